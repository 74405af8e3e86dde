"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A batch is cut into slices of about a megabyte, and a slice is handled as one byte array with the bounds of its
documents. All character classes in use are ASCII ranges and "everything else", so bytes are enough.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """True for every byte outside the given inclusive ranges."""
    out = np.ones(256, bool)
    for low, high in excluded:
        out[low : high + 1] = False
    return out


#: Bytes of ``[^\x20\x09-\x0D]+``
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all their bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[name] = np.cumprod(grown)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """c such that (c[j] - c[i]) * base**-i hashes data[i:j]; see ``span_hashes``."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[:-1], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of every data[start:end]; equal spans have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


#: Longer words are hashed by BLAKE2b.
SHORT = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of every data[start:end], eight bytes at a time, each stirred into what came before.

    Unlike a polynomial modulo a power of two this has no structure by which regular words meet.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + U64((_BASE * (2 * salt + 1)) % 2**64))
    # Eight bytes from any place of the data on.
    eights = np.ndarray(len(data), "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    active, at = np.flatnonzero(size <= SHORT), 0
    while len(active):
        left = size[active] - at
        some = eights[start[active] + at]
        some = np.where(left >= 8, some, some & ((U64(1) << (U64(8) * np.minimum(left, 7).astype(np.uint64))) - U64(1)))
        out[active] = mix((out[active] ^ some) * U64(_BASE) + U64(at + 1))
        at += 8
        active = active[left > 8]
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
    return out


def same_bytes(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray, size: np.ndarray, most: int = 1_000_000) -> np.ndarray:
    """Whether left[a:a + size] equals right[b:b + size], for many places; every size is above zero.

    About ``most`` bytes are compared at once.
    """
    out = np.zeros(len(size), bool)
    share = np.cumsum(size) // most
    for some in np.split(np.arange(len(size)), np.flatnonzero(np.diff(share)) + 1) if len(size) else []:
        n = size[some]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        out[some] = np.logical_and.reduceat(left[np.repeat(a[some], n) + step] == right[np.repeat(b[some], n) + step], first)
    return out


class Slice:
    """Consecutive rows of a batch: ``data`` holds their bytes, document i is data[start[i]:end[i]]."""

    def __init__(self, batch: pa.RecordBatch, data: np.ndarray, start: np.ndarray, end: np.ndarray, valid: np.ndarray):
        self.batch, self.data, self.start, self.end, self.valid = batch, data, start, end, valid

    def __len__(self) -> int:
        return len(self.start)

    def words(self, lowered: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all maximal runs of bytes of a class, and for each document its first run (n + 1 values)."""
        member = inside[lowered]
        before, after = np.empty_like(member), np.empty_like(member)
        before[1:], after[:-1] = member[:-1], member[1:]
        if len(member):
            before[0] = after[-1] = False
        full = self.end > self.start
        before[self.start[full]] = False
        after[self.end[full] - 1] = False
        starts = np.flatnonzero(member & ~before)
        ends = np.flatnonzero(member & ~after) + 1
        bounds = np.searchsorted(starts, np.append(self.start, len(member)))
        return starts, ends, bounds


def give_back() -> None:
    """Return freed memory to the system, where its C library can: a worker waits for later stages beside others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[Slice]:
    """Slices of about ``most`` bytes; a longer document gets one of its own. A null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary())
        valid = np.asarray(texts.is_valid())
        if not valid.all():
            texts = texts.fill_null(b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        low = 0
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + most, "right")) - 1)
            part = bounds[low : high + 1] - bounds[low]
            yield Slice(batch.slice(low, high - low), data[bounds[low] : bounds[high]], part[:-1], part[1:], valid[low:high])
            low = high
    give_back()


def ids(batch: pa.RecordBatch, column: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(column))


def runs(values: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
