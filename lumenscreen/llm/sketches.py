"""Word shingles, MinHash samples and odd sketches of documents, vectorised over slices of a batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .text import LOWER, Slice, mix, slices, word_hashes

SKETCH_BITS = 2048


def shingle_sets(part: Slice, inside: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of each document: values and bounds (n + 1)."""
    lowered = LOWER[part.data]
    start, end, first = part.words(lowered, inside)
    tokens = word_hashes(lowered, start, end)
    counts = np.diff(first)
    n = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    # Every position with its word-gram; those that would cross into the next document are cut below.
    grams = np.zeros(len(tokens), np.uint64)
    for k in range(words):
        later = tokens[k:] if k else tokens
        grams[: len(later)] = mix(grams[: len(later)] * np.uint64(0x9E3779B97F4A7C15) + later + np.uint64(k + 1))
    for i in np.flatnonzero((counts > 0) & (counts < words)):
        value = np.zeros(1, np.uint64)
        for k, t in enumerate(tokens[first[i] : first[i + 1]]):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + t + np.uint64(100 + k))
        grams[first[i]] = value[0]
    pieces, sizes = [], np.zeros(len(part), np.int64)
    for i in range(len(part)):
        own = grams[first[i] : first[i] + n[i]]
        own = np.sort(own)
        own = own[np.append(True, own[1:] != own[:-1])] if len(own) else own
        pieces.append(own)
        sizes[i] = len(own)
    return (np.concatenate(pieces) if pieces else grams[:0]), np.append(0, np.cumsum(sizes))


def minhashes(values: np.ndarray, bounds: np.ndarray, samples: int, seed: int = 11) -> np.ndarray:
    """samples x documents smallest hashes under as many multiply-shift permutations; documents must not be empty."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, samples, dtype=np.uint64) | np.uint64(1)
    shifts = rng.integers(1, 2**63, samples, dtype=np.uint64)
    out = np.empty((samples, len(bounds) - 1), np.uint64)
    low = bounds[:-1]
    for k in range(samples):
        h = values ^ shifts[k]
        h *= factors[k]
        h ^= h >> np.uint64(32)
        h *= factors[(k + 1) % samples]
        out[k] = np.minimum.reduceat(h, low)
    return out


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps: each sample flips one bit. documents x 64-bit words.

    Two documents that differ in d samples differ in about bits / 2 * (1 - exp(-4 d / bits)) bits.
    """
    n = samples.shape[1]
    at = (mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64)[:, None]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((at + SKETCH_BITS * np.arange(n)).ravel(), minlength=n * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(flips.reshape(n, SKETCH_BITS), axis=1).view(np.uint64)


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """documents x bands: one 64-bit key for each group of rows consecutive samples."""
    bands = len(samples) // rows
    out = np.empty((samples.shape[1], bands), np.uint64)
    for b in range(bands):
        key = np.full(samples.shape[1], b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples[b * rows + r])
        out[:, b] = key
    return out


def sequence_digests(part: Slice, inside: np.ndarray) -> list[bytes]:
    """SHA-256 of each document's lower-cased words with a space behind each."""
    member = inside[LOWER[part.data]]
    stays = member.copy()
    stays[1:] |= member[:-1]
    stays[part.start[part.end > part.start]] = member[part.start[part.end > part.start]]
    octets = np.where(member, LOWER[part.data], np.uint8(32))[stays]
    at = np.append(0, np.cumsum(stays))
    ends_in_word = np.zeros(len(part), bool)
    full = part.end > part.start
    ends_in_word[full] = member[part.end[full] - 1]
    return [hashlib.sha256(octets[a:b].tobytes() + b" " * w).digest() for a, b, w in zip(at[part.start].tolist(), at[part.end].tolist(), ends_in_word.tolist(), strict=True)]


SIGNATURE = "doc_id long, n_shingles long, digest binary, bands array<long>"


def signer(inside: np.ndarray, words: int, bands: int, rows: int):
    """mapInArrow function: (doc_id, text) -> SIGNATURE. A document without words has null bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, bounds = shingle_sets(part, inside, words)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            keys = np.zeros((0, bands), np.uint64)
            if len(full):
                keys = band_keys(minhashes(values, np.append(bounds[full], len(values)), bands * rows), rows)
            where = np.append(0, np.cumsum((sizes > 0) * bands))
            column = pa.ListArray.from_arrays(pa.array(where, pa.int32()), pa.array(keys.ravel().view(np.int64)), mask=pa.array(sizes == 0))
            digests = pa.array(sequence_digests(part, inside), pa.binary())
            yield pa.RecordBatch.from_arrays([part.batch.column(0).cast(pa.int64()), pa.array(sizes), digests, column], names=["doc_id", "n_shingles", "digest", "bands"])

    return sign


def setter(inside: np.ndarray, words: int, samples: int):
    """mapInArrow function: (doc_id, text) -> doc_id, whole shingle set and odd sketch as bytes; for documents with words."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, bounds = shingle_sets(part, inside, words)
            full = np.flatnonzero(np.diff(bounds))
            if not len(full):
                continue
            sketch = odd_sketches(minhashes(values, np.append(bounds[full], len(values)), samples))
            sets = [values[bounds[i] : bounds[i + 1]].tobytes() for i in full]
            yield pa.RecordBatch.from_arrays([part.batch.column(0).take(pa.array(full)).cast(pa.int64()), pa.array(sets, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())], names=["doc_id", "shingles", "sketch"])

    return make
