"""Packing documents into training sequences along a space-filling curve (operator 13).

1. A scan tokenizes each text, appends the end id, hashes the ids to a vector of damped counts and projects it to a few
   dimensions with fixed random directions. Ids are stored, in rows of at most ``row_ids`` ids.
2. The range of each dimension over all documents makes a grid; a document's cell on the Hilbert curve is its key.
3. Rows are range-sorted by (key, id, start): documents that are near each other follow each other, and copies with one
   key still go to different partitions by id.
4. Each partition is one stream of ids, cut at every ``length`` ids. What is left at a partition's end is cut into
   sequences of falling powers of two, which need no padding, so nothing is padded at all. Spark samples where ranges end,
   so another run may cut the stream at other ids; the result is stored and doesn't change within a run.

Ids are those of the tokenizers library for the definition. Of a byte-level BPE whose merges make ever larger ids, the
same ids come from the tiktoken library, made of the same definition, at a quarter of the time; texts are then read in
stretches cut before a space that follows another character, where a token always begins, so a long text needs little
more memory than its ids. Other definitions go through tokenizers, whole text by whole text.

Defined cases: a null or empty text is its end id alone; strings of special tokens in a text are ordinary text; repeated
rows and null ids are documents of their own, null ids first within a key; texts without white space are one piece; an
empty table gives no sequences; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, small_batches, stored

#: White space as tokenizers know it: Python's without the four separators of ASCII.
_BREAK = re.compile(r"(?<=[\S\x1c-\x1f])[^\S\x1c-\x1f]")
STRETCH = 500_000
#: Fixed value: how byte-level definitions split a text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where no two white spaces follow each other.
_SPLIT_PLAIN = _SPLIT.replace(r"|\s+(?!\S)", "")
_RUN = re.compile(r"\s\s")
#: Ids of a range partition, about; twice their bytes on disk at most.
RANGE_IDS = 16_000_000
MOST_RANGES = 50_000


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level definitions write for each byte: printable ones are themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranks(definition: dict) -> dict[bytes, int] | None:
    """Bytes of all tokens and their ids, if the definition is a plain byte-level BPE whose ids rise with its merges."""
    model, before = definition["model"], definition.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not definition.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = any(model.get(n) for n in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or odd:
        return None
    letters, vocabulary = _byte_letters(), model["vocab"]
    made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    special = {t["content"] for t in definition.get("added_tokens", [])}
    single = [i for t, i in vocabulary.items() if len(t) == 1]
    if made != sorted(made) or len(single) != 256 or made[0] < max(single):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}


@functools.lru_cache(maxsize=2)
def _encoding(definition: str):
    """(encode a stretch of text, number of ids, may texts be cut)."""
    parsed = json.loads(definition)
    if ranks := _ranks(parsed):
        import tiktoken

        fast, plain = (tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("given", _SPLIT), ("given, plain", _SPLIT_PLAIN)))
        return lambda text: (fast if _RUN.search(text) else plain).encode_ordinary(text), max(ranks.values()) + 1, True
    from tokenizers import Tokenizer

    slow = Tokenizer.from_str(definition)
    slow.encode_special_tokens = True
    return lambda text: slow.encode(text, add_special_tokens=False).ids, slow.get_vocab_size(), False


class Encoder:
    """Ids of texts as bytes of little-endian numbers."""

    def __init__(self, definition: str):
        self.encode, n_ids, self.cut = _encoding(definition)
        self.kind = np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            later = _BREAK.search(text, at + STRETCH) if self.cut and len(text) - at > STRETCH else None
            end = later.start() if later else len(text)
            out.append(np.array(self.encode(text[at:end] if at or end < len(text) else text), self.kind).tobytes())
            at = end
        return b"".join(out)


def directions(dims: int, hashed: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(hashed, dims)) / np.sqrt(hashed)


def project(ids: np.ndarray, towards: np.ndarray) -> np.ndarray:
    """The unit vector of square-rooted counts of hashed ids, projected."""
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    counts = np.sqrt(np.bincount((hashed % np.uint64(len(towards))).astype(np.int64), minlength=len(towards)))
    return counts @ towards / max(1.0, float(np.linalg.norm(counts)))


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows x dimensions, ``bits`` bits each): neighbours on it share a face.

    From the highest bit down, the digit of a cell is the Gray code's rank of its half-spaces; the rest of the cell is
    then reflected and has two axes exchanged, so that each sub-cube is entered where the last one was left.
    """
    n = cells.shape[1]
    x = cells.astype(np.int64).T.copy()
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for d in range(n):
            upper = (x[d] >> level) & 1 == 1
            # In the upper half the first axis turns round, in the lower half it changes places with axis d.
            swap = np.where(upper, 0, (x[0] ^ x[d]) & below)
            x[0] ^= np.where(upper, below, swap)
            x[d] ^= swap if d else 0
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def _tokens(shared, end_id: int, dims: int, hashed: int, row_ids: int):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, towards = Encoder(shared.value), directions(dims, hashed)
        end = np.array([end_id], encode.kind).tobytes()
        wide = encode.kind.itemsize
        for batch in batches:
            names = batch.column(0)
            rows: list[tuple] = []
            held = 0
            for i, text in enumerate(batch.column(1)):
                raw = encode(text.as_py() or "") + end
                ids = np.frombuffer(raw, encode.kind)
                where = project(ids, towards).tolist()
                rows.extend((i, at, raw[wide * at : wide * (at + row_ids)], len(ids), where) for at in range(0, len(ids), row_ids))
                held += len(raw)
                if held > 4_000_000 or i == batch.num_rows - 1:
                    doc, start, ids, total, where = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": names.take(pa.array(doc)), "start": pa.array(start, pa.int64()), "ids": pa.array(ids, pa.binary()), "doc_tokens": pa.array(total, pa.int64()), "place": pa.array(where, pa.list_(pa.float64()))})
                    rows, held = [], 0

    return tokenize


def _keys(low: list[float], high: list[float], bits: int):
    base = np.array(low)
    scale = ((1 << bits) - 1) / np.maximum(np.array(high) - base, 1e-300)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column(4).flatten()).reshape(batch.num_rows, len(base))
            cells = ((place - base) * scale).astype(np.int64).clip(0, (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_keys(cells, bits)), *batch.columns[:4]], names=["key", *batch.schema.names[:4]])

    return key


def cuts(left: int) -> list[int]:
    """Falling powers of two that add up to left."""
    return [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def _sequences(length: int, width: int, doc_type: pa.DataType):
    kind = np.dtype("<u2" if width == 2 else "<u4")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        made = 0
        # The open sequence: pieces of (doc_id, start, ids as 32 bits, doc_tokens).
        open_: list[tuple] = []
        filled = 0
        done: list[tuple[int, list[tuple]]] = []

        def batch_of(rows: list[tuple[int, list[tuple]]]) -> pa.RecordBatch:
            flat = [p for _, pieces in rows for p in pieces]
            sizes = np.array([len(p[2]) // 4 for p in flat], np.int64)
            n = np.array([len(pieces) for _, pieces in rows], np.int64)
            bounds = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            first_piece = np.cumsum(n) - n
            at = np.cumsum(sizes) - sizes
            offset = at - np.repeat(at[first_piece], n)
            per_row = np.add.reduceat(sizes, first_piece)
            ids = np.frombuffer(b"".join(p[2] for p in flat), "<u4").astype(kind).tobytes()
            ends = (width * np.cumsum(per_row)).tolist()
            fields = {
                "doc_id": pa.array([p[0] for p in flat], doc_type), "start": pa.array([p[1] for p in flat], pa.int64()), "length": pa.array(sizes, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(p[2]) for p in flat], pa.int64()), "doc_tokens": pa.array([p[3] for p in flat], pa.int64()), "offset": pa.array(offset, pa.int64()),
            }
            pieces = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
            tokens = pa.array([ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), tokens, pa.ListArray.from_arrays(bounds, pieces)], names=["sequence_id", "ids", "pieces"])

        for batch in batches:
            for doc, start, ids, total in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                raw, at = np.frombuffer(ids, kind).astype("<u4").tobytes(), 0
                while at < len(raw):
                    some = raw[at : at + 4 * (length - filled)]
                    open_.append((doc, start + at // 4, some, total))
                    filled += len(some) // 4
                    at += len(some)
                    if filled == length:
                        done.append((first + made, open_))
                        made, open_, filled = made + 1, [], 0
                if len(done) >= 512:
                    yield batch_of(done)
                    done = []
        for size in cuts(filled):
            own: list[tuple] = []
            while size:
                doc, start, raw, total = open_.pop(0)
                if len(raw) > 4 * size:
                    open_.insert(0, (doc, start + size, raw[4 * size :], total))
                    raw = raw[: 4 * size]
                own.append((doc, start, raw, total))
                size -= len(raw) // 4
            done.append((first + made, own))
            made += 1
        if done:
            yield batch_of(done)

    return pack


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 0, dims: int = 4, bits: int = 12, hashed: int = 1024, row_ids: int = 65_536) -> DataFrame:
    """sequence_id, ids, pieces (array of doc_id, start, length, ids_crc32, doc_tokens, offset).

    ``ids`` are little-endian numbers of two bytes, or of four if the vocabulary needs them. ``tokenizer`` is the path of a definition for the tokenizers library, as the driver sees it; tasks are sent its
    contents. A sequence has ``length`` ids or a smaller power of two of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    definition = Path(tokenizer).read_text(encoding="utf-8")
    width = Encoder(definition).kind.itemsize
    doc = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    own = [doc, T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())]
    shared = spark.sparkContext.broadcast(definition)
    place = T.StructField("place", T.ArrayType(T.DoubleType()))
    tokens = stored(docs.select("doc_id", "text").mapInArrow(_tokens(shared, end_id, dims, hashed, row_ids), T.StructType([*own, place])))
    spread = tokens.agg(F.sum(F.octet_length("ids")).alias("bytes"), *[f(F.col("place")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("low", F.min), ("high", F.max))]).first()
    parts = min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), (spread.bytes or 0) // width // RANGE_IDS))
    low, high = ([spread[f"{n}{d}"] or 0.0 for d in range(dims)] for n in ("low", "high"))
    keyed = tokens.mapInArrow(_keys(low, high, bits), T.StructType([T.StructField("key", T.LongType()), *own]))
    ordered = keyed.repartitionByRange(parts, "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start")
    piece = T.StructType([doc, *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "offset")]])
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("pieces", T.ArrayType(piece))])
    arrow = keyed.select("doc_id").limit(0).toArrow().schema.field(0).type
    packed = stored(ordered.mapInArrow(_sequences(length, width, arrow), schema))
    discard(tokens)
    return packed


def pieces(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return pack(docs, tokenizer, **options).select("sequence_id", F.explode("pieces").alias("p")).select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")
