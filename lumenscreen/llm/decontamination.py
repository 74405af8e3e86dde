"""Benchmark decontamination with an FM-index for each training shard (operator 1).

A task cuts its documents into shards of about a megabyte. The words of a shard become identifiers of the benchmark's
vocabulary; runs of known words that are long enough to hold a window are indexed, as no window can lie elsewhere.
All benchmark windows are searched backwards through the index at once, their occurrences are located from sampled
suffix positions, and overlapping occurrences merge into removal spans. Documents are never shuffled.

The benchmark is read in blocks of bounded size (``block_bytes``), whose windows, about ten times its bytes, are
broadcast. A pass over the rows takes ``blocks_at_once`` blocks one after the other in one Python function; between
passes the rows and what was found are stored, so neither the plan nor a worker's memory grows with the benchmark.
Words are looked up by a hash and their bytes compared, so no other word passes for one of the benchmark's.

A window is 13 consecutive words of an item; a shorter item is one window; an item without words has none.
Defined cases: a null or empty text has no words and is never contaminated; a null item text has no window; repeated
item ids count once for a document; a null item id is named "null"; a text of any length is one shard or more; repeated document rows each get their own result; an empty benchmark marks
nothing; columns of docs beyond doc_id and text are kept by ``find_contamination`` under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .shared import discard, small_batches, stored
from .text import ALNUM, LOWER, same_bytes, slices, word_hashes

WINDOW = 13


class Windows:
    """The windows of a block of items, as rows of identifiers for each window length, and the items that have each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        batch = pa.RecordBatch.from_pydict({"text": [t for _, t in items]}, schema=pa.schema([("text", pa.large_string())]))
        symbols, bounds, self.vocabulary = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, np.uint64)
        for part in slices(iter([batch]), most=1 << 62):
            lowered = LOWER[part.data]
            start, end, bounds = part.words(lowered, ALNUM)
            symbols = self._learn(lowered, start, end)
        self.items = [x for x, _ in items]
        self._index(symbols, bounds, window)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The vocabulary: hashes, and bytes of each word; 1 and on for every word. Hashes that meet are salted anew."""
        for salt in range(64):
            self.salt = salt
            self.vocabulary, first, symbols = np.unique(word_hashes(data, start, end, salt), return_index=True, return_inverse=True)
            size = end - start
            same = size == size[first][symbols]
            some = np.flatnonzero(same)
            if same.all() and same_bytes(data, start[some], data, start[first][symbols[some]], size[some]).all():
                break
        else:
            raise ValueError("different words of a benchmark block always have equal hashes")
        self.size = size[first]
        at = np.cumsum(self.size) - self.size
        self.bytes = data[np.repeat(start[first] - at, self.size) + np.arange(int(self.size.sum()))]
        self.at = at
        return (symbols + 1).astype(np.int32)

    def known(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The symbols of words, 0 for words that aren't in the vocabulary."""
        hashes = word_hashes(data, start, end, self.salt)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        size = end - start
        likely = np.flatnonzero((self.vocabulary[at] == hashes) & (self.size[at] == size))
        likely = likely[same_bytes(data, start[likely], self.bytes, self.at[at[likely]], size[likely])]
        out = np.zeros(len(start), np.int64)
        out[likely] = at[likely] + 1
        return out

    def _index(self, symbols: np.ndarray, bounds: np.ndarray, window: int) -> None:
        items = self.items
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        counts = np.diff(bounds)
        sizes = np.minimum(counts, window)
        for length in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == length)
            n = counts[own] - length + 1
            item = np.repeat(own, n)
            at = np.repeat(bounds[:-1][own], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(symbols, length)[at])
            _, first, name = np.unique(rows.view(np.dtype((np.void, 4 * length))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(name * np.int64(len(items)) + item)
            owners = np.append(0, np.cumsum(np.bincount(pairs // len(items), minlength=len(first))))
            self.by_length[length] = (rows[first], owners, (pairs % len(items)).astype(np.int32))


def _hits(known: np.ndarray, bounds: np.ndarray, windows: Windows, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in words, of all occurrences, and (start, item) pairs; known: identifiers, 0 for other words."""
    shortest = min(windows.by_length)
    first = np.zeros(len(known), bool)
    first[bounds[:-1][bounds[:-1] < len(known)]] = True
    inside = known > 0
    begins = np.flatnonzero(inside & (first | ~np.append(False, inside[:-1])))
    finishes = np.flatnonzero(inside & (np.append(first[1:], True) | ~np.append(inside[1:], False))) + 1
    keep = finishes - begins >= shortest
    begins, lengths = begins[keep], (finishes - begins)[keep]
    nothing = np.zeros((0, 2), np.int64)
    if not len(begins):
        return nothing, nothing
    # Each run behind a separator; word[k] is the word that symbol k stands for.
    offset = np.append(0, np.cumsum(lengths + 1))
    word = np.repeat(begins - offset[:-1] - 1, lengths + 1) + np.arange(offset[-1])
    symbols = np.zeros(offset[-1], np.int64)
    body = np.ones(offset[-1], bool)
    body[offset[:-1]] = False
    symbols[body] = known[word[body]]
    index = FMIndex(symbols, len(windows.vocabulary) + 1, sample)
    spans, items = [nothing], [nothing]
    for length, (patterns, owner_bounds, owners) in windows.by_length.items():
        low, high = index.search(patterns)
        which = np.repeat(np.arange(len(low)), high - low)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[which]
        at = word[index.locate(rows)]
        spans.append(np.stack([at, at + length], 1))
        n = np.diff(owner_bounds)[which]
        owner = owners[np.repeat(owner_bounds[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        items.append(np.stack([np.repeat(at, n), owner], 1))
    return np.concatenate(spans), np.concatenate(items)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values, kind))


def _marker(blocks: list, shard_bytes: int, sample: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "_text", shard_bytes):
            lowered = LOWER[part.data]
            start, end, bounds = part.words(lowered, ALNUM)
            n_words = np.diff(bounds)
            doc = np.repeat(np.arange(len(part)), n_words)
            cover = np.zeros(len(start) + 1, np.int64)
            own, names = [], []
            for shared in blocks:
                windows: Windows = shared.value
                if not windows.by_length or not len(start):
                    continue
                spans, items = _hits(windows.known(lowered, start, end), bounds, windows, sample)
                np.add.at(cover, spans[:, 0], 1)
                np.add.at(cover, spans[:, 1], -1)
                pairs = np.unique(np.stack([doc[items[:, 0]], items[:, 1]], 1), axis=0)
                own.append(pairs[:, 0])
                names.append(np.array(windows.items, object)[pairs[:, 1]])
            earlier = part.batch.column(part.batch.schema.get_field_index("word_spans"))
            flat = np.asarray(earlier.flatten(), np.int64)
            if len(flat):
                shift = np.repeat(bounds[:-1], np.asarray(pa.compute.fill_null(pa.compute.list_value_length(earlier), 0)))
                np.add.at(cover, (flat + shift)[0::2], 1)
                np.add.at(cover, (flat + shift)[1::2], -1)
            hit = np.cumsum(cover)[:-1] > 0
            # Merged spans: maximal runs of hit words within a document.
            edge = np.zeros(len(start) + 1, bool)
            edge[bounds] = True
            s = np.flatnonzero(hit & (edge[:-1] | ~np.append(False, hit[:-1])))
            e = np.flatnonzero(hit & (edge[1:] | ~np.append(hit[1:], False)))
            per_doc = np.bincount(doc[s], minlength=len(part)) if len(s) else np.zeros(len(part), np.int64)
            words = np.stack([s - bounds[doc[s]], e + 1 - bounds[doc[s]]], 1).ravel()
            octets = np.stack([start[s] - part.start[doc[s]], end[e] - part.start[doc[s]]], 1).ravel()
            owner, name = np.concatenate([np.zeros(0, np.int64), *own]), np.concatenate([np.zeros(0, object), *names])
            order = np.argsort(owner, kind="stable")
            new_items = _lists(name[order], np.bincount(owner, minlength=len(part)), pa.string())
            columns = {n: part.batch.column(i) for i, n in enumerate(part.batch.schema.names)}
            columns |= {"n_words": pa.array(n_words, pa.int64()), "word_spans": _lists(words, 2 * per_doc, pa.int32()), "byte_spans": _lists(octets, 2 * per_doc, pa.int32()), "new_items": new_items}
            yield pa.RecordBatch.from_pydict(columns)

    return mark


def _span_columns(df: DataFrame) -> DataFrame:
    none = F.array().cast("array<int>")
    return df.withColumns({"n_words": F.lit(0).cast("long"), "word_spans": none, "byte_spans": none, "items": F.array().cast("array<string>"), "new_items": F.array().cast("array<string>")})


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 750_000, block_bytes: int = 4_000_000, sample: int = 16, blocks_at_once: int = 4) -> DataFrame:
    """doc_id, doc (the whole row), n_words, word_spans and byte_spans (start, end, start, end ...), sorted items."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").alias("text")).where(F.col("text").isNotNull())
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    out = _span_columns(docs.select(F.struct("*").alias("doc"), F.col("text").alias("_text")))
    held = None
    for low in range(0, blocks, blocks_at_once):
        shared = []
        for block in range(low, min(blocks, low + blocks_at_once)):
            own = texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
            shared.append(spark.sparkContext.broadcast(Windows([tuple(x) for x in sorted(own)], window)))
        out = out.mapInArrow(_marker(shared, shard_bytes, sample), out.schema)
        out = out.withColumn("items", F.array_distinct(F.concat("items", "new_items")))
        if low + blocks_at_once < blocks:
            out = stored(out)
            if held is not None:
                discard(held)
            held = out
    return out.select(F.col("doc.doc_id").alias("doc_id"), "doc", "n_words", "word_spans", "byte_spans", F.array_sort("items").alias("items"))


def hit_words(word_spans) -> F.Column:
    """Sum of ends less sum of starts."""
    return F.aggregate(F.transform(word_spans, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: at least a twentieth of the words is hit."""
    n_hit = hit_words("word_spans")
    out = find_contamination(docs, benchmark, **options).select("doc_id", "n_words", n_hit.alias("n_hit"), "items")
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, unchanged."""
    n_hit = hit_words("word_spans")
    found = find_contamination(docs, benchmark, **options)
    return found.where(~((n_hit > 0) & (20 * n_hit >= F.col("n_words")))).select("doc.*")
