"""Target-distribution importance resampling by bit-sliced aggregation (operator 12).

1. A scan hashes the word n-grams of each text to buckets and writes the counts of a document as bit planes: plane p is
   a bitmap over the buckets whose bit b is bit p of the count of bucket b. Planes are stored; texts are read once.
2. The corpus counts are the planes' columns added with their powers of two, in tasks, then by Spark: a number a bucket.
3. A bucket's gain, the logarithm of how much more often the target holds it, becomes signed bit planes as well, in
   two's complement. A document's weight is exact: sum over planes p and q of 2**(p+q) * popcount(counts p AND gains q),
   the sign plane counted negative. The gain planes, bits x buckets / 8 bytes, are what tasks are sent.
4. The best draws by weight plus a Gumbel number of the document's id are ranked over range partitions of
   (score, id): counts of the partitions give offsets, and only partitions that hold draws number their rows.

Defined cases: a null, empty or wordless text has no features and the weight 0; a null id is hashed as ``null`` and
ordered last among equal scores; rows that repeat an id are documents of their own, with the same Gumbel number;
an empty target or corpus has no features in any bucket; a text of any length is read in pieces between words; an empty table gives
no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, discard, small_batches, stored
from .text import slices

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PIECE = 1_000_000
#: Rows of a range partition, about, in tables that need more of them than the session's shuffle partitions.
RANGE_ROWS = 2_000_000


def words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a lower-cased text, in lists of about a megabyte of it."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        # A word isn't cut: its other bytes belong to this piece.
        while end < len(text) and (more := _WORD.match(text, end)):
            end = more.end()
        yield _WORD.findall(text, at, end)
        at = end


def bucket_counts(text: bytes, buckets: int, longest: int) -> np.ndarray:
    """How often each bucket occurs: crc32 of all runs of 1 to ``longest`` words, joined by a space."""
    counts, held = np.zeros(buckets, np.int64), []
    for some in words(text.lower()):  # of bytes: A-Z only
        for n in range(1, longest + 1):
            run = [*held[max(0, len(held) - n + 1) :], *some] if n > 1 else some
            grams = run if n == 1 else [b" ".join(run[i : i + n]) for i in range(len(run) - n + 1)]
            if grams:
                counts += np.bincount(np.fromiter(map(zlib.crc32, grams), np.uint32, len(grams)) % buckets, minlength=buckets)
        held = [*held, *some][-(longest - 1) :] if longest > 1 else []
    return counts


def width(buckets: int) -> int:
    """64-bit words of a plane."""
    return -(-buckets // 64)


def planes_of(values: np.ndarray, bits: int) -> np.ndarray:
    """bits x width bitmaps: bit b of plane p is bit p of values[b]; negative values in two's complement."""
    out = np.zeros((bits, width(len(values)) * 8), np.uint8)
    for p in range(bits):
        packed = np.packbits(((values >> p) & 1).astype(np.uint8), bitorder="little")
        out[p, : len(packed)] = packed
    return out.view(np.uint64)


def _planes(buckets: int, longest: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sizes, bounds, out = np.zeros(len(part), np.int64), np.zeros(len(part) + 1, np.int64), []
            for i, (a, b) in enumerate(zip(part.start.tolist(), part.end.tolist(), strict=True)):
                counts = bucket_counts(part.data[a:b].tobytes(), buckets, longest)
                sizes[i] = counts.sum()
                own = planes_of(counts, int(counts.max()).bit_length())
                out.extend(x.tobytes() for x in own)
                bounds[i + 1] = len(out)
            planes = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, pa.binary()))
            yield pa.RecordBatch.from_arrays([part.batch.column(part.batch.schema.get_field_index("doc_id")), pa.array(sizes), planes], names=["doc_id", "n_features", "planes"])

    return count


def bit_planes(docs: DataFrame, buckets: int, longest: int) -> DataFrame:
    """doc_id, n_features, planes: the bucket counts of each document, no planes without features."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_features", T.LongType()), T.StructField("planes", T.ArrayType(T.BinaryType()))])
    return docs.select("doc_id", "text").mapInArrow(_planes(buckets, longest), schema)


def _rows(batch: pa.RecordBatch, name: str = "planes") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All planes of a batch (rows x width), the document and the power of two of each."""
    lists = batch.column(batch.schema.get_field_index(name))
    flat = lists.flatten()
    n = np.asarray(pa.compute.list_value_length(lists), np.int64)
    doc = np.repeat(np.arange(len(n)), n)
    power = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    bits = np.frombuffer(b"".join(flat.to_pylist()), np.uint64)
    return bits.reshape(len(doc), -1) if len(doc) else np.zeros((0, 1), np.uint64), doc, power


def _column_sums(buckets: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            bits, _, power = _rows(batch)
            for p in np.unique(power).tolist():
                own = bits[power == p]
                for at in range(0, len(own), 255):  # a column of 255 ones still fits in a byte
                    ones = np.unpackbits(own[at : at + 255].view(np.uint8), axis=1, bitorder="little")[:, :buckets]
                    total += ones.sum(0, dtype=np.uint8).astype(np.int64) << p
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    return add


def totals(planes: DataFrame, buckets: int) -> np.ndarray:
    """Corpus count of each bucket; the driver reads a number a bucket."""
    out = np.zeros(buckets, np.int64)
    for r in planes.select("planes").mapInArrow(_column_sums(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of the target's and the corpus's share) of each bucket."""
    n, big_s, big_t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + n) / ((s + 1.0) * (big_t + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigher(gain: np.ndarray):
    """Batches of doc_id, n_features, planes -> doc_id, n_features, weight."""
    bits = max(int(gain.max()).bit_length(), int(-1 - gain.min()).bit_length()) + 1
    masks = planes_of(gain, bits)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, doc, power = _rows(batch)
            weight = np.zeros(batch.num_rows, np.int64)
            for at in range(0, len(own), 512):
                some = own[at : at + 512]
                value = np.zeros(len(some), np.int64)
                for q in range(bits):
                    ones = np.bitwise_count(some & masks[q]).sum(1, dtype=np.int64)
                    value += -(ones << q) if q == bits - 1 else ones << q
                np.add.at(weight, doc[at : at + 512], value << power[at : at + 512])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return weigh


def gumbel(doc_id: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of the SHA-256 of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, most: int, order: list[Column], kept: str, parts: int) -> DataFrame:
    """rows with ``kept``: 1, 2, 3 ... of the first ``most`` in the order, null for the others; no task holds all rows."""
    ranged = cut(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = sorted((r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.count("*").alias("n")).collect())
    offsets, at = [], 0
    for name, n in sizes:
        if at < most:
            offsets.append((name, at))
        at += n
    reached = len(offsets) and offsets[-1][0]
    head = ranged.where(F.col("_range") <= reached) if offsets else ranged.limit(0)
    tail = ranged.where(F.col("_range") > reached) if offsets else ranged
    before = ranged.sparkSession.createDataFrame(offsets, "_range int, _before long") if offsets else None
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    if before is not None:
        # A row for each partition of the range exchange.
        head = head.join(F.broadcast(before), "_range").withColumn("_place", F.col("_before") + place)
        head = head.withColumn(kept, F.when(F.col("_place") <= most, F.col("_place")))
    else:
        head = head.withColumn(kept, F.lit(None).cast("long"))
    return head.select(*rows.columns, kept).unionByName(tail.withColumn(kept, F.lit(None).cast("long")).select(*rows.columns, kept))


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, percent: int = 10, least_words: int = 20, seed: str = "2024") -> DataFrame:
    """doc_id, n_features, weight, score, rank of all documents; rank is null for those that aren't drawn.

    Of the documents with at least ``least_words`` words, ``percent`` in a hundred are drawn: the highest scores, ties
    to the smaller id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    planes = stored(bit_planes(docs, buckets, longest))
    wanted = target.select(F.lit(0).alias("doc_id"), "text")
    gain = gains(totals(planes, buckets), totals(bit_planes(wanted, buckets, longest), buckets))
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_features", T.LongType()), T.StructField("weight", T.LongType())])
    # Runs of 1 to n words: a document of w words has w + (w - 1) + ... of them.
    enough = sum(max(0, least_words - n) for n in range(longest))
    scored = stored(planes.mapInArrow(weigher(gain), schema).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    discard(planes)
    able = scored.where(F.col("n_features") >= enough)
    n = able.count()
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc(), F.col("weight").desc()]
    drawn = numbered(able, n * percent // 100, order, "rank", max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS))
    return drawn.unionByName(scored.where(F.col("n_features") < enough).withColumn("rank", F.lit(None).cast("long")))
