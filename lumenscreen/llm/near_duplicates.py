"""MinHash near-duplicates with odd sketches (operator 10).

1. A scan gives each document its number of shingles, the SHA-256 of its word sequence and band keys of MinHash
   samples. Documents with equal sequences, whose sets are equal then, are copies; only the first of them goes on.
2. Documents that share a band key form a bucket. Every member is compared with the smallest one of its bucket.
3. Buckets whose members are still in several components are compared in full, block by block, inside tasks that
   hold two blocks of sketches and sets; only links leave them.
4. A pair is compared by odd sketches: parity bitmaps of 512 MinHash samples, whose XOR has few bits where the sets
   are alike. Pairs far below the threshold end there; the others are confirmed on their whole shingle sets.
5. Confirmed links give components by large-star and small-star steps.

With 20 bands of 4 rows a pair at a similarity of 0.85 misses all buckets once in two million, at 0.8 once in
30,000; the sketch test is five standard deviations wide at the threshold.

Batches are bounded in bytes, and a longer text is handled whole by itself. A bucket whose members stay in several
components is compared block by block, which is quadratic in its size.

Defined cases: a null, empty or wordless text has no shingles, links with nothing and is kept; a text with fewer words
than a shingle is one shingle; a null doc_id links with nothing, has a null component and is kept; rows that repeat a
doc_id share a result, that of the row with more shingles; extra columns are ignored or, in ``drop_near_duplicates``,
kept under their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, held, salted_join, small_batches, stored
from .sketches import SIGNATURE, SKETCH_BITS, setter, signer
from .text import NOT_SPACE

BLOCK = 512


def sketch_limit(percent: int, samples: int) -> int:
    """Differing bits that a pair at the threshold passes only once in millions."""
    p = 1 - percent / 100
    differing = samples * p + 5 * (samples * p * (1 - p)) ** 0.5
    bits = SKETCH_BITS / 2 * (1 - np.exp(-4 * differing / SKETCH_BITS))
    return int(bits + 3 * (bits * (1 - bits / SKETCH_BITS)) ** 0.5)


def _sketch_filter(limit: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                near = np.bitwise_count(x ^ y).sum(1) <= limit
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], names=["a", "b"])

    return keep


def _exact(percent: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return keep


def _cross_links(limit: int, percent: int):
    """Members of a block pair of one bucket, sorted by it -> links between different components.

    A pair that shares an earlier band is left to that bucket, and the pivot's pairs are known. Pairs stay in numpy:
    sketches sort out most, the others are confirmed on their whole sets, and only links are returned.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def starts(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            group = np.stack([rows[n].to_numpy() for n in ("band", "key", "i", "j")], 1)
            return group, np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(1)))

        def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            group, first = starts(rows)
            block, comp, doc, pivot = (rows[n].to_numpy() for n in ("block", "comp", "doc", "pivot"))
            bands = np.asarray(rows["bands"].combine_chunks().flatten()).reshape(len(group), -1)
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(group), -1)
            sets = rows["shingles"].combine_chunks()
            for s, e in zip(first, np.append(first[1:], len(group)), strict=True):
                left, right = s + np.flatnonzero(block[s:e] == group[s, 2]), s + np.flatnonzero(block[s:e] == group[s, 3])
                out = []
                for u in left:
                    v = right[(comp[right] != comp[u]) & (doc[right] != pivot[s])] if doc[u] != pivot[s] else right[:0]
                    if group[s, 2] == group[s, 3]:
                        v = v[v > u]
                    v = v[~(bands[v, : group[s, 0]] == bands[u, : group[s, 0]]).any(1)] if group[s, 0] else v
                    v = v[np.bitwise_count(sketch[v] ^ sketch[u]).sum(1) <= limit]
                    for k in range(0, len(v), 256):
                        some = v[k : k + 256]
                        own = np.frombuffer(sets[int(u)].as_buffer(), np.uint64)
                        others = [np.frombuffer(sets[int(x)].as_buffer(), np.uint64) for x in some]
                        sizes = np.array([len(x) for x in others])
                        values = np.concatenate(others)
                        at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                        common = np.add.reduceat((own[at] == values).astype(np.int64), np.cumsum(sizes) - sizes)
                        good = some[100 * common >= percent * (len(own) + sizes - common)]
                        out.append(np.stack([np.minimum(doc[good], doc[u]), np.maximum(doc[good], doc[u])], 1))
                if out and len(found := np.concatenate(out)):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(x.num_rows for x in held) >= 2 * BLOCK:
                rows = pa.Table.from_batches(held)
                if at := int(starts(rows)[1][-1]):
                    yield from solve(rows.slice(0, at))
                    held = rows.slice(at).to_batches()
        if held:
            yield from solve(pa.Table.from_batches(held))

    return links


def _with_both(pairs: DataFrame, per_doc: DataFrame, column: str, chunk: int = 256) -> DataFrame:
    """a, b, the column of a, the column of b. A document in many pairs is repeated once for each chunk of them."""
    out, total = pairs, pairs.count()
    for side in ("a", "b"):
        n = pairs.groupBy(side).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_n"))
        salts = n.where("_n > 1").withColumn("_rows", F.col("_n") * chunk)
        out = salted_join(out, salts, side, F.col("b" if side == "a" else "a"), "_rows", total).withColumn("_n", F.coalesce("_n", F.lit(1)))
        out = out.withColumn("_s", F.pmod(F.xxhash64("a", "b"), F.col("_n")).cast("int")).drop("_n")
        values = per_doc.select(F.col("doc_id").alias(side), F.col(column).alias(f"{column}_{side}")).join(n, side)
        values = values.withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
        out = out.join(values, [side, "_s"]).drop("_s")
    return out.select("a", "b", f"{column}_a", f"{column}_b")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, bands: int = 20, rows: int = 4, samples: int = 512, inside: np.ndarray = NOT_SPACE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. Links: 100 * |A & B| >= percent * |A | B| on sets of shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    signed = stored(texts.mapInArrow(signer(inside, words, bands, rows), SIGNATURE))
    usable = signed.where("doc_id IS NOT NULL AND bands IS NOT NULL").withColumn("sequence", F.col("digest"))
    copies = usable.groupBy("sequence").agg(F.min("doc_id").alias("rep"), F.count("*").alias("_n")).where("_n > 1")
    classes = stored(salted_join(usable, copies, "sequence", F.col("doc_id"), "_n").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "bands"))

    banded = classes.where("doc_id = rep").select(F.col("doc_id").alias("doc"), F.posexplode("bands").alias("band", "key")).withColumn("bucket", F.struct("band", "key"))
    buckets = banded.groupBy("bucket").agg(F.min("doc").alias("pivot"), F.max("doc").alias("_last"), F.count("*").alias("size")).where("pivot < _last").drop("_last")
    # Only rows of shared buckets stay.
    members = stored(salted_join(banded, buckets.withColumn("_rows", F.col("size")), "bucket", F.col("doc"), "_rows", bands * usable.count()).where("pivot IS NOT NULL").select("doc", "band", "key", "pivot", "size"))
    wanted = stored(members.select(F.col("doc").alias("doc_id")).distinct())
    sets = texts.join(held(wanted), "doc_id", "left_semi").mapInArrow(setter(inside, words, samples), "doc_id long, shingles binary, sketch binary")
    keys = classes.groupBy("doc_id").agg(F.first("bands").alias("bands"))
    detail = stored(sets.dropDuplicates(["doc_id"]).join(keys, "doc_id"))

    limit = sketch_limit(percent, samples)
    pair = "a long, b long"

    def confirm(pairs: DataFrame) -> DataFrame:
        return _with_both(pairs, detail, "shingles").mapInArrow(_exact(percent), pair)

    star = stored(members.where("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b")).distinct())
    near = stored(_with_both(star, detail, "sketch").mapInArrow(_sketch_filter(limit), pair))
    links = stored(confirm(near))
    roots = components(links)

    # Buckets that still hold several components: their other pairs.
    placed = members.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("_x"), F.max("comp").alias("_y"), F.max("size").alias("_size")).where("_x < _y AND _size > 2")
    open_ = placed.join(mixed.select("band", "key", F.ceil(F.col("_size") / BLOCK).cast("int").alias("blocks")), ["band", "key"])
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = open_.withColumn("block", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "doc", "comp", "pivot")
    detailed = dealt.join(detail.withColumnRenamed("doc_id", "doc"), "doc")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = detailed.repartition(parts, "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")
    more = stored(in_order.mapInArrow(_cross_links(limit, percent), pair).distinct())
    if more.limit(1).count():
        roots = components(links.union(more))
    discard(members, wanted, detail, star, near, links, more)

    of_rep = classes.groupBy("rep").agg(F.count("*").alias("_n")).join(roots.withColumnRenamed("node", "rep"), "rep")
    found = salted_join(classes.select("doc_id", "rep"), of_rep, "rep", F.col("doc_id"), "_n")
    found = found.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("component_id"))
    out = signed.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).where("doc_id IS NOT NULL").join(found, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    nulls = signed.where("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = stored(out.unionByName(nulls).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
    discard(signed, classes)
    return result


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with the first document of each component only."""
    gone = stored(near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("_gone")))
    return docs.join(held(gone), docs["doc_id"] == gone["_gone"], "left_anti")
