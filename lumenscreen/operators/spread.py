"""Work on a key that may own most rows: joins, ranks, percentiles and streams that bring no key into one task."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored

#: Rows of a table with one row for each key that are sent to every task; larger tables are shuffled.
MOST_BROADCAST = 50_000
#: Keys with fewer values are bracketed by their whole range.
FEW = 4_000
#: Rows of a key that one task may hold.
DIRECT = 1_000_000


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """All keys equal, nulls too."""
    return functools.reduce(operator.and_, [left[k].eqNullSafe(right[k]) for k in keys])


def join_key(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with a stored table of one row a key: sent to every task if its counted rows allow, else shuffled,
    where adaptive execution splits a hot key's partition."""
    return rows.join(F.broadcast(per_key) if per_key.count() <= MOST_BROADCAST else per_key, keys, how)


def ranked(rows: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    """rows with their place (1, 2, 3 ...) in the order within their key.

    Rows are range-sorted by key and order, so a hot key owns many ranges. Ranges are numbered inside, and the sums of
    the ranges before are added: a window holds the rows of one range, or a row for each range of a key.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = stored(sizes.select(*keys, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    placed = ranged.withColumn("_place", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    before = F.broadcast(before) if before.count() <= MOST_BROADCAST else before
    out = placed.join(before, same(placed, before, [*keys, "_range"]))
    return out.select(*[placed[c] for c in rows.columns], (before["_before"] + placed["_place"]).alias(name))


def _brackets(rows: DataFrame, keys: list[str], wanted: dict[str, list[float]], also: dict[str, Column], width: float, accuracy: int) -> DataFrame:
    """A row a key: also, and for each value its number _n_, and its brackets _b_: (low, high) for each share."""
    parts = []
    for c, shares in wanted.items():
        ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-width, width)]
        sketch = F.percentile_approx(c, F.array(*[F.lit(e) for e in ends]), F.lit(accuracy))
        whole = F.array(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")) for _ in shares])
        near = F.array(*[F.struct(F.get(sketch, F.lit(2 * i)).alias("low"), F.get(sketch, F.lit(2 * i + 1)).alias("high")) for i in range(len(shares))])
        parts += [F.count(c).alias(f"_n_{c}"), (whole if width >= 1 else F.when(F.count(c) <= FEW, whole).otherwise(near)).alias(f"_b_{c}")]
    return rows.groupBy(*keys).agg(*parts, *[f.alias(n) for n, f in also.items()])


def quantiles(rows: DataFrame, keys: list[str], wanted: dict[str, list[float]], also: dict[str, Column] | None = None, width: float = 0.0005, accuracy: int = 10_000, largest: int | None = None) -> DataFrame:
    """keys, the columns of ``also`` (aggregates) and for each wanted double column an array of exact percentiles.

    Keys are counted first, unless the rows of the ``largest`` key are given. If none has over ``DIRECT`` rows, one aggregation holds a key's values. Otherwise, for all
    keys, columns and shares at once, a sketch gives a bracket for each share; a second pass counts the values below a
    bracket and the different values inside it, and their running sums give the two values around the wanted place,
    which are interpolated linearly. A bracket holds about a thousandth of a key's values. The counts prove a bracket;
    keys where one fails, if any, go through wider ones. Nulls don't count; a key without values has null; rows with a
    null key take no part.
    """
    rows = rows.where(functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys]))
    if largest is None:
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= DIRECT:
        exact = [F.percentile(c, F.array(*[F.lit(float(x)) for x in shares])).alias(c) for c, shares in wanted.items()]
        return rows.groupBy(*keys).agg(*[f.alias(n) for n, f in (also or {}).items()], *exact)
    asked = [(c, i, s) for c, shares in wanted.items() for i, s in enumerate(shares)]
    found = None
    left = stored(rows)
    while True:
        facts = stored(_brackets(left, keys, wanted, also or {}, width, accuracy))
        marked = join_key(left.select(*keys, *wanted), facts.select(*keys, *[f"_b_{c}" for c in wanted]), keys)
        ends = [(n, F.col(c), F.col(f"_b_{c}")[i]) for n, (c, i, _) in enumerate(asked)]
        below = stored(marked.groupBy(*keys).agg(*[F.count_if(x < b["low"]).alias(f"_l_{n}") for n, x, b in ends]).join(facts.select(*keys, *[f"_n_{c}" for c in wanted]), keys))
        inside = F.array_compact(F.array(*[F.when((x >= b["low"]) & (x <= b["high"]), F.struct(F.lit(n).alias("id"), x.alias("v"))) for n, x, b in ends]))
        counts = marked.select(*keys, F.explode(inside).alias("h")).groupBy(*keys, "h").agg(F.count("*").alias("n")).select(*keys, "h.id", "h.v", "n")
        chosen = lambda values, kind: functools.reduce(lambda a, x: F.when(F.col("id") == x[0], x[1]).otherwise(a), enumerate(values), F.lit(None).cast(kind))
        place = (chosen([F.col(f"_n_{c}") for c, _, _ in asked], "long") - 1) * chosen([F.lit(float(s)) for _, _, s in asked], "double")
        low = chosen([F.col(f"_l_{n}") for n in range(len(asked))], "long")
        running = F.sum("n").over(Window.partitionBy(*keys, "id").orderBy("v"))
        summed = join_key(counts.withColumn("upto", running), below, keys).select(*keys, "id", "v", (F.col("upto") + low).alias("upto"), place.alias("place"), low.alias("low"))
        value = lambda at: F.min(F.when(F.col("upto") > at, F.col("v")))
        first, second = F.floor("place"), F.ceil("place")
        proof = (F.first("low") <= F.first(first)) & (F.max("upto") > F.first(second))
        around = summed.groupBy(*keys, "id").agg(value(first).alias("a"), value(second).alias("b"), F.first("place").alias("p"), proof.alias("ok"))
        exact = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil("p") - F.col("p")) * F.col("a") + (F.col("p") - F.floor("p")) * F.col("b"))
        per_key = around.groupBy(*keys).agg(F.bool_and("ok").alias("_ok"), F.count("*").alias("_ids"), *[F.max(F.when(F.col("id") == n, exact)).alias(f"_q_{n}") for n in range(len(asked))])
        # A key has an answer for each share of the columns in which it has values, or the bracket held none of them.
        due = functools.reduce(operator.add, [F.when(F.col(f"_n_{c}") > 0, len(shares)).otherwise(0) for c, shares in wanted.items()])
        answered = F.coalesce(F.col("_ok"), F.lit(True)) & (F.coalesce("_ids", F.lit(0)) == due)
        done = stored(facts.join(per_key, keys, "left").withColumn("_ok", F.lit(True) if width >= 1 else answered))
        ids = {c: [n for n, (d, _, _) in enumerate(asked) if d == c] for c in wanted}
        lists = [F.when(F.col(f"_q_{own[0]}").isNotNull(), F.array(*[F.col(f"_q_{n}") for n in own])).alias(c) for c, own in ids.items()]
        good = done.where("_ok").select(*keys, *(also or {}), *lists)
        found = good if found is None else found.unionByName(good)
        failed = done.where("NOT _ok").select(*keys)
        if not failed.limit(1).count():
            return found
        left, width = left.join(failed, keys, "left_semi"), min(1.0, width * 32)


class Step:
    """What a stream does with one group: made of the group's first rows, given the others, asked at the end."""

    def __init__(self, first: pa.Table | None):
        self.first = first

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield from ()

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def streamed(rows: DataFrame, group: list[str], order: list[str], step: Callable[[pa.Table | None], Step], schema: T.StructType) -> DataFrame:
    """Rows of a group pass a task in one stream: those with ``_kind`` 0 come first and are held, the others go by.

    A step must hold no more than the first rows. All columns, and ``_group``, a hash by which a stream is cut, reach it.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = rows.withColumn("_group", F.xxhash64(*group))
    placed = named.repartition(parts, *group).sortWithinPartitions(*group, "_kind", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, open_ = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, kind = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("_group", "_kind"))
            bounds = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(g)]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if g[a] != now:
                    if open_ is not None:
                        yield from open_.end()
                    now, held, open_ = g[a], [], None
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                else:
                    if open_ is None:
                        open_ = step(pa.Table.from_batches(held) if held else None)
                    yield from open_.rows(batch.slice(a, b - a))
        if open_ is not None:
            yield from open_.end()

    return placed.mapInArrow(run, schema)


def each_group(rows: DataFrame, group: list[str], one: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """one(rows of a group) for all groups; a task holds one small group at a time, and gives many at once back."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("_group", F.xxhash64(*group)).repartition(parts, *group).sortWithinPartitions(*group)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, done, size = None, [], [], 0

        def solved() -> pd.DataFrame:
            return one(pd.concat(held, ignore_index=True).drop(columns="_group"))

        for frame in frames:
            g = frame["_group"].to_numpy()
            bounds = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)] if len(g) else [0]
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if g[a] != now:
                    if held:
                        done.append(solved())
                        size += len(done[-1])
                    now, held = g[a], []
                    if size > 50_000:
                        yield pd.concat(done)
                        done, size = [], 0
                held.append(frame.iloc[a:b])
        if held:
            done.append(solved())
        if done:
            yield pd.concat(done)

    return placed.mapInPandas(run, schema)


def numbers(batch: pa.RecordBatch | pa.Table, name: str, kind=np.float64) -> np.ndarray:
    """A column without nulls as numpy."""
    column = batch[name] if isinstance(batch, pa.Table) else batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.to_numpy() if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False), kind)
