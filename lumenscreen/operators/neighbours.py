"""Exact nearest neighbours of points in many groups: leaves of a sampled k-d split, halos by a proof radius.

A group with few candidates is one leaf. Of a larger one a bounded sample (the smallest hashes) is split at medians,
along the wider side, until a leaf holds about ``leaf`` candidates. A point's k nearest candidates in the sample are no nearer
than its true ones, so their distance is a radius that surely holds these: the point goes to every leaf that the circle
touches, which is one leaf for most. A leaf's task holds the leaf's candidates while the points stream by; what several
leaves found for a point is merged. Lone points get a large circle, dense clumps small leaves; nothing falls back to all pairs.

Leaves follow places, so candidates that all share one place stay one leaf. The sample bounds the number of leaves
(``sample`` / 8); beyond ``leaf`` times that many candidates in one group, leaves grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored
from .spread import MOST_BROADCAST, Step, numbers, same, streamed

LEAF = 4_096
SAMPLE = 1_024
#: Points of a group that go through one stream while leaves are found for them.
STREAM = 500_000


class Tree:
    """Leaves of a sample: boxes whose outer sides are open."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaves: int):
        self.box: list[tuple[float, float, float, float]] = []
        self._split(x, y, (-np.inf, np.inf, -np.inf, np.inf), leaves)
        self.bounds = np.array(self.box)

    def _split(self, x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float], leaves: int) -> None:
        wide, high = (v.max() - v.min() if len(v) else 0.0 for v in (x, y))
        if leaves < 2 or max(wide, high) == 0:
            self.box.append(box)
            return
        along = x if wide >= high else y
        cut = float(np.median(along))
        low = along < cut
        if not low.any():  # the median is the smallest value
            cut = float(along[along > cut].min())
            low = along < cut
        a, b, c, d = box
        first, second = ((a, cut, c, d), (cut, b, c, d)) if wide >= high else ((a, b, c, cut), (a, b, cut, d))
        self._split(x[low], y[low], first, leaves // 2)
        self._split(x[~low], y[~low], second, leaves - leaves // 2)

    def leaf_of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        for i, (a, b, c, d) in enumerate(self.box):
            out[(x >= a) & (x < b) & (y >= c) & (y < d)] = i
        return out

    def touched(self, x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, leaf) for every leaf within the radius of a point."""
        a, b, c, d = self.bounds.T
        dx = np.maximum(np.maximum(a - x[:, None], x[:, None] - b), 0)
        dy = np.maximum(np.maximum(c - y[:, None], y[:, None] - d), 0)
        return np.nonzero(np.sqrt(dx * dx + dy * dy) <= radius[:, None] * (1 + 1e-12))


def _kth(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, k: int) -> np.ndarray:
    """Distance of each point to its k-th nearest candidate, infinite with fewer."""
    out = np.full(len(x), np.inf)
    step = max(1, 4_000_000 // max(1, len(px)))
    for at in range(0, len(x) if len(px) >= k else 0, step):
        dx, dy = x[at : at + step, None] - px, y[at : at + step, None] - py
        out[at : at + step] = np.partition(np.sqrt(dx * dx + dy * dy), k - 1, 1)[:, k - 1]
    return out


def _take(batch: pa.RecordBatch, names: list[str], at: np.ndarray) -> list[pa.Array]:
    take = pa.array(at)
    return [batch.column(batch.schema.get_field_index(n)).take(take) for n in names]


def _place(carried: list[str], k: int, leaf: int):
    """Streams of one group's sample, then its candidates (_kind 1) and points (_kind 2): leaves for all of them."""

    class Place(Step):
        def __init__(self, first: pa.Table | None):
            super().__init__(first)
            self.x, self.y = numbers(first, "_x"), numbers(first, "_y")
            self.tree = Tree(self.x, self.y, max(1, min(int(first["_n"][0].as_py() // leaf) + 1, len(self.x) // 8)))

        def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            x, y, kind = numbers(batch, "_x"), numbers(batch, "_y"), numbers(batch, "_kind", np.int64)
            own = np.flatnonzero(kind == 1)
            at, leaves = [own], [self.tree.leaf_of(x[own], y[own])]
            asked = np.flatnonzero(kind == 2)
            for some in np.array_split(asked, max(1, len(asked) // 2000)):
                point, touched = self.tree.touched(x[some], y[some], _kth(x[some], y[some], self.x, self.y, k))
                at.append(some[point])
                leaves.append(touched.astype(np.int32))
            at, leaves = np.concatenate(at), np.concatenate(leaves)
            shared = (np.bincount(at, minlength=len(x)) > 1)[at]
            columns = _take(batch, carried, at)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kind[at] - 1, pa.int32()), pa.array(leaves), pa.array(shared)], names=[*carried, "_kind", "_leaf", "_shared"])

    return Place


def _nearest(keys: list[str], k: int):
    """Streams of a leaf's candidates, sorted by number, then of points: the k nearest of each point."""

    class Nearest(Step):
        def __init__(self, first: pa.Table | None):
            super().__init__(first)
            if first is not None:
                self.x, self.y, self.number = numbers(first, "_x"), numbers(first, "_y"), first["_num"].combine_chunks()

        def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if self.first is None:
                return
            x, y = numbers(batch, "_x"), numbers(batch, "_y")
            step = max(1, 4_000_000 // len(self.x))
            for at in range(0, len(x), step):
                dx, dy = x[at : at + step, None] - self.x, y[at : at + step, None] - self.y
                apart = np.sqrt(dx * dx + dy * dy)
                n = min(k, len(self.x))
                limit = np.partition(apart, n - 1, 1)[:, n - 1]
                point, near = np.nonzero(apart <= limit[:, None])
                dist = apart[point, near]
                order = np.lexsort((near, dist, point))
                point, near, dist = point[order], near[order], dist[order]
                rank = np.arange(len(point)) - np.searchsorted(point, point) + 1
                keep = rank <= k
                columns = _take(batch, [*keys, "_num", "_shared"], at + point[keep])
                yield pa.RecordBatch.from_arrays([*columns[:-1], self.number.take(pa.array(near[keep])), pa.array(dist[keep]), pa.array(rank[keep], pa.int32()), columns[-1]], names=[*keys, "_num", "_near", "dist", "rank", "_shared"])

    return Nearest


def nearest(points: DataFrame, candidates: DataFrame, keys: list[str], k: int, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """keys, _num, _near, dist, rank (from 1): the k nearest candidates of each point, equal distances by number.

    Both have the keys, _num, _x and _y (doubles without nulls). A group without candidates gives nothing.
    """
    shape = [*keys, "_num", "_x", "_y"]
    both = candidates.select(*shape, F.lit(1).alias("_kind")).unionByName(points.select(*shape, F.lit(2).alias("_kind")))
    both = stored(both)
    sizes = both.where("_kind = 1").groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > leaf)
    sizes = stored(sizes.withColumn("_salts", F.ceil(F.col("_n") / STREAM).cast("int")))
    n_large = sizes.count()
    place = T.StructType([T.StructField("_kind", T.IntegerType()), T.StructField("_leaf", T.IntegerType()), T.StructField("_shared", T.BooleanType())])
    single = [(F.col("_kind") - 1).alias("_kind"), F.lit(0).alias("_leaf"), F.lit(False).alias("_shared")]
    if not n_large:
        placed = both.select(*shape, *single)
    else:
        large = F.broadcast(sizes) if n_large <= MOST_BROADCAST else sizes
        marked = both.join(large, same(both, large, keys), "left").select(*[both[c] for c in [*shape, "_kind"]], "_n", "_salts")
        few, many = marked.where("_n IS NULL"), marked.where("_n IS NOT NULL")
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("_num", "_x", "_y"), "_num"))
        drawn = many.where("_kind = 1").withColumn("_r", first).where(F.col("_r") <= sample).drop("_r").withColumn("_kind", F.lit(0))
        drawn = drawn.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        dealt = many.withColumn("_salt", F.pmod(F.xxhash64("_num", "_x"), F.col("_salts")).cast("int"))
        schema = T.StructType([*both.select(*shape).schema.fields, *place.fields])
        # The stream is cut at a change of kind as well: candidates and points both follow the sample.
        found = streamed(drawn.unionByName(dealt), [*keys, "_salt"], [], _place(shape, k, leaf), schema)
        placed = few.select(*shape, *single).unionByName(found)
    types = {f.name: f.dataType for f in both.schema.fields}
    schema = T.StructType([*both.select(*keys, "_num").schema.fields, T.StructField("_near", types["_num"]), T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType()), T.StructField("_shared", T.BooleanType())])
    found = streamed(placed, [*keys, "_leaf"], ["_num"], _nearest(keys, k), schema)
    if not n_large:
        return found.drop("_shared")
    found = stored(found)
    order = Window.partitionBy(*keys, "_num").orderBy("dist", "_near")
    merged = found.where("_shared").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.where("NOT _shared").unionByName(merged).drop("_shared")
