"""Robust fits by random trials, on all rows of a group, from one stored input.

A row's part in a trial follows from a hash of its values and its number among equal rows, so the fit depends neither on
the partitions nor on the order of rows. Models are made in tasks, from sums or samples of bounded size for each group.
To score them, a group's models go first through a stream and its rows follow; a large group has several streams. Few
rows need all models: of lines, the rows between the innermost and the outermost model's band; of maps, only models
that a bounded sample hasn't ruled out see all rows. Sums leave the streams; the driver sees no row and no model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored
from .spread import Step, join_key, numbers, quantiles, streamed

#: Rows of a group that go through one stream.
STREAM = 50_000
#: Rows of a group are dealt to so many blocks by their hash; a trial takes or leaves whole blocks.
BLOCKS = 1024
_GROUP = "_g long, "


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(row: np.ndarray, trials: int, blocks: int = BLOCKS) -> np.ndarray:
    """rows x trials numbers from 0 to below 1, by a hash of the row's block, which its identity gives, and the trial."""
    block = row.astype(np.int64) % blocks
    mixed = _mixed(_mixed(block.astype(np.uint64))[:, None] + _mixed(np.arange(1, trials + 1, dtype=np.uint64))[None, :])
    return (mixed >> np.uint64(11)).astype(np.float64) / 2.0**53


def _identified(rows: DataFrame, keys: list[str], columns: list[str], seed: int) -> DataFrame:
    """keys' hash _g, the columns as doubles and _row: a hash of a row's values and its number among its equals."""
    used = rows.select(F.xxhash64(*keys).alias("_g"), *[F.col(c).cast("double").alias(c) for c in columns])
    counted = used.groupBy("_g", *columns).agg(F.count("*").alias("_n"))
    each = counted.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
    return each.select("_g", *columns, F.xxhash64(F.lit(seed), *columns, "_i").alias("_row"))


def _solve_lines(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope and intercept from n, sums of x, y, x * x and x * y (rows of s)."""
    n, x, y, xx, xy = s
    n = np.maximum(n, 1)
    spread = xx - x * x / n
    slope = np.where(spread > 1e-9 * np.maximum(xx, 1e-300), (xy - x * y / n) / np.where(spread == 0, 1, spread), 0.0)
    return slope, (y - slope * x) / n


def _beside(rows: DataFrame, models: DataFrame, columns: list[str]) -> DataFrame:
    """Input of ``streamed`` by (_g, _salt): of each group its model (a binary) first, then its rows.

    ``models`` has _g, _n (rows of the group) and _model; a group with many rows has several streams, by the rows' hash.
    """
    sized = models.withColumn("_salts", F.ceil(F.col("_n") / STREAM).cast("int"))
    hot = stored(sized.where("_salts > 1").select("_g", "_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_salts")).cast("int"), F.lit(0))
    dealt = join_key(rows, hot, ["_g"], "left").select("_g", salt.alias("_salt"), F.lit(1).alias("_kind"), *columns, F.lit(None).cast("binary").alias("_model"))
    first = sized.select("_g", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), F.lit(0).alias("_kind"), *[F.lit(None).cast("double").alias(c) for c in columns], "_model")
    return first.unionByName(dealt)


_SUMS = T.StructType([T.StructField("_g", T.LongType()), T.StructField("trial", T.IntegerType()), T.StructField("sums", T.ArrayType(T.DoubleType()))])


def _sum_rows(g: int, trials: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    """trials x numbers as rows."""
    lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), sums.shape[1]).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(trials), g)), pa.array(trials, pa.int32()), lists], names=["_g", "trial", "sums"])


def _added(sums: DataFrame, width: int) -> DataFrame:
    """The rows of sums of all streams of a group, added for each trial."""
    return sums.groupBy("_g", "trial").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])


def _outer(slope: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Lines that are highest or lowest somewhere: corners of the convex hull of (slope, intercept)."""
    order = np.lexsort((intercept, slope))
    corners: list[int] = []
    for turn in (order, order[::-1]):
        side: list[int] = []
        for i in turn.tolist():
            while len(side) > 1:
                a, b = side[-2], side[-1]
                if (slope[b] - slope[a]) * (intercept[i] - intercept[a]) - (intercept[b] - intercept[a]) * (slope[i] - slope[a]) > 0:
                    break
                side.pop()
            side.append(i)
        corners += side
    return np.unique(corners)


class _Lines(Step):
    """Sums over the inliers of every line. A row inside all bands is added once, one outside all of them never; only
    rows between, where lines disagree, are held against each line."""

    def __init__(self, first: pa.Table):
        super().__init__(first)
        self.g = int(first["_g"][0].as_py())
        limit, *lines = np.frombuffer(first["_model"][0].as_py(), np.float64)
        self.limit, (self.slope, self.intercept) = limit, np.array(lines).reshape(2, -1)
        self.corners = _outer(self.slope, self.intercept)
        self.common, self.own = np.zeros(6), np.zeros((len(self.slope), 6))

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, y = numbers(batch, "x"), numbers(batch, "y")
        at = self.slope[self.corners] * x[:, None] + self.intercept[self.corners]
        low, high = at.min(1), at.max(1)
        slack = 1e-9 * (np.abs(y) + np.abs(low) + np.abs(high) + self.limit)
        always = (y - low <= self.limit - slack) & (y - high >= slack - self.limit)
        never = (y - high > self.limit + slack) | (y - low < -self.limit - slack)
        moments = np.stack([np.ones(len(x)), x, y, x * x, x * y, y * y], 1)
        self.common += moments[always].sum(0)
        between = np.flatnonzero(~always & ~never)
        for some in np.array_split(between, max(1, len(between) // 2000)):
            rest = y[some, None] - self.slope * x[some, None] - self.intercept
            self.own += (np.abs(rest) <= self.limit).astype(np.float64).T @ moments[some]
        yield from ()

    def end(self) -> Iterator[pa.RecordBatch]:
        # The sum of squared rests follows from the moments.
        yield _sum_rows(self.g, np.arange(len(self.own)), self.own + self.common)


def robust_line(rows: DataFrame, x: str, y: str, keys: list[str], below: float = 15000.0, trials: int = 500, share: float = 0.6, seed: int = 0) -> DataFrame:
    """Keys, slope, intercept, n_inliers of y over x per well, on all rows with x below a cut.

    A trial fits a line to about a share of the rows. Inliers lie within the median absolute deviation of y. The trial
    with most inliers wins, of equals that with the larger R2, then the first; its inliers are fitted again. Rows with a
    null take no part; a group without two different x has nulls.
    """
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) < below))
    names = stored(used.groupBy(*keys).agg(F.count("*").alias("_rows")).select(F.xxhash64(*keys).alias("_g"), *keys, "_rows"))
    largest = names.agg(F.max("_rows")).first()[0] or 0
    data = stored(_identified(used.select(*keys, F.col(x).alias("x"), F.col(y).alias("y")), keys, ["x", "y"], seed))
    middle = stored(quantiles(data, ["_g"], {"y": [0.5]}, {"n": F.count("*"), "mx": F.avg("x"), "spread": F.max("x") > F.min("x")}, largest=largest).where("spread").select("_g", "n", "mx", F.col("y")[0].alias("m")))
    # Centred values keep the sums precise.
    centred = join_key(data, middle, ["_g"]).select("_g", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("m")).alias("y"), "_row")
    centred = centred.withColumn("d", F.abs("y"))
    block = F.pmod(F.col("_row"), F.lit(BLOCKS)).alias("block")
    terms = {"n": F.count("*").cast("double"), "sx": F.sum("x"), "sy": F.sum("y"), "sxx": F.sum(F.col("x") * F.col("x")), "sxy": F.sum(F.col("x") * F.col("y"))}
    blocks = centred.groupBy("_g", block).agg(*[f.alias(n) for n, f in terms.items()])
    # At most BLOCKS rows of sums for each group.
    per_group = blocks.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("block", *terms))).alias("b"), F.sum("n").cast("long").alias("_n"))
    limits = quantiles(centred, ["_g"], {"d": [0.5]}, largest=largest).select("_g", F.col("d")[0].alias("limit"))

    fields = list(terms)

    def models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for own, limit in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                sums = np.array([[b[n] for n in fields] for b in own])
                taken = (draws(np.array([b["block"] for b in own]), trials) < share).astype(np.float64)
                made.append(np.concatenate([[limit], *_solve_lines(sums.T @ taken)]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["_g", "_n", "_model"])

    ready = stored(per_group.join(limits, "_g").select("_g", "b", "_n", "limit").mapInArrow(models, _GROUP + "_n long, _model binary"))
    found = _added(streamed(_beside(centred, ready, ["x", "y"]), ["_g", "_salt"], [], _Lines, _SUMS), 6)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for own, model in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                s = np.zeros((6, trials))
                s[:, [o["trial"] for o in own]] = np.array([[o[f"s{i}"] for o in own] for i in range(6)])
                slope, intercept = np.frombuffer(model, np.float64)[1:].reshape(2, -1)
                count = np.maximum(s[0], 1)
                total = s[5] - s[2] ** 2 / count
                rest = s[5] - 2 * slope * s[4] - 2 * intercept * s[2] + slope**2 * s[3] + 2 * slope * intercept * s[1] + intercept**2 * s[0]
                r2 = np.where(total > 0, 1 - rest / np.where(total > 0, total, 1), 0.0)
                won = np.lexsort((np.arange(trials), -np.round(r2, 9), -s[0]))[0]
                slope, intercept = _solve_lines(s[:5, won : won + 1])
                fits.append((float(slope[0]), float(intercept[0]), int(s[0, won])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in fits], t) for i, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]], names=["_g", "slope", "intercept", "n_inliers"])

    sums = found.groupBy("_g").agg(F.collect_list(F.struct("trial", *[f"s{i}" for i in range(6)])).alias("s"))
    fits = sums.join(ready.select("_g", "_model"), "_g").mapInArrow(best, _GROUP + "slope double, intercept double, n_inliers long")
    back = F.col("intercept") + F.col("m") - F.col("slope") * F.col("mx")
    return names.drop("_rows").join(fits.join(middle, "_g").select("_g", "slope", back.alias("intercept"), "n_inliers"), "_g", "left").drop("_g")


def _map_of(s: np.ndarray) -> np.ndarray | None:
    """3 x 2 coefficients from the sums of products of (1, x, y) with itself and with the targets."""
    a, b = s[:9].reshape(3, 3), s[9:].reshape(3, 2)
    return np.linalg.solve(a, b) if abs(np.linalg.det(a)) > 1e-9 else None


def _inlier_sums(points: np.ndarray, maps: np.ndarray, most: float) -> np.ndarray:
    """maps x 16: inliers, and their sums of products, of every map."""
    out = np.zeros((len(maps), 16))
    step = max(1, 400_000 // max(1, len(maps)))
    for at in range(0, len(points), step):
        v = points[at : at + step]
        a = np.column_stack([np.ones(len(v)), v[:, :2]])
        inside = (np.abs(np.einsum("ni,tij->tnj", a, maps) - v[None, :, 2:]).sum(2) <= most).astype(np.float64)
        products = np.concatenate([(a[:, :, None] * a[:, None, :]).reshape(len(v), 9), (a[:, :, None] * v[:, None, 2:]).reshape(len(v), 6)], 1)
        out += np.column_stack([inside.sum(1), inside @ products])
    return out


def trial_maps(sample: np.ndarray, row: np.ndarray, trials: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and maps of the trials that aren't degenerate: the three sampled rows with a trial's smallest draws."""
    drawn = draws(row, trials, 1 << 62)
    three = np.argsort(drawn, 0, kind="stable")[:3].T
    p = sample[three]
    a = np.concatenate([np.ones((len(p), 3, 1)), p[:, :, :2]], 2)
    good = np.flatnonzero(np.abs(np.linalg.det(a)) > 1e-9)
    return good, np.linalg.solve(a[good], p[good][:, :, 2:])


def still_open(inliers: np.ndarray, sampled: int, failure: float = 1e-9) -> np.ndarray:
    """Models that may have most inliers of all rows, by their inliers in a sample; wrong with less than this chance.

    Hoeffding's bound on each model's share, twice its width below the best one.
    """
    width = math.sqrt(math.log(2 * max(1, len(inliers)) / failure) / (2 * sampled))
    return np.flatnonzero(inliers / sampled >= inliers.max(initial=0) / sampled - 2 * width)


class _Maps(Step):
    """Sums over the inliers of the maps that are still open."""

    most = 0.0

    def __init__(self, first: pa.Table):
        super().__init__(first)
        self.g = int(first["_g"][0].as_py())
        model = np.frombuffer(first["_model"][0].as_py(), np.float64).reshape(-1, 7)
        self.trial, self.maps = model[:, 0].astype(np.int64), model[:, 1:].reshape(-1, 3, 2)
        self.sums = np.zeros((len(self.maps), 16))

    def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        self.sums += _inlier_sums(np.stack([numbers(batch, c) for c in ("x", "y", "to_x", "to_y")], 1), self.maps, self.most)
        yield from ()

    def end(self) -> Iterator[pa.RecordBatch]:
        yield _sum_rows(self.g, self.trial, self.sums)


def robust_affine(rows: DataFrame, keys: list[str], most: float = 10.0, trials: int = 1000, seed: int = 0, sample: int = 4096, failure: float = 1e-9) -> DataFrame:
    """(x, y) -> (to_x, to_y) from three points a trial, on all rows; within ``most`` of the map is an inlier.

    The ``sample`` rows of a group with the smallest hashes give the trials their points and a first count of inliers.
    Models that this leaves a chance (``still_open``) are scored on all rows, unless the sample is the group; the one
    with most inliers wins, of equals the first, and its inliers are fitted again. Coefficients are arrays (constant,
    of x, of y), null below three rows or where all trials are degenerate. Rows with a null take no part.
    """
    columns = ["x", "y", "to_x", "to_y"]
    used = stored(rows.dropna(subset=columns).select(*keys, *columns))
    names = used.select(F.xxhash64(*keys).alias("_g"), *keys).distinct()
    data = stored(_identified(used, keys, columns, seed))
    first = Window.partitionBy("_g").orderBy("_row", *columns)
    sampled = data.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= sample).groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_r", "_row", *columns))).alias("p"))
    sampled = sampled.join(data.groupBy("_g").agg(F.count("*").alias("_n")), "_g")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, own, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = np.array([[q[c] for c in columns] for q in own])
                trial, maps = trial_maps(p, np.array([q["_row"] for q in own]), trials) if len(p) >= 3 else (np.zeros(0, np.int64), np.zeros((0, 3, 2)))
                sums = _inlier_sums(p, maps, most)
                kept = np.arange(len(trial)) if n <= len(p) else still_open(sums[:, 0], len(p), failure)
                model = np.column_stack([trial[kept], maps[kept].reshape(-1, 6)]).tobytes()
                whole = sums.ravel().tolist() if n <= len(p) else None
                yield pa.RecordBatch.from_arrays([pa.array([g]), pa.array([n]), pa.array([model], pa.binary()), pa.array([whole], pa.list_(pa.float64()))], names=["_g", "_n", "_model", "whole"])

    begun = stored(sampled.select("_g", "p", "_n").mapInArrow(begin, _GROUP + "_n long, _model binary, whole array<double>"))
    large = begun.where("whole IS NULL").drop("whole")

    class Maps(_Maps):
        pass

    Maps.most = most
    found = _added(streamed(_beside(data.join(large.select("_g"), "_g", "left_semi"), large, columns), ["_g", "_salt"], [], Maps, _SUMS), 16)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = []
            for model, whole, own in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                trial = np.frombuffer(model, np.float64).reshape(-1, 7)[:, 0]
                if whole is None:
                    at = {o["trial"]: [o[f"s{i}"] for i in range(16)] for o in own or []}
                    s = np.array([at[int(t)] for t in trial])
                else:
                    s = np.array(whole).reshape(-1, 16)
                won = int(s[:, 0].argmax()) if len(s) else -1
                fit = _map_of(s[won, 1:]) if len(s) and s[won, 0] >= 3 else None
                fits.append((None if fit is None else fit[:, 0].tolist(), None if fit is None else fit[:, 1].tolist(), int(s[won, 0]) if len(s) else 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[i] for f in fits], t) for i, t in enumerate((pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32()))]], names=["_g", "of_x", "of_y", "n_inliers"])

    sums = found.groupBy("_g").agg(F.collect_list(F.struct("trial", *[f"s{i}" for i in range(16)])).alias("s"))
    out = begun.join(sums, "_g", "left").select("_g", "_model", "whole", "s").mapInArrow(best, _GROUP + "of_x array<double>, of_y array<double>, n_inliers int")
    return names.join(out, "_g", "left").withColumn("n_inliers", F.coalesce("n_inliers", F.lit(0))).drop("_g")
