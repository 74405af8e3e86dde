"""Statistics per barcode: one grouped pass where a scan per barcode would do the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .spread import MOST_BROADCAST, join_key, quantiles, ranked

BARCODE = "cell_barcode_0"


def single_barcode(cells: DataFrame) -> DataFrame:
    """P5."""
    return cells.where("cell_barcode_1 IS NULL")


def between_open(x: Column, low: float, high: float) -> Column:
    """Both ends excluded."""
    return (x > low) & (x < high)


def _percentiles(rows: DataFrame, wanted: dict[str, list[float]], also: dict[str, Column], approximate: bool) -> DataFrame:
    """A row a barcode: also, and an array of percentiles of each wanted column; exact ones hold no barcode in one task."""
    if not approximate:
        return quantiles(rows, [BARCODE], wanted, also)
    sketches = [F.percentile_approx(c, F.array(*[F.lit(s) for s in shares]), F.lit(100_000)).alias(c) for c, shares in wanted.items()]
    return rows.where(F.col(BARCODE).isNotNull()).groupBy(BARCODE).agg(*[f.alias(n) for n, f in also.items()], *sketches)


def above_floor(cells: DataFrame, x: str, percent: float, key: str = BARCODE, approximate: bool = False) -> DataFrame:
    """Drop the lowest part of each barcode; keep what is above the percentile."""
    floors = _percentiles(cells.select(F.col(key).alias(BARCODE), F.col(x).cast("double").alias("_x")), {"_x": [percent / 100]}, {}, approximate)
    floors = stored(floors.select(F.col(BARCODE).alias("_key"), F.col("_x")[0].alias("_floor")))
    floors = F.broadcast(floors) if floors.count() <= MOST_BROADCAST else floors
    return cells.join(floors, F.col(key) == F.col("_key")).where(F.col(x) > F.col("_floor")).drop("_key", "_floor")


def representative(cells: DataFrame, features: list[str], intensity: str, least: float = 300.0, keys: list[str] = ["plate", "well"]) -> DataFrame:  # noqa: B006
    """P10: within one population standard deviation of the well's mean in every feature."""
    bright = cells.where(F.col(intensity) > least)
    stats = bright.groupBy(*keys).agg(*[f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = bright.join(stats, keys)
    for c in features:
        out = out.where(F.col(c).between(F.col(f"_m_{c}") - F.col(f"_s_{c}"), F.col(f"_m_{c}") + F.col(f"_s_{c}")))
    return out.select(*cells.columns)


def shared_means(first: DataFrame, second: DataFrame, x: str, barcodes: DataFrame, min_cells: int = 30) -> DataFrame:
    """Mean per barcode in both data sets, where both have enough single-barcode cells."""

    def means(d: DataFrame, name: str) -> DataFrame:
        return single_barcode(d).groupBy(BARCODE).agg(F.count("*").alias("_n"), F.avg(x).alias(name)).where(F.col("_n") >= min_cells).drop("_n")

    wanted = barcodes.select(F.col("barcode").alias(BARCODE)).distinct()
    return means(first, "mean_1").join(means(second, "mean_2"), BARCODE).join(wanted, BARCODE, "left_semi")


def _for_requested(barcodes: DataFrame, stats: DataFrame) -> DataFrame:
    out = barcodes.select(F.col("barcode").alias(BARCODE)).distinct().join(stats, BARCODE, "left")
    return out.withColumn("n_in_range", F.coalesce("n_in_range", F.lit(0))) if "n_in_range" in stats.columns else out


def mean_condensates(cells: DataFrame, barcodes: DataFrame, intensity: str, low: float = 100.0, high: float = 10000.0, enforce_coverage: bool = False, min_frac: float = 0.3) -> DataFrame:
    """A5: a row for every requested barcode."""
    inside = between_open(F.col(intensity), low, high)
    value = F.avg(F.when(inside, F.col("num_condensates")))
    if enforce_coverage:
        value = F.when(F.count_if(inside) >= min_frac * F.count("*"), value)
    return _for_requested(barcodes, single_barcode(cells).groupBy(BARCODE).agg(value.alias("mean_num_cond")))


def average_property(cells: DataFrame, barcodes: DataFrame, prop: str, intensity: str, how: str = "mean", low: float = 100.0, high: float = 10000.0, min_cells: int = 30, min_frac: float = 0.3, floor_percent: float | None = None, approximate: bool = False) -> DataFrame:
    """Mean or median per barcode where enough cells, and a large enough share, are in range."""
    rows = single_barcode(cells)
    rows = rows if floor_percent is None else above_floor(rows, intensity, floor_percent, approximate=approximate)
    inside = between_open(F.col(intensity), low, high)
    x = F.when(inside, F.col(prop))
    n = F.count_if(inside)
    if how == "mean":
        gated = F.when((n >= min_cells) & (n >= min_frac * F.count("*")), F.avg(x))
        return _for_requested(barcodes, rows.groupBy(BARCODE).agg(gated.alias("value"), n.alias("n_in_range")))
    marked = rows.select(BARCODE, inside.alias("_in"), x.cast("double").alias("_x"))
    n = F.count_if("_in")
    gate = (n >= min_cells) & (n >= min_frac * F.count("*")) & (F.count("_x") == n)
    out = _percentiles(marked, {"_x": [0.5]}, {"n_in_range": n, "_gate": gate}, approximate)
    return _for_requested(barcodes, out.select(BARCODE, F.when(F.col("_gate"), F.col("_x")[0]).alias("value"), "n_in_range"))


def barcode_statistics(cells: DataFrame, barcodes: DataFrame, props: list[str], intensity: str, condensate_props: tuple[str, ...] = (), how: str = "mean", low: float = 100.0, high: float = 10000.0, min_cells: int = 30, min_frac: float = 0.3, approximate: bool = False) -> DataFrame:
    """Mean and population deviation, or median and raw MAD, of many properties in one grouped pass (two for MAD).

    Condensate properties use only cells with condensates and have a gate of their own. Gates count rows. Mean and
    deviation skip nulls; median and MAD are null if any value is.
    """
    rows = single_barcode(cells).where(F.col(BARCODE).isNotNull())
    inside = F.coalesce(between_open(F.col(intensity), low, high), F.lit(False))

    def scope(p: str) -> Column:
        return inside & (F.col("num_condensates") > 0) if p in condensate_props else inside

    gate = {p: (F.count_if(inside) >= min_cells) & (F.count_if(inside) >= min_frac * F.count("*")) & (F.count_if(scope(p)) >= min_cells) for p in props}
    if how == "mean":
        out = [f(F.when(scope(p), F.col(p))) for p in props for f in (F.avg, F.stddev_pop)]
        names = [f"{n}_{p}" for p in props for n in ("mean", "std")]
        stats = rows.groupBy(BARCODE).agg(F.count_if(inside).alias("n_in_range"), *[F.when(gate[n.split("_", 1)[1]], c).alias(n) for c, n in zip(out, names, strict=True)])
        return _for_requested(barcodes, stats)
    count = {p: F.count_if(f"_in_{p}") for p in props}
    n = F.count_if("_in")
    gates = {f"_gate_{p}": (n >= min_cells) & (n >= min_frac * F.count("*")) & (count[p] >= min_cells) & (F.count(f"_x_{p}") == count[p]) for p in props}
    marked = rows.select(BARCODE, inside.alias("_in"), *[c for p in props for c in (scope(p).alias(f"_in_{p}"), F.when(scope(p), F.col(p)).cast("double").alias(f"_x_{p}"))])
    marked = stored(marked)
    middle = _percentiles(marked, {f"_x_{p}": [0.5] for p in props}, {"n_in_range": n, **gates}, approximate)
    medians = stored(middle.select(BARCODE, "n_in_range", *[F.when(F.col(f"_gate_{p}"), F.col(f"_x_{p}")[0]).alias(f"median_{p}") for p in props]))
    apart = join_key(marked.select(BARCODE, *[f"_x_{p}" for p in props]), medians.drop("n_in_range"), [BARCODE])
    apart = apart.select(BARCODE, *[F.abs(F.col(f"_x_{p}") - F.col(f"median_{p}")).alias(f"_d_{p}") for p in props])
    mads = _percentiles(apart, {f"_d_{p}": [0.5] for p in props}, {}, approximate)
    mads = mads.select(BARCODE, *[F.col(f"_d_{p}")[0].alias(f"mad_{p}") for p in props])
    return _for_requested(barcodes, medians.join(mads, BARCODE, "left"))


def condensate_share(cells: DataFrame, barcodes: DataFrame, intensity: str, low: float = 100.0, high: float = 10000.0) -> DataFrame:
    """Share of in-range cells with condensates and their number; (null, 0) without cells."""
    inside = F.coalesce(between_open(F.col(intensity), low, high), F.lit(False))
    stats = single_barcode(cells).groupBy(BARCODE).agg(F.try_divide(F.count_if(inside & (F.col("num_condensates") > 0)), F.count_if(inside)).alias("fraction"), F.count_if(inside).alias("n"))
    return _for_requested(barcodes, stats).withColumn("n", F.coalesce("n", F.lit(0)))


def percentiles(cells: DataFrame, barcodes: DataFrame, prop: str, intensity: str, percents: list[float], low: float = 0.0, high: float = 100000.0, min_cells: int = 30, min_frac: float = 0.3, approximate: bool = False) -> DataFrame:
    """Percentile list and in-range count; a gate that fails gives a null list but still the count."""
    inside = F.coalesce(between_open(F.col(intensity), low, high), F.lit(False))
    marked = single_barcode(cells).select(BARCODE, inside.alias("_in"), F.when(inside, F.col(prop)).cast("double").alias("_x"))
    n = F.count_if("_in")
    gate = (n >= min_cells) & (n >= min_frac * F.count("*"))
    out = _percentiles(marked, {"_x": [v / 100 for v in percents]}, {"n": n, "_gate": gate}, approximate)
    stats = out.select(BARCODE, F.when(F.col("_gate"), F.col("_x")).alias("percentiles"), "n")
    return _for_requested(barcodes, stats).withColumn("n", F.coalesce("n", F.lit(0)))


def first_n(cells: DataFrame, n: int, order: list, keys: list[str] = [BARCODE]) -> DataFrame:  # noqa: B006
    """W3, P11 after a filter: the first n rows of each key in an explicit order."""
    return cells.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def random_n(cells: DataFrame, n: int, identity: list[str], seed: int = 1, keys: list[str] = [BARCODE]) -> DataFrame:  # noqa: B006
    """A reproducible sample: the first n by md5 of seed and identity."""
    return first_n(cells, n, [F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity])), *identity], keys)


def grid(cells: DataFrame, order: list, per_row: int = 20, keys: list[str] = [BARCODE]) -> DataFrame:  # noqa: B006
    """Rank within the key and its place on a grid; a key may own most rows."""
    return ranked(cells, keys, order).withColumn("grid_row", F.floor((F.col("rank") - 1) / per_row)).withColumn("grid_col", F.pmod(F.col("rank") - 1, F.lit(per_row)))


def with_sublibrary(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells whose barcode and sub-library are asked for together."""
    return cells.join(wanted.select(F.col("barcode").alias(BARCODE), "sublib").distinct(), [BARCODE, "sublib"], "left_semi")


def paired_by_rank(pooled: DataFrame, arrayed: DataFrame, n: int, identity: list[str], intensity: str, seed: int = 1) -> DataFrame:
    """min(n, pooled cells) cells of each barcode from both sides, lined up by intensity rank.

    The limit n is known to the plan, so every task keeps n rows of a barcode before the shuffle.
    """
    sizes = pooled.groupBy(BARCODE).agg(F.least(F.count("*"), F.lit(n)).alias("_take"))

    def ranked(d: DataFrame, name: str) -> DataFrame:
        key = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
        drawn = d.withColumn("_r", F.row_number().over(Window.partitionBy(BARCODE).orderBy(key, *identity))).where(F.col("_r") <= n).join(sizes, BARCODE).where("_r <= _take")
        rank = F.row_number().over(Window.partitionBy(BARCODE).orderBy(intensity, *identity))
        return drawn.select(BARCODE, rank.alias("rank"), F.struct(*identity).alias(name), F.col(intensity).alias(f"{name}_intensity"))

    return ranked(pooled, "pooled").join(ranked(arrayed, "arrayed"), [BARCODE, "rank"])
