"""Duplicates, bad barcodes, implausible matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["plate", "well", "tile_10x", "cell"]


def first_of_key(cells: DataFrame, order: list, keys: list[str] = CELL) -> DataFrame:
    """The first row of each cell in an explicit order; rows with a null key vanish."""
    known = cells.where(F.forall(F.array(*[F.col(k).isNotNull() for k in keys]), lambda x: x))
    return known.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def without_bad_barcodes(cells: DataFrame, bad: DataFrame) -> DataFrame:
    """Neither barcode is in the list; a null barcode is never bad."""
    bad = bad.select(F.col("barcode").alias("_bad")).where("_bad IS NOT NULL").distinct()
    out = cells.join(bad, F.col("cell_barcode_0") == F.col("_bad"), "left_anti")
    return out.join(bad, F.col("cell_barcode_1") == F.col("_bad"), "left_anti")


def duplicate_census(cells: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Number of keys seen once and more than once."""
    return cells.groupBy(*keys).count().groupBy((F.col("count") > 1).alias("duplicated")).agg(F.count("*").alias("n_keys"), F.sum("count").alias("n_rows"))


def loss(cells: DataFrame, kept: Column, keys: list[str]) -> DataFrame:
    """Cells before, lost, and the share lost."""
    lost = F.count_if(~F.coalesce(kept, F.lit(False)))
    return cells.groupBy(*keys).agg(F.count("*").alias("n_cells"), lost.alias("n_lost"), (lost / F.count("*")).alias("fraction_filtered"))


def line_fit(rows: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """Least squares per group."""
    return rows.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def in_band(x: Column, y: Column, slope: Column, intercept: Column, scalar, offset: float) -> Column:
    """Strictly within x * scalar + offset of the line; a null counts as outside."""
    return F.coalesce(F.abs(slope * x + intercept - y) < x * scalar + F.lit(offset), F.lit(False))


def scalar_sweep(rows: DataFrame, lines: DataFrame, x: str, y: str, keys: list[str], scalars: list[float], offset: float, threshold: float) -> tuple[DataFrame, DataFrame]:
    """A10: (kept rows, status). The smallest scalar that filters less than the threshold; one fit, one aggregation.

    A group in which no scalar passes keeps no rows and has a status row with a null scalar.
    """
    scalars = sorted(scalars)
    fitted = rows.join(lines, keys)
    inside = lambda s: in_band(F.col(x), F.col(y), F.col("slope"), F.col("intercept"), F.lit(s), offset)
    shares = fitted.groupBy(*keys).agg(*[(F.count_if(~inside(s)) / F.count("*")).alias(f"f{i}") for i, s in enumerate(scalars)])
    selected = F.coalesce(*[F.when(F.col(f"f{i}") < threshold, F.lit(float(s))) for i, s in enumerate(scalars)])
    status = shares.select(*keys, selected.alias("selected_scalar"), F.array(*[F.col(f"f{i}") for i in range(len(scalars))]).alias("fractions"))
    kept = fitted.join(status.select(*keys, "selected_scalar"), keys).where(in_band(F.col(x), F.col(y), F.col("slope"), F.col("intercept"), F.col("selected_scalar"), offset))
    return kept.select(*rows.columns), status
