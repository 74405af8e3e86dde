"""Sequencing reads to cells: calls, quality filters, barcodes of a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READ = ["plate", "well", "tile", "cell", "read"]


def call_reads(bases: DataFrame, keys: list[str] = READ) -> DataFrame:
    """A1: per cycle the channel with most intensity; quality of a cycle is its share less that of the second.

    Own contract: Q = (first - second) / first, 0 where the first isn't positive; ties go to the base that sorts first.
    """
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("intensity")).alias("down"), F.col("channel").alias("base"))))
    cycles = bases.groupBy(*keys, "cycle").agg(ranked.alias("r"))
    first, second = -F.get("r", F.lit(0))["down"], F.coalesce(-F.get("r", F.lit(1))["down"], F.lit(0.0))
    quality = F.when(first > 0, (first - second) / first).otherwise(0.0)
    cycles = cycles.select(*keys, "cycle", F.get("r", F.lit(0))["base"].alias("base"), quality.alias("q"))
    bases_in_order = F.transform(F.sort_array(F.collect_list(F.struct("cycle", "base"))), lambda x: x["base"])
    return cycles.groupBy(*keys).agg(F.array_join(bases_in_order, "").alias("barcode"), F.min("q").alias("Q_min"))


def valid_reads(reads: DataFrame, barcodes: DataFrame, key: str = "barcode", quality: float = 0.05, artefact: Column | None = None) -> DataFrame:
    """Not the all-G artefact, quality above the limit (strictly), key in the list.

    The semi join is left to Spark, which broadcasts a list that it knows to be small.
    """
    artefact = F.repeat(F.lit("G"), F.length("barcode")) if artefact is None else artefact
    kept = reads.where((F.col("barcode") != artefact) & (F.col("Q_min") > quality))
    return kept.join(barcodes.select(key).distinct(), key, "left_semi")


def call_cells(reads: DataFrame, keys: list[str] = ["plate", "well", "tile", "cell"]) -> DataFrame:  # noqa: B006
    """A2: the two most frequent barcodes of a cell; ties by barcode; cell 0 is background. Counts combine before the shuffle."""
    counts = reads.where("cell <> 0").groupBy(*keys, "barcode").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "barcode"))
    best = counts.withColumn("rn", rank)
    value = lambda column, k: F.max(F.when(F.col("rn") == k, F.col(column)))
    return best.groupBy(*keys).agg(value("barcode", 1).alias("cell_barcode_0"), value("n", 1).alias("cell_barcode_count_0"), value("barcode", 2).alias("cell_barcode_1"), F.coalesce(value("n", 2), F.lit(0)).alias("cell_barcode_count_1"), F.sum("n").alias("barcode_count"))


def quality_sweep(reads: DataFrame, barcodes: DataFrame, thresholds: list[float], keys: list[str]) -> DataFrame:
    """Per threshold the reads above it, the share that is in the list, and cells with such a read. One scan."""
    marked = reads.join(barcodes.select("barcode", F.lit(True).alias("_known")).distinct(), "barcode", "left")
    rows = marked.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where(F.col("Q_min") > F.col("threshold"))
    known = F.coalesce("_known", F.lit(False))
    return rows.groupBy("threshold").agg(F.count("*").alias("reads"), (F.count_if(known) / F.count("*")).alias("mapped"), F.count_distinct(F.when(known, F.struct(*keys))).alias("cells"))


def with_barcode_table(cells: DataFrame, phenotype: DataFrame, barcodes: DataFrame, cycles: int, keys: list[str] = ["plate", "well", "tile", "cell"]) -> DataFrame:  # noqa: B006
    """Cells, their phenotype, and the barcode table by the prefix of the cycles in use."""
    named = barcodes.withColumn("_prefix", F.substring("barcode", 1, cycles)).dropDuplicates(["_prefix"]).withColumnRenamed("barcode", "library_barcode")
    return cells.join(phenotype, keys, "left").join(named, F.substring("cell_barcode_0", 1, cycles) == F.col("_prefix"), "left").drop("_prefix")
