"""Adapter views: the given tables in the shape of the domain's, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    rows = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        F.col("l_returnflag").alias("plate"), F.col("l_linestatus").alias("well"), (F.col("l_suppkey") % 10).alias("tile_10x"), F.col("l_partkey").alias("cell"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
        F.col("p_brand").alias("cell_barcode_0"), F.when(F.col("l_linenumber") > 5, F.col("p_type")).alias("cell_barcode_1"), (F.col("l_extendedprice") / 10).alias("intensity"), (F.col("l_linenumber") - 1).alias("num_condensates"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("feature"), F.col("l_quantity").alias("area"), F.col("p_type").alias("sublib"),
    )


CELLS = """cells AS (SELECT l_returnflag AS plate, l_linestatus AS well, l_suppkey % 10 AS tile_10x, l_partkey AS cell, l_orderkey AS ord, l_linenumber AS line,
  p_brand AS cell_barcode_0, CASE WHEN l_linenumber > 5 THEN p_type END AS cell_barcode_1, l_extendedprice / 10 AS intensity, l_linenumber - 1 AS num_condensates,
  CASE WHEN l_tax <> 0 THEN l_quantity END AS feature, l_quantity AS area, p_type AS sublib FROM lineitem JOIN part ON l_partkey = p_partkey)"""
CELL_COLUMNS = ["plate", "well", "tile_10x", "cell", "ord", "line", "cell_barcode_0", "cell_barcode_1", "intensity", "num_condensates", "feature", "area", "sublib"]


def barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("barcode")).distinct()


BARCODES = "barcodes AS (SELECT DISTINCT p_brand AS barcode FROM part)"


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.lit("p").alias("plate"), F.lit("w").alias("well"), (F.col("user_id") % 10).alias("tile"), F.col("user_id").alias("cell"), F.col("event_id").alias("read"), F.col("event_type").alias("barcode"), (F.col("value") / 100).alias("Q_min"))


READS = "reads AS (SELECT 'p' AS plate, 'w' AS well, user_id % 10 AS tile, user_id AS cell, event_id AS read, event_type AS barcode, value / 100 AS Q_min FROM events)"


def nuclei(spark: SparkSession, sf_dir: str, side: int | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows if side is None else rows.where(F.col("vec_id") % 2 == side)
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    return rows.select(F.col("label").alias("tile"), F.col("vec_id").alias("label"), at(0).alias("x"), at(1).alias("y"), at(2).alias("intensity"))


NUCLEI = "nuclei AS (SELECT label AS tile, vec_id AS label, vec_id % 2 AS side, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS intensity FROM embeddings)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nuclei(spark, sf_dir)
    return rows.select(F.lit("p").alias("plate"), F.lit("w").alias("well"), "tile", (F.floor(F.col("label") / 10) % 4).cast("int").alias("frame"), F.col("label").alias("nucleus_num"), F.col("x").alias("centroid_x"), F.col("y").alias("centroid_y"), F.concat(F.lit("b"), F.col("label") % 5).alias("cell_barcode_0"), F.when(F.col("label") % 3 == 0, "z").alias("cell_barcode_1"))


FRAMES = "frames AS (SELECT tile, ((label // 10) % 4)::INT AS frame, label AS nucleus_num, x, y, 'b' || (label % 5) AS cell_barcode_0, CASE WHEN label % 3 = 0 THEN 'z' END AS cell_barcode_1 FROM nuclei)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as pixels of two channels: 400 orders make an image of 40 x 40 places, so images grow with the table.

    Lines of one order with the same place add up.
    """
    at = (F.col("l_orderkey") % 400) * 4 + F.col("l_linenumber") % 4
    field = F.floor(F.col("l_orderkey") / 400).cast("int")
    rows = table(spark, sf_dir, "lineitem").select(field.alias("field"), F.floor(at / 40).cast("int").alias("row"), (at % 40).cast("int").alias("col"), F.col("l_extendedprice").cast("int").alias("v0"), (F.col("l_quantity") * 100).cast("int").alias("v1"))
    one = rows.groupBy("field", "row", "col").agg(F.sum("v0").cast("int").alias("v0"), F.sum("v1").cast("int").alias("v1"))
    place = [F.concat(F.lit("P"), F.floor(F.col("field") / 50)).alias("plate"), F.concat(F.lit("W"), F.floor(F.col("field") / 10) % 5).alias("well")]
    label = F.when((F.col("row") % 10 < 8) & (F.col("col") % 20 < 16), F.floor(F.col("row") / 10) * 2 + F.floor(F.col("col") / 20) + 1).otherwise(0).cast("int")
    both = F.explode(F.array(F.struct(F.lit("c0").alias("channel"), F.col("v0").alias("value")), F.struct(F.lit("c1").alias("channel"), F.col("v1").alias("value"))))
    return one.withColumn("label", label).select(*place, "field", "row", "col", "label", both.alias("x")).select("plate", "well", "field", "x.channel", "row", "col", "x.value", "label")


PIXELS = """one AS (SELECT (l_orderkey // 400)::INT AS field, (((l_orderkey % 400) * 4 + l_linenumber % 4) // 40)::INT AS row, (((l_orderkey % 400) * 4 + l_linenumber % 4) % 40)::INT AS col, sum(trunc(l_extendedprice)::INT)::INT AS v0, sum(trunc(l_quantity * 100)::INT)::INT AS v1 FROM lineitem GROUP BY ALL),
lab AS (SELECT 'P' || field // 50 AS plate, 'W' || field // 10 % 5 AS well, *, (CASE WHEN row % 10 < 8 AND col % 20 < 16 THEN (row // 10) * 2 + col // 20 + 1 ELSE 0 END)::INT AS label FROM one),
pixels AS (SELECT plate, well, field, 'c0' AS channel, row, col, v0 AS value, label FROM lab UNION ALL SELECT plate, well, field, 'c1', row, col, v1, label FROM lab)"""
