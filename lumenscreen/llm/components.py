"""Connected components by alternating large-star and small-star steps, all of them joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, salted_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _smallest(links: DataFrame, total: int) -> DataFrame:
    """links (u, v) with m: the smallest of u and all its v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return salted_join(links, least, "u", F.col("v"), "n", total).withColumn("m", F.least("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, root): the smallest node of the component of every node that has an edge to another one."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        large = _smallest(both, 2 * before[0]).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = _smallest(large.select(F.col("a").alias("u"), F.col("b").alias("v")), 2 * before[0])
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).union(down.select("u", "m")).where("a <> b").distinct()
        now = cut(small)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
