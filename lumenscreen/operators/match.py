"""Registration of fields to tiles and matching of nuclei."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import distance
from .neighbours import nearest

PLACE = ["plate", "well"]


def registration_gate(fields: DataFrame, least_cc: float = 0.30, most_distance: float = 15.0) -> DataFrame:
    """Equal values are kept."""
    apart = distance(F.col("expected_x"), F.col("expected_y"), F.col("actual_x"), F.col("actual_y"))
    return fields.where((F.col("cc_mag") >= least_cc) & (apart <= most_distance))


def candidate_tiles(fields: DataFrame, tiles: DataFrame, size: float, keys: list[str] = PLACE) -> DataFrame:
    """A range join, strict at both ends. Tiles are binned by size, so it is an equi-join on neighbouring bins."""
    bins = lambda c: F.floor(F.col(c) / size).cast("long")
    near = lambda c: F.explode(F.array(*[bins(c) + k for k in (-2, -1, 0, 1)]))
    t = tiles.withColumn("_bx", bins("tile_x")).withColumn("_by", bins("tile_y"))
    f = fields.withColumn("_bx", near("x")).withColumn("_by", near("y"))
    inside = lambda c, o: (F.col(c) > F.col(o) - 0.15 * size) & (F.col(c) < F.col(o) + 1.15 * size)
    return f.join(t, [*keys, "_bx", "_by"]).where(inside("x", "tile_x") & inside("y", "tile_y")).drop("_bx", "_by")


def best_tile(scored: DataFrame, field: list[str]) -> DataFrame:
    """The tile with the highest correlation; the first wins ties."""
    return scored.groupBy(*field).agg(F.max_by(F.struct("tile", "cc"), F.struct("cc", (-F.col("tile_order")).alias("o"))).alias("_t")).select(*field, "_t.tile", "_t.cc")


def _finite(x: str, y: str) -> Column:
    """Nulls and not-a-number are left out as well."""
    return (F.abs(F.col(x)) < float("inf")) & (F.abs(F.col(y)) < float("inf"))


def _places(nuclei: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _num, _x, _y: a row for each place with nuclei. Its number has the nucleus of the smallest label, and how many there are."""
    once = nuclei.groupBy(*keys, "x", "y").agg(F.min(F.struct("label", "intensity")).alias("_l"), F.count("*").alias("n"))
    return once.select(*keys, F.struct("_l.label", "_l.intensity", "n", "x", "y").alias("_num"), F.col("x").alias("_x"), F.col("y").alias("_y"))


def _with_nearest(nuclei: DataFrame, others: DataFrame, keys: list[str], k: int, near: str, leaf: int) -> DataFrame:
    """nuclei with ``near`` (label and intensity), dist and, with k = 2, second_dist: their nearest of the others.

    Nuclei of one place are looked up once; of others that share one, the smallest label is the nearest and the next one as far.
    """
    found = nearest(_places(nuclei, keys), _places(others, keys), keys, k, leaf)
    one = found.groupBy(*keys, "_num").agg(F.min_by("_near", "rank").alias(near), F.min("dist").alias("dist"), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias("_next"))
    one = one.select(*keys, F.col("_num.x").alias("x"), F.col("_num.y").alias("y"), near, "dist", F.when(F.col(f"{near}.n") > 1, F.col("dist")).otherwise(F.col("_next")).alias("second_dist"))
    out = nuclei.join(one, [*keys, "x", "y"])
    return out if k > 1 else out.drop("second_dist")


def mutual_nearest(nuclei_40x: DataFrame, nuclei_10x: DataFrame, keys: list[str], most: float = 15.0, ratio: float = 0.9, accept_single: bool = False, bucketed: bool = True, leaf: int = 1024) -> DataFrame:
    """Mutual nearest neighbours with a ratio test, within a registered pair.

    Inputs have the keys, label, x, y and intensity. Both sides look for their nearest through leaves of places
    (``neighbours``), about ``leaf`` in each, so no form compares all pairs. Bucketed form: the second distance is null
    beyond most / ratio. The other form also gives far second distances. Both accept the same pairs.

    A nucleus without a place (null or not-a-number) is nobody's neighbour, one at infinity at most a second one. Rows
    with the same keys and label are one nucleus in several places.
    """
    known = functools.reduce(operator.and_, [F.col(k).isNotNull() for k in keys])
    shape = [*keys, "label", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "intensity"]
    a, b = (n.where(known).select(*shape) for n in (nuclei_40x, nuclei_10x))
    far = b.where(F.greatest(F.abs("x"), F.abs("y")) == float("inf")).where("x IS NOT NULL AND y IS NOT NULL").select(*keys, F.lit(float("inf")).alias("_far")).distinct()
    a, b = (n.where(_finite("x", "y")) for n in (a, b))
    own = Window.partitionBy(*keys, "label").orderBy("dist", "_near.label")
    forth = _with_nearest(a, b, keys, 2, "_near", leaf).withColumns({"_r": F.row_number().over(own), "_also": F.lead("dist").over(own)}).where("_r = 1").where(F.col("dist") < most)
    back = _with_nearest(b, a, keys, 1, "_near", leaf).where(F.col("dist") < most).withColumn("_r", F.row_number().over(own)).where("_r = 1")
    forth = forth.select(*keys, F.col("label").alias("label_40x"), F.col("_near.label").alias("label_10x"), "dist", F.least("second_dist", "_also").alias("second_dist"), F.abs(F.col("intensity") - F.col("_near.intensity")).alias("intensity_diff"))
    back = back.select(*keys, F.col("_near.label").alias("label_40x"), F.col("label").alias("label_10x"), "dist")
    found = forth.join(back, [*keys, "label_40x", "label_10x", "dist"], "left_semi").join(far, keys, "left").withColumn("second_dist", F.coalesce("second_dist", "_far"))
    passes = F.when(F.col("second_dist").isNull(), F.lit(accept_single)).otherwise(F.try_divide("dist", "second_dist") < ratio)
    found = found.where(F.coalesce(passes, F.lit(False)))
    found = found.withColumn("second_dist", F.when(F.col("second_dist") <= most / ratio, F.col("second_dist"))) if bucketed else found
    return found.select(*keys, "label_40x", "label_10x", "dist", "second_dist", "intensity_diff")


def overlap_match(pixels_40x: DataFrame, pixels_10x: DataFrame, keys: list[str], least: float = 0.25, ratio: float = 1.5) -> DataFrame:
    """The most frequent 10x label under a nucleus; a label that is claimed twice is rejected."""
    a = pixels_40x.where("label <> 0").select(*keys, "row", "col", F.col("label").alias("label_40x"))
    b = pixels_10x.where("label <> 0").select(*keys, "row", "col", F.col("label").alias("label_10x"))
    areas = a.groupBy(*keys, "label_40x").agg(F.count("*").alias("area"))
    counts = a.join(b, [*keys, "row", "col"]).groupBy(*keys, "label_40x", "label_10x").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys, "label_40x").orderBy(F.desc("n"), "label_10x")
    top = counts.withColumn("_rn", F.row_number().over(order)).withColumn("_next", F.lead("n").over(order)).where("_rn = 1")
    good = top.join(areas, [*keys, "label_40x"]).where((F.col("n") / F.col("area") > least) & (F.col("_next").isNull() | (F.col("n") / F.col("_next") > ratio)))
    return good.withColumn("_claims", F.count("*").over(Window.partitionBy(*keys, "label_10x"))).where("_claims = 1").select(*keys, "label_40x", "label_10x", "n", "area")


def match_statistics(nuclei_40x: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """A3: matched, share matched, duplicated 10x nuclei; (0, 0.0, 0) for a field without matches."""
    total = nuclei_40x.groupBy(*keys).agg(F.count("*").alias("_n"))
    found = matches.groupBy(*keys).agg(F.count("*").alias("n_matched"), (F.count("label_10x") - F.count_distinct("label_10x")).alias("n_duplicated"))
    out = total.join(found, keys, "left")
    return out.select(*keys, F.coalesce("n_matched", F.lit(0)).alias("n_matched"), F.coalesce(F.col("n_matched") / F.col("_n"), F.lit(0.0)).alias("fraction"), F.coalesce("n_duplicated", F.lit(0)).alias("n_duplicated"))


def attach_once(matches: DataFrame, sbs: DataFrame, phenotype: DataFrame, sbs_key: list[str], phenotype_key: list[str], strict_well: bool = False) -> DataFrame:
    """SBS and phenotype row of a match, where exactly one of each exists; phenotype columns are null in another well."""

    def unique(d: DataFrame, key: list[str]) -> DataFrame:
        return d.join(d.groupBy(*key).count().where("count = 1").select(*key), key, "left_semi")

    features = [c for c in phenotype.columns if c not in (*phenotype_key, "well")]
    p = unique(phenotype, phenotype_key).withColumnRenamed("well", "_pwell")
    renamed = {c: f"{c}_y" for c in features if c in sbs.columns or c in matches.columns}
    p = p.withColumnsRenamed(renamed)
    out = matches.join(p, phenotype_key).join(unique(sbs, sbs_key), sbs_key)
    same = F.col("_pwell").eqNullSafe(F.col("well"))
    out = out.where(same) if strict_well else out.withColumns({renamed.get(c, c): F.when(same, F.col(renamed.get(c, c))) for c in features})
    return out.drop("_pwell")


def affine(x: Column, y: Column, c: list[Column]) -> Column:
    """One output of a fitted map."""
    return c[0] + c[1] * x + c[2] * y
