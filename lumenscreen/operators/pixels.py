"""Statistics over pixel tables: (image keys, channel, row, col, value, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMAGE = ["plate", "well", "field"]


def apply_flatfield(pixels: DataFrame, field: DataFrame, keys: list[str]) -> DataFrame:
    """Value over field, saturated, truncated."""
    return pixels.join(field.withColumnRenamed("value", "_f"), [*keys, "channel", "row", "col"]).withColumn("value", F.least(F.col("value") / F.col("_f"), F.lit(65535.0)).cast("int")).drop("_f")


def bleedthrough(pixels: DataFrame, channel: str, other: str, factor: float, keys: list[str] = IMAGE) -> DataFrame:
    """One channel less a share of another, floor at 0, truncated."""
    own = pixels.where(F.col("channel") == channel)
    there = pixels.where(F.col("channel") == other).select(*keys, "row", "col", F.col("value").alias("_o"))
    return own.join(there, [*keys, "row", "col"]).withColumn("value", F.greatest(F.lit(0.0), F.col("value") - F.col("_o") * factor).cast("int")).drop("_o")


def region_statistics(pixels: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """Per label and channel; the box's upper ends are exclusive."""
    v = F.col("value")
    out = pixels.where("label <> 0").groupBy(*keys, "label", "channel").agg(
        F.count("*").alias("area"), F.avg(v).alias("mean"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"), F.sum(v).alias("total"), F.avg("row").alias("centroid_row"), F.avg("col").alias("centroid_col"),
        F.min("row").alias("min_row"), F.min("col").alias("min_col"), (F.max("row") + 1).alias("max_row"), (F.max("col") + 1).alias("max_col"),
    )
    return out


def inside_regions(regions: DataFrame, low: int, high: int, height: int, width: int) -> DataFrame:
    """X6."""
    clear = (F.col("min_row") > 0) & (F.col("min_col") > 0) & (F.col("max_row") < height) & (F.col("max_col") < width)
    return regions.where((F.col("area") > low) & (F.col("area") < high) & clear)


def channel_correlation(pixels: DataFrame, first: str, second: str, keys: list[str] = IMAGE) -> DataFrame:
    """Pearson; null below two pixels or for a constant channel."""
    wide = pixels.where("label <> 0").groupBy(*keys, "label", "row", "col").agg(F.max(F.when(F.col("channel") == first, F.col("value"))).alias("a"), F.max(F.when(F.col("channel") == second, F.col("value"))).alias("b"))
    value = F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b"))
    return wide.groupBy(*keys, "label").agg(F.when(F.count("*") > 1, value).alias("corr"))


def max_projection(pixels: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """X7."""
    return pixels.groupBy(*keys, "channel", "row", "col").agg(F.max("value").alias("value"))


def percentile_scaled(pixels: DataFrame, percent: float = 99.5, keys: list[str] = IMAGE) -> DataFrame:
    """Over the image's percentile, clipped at 1, to 8 bits."""
    top = pixels.groupBy(*keys, "channel").agg(F.percentile("value", F.lit(percent / 100)).alias("_top"))
    return pixels.join(top, [*keys, "channel"]).withColumn("value", F.bround(F.least(F.lit(1.0), F.try_divide("value", "_top")) * 255).cast("int")).drop("_top")


def rotated(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """By 180 degrees."""
    return pixels.withColumns({"row": height - 1 - F.col("row"), "col": width - 1 - F.col("col")})


def halved(pixels: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """Means of 2 x 2; an odd last row or column is averaged with zeros."""
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return pixels.groupBy(*keys, "channel", half("row"), half("col")).agg(F.bround(F.sum("value") / 4).cast("int").alias("value"))


def condensate_threshold(pixels: DataFrame, k: float = 3.0, cutoff: float = 300.0, keys: list[str] = IMAGE) -> DataFrame:
    """max(mean(dilute) + k * std(dilute), cutoff), dilute: below twice the mean.

    Column hole, if there, marks pixels left out, unless they cover more than three quarters of the cell.
    """
    cells = pixels.where("label <> 0")
    if "hole" in pixels.columns:
        share = cells.groupBy(*keys, "label", "channel").agg(F.avg(F.col("hole").cast("int")).alias("_h"))
        cells = cells.join(share, [*keys, "label", "channel"]).where(~F.col("hole") | (F.col("_h") > 0.75)).drop("_h")
    means = cells.groupBy(*keys, "label", "channel").agg(F.avg("value").alias("_m"))
    dilute = cells.join(means, [*keys, "label", "channel"]).where(F.col("value") < 2 * F.col("_m"))
    return dilute.groupBy(*keys, "label", "channel").agg(F.greatest(F.avg("value") + k * F.stddev_pop("value"), F.lit(cutoff)).alias("threshold"))


def nucleolus_threshold(pixels: DataFrame, k: float = 0.9, cutoff: float = 300.0, keys: list[str] = IMAGE) -> DataFrame:
    """max(mean + k * std(dilute), cutoff), dilute: below twice the mean; the mean is that of all pixels."""
    cells = pixels.where("label <> 0").withColumn("_m", F.avg("value").over(_cell(keys)))
    dilute = F.when(F.col("value") < 2 * F.col("_m"), F.col("value"))
    return cells.groupBy(*keys, "label", "channel").agg(F.greatest(F.avg("value") + k * F.stddev_pop(dilute), F.lit(cutoff)).alias("threshold"))


def object_properties(objects: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """Number, area, intensity and eccentricity of the objects of each cell; no objects: 0 and nulls."""
    one = objects.where("label <> 0 AND object <> 0").groupBy(*keys, "label", "object").agg(F.count("*").alias("area"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.var_pop("row").alias("a"), F.var_pop("col").alias("b"), F.covar_pop("row", "col").alias("c"))
    root = F.sqrt(((F.col("a") - F.col("b")) / 2) ** 2 + F.col("c") ** 2)
    l1, l2 = (F.col("a") + F.col("b")) / 2 + root, (F.col("a") + F.col("b")) / 2 - root
    one = one.withColumn("ecc", F.when(l1 <= 1e-12, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(l2, l1)))))
    stats = one.groupBy(*keys, "label").agg(F.count("*").alias("num"), F.sum("total").alias("total_intensity"), F.sum("area").alias("total_area"), F.avg("area").alias("mean_area"), F.stddev_pop("area").alias("std_area"), F.avg("ecc").alias("mean_ecc"), F.stddev_pop("ecc").alias("std_ecc"))
    cells = objects.where("label <> 0").select(*keys, "label").distinct()
    return cells.join(stats, [*keys, "label"], "left").withColumn("num", F.coalesce("num", F.lit(0)))


def mask_overlap(pixels: DataFrame, first: str, second: str, keys: list[str] = IMAGE) -> DataFrame:
    """Area where both masks hold, and its share of the first."""
    both, own = F.count_if(F.col(first) & F.col(second)), F.count_if(F.col(first))
    return pixels.where("label <> 0").groupBy(*keys, "label").agg(both.alias("overlap_area"), F.try_divide(both, own).alias("overlap_fraction"))


def texture(pixels: DataFrame, offset: int = 5, keep_zero: bool = False, keys: list[str] = IMAGE) -> DataFrame:
    """Grey-level co-occurrence at a column offset, symmetric; level 0 removed unless asked for."""
    rows = pixels.where("label <> 0").withColumn("level", F.when(F.max("value").over(_cell(keys)) < 256, F.col("value")).otherwise(F.floor(F.col("value") / 256)).cast("int"))
    rows = rows if keep_zero else rows.where("level > 0")
    a = rows.select(*keys, "label", "channel", "row", "col", F.col("level").alias("i"))
    b = rows.select(*keys, "label", "channel", "row", (F.col("col") - offset).alias("col"), F.col("level").alias("j"))
    counts = a.join(b, [*keys, "label", "channel", "row", "col"]).groupBy(*keys, "label", "channel", "i", "j").agg(F.count("*").alias("n"))
    sym = counts.unionByName(counts.select(*keys, "label", "channel", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy(*keys, "label", "channel", "i", "j").agg(F.sum("n").alias("n"))
    w, d = F.col("n"), F.col("i") - F.col("j")
    total = F.sum(w)
    out = sym.groupBy(*keys, "label", "channel").agg(
        total.alias("_n"), (F.sum(w * F.abs(d)) / total).alias("dissimilarity"), (F.sum(w * d * d) / total).alias("contrast"), (F.sum(w / (1 + d * d)) / total).alias("homogeneity"), (F.sqrt(F.sum(w * w)) / total).alias("energy"),
        (F.sum(w * F.col("i")) / total).alias("_m"), (F.sum(w * F.col("i") * F.col("i")) / total).alias("_q"), (F.sum(w * F.col("i") * F.col("j")) / total).alias("_p"),
    )
    var = F.col("_q") - F.col("_m") * F.col("_m")
    return out.withColumn("correlation", F.when(var <= 1e-12, 1.0).otherwise(F.try_divide(F.col("_p") - F.col("_m") * F.col("_m"), var))).drop("_n", "_m", "_q", "_p")


def _cell(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys, "label", "channel")
