"""Time-lapse tracking: everything is keyed by plate, well and tile, so no loop runs over tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored
from .neighbours import LEAF, nearest
from .spread import ranked, same

TILE = ["plate", "well", "tile"]


def edges(nuclei: DataFrame, k: int = 3, keys: list[str] = TILE, present_frames: bool = False, leaf: int = LEAF) -> DataFrame:
    """Each nucleus to its k nearest of the frame before, or of the last frame that is present.

    Nuclei without a position have no edges.
    """
    rows = nuclei.where("centroid_x IS NOT NULL AND centroid_y IS NOT NULL")
    rows = rows.select(*keys, "frame", F.col("nucleus_num").alias("_num"), F.col("centroid_x").cast("double").alias("_x"), F.col("centroid_y").cast("double").alias("_y"))
    if present_frames:
        rows = stored(rows)
        # A row for each frame of a tile.
        frames = rows.select(*keys, "frame").distinct().withColumn("_f", F.dense_rank().over(Window.partitionBy(*keys).orderBy("frame")))
        rows = rows.join(frames, same(rows, frames, [*keys, "frame"])).select(*[rows[c] for c in keys], F.col("_f").alias("frame"), "_num", "_x", "_y")
    found = nearest(rows, rows.withColumn("frame", F.col("frame") + 1), [*keys, "frame"], k, leaf)
    return found.select(*keys, "frame", F.col("_num").alias("nucleus_num"), F.col("_near").alias("prev_num"), "dist", "rank")


def _doubled(steps: DataFrame, n: int, keys: list[str], joined) -> DataFrame:
    """Segments of one step each (step from 0 to n - 1, a, b) -> the segments over all n steps.

    Each round joins the segments of even and odd place that meet in a node, so there are log2(n) joins of stored
    tables; a last segment without a partner waits for the next round.
    """
    steps = stored(steps)
    while n > 1:
        left = steps.where("step % 2 = 0").withColumn("step", F.floor(F.col("step") / 2).cast("int"))
        right = steps.where("step % 2 = 1").withColumn("step", F.floor(F.col("step") / 2).cast("int"))
        right = right.select(*keys, "step", F.col("a").alias("b"), F.col("b").alias("_to"), *[F.col(c).alias(f"_{c}") for c in steps.columns if c not in (*keys, "step", "a", "b")])
        out = joined(left.join(right, [*keys, "step", "b"]))
        if n % 2:
            out = out.unionByName(steps.where(F.col("step") == n - 1).withColumn("step", F.lit(n // 2)))
        steps, n = stored(out), (n + 1) // 2
    return steps


def cheapest_paths(links: DataFrame, start: int, last: int, cutoff: float = 100.0, keys: list[str] = TILE) -> DataFrame:
    """Cheapest path from the start frame to each nucleus of the last, of equal costs the first path.

    Path doubling: the cheapest paths between the nuclei of two frames, over twice as many frames each round. Costs over
    the cutoff go at once, which keeps the pairs few.
    """
    if last <= start:
        first = links.where(F.col("frame") == start + 1).select(*keys, F.col("prev_num").alias("at")).distinct()
        return first.select(*keys, "at", F.lit(0.0).alias("cost"), F.array("at").alias("path"))
    used = links.where(F.col("frame").between(start + 1, last) & (F.col("dist") <= cutoff))
    steps = used.select(*keys, (F.col("frame") - (start + 1)).cast("int").alias("step"), F.col("prev_num").alias("a"), F.col("nucleus_num").alias("b"), F.col("dist").alias("cost"), F.array("prev_num", "nucleus_num").alias("path"))
    best = F.min_by(F.struct("cost", "path"), F.struct("cost", "path")).alias("_v")

    def joined(pairs: DataFrame) -> DataFrame:
        whole = pairs.withColumn("cost", F.col("cost") + F.col("_cost")).where(F.col("cost") <= cutoff)
        whole = whole.withColumn("path", F.concat("path", F.slice("_path", 2, F.size("_path"))))
        return whole.groupBy(*keys, "step", "a", F.col("_to").alias("b")).agg(best).select(*keys, "step", "a", "b", "_v.cost", "_v.path")

    found = _doubled(steps, last - start, keys, joined)
    return found.groupBy(*keys, F.col("b").alias("at")).agg(best).select(*keys, "at", "_v.cost", "_v.path")


def strict_paths(paths: DataFrame, threshold: float = 35.0, keys: list[str] = TILE) -> DataFrame:
    """Without paths that share a node with another, and paths over the threshold."""
    nodes = paths.select(*keys, "at", F.posexplode("path").alias("step", "node"))
    shared = nodes.withColumn("n", F.count("*").over(Window.partitionBy(*keys, "step", "node"))).where("n > 1").select(*keys, "at").distinct()
    return paths.where(F.col("cost") <= threshold).join(shared, [*keys, "at"], "left_anti")


def better_paths(paths: DataFrame, threshold: float = 35.0, keys: list[str] = TILE) -> DataFrame:
    """T4: of paths that share a node the cheapest stays, if it is first at all its nodes; then T3's test."""
    nodes = paths.select(*keys, "at", "cost", F.posexplode("path").alias("step", "node"))
    lost = nodes.withColumn("r", F.row_number().over(Window.partitionBy(*keys, "step", "node").orderBy("cost", "at"))).where("r > 1").select(*keys, "at").distinct()
    return strict_paths(paths.join(lost, [*keys, "at"], "left_anti"), threshold, keys)


def tracks(nuclei: DataFrame, frames: list[int], cutoff: float = 250.0, keys: list[str] = TILE) -> DataFrame:
    """Nearest predecessor within the cutoff, nearest successor of each predecessor, chained over all frames.

    One row for each frame of each full track; ids count from 0 in each tile by the first nucleus.
    """
    link = edges(nuclei, 1, keys).where(F.col("dist") <= cutoff)
    order = Window.partitionBy(*keys, "frame", "prev_num").orderBy("dist", "nucleus_num")
    place = F.array_position(F.array(*[F.lit(f) for f in frames[1:]]), F.col("frame").cast("int")).cast("int") - 1
    link = link.withColumn("_r", F.row_number().over(order)).where("_r = 1").withColumn("step", place).where("step >= 0")
    steps = link.select(*keys, "step", F.col("prev_num").alias("a"), F.col("nucleus_num").alias("b"), F.array("prev_num", "nucleus_num").alias("path"))

    def joined(pairs: DataFrame) -> DataFrame:
        return pairs.select(*keys, "step", "a", F.col("_to").alias("b"), F.concat("path", F.slice("_path", 2, F.size("_path"))).alias("path"))

    chain = _doubled(steps, len(frames) - 1, keys, joined)
    ids = ranked(chain, keys, ["a"], "_place") if len(frames) > 1 else chain.withColumn("_place", F.lit(1))
    points = F.posexplode("path").alias("_at", "nucleus_num")
    long = ids.select(*keys, (F.col("_place") - 1).alias("track"), points).withColumn("frame", F.array(*[F.lit(f) for f in frames])[F.col("_at")]).drop("_at")
    return nuclei.join(long, [*keys, "frame", "nucleus_num"])


def series(tracked: DataFrame, barcode: str, frames: list[int], value: str, keys: list[str] = TILE) -> DataFrame:
    """The value over the frames of tracks that hold a single-barcode row of a barcode."""
    chosen = tracked.where((F.col("cell_barcode_0") == barcode) & F.col("cell_barcode_1").isNull()).select(*keys, "track").distinct()
    rows = tracked.where(F.col("frame").isin(frames)).join(chosen, [*keys, "track"], "left_semi")
    return rows.groupBy(*keys, "track").pivot("frame", frames).agg(F.first(value))
