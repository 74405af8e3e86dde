"""Images cut into bands of rows or columns: labels, distances and smoothing of which no task holds an image."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import stored
from .pixels import IMAGE
from .spread import Step, numbers, same, streamed


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each element's set, where a and b are joined: union-find for all joins at once."""
    root = np.arange(size)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low < high
        if not open_.any():
            break
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    return root


def run_labels(row: np.ndarray, col: np.ndarray, diagonal: bool) -> np.ndarray:
    """For each pixel of a set, in row order without repeats: which pixel is the first of its connected set.

    Pixels next to each other in a row are a run; a run meets those runs of the next row that overlap it.
    """
    if not len(row):
        return np.zeros(0, np.int64)
    starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1)))
    ends = np.append(starts[1:], len(row)) - 1
    reach, low = int(diagonal), int(col.min()) - 1
    width = int(col.max()) - low + 3
    first, last = row[starts] * width + col[starts] - low, row[ends] * width + col[ends] - low
    a = np.searchsorted(last, first + width - reach)
    b = np.searchsorted(first, last + width + reach, "right")
    n = np.maximum(b - a, 0)
    left = np.repeat(np.arange(len(starts)), n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
    of_run = roots(len(starts), left, right)
    return np.repeat(starts[of_run], ends - starts + 1)


def _band_labels(names: list[str], width: int, diagonal: bool, schema_names: list[str]):
    """Streams of a band's pixels (_kind 0, in row order), then a row that asks for them."""

    class Band(Step):
        def end(self) -> Iterator[pa.RecordBatch]:
            table = self.first
            row, col = numbers(table, "row", np.int64), numbers(table, "col", np.int64)
            first = run_labels(row, col, diagonal)
            place = row[first] * width + col[first] + 1
            yield pa.RecordBatch.from_arrays([*[table[n].combine_chunks() for n in names], pa.array(row, pa.int32()), pa.array(col, pa.int32()), pa.array(place)], names=schema_names)

    return Band


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, root: the smallest node that links (keys, a, b) lead to; a row for every node of a link.

    Each round a node takes the smallest root among its neighbours', then the root of that root, so paths shorten fast.
    """
    both = stored(links.select(*keys, "a", "b").union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = stored(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        theirs = now.select(*keys, F.col("node").alias("b"), F.col("root").alias("_r"))
        seen = both.join(theirs, [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("_r").alias("_r"))
        least = stored(now.join(seen, [*keys, "node"]).withColumn("_least", F.least("root", "_r")).drop("_r"))
        jump = least.select(*keys, F.col("node").alias("_least"), F.col("_least").alias("_far"))
        after = stored(least.join(jump, [*keys, "_least"], "left").select(*keys, "node", F.least("_least", "_far").alias("root"), (F.least("_least", "_far") != F.col("root")).alias("_moved")))
        if not after.where("_moved").limit(1).count():
            return after.drop("_moved")
        now = after.drop("_moved")


def labelled(pixels: DataFrame, mask: str, keys: list[str], width: int, diagonal: bool = False, rows: int = 256) -> DataFrame:
    """X11 to X13 for images of any size: the pixels of a boolean column with component, row * width + col + 1 of the
    first pixel, in row order, of the connected set.

    A task labels the runs of a band of ``rows`` rows. Sets that touch across the border of two bands are links between
    their names; what these lead to renames the sets, so an image of many bands has the labels of one array. Repeated
    pixels count once.
    """
    on = pixels.where(F.coalesce(F.col(mask), F.lit(False))).select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).distinct()
    on = on.withColumn("_band", F.floor(F.col("row") / rows).cast("int"))
    asks = on.select(*keys, "_band").distinct()
    both = on.withColumn("_kind", F.lit(0)).unionByName(asks.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    names = [*keys, "row", "col", "component"]
    schema = T.StructType([*on.select(*keys).schema.fields, T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("component", T.LongType())])
    local = stored(streamed(both, [*keys, "_band"], ["row", "col"], _band_labels(keys, width, diagonal, names), schema))
    steps = F.explode(F.array(*[F.col("col") + i for i in ((-1, 0, 1) if diagonal else (0,))]))
    above = local.where((F.col("row") + 1) % rows == 0).select(*keys, (F.col("row") + 1).alias("row"), steps.alias("col"), F.col("component").alias("a"))
    below = local.where(F.col("row") % rows == 0).select(*keys, "row", "col", F.col("component").alias("b"))
    links = above.join(below, [*keys, "row", "col"]).select(*keys, "a", "b").distinct()
    renamed = components(links, keys).where("node <> root").select(*keys, F.col("node").alias("component"), "root")
    return local.join(renamed, [*keys, "component"], "left").select(*keys, "row", "col", F.coalesce("root", "component").alias("component"))


def squared_distances(height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of heights: at every column c the least (c - j) ** 2 + height[j] over columns j, and such a j.

    The lower envelope of the parabolas of all columns, for all rows at once: every column enters the stacks of the
    rows' envelopes once and leaves once, so the cost doesn't depend on how far a minimum is. Heights may be infinite.
    """
    rows, width = height.shape
    at = np.arange(rows)
    stack, bound = np.zeros((rows, width), np.int64), np.full((rows, width + 1), np.inf)
    size = np.zeros(rows, np.int64)
    for j in range(width):
        live = at[np.isfinite(height[:, j])]
        open_ = live
        cross = np.full(rows, -np.inf)
        while len(open_):
            open_ = open_[size[open_] > 0]
            top = stack[open_, size[open_] - 1]
            meets = ((height[open_, j] + j * j) - (height[open_, top] + top * top)) / (2.0 * (j - top))
            cross[open_] = meets
            out = meets <= bound[open_, size[open_] - 1]
            size[open_[out]] -= 1
            cross[open_[out & (size[open_] == 0)]] = -np.inf
            open_ = open_[out]
        stack[live, size[live]] = j
        bound[live, size[live]] = np.where(size[live] == 0, -np.inf, cross[live])
        size[live] += 1
    best, which = np.full((rows, width), np.inf), np.full((rows, width), -1)
    place = np.zeros(rows, np.int64)
    some = at[size > 0]
    for c in range(width):
        while True:
            nxt = some[(place[some] + 1 < size[some])]
            nxt = nxt[bound[nxt, place[nxt] + 1] < c]
            if not len(nxt):
                break
            place[nxt] += 1
        j = stack[some, place[some]]
        best[some, c], which[some, c] = (c - j) ** 2 + height[some, j], j
    return best, which


def distance_to(mask: np.ndarray) -> np.ndarray:
    """Squared Euclidean distance of every place of an array to the mask; infinite without any."""
    down = np.where(mask, 0.0, np.inf)
    best, _ = squared_distances(down.T)
    return squared_distances(best.T)[0]


class _Strip(Step):
    """Streams of a strip: its given values (_kind 0), then a row that asks for the result."""

    def dense(self, across: str, along: str, value: str, fill: float) -> tuple[np.ndarray, int, int]:
        """Values as an array, across the strip by along it, and its first places."""
        i, j = numbers(self.first, across, np.int64), numbers(self.first, along, np.int64)
        out = np.full((int(np.ptp(i)) + 1, int(np.ptp(j)) + 1), fill)
        out[i - i.min(), j - j.min()] = numbers(self.first, value)
        return out, int(i.min()), int(j.min())


def _strips(rows: DataFrame, keys: list[str], across: str, size: int) -> DataFrame:
    """Input of ``streamed``: all rows as _kind 0 of their strip, and a row for each strip behind them."""
    placed = rows.withColumn("_strip", F.floor(F.col(across) / size).cast("int"))
    asks = placed.select(*keys, "_strip").distinct()
    return placed.withColumn("_kind", F.lit(0)).unionByName(asks.withColumn("_kind", F.lit(1)), allowMissingColumns=True)


def _columns_of(keys: list[str], distance: int, scale: int):
    """X15, first pass: of a strip of columns, every place within the distance of a label in its own column."""

    class Columns(_Strip):
        def end(self) -> Iterator[pa.RecordBatch]:
            t = self.first
            label, top, left = self.dense("row", "col", "label", 0)
            # Room for what grows over the ends.
            label = np.pad(label.astype(np.int64), [(distance, distance), (0, 0)])
            near = np.full(label.shape, np.inf)
            for reverse in (False, True):
                view, out = (x[::-1] if reverse else x for x in (label, near))
                last, name = np.full(view.shape[1], -(10**9)), np.zeros(view.shape[1], np.int64)
                for i in range(len(view)):
                    here = view[i] > 0
                    last[here], name[here] = i, view[i][here]
                    apart = (i - last).astype(np.float64)
                    # Squared distance and label in one number: the smaller label wins among equal distances.
                    out[i] = np.minimum(out[i], np.where(apart <= distance, apart * apart * scale + name, np.inf))
            i, j = np.nonzero(np.isfinite(near))
            key = [pa.array([t[k][0].as_py()] * len(i), t.schema.field(k).type) for k in keys]
            yield pa.RecordBatch.from_arrays([*key, pa.array(i + top - distance, pa.int32()), pa.array(j + left, pa.int32()), pa.array(near[i, j])], names=[*keys, "row", "col", "_near"])

    return Columns


def _rows_of(columns: list[str], distance: int, scale: int):
    """X15, second pass: of a strip of rows, what the columns gave (_kind 0), then background pixels (_kind 1)."""

    class Rows(_Strip):
        def __init__(self, first: pa.Table | None):
            super().__init__(first)
            if first is not None:
                near, self.top, self.left = self.dense("row", "col", "_near", np.inf)
                near = np.pad(near, [(0, 0), (distance, distance)], constant_values=np.inf)
                self.left -= distance
                # All parabolas are scaled alike, so the envelope is that of the heights over the scale.
                best, which = squared_distances(near / scale)
                at = np.arange(near.shape[1])
                key = np.where(which >= 0, ((at - which) ** 2) * scale + np.take_along_axis(near, np.maximum(which, 0), 1), np.inf)
                self.label = np.where(np.isfinite(key) & (key // scale <= distance * distance), key % scale, 0)

        def rows(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            label = np.zeros(batch.num_rows, np.int64)
            if self.first is not None:
                i, j = numbers(batch, "row", np.int64) - self.top, numbers(batch, "col", np.int64) - self.left
                inside = (i >= 0) & (i < self.label.shape[0]) & (j >= 0) & (j < self.label.shape[1])
                label[inside] = self.label[i[inside], j[inside]].astype(np.int64)
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(label)], names=[*columns, "_label"])

    return Rows


def grown_labels(pixels: DataFrame, distance: int, keys: list[str] = IMAGE, strip: int = 64) -> DataFrame:  # noqa: B006
    """Background pixels within a distance take the nearest label, the smaller one of equals.

    An exact distance transform in two passes: along the columns, each place learns of the labels of its own column; along
    the rows, the lower envelope of the columns' parabolas gives the nearest of all. A task holds a strip of columns or of
    rows, and its cost doesn't depend on the distance. Labels must be positive and below 2 ** 24.
    """
    columns = pixels.columns
    by = [*keys, "channel"]
    # Squared distances and labels share the 53 bits of a double.
    most = pixels.agg(F.max("label")).first()[0] or 0
    scale = 1 << int(most).bit_length()
    if scale > 1 << 24 or scale * (distance + 1) ** 2 >= 1 << 52:
        raise ValueError("labels are too large for this distance")
    on = pixels.where("label <> 0").groupBy(*by, "row", "col").agg(F.min("label").alias("label"))
    place = T.StructType([*on.select(*by).schema.fields, T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("_near", T.DoubleType())])
    near = streamed(_strips(on, by, "col", strip), [*by, "_strip"], [], _columns_of(by, distance, scale), place)
    own = pixels.withColumns({"_strip": F.floor(F.col("row") / strip).cast("int"), "_kind": F.lit(1)})
    given = near.withColumns({"_strip": F.floor(F.col("row") / strip).cast("int"), "_kind": F.lit(0)})
    types = {c: pixels.schema[c].dataType for c in columns}
    given = given.select(*[F.col(c).cast(types[c]).alias(c) if c in (*by, "row", "col") else F.lit(None).cast(types[c]).alias(c) for c in columns], "_near", "_strip", "_kind")
    both = given.unionByName(own.where("label = 0 OR label IS NULL").withColumn("_near", F.lit(None).cast("double")))
    out = streamed(both, [*by, "_strip"], [], _rows_of(columns, distance, scale), T.StructType([*pixels.schema.fields, T.StructField("_label", T.LongType())]))
    found = out.withColumn("label", F.col("_label").cast(types["label"])).drop("_label")
    return pixels.where("label <> 0").unionByName(found)


def blurred(lines: np.ndarray, sigma: float) -> np.ndarray:
    """Every row smoothed by a Gaussian cut at four sigma, its ends extended."""
    reach = int(4 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weights /= weights.sum()
    wide = np.pad(lines, [(0, 0), (reach, reach)], mode="edge")
    out = np.zeros_like(lines)
    for i, w in enumerate(weights):
        out += w * wide[:, i : i + lines.shape[1]]
    return out


def _blur(keys: list[str], across: str, along: str):
    """Strips smoothed along themselves; the first rows bring the image's size, its mean and sigma."""

    class Blur(_Strip):
        def end(self) -> Iterator[pa.RecordBatch]:
            t = self.first
            i, j = numbers(t, across, np.int64), numbers(t, along, np.int64)
            length, mean, sigma, low, high = (t[n][0].as_py() for n in ("_length", "_mean", "_sigma", "_low", "_high"))
            lines = np.full((high - low, length), mean)
            lines[i - low, j] = numbers(t, "value")
            lines = blurred(lines, sigma)
            a, b = (x.ravel() for x in np.indices(lines.shape))
            key = [pa.array([t[k][0].as_py()] * len(a), t.schema.field(k).type) for k in keys]
            yield pa.RecordBatch.from_arrays([*key, pa.array(a + low, pa.int32()), pa.array(b, pa.int32()), pa.array(lines.ravel())], names=[*keys, across, along, "value"])

    return Blur


def smoothed_field(pixels: DataFrame, keys: list[str], sigma: float | None = None, strip: int = 64) -> DataFrame:
    """Mean image of the keys and channel, smoothed (a tenth of its height, ends extended), over its maximum.

    Strips of rows are smoothed along the rows, then strips of columns along the columns: a Gaussian is both, one after
    the other, so strips need nothing of their neighbours and no task holds the image. Places without a pixel take the
    image's mean, and have no row in the result.
    """
    by = [*keys, "channel"]
    means = stored(pixels.groupBy(*by, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).agg(F.avg("value").alias("value")))
    size = means.groupBy(*by).agg((F.max("row") + 1).alias("_height"), (F.max("col") + 1).alias("_width"), F.avg("value").alias("_mean"))
    size = stored(size.withColumn("_sigma", F.lit(float(sigma)) if sigma else F.greatest(F.col("_height") / 10, F.lit(0.5))))
    now = means
    for across, along, length, extent in (("row", "col", "_width", "_height"), ("col", "row", "_height", "_width")):
        # Every strip of an image is there, also where all its places lack a pixel.
        every = size.select(*by, F.explode(F.sequence(F.lit(0), F.floor((F.col(extent) - 1) / strip).cast("int"))).alias("_strip"), F.col(length).alias("_length"), "_mean", "_sigma", F.col(extent).alias("_extent"))
        every = every.withColumn("_low", F.col("_strip") * strip).withColumn("_high", F.least(F.col("_low") + strip, "_extent")).drop("_extent")
        facts = every.columns[len(by) + 1 :]
        placed = now.withColumn("_strip", F.floor(F.col(across) / strip).cast("int"))
        # A strip's corner with the image's mean stands for a strip without pixels.
        corner = every.select(*by, F.col("_low").alias(across), F.lit(0).alias(along), F.col("_mean").alias("value"), "_strip").withColumn("_first", F.lit(0))
        given = placed.withColumn("_first", F.lit(1)).unionByName(corner)
        given = given.join(every, same(given, every, [*by, "_strip"])).select(*[given[c] for c in given.columns], *facts).withColumn("_kind", F.lit(0))
        asks = every.select(*by, "_strip").withColumn("_kind", F.lit(1))
        schema = T.StructType([*means.select(*by).schema.fields, T.StructField(across, T.IntegerType()), T.StructField(along, T.IntegerType()), T.StructField("value", T.DoubleType())])
        now = streamed(given.unionByName(asks, allowMissingColumns=True), [*by, "_strip"], ["_first"], _blur(by, across, along), schema)
    now = stored(now)
    top = stored(now.groupBy(*by).agg(F.max("value").alias("_top")))
    out = now.join(means.select(*by, "row", "col"), [*by, "row", "col"], "left_semi")
    out = out.join(top, same(out, top, by)).select(*[out[c] for c in out.columns], "_top")
    return out.select(*by, "row", "col", F.when(F.col("_top") != 0, F.col("value") / F.col("_top")).otherwise(F.col("value")).alias("value"))


def split_touching(mask: np.ndarray, depth: float = 1.0) -> np.ndarray:
    """Numbers of objects (from 1; 0 outside) of a small mask, touching ones apart: flooding in order of height.

    A pixel's height is its distance to the outside. From the highest on, a pixel joins the basin of the neighbour to
    which the way up is steepest; where two basins meet, the lower one is an object of its own if its peak stands
    ``depth`` above the meeting, otherwise it becomes part of the other. Own contract: the called function isn't at hand.
    """
    wide = np.pad(mask, 1)
    height = np.sqrt(distance_to(~wide))
    flat, w = height.ravel(), wide.shape[1]
    inside = np.flatnonzero(wide.ravel())
    order = inside[np.argsort(-flat[inside], kind="stable")]
    basin = np.full(flat.size, -1)
    parent, peak = [], []

    def find(b: int) -> int:
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        return b

    around = [(i * w + j, (i * i + j * j) ** 0.5) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    for p in order.tolist():
        known = [(s, far) for s, far in around if basin[p + s] >= 0]
        near = sorted({find(int(basin[p + s])) for s, _ in known}, key=lambda b: (-peak[b], b))
        if not near:
            basin[p] = len(parent)
            parent.append(len(parent))
            peak.append(float(flat[p]))
            continue
        for lower in near[1:]:
            if peak[lower] - flat[p] < depth:
                parent[lower] = near[0]
        steepest = max(known, key=lambda n: ((flat[p + n[0]] - flat[p]) / n[1], -n[0]))[0]
        basin[p] = basin[p + steepest]
    out = np.zeros(flat.size, np.int64)
    out[inside] = [find(int(b)) for b in basin[inside]]
    # Numbered by the first pixel in row order.
    names, first, at = np.unique(out[inside], return_index=True, return_inverse=True)
    out[inside] = np.argsort(np.argsort(first))[at] + 1
    return out.reshape(wide.shape)[1:-1, 1:-1]
