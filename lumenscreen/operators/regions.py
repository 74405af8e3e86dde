"""Objects inside cells, crops and registration of images; grown labels and flat fields are those of ``bands``.

Tasks in Python hold one cell, a strip of an image or a pair of images.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bands import distance_to, grown_labels, labelled, run_labels, smoothed_field, split_touching
from .pixels import IMAGE
from .registration import correlation, fast_size, placement, transform
from .spread import each_group

__all__ = ["condensate_intensities", "connected", "crops", "flag_holes", "grown_labels", "label_objects", "labelled", "nucleolus_mask", "registration_scores", "smoothed_field"]


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def connected(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """0 outside; inside, the smallest flat index + 1 of the pixel's connected set."""
    row, col = np.nonzero(mask)
    first = run_labels(row, col, diagonal)
    out = np.zeros(mask.shape, np.int64)
    out[row, col] = row[first] * mask.shape[1] + col[first] + 1
    return out


def _small(label: np.ndarray, below: int) -> np.ndarray:
    values, at, n = np.unique(label, return_inverse=True, return_counts=True)
    return ((n < below) & (values != 0))[at.reshape(label.shape)]


def label_objects(pixels: DataFrame, mask: str, least_hole: int = 4, least_area: int = 4, depth: float | None = None, keys: list[str] = IMAGE) -> DataFrame:
    """Pixels of a cell with object (0: none), from a boolean column.

    Holes (joined by edges) and objects (joined by edges or corners) below the sizes go. With a depth, objects that
    touch are told apart (``split_touching``). Then objects at the edge of the cell's box or with a neighbour outside
    the cell go. Objects are numbered in row order within a cell.
    """
    by = [*keys, "label", "channel"]
    cells = pixels.where("label <> 0").select(*by, "row", "col", "value", F.coalesce(F.col(mask), F.lit(False)).alias("_m"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        r, c = (g[n].to_numpy() - g[n].min() for n in ("row", "col"))
        inside = np.zeros((r.max() + 3, c.max() + 3), bool)
        found = inside.copy()
        inside[r + 1, c + 1], found[r + 1, c + 1] = True, g["_m"]
        found |= _small(connected(~found, False), least_hole) & inside
        label = connected(found, True)
        label[_small(label, least_area)] = 0
        if depth is not None:
            label = split_touching(label > 0, depth)
        edge = np.unique(label[np.logical_or.reduce([~np.roll(inside, s, a) for a in (0, 1) for s in (-1, 1)])])
        label[np.isin(label, edge)] = 0
        names = np.unique(np.append(0, label))
        g["object"] = np.searchsorted(names, label[r + 1, c + 1]).astype(np.int32)
        return g[[*by, "row", "col", "value", "object"]]

    return each_group(cells, by, one, _schema(cells, [*by, "row", "col", "value"]) + ", object int")


def _box(g: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and columns of a cell's pixels in its box, the pixels inside, and the box's values (0 outside)."""
    r, c = (g[n].to_numpy() - g[n].min() for n in ("row", "col"))
    inside = np.zeros((r.max() + 1, c.max() + 1), bool)
    value = np.zeros(inside.shape)
    inside[r, c], value[r, c] = True, g["value"]
    return r, c, inside, value


def _enclosed(mask: np.ndarray) -> np.ndarray:
    """Pixels outside the mask that no path by edges joins to the border."""
    label = connected(np.pad(~mask, 1, constant_values=True), False)
    return ((label != label[0, 0]) & (label != 0))[1:-1, 1:-1]


def cross_entropy_threshold(values: np.ndarray, guess: float, tolerance: float = 0.5) -> float:
    """Iterated minimum cross-entropy threshold of Li and Tam; a guess outside the values becomes their top less a half."""
    low, high = float(values.min()), float(values.max())
    if low == high:
        return high
    shifted = values - low
    now, following = -np.inf, (guess if low < guess < high else high - 0.5) - low
    while abs(following - now) > tolerance:
        now = following
        above = shifted > now
        if above.all() or not above.any() or (back := shifted[~above].mean()) == 0:
            break
        fore = shifted[above].mean()
        following = (back - fore) / (np.log(back) - np.log(fore))
    return following + low


def flag_holes(pixels: DataFrame, most_fill: int = 50, least_hole: int = 10, keys: list[str] = IMAGE) -> DataFrame:
    """X11: pixels of a cell with a boolean column hole: darker than a threshold of the inverted image of its box.

    Bright spots of fewer than ``most_fill`` pixels inside a hole belong to it; holes below ``least_hole`` pixels,
    counted with the dark surroundings that touch them, go. A null value counts as 0.
    """
    by = [*keys, "label", "channel"]
    cells = pixels.where("label <> 0").select(*by, "row", "col", F.coalesce("value", F.lit(0)).alias("value"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        r, c, inside, value = _box(g)
        dark = value < -cross_entropy_threshold(-value, -1.0)
        dark |= _small(connected(_enclosed(dark), True), most_fill)
        dark &= ~_small(connected(dark, False), least_hole)
        g["hole"] = dark[r, c]
        return g[[*by, "row", "col", "value", "hole"]]

    return each_group(cells, by, one, _schema(cells, [*by, "row", "col", "value"]) + ", hole boolean")


def nucleolus_mask(pixels: DataFrame, thresholds: DataFrame, keys: list[str] = IMAGE) -> DataFrame:
    """Pixels of a cell with a boolean column nucleolus: above the cell's threshold, or enclosed by such pixels."""
    by = [*keys, "label", "channel"]
    cells = pixels.where("label <> 0").join(thresholds, by).select(*by, "row", "col", "value", F.coalesce(F.col("value") > F.col("threshold"), F.lit(False)).alias("nucleolus"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        r, c, inside, _ = _box(g)
        mask = np.zeros(inside.shape, bool)
        mask[r, c] = g["nucleolus"]
        g["nucleolus"] = (mask | _enclosed(mask))[r, c]
        return g[[*by, "row", "col", "value", "nucleolus"]]

    return each_group(cells, by, one, _schema(cells, [*by, "row", "col", "value"]) + ", nucleolus boolean")


def _within(mask: np.ndarray, distance: int) -> np.ndarray:
    """Pixels whose Euclidean distance to the mask is at most ``distance``."""
    return distance_to(mask) <= distance * distance


def condensate_intensities(objects: DataFrame, every: str = "object", hole: str | None = None, shrink: int = 2, grow: int = 8, keys: list[str] = IMAGE) -> DataFrame:
    """Mean and population std of the pixels of a cell's objects, whole and shrunk, and of its dilute phase.

    ``object`` numbers the final objects (0: none). The dilute phase leaves out holes (a boolean column) and what is
    within ``grow`` pixels of any object in column ``every``, which also holds objects dropped from the final ones.
    Pixels of the cell's box outside the cell are background. A statistic of no pixel is null.
    """
    by = [*keys, "label", "channel"]
    no_hole = F.lit(False) if hole is None else F.coalesce(F.col(hole), F.lit(False))
    cells = objects.where("label <> 0").select(*by, "row", "col", "value", (F.coalesce("object", F.lit(0)) != 0).alias("_own"), (F.coalesce(F.col(every).cast("int"), F.lit(0)) != 0).alias("_every"), no_hole.alias("_hole"))

    def flagged(g: pd.DataFrame) -> pd.DataFrame:
        r, c, inside, _ = _box(g)
        own, near = np.zeros(inside.shape, bool), np.zeros(inside.shape, bool)
        own[r, c], near[r, c] = g["_own"], g["_every"]
        g["_core"] = (own & ~_within(~own, shrink))[r, c]
        g["_dilute"] = ~_within(near, grow)[r, c] & ~g["_hole"].to_numpy()
        return g[[*by, "value", "_own", "_hole", "_core", "_dilute"]]

    flags = each_group(cells, by, flagged, _schema(cells, [*by, "value"]) + ", _own boolean, _hole boolean, _core boolean, _dilute boolean")
    chosen = {"condensate": "_core", "condensate_no_shrink": "_own", "dilute": "_dilute"}
    parts = [f(F.when(F.col(flag), F.col("value"))).alias(f"{stat}_{name}") for name, flag in chosen.items() for stat, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return flags.groupBy(*by).agg(*parts, F.avg(F.when(~F.col("_hole"), F.col("value"))).alias("mean_no_holes"))


def masked_correlation(fixed: np.ndarray, moving: np.ndarray, fixed_mask: np.ndarray, moving_mask: np.ndarray, least_overlap: float) -> np.ndarray:
    """Normalised cross-correlation of two masked images at all shifts, by FFT (Padfield 2012).

    Entry (i, j) has the moving image's first pixel at (i, j) - moving shape + 1 of the fixed one. Shifts whose
    overlap is below a share of the largest one are 0.
    """
    fast = fast_size([a + b - 1 for a, b in zip(fixed.shape, moving.shape, strict=True)])
    spectra = [transform(np.where(mask, x, np.nan), fast) for x, mask in ((fixed, fixed_mask), (moving, moving_mask))]
    return correlation(*spectra, fixed.shape, moving.shape, fast, least_overlap)


def registration_scores(pairs: DataFrame, keys: list[str], least_overlap: float = 0.3) -> DataFrame:
    """Keys, cc (the largest correlation) and shift_row, shift_col, which lay the target over the source.

    A row of ``pairs`` holds two images row by row: source and target, each with _height and _width; null pixels are
    masked out. Equal largest correlations (to 1e-9) give the mean of their shifts. A pair with a null or empty
    image, or without any valid pixel, has nulls. One task holds one pair's images at a time.
    """
    images = [f"{side}{part}" for side in ("source", "target") for part in ("", "_height", "_width")]
    used = pairs.select(*keys, F.monotonically_increasing_id().alias("_pair"), *images)

    def image(row: pd.Series, side: str) -> np.ndarray | None:
        h, w = row[f"{side}_height"], row[f"{side}_width"]
        if row[side] is None or not len(row[side]) or pd.isna(h) or pd.isna(w):
            return None
        out = np.asarray(row[side], float).reshape(int(h), int(w))
        return None if np.isnan(out).all() else out

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        source, target = image(g.iloc[0], "source"), image(g.iloc[0], "target")
        out = g[keys].assign(cc=None, shift_row=None, shift_col=None)
        if source is not None and target is not None:
            cc = masked_correlation(target, source, ~np.isnan(target), ~np.isnan(source), least_overlap)
            best, row, col = placement(cc, source.shape, target.shape)
            out = g[keys].assign(cc=best, shift_row=row, shift_col=col)
        return out

    return used.groupBy(*keys, "_pair").applyInPandas(one, _schema(used, keys) + ", cc double, shift_row double, shift_col double")


def crops(pixels: DataFrame, size: int = 185, most: float = 65535.0, keys: list[str] = IMAGE) -> DataFrame:
    """Pixels of each cell, centred in a square (an odd remainder to the right), clipped and scaled to 16 bits.

    Cells larger than the square are skipped; n_clipped counts the clipped pixels of the crop.
    """
    by = [*keys, "label", "channel"]
    cells = pixels.where("label <> 0")
    box = cells.groupBy(*by).agg(F.min("row").alias("_r"), F.min("col").alias("_c"), (F.max("row") - F.min("row") + 1).alias("_h"), (F.max("col") - F.min("col") + 1).alias("_w"), F.count_if(F.col("value") > most).alias("n_clipped"))
    at = lambda c, low, extent: (F.col(c) - F.col(low) + F.floor((size - F.col(extent)) / 2)).cast("int").alias(c)
    value = F.floor(F.least(F.col("value"), F.lit(most)) / most * 65535).cast("int")
    return cells.join(box.where((F.col("_h") <= size) & (F.col("_w") <= size)), by).select(*by, at("row", "_r", "_h"), at("col", "_c", "_w"), value.alias("value"), "n_clipped")
