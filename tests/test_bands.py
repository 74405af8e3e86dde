"""Bands and strips of images against one array: labels, distances, smoothing, and touching objects told apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscreen.operators import bands, regions

PIXELS = "plate string, well string, field int, channel string, row int, col int, value double, label int"
KEYS = ["plate", "well", "field", "channel"]


def rows_of(value, field=0, label=None, keep=None):
    at = [(r, c) for r in range(value.shape[0]) for c in range(value.shape[1]) if keep is None or keep[r, c]]
    return [("p", "w", field, "c", r, c, float(value[r, c]), int(0 if label is None else label[r, c])) for r, c in at]


def flooded(mask, diagonal):
    """Labels by plain search."""
    out, steps = np.zeros(mask.shape, int), [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (diagonal or not (i and j))]
    for r, c in np.argwhere(mask):
        if not out[r, c]:
            todo = [(r, c)]
            out[r, c] = name = r * mask.shape[1] + c + 1
            while todo:
                a, b = todo.pop()
                for i, j in steps:
                    p = (a + i, b + j)
                    if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not out[p]:
                        out[p] = name
                        todo.append(p)
    return out


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_of_arrays(diagonal):
    rng = np.random.default_rng(4)
    for share in (0.0, 0.2, 0.5, 0.6, 0.9, 1.0):
        for shape in ((1, 1), (1, 9), (9, 1), (17, 23), (40, 12)):
            mask = rng.random(shape) < share
            assert (regions.connected(mask, diagonal) == flooded(mask, diagonal)).all()


@pytest.mark.parametrize("diagonal", [False, True])
def test_labels_of_many_bands_are_those_of_one_array(spark, diagonal):
    rng = np.random.default_rng(7)
    spiral = np.zeros((41, 31), bool)
    for k in range(0, 15, 2):
        spiral[k : 41 - k, [k, 30 - k]] = True
        spiral[[k, 40 - k], k : 31 - k] = True
        spiral[k + 1, k] = False
    masks = {0: rng.random((41, 31)) < 0.55, 1: spiral, 2: np.ones((41, 31), bool), 3: np.zeros((41, 31), bool)}
    px = [r for f, m in masks.items() for r in rows_of(m, f)]
    df = spark.createDataFrame(px + px[:50] + [("p", "w", 0, "c", 0, 0, None, 0)], PIXELS).withColumn("on", F.col("value") > 0)
    for rows in (1, 5, 64):
        got = bands.labelled(df, "on", KEYS, 31, diagonal, rows).collect()
        for f, mask in masks.items():
            out = np.zeros(mask.shape, int)
            own = [r for r in got if r.field == f]
            for r in own:
                out[r.row, r.col] = r.component
            assert (out == flooded(mask, diagonal)).all() and len(own) == mask.sum()


def test_lower_envelopes():
    rng = np.random.default_rng(2)
    for shape in ((1, 1), (3, 17), (20, 40)):
        height = np.where(rng.random(shape) < 0.4, np.inf, rng.integers(0, 200, shape).astype(float))
        best, which = bands.squared_distances(height)
        c = np.arange(shape[1])
        every = (c[:, None] - c) ** 2 + height[:, None, :]
        assert (best == every.min(2)).all()
        known = np.isfinite(best)
        assert (np.take_along_axis(every, np.maximum(which, 0)[:, :, None], 2)[:, :, 0][known] == best[known]).all()
        mask = rng.random(shape) < 0.1
        on = np.argwhere(mask)
        want = [[min(((r - a) ** 2 + (k - b) ** 2 for a, b in on), default=np.inf) for k in range(shape[1])] for r in range(shape[0])]
        assert (bands.distance_to(mask) == np.array(want)).all()


@pytest.mark.parametrize(("distance", "strip"), [(1, 4), (3, 5), (8, 64), (30, 7)])
def test_grown_labels_of_any_distance(spark, distance, strip):
    rng = np.random.default_rng(distance)
    label = np.where(rng.random((23, 19)) < 0.04, rng.integers(1, 70_000, (23, 19)), 0)
    label[3, 3] = label[3, 7] = 5
    keep = (rng.random((23, 19)) < 0.8) | (label > 0)
    df = spark.createDataFrame(rows_of(label, 0, label, keep) + [("p", "w", 1, "c", 2, 2, None, 0), ("q", "w", 0, "d", -4, 3, 1.0, 9), ("q", "w", 0, "d", -5, 3, 1.0, 0)], PIXELS)
    grown = bands.grown_labels(df, distance, strip=strip)
    got = {(r.plate, r.field, r.row, r.col): r.label for r in grown.collect()}
    on = np.argwhere(label)
    for r, c in np.argwhere(keep):
        near = [((r - i) ** 2 + (c - j) ** 2, label[i, j]) for i, j in on if (r - i) ** 2 + (c - j) ** 2 <= distance**2]
        assert got["p", 0, r, c] == (label[r, c] or min(near, default=(0, 0))[1]), (r, c)
    assert got["p", 1, 2, 2] == 0 and got["q", 0, -5, 3] == 9 and len(got) == keep.sum() + 3 and grown.columns == df.columns


def test_smoothed_field_against_one_array(spark):
    rng = np.random.default_rng(3)
    images = [rng.uniform(0, 100, (30, 22)) + np.arange(22) for _ in range(3)]
    keep = rng.random((30, 22)) < 0.9
    keep[5:12, :9] = keep[29, 21] = True
    keep[8:16] = False  # strips without any pixel
    df = spark.createDataFrame([r for f, v in enumerate(images) for r in rows_of(v, f, keep=keep)], PIXELS)
    mean = np.where(keep, sum(images) / 3, (sum(images) / 3)[keep].mean())
    for sigma, strip in ((None, 4), (1.3, 7), (2.0, 64)):
        s = sigma or 3.0
        reach = int(4 * s + 0.5)
        weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / s) ** 2)
        weights /= weights.sum()
        wide, want = np.pad(mean, reach, mode="edge"), np.zeros_like(mean)
        for i, a in enumerate(weights):
            for j, b in enumerate(weights):
                want += a * b * wide[i : i + 30, j : j + 22]
        want /= want.max()
        got = bands.smoothed_field(df, ["plate", "well"], sigma, strip).collect()
        assert len(got) == keep.sum() and all(abs(r.value - want[r.row, r.col]) < 1e-9 for r in got)
    assert bands.smoothed_field(df.limit(0), ["plate", "well"]).count() == 0


def disks(shape, *circles):
    r, c = np.indices(shape)
    return np.logical_or.reduce([(r - a) ** 2 + (c - b) ** 2 <= d * d for a, b, d in circles])


def test_touching_objects_are_split(spark):
    two = disks((30, 40), (14, 12, 8), (14, 25, 8))
    out = bands.split_touching(two)
    assert set(np.unique(out)) == {0, 1, 2} and (out[two] > 0).all() and out[14, 10] == 1 and out[14, 28] == 2
    assert abs((out == 1).sum() - (out == 2).sum()) < 30
    for one in (disks((30, 40), (14, 12, 8)), disks((30, 40), (14, 12, 8), (14, 14, 8)), np.ones((5, 30), bool), np.ones((1, 1), bool)):
        assert set(np.unique(bands.split_touching(one))) - {0} == {1}
    assert not bands.split_touching(np.zeros((4, 4), bool)).any()
    df = spark.createDataFrame(rows_of(two.astype(float), label=np.ones_like(two, int)), PIXELS).withColumn("m", F.col("value") > 0)
    found = {depth: {r.object for r in regions.label_objects(df, "m", depth=depth).collect()} for depth in (None, 1.0)}
    assert found == {None: {0, 1}, 1.0: {0, 1, 2}}
