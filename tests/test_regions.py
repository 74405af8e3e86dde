"""Objects, grown labels, crops, flat fields and affine maps on small images, against plain loops."""

import numpy as np

from lumenscreen.operators import regions, robust

PIXELS = "plate string, well string, field int, channel string, row int, col int, value int, label int"


def image(label, value):
    return [("p", "w", 0, "c", r, c, int(value[r, c]), int(label[r, c])) for r in range(label.shape[0]) for c in range(label.shape[1])]


def test_objects_lose_holes_small_ones_and_those_at_the_edge(spark):
    on = np.zeros((12, 14), int)
    on[2:6, 2:6] = 1
    on[3, 3] = 0  # a hole to fill
    on[6:9, 6:9] = 1  # joined at a corner
    on[10, 2] = 1  # too small
    on[0:3, 9:12] = 1  # at the edge
    df = spark.createDataFrame(image(np.ones_like(on), on), PIXELS).selectExpr("*", "value = 1 AS m")
    got = {(r.row, r.col): r.object for r in regions.label_objects(df, "m").collect()}
    want = {(r, c) for r in range(2, 6) for c in range(2, 6)} | {(r, c) for r in range(6, 9) for c in range(6, 9)}
    assert len(got) == on.size and {k for k, v in got.items() if v} == want and {v for v in got.values() if v} == {1}
    assert regions.label_objects(df.where("value = 9"), "m").count() == 0


def test_grown_labels_against_loops(spark):
    label = np.random.default_rng(4).choice([0, 0, 0, 0, 0, 1, 2], (9, 9))
    got = {(r.row, r.col): r.label for r in regions.grown_labels(spark.createDataFrame(image(label, label), PIXELS), 2).collect()}
    for r in range(9):
        for c in range(9):
            near = [((r - i) ** 2 + (c - j) ** 2, label[i, j]) for i in range(9) for j in range(9) if label[i, j] and (r - i) ** 2 + (c - j) ** 2 <= 4]
            assert got[r, c] == (label[r, c] or min(near, default=(0, 0))[1])


def test_crops_flat_field_and_affine(spark):
    label = np.zeros((6, 6), int)
    label[1:3, 2:5] = 1
    df = spark.createDataFrame(image(label, label * 50 + 50), PIXELS)
    got = regions.crops(df, 6, 80.0).collect()
    assert {(r.row, r.col) for r in got} == {(r, c) for r in (2, 3) for c in (1, 2, 3)} and {(r.value, r.n_clipped) for r in got} == {(65535, 6)}
    assert regions.crops(df, 2).count() == 0
    flat = regions.smoothed_field(df.selectExpr("plate", "well", "channel", "row", "col", "7 AS value"), ["plate", "well"]).collect()
    assert len(flat) == 36 and all(abs(r.value - 1) < 1e-9 for r in flat)
    rng = np.random.default_rng(0)
    xy = rng.uniform(0, 1000, (40, 2))
    to = np.column_stack([5 + 2 * xy[:, 0], -3 + 2 * xy[:, 1]])
    to[:12] += rng.uniform(100, 900, (12, 2))
    rows = [("a", *map(float, x), *map(float, y)) for x, y in zip(xy, to, strict=True)] + [("a", None, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0, 1.0)]
    fit = {r.k: r for r in robust.robust_affine(spark.createDataFrame(rows, "k string, x double, y double, to_x double, to_y double"), ["k"], trials=200).collect()}
    assert np.allclose(fit["a"].of_x, [5, 2, 0]) and np.allclose(fit["a"].of_y, [-3, 0, 2]) and fit["a"].n_inliers == 28 and fit["b"].of_x is None


def test_holes_and_nucleoli(spark):
    value = np.full((14, 14), 1000)
    value[2:6, 2:6] = 10  # a hole of 16 pixels
    value[3, 3] = 900  # a spot inside it
    value[9, 9] = 10  # too small
    label = np.ones((14, 14), int)
    df = spark.createDataFrame(image(label, value), PIXELS)
    got = {(r.row, r.col) for r in regions.flag_holes(df).collect() if r.hole}
    assert got == {(r, c) for r in range(2, 6) for c in range(2, 6)}
    flat = spark.createDataFrame(image(label, label * 7), PIXELS)
    assert regions.flag_holes(flat).where("hole").count() == 0 and regions.flag_holes(df.where("label = 9")).count() == 0
    limits = spark.createDataFrame([("p", "w", 0, 1, "c", 500.0)], "plate string, well string, field int, label int, channel string, threshold double")
    ring = {(r.row, r.col) for r in regions.nucleolus_mask(df, limits).collect() if r.nucleolus}
    assert ring == {(r, c) for r in range(14) for c in range(14)}
    gap = spark.createDataFrame(image(label, np.where(np.arange(14)[None, :] == 3, 10, value)), PIXELS)  # opens to the edge
    assert {(r.row, r.col) for r in regions.nucleolus_mask(gap, limits).collect() if not r.nucleolus} == {(r, 3) for r in range(14)} | {(r, c) for r in range(2, 6) for c in range(2, 6)}


def test_cross_entropy_threshold_separates_two_levels():
    values = np.random.default_rng(2).permutation(np.append(np.full(300, 20.0), np.full(100, 200.0)))
    assert 20 < regions.cross_entropy_threshold(values, 100.0) < 200
    assert regions.cross_entropy_threshold(np.full(9, 3.0), 1.0) == 3.0


def _slow(fixed, moving, least):
    (h, w), (a, b) = fixed.shape, moving.shape
    out, over = np.zeros((h + a - 1, w + b - 1)), np.zeros((h + a - 1, w + b - 1))
    for i in range(h + a - 1):
        for j in range(w + b - 1):
            pairs = [(fixed[r, c], moving[r - i + a - 1, c - j + b - 1]) for r in range(h) for c in range(w) if 0 <= r - i + a - 1 < a and 0 <= c - j + b - 1 < b]
            pairs = np.array([p for p in pairs if not np.isnan(p).any()]).reshape(-1, 2)
            over[i, j] = len(pairs)
            d = pairs - pairs.mean(0) if len(pairs) else pairs
            scale = np.sqrt((d**2).sum(0).prod()) if len(pairs) else 0
            out[i, j] = (d[:, 0] * d[:, 1]).sum() / scale if scale > 1e-6 else 0
    out[over < least * over.max()] = 0
    return out


def test_masked_correlation_against_loops_and_known_shift(spark):
    rng = np.random.default_rng(7)
    big = rng.integers(0, 100, (24, 24)).astype(float)
    fixed, moving = big[4:16, 5:17].copy(), big[6:18, 2:14].copy()
    fixed[0, :3] = np.nan
    moving[5, 5] = np.nan
    got = regions.masked_correlation(fixed, moving, ~np.isnan(fixed), ~np.isnan(moving), 0.3)
    assert np.allclose(got, _slow(fixed, moving, 0.3), atol=1e-8)
    flat = lambda x: [None if np.isnan(v) else float(v) for v in x.ravel()]
    schema = "k string, source array<double>, source_height int, source_width int, target array<double>, target_height int, target_width int"
    rows = [("a", flat(moving), 12, 12, flat(fixed), 12, 12), ("b", None, 12, 12, flat(fixed), 12, 12), ("c", [None] * 4, 2, 2, flat(fixed), 12, 12)]
    found = {r.k: r for r in regions.registration_scores(spark.createDataFrame(rows, schema), ["k"]).collect()}
    assert abs(found["a"].cc - 1) < 1e-9 and (found["a"].shift_row, found["a"].shift_col) == (-2.0, 3.0)
    assert found["b"].cc is None and found["c"].cc is None and len(found) == 3
    assert regions.registration_scores(spark.createDataFrame([], schema), ["k"]).count() == 0


def test_condensate_intensities_against_loops(spark):
    rng = np.random.default_rng(9)
    label = np.ones((20, 20), int)
    value = rng.integers(1, 100, label.shape)
    own = np.zeros(label.shape, bool)
    own[3:10, 3:10] = True
    own[15, 15] = True
    every = own.copy()
    every[0, 19] = True
    hole = rng.random(label.shape) < 0.1
    rows = [(*r, int(own[r[4], r[5]]), bool(every[r[4], r[5]]), bool(hole[r[4], r[5]])) for r in image(label, value)]
    df = spark.createDataFrame(rows, PIXELS + ", object int, every boolean, hole boolean")
    far = lambda r, c, mask, most: all((r - i) ** 2 + (c - j) ** 2 > most**2 for i, j in np.argwhere(mask))
    places = [(r, c) for r in range(20) for c in range(20)]
    core = [value[p] for p in places if own[p] and far(*p, ~own, 2)]
    dilute = [value[p] for p in places if not hole[p] and far(*p, every, 8)]
    got = regions.condensate_intensities(df, "every", "hole").first()
    want = [np.mean(core), np.std(core), value[own].mean(), value[own].std(), np.mean(dilute), np.std(dilute), value[~hole].mean()]
    assert core and dilute and np.allclose(list(got)[-7:], want)
    none = regions.condensate_intensities(df.selectExpr("* except (object)", "0 object")).first()
    assert none.mean_condensate is None and none.mean_condensate_no_shrink is None and abs(none.mean_dilute - value.mean()) < 1e-9
