"""Small fixtures for the library's own operators: nulls, ties, single candidates, empty groups, planted data."""

import numpy as np
from pyspark.sql import functions as F

from lumenscreen.functions import coords, names
from lumenscreen.operators import clean, match, pixels, reads, robust, stats, track
from lumenscreen.sources import tables


def test_first_row_and_bad_barcodes(spark):
    rows = [("p", "w", 1, 1, 0, "bad", None), ("p", "w", 1, 1, 1, "good", None), ("p", "w", 1, None, 2, "good", None), ("p", "w", 2, 1, 3, "good", "bad"), ("p", "w", 2, 2, 4, None, None)]
    cells = spark.createDataFrame(rows, "plate string, well string, tile_10x int, cell int, seq int, cell_barcode_0 string, cell_barcode_1 string")
    first = clean.first_of_key(cells, ["seq"])
    assert sorted(r.seq for r in first.collect()) == [0, 3, 4]
    bad = spark.createDataFrame([("bad",), (None,)], "barcode string")
    assert [r.seq for r in clean.without_bad_barcodes(first, bad).collect()] == [4]
    assert clean.first_of_key(first, ["seq"]).count() == 3


def test_reads(spark):
    rows = [(1, "AAAAA", 0.05), (1, "AAAAA", 0.06), (1, "GGGGG", 0.9), (1, "CCCCC", 0.9), (0, "AAAAA", 0.9), (1, "TTTTT", 0.9)]
    df = spark.createDataFrame(rows, "cell int, barcode string, Q_min double")
    known = spark.createDataFrame([("AAAAA",), ("CCCCC",), ("CCCCC",)], "barcode string")
    kept = reads.valid_reads(df, known)
    assert sorted((r.cell, r.barcode) for r in kept.collect()) == [(0, "AAAAA"), (1, "AAAAA"), (1, "CCCCC")]
    called = reads.call_cells(kept, ["cell"]).collect()
    assert [(r.cell, r.cell_barcode_0, r.cell_barcode_1, r.barcode_count) for r in called] == [(1, "AAAAA", "CCCCC", 2)]


def test_mutual_nearest_rules(spark):
    schema = "k int, label int, x double, y double, intensity double"
    a = spark.createDataFrame([(1, 1, 0.0, 0.0, 5.0), (1, 2, 1.0, 0.0, 5.0), (1, 3, 100.0, 0.0, 5.0), (2, 1, 0.0, 0.0, 1.0), (3, 1, 0.0, 0.0, 1.0)], schema)
    b = spark.createDataFrame([(1, 1, 0.2, 0.0, 4.0), (1, 2, 115.0, 0.0, 4.0), (2, 1, 1.0, 0.0, 1.0), (3, 1, 0.0, 0.0, 1.0), (3, 2, 0.0, 0.0, 1.0)], schema)
    for bucketed in (False, True):
        got = match.mutual_nearest(a, b, ["k"], bucketed=bucketed).collect()
        assert [(r.k, r.label_40x, r.label_10x) for r in got] == [(1, 1, 1)]
        single = match.mutual_nearest(a, b, ["k"], accept_single=True, bucketed=bucketed).collect()
        assert sorted((r.k, r.label_40x) for r in single) == [(1, 1), (2, 1)]


def test_robust_line_finds_planted_line(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1000, 400)
    y = 2 * x + 5 + rng.normal(0, 1, 400)
    y[:40] += rng.uniform(500, 3000, 40)
    rows = [("p", "w", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("p", "w", None, 1.0), ("p", "w", 20000.0, 0.0)]
    fit = robust.robust_line(spark.createDataFrame(rows, "plate string, well string, x double, y double"), "x", "y", ["plate", "well"], trials=100).first()
    assert abs(fit.slope - 2) < 0.5


def test_robust_line_against_one_array(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 60, 900).astype(float)
    y = np.round(3 * x - 4 + rng.normal(0, 5, 900))
    y[:200] = 500 - 2 * x[:200]
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(x, y, strict=True)] + [("q", 1.0, 2.0), ("q", 1.0, 3.0), ("r", None, 1.0)], "k string, x double, y double")
    fits = [{r.k: r for r in robust.robust_line(df.repartition(n), "x", "y", ["k"], trials=60).collect()} for n in (1, 7)]
    assert set(fits[0]) == {"p", "q"} and fits[0]["q"].slope is None
    data = robust._identified(df.where("k = 'p'").select("k", "x", "y"), ["k"], ["x", "y"], 0).toPandas()
    x, y, taken = data["x"].to_numpy(), data["y"].to_numpy(), robust.draws(data["_row"].to_numpy(), 60) < 0.6
    assert len(x) == 900 and 0.55 < taken.mean() < 0.65
    limit, best = np.median(np.abs(y - np.median(y))), None
    for t in range(60):
        slope, intercept = np.polyfit(x[taken[:, t]], y[taken[:, t]], 1)
        rest = y - slope * x - intercept
        inside = np.abs(rest) <= limit
        key = (inside.sum(), round(1 - (rest[inside] ** 2).sum() / ((y[inside] - y[inside].mean()) ** 2).sum(), 9))
        best = max(best, (key, -t, inside), key=lambda b: b[:2]) if best else (key, -t, inside)
    want = np.polyfit(x[best[2]], y[best[2]], 1)
    for fit in fits:
        assert np.allclose([fit["p"].slope, fit["p"].intercept], want) and fit["p"].n_inliers == best[2].sum()


def test_sweep_without_passing_scalar(spark):
    rows = spark.createDataFrame([("p", "w", 1.0, float(i * 1000)) for i in range(10)], "plate string, well string, x double, y double")
    lines = spark.createDataFrame([("p", "w", 0.0, 0.0)], "plate string, well string, slope double, intercept double")
    kept, status = clean.scalar_sweep(rows, lines, "x", "y", ["plate", "well"], [0.1, 0.2], 1.0, 0.01)
    assert kept.count() == 0 and status.first().selected_scalar is None


def test_statistics_gates_and_nulls(spark):
    rows = [("a", None, 500.0, 1, float(i)) for i in range(30)] + [("b", None, 500.0, 0, 1.0)] * 29 + [("a", "x", 500.0, 1, 1e9)] + [("c", None, 100.0, 1, 1.0)]
    cells = spark.createDataFrame(rows, "cell_barcode_0 string, cell_barcode_1 string, intensity double, num_condensates int, f double")
    wanted = spark.createDataFrame([("a",), ("b",), ("absent",)], "barcode string")
    got = {r.cell_barcode_0: r for r in stats.barcode_statistics(cells, wanted, ["f"], "intensity").collect()}
    assert got["a"].mean_f == 14.5 and got["b"].mean_f is None and got["absent"].n_in_range == 0
    share = {r.cell_barcode_0: (r.fraction, r.n) for r in stats.condensate_share(cells, wanted, "intensity").collect()}
    assert share == {"a": (1.0, 30), "b": (0.0, 29), "absent": (None, 0)}


def test_edges_of_the_leaves_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    spots = [(t, f, n, float(rng.integers(0, 400 if t else 4000)), float(rng.integers(0, 60))) for t in range(2) for f in range(3) for n in range(40 if t else 12)]
    rows = [("p", "w", *s) for s in spots] + [("p", "w", 1, 1, 99, None, 1.0)]
    nuclei = spark.createDataFrame(rows, "plate string, well string, tile int, frame int, nucleus_num int, centroid_x double, centroid_y double")
    want = set()
    for t, f, n, x, y in spots:
        near = sorted((float(np.sqrt((x - a) * (x - a) + (y - b) * (y - b))), m) for u, g, m, a, b in spots if (u, g) == (t, f - 1))
        want |= {(t, f, n, m, d, i + 1) for i, (d, m) in enumerate(near[:3])}
    for leaf in (2, 9, 4096):
        got = track.edges(nuclei, leaf=leaf).collect()
        assert {(r.tile, r.frame, r.nucleus_num, r.prev_num, r.dist, r["rank"]) for r in got} == want and len(got) == len(want)


def test_images_as_arrays(spark):
    px = spark.createDataFrame([(0, "a", 0, 1, 5), (0, "a", 2, 0, 7), (1, "b", 1, 1, 9)], "field int, channel string, row int, col int, value int")
    images = tables.image_rows(px, 3, 2, ["field"])
    assert {r.field: r.pixels for r in images.collect()} == {0: [None, 5.0, None, None, 7.0, None], 1: [None, None, None, 9.0, None, None]}
    assert sorted(tuple(r) for r in tables.pixel_rows(images, ["field"]).collect()) == sorted((f, c, r, k, float(x)) for f, c, r, k, x in px.collect())


def test_tracks_need_every_frame(spark):
    rows = [(t, f, 10 * f + t, float(t * 50), float(f)) for t in range(3) for f in range(3) if (t, f) != (2, 1)]
    nuclei = spark.createDataFrame([("p", "w", 1, f, n, x, y) for _, f, n, x, y in rows], "plate string, well string, tile int, frame int, nucleus_num int, centroid_x double, centroid_y double")
    got = track.tracks(nuclei, [0, 1, 2], 20.0).collect()
    assert sorted((r.track, r.frame, r.nucleus_num) for r in got) == [(t, f, 10 * f + t) for t in range(2) for f in range(3)]


def test_pixels(spark):
    rows = [("p", "w", 0, c, r, k, (10 if c == "a" else r), 1) for c in "ab" for r in range(4) for k in range(7)]
    px = spark.createDataFrame(rows, "plate string, well string, field int, channel string, row int, col int, value int, label int")
    assert pixels.channel_correlation(px, "a", "b").first()["corr"] is None
    got = {r.channel: r for r in pixels.texture(px).collect()}
    assert got["a"].correlation == 1.0 and got["a"].energy == 1.0
    assert {r.channel: r.area for r in pixels.region_statistics(px).collect()} == {"a": 28, "b": 28}


def test_names_and_registrations(spark, tmp_path):
    df = spark.createDataFrame([("/x/WellB2_Seq-tile7.tif", "B5", "r01c01f12p01.tif"), ("bad", "Z9", "none")], "a string, w string, f string")
    got = df.select(names.well_10x(F.col("a")).alias("w"), names.tile_10x(F.col("a")).alias("t"), names.well_code(F.col("w")).alias("c"), names.field_40x(F.col("f")).alias("f")).collect()
    assert (got[0].w, got[0].t, got[0].c, got[0].f) == ("B2", 7, "r02c05", 12) and got[1].c is None and got[1].t is None
    (tmp_path / "a.txt").write_text("x.tif 1 2 3\n/a b//c.tif 0.5 1 2 3 4 5 6\n")
    (tmp_path / "b.txt").write_text("/y.tif 0.25 7 8\n")
    reg = {r.image_10x: (r.cc_mag, r.shift_x, r.actual_y) for r in tables.read_registrations(spark, str(tmp_path)).collect()}
    assert reg == {"/a b/c.tif": (0.5, 1.0, 6.0), "/y.tif": (0.25, 7.0, None)}
    assert spark.range(1).select(coords.floor_bin(F.lit(30.0), 10)).first()[0] == 30.0
