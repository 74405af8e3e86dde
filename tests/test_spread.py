"""Ranks, percentiles, neighbours, paths and fits where one key owns most rows, against plain arrays."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscreen.operators import neighbours, robust, spread, stats, track
from lumenscreen.sources import tables


def percentile(x, share):
    x = sorted(x)
    at = (len(x) - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    return x[low] if x[low] == x[high] else (high - at) * x[low] + (at - low) * x[high]


@pytest.mark.parametrize(("width", "accuracy", "few"), [(0.0005, 10_000, 4_000), (0.001, 200, 50), (1e-9, 10, 20)])
@pytest.mark.parametrize("direct", [0, 1_000_000])
def test_exact_quantiles_of_a_hot_key(spark, monkeypatch, width, accuracy, few, direct):
    if direct and few < 4_000:
        pytest.skip("no brackets")
    monkeypatch.setattr(spread, "FEW", few)
    monkeypatch.setattr(spread, "DIRECT", direct)
    rng = np.random.default_rng(3)
    hot = np.append(rng.normal(0, 50, 8500), np.repeat(7.0, 500))
    rows = [("hot", float(v), float(np.floor(v))) for v in hot] + [("b", 1.0, None), ("b", 2.0, None), ("b", 5.0, 1.0), ("c", None, None), (None, 9.0, 9.0), ("d", 4.0, 4.0)]
    rows += [(f"k{i % 30}", float(rng.integers(0, 9)), float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(5)
    shares = {"x": [0.0, 0.05, 0.5, 0.95, 1.0], "y": [0.3]}
    got = {r.k: r for r in spread.quantiles(df, ["k"], shares, {"n": F.count("*")}, width, accuracy).collect()}
    keys = {k for k, _, _ in rows} - {None}
    assert set(got) == keys
    for k in keys:
        for c, at in (("x", 1), ("y", 2)):
            own = [r[at] for r in rows if r[0] == k and r[at] is not None]
            assert got[k][c] == ([percentile(own, s) for s in shares[c]] if own else None), (k, c)
        assert got[k].n == sum(r[0] == k for r in rows)


def test_quantiles_hold_no_key_in_a_window(spark, monkeypatch):
    monkeypatch.setattr(spread, "DIRECT", 1000)
    # The windows' input is what a bracket holds: a few of the different values of a key.
    df = tables.stored(spark.range(200_000).select(F.lit("k").alias("k"), F.rand(5).alias("x")))
    seen = []
    real = spread.join_key
    spread.join_key = lambda rows, per_key, keys, how="inner": seen.append(rows) or real(rows, per_key, keys, how)
    try:
        got = spread.quantiles(df, ["k"], {"x": [0.5]}).first()
    finally:
        spread.join_key = real
    assert got.x == [percentile([r.x for r in df.collect()], 0.5)]
    assert seen[1].count() < 2_000


@pytest.mark.parametrize("direct", [0, 1_000_000])
def test_statistics_with_ninety_percent_in_one_barcode(spark, monkeypatch, direct):
    monkeypatch.setattr(spread, "DIRECT", direct)
    rng = np.random.default_rng(6)
    rows = [("a" if i % 10 else f"b{i % 7}", None, float(rng.integers(1, 1000)), int(rng.integers(0, 3)), float(rng.normal())) for i in range(6000)]
    cells = spark.createDataFrame(rows, "cell_barcode_0 string, cell_barcode_1 string, intensity double, num_condensates int, f double")
    wanted = spark.createDataFrame([("a",), ("b1",), ("none",)], "barcode string")
    got = {r.cell_barcode_0: r for r in stats.barcode_statistics(cells, wanted, ["f"], "intensity", how="median", low=100, high=900).collect()}
    pct = {r.cell_barcode_0: r for r in stats.percentiles(cells, wanted, "f", "intensity", [5, 50], low=100, high=900).collect()}
    mid = {r.cell_barcode_0: r for r in stats.average_property(cells, wanted, "f", "intensity", "median", 100, 900).collect()}
    for k in ("a", "b1"):
        own = [r[4] for r in rows if r[0] == k and 100 < r[2] < 900]
        m = percentile(own, 0.5)
        assert (got[k].median_f, mid[k].value, got[k].n_in_range) == (m, m, len(own))
        assert got[k].mad_f == percentile([abs(x - m) for x in own], 0.5) and pct[k].percentiles == [percentile(own, 0.05), m]
    assert got["none"].median_f is None and (pct["none"].percentiles, pct["none"].n) == (None, 0)
    floor = {k: percentile([r[2] for r in rows if r[0] == k], 0.1) for k in {r[0] for r in rows}}
    assert stats.above_floor(cells, "intensity", 10).count() == sum(r[2] > floor[r[0]] for r in rows)


def test_ranks_of_a_hot_key(spark):
    rows = [("hot" if i % 10 else None if i % 20 else "b", (i * 37) % 500, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(6)
    got = spread.ranked(df, ["k"], [F.col("x").desc(), "i"])
    want = {}
    for k in {r[0] for r in rows}:
        want |= {i: n for n, (_, i) in enumerate(sorted((-x, i) for c, x, i in rows if c == k), 1)}
    assert got.columns == ["k", "x", "i", "rank"] and {r.i: r["rank"] for r in got.collect()} == want


def points(spark, rows):
    return spark.createDataFrame(rows, "g int, _num int, _x double, _y double")


@pytest.mark.parametrize(("leaf", "sample"), [(4096, 1024), (40, 64), (8, 16), (1, 512)])
def test_neighbours_in_clumps_and_alone(spark, leaf, sample, monkeypatch):
    monkeypatch.setattr(neighbours, "STREAM", 150)
    rng = np.random.default_rng(leaf)
    at = np.concatenate([rng.normal(0, 1, (200, 2)), rng.normal((1000, 5), 0.01, (150, 2)), rng.uniform(-9000, 9000, (30, 2)), np.full((60, 2), 3.0), rng.integers(0, 9, (120, 2))])
    candidates = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [(1, 7, 0.0, 0.0)] + [(2, i, float(i), 0.0) for i in range(4)]
    asked = [(0, i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([at[::3], rng.uniform(-20000, 20000, (25, 2))]))]
    asked += [(1, 1, 5.0, 5.0), (2, 5, 1.5, 0.0), (3, 1, 0.0, 0.0)]
    got = neighbours.nearest(points(spark, asked).repartition(3), points(spark, candidates).repartition(3), ["g"], 3, leaf, sample).collect()
    want = set()
    for g, n, x, y in asked:
        near = sorted((float(np.sqrt((x - a) * (x - a) + (y - b) * (y - b))), m) for c, m, a, b in candidates if c == g)
        want |= {(g, n, m, d, i) for i, (d, m) in enumerate(near[:3], 1)}
    assert {(r.g, r["_num"], r["_near"], r["dist"], r["rank"]) for r in got} == want and len(got) == len(want)


NUCLEI = "plate string, well string, tile int, frame int, nucleus_num int, centroid_x double, centroid_y double"


def test_a_hundred_frames(spark):
    # Five nuclei drift; the fourth is missing in one frame.
    rows = [("p", "w", 1, f, 10 * f + t, t * 100.0 + f, float(t)) for f in range(101) for t in range(5) if (f, t) != (57, 3)]
    nuclei = spark.createDataFrame(rows, NUCLEI)
    got = track.tracks(nuclei, list(range(101)), 20.0).select("track", "frame", "nucleus_num").collect()
    assert sorted(map(tuple, got)) == sorted((i, f, 10 * f + t) for i, t in enumerate((0, 1, 2, 4)) for f in range(101))
    links = tables.stored(track.edges(nuclei))
    paths = track.cheapest_paths(links, 0, 100, cutoff=120.0).collect()
    assert {(r.at, round(r.cost, 9), tuple(r.path)) for r in paths} == {(1000 + t, 100.0, tuple(10 * f + t for f in range(101))) for t in (0, 1, 2, 4)}


def test_cheapest_paths_against_a_sweep(spark):
    rng = np.random.default_rng(12)
    spots = [(t, f, n, float(rng.integers(0, 12)), float(rng.integers(0, 12))) for t in range(2) for f in range(8) for n in range(9)]
    links = tables.stored(track.edges(spark.createDataFrame([("p", "w", *s) for s in spots], NUCLEI)))
    edges = {}
    for r in links.collect():
        edges.setdefault((r.tile, r.frame), []).append((r.prev_num, r.nucleus_num, r.dist))
    for start, last in ((0, 7), (2, 5), (3, 4), (1, 7)):
        want = {}
        for t in range(2):
            now = {a: (0.0, (a,)) for a, _, _ in edges[t, start + 1]}
            for f in range(start + 1, last + 1):
                after = {}
                for a, b, d in edges[t, f]:
                    if a in now and now[a][0] + d <= 9:
                        after[b] = min(after.get(b, (np.inf, ())), (now[a][0] + d, (*now[a][1], b)), key=lambda v: (round(v[0], 9), v[1]))
                now = after
            want |= {(t, b): (round(c, 6), p[0], p[-1]) for b, (c, p) in now.items()}
        got = {(r.tile, r.at): (round(r.cost, 6), r.path[0], r.path[-1]) for r in track.cheapest_paths(links, start, last, 9.0).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][2] == want[k][2] for k in got)


def test_tracks_scan_their_table_once(spark):
    nuclei = spark.createDataFrame([("p", "w", 1, f, f, float(f), 0.0) for f in range(5)], NUCLEI)
    plan = track.tracks(nuclei, list(range(5)), 20.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 4


def test_affine_trials_that_a_sample_rules_out(spark, monkeypatch):
    monkeypatch.setattr(robust, "STREAM", 900)
    rng = np.random.default_rng(5)
    xy = rng.uniform(0, 1000, (3000, 2))
    to = np.column_stack([5 + 2 * xy[:, 0], -3 + 2 * xy[:, 1]]) + rng.normal(0, 2, (3000, 2))
    to[:900] += rng.uniform(50, 900, (900, 2))
    rows = [("a", *map(float, p), *map(float, q)) for p, q in zip(xy, to, strict=True)] + [("b", float(i % 2), float(i // 2), float(i), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "k string, x double, y double, to_x double, to_y double")
    data = robust._identified(df.where("k = 'a'"), ["k"], ["x", "y", "to_x", "to_y"], 0).orderBy("_row").toPandas()
    points, row = data[["x", "y", "to_x", "to_y"]].to_numpy(), data["_row"].to_numpy()
    trial, maps = robust.trial_maps(points[:300], row[:300], 150)
    inliers = [int((np.abs(np.column_stack([np.ones(len(points)), points[:, :2]]) @ m - points[:, 2:]).sum(1) <= 10).sum()) for m in maps]
    best = int(np.argmax(inliers))
    few = robust.still_open(robust._inlier_sums(points[:300], maps, 10.0)[:, 0], 300)
    assert best in few and len(few) < len(maps)
    inside = np.abs(np.column_stack([np.ones(len(points)), points[:, :2]]) @ maps[best] - points[:, 2:]).sum(1) <= 10
    want, *_ = np.linalg.lstsq(np.column_stack([np.ones(inside.sum()), points[inside, :2]]), points[inside, 2:], rcond=None)
    for parts in (1, 5):
        fit = {r.k: r for r in robust.robust_affine(df.repartition(parts), ["k"], trials=150, sample=300).collect()}
        assert fit["a"].n_inliers == inliers[best] and np.allclose(np.stack([fit["a"].of_x, fit["a"].of_y], 1), want)


def test_lines_in_several_streams(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 500, 5000)
    y = 2 * x + rng.normal(0, 40, 5000)
    df = spark.createDataFrame([("p", float(a), float(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y double")
    whole = robust.robust_line(df, "x", "y", ["k"], trials=70).first()
    monkeypatch.setattr(robust, "STREAM", 700)
    assert np.allclose(list(robust.robust_line(df.repartition(6), "x", "y", ["k"], trials=70).first())[1:], list(whole)[1:])


def test_outer_lines_bound_all(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 200):
        slope, intercept = rng.integers(-9, 9, n).astype(float), rng.integers(-9, 9, n).astype(float)
        corners = robust._outer(slope, intercept)
        for x in rng.normal(0, 100, 40):
            every = slope * x + intercept
            some = every[corners]
            assert some.max() == every.max() and some.min() == every.min()


def test_a_large_image_repeated_pixels_and_gaps(spark):
    side = 2000
    px = spark.range(side * side).where("id % 7 <> 3").select(F.lit(1).alias("field"), F.lit("c").alias("channel"), (F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"), (F.col("id") % 1000).cast("double").alias("value"))
    got = tables.image_rows(px, side, side, ["field"]).select(F.size("pixels").alias("n"), F.size(F.array_compact("pixels")).alias("known"), F.element_at("pixels", 2001).alias("a"), F.element_at("pixels", 4).alias("b")).first()
    assert tuple(got) == (side * side, sum(i % 7 != 3 for i in range(side * side)), 0.0, None)
    rows = [(1, "c", 0, 0, 5.0), (1, "c", 0, 0, 9.0), (1, "c", 0, 1, None), (1, "c", 70, 2, 4.0), (1, "c", 70, 2, None), (1, "c", 99, 0, 1.0), (1, "c", 0, 3, 1.0), (1, "c", -1, 0, 1.0)]
    small = tables.image_rows(spark.createDataFrame(rows, "field int, channel string, row int, col int, value double"), 80, 3, ["field"]).first()
    want = [None] * 240
    want[0], want[70 * 3 + 2] = 9.0, 4.0
    assert small.pixels == want and (small.height, small.width) == (80, 3)
    bands = tables.pixel_bands(spark.createDataFrame(rows, "field int, channel string, row int, col int, value double"), 80, 3, ["field"]).collect()
    assert sorted((r.band, len(r.pixels)) for r in bands) == [(0, 96), (2, 48)]


def test_no_rows(spark):
    none = spark.createDataFrame([], "k string, x double, i int")
    assert spread.quantiles(none, ["k"], {"x": [0.5]}).count() == 0 and spread.ranked(none, ["k"], ["x"]).count() == 0
    assert neighbours.nearest(points(spark, []), points(spark, []), ["g"], 2).count() == 0
    assert track.edges(spark.createDataFrame([], NUCLEI)).count() == 0 and track.tracks(spark.createDataFrame([], NUCLEI), [0, 1, 2]).count() == 0
    assert list(itertools.chain(tables.image_rows(spark.createDataFrame([], "field int, channel string, row int, col int, value int"), 4, 4, ["field"]).collect())) == []
