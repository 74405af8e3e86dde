"""Mutual nearest neighbours against loops, by the rules of SQL: nulls come last, and rows of one label share its windows."""

import math

import numpy as np
import pytest

from lumenscreen.operators import match, neighbours

NUCLEI = "k int, label int, x double, y double, intensity double"


def brute(a, b, most=15.0, ratio=0.9):
    """A row for each accepted pair; labels may repeat, as in the windows of the SQL."""
    last = lambda d: (d is None, d is not None and math.isnan(d), d or 0.0)
    out = []
    for k in {r[0] for r in a if r[0] is not None}:
        pairs = []
        for _, p, x, y, i in (r for r in a if r[0] == k):
            for _, q, u, v, j in (r for r in b if r[0] == k):
                d = None if None in (x, y, u, v) else float(np.sqrt((np.float64(x) - u) * (np.float64(x) - u) + (np.float64(y) - v) * (np.float64(y) - v)))
                pairs.append((d, p, q, None if None in (i, j) else abs(i - j)))
        forth, back = {}, {}
        for r in sorted(pairs, key=lambda r: (r[1], last(r[0]), r[2])):
            forth.setdefault(r[1], []).append(r)
        for r in sorted(pairs, key=lambda r: (r[2], last(r[0]), r[1])):
            back.setdefault(r[2], r)
        for found in forth.values():
            d, p, q, i = found[0]
            second = found[1][0] if len(found) > 1 else None
            if back[q] == found[0] and d is not None and d < most and second and d / second < ratio:
                out.append((k, p, q, d, second, i))
    return sorted(out)


def given(spark, rows):
    return spark.createDataFrame(rows, NUCLEI).repartition(3)


@pytest.mark.filterwarnings("ignore:invalid value")
@pytest.mark.parametrize("leaf", [1024, 8])
def test_nulls_far_places_copies_and_repeated_labels(spark, leaf, monkeypatch):
    monkeypatch.setattr(neighbours, "STREAM", 60)
    rng = np.random.default_rng(leaf)
    inf, nan = math.inf, math.nan

    def side(n, start):
        at = np.concatenate([rng.normal(0, 40, (n, 2)), rng.normal(300, 1, (n // 4, 2)), rng.integers(0, 9, (n // 4, 2)) * 30.0])
        return [(0, start + i, float(x), float(y), float(i % 7)) for i, (x, y) in enumerate(at)]

    a, b = side(120, 0), side(90, 1)
    b += [(0, 5000 + i, r[2], r[3], 1.0) for i, r in enumerate(a[:10])] + [(0, 6000 + i, 900.0, 900.0, 2.0) for i in range(40)]
    a += [(0, 7000 + i, 900.0, 901.0, None) for i in range(30)] + [(0, 3, 555.0, 555.0, 4.0), (None, 1, 0.0, 0.0, 1.0)]
    b += [(0, 9000, 556.0, 555.0, 4.0), (0, 9001, None, 0.0, 1.0), (0, 9002, nan, 0.0, 1.0), (0, 9003, inf, 1.0, 1.0), (None, 1, 0.0, 0.0, 1.0)]
    a += [(0, 9100, nan, 1.0, 1.0), (0, 9101, 1.0, None, 1.0), (0, 9102, -inf, 1.0, 1.0)]
    # One place each, and others that are null, not a number or far.
    for k, other in enumerate([[], [(None, 1.0)], [(nan, 1.0)], [(inf, 1.0)], [(None, 1.0), (-inf, 1.0)], [(nan, inf)], [(0.0, 0.0)], [(1000.0, 0.0)]], 1):
        a += [(k, 1, 1.0, 0.0, 2.0), (k, 2, 1.0, 0.0, 9.0)]
        b += [(k, 1, 0.0, 0.0, 5.0), *[(k, 2 + i, x, y, 1.0) for i, (x, y) in enumerate(other)]]
    want = brute(a, b)
    assert len(want) > 30 and {r[0] for r in want} == {0, 4, 5, 8}
    exact = match.mutual_nearest(given(spark, a), given(spark, b), ["k"], bucketed=False, leaf=leaf)
    assert sorted(map(tuple, exact.collect())) == want


def test_a_hundred_million_pairs(spark):
    n = 10_000
    at = np.random.default_rng(5).uniform(0, 60, (n, 2))
    a = [(1, i, float(x), float(y), 1.0) for i, (x, y) in enumerate(at)] + [(1, n + i, 30.0, 30.0, 1.0) for i in range(2000)]
    b = [(1, i, float(x) + 1e-6, float(y), 3.0) for i, (x, y) in enumerate(at)] + [(1, n + i, 30.0, 30.0, 1.0) for i in range(2000)]
    got = match.mutual_nearest(given(spark, a), given(spark, b), ["k"], bucketed=False).collect()
    assert len(got) > n - 10 and all(r.label_40x == r.label_10x and r.intensity_diff == 2 for r in got)
    assert all(abs(r.dist - 1e-6) < 1e-12 < 1e-6 < r.second_dist for r in got)


def test_the_bucketed_form_accepts_the_same_pairs(spark):
    rng = np.random.default_rng(2)
    a = [(0, i, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.uniform(0, 200, (60, 2)))] + [(k, 1, 1.0, 0.0, 1.0) for k in (1, 2, 3)]
    b = [(0, i, float(x), float(y), 2.0) for i, (x, y) in enumerate(rng.uniform(0, 200, (50, 2)))] + [(1, 1, 0.0, 0.0, 1.0), (1, 2, None, 0.0, 1.0), (2, 1, 0.0, 0.0, 1.0), (2, 2, math.nan, 0.0, 1.0), (3, 1, 0.0, 0.0, 1.0), (3, 2, 50.0, 0.0, 1.0)]
    want = [(*r[:4], r[4] if r[4] <= 15.0 / 0.9 else None, r[5]) for r in brute(a, b)]
    assert {r[0] for r in want} == {0, 3} and {r[4] is None for r in want} == {True, False}
    for leaf in (1024, 8):
        assert sorted(map(tuple, match.mutual_nearest(given(spark, a), given(spark, b), ["k"], leaf=leaf).collect()), key=str) == sorted(want, key=str)


def test_nuclei_of_one_place_are_looked_up_once(spark):
    # 3,000 nuclei of each side share a place: nine million pairs, one row each for the leaves.
    a = [(1, i, 5.0, 5.0, 1.0) for i in range(3000)] + [(1, 3000, 80.0, 0.0, 1.0)]
    b = [(1, i, 6.0, 5.0, 1.0) for i in range(3000)] + [(1, 3000, 81.0, 0.0, 1.0)]
    assert match._places(given(spark, a), ["k"]).count() == 2
    got = match.mutual_nearest(given(spark, a), given(spark, b), ["k"]).collect()
    assert [tuple(r) for r in got] == [(1, 3000, 3000, 1.0, None, 0.0)]


def test_statistics_leave_out_pairs_without_a_second_place(spark):
    a = [(1, i, float(100 * i), 0.0, 1.0) for i in range(3)] + [(2, 1, 0.0, 0.0, 1.0), (2, 2, None, 0.0, 1.0), (3, 1, None, None, 1.0)]
    b = [(1, i, 100.0 * i + 1, 0.0, 1.0) for i in range(2)] + [(2, 1, 1.0, 0.0, 1.0), (2, 2, None, 0.0, 1.0)]
    # 20,000 nuclei of each side in one place: 400 million pairs if they were compared.
    a += [(4, i, 5.0, 5.0, 1.0) for i in range(20_000)] + [(4, 20_000, 90.0, 0.0, 1.0)]
    b += [(4, i, 5.0, 6.0, 1.0) for i in range(20_000)] + [(4, 20_000, 91.0, 0.0, 1.0)]
    nuclei = given(spark, a)
    got = match.match_statistics(nuclei, match.mutual_nearest(nuclei, given(spark, b), ["k"]), ["k"])
    assert {r.k: (r.n_matched, round(r.fraction, 9), r.n_duplicated) for r in got.collect()} == {1: (2, round(2 / 3, 9), 0), 2: (0, 0.0, 0), 3: (0, 0.0, 0), 4: (1, round(1 / 20_001, 9), 0)}
