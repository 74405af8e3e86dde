"""Pairs registered from stored transforms against images given in pairs."""

import numpy as np

from lumenscreen.operators import regions, registration

IMAGES = "plate string, field int, height int, width int, pixels array<double>"


def test_an_image_is_transformed_once_and_results_are_those_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(registration, "STREAM", 3)
    rng = np.random.default_rng(3)
    big = rng.integers(0, 100, (40, 40)).astype(float)
    shapes = [(4, 5, 16, 12), (6, 2, 12, 12), (0, 9, 20, 11), (10, 10, 12, 16), (3, 3, 16, 16)]
    images = {}
    for f, (r, c, h, w) in enumerate(shapes):
        images[f] = big[r : r + h, c : c + w].copy()
        images[f][rng.random((h, w)) < 0.05] = np.nan
    flat = lambda x: [None if np.isnan(v) else float(v) for v in x.ravel()]
    rows = [("p", f, *x.shape, flat(x)) for f, x in images.items()] + [("p", 7, 3, 3, None), ("p", 8, 2, 2, [None] * 4), ("p", 9, 0, 0, [])]
    transforms = registration.image_transforms(spark.createDataFrame(rows, IMAGES), ["plate", "field"])
    assert transforms.count() == len(rows)
    ids = [r[1] for r in rows] + [99]
    pairs = spark.createDataFrame([("p", a, b) for a in ids for b in ids], "plate string, a int, b int")
    got = {(r.a, r.b): (r.cc, r.shift_row, r.shift_col) for r in registration.registered(transforms, pairs, ["plate", "field"], ["plate", "a"], ["plate", "b"]).collect()}
    schema = "a int, b int, source array<double>, source_height int, source_width int, target array<double>, target_height int, target_width int"
    known = {r[1]: r for r in rows}
    both = [(a, b, known[a][4], *known[a][2:4], known[b][4], *known[b][2:4]) for a in known for b in known]
    want = {(r.a, r.b): (r.cc, r.shift_row, r.shift_col) for r in regions.registration_scores(spark.createDataFrame(both, schema), ["a", "b"]).collect()}
    assert len(got) == len(ids) ** 2
    for pair, values in got.items():
        if want.get(pair, (None,))[0] is None:
            assert values == (None, None, None)
        else:
            assert np.allclose(values, want[pair], atol=1e-8)
    assert got[0, 0][0] > 0.99 and abs(got[0, 4][1] - got[4, 0][1]) > 0
    assert registration.registered(transforms, pairs.limit(0), ["plate", "field"], ["plate", "a"], ["plate", "b"]).count() == 0
