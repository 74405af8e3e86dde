"""What registration stores, and how often it transforms an image."""

import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa

from lumenscreen.operators import regions, registration

IMAGES = "plate string, field int, height int, width int, pixels array<double>"


def test_images_are_stored_and_no_transforms(spark, monkeypatch):
    monkeypatch.setattr(registration, "STREAM", 8)
    rng = np.random.default_rng(7)
    big = rng.integers(0, 60_000, (120, 40)).astype(float)
    images = {f: big[f : f + 40].ravel().tolist() for f in range(70)}
    transforms = registration.image_transforms(spark.createDataFrame([("p", f, 40, 40, x) for f, x in images.items()], IMAGES), ["plate", "field"])
    # 12,800 bytes of pixels an image; its padded transforms have 399,360.
    assert sum(os.path.getsize(urlparse(f).path) for f in transforms.inputFiles()) < 20_000 * len(images)
    pairs = [("p", f, f + 1, "near") for f in range(-1, 70)] + [("p", f, 69 - f, "far") for f in range(70)] + [("p", None, 3, "none"), (None, 1, 2, "none"), ("p", 5, 6, "near")]
    schema = "plate string, field int, target int, kind string"
    got = registration.registered(transforms, spark.createDataFrame(pairs, schema).repartition(3), ["plate", "field"], ["plate", "field"], ["plate", "target"]).collect()
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, pairs))
    for r in got:
        if r.plate is None or r.field not in images or r.target not in images:
            assert tuple(r)[4:] == (None, None, None)
        elif abs(r.field - r.target) < 20:
            # The target lies so many rows below the source, the middle of both is half their heights away.
            assert r.cc > 0.999 and (r.shift_row, r.shift_col) == (r.target - r.field, 0.0)
    some = [p for p in pairs if p[0] and p[1] in images and p[2] in images][::9]
    both = spark.createDataFrame([(a, b, images[a], 40, 40, images[b], 40, 40) for _, a, b, _ in some], "a int, b int, source array<double>, source_height int, source_width int, target array<double>, target_height int, target_width int")
    mine = {(r.field, r.target): tuple(r)[4:] for r in got}
    for r in regions.registration_scores(both, ["a", "b"]).collect():
        assert np.allclose(tuple(r)[2:], mine[r.a, r.b], atol=1e-8)


def test_a_stream_transforms_an_image_once(monkeypatch):
    made = []
    monkeypatch.setattr(registration, "transform", lambda image, fast, f=registration.transform: (made.append(1), f(image, fast))[1])
    rng = np.random.default_rng(1)
    first = pa.table({"_i": [1, 2, 3, 4], "_height": [6] * 4, "_width": [5] * 4, "_fast": [[16, 16]] * 4, "_pixels": [*(rng.random(30).tolist() for _ in range(3)), [None] * 30]}, pa.schema({"_i": pa.int64(), "_height": pa.int32(), "_width": pa.int32(), "_fast": pa.list_(pa.int32()), "_pixels": pa.list_(pa.float64())}))
    step = registration._pair_scores(["n"], 0.3)(first)
    pairs = [(a, b) for a in range(1, 5) for b in range(1, 5)]
    batches = [pa.RecordBatch.from_pydict({"n": list(range(len(p))), "_s": [x for x, _ in p], "_t": [x for _, x in p]}) for p in (pairs[:7], pairs[7:])]
    found = [r for b in batches for out in step.rows(b) for r in out.to_pylist()]
    assert len(made) == 3 and len(found) == 16
    assert all((r["cc"] is None) == (4 in p) for r, p in zip(found, pairs, strict=True)) and found[0]["cc"] > 0.999
