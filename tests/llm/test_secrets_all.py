"""Training on the tokens of all documents, beyond what the driver takes as examples."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenscreen.llm.secrets import CharCNN, Quick, _learned, all_windows, flat, least_loss, pieces, scan, train, window, with_parameters
from lumenscreen.llm.text import slices


def test_all_windows_equal_single_ones():
    texts = ["", "abcdefgh", "x" * 300, "é " + "abc-" * 40 + " é", None, "ab" * 24 + "c"]
    for part in slices(iter([pa.RecordBatch.from_pydict({"doc_id": range(len(texts)), "text": texts})])):
        spans = [(i, int(a) + s, int(b) - t) for i, (a, b) in enumerate(zip(part.start, part.end, strict=True)) for s in range(3) for t in range(3) if b - a > s + t]
        row, start, end = (np.array(c) for c in zip(*spans, strict=True))
        raw = part.data.tobytes()
        want, n = pieces([window(raw, int(part.start[i]), int(part.end[i]), s, e) for i, s, e in spans])
        got, of = all_windows(part, row, start, end)
        assert (got == np.minimum(want, 127)).all() and (of == np.repeat(np.arange(len(spans)), n)).all()


def test_sums_are_loss_and_gradient_of_the_network():
    rng = np.random.default_rng(1)
    x, model = rng.integers(0, 128, (300, 80)).astype(np.uint8), CharCNN(3)
    z = model.logits([r.tobytes() for r in x])
    assert np.allclose(Quick(model).logits(x), z, atol=1e-4)
    for label in (0, 1):
        sums, at = Quick(model).sums(x, label), flat(model)
        assert sums[1] == 300 and np.isclose(sums[0], np.logaddexp(0, (1 - 2 * label) * z).sum(), rtol=1e-4)
        for way in (rng.normal(size=len(at)) for _ in range(3)):
            step = 1e-5 * way
            up, down = (np.logaddexp(0, (1 - 2 * label) * with_parameters(model, at + s).logits([r.tobytes() for r in x])).sum() for s in (step, -step))
            assert np.isclose(sums[2:] @ way, (up - down) / 2e-5, rtol=0.02, atol=0.5)


def test_least_loss_of_a_square():
    scale = np.array([1.0, 3.0, 0.5])
    got = least_loss(lambda x: (float((scale * (x - 1) ** 2).sum()), 2 * scale * (x - 1)), np.zeros(3), 30)
    assert np.allclose(got, 1, atol=1e-3)


def rows(n):
    words = "the and of with reeding thonhare mentation entire".split()
    for i in range(n):
        prose = " ".join(words[(i * 7 + k) % len(words)] for k in range(30))
        yield i, f"{prose} token = {hashlib.sha1(str(i).encode()).hexdigest()[:24]} {prose}" if i % 2 else f"{prose} internationalisation-of-things {prose}"


def test_every_token_is_in_the_fit(spark):
    docs = spark.createDataFrame(list(rows(400)), "doc_id long, text string")
    seen = []
    for part in slices(iter(docs.toArrow().to_batches())):
        for held in (False, True):
            seen += [len(x) for _, x, *_ in _learned(part, np.zeros((1, 80), np.uint8), None, held)]
    words = docs.select(F.explode(F.split("text", "[^A-Za-z0-9+/_=-]+")).alias("word"))
    assert sum(seen) == words.where("length(word) >= 8").count()
    # 60 windows of a label start the training; the network of all tokens finds keys outside of keywords.
    model = train(docs, most=60)
    keys = [window(t, 0, len(t), 12, 40) for t in (b"some prose " + b" " + hashlib.sha1(str(9000 + i).encode()).hexdigest()[:28].encode() + b" and after" for i in range(40))]
    assert (model.score(keys) >= model.threshold).mean() >= 0.9
    # Tokens that the start never meets move the threshold: half of the others look like keys.
    other = spark.createDataFrame([(10_000 + i, f"see {hashlib.sha1(str(7 * i).encode()).hexdigest()[:15].upper()} here") for i in range(3000)], "doc_id long, text string")
    moved = train(docs.union(other), most=60)
    assert (flat(moved) != flat(model)).any() and moved.threshold != model.threshold


def test_candidates_are_judged_by_the_fit_on_all_tokens(spark):
    # Long words with a digit are candidates; the fit on all tokens without them finds most unlike secrets.
    more = [(10_000 + i, f"some prose internationalisation-of-things-{i % 10} and more") for i in range(300)]
    keys = [(20_000 + i, f"some prose {hashlib.sha1(str(9000 + i).encode()).hexdigest()[:28]} and after") for i in range(40)]
    docs = spark.createDataFrame([*rows(400), *more, *keys], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in scan(docs, most=60).collect()}
    assert sum("cnn:" in got[i] for i, _ in keys) >= 36
    assert sum("cnn:" in got[i] for i, _ in more) <= 15
