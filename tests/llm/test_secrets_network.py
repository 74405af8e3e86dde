"""Keys deep inside long tokens, and labels that are rare in the corpus."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from lumenscreen.llm.language import fold
from lumenscreen.llm.secrets import INSIDE, WIDTH, elsewhere, examples, pieces, scan, train, window


def corpus(findings=200):
    words = "the and of with reeding thonhare mentation entire".split()
    rows = []
    for i in range(2 * findings):
        h = hashlib.sha1(str(i).encode()).hexdigest()
        prose = " ".join(words[(i * 7 + k) % len(words)] for k in range(30))
        rows.append((i, f"{prose} token = {h[:24]} {prose}" if i % 2 else f"{prose} internationalisation-of-things {prose}"))
    return rows


def test_windows_cover_all_of_a_token():
    raw = b"<" + bytes(range(33, 33 + 90)) * 3 + b">"
    for n in (1, 47, 48, 49, 72, 96, 97, 250):
        x, count = pieces([window(raw, 0, len(raw), 1, 1 + n)])
        assert len(x) == count[0] and x.shape[1] == WIDTH
        seen = b"".join(r[16 : 16 + INSIDE].tobytes() for r in x)
        assert set(raw[1 : 1 + n]) <= set(seen) and all(raw[k : k + min(n, 24)] in seen for k in range(1, 2 + n - min(n, 24), 24))


def test_keys_behind_long_paths_are_found(spark):
    path = "internationalisation-of-things/" * 3
    rows = corpus() + [(1000 + i, f"some prose before {path}{hashlib.sha1(str(9000 + i).encode()).hexdigest()[:28]} and after") for i in range(40)]
    got = {r["doc_id"]: r["spans"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum("cnn:" in got[1000 + i] for i in range(40)) >= 30


def distinct(findings):
    return [(i, f"{text} longwordnumber{'abcdefghijklmnopqrstuvwxyz'[i]}") for i, text in corpus(findings)]


def test_rare_findings_are_learned_from(spark):
    # 12 findings in 50,024 documents: a sample of 20,000 documents holds about 5.
    plain = spark.range(10_000, 60_000).selectExpr("id AS doc_id", "'the and of with reeding' AS text")
    rows = spark.createDataFrame(distinct(12), "doc_id long, text string").union(plain)
    model = train(rows)
    assert model is not None and 0 < model.threshold < 1
    assert train(rows.where("doc_id >= 10000")) is None


def test_held_out_findings_without_their_keywords(spark):
    docs = spark.createDataFrame(corpus(400), "doc_id long, text string")
    rest = fold(F.col("doc_id"))
    model = train(docs.where(rest != 0))
    windows, labels, _ = examples(docs.where(rest == 0))
    secret, other = ([w for w, k in zip(windows, labels, strict=True) if k == want and len(w) == WIDTH] for want in (1, 0))
    (x, _), (y, _) = pieces(secret), pieces(other)
    hidden = [r.tobytes() for r in elsewhere(x, y, np.random.default_rng(3))]
    assert len(hidden) > 50 and (model.score(hidden) >= model.threshold).mean() >= 0.9
    assert (model.score(other) >= model.threshold).mean() <= 0.02


def test_any_token_can_be_an_example(spark):
    # A text of many long tokens: each of them is learned from, not the longest ones only.
    text = " ".join(f"{'abcdefghij'[i]}-longword-{'klmnopqrst'[i]}" for i in range(10))
    windows, labels, fewest = examples(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))
    assert len(windows) == 10 and not labels.any() and fewest == 0
