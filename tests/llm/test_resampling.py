"""Operator 12 against counts in a dictionary, and its bit planes against plain sums."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lumenscreen.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)


def plain(docs, target, buckets, longest, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for _, x in side for f in features(x, longest)[0]) for side in (docs, target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    out = []
    for i, text in docs:
        own, n = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in own)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: len(able) * percent // 100], 1)}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=str)


def check(spark, docs, target, buckets=10_000, longest=1, percent=10, least=20):
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, rank int").repartition(3)
    b = spark.createDataFrame(target, "item_id long, text string")
    got = resampling.resample(d, b, buckets=buckets, longest=longest, percent=percent, least_words=least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, buckets, longest, percent, least)


def words(rng, n):
    return " ".join(f"w{k}" for k in rng.zipf(1.3, n) % 500)


def test_weights_scores_and_ranks(spark):
    rng = np.random.default_rng(4)
    docs = [(i, words(rng, int(rng.integers(0, 60)))) for i in range(150)]
    docs += [(900, None), (901, ""), (902, "...!"), (903, "Ünï ÀB x1y " * 30), (904, "hot " * 70_000 + "ÉCOLE a" * 3)]
    target = [(1, words(rng, 400)), (2, None), (2, ""), (None, "hot Hot x1y")]
    check(spark, docs, target)
    check(spark, docs, target, buckets=70, percent=50, least=5)
    check(spark, docs[:60], target, buckets=64, longest=3, percent=100, least=1)


def test_empty_sides_ties_and_repeated_rows(spark):
    check(spark, [(i, "one two three") for i in range(30)], [(1, None)], least=2)
    check(spark, [(5, "same words here")] * 9 + [(None, "other words")] * 3, [(1, "words")], least=1, percent=60)
    got = resampling.resample(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string"))
    assert got.count() == 0


def test_planes_and_signed_gains(spark):
    rng = np.random.default_rng(5)
    for buckets in (1, 63, 64, 65, 1000):
        counts = rng.integers(0, 40, (7, buckets)) * (rng.random((7, buckets)) < 0.3)
        gain = rng.integers(-3000, 3000, buckets)
        bits = 13
        masks = resampling.planes_of(gain, bits)
        for c in counts:
            planes = resampling.planes_of(c, int(c.max()).bit_length())
            value = sum((-1 if q == bits - 1 else 1) * 2 ** (p + q) * int(np.bitwise_count(x & masks[q]).sum()) for p, x in enumerate(planes) for q in range(bits))
            assert value == int((c * gain).sum())


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 7)
    text = b"ab cd efghijklmnop q,rs " * 5 + "é".encode() * 9
    assert [w for some in resampling.words(text) for w in some] == resampling._WORD.findall(text)
    for n in (1, 2, 3):
        w = resampling._WORD.findall(text)
        assert resampling.bucket_counts(text, 50, n).sum() == sum(max(0, len(w) - k) for k in range(n))


def test_ranks_over_many_ranges(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 7).alias("score"))
    got = resampling.numbered(rows, 1000, [F.col("score").desc(), F.col("id").asc()], "rank", 11).collect()
    want = {i: k for k, (_, i) in enumerate(sorted((-(i % 7), i) for i in range(3000))[:1000], 1)}
    assert {r.id: r["rank"] for r in got} == {i: want.get(i) for i in range(3000)} and len(got) == 3000
