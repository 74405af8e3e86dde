"""Against a brute-force version that looks at every window."""

import hashlib
import random

import pytest

from lumenscreen.llm.suffix_dedup import deduplicate


def brute(rows, length=50):
    first: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in rows if d is not None]
    for d, t in data:
        for i in range(len(t) - length + 1):
            w = t[i : i + length]
            first[w] = min(first.get(w, d), d)
    out = set()
    for d, t in data:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.add((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "of", "und", "éa", "thon", "re", "ing", "ñ", "that", "with"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice(passages)
            if rng.random() < 0.5:
                a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
                p = p[a:b]
            parts.append(p if rng.random() < 0.6 else " ".join(rng.choice(words) for _ in range(rng.randint(5, 40))))
        rows.append((d * 3 % 121, " ".join(parts)))
    rows += [(500, None), (501, ""), (502, "short"), (503, "a" * 300), (504, "a" * 200), (505, "ab" * 100), (506, "x" * 49), (507, "x" * 50), (508, "y" + "x" * 50)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in deduplicate(docs).collect()}
    assert got == brute(rows)


def test_null_id_empty_table_and_extra_columns(spark):
    text = "the same long passage of many words that stands in several documents at once, again and again"
    docs = spark.createDataFrame([(None, text, 1), (1, text, 2), (2, text, 3)], "doc_id long, text string, starts int")
    got = {r["doc_id"]: r["n_removed"] for r in deduplicate(docs).collect()}
    assert got == {None: 0, 1: 0, 2: len(text)}
    assert deduplicate(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: bytes(r["kept"]).decode() for r in deduplicate(docs, texts_out=True).collect()}
    assert kept == {None: text, 1: text, 2: ""}


@pytest.mark.parametrize("options", [{"hash_bits": 8, "verify_order": True}, {"hash_bits": 5, "bucket_bytes": 2000, "verify_order": True}, {"hot_segments": 1, "bucket_bytes": 3000}, {"split_rows": 1}, {"hash_bits": 6, "hot_segments": 2, "split_rows": 1, "verify_order": True}])
def test_collisions_and_hot_grams_change_nothing(spark, options):
    rows = corpus(3)
    # Documents without a common slice: their segments meet in buckets only.
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    assert {tuple(r) for r in deduplicate(docs, **options).collect()} == brute(rows)


def test_a_gram_in_many_different_surroundings(spark):
    rng = random.Random(9)
    core = "a passage that stands everywhere and has seventy bytes or a few more of them"
    rows = [(d, "".join(rng.choice("abcdefgh") for _ in range(60)) + core + "".join(rng.choice("abcdefgh") for _ in range(60))) for d in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for options in ({}, {"hot_segments": 4}, {"split_rows": 10}):
        got = {tuple(r) for r in deduplicate(docs, **options).collect()}
        assert got == brute(rows) and sum(r[2] for r in got) >= 149 * len(core)


def test_sorting_puts_order_right_after_collisions():
    import numpy as np

    from lumenscreen.llm.suffix_dedup import classes
    from lumenscreen.llm.text import prefix_hashes

    data = np.frombuffer(bytes(random.Random(4).choice(b"ab") for _ in range(400)), np.uint8)
    at = np.arange(0, 360)
    for bits in (64, 2, 0):
        order, same = classes(data, prefix_hashes(data), at, np.zeros(360, np.int64), np.full(360, 9), bits, bits < 64)
        texts = [data[a : a + 9].tobytes() for a in at[order]]
        assert texts == sorted(texts) and same.tolist() == [False, *[x == y for x, y in zip(texts, texts[1:])]]
