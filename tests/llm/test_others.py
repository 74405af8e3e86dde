"""Small fixtures with nulls, empty texts, ties, repeated rows, extra columns; brute force where SQL doesn't reach."""

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lumenscreen.llm import ann, decontamination, language, licenses, line_templates, mixing, near_duplicates, warc
from lumenscreen.llm.language import viterbi
from lumenscreen.llm.text import slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 7) for i, t, lang, s in rows], DOCS)


def test_viterbi_matches_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(3):
        bounds = np.append(0, np.cumsum(rng.integers(1, 8, 4)))
        s = rng.normal(size=(bounds[-1], 3))
        got = viterbi(s, bounds, 0.7)
        for a, b in itertools.pairwise(bounds):
            value = lambda p, a=a, b=b: sum(s[a + j, p[j]] for j in range(b - a)) - 0.7 * sum(p[j] != p[j - 1] for j in range(1, b - a))
            assert abs(value(got[a:b]) - max(map(value, itertools.product(range(3), repeat=b - a)))) < 1e-9


def test_language(spark):
    rows = [(i, "the cat and the dog with this" if i % 2 else "le chat et la chienne avec des", "en" if i % 2 else "fr", "s") for i in range(200)]
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, "123 ½", "en", "s"), (903, "the dog and this cat le chat avec la chienne des", None, "s")]
    got = {r.doc_id: r for r in language.held_out_predictions(docs(spark, rows)).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "fr") for i in range(200))
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].score < 1
    assert got[900].spans == "" and got[903].spans == "0:20:en,21:48:fr"
    assert language.held_out_predictions(docs(spark, []).limit(0)).count() == 0


def test_language_of_many_labels_long_texts_and_marks(spark):
    # 300 languages, each with words of its own; the text of the last one is long.
    word = lambda i, k: f"{'abcdefghijklmnopqrst'[i % 20]}{'abcdefghijklmnopqrst'[i // 20]}{'vwxyz'[k]}"
    rows = [(1000 * k + i, " ".join(word(i, (k + j) % 5) for j in range(12)), f"l{i:03d}", "s") for i in range(300) for k in range(3)]
    d = docs(spark, rows)
    model = language.train(d, 10_000, switch=3.0)
    asked = docs(spark, [(i, " ".join(word(i, j % 5) for j in range(10 if i < 299 else 30_000)), None, None) for i in (0, 17, 255, 256, 280, 299)])
    got = {r.doc_id: r.lang_pred for r in language.predict(asked.select("doc_id", "text"), F.col("text"), model).select("doc_id", "lang_pred").collect()}
    assert got == {i: f"l{i:03d}" for i in got} and len(got) == 6
    marked = language.Words(next(slices(iter([pa.RecordBatch.from_pydict({"text": ["naïve cafe\u0301 ÀB ½ \u0301 x1y", None, "z"]})]))))
    assert [(int(a), int(b), int(c)) for a, b, c in zip(marked.doc, marked.start, marked.end)] == [(0, 0, 5), (0, 6, 11), (0, 12, 14), (0, 19, 20), (0, 21, 22), (2, 0, 1)]


def test_rejected_documents(spark):
    d = docs(spark, [(i, "the cat and the dog with this", "en", "s") for i in range(30)] + [(90, "12 34", "en", "s"), (91, None, "en", "s"), (92, "", None, None)])
    kept = language.reject_documents(d.withColumn("score", F.lit(1)).withColumn("lang_pred", F.lit("x")))
    assert kept.columns == [*d.columns, "score", "lang_pred"] and sorted(r.doc_id for r in kept.collect()) == list(range(30))


def test_mixing_targets_and_draws(spark):
    rows = [(i, "w " * (i % 13 + 1), "en", ["a", "b", None][i % 3] if i % 4 else "a") for i in range(300)] + [(None, None, "en", "a"), (5, "w", "en", "z")]
    d = docs(spark, rows)
    got = mixing.taken_words(d, block_docs=16).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r.target, []).append(r.taken)
    assert all(abs(sum(t) - target) <= 1 for target, t in by.items())
    drawn = mixing.mix(d, block_docs=16, shards=4)
    assert drawn.agg(F.sum("words")).first()[0] == sum(r.taken for r in got)
    assert sorted(c for c in drawn.columns if c != "size") == sorted(["doc_id", "text", "lang", "source", "n_chars", "shard", "draw", "words", "position"])
    assert drawn.where("words <> size(filter(split(text, ' '), x -> x <> ''))").count() == 0
    assert mixing.taken_words(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0
    # A shard is one partition in the order of its positions, and the whole mix is what the plan says.
    placed = drawn.select(F.spark_partition_id().alias("p"), "shard", "position").collect()
    assert len({r.shard for r in placed}) == 4 == len({(r.p, r.shard) for r in placed})
    assert all(a.position <= b.position for a, b in itertools.pairwise(placed) if (a.p, a.shard) == (b.p, b.shard))
    want = sum(len([x for x in r.draws.split(",") if x]) for r in mixing.taken_words(d, block_docs=16, shards=4).collect())
    assert len(placed) == want
    clash = d.selectExpr("*", "1 AS shard", "2 AS position", "3 AS block", "4 AS words", "5 AS _row")
    assert mixing.mix(clash, block_docs=16, shards=4).columns == [*clash.columns, "_shard", "draw", "_words", "_position"]


def test_split_quotas_is_exact_and_hypergeometric(spark):
    q = spark.createDataFrame([("a", 40), ("b", 24), (None, 0)], "source string, quota long")
    halves = []
    for seed in range(40):
        rows = mixing.split_quotas(q, 2, seed).collect()
        assert sum(r.quota for r in rows if r.source == "a") == 40 and sum(r.quota for r in rows if r.shard == 0) == 32
        halves.append(next(r.quota for r in rows if r.source == "a" and r.shard == 0))
    assert abs(np.mean(halves) - 20) < 1.5 and 1 < np.std(halves) < 3


def test_decontamination_blocks_agree_and_edge_cases(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, ""), (1, item)], "item_id long, text string")
    d = docs(spark, [(1, f"x {item.upper()} y", "en", "s"), (2, "a short, ITEM here", "en", "s"), (3, None, "en", "s"), (4, "", "en", "s"), (5, "five six seven", "en", "s"), (None, item, "en", "s")])
    one = {r.doc_id: tuple(r) for r in decontamination.report(d, bench).collect()}
    many = {r.doc_id: tuple(r) for r in decontamination.report(d, bench, block_bytes=20).collect()}
    assert one == many
    assert one[1][1:4] == (16, 14, 1) and one[2][2] == 2 and one[3][1:4] == (0, 0, 0) and one[None][-1] is True
    assert sorted(r.doc_id for r in decontamination.remove_contaminated(d, bench).collect()) == [3, 4, 5]


def test_near_duplicates_chain_and_edges(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(10, " ".join(base)), (3, " ".join(base[:-1] + ["z"])), (7, " ".join(["q", *base[1:-1], "z"])), (4, None), (5, ""), (6, "one two"), (8, "one two"), (9, "ONE  two"), (11, " ".join(base[::-1]))]
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows]), percent=85, words=3).collect()}
    assert {i: got[i].component_id for i in got} == {10: 3, 3: 3, 7: 3, 4: 4, 5: 5, 6: 6, 8: 6, 9: 6, 11: 11}
    assert got[4].n_shingles == 0 and got[6].n_shingles == 1 and got[10].n_shingles == 58


def test_near_duplicates_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(12):
        base = [f"f{f}w{k}" for k in range(80)]
        for _ in range(8):
            t = list(base)
            for k in rng.choice(80, rng.integers(0, 5), replace=False):
                t[k] = f"r{rng.integers(1e6)}"
            rows.append((len(rows), " ".join(t)))
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            c = len(sets[i] & sets[j])
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                root[i] = root[j] = min(root[i], root[j])
    got = near_duplicates.near_duplicates(docs(spark, [(i, t, "en", "s") for i, t in rows]), percent=85, words=3).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 16)) + 3 * rng.normal(size=(10, 16))[rng.integers(0, 10, 1500)]
    x[100:110] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [None] + [1.0] * 15)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(j)) for q in range(0, 1500, 50) for j in np.lexsort((np.arange(1500), -np.where(np.arange(1500) == q, -9, np.round(u @ u[q], 12))))[:5]}
    assert len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100] == [101, 102, 103, 104, 105]


def test_warc_round_trip_of_chunks(spark, tmp_path):
    big = "é" * 5000
    pages = spark.createDataFrame([(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "small"), (6, "u", "small"), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 100)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder, chunk=1000)
    chunks = warc.read_archives(spark, folder, chunk=777).collect()
    text = {p: b"".join(bytes(c.data) for c in sorted((c for c in chunks if c.page_id == p), key=lambda c: c.chunk)).decode() for p in range(1, 8)}
    assert text == {1: "", 2: big, 3: "", 4: "", 5: "small", 6: "small", 7: "a\r\n\r\nWARC/1.1\r\n" * 100}
    assert {c.page_id: c.refers_to for c in chunks if c.record_type == "revisit"} == {1: 2}
    assert max(len(c.data) for c in chunks) <= 777


def test_lines_and_licenses(spark):
    rows = [(i, f"own line number {'abcdefghijklmnop'[i]} here\nVisited by user{i} on page {i}\nother words {'abcdefghijklmnop'[-i]} there", "en", "s") for i in range(16)] + [(50, None, "en", "s"), (51, "", "en", "s")]
    got = {r.doc_id: r for r in line_templates.report(docs(spark, rows)).collect()}
    assert [got[i].n_dropped for i in range(16)] == [0] + [1] * 15 and got[50].n_lines == 0 and got[51].n_dropped == 0
    copies = docs(spark, [(i, "same text\nof a copied document\nin full", "en", "s") for i in range(20)])
    assert line_templates.drop_lines(copies).where("text = 'same text\nof a copied document\nin full'").count() == 20
    text = "Hello there. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\nAll rights reserved. Released under the MIT License."
    found = licenses.scan(docs(spark, [(1, text, "en", "s"), (2, None, "en", "s"), (3, "the license plate", "en", "s")])).collect()
    assert {r.doc_id: r.licenses for r in found} == {1: "Apache-2.0,MIT,all-rights-reserved", 2: "", 3: ""}
    spans = [re.split(":", s) for s in next(r.spans for r in found if r.doc_id == 1).split(",")]
    assert text[int(spans[0][1]) : int(spans[0][2])].strip().startswith("Licensed under the Apache")


def test_ann_exact_mode_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(400, 6)), 3)
    ids = np.arange(400)
    ids[300:310] = 50  # ten more rows with the id of a query
    x[300] = x[50]  # and one of them its twin
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, exact=True).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = []
    for q in np.flatnonzero(ids % 50 == 0):
        others = np.delete(np.arange(400), q)
        near = others[np.lexsort((ids[others], -np.round(u[others] @ u[q], 12)))][:5]
        want += [(int(ids[q]), k + 1, int(ids[j])) for k, j in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == sorted(want)
    assert ann.search(df.limit(0), F.lit(True)).count() == 0 and ann.search(df.limit(1), F.lit(True)).count() == 0


def test_windows_of_a_large_benchmark_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5000)])
    items = [(str(i), " ".join(words[rng.integers(0, 5000, 400)])) for i in range(2000)]
    tracemalloc.start()
    windows = decontamination.Windows(items, 13)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    patterns, owners, _ = windows.by_length[13]
    assert len(patterns) == 2000 * 388 == owners[-1] and peak < 100 * sum(len(t) for _, t in items)
