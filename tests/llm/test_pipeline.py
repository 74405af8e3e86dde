"""Stages of the pipeline on small tables with nulls, empty and long texts, repeated rows and clashing columns."""

import itertools
import random
import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

WORDS = [f"{a}{b}" for a in ("re", "tho", "men", "inter", "sal", "vor", "quin", "bel") for b in ("ding", "ware", "tation", "net", "ly", "mund", "sel", "dar")]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id int, _drop string, _text string, shard int, position int, words int, draw int, kept int, score int, spans string"
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en" if t else None, ("a", "b", None)[k % 3], len(t or ""), 1, "d", "t", 2, 3, 4, 5, 6, 7, "s") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def table(spark, texts):
    return spark.createDataFrame(rows_of(texts), COLUMNS)


def texts(seed=1):
    rng = random.Random(seed)
    out = [(i, prose(rng, 60)) for i in range(40)]
    out += [(100, None), (101, ""), (102, "12 34"), (103, prose(rng, 30_000)), (7, out[7][1]), (None, prose(rng, 40))]
    return out


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stages_keep_columns_and_take_empty_tables(spark, folder, name, stage):
    docs = table(spark, texts())
    got, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
    if name == pipeline.STAGES[-1][0]:
        assert got.columns == [*docs.columns, "_shard", "_draw", "_words", "_position"]
    else:
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert none.count() == 0 and got.where("_id = 1 AND _drop = 'd' AND _text = 't' AND spans = 's'").count() == got.count() > 0


def test_language_stage_rejects_texts_without_letters_only(spark, folder):
    kept = pipeline.language_id(spark, table(spark, texts()), folder).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((i for i, t in texts() if t and re.search("[a-z]", t)), key=str)


def test_line_stage_against_brute_force(spark, folder):
    rng = random.Random(2)
    own = {i: [prose(rng, 6 + i % 5) for _ in range(4)] for i in range(20)}
    for i in range(12):
        own[i].insert(i % 3, "this very line stands in many documents")
    for i in range(7):
        own[i].append("and this one in seven only")
    docs = table(spark, [(i, "\n".join(t)) for i, t in own.items()])
    want = {i: "\n".join(x for x in t if i == 0 or not x.startswith("this very")) for i, t in own.items()}
    got = {r.doc_id: (r.text, r.n_chars) for r in pipeline.line_dedup(spark, docs, folder).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_near_duplicate_stage_against_all_pairs(spark, folder):
    rng = random.Random(3)
    rows = []
    for _ in range(6):
        base = [rng.choice(WORDS) for _ in range(120)]
        for k in range(4):
            t = list(base)
            for at in rng.sample(range(120), k):
                t[at] = f"x{rng.random()}"
            rows.append((len(rows) * 7 % 101, " ".join(t)))
    rows += [(200, None), (201, ""), (202, "two words"), (203, "two words")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in rows if (w := (t or "").split())}
    root = {i: i for i, _ in rows}
    for _ in rows:
        for a, b in itertools.combinations(sets, 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    kept = pipeline.near_dedup(spark, table(spark, rows), folder).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, r in root.items() if i == r)


def test_decontamination_stage_against_brute_force(spark, folder):
    rng = random.Random(4)
    item = ITEM.split()
    rows = [(1, f"{prose(rng, 50)} {' '.join(item[1:14]).upper()}, {prose(rng, 50)}"), (2, f"{prose(rng, 50)} {' '.join(item[:12])} {prose(rng, 50)}"), (3, f"{prose(rng, 400)} {ITEM}"), (4, None), (5, ""), (None, ITEM)]

    def contaminated(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        hit = {k + j for k in range(len(words) - 12) for j in range(13) if words[k : k + 13] in [item[a : a + 13] for a in range(3)]}
        return hit and 20 * len(hit) >= len(words)

    kept = pipeline.decontaminate(spark, table(spark, rows), folder).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted((i for i, t in rows if not contaminated(t)), key=str)


def test_the_whole_run(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, prose(rng, 50)) for i in range(30)]
    rows += [(50, rows[3][1]), (51, rows[4][1]), (52, ITEM), (53, "1 2 3"), (54, None)]
    spark.createDataFrame(rows_of(rows), COLUMNS).drop("_id", "_drop", "_text", "shard", "position", "words", "draw", "kept", "score", "spans").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} <= set(range(30))
    # 30 documents of 50 words: one and a half times all words, cut at each of three targets; no document over twice.
    assert 2248 <= got.selectExpr("sum(words)").first()[0] <= 2250 and got.groupBy("doc_id").count().where("count > 2").count() == 0
