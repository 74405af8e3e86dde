"""Word hashes: words that polynomials modulo a power of two take for each other, and their effect on operators 1 and 10."""

import numpy as np

from lumenscreen.llm import decontamination, near_duplicates, text


def mirrored(n=10):
    """Two words of 2**n letters whose polynomial hashes modulo 2**64 are equal for every odd base."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_hashes_of_words():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in [*range(1, 80), 200, 1000] for _ in range(3)] + [w.encode() for w in mirrored()] + [b"a" * n for n in range(1, 100)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    hashes = text.word_hashes(data, start, start + size)
    assert len(set(hashes.tolist())) == len(set(words))
    again = text.word_hashes(data[2:], start[1:] - 2, (start + size)[1:] - 2)
    assert (again == hashes[1:]).all() and (text.word_hashes(data, start, start + size, 1) != hashes).all()
    same = text.same_bytes(data, start, data, np.roll(start, 1), np.minimum(size, np.roll(size, 1)))
    assert same.tolist() == [a[: min(len(a), len(b))] == b[: min(len(a), len(b))] for a, b in zip(words, [words[-1], *words[:-1]], strict=True)]


def test_mirrored_words_neither_link_nor_contaminate(spark):
    a, b = mirrored()
    docs = spark.createDataFrame([(1, f"{a} one two"), (2, f"{b} one two"), (3, f"{a} ONE two")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in near_duplicates.near_duplicates(docs, percent=85, words=3).collect()} == {1: True, 2: True, 3: False}
    items = spark.createDataFrame([(7, f"{a} one"), (8, b)], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.report(docs, items).collect()}
    assert got == {1: (2, 1), 2: (1, 1), 3: (2, 1)}


def test_colliding_words_of_a_benchmark(spark, monkeypatch):
    real = text.word_hashes
    weak = lambda data, start, end, salt=0: real(data, start, end, salt) % np.uint64(997)
    monkeypatch.setattr(decontamination, "word_hashes", weak)
    words = [f"w{i}" for i in range(24)]
    windows = decontamination.Windows([("1", " ".join(words))], 13)
    asked = [*words, *(f"x{i}" for i in range(5000))]
    data = np.frombuffer(" ".join(asked).encode(), np.uint8)
    size = np.array([len(w) for w in asked])
    start = np.cumsum(size + 1) - size - 1
    known = windows.known(data, start, start + size)
    assert sorted(known[:24].tolist()) == list(range(1, 25)) and not known[24:].any()


def test_many_blocks_need_one_python_node_a_pass(spark):
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} and a{i + 1} b{i + 1}") for i in range(60)] + [(90, None), (91, "")], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"a{i} b{i} c{i}") for i in range(0, 60, 3)], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.report(docs, items).collect()))
    cut = decontamination.report(docs, items, block_bytes=12, blocks_at_once=3)
    assert sorted(map(tuple, cut.collect())) == whole and sum(r[2] for r in whole) == 60
    assert cut._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_columns_of_any_name(spark):
    from lumenscreen.llm import language

    rows = [(i, "the cat and the dog with this" if i % 2 else "le chat et la chienne avec des", "en" if i % 2 else "fr", i, i, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a b` int, `a.b` int, `x-y` int")
    assert language.reject_documents(docs).columns == docs.columns and language.reject_documents(docs).count() == 60
    kept = near_duplicates.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]
