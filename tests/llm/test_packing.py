"""Operator 13: ids against the tokenizer on whole texts, the curve against its definition, packing against its rules."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenscreen.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start int, pieces string"


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(PATH)
    out.encode_special_tokens = True
    return lambda text: out.encode(text or "", add_special_tokens=False).ids


def encoded(text):
    e = packing.Encoder(open(PATH, encoding="utf-8").read())
    return np.frombuffer(e(text), e.kind).tolist()


def test_pieces_give_the_ids_of_whole_texts(whole, monkeypatch):
    draw = random.Random(3)
    alphabet = ["a", "B", "é", "漢", " ", "  ", "\n", "\t", " ", " ", "　", "\x1c", "\x85", "'s", "12", "½", "!", "...", "́", "<|endoftext|>", "\r\n", "🙂"]
    for stretch in (5, 500_000):
        monkeypatch.setattr(packing, "STRETCH", stretch)
        for _ in range(400):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(0, 40)))
            assert encoded(text) == whole(text), repr(text)


def test_other_definitions_and_changed_ones_go_through_tokenizers():
    import json

    from tokenizers import Tokenizer

    lower = public_tokenizers.path("word_bpe_49k.json")
    given = open(lower, encoding="utf-8").read()
    slow = Tokenizer.from_str(given)
    slow.encode_special_tokens = True
    e = packing.Encoder(given)
    text = "Some Words, and <|endoftext|> 12 more\n" * 9
    assert not e.cut and np.frombuffer(e(text), e.kind).tolist() == slow.encode(text, add_special_tokens=False).ids
    bytewise = json.loads(open(PATH, encoding="utf-8").read())
    assert packing._ranks(bytewise)
    assert packing._ranks(bytewise | {"normalizer": {"type": "Lowercase"}}) is None
    assert packing._ranks(bytewise | {"model": bytewise["model"] | {"merges": bytewise["model"]["merges"][::-1]}}) is None


@pytest.mark.parametrize("text", ["x" * 200_000, " " * 100_000 + "a", "\n" * 50_000, "ab " * 60_000 + " " * 9, "é" * 50_000])
def test_long_runs(whole, monkeypatch, text):
    monkeypatch.setattr(packing, "STRETCH", 20_000)
    assert encoded(text) == whole(text)


@pytest.mark.parametrize(("dims", "bits"), [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = packing.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def packed(spark, rows, **options):
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return packing.pack(d, PATH, **options).cache()


def check(rows, sequences, whole, length=1024):
    """Every id of every document lies in one piece, pieces fill sequences, sequences have allowed sizes."""
    found = {}
    for s in sequences:
        ids = np.frombuffer(s.ids, "<u2").tolist()
        assert len(ids) == length or (len(ids) < length and len(ids).bit_count() == 1)
        at = 0
        for p in s.pieces:
            own = ids[p.offset : p.offset + p.length]
            assert p.offset == at and p.length > 0 and p.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
            found.setdefault(p.doc_id, []).append((p.start, own, p.doc_tokens))
            at += p.length
        assert at == len(ids)
    assert len({s.sequence_id for s in sequences}) == len(sequences)
    want = {}
    for i, text in rows:
        want.setdefault(i, []).append([*whole(text), 0])
    assert set(found) == set(want)
    for i, texts in want.items():
        assert sum(len(t) for t in texts) == sum(len(own) for _, own, _ in found[i])
        if len(texts) == 1:
            assert [x for _, own, _ in sorted(found[i]) for x in own] == texts[0] and {n for *_, n in found[i]} == {len(texts[0])}
        assert sorted(x for t in texts for x in t) == sorted(x for _, own, _ in found[i] for x in own)


def test_packing(spark, whole):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choice(["alpha", "beta", "Gamma,", "ü", "12"]) for _ in range(draw.randrange(0, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long text " * 20_000), (103, "<|endoftext|> x"), (104, "same"), (104, "same"), (None, "none"), (None, None)]
    rows += [(200 + i, "a copy of one and the same text") for i in range(300)]
    for options in ({}, {"row_ids": 100}, {"length": 64, "bits": 3}):
        check(rows, packed(spark, rows, **options).collect(), whole, options.get("length", 1024))


def test_copies_go_to_several_partitions(spark):
    rows = [(i, "the same words again and again in every copy") for i in range(2000)] + [(5000 + i, f"other {i}") for i in range(20)]
    first = packed(spark, rows).collect()
    assert len({s.sequence_id >> 36 for s in first if any(p.doc_id < 5000 for p in s.pieces)}) > 1


def test_neighbours_share_topics(spark):
    draw = random.Random(8)
    topics = [[f"{t}{k}" for k in "abcdefghijklmnop"] for t in ("red", "green", "blue", "grey", "pink", "black")]
    rows = [(i, " ".join(draw.choice(topics[i % 6]) for _ in range(120))) for i in range(240)]
    same = total = 0
    for s in packed(spark, rows).collect():
        for a, b in itertools.pairwise(p.doc_id for p in s.pieces):
            same, total = same + (a % 6 == b % 6), total + 1
    assert total > 100 and same > 0.6 * total  # one in six by chance


def test_empty_table(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert packing.pack(d, PATH).count() == 0
    assert packing.pieces(d, PATH).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packing.pieces(spark.createDataFrame([(1, None, 1, "x")], SCHEMA), PATH).select(F.sum("length")).first()[0] == 1
