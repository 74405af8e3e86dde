"""Operator 11 against a plain search of all entries, and its cells against their definition."""

import hashlib

import numpy as np
import pytest

from lumenscreen.llm import vector_codes
from lumenscreen.llm.vector_codes import Cells, edges

SCHEMA = "vec_id long, embedding array<double>, label string, code int, v int"


def plain(rows, scale=4096, parts=8, entries=16, rounds=6):
    """Rows of (vec_id, embedding, label) -> (vec_id, code, error, label_error, digest), in Python integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in e], l) for i, e, l in rows if e and all(x is not None and np.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = edges(len(kept[0][1]), parts)
    books = [[r[1][a:b] for r in kept[:entries]] for a, b in cut]
    nearest = lambda x, book: min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for (a, b), book in zip(cut, books, strict=True):
            owner = [nearest(r[1][a:b], book)[1] for r in kept]
            for k in set(owner):
                own = [r[1][a:b] for r, o in zip(kept, owner, strict=True) if o == k]
                book[k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out, by_label = [], {}
    for i, x, label in kept:
        got = [nearest(x[a:b], book) for (a, b), book in zip(cut, books, strict=True)]
        out.append((i, "".join(f"{k:02x}" for _, k in got), sum(d for d, _ in got), label))
        by_label[label] = by_label.get(label, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, c, e if e < 1 << 63 else None, by_label[l] if by_label[l] < 1 << 63 else None, digest) for i, c, e, l in out]


def both(spark, rows, **options):
    got = vector_codes.report(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3), **options)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(rows, **options), key=key)


def test_codes_equal_a_full_search(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.1, (4, 64))
    rows = [(i, (centres[i % 4] + rng.normal(0, 0.05, 64)).tolist(), "hot" if i % 3 else None) for i in range(120)]
    rows += [(500, None, "x"), (501, [], "x"), (502, [float("nan")] * 64, "x"), (503, [float("inf")] + [0.0] * 63, "x"), (504, [None] + [0.0] * 63, "x")]
    both(spark, rows)


def test_ties_repeated_rows_null_ids_and_few_vectors(spark):
    rows = [(i // 2, [float(i % 2), 0.0, 1.0], "a") for i in range(8)] + [(None, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], "")]
    both(spark, rows)
    both(spark, [(1, [0.25] * 16, None)])
    both(spark, [(i, [x] * 8, "s") for i, x in enumerate([0.1, 0.1, -0.1, 0.3])], entries=2, parts=2, rounds=3)


def test_large_components_use_exact_integers(spark):
    both(spark, [(i, [1e9 * (i - 9), 0.001 * i, 3.0, -1e12][:4], "big" if i < 15 else "other") for i in range(20)], parts=2, entries=3, rounds=2)
    both(spark, [(i, [30_000.0 + i, -30_000.0 * (i % 3), float(i), 0.0], "s") for i in range(40)], parts=2, entries=4, rounds=4)


def test_other_lengths_and_empty_tables(spark):
    rows = [(i, [float(i)] * 8, None) for i in range(6)] + [(9, [1.0] * 4, None)]
    got = vector_codes.report(spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)).collect()
    assert sorted(r.vec_id for r in got) == list(range(6))
    empty = vector_codes.report(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


@pytest.mark.parametrize("most", [0, 5, 10_000])
def test_cells_keep_every_nearest_entry(most, monkeypatch):
    rng = np.random.default_rng(2)
    book = rng.integers(-900, 900, (16, 4))
    book[5] = book[3]
    cells = Cells(book, most)
    pruned = 0
    for turn in range(4):
        if turn == 3:  # all hashes collide
            monkeypatch.setattr(vector_codes, "mix", lambda x: np.zeros_like(x))
        x = rng.integers(-1000, 1000, (500, 4))
        x[:16] = book
        d = ((x[:, None] - book) ** 2).sum(2)
        open_ = cells.open_entries(x)
        code, error = cells.nearest(x)
        assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
        assert open_[np.arange(500), d.argmin(1)].all() and len(cells.keys) <= most
        pruned += (~open_).sum()
    assert pruned > 5000
