"""Vector code compression through memoised grid cells (operator 11).

Vectors become integers, floor(scale * x), and are cut into equal parts; each part position has a codebook that Lloyd's
rounds refine. The nearest entry of a part is looked up through a grid: the part's coarse cell (each component shifted
right) is hashed, and a cache holds, for every cell met, the entries that aren't dominated across the cell's box. An
entry is dominated if even the smallest difference, over the box, of its squared distance and that of the entry nearest
to the box's middle is above zero; the largest distance of the one against the smallest of the other is the coarser
form of this bound. Only entries left are evaluated, in exact integers, so codes are those of a full search. The
cells' sides follow the codebook: a power of two near half the spacing of its entries. A cache keeps at most
``most_cells`` cells of each part; later ones are bounded again for each batch, so memory has a bound and results don't change.

A round is one scan: tasks add up their parts by entry, Spark sums these (parts x entries x components numbers a task),
and the driver reads one codebook, whose size the parameters bound. Nothing else leaves the tasks.

Defined cases: a vector that is null or empty, or holds null or non-finite components, is dropped, as is one of another length
than most (ties: the longer) or with a component that doesn't fit in 62 bits after scaling; a length that the number of
parts doesn't divide gives parts that differ by one component; the first codebook takes the smallest ids, null ids last,
rows that repeat an id in the order of their components, all of them; with fewer vectors than entries there are fewer
entries, and equal entries all stay (the first of them is used); an error that doesn't fit in a long is null, and so is a sum over it;
labels that are null are one label; an empty table gives no rows; columns besides vec_id, embedding and label are
ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, salted_join, small_batches, stored
from .text import mix

#: Integers up to this have squared distances and sums over a task that fit in 64 bits; larger ones are Python integers.
PLAIN = 1 << 26
MOST = 1 << 62
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def to_integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label, v (array<long>) of the vectors whose components are all there and finite."""
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.col("label").alias("label"), x.alias("_x")).where("_x IS NOT NULL AND size(_x) > 0")
    rows = rows.where(F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < MOST / scale)))
    return rows.select("vec_id", "label", F.transform("_x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def edges(length: int, parts: int) -> list[tuple[int, int]]:
    at = np.linspace(0, length, parts + 1).astype(int).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


class Cells:
    """The codebook of one part position and the cells met so far."""

    def __init__(self, book: np.ndarray, most_cells: int):
        self.book = book
        self.most = most_cells
        self.shift = self._side(book)
        self.size = (book**2).sum(1)
        self.keys = np.zeros(0, np.uint64)
        self.coords = book[:0]
        self.open = np.zeros((0, len(book)), bool)

    @staticmethod
    def _side(book: np.ndarray) -> int:
        """Bits of the cells' side: half the median distance of an entry to its nearest one, shared by the components."""
        b = book.astype(np.float64)
        apart = ((b[:, None] - b) ** 2).sum(2)
        apart[apart == 0] = np.inf
        near = np.sort(apart.min(1))
        near = near[np.isfinite(near)]
        return max(0, round(math.log2(math.sqrt(near[len(near) // 2] / max(1, b.shape[1]))))) if len(near) else 0

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """cells x entries: False where the entry is farther than another one all over the cell's box."""
        low = cells << self.shift
        high = low + ((1 << self.shift) - 1)
        middle = (low + high) >> 1
        best = self.size - 2 * (middle @ self.book.T)
        best = best.argmin(1)
        out = np.empty((len(cells), len(self.book)), bool)
        for k, entry in enumerate(self.book):
            away = entry - self.book[best]
            corner = np.where(away > 0, high, low)
            out[:, k] = (self.size[k] - self.size[best] - 2 * (away * corner).sum(1)) <= 0
        return out

    def open_entries(self, x: np.ndarray) -> np.ndarray:
        """rows x entries: the entries to evaluate, from the cache where the row's cell is there."""
        cells = x >> self.shift
        key = np.zeros(len(x), np.uint64)
        for j in range(x.shape[1]):
            key = mix(key * _FACTOR + (cells[:, j] & 0xFFFFFFFF).astype(np.uint64) + np.uint64(j + 1))
        key, first, row_cell = np.unique(key, return_index=True, return_inverse=True)
        found = cells[first]
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), bool)
        if len(self.keys):
            near = np.minimum(at, len(self.keys) - 1)
            known = (self.keys[near] == key) & (self.coords[near] == found).all(1)
            at = near
        entries = np.empty((len(key), len(self.book)), bool)
        entries[known] = self.open[at[known]]
        new = np.flatnonzero(~known)
        entries[new] = self.undominated(found[new])
        keep = new[~np.isin(key[new], self.keys)][: max(0, self.most - len(self.keys))]
        if len(keep):
            into = np.searchsorted(self.keys, key[keep])
            self.keys = np.insert(self.keys, into, key[keep])
            self.coords = np.insert(self.coords, into, found[keep], axis=0)
            self.open = np.insert(self.open, into, entries[keep], axis=0)
        out = entries[row_cell]
        # Rows of other cells with the same hash are compared with every entry.
        out[(cells != found[row_cell]).any(1)] = True
        return out

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each row's nearest entry, ties to the lower index."""
        wanted = self.open_entries(x)
        code = np.full(len(x), -1)
        error = np.zeros(len(x), x.dtype)
        for k, entry in enumerate(self.book):
            rows = np.flatnonzero(wanted[:, k])
            d = ((x[rows] - entry) ** 2).sum(1)
            closer = (code[rows] < 0) | (d < error[rows])
            error[rows[closer]] = d[closer]
            code[rows[closer]] = k
        return code, error


class Coder:
    """Codebooks of all part positions, in plain integers or, if components are large, in Python's."""

    def __init__(self, books: list[np.ndarray], most_cells: int):
        self.books, self.most = books, most_cells
        self.cells: dict[bool, list[Cells]] = {}

    def parts(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each part position: its number, the rows' parts, codes and squared distances."""
        plain = all(b.size == 0 or abs(b).max() < PLAIN for b in self.books) and (x.size == 0 or np.abs(x).max() < PLAIN)
        kind = np.int64 if plain else object
        if plain not in self.cells:
            self.cells[plain] = [Cells(b.astype(kind), self.most) for b in self.books]
        x, at = x.astype(kind), 0
        for p, cells in enumerate(self.cells[plain]):
            own = np.ascontiguousarray(x[:, at : at + cells.book.shape[1]])
            at += cells.book.shape[1]
            yield (p, own, *cells.nearest(own))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return np.asarray(column.flatten(), np.int64).reshape(batch.num_rows, -1)


def _sums(books: list[np.ndarray], most_cells: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, most_cells)
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            if batch.num_rows:
                for p, own, code, _ in coder.parts(_matrix(batch)):
                    order = np.argsort(code, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
                    used = code[order[first]]
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
                    totals[p][used] += np.add.reduceat(own[order], first, axis=0).astype(object)
        rows = [(p, k, j, int(counts[p][k]), Decimal(int(totals[p][k, j]))) for p in range(len(books)) for k in np.flatnonzero(counts[p]).tolist() for j in range(books[p].shape[1])]
        part, entry, place, n, total = zip(*rows, strict=True) if rows else ([],) * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip((part, entry, place, n, total), kinds, strict=True)], names=["part", "entry", "place", "n", "total"])

    return add


def _codes(books: list[np.ndarray], most_cells: int):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(books, most_cells)
        for batch in batches:
            if not batch.num_rows:
                continue
            digits, error = [], 0
            for _, _, own, d in coder.parts(_matrix(batch)):
                digits.append(own.astype(np.uint8 if len(books[0]) <= 256 else ">u2"))
                error = error + d
            raw = np.stack(digits, 1)
            width = 2 * raw.dtype.itemsize * raw.shape[1]
            text = raw.tobytes().hex()
            codes = [text[i : i + width] for i in range(0, len(text), width)]
            fits = pa.array([int(e) if e < 1 << 63 else None for e in error] if error.dtype == object else error, pa.int64())
            own = {n: batch.column(batch.schema.get_field_index(n)) for n in ("vec_id", "label")}
            yield pa.RecordBatch.from_pydict(own | {"code": pa.array(codes, pa.string()), "error": fits})

    return code


def fit(rows: DataFrame, length: int, parts: int = 8, entries: int = 16, rounds: int = 6, most_cells: int = 65_536) -> list[np.ndarray]:
    """Codebooks (entries x components, Python integers) of the part positions, fitted on all rows of vec_id, v."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    start = np.array([r.v for r in first], object).reshape(len(first), length)
    books = [start[:, a:b].copy() for a, b in edges(length, parts)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books, most_cells), "part int, entry int, place int, n long, total decimal(38,0)")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            books[r.part][r.entry, r.place] = int(r.total) // r.n
    return books


def compress(vectors: DataFrame, scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, most_cells: int = 65_536) -> DataFrame:
    """vec_id, label, code, error, codebooks (array by part of arrays of entries) of every vector kept."""
    small_batches(vectors.sparkSession)
    integers = stored(to_integers(vectors, scale))
    lengths = integers.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    length = lengths.n if lengths else 0
    rows = integers.where(F.size("v") == length)
    books = fit(rows, length, parts, entries, rounds, most_cells)
    empty = rows.selectExpr("vec_id", "label", "'' AS code", "0L AS error")
    if not length:
        coded = empty
    else:
        coded = stored(rows.mapInArrow(_codes(books, most_cells), T.StructType([T.StructField(f.name, f.dataType) for f in empty.schema.fields])))
        discard(integers)
    return coded.withColumn("codebooks", F.lit(",".join(str(c) for b in books for c in b.ravel().tolist())))


def report(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error (the errors of its label added up), codebooks_sha256."""
    coded = compress(vectors, **options)
    digest = hashlib.sha256((coded.select("codebooks").first() or [""])[0].encode()).hexdigest()
    keyed = coded.select("vec_id", "code", "error", F.concat(F.lit("="), F.col("label").cast("string")).alias("_label")).fillna("", ["_label"])
    # One null error makes the label's sum null; a label may hold any share of the rows.
    total = F.when(F.count("*") == F.count("error"), F.sum(F.col("error").cast("decimal(38,0)")))
    sums = keyed.groupBy("_label").agg(total.try_cast("long").alias("label_error"), F.count("*").alias("_rows"))
    out = salted_join(keyed, sums, "_label", F.col("vec_id"), "_rows")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
