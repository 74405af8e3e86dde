"""Approximate nearest neighbours by an inverted file with product-quantised residuals (operator 2).

Coarse centroids and the residual codebooks are fitted on about ``sample`` vectors (a documented bound; a hash of the
row picks them). Every vector is then assigned to its centroid's list and coded. The number of lists to probe is measured
against brute force: ``judged`` of the queries, which a hash picks, meet all rows, and as many lists are probed as hold
0.98 of their neighbours.

A query probes its nearest lists, more of them where these hold fewer than k others, and scores their codes through its
table of inner products, the asymmetric distance table. The ``rerank`` best are compared on the original vectors in double precision, and
then every further vector that the error of its code, which is known, doesn't keep behind the k-th of these. So no
neighbour in a probed list is lost, also where codes can't tell the vectors of a tight group apart.

There is a list for about ``list_rows`` vectors, but ``most_lists`` at most, as the driver holds the centroids; beyond
list_rows * most_lists vectors the lists grow with the table, and a query's work with them.

Lists are cut into parts of bounded size, so that a list with a third of all rows is many tasks' work, and the parts,
in an order that keeps near lists together, are dealt to units. A task holds the candidates of one unit; the queries that probe a list of it stream by. Only the k
best of a query leave a unit, after the exact reranking there. Query vectors are shuffled, never broadcast; only the
fitted index is, whose size the parameters bound.

Defined cases: a vector that is null, empty, zero, of another length than most, or holds null or non-finite components
takes no part; a null id takes no part; equal scores go to the smaller id; with fewer candidates than k all are
returned; an empty table gives no rows; rows that repeat an id are queries and candidates of their own, and each finds
the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part; lengths aren't compared yet."""
    out = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return out.where(finite & F.exists("v", lambda x: x != 0))


def _lloyd(x: np.ndarray, k: int, rng: np.random.Generator, steps: int) -> np.ndarray:
    different = np.unique(x, axis=0)
    k = min(k, len(different))
    centres = different[rng.choice(len(different), k, replace=False)].copy()
    for _ in range(steps):
        own = (x @ centres.T - 0.5 * (centres**2).sum(1)).argmax(1)
        n = np.bincount(own, minlength=k)
        for j in range(x.shape[1]):
            centres[:, j] = np.where(n > 0, np.bincount(own, x[:, j], k) / np.maximum(n, 1), centres[:, j])
    return centres


class Index:
    def __init__(self, sample: np.ndarray, lists: int, parts: int, codes: int, seed: int):
        rng = np.random.default_rng(seed)
        x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.size = x.shape[1]
        self.centres = _lloyd(x, max(1, min(lists, len(x))), rng, 10)
        self.edges = np.linspace(0, self.size, min(parts, self.size) + 1).astype(int)
        rest = x - self.centres[self.nearest(x, 1)[:, 0]]
        self.books = [_lloyd(rest[:, a:b], min(codes, len(x)), rng, 8) for a, b in zip(self.edges[:-1], self.edges[1:], strict=True)]

    def probes_for(self, recall: float, queries: np.ndarray, lists: list[list[int]], sizes: np.ndarray) -> int:
        """Lists to probe so that this share of the queries' neighbours, which are in the given lists, lies in them."""
        needed = []
        for own, found in zip(self.nearest(queries, len(self.centres)), lists, strict=True):
            own = own[sizes[own] > 0]
            order = np.zeros(len(self.centres), np.int64)
            order[own] = np.arange(len(own))
            needed += order[found].tolist()
        needed.sort()
        return needed[max(0, int(np.ceil(recall * len(needed))) - 1)] + 1 if needed else 1

    def probes(self, x: np.ndarray, n: int, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """For each row its nearest lists that hold something: n of them, or more until they hold ``least`` rows."""
        near = self.nearest(x, len(self.centres))
        out = []
        for own in near:
            own = own[sizes[own] > 0]
            out.append(own[: max(n, int(np.searchsorted(np.cumsum(sizes[own]), least)) + 1)])
        return out

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        score = x @ self.centres.T - 0.5 * (self.centres**2).sum(1)
        n = min(n, len(self.centres))
        best = np.argpartition(-score, n - 1, 1)[:, :n]
        return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), 1, kind="stable"), 1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.nearest(x, 1)[:, 0]
        rest = x - self.centres[own]
        codes = [(rest[:, a:b] @ k.T - 0.5 * (k**2).sum(1)).argmax(1).astype(np.uint8) for a, b, k in zip(self.edges[:-1], self.edges[1:], self.books, strict=True)]
        return own, np.stack(codes, 1)

    def decode(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.centres[own] + np.concatenate([k[codes[:, m]] for m, k in enumerate(self.books)], 1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """queries x parts x codes: inner product of a query's part with each code word."""
        out = np.zeros((len(q), len(self.books), max(len(b) for b in self.books)))
        for m, (a, b, k) in enumerate(zip(self.edges[:-1], self.edges[1:], self.books, strict=True)):
            out[:, m, : len(k)] = q[:, a:b] @ k.T
        return out


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.asarray(column.flatten(), np.float64).reshape(batch.num_rows, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _rows(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow or underflow in the norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their largest component: the same cosine to the last bit, without overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def near_order(x: np.ndarray) -> np.ndarray:
    """An order of the rows that puts near ones together: halved again and again along the widest direction."""
    if len(x) < 3:
        return np.arange(len(x))
    middle = x - x.mean(0)
    along = middle @ np.linalg.svd(middle, full_matrices=False)[2][0]
    order = np.argsort(along, kind="stable")
    low, high = order[: len(x) // 2], order[len(x) // 2 :]
    return np.concatenate([low[near_order(x[low])], high[near_order(x[high])]])


class Deal:
    """Where the parts of the lists go: lists near each other follow each other, and units are even shares of all rows.

    So the lists of a query lie in few units, and a list with a third of all rows is spread over a third of them.
    """

    def __init__(self, sizes: np.ndarray, order: np.ndarray, units: int, part_rows: int):
        self.sizes, self.units = sizes.astype(np.int64), units
        self.parts = np.maximum(1, -(-self.sizes // part_rows))
        self.before = np.zeros(len(sizes), np.int64)
        self.before[order] = np.cumsum(self.sizes[order]) - self.sizes[order]
        self.total = max(1, int(self.sizes.sum()))

    def unit(self, lists: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (self.before[lists] + part * self.sizes[lists] // self.parts[lists]) * self.units // self.total

    def of_rows(self, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.unit(own, (mixed % self.parts[own].astype(np.uint64)).astype(np.int64))

    def of_query(self, lists: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Each unit that holds a part of these lists, with those of the lists that it holds."""
        many = self.parts[lists]
        each = np.repeat(lists, many)
        unit = self.unit(each, np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many))
        order = np.argsort(unit, kind="stable")
        cuts = np.flatnonzero(np.diff(unit[order])) + 1
        return [(int(unit[some[0]]), np.unique(each[some])) for some in np.split(order, cuts)]


#: side 0: candidates, 1: queries; twin tells queries apart that share an id; times: how many equal rows ask.
SCANNED = "unit int, side int, id long, v binary, list int, code binary, twin long, times int"
_SCANNED = [x.split()[0] for x in SCANNED.split(", ")]


def _surveyor(shared, asked, k: int):
    """Rows of each list (q -1), and the k nearest rows of each judged query with their lists (q 0 and up), in this task."""

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, (ids, raw) = shared.value, asked.value
        counts = np.zeros(len(index.centres), np.int64)
        unit = _unit(raw)
        best, where = np.full((len(raw), k), -np.inf), np.zeros((len(raw), k), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                v, vec_id = _matrix(some, "v"), some.column(0).to_numpy()
                own = index.nearest(_unit(v), 1)[:, 0]
                counts += np.bincount(own, minlength=len(counts))
                score = unit @ _unit(v).T
                for q in np.flatnonzero(np.isin(ids, vec_id)):
                    mine = np.flatnonzero(vec_id == ids[q])
                    score[q, mine[(v[mine] == raw[q]).all(1)]] = -np.inf
                score = np.concatenate([best, score], 1)
                lists = np.concatenate([where, np.broadcast_to(own, (len(raw), len(own)))], 1)
                top = np.argpartition(-score, k - 1, 1)[:, :k]
                best, where = np.take_along_axis(score, top, 1), np.take_along_axis(lists, top, 1)
        filled, (q, j) = np.flatnonzero(counts), np.nonzero(np.isfinite(best))
        none = np.zeros(len(filled))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(none - 1, q), pa.int32()), pa.array(np.append(filled, where[q, j]), pa.int32()), pa.array(np.append(counts[filled], 0 * q), pa.int64()), pa.array(np.append(none, -best[q, j]), pa.float64())],
            names=["q", "list", "n", "far"],
        )

    return survey


def _coder(shared, deal: Deal, dtype: str):
    """Candidates, side 0: their vector, list and code."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch, "v")
                own, codes = shared.value.encode(_unit(v))
                unit = deal.of_rows(own, batch.column(0).to_numpy())
                side = pa.array(np.zeros(len(v)), pa.int32())
                none = pa.nulls(len(v), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), side, batch.column(0), _binary(v.astype(dtype)), pa.array(own, pa.int32()), _binary(codes), none, none.cast(pa.int32())], names=_SCANNED)

    return code


def _prober(shared, deal: Deal, probes: int, least: int, dtype: str):
    """Queries, side 1: once for each unit that holds a probed list, with those lists in place of a code."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                v = _matrix(some, "v")
                row, unit, lists = [], [], []
                for i, near in enumerate(shared.value.probes(_unit(v), probes, deal.sizes, least)):
                    for u, held in deal.of_query(near):
                        row.append(i)
                        unit.append(u)
                        lists.append(held.astype(np.int32).tobytes())
                take = pa.array(row, pa.int64())
                side = pa.array(np.ones(len(row)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(unit, pa.int32()), side, some.column(0).take(take), _binary(v.astype(dtype)).take(take), pa.nulls(len(row), pa.int32()), pa.array(lists, pa.binary()), some.column(2).take(take), some.column(3).take(take)], names=_SCANNED)

    return probe


class _Unit:
    """The candidates of one unit, list by list."""

    def __init__(self, index: Index, rows: pa.Table, dtype: str):
        own, ids = rows["list"].to_numpy(), rows["id"].to_numpy()
        order = np.lexsort((ids, own))
        self.index, self.own, self.ids = index, own[order], ids[order]
        self.codes = _rows(rows["code"].combine_chunks(), np.uint8)[order]
        self.v = _rows(rows["v"].combine_chunks(), dtype)[order]
        # Of each row: its unit vector, the error of its code and the code's squared length.
        self.unit = np.empty(self.v.shape)
        self.error, self.square = np.empty((2, len(ids)), np.float32)
        for at in range(0, len(ids), 2048):
            some = slice(at, at + 2048)
            self.unit[some] = _unit(self.v[some].astype(np.float64))
            coded = index.decode(self.own[some], self.codes[some])
            self.error[some], self.square[some] = np.linalg.norm(self.unit[some] - coded, axis=1), (coded**2).sum(1)
        self.lists, first = np.unique(self.own, return_index=True)
        self.edges = np.append(first, len(ids))

    def nearest(self, queries: pa.RecordBatch, dtype: str, best: int | None, k: int) -> pa.RecordBatch:
        """The k best of each query by the vectors' cosine, proved by its distance tables.

        A row is left out if its code is farther from the query than the k-th of the ``best`` by the tables (None: all),
        by more than the code's error.
        """
        raw = _rows(queries.column(3), dtype).astype(np.float64)
        unit = _unit(raw)
        tables = self.index.tables(unit).astype(np.float32)
        probed = np.zeros((len(raw), len(self.index.centres)), bool)
        for i, lists in enumerate(queries.column(5).to_pylist()):
            probed[i, np.frombuffer(lists, np.int32)] = True
        score = np.full((len(raw), len(self.ids)), -np.inf, np.float32)
        for which, s, e in zip(self.lists, self.edges[:-1], self.edges[1:], strict=True):
            wanted = np.flatnonzero(probed[:, which])
            if len(wanted):
                part = np.repeat((unit[wanted] @ self.index.centres[which]).astype(np.float32)[:, None], e - s, 1)
                for m in range(self.codes.shape[1]):
                    part += np.take(tables[wanted, m], self.codes[s:e, m], 1)
                score[wanted, s:e] = part
        chosen_of, vec_id, exact = [], [], []
        for i, query in enumerate(queries.column(2).to_pylist()):
            # The query's own row is out; others with its id, and further equal rows, are candidates.
            mine = np.flatnonzero(self.ids == query)
            score[i, mine[(self.v[mine].astype(np.float64) == raw[i]).all(1)][:1]] = -np.inf
            top = np.flatnonzero(np.isfinite(score[i]))
            if best is not None and best < len(top):
                first = top[np.argpartition(-score[i, top], best - 1)[:best]]
                cosine = self.unit[first] @ unit[i]
                kth = np.sqrt(max(0.0, 2 - 2 * np.partition(cosine, len(cosine) - min(k, len(cosine)))[-min(k, len(cosine))])) + 1e-7
                top = top[1 - 2 * score[i, top] + self.square[top] - 1e-5 <= (kth + self.error[top]) ** 2]
            # What could be among the k best by rounded cosines is judged by the exact ones.
            cosine = self.unit[top] @ unit[i]
            if len(top) > k:
                top = top[cosine >= np.partition(cosine, len(top) - k)[len(top) - k] - 1e-12]
            x, y = _scaled(raw[i : i + 1]), _scaled(self.v[top].astype(np.float64)) if len(top) else self.v[top]
            found = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            chosen = np.lexsort((self.ids[top], -found))[:k]
            chosen_of.append(np.full(len(chosen), i))
            vec_id.append(self.ids[top][chosen])
            exact.append(found[chosen])
        of = pa.array(np.concatenate(chosen_of), pa.int64())
        return pa.RecordBatch.from_arrays([queries.column(2).take(of), queries.column(6).take(of), queries.column(7).take(of), pa.array(np.concatenate(vec_id), pa.int64()), pa.array(np.concatenate(exact), pa.float64())], names=["query_id", "twin", "times", "vec_id", "score"])


def _scanner(shared, dtype: str, best: int | None, k: int):
    """Units in order, candidates before queries: the candidates of one unit are held, its queries stream by."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if key[s, 0] != current:
                    current, held, block = key[s, 0], [], None
                if key[s, 1] == 0:
                    held.append(batch.slice(s, e - s))
                elif held:
                    block = block or _Unit(shared.value, pa.Table.from_batches(held), dtype)
                    for at in range(s, e, 64):
                        yield block.nearest(batch.slice(at, min(64, e - at)), dtype, best, k)

    return scan


def search(vectors: DataFrame, is_query, k: int = 5, sample: int = 20_000, list_rows: int = 256, most_lists: int = 2048, recall: float = 0.98, judged: int = 256, parts: int = 32, codes: int = 256, rerank: int = 200, unit_rows: int = 32768, seed: int = 3, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which is_query holds.

    exact: all lists are probed and all their vectors reranked, so that no neighbour is missed.
    recall: the share of the neighbours of ``judged`` queries, found by brute force, that the probed lists hold.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if sizes is None:
        return empty
    rows = rows.where(F.size("v") == sizes["n"]).withColumn("vec_id", F.col("vec_id").cast("long"))
    total = sizes["count"]
    share = min(1.0, sample / total)
    picked = rows.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id", "v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").toArrow()["v"].combine_chunks()
    fitted = np.asarray(picked.flatten(), np.float64).reshape(len(picked), -1)
    lists = max(1, min(most_lists, total // list_rows))
    index = Index(fitted / np.abs(fitted).max(1, keepdims=True), lists, parts, codes, seed)
    shared = spark.sparkContext.broadcast(index)

    some = rows.where(is_query).orderBy(F.xxhash64(F.lit(seed + 1), "vec_id", "v")).select("vec_id", "v").limit(judged).toArrow()
    asked = np.asarray(some["v"].combine_chunks().flatten(), np.float64).reshape(len(some), index.size)
    sent = spark.sparkContext.broadcast((some["vec_id"].to_numpy(), asked))
    counted = np.zeros(len(index.centres), np.int64)  # most_lists numbers at most
    near = [[] for _ in asked]
    surveyed = rows.select("vec_id", "v").mapInArrow(_surveyor(shared, sent, k), "q int, list int, n long, far double")
    of = F.when(F.col("q") < 0, F.col("list")).otherwise(0)
    found = F.slice(F.sort_array(F.collect_list(F.when(F.col("q") >= 0, F.struct("far", "list")))), 1, k)["list"]
    for row in surveyed.groupBy("q", of.alias("of")).agg(F.sum("n").alias("n"), found.alias("found")).collect():
        if row["q"] < 0:
            counted[row["of"]] = row["n"]
        else:
            near[row["q"]] = row["found"]
    probes, best = index.probes_for(recall, _unit(asked), near, counted) if len(asked) else 1, rerank
    if exact:
        probes, best = len(index.centres), None
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    unit_rows = max(1024, unit_rows * 64 // max(64, index.size))  # a unit's vectors take about the same room at any length
    deal = Deal(counted, near_order(index.centres), max(partitions, -(-total // unit_rows)), unit_rows // 4)
    dtype = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    coded = rows.select("vec_id", "v").mapInArrow(_coder(shared, deal, dtype), SCANNED)
    queries = rows.where(is_query).groupBy("vec_id", "v").agg(F.count("*").cast("int").alias("times"))
    asked = queries.select("vec_id", "v", F.xxhash64("v").alias("twin"), "times").mapInArrow(_prober(shared, deal, probes, k + 1, dtype), SCANNED)
    in_order = coded.unionAll(asked).repartition(partitions, "unit").sortWithinPartitions("unit", "side")
    found = in_order.mapInArrow(_scanner(shared, dtype, best, k), "query_id long, twin long, times int, vec_id long, score double")
    ranked = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id")
    kept = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return kept.withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("times")))).select("query_id", "rank", "vec_id", "score")
