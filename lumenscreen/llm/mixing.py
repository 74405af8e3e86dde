"""Mixing sources to target weights (operator 9, DataFrame functions only).

A source's target is its share, by weight, of 1.5 times all words; no target passes twice the size of its source,
and what a full source can't take is shared again among the others. Documents are dealt into blocks of a few
hundred by a hash. A source whose target is q times its size and a rest draws every block q times, and permuted
blocks up to the rest; the last block is cut at the exact word. The block quotas of all sources are split among the
output shards by a binary tree: at each node the left half draws its number of slots from the node's blocks without
replacement, which is a multivariate hypergeometric draw, made as one hypergeometric draw for each source. A
source's permuted blocks are then dealt to the shards by its quotas, so shards are disjoint. ``mix`` sends each shard to
one partition and sorts it in a random order of its own; the number of shards grows with the words. Sources are taken
to be a small dimension: their plan is a row for each, sorted in one task, and a node of the tree lists them all.

Defined cases: a null or empty text has size 0, is in the mix when its block is, and adds no words; a null source is
a source of its own that comes last; repeated rows are documents of their own; no documents give no rows; a source
without words has target 0. Extra columns of the input, whatever their names, don't change the plan and stay in the
mix; a column that ``mix`` adds under a name that is taken gets underscores before it. Texts of any length count whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, free_name

WORD = r"[^\x20\x09-\x0D]+"
SHARD_WORDS = 64_000_000
MOST_BROADCAST = 100_000


def _hash(seed: int, *parts: Column) -> Column:
    """The first 32 bits of an md5: the same number in any engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _uniform(seed: int, *parts: Column) -> Column:
    """From 0 to below 1: the first 52 bits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _key() -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, n_docs, source_size, target). One row for each source; sources are a small dimension."""
    stats = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = stats.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_room.rowsBetween(0, Window.unboundedFollowing)
    all_rows = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # What each unit of weight gets once all sources with less room are full; the first source with room to spare settles it.
    level = (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    full = F.col("_cap") <= F.col("_level") * F.col("_w")
    levels = capped.withColumn("_level", level).withColumn("_full", full)
    final = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level")))).over(all_rows)[F.lit("_level")]
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least("_cap", final * F.col("_w")))
    return levels.withColumn("target", target).select("source", "n_docs", "source_size", "target")


def _let(values: dict[str, Column], body) -> Column:
    """body(row of values), with each value computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _walk(v: Column, up: bool, goal: Column | None) -> Column:
    """Add up probabilities, relative to the mode's, step by step from the mode; ``at``: the step that passes the goal."""
    steps = F.floor(F.when(F.lit(up), v["top"] - v["mode"]).otherwise(v["mode"] - v["bottom"])).cast("int")
    # A sequence has at least one element: step 0 stands for the mode itself and adds nothing.
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))

    def step(s: Column, i: Column) -> Column:
        if up:
            x = v["mode"] + i - 1
            ratio = (v["k"] - x) * (v["n"] - x) / ((x + 1) * (v["m"] - v["k"] - v["n"] + x + 1))
        else:
            x = v["mode"] - i + 1
            ratio = x * (v["m"] - v["k"] - v["n"] + x) / ((v["k"] - x + 1) * (v["n"] - x + 1))
        w = F.when(i > 0, s["w"] * ratio).otherwise(s["w"])
        total = F.when(i > 0, s["sum"] + w).otherwise(s["sum"])
        at = F.lit(None).cast("double") if goal is None else F.when(s["at"].isNull() & (i > 0) & (total > goal), x + (1 if up else -1)).otherwise(s["at"])
        return F.struct(w.alias("w"), total.alias("sum"), at.alias("at"))

    return F.aggregate(F.sequence(F.lit(0), steps), start, step)


def _hypergeometric(u: Column, successes: Column, draws: Column, population: Column) -> Column:
    """Exact inverse transform, walking outward from the mode by ratios of neighbouring probabilities.

    The walk ends 12 standard deviations away, where what is left is under the resolution of a double.
    """

    def centred(v: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), v["n"] + v["k"] - v["m"]), F.least(v["k"], v["n"])
        mode = F.least(high, F.greatest(low, F.floor((v["n"] + 1) * (v["k"] + 1) / (v["m"] + 2)).cast("double")))
        p = v["k"] / F.greatest(v["m"], F.lit(1.0))
        reach = F.ceil(12 * F.sqrt(v["n"] * p * (1 - p)) + 24).cast("double")
        known = {c: v[c] for c in ("u", "k", "n", "m")}
        return _let(known | {"low": low, "high": high, "mode": mode, "reach": reach}, bounded)

    def bounded(v: Column) -> Column:
        known = {c: v[c] for c in ("u", "k", "n", "m", "mode")}
        return _let(known | {"top": F.least(v["high"], v["mode"] + v["reach"]), "bottom": F.greatest(v["low"], v["mode"] - v["reach"])}, summed)

    def summed(v: Column) -> Column:
        known = {c: v[c] for c in ("u", "k", "n", "m", "mode", "top", "bottom")}
        return _let(known | {"right": _walk(v, True, None)["sum"], "left": _walk(v, False, None)["sum"]}, drawn)

    def drawn(v: Column) -> Column:
        goal = v["u"] * (1 + v["right"] + v["left"])
        found = F.when(goal < 1, v["mode"]).when(goal < 1 + v["right"], _walk(v, True, goal - 1)["at"]).otherwise(_walk(v, False, goal - 1 - v["right"])["at"])
        return F.coalesce(found, v["mode"]).cast("long")

    return _let({"u": u, "k": successes.cast("double"), "n": draws.cast("double"), "m": population.cast("double")}, centred)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, quota) -> (source, shard, quota), by a binary tree over the shards.

    A row of the tree is a node: a range of shards and the quota of every source in it.
    """
    tree = quotas.agg(F.sort_array(F.collect_list(F.struct("source", "quota"))).alias("q")).withColumn("low", F.lit(0)).withColumn("high", F.lit(shards))
    for _ in range(math.ceil(math.log2(max(shards, 1)))):
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        population = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x["quota"])
        nodes = tree.withColumn("mid", middle).withColumn("n", population).withColumn("slots", F.floor(F.col("n") * (F.col("mid") - F.col("low")) / (F.col("high") - F.col("low"))).cast("long"))
        start = F.struct(F.col("slots").alias("slots"), F.col("n").alias("n"), F.array().cast("array<bigint>").alias("left"))

        def draw(s: Column, x: Column) -> Column:
            got = _hypergeometric(_uniform(seed, F.col("low"), F.col("high"), x["source"]), x["quota"], s["slots"], s["n"])
            return F.struct((s["slots"] - got).alias("slots"), (s["n"] - x["quota"]).alias("n"), F.concat(s["left"], F.array(got)).alias("left"))

        nodes = nodes.withColumn("left", F.aggregate("q", start, draw)["left"])
        part = lambda take: F.transform("q", lambda x, i: F.struct(x["source"].alias("source"), (take(x, i)).alias("quota")))
        halves = F.array(
            F.struct(part(lambda x, i: F.get("left", i)).alias("q"), F.col("low").alias("low"), F.col("mid").alias("high")),
            F.struct(part(lambda x, i: x["quota"] - F.get("left", i)).alias("q"), F.col("mid").alias("low"), F.col("high").alias("high")),
        )
        whole = F.array(F.struct(F.col("q").alias("q"), F.col("low").alias("low"), F.col("high").alias("high")))
        # Each level is cut, so that plans stay small; a level is a row for each shard at most.
        tree = cut(nodes.select(F.inline(F.when(F.col("high") - F.col("low") > 1, halves).otherwise(whole))))
    return tree.select(F.col("low").alias("shard"), F.explode("q").alias("x")).select("x.source", "shard", "x.quota")


def _running(df: DataFrame, value: str, order: str, out: str, bins: int = 1024) -> DataFrame:
    """Exclusive running sum of value for each source in the order of a 32-bit hash.

    No source is gathered in a task: sums of hash ranges come first, then each range has its own window.
    """
    ranged = df.withColumn("_bin", F.floor(F.col(order) * bins / F.lit(2**32)).cast("int"))
    bin_sums = ranged.groupBy("_key", "_bin").agg(F.sum(value).alias("_s"))
    over_bins = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = bin_sums.select("_key", "_bin", F.coalesce(F.sum("_s").over(over_bins), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_key", "_bin").orderBy(order, "block", "draw").rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(starts, ["_key", "_bin"])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_bin", "_before")


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", _size().alias("size"))


def mix_plan(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The plan of ``planned`` alone."""
    return planned(docs, shards, **options)[0]


def planned(docs: DataFrame, shards: int | None = None, block_docs: int = 256, seed: int = 17, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, keep: bool = False) -> tuple[DataFrame, int]:
    """The plan and its number of shards. One row for each document: doc_id, source, size, source_size, target, block, at, shards, draws; with keep, its whole row as _row.

    ``draws`` lists what the mix takes of it: shard, draw (0 and on: whole passes; last: the permuted rest) and words.
    ``shards`` is their number: by default 16, or more where a shard would get over SHARD_WORDS words.
    """
    sized = cut(sized_documents(docs))
    targets = cut(source_targets(sized, weights, share, most))
    quota = targets.select(
        _key().alias("_key"), "source_size", "target",
        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs)).alias("_blocks"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("_passes"),
    )
    quota = quota.withColumn("_rest", F.floor("target") - F.col("_passes") * F.col("source_size"))
    facts = targets.agg(F.count("*").alias("sources"), F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()
    shards = shards or max(16, math.ceil(float(share) * facts["words"] / SHARD_WORDS))

    def held(small: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(small) if rows <= MOST_BROADCAST else small

    def place(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_key", _key()).join(held(quota, facts["sources"]), "_key")
        return rows.withColumn("at", _hash(seed, F.col("doc_id"))).withColumn("block", F.pmod(_hash(seed + 1, F.col("doc_id")), F.col("_blocks")))

    blocks = place(sized).groupBy("_key", "source", "block").agg(F.sum("size").alias("words"), F.first("_passes").alias("passes"), F.first("_rest").alias("rest"))
    blocks = blocks.withColumn("order", _hash(seed + 2, F.col("source"), F.col("block"))).withColumn("draw", F.lit(0))
    blocks = cut(_running(blocks, "words", "order", "before"))
    passes = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.col("passes"), F.lit(1))), lambda i: F.struct((i - 1).cast("int").alias("draw"), F.col("words").alias("limit")))).otherwise(F.array())
    rest = F.when(F.col("rest") > F.col("before"), F.array(F.struct(F.col("passes").cast("int").alias("draw"), F.least("words", F.col("rest") - F.col("before")).alias("limit")))).otherwise(F.array())
    slots = blocks.select("_key", "source", "block", F.inline(F.concat(passes, rest)))
    slots = slots.withColumn("one", F.lit(1)).withColumn("order", _hash(seed + 3, F.col("source"), F.col("block"), F.col("draw")))
    slots = _running(slots, "one", "order", "rank")

    quotas = split_quotas(slots.groupBy("source").agg(F.count("*").alias("quota")), shards, seed).withColumn("_key", _key())
    upto = Window.partitionBy("_key").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = quotas.withColumn("end", F.sum("quota").over(upto)).groupBy("_key").agg(F.sort_array(F.collect_list("end")).alias("_ends"))
    dealt = slots.join(held(ends, facts["sources"] * shards), "_key").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("rank"))))
    drawn = dealt.groupBy("_key", "block").agg(F.sort_array(F.collect_list(F.struct("draw", "shard", "limit"))).alias("_slots"))

    # The window and the join deal rows alike, so whole rows are shuffled once.
    inside = Window.partitionBy("_key", "block").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = docs.select("doc_id", "source", _size().alias("size"), F.struct("*").alias("_row")) if keep else sized
    out = place(rows).withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(drawn, ["_key", "block"], "left")
    words = lambda s: F.greatest(F.lit(0), F.least(F.col("size"), s["limit"] - F.col("_before"))).cast("long")
    drawn_words = F.transform("_slots", lambda s: F.struct(s["shard"].alias("shard"), s["draw"].alias("draw"), words(s).alias("words")))
    kept = F.filter(drawn_words, lambda d: (d["words"] > 0) | (F.col("size") == 0))
    draws = F.coalesce(kept, F.array().cast("array<struct<shard:int,draw:int,words:bigint>>"))
    return out.select("doc_id", "source", "size", "source_size", "target", "block", "at", F.lit(shards).alias("shards"), draws.alias("draws"), *["_row"] * keep), shards


def mix(docs: DataFrame, shards: int | None = None, **options) -> DataFrame:
    """The mix itself: a row for each document drawn, with all columns of docs and shard, draw, words and position.

    A shard is in one partition, sorted by position. The text of a document that is cut at a target holds its first words.
    """
    plan, n = planned(docs, shards, keep=True, **options)
    plan = plan.select("doc_id", "size", "_row", F.explode("draws").alias("_d"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col("_row.text"), F.lit(WORD), F.lit(0)), F.lit(1), F.col("_d.words").cast("int")), " ")
    text = F.when(F.col("_d.words") < F.col("size"), part).otherwise(F.col("_row.text"))
    position = F.xxhash64(F.lit(options.get("seed", 17)), "doc_id", F.col("_d.draw"))
    named = {n: free_name(n, docs.columns) for n in ("shard", "draw", "words", "position")}
    out = plan.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns], *[F.col(f"_d.{n}").alias(named[n]) for n in ("shard", "draw", "words")], position.alias(named["position"]))
    # A partition for each planned shard; a hash would put several in one and none in others.
    return out.repartitionById(n, named["shard"]).sortWithinPartitions(named["shard"], named["position"])


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, draws: what the plan takes of each document.

    draws lists shard:draw:words, comma-joined.
    """
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda s, d: s + d["words"])
    listed = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["draw"].cast("string"), d["words"].cast("string"))), ",")
    return mix_plan(docs, **options).select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), taken.alias("taken"), listed.alias("draws"))
