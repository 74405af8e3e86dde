"""Line dedup with a log-template tree (operator 5).

Lines are parsed by a tree of fixed depth: the number of tokens, then the leading tokens, lead to a leaf. Tokens with
a digit are variable fields. Within a leaf a place is constant if one token holds it in most of the leaf's different
lines; a line that agrees with all constant places has the leaf's template, with its other fields generalised. A leaf
with too few constant places has none, and its lines stand for themselves.

A line recurs if it stands, digits aside, in at least ``min_contexts`` different documents: alone, between blank lines,
at an edge of the text or within a block of other repeated lines. Documents that are equal but for blank lines and
spacing are one document, so that copies of a whole document are left to near-duplicate removal. Near copies are
different documents: lines that min_contexts of them share recur. A template of lines that differ in words recurs if it
stands in so many different surroundings, which are the pair of lines around it, blank ones skipped. What recurs is
dropped from all documents but the first that has it.

Everything is grouped aggregation and salted joins on hashes; only distinct lines of crowded leaves are split into
tokens. Defined cases: null text stays null; blank lines are never dropped; a document whose lines are all dropped
has an empty text; a null doc_id is left alone; rows that repeat a doc_id share the places that go; of equally frequent
tokens the one that sorts last holds a place; a text of any length is read whole; an empty table gives no rows; extra
columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, salted_join, stored

FIELD = "<*>"
BROADCAST_ROWS = 1_000_000
#: Documents with lines that go, and an eighth of such lines, up to which their places are sent to every task.
MOST_SENT = 250_000


def _spaced(line: Column) -> Column:
    """White space as single spaces, none at the ends; the expression with a rewrite runs only where it is needed."""
    odd = line.rlike("[\\x09-\\x0D]|  ")
    return F.trim(F.when(odd, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line))


def _masked(line: Column) -> Column:
    """Tokens with a digit as FIELD; a token is tried from its first character only."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", FIELD)).otherwise(line)


def parsed_lines(docs: DataFrame, depth: int = 3) -> DataFrame:
    """doc_id, pos, masked, line and leaf (hashes), context, copy (hash of the whole text): a row for each line with a token."""
    lines = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(F.split("text", "\n"), _spaced).alias("_l"))
    copy = F.xxhash64(F.array_join(F.filter("_l", lambda x: x != ""), "\n"))
    numbered = F.transform("_l", lambda x, i: F.struct(i.alias("pos"), _masked(x).alias("masked")))
    lines = lines.select("doc_id", copy.alias("copy"), F.filter(numbered, lambda x: x["masked"] != "").alias("_m"))
    near = lambda i: F.coalesce(F.get("_m", i)["masked"], F.lit(""))
    around = F.transform("_m", lambda x, i: F.struct(x["pos"].alias("pos"), x["masked"].alias("masked"), F.xxhash64(near(i - 1), near(i + 1)).alias("context")))
    rows = lines.select("doc_id", "copy", F.explode(around).alias("x")).select("doc_id", "x.pos", "x.masked", "x.context", "copy")
    words = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    leaf = F.xxhash64(words, F.substring_index("masked", " ", depth))
    return rows.select("doc_id", "pos", "masked", F.xxhash64("masked").alias("line"), leaf.alias("leaf"), "context", "copy")


def templates(rows: DataFrame, min_contexts: int = 8, constant_share: float = 0.6, constant_places: float = 0.5) -> DataFrame:
    """line, first_doc, rows of the lines that recur by themselves or by their template, stored. rows: stored parsed lines."""
    alone = rows.groupBy("line", "copy").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).groupBy("line").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"), F.sum("n").alias("rows"))
    alone = stored(alone)
    crowded = stored(rows.groupBy("leaf", "context").agg(F.count("*").alias("n")).groupBy("leaf").agg(F.count("*").alias("contexts"), F.sum("n").alias("_rows")).where(F.col("contexts") >= min_contexts).select("leaf", "_rows"))
    texts = rows.select("line", "leaf", "masked")
    if crowded.count() <= BROADCAST_ROWS:
        within = texts.join(F.broadcast(crowded), "leaf", "left_semi")
    else:
        within = salted_join(texts, crowded.withColumn("_crowded", F.lit(True)), "leaf", F.col("line"), "_rows").where("_crowded").drop("_crowded")
    distinct = stored(within.groupBy("line", "leaf", "masked").count().drop("count"))
    tokens = distinct.select("line", "leaf", F.posexplode(F.split("masked", " ")).alias("place", "token"))
    counts = tokens.groupBy("leaf", "place", "token").count()
    places = counts.groupBy("leaf", "place").agg(F.max_by("token", F.struct("count", "token")).alias("token"), (F.max("count") / F.sum("count")).alias("share"), F.sum("count").alias("n"))
    constant = F.when((F.col("share") >= constant_share) & (F.col("token") != FIELD), F.col("token"))
    trees = places.groupBy("leaf").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", constant.alias("token")))), lambda x: x["token"]).alias("form"), F.max("n").alias("n"))
    trees = trees.where(F.size(F.filter("form", lambda x: x.isNotNull())) >= constant_places * F.size("form"))
    matched = salted_join(distinct, trees, "leaf", F.col("line"), "n").where("form IS NOT NULL")
    agrees = F.forall(F.zip_with("form", F.split("masked", " "), lambda c, t: c.isNull() | c.eqNullSafe(t)), lambda x: x)
    named = matched.where(agrees).select("line", F.xxhash64("leaf", F.lit("template")).alias("template"))
    used = salted_join(rows.select("doc_id", "line", "context"), named.join(alone.select("line", "rows"), "line"), "line", F.col("doc_id"), "rows").where("template IS NOT NULL")
    found = used.groupBy("template", "context").agg(F.min("doc_id").alias("doc_id"))
    recurring = found.groupBy("template").agg(F.count("*").alias("contexts"), F.min("doc_id").alias("first_doc")).where(F.col("contexts") >= min_contexts)
    by_template = named.join(recurring, "template").select("line", "first_doc").join(alone.select("line", "rows"), "line")
    by_itself = alone.where(F.col("copies") >= min_contexts).select("line", "first_doc", "rows")
    out = stored(by_itself.union(by_template).groupBy("line").agg(F.min("first_doc").alias("first_doc"), F.max("rows").alias("rows")))
    discard(alone, crowded, distinct)
    return out


def dropped_lines(docs: DataFrame, depth: int = 3, min_contexts: int = 8, **options) -> DataFrame:
    """doc_id, drop: the places of the lines that go."""
    rows = stored(parsed_lines(docs, depth))
    found = templates(rows, min_contexts, **options)
    hit = salted_join(rows.select("doc_id", "pos", "line"), found, "line", F.col("doc_id"), "rows").where("first_doc IS NOT NULL AND doc_id <> first_doc")
    drops = stored(hit.groupBy("doc_id").agg(F.collect_set("pos").alias("drop")))
    discard(rows, found)
    return drops


def _kept(text: Column, drop: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(drop, i)), "\n")


def _with_drops(docs: DataFrame, **options) -> DataFrame:
    """_row: the whole row of docs, _drop: the places of its lines that go, null where none does."""
    found = dropped_lines(docs.select("doc_id", "text"), **options).select(F.col("doc_id").alias("_id"), F.col("drop").alias("_drop"))
    places = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("_drop")), F.lit(0)).alias("places")).first()
    if places.n <= MOST_SENT and places.places <= 8 * MOST_SENT:
        # A few megabytes spare the texts a shuffle.
        found = F.broadcast(found)
    return docs.select(F.struct("*").alias("_row")).join(found, F.col("_row.doc_id") == F.col("_id"), "left").drop("_id")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    rows = _with_drops(docs.select("doc_id", "text"), **options).select("_row.doc_id", "_row.text", F.col("_drop").alias("drop"))
    text = F.coalesce(F.when(F.col("drop").isNotNull(), _kept(F.col("text"), F.col("drop"))).otherwise(F.col("text")), F.lit(""))
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(lines).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(text, 256).alias("kept_sha256"))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without their recurring lines; n_chars, if it is there, follows the text; documents left without text go."""
    text, kept = F.col("_row.text"), _kept(F.col("_row.text"), F.col("_drop"))
    rows = _with_drops(docs, **options).withColumn("_text", F.when(F.col("_drop").isNotNull(), kept).otherwise(text)).where("_drop IS NULL OR trim(_text) <> ''")
    changed = {"text": F.col("_text"), "n_chars": F.when(F.col("_drop").isNotNull(), F.length("_text")).otherwise(F.col("_row").getField("n_chars") if "n_chars" in docs.columns else None)}
    return rows.select(*[(changed[c].cast(t) if c in changed else F.col("_row").getField(c)).alias(c) for c, t in docs.dtypes])
