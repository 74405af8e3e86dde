"""Language identification of words and mixed-language spans (operator 4).

Words are maximal runs of letters, and marks between them. The script of a word, from ranges of code points, leaves the
languages whose training words use that script; among these a word scores by hashed character n-grams (naive Bayes with
add-one-half smoothing). Viterbi over the words of a document, with a penalty for every switch of language, labels
spans. A document's language is the one whose spans hold most letters; its score is that share of all letters.

Training reads at most about ``train_docs`` labelled documents (a documented bound; a hash of the id picks them), but
counts their whole texts, on the executors. What reaches the driver is one table of n-gram counts of fixed size for
each learned language; languages are taken to be a small dimension.

A slice of texts is one array of code points. Its distinct words are scored once, and their scores are kept for the
next slices. Viterbi runs over all documents of a slice at once, word by word; as the penalty is the same for all
switches, a step needs the best label only.

Defined cases: null or letterless texts are ``und`` with score 0; ties go to the language that sorts first; repeated
rows each get their result; with no labelled document everything is ``und``; a text of any length is read whole;
other columns play no part, but none of the rows given to ``predict`` may have the names of the columns it adds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches
from .text import Slice, mix, powers, runs, slices, span_hashes

BITS = 16
#: Bytes of text that are scored at once: a hundred times as many bytes of memory, about.
SLICE = 1_000_000
#: First and last code point of the ranges that name a script, in order of code points.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1E00, 0x1EFF, "latin"), (0x3040, 0x30FF, "kana"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
]
SCRIPTS = ["other", *dict.fromkeys(s for _, _, s in SCRIPT_RANGES)]
_STARTS = np.array([a for a, _, _ in SCRIPT_RANGES], np.int64)
_ENDS = np.array([b for _, b, _ in SCRIPT_RANGES], np.int64)
_NAMES = np.array([SCRIPTS.index(s) for _, _, s in SCRIPT_RANGES])
#: Letters stand below this code point; what lies above it counts as no letter.
_LAST = 0x34000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, is it a letter or mark, and its lower case (itself if that isn't one letter)."""
    every = [chr(i) for i in range(_LAST)]
    letter = np.fromiter((c.isalpha() for c in every), bool, _LAST)
    mark = np.fromiter((unicodedata.category(c)[0] == "M" for c in every), bool, _LAST)
    lower = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in every), np.uint32, _LAST)
    return letter, letter | mark, lower


class Words:
    """The words of a slice: doc, start, end (code points from the document's start), letters; name: which distinct word."""

    def __init__(self, part: Slice):
        letter, inside, lower = _tables()
        firsts = (part.data & 0xC0) != 0x80
        points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        at = np.append(0, np.cumsum(firsts))
        low, high = at[part.start], at[part.end]
        if len(points) != at[-1]:  # bytes that aren't UTF-8
            texts = [part.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(part.start.tolist(), part.end.tolist(), strict=True)]
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            high = np.cumsum([len(t) for t in texts])
            low = np.append(0, high[:-1])
        points = np.minimum(points, _LAST - 1)
        member = inside[points]
        before, after = np.append(False, member[:-1]), np.append(member[1:], False)
        full = high > low
        before[low[full]] = False
        after[high[full] - 1] = False
        start, end = np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1
        count = np.append(0, np.cumsum(letter[points]))
        some = count[end] > count[start]
        start, end = start[some], end[some]
        self.letters = count[end] - count[start]
        self.doc = np.searchsorted(low, start, "right") - 1
        self.start, self.end = start - low[self.doc], end - low[self.doc]
        self.points = lower[points]
        up, _ = powers(len(points) + 1)
        prefix = np.append(np.uint64(0), np.cumsum(mix(self.points.astype(np.uint64) + np.uint64(1)) * up[:-1]))
        self.hashes, first, self.name = np.unique(span_hashes(prefix, start, end), return_index=True, return_inverse=True)
        self._at = start[first], end[first]

    def grams(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these distinct words: hashed n-grams (1 to 4 characters, with the word's edges), the word of each, each word's script."""
        start, end = self._at[0][which], self._at[1][which]
        lengths = end - start + 2
        last = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(which)), lengths)
        points = self.points[np.clip(np.arange(int(lengths.sum())) - np.repeat(last - lengths + 1 - start, lengths), 0, len(self.points) - 1)].astype(np.uint64)
        points[last - lengths], points[last - 1] = 2, 3
        grams, owners = [], []
        key = np.zeros(len(points), np.uint64)
        for n in range(1, 5):
            key = key[: len(points) - n + 1] * np.uint64(0x110000) + points[n - 1 :]
            whole = owner[: len(key)] == owner[n - 1 :]
            if n == 1:
                whole &= points > 3
            grams.append((mix(key[whole] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int32))
            owners.append(owner[: len(key)][whole])
        first = self.points[start].astype(np.int64)
        at = np.maximum(np.searchsorted(_STARTS, first, "right") - 1, 0)
        script = np.where((first >= _STARTS[at]) & (first <= _ENDS[at]), _NAMES[at], 0)
        return np.concatenate(grams), np.concatenate(owners), script


class Model:
    """Log-likelihood of every n-gram for each language, and which scripts each language uses."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray, switch: float):
        self.languages, self.switch = languages, switch
        total = counts.sum(1, keepdims=True)
        self.table = np.ascontiguousarray(np.log((counts + 0.5) / (total + 0.5 * counts.shape[1])).T.astype(np.float32))
        # A script counts for a language from one word in two hundred; a script that none uses leaves all of them.
        uses = scripts >= 0.005 * np.maximum(scripts.sum(1, keepdims=True), 1)
        uses &= scripts > 0
        self.barred = np.where(uses.T | ~uses.any(0)[:, None], 0.0, -1e4).astype(np.float32)

    def scores(self, words: Words, which: np.ndarray) -> np.ndarray:
        grams, owner, script = words.grams(which)
        out = np.empty((len(which), len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.table[grams, k], len(which))
        out -= out.max(1, keepdims=True)
        return out + self.barred[script]


class Scorer:
    """Scores of distinct words, kept from one slice to the next, of about ``most`` words."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros((0, len(model.languages)), np.float32)

    def __call__(self, words: Words) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, words.hashes), max(len(self.keys) - 1, 0))
        known = self.keys[at] == words.hashes if len(self.keys) else np.zeros(len(words.hashes), bool)
        out = np.empty((len(words.hashes), self.rows.shape[1]), np.float32)
        out[known] = self.rows[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.model.scores(words, new)
            if len(self.keys) + len(new) > self.most:
                self.keys, self.rows = words.hashes[: self.most], out[: self.most]
            else:
                keys = np.append(self.keys, words.hashes[new])
                order = np.argsort(keys)
                self.keys, self.rows = keys[order], np.concatenate([self.rows, out[new]])[order]
        return out[words.name]


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """Best labels of the words of documents scores[bounds[i]:bounds[i + 1]], which hold one word at least."""
    n_labels, lengths = scores.shape[1], np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, size = bounds[:-1][order], lengths[order]
    live = np.searchsorted(-size, -np.arange(int(size.max())), "left")  # documents longer than t words come first
    stays = np.zeros((len(scores), n_labels), bool)
    came = np.zeros(len(scores), np.int32)
    now, every = np.zeros((len(begin), n_labels)), np.arange(len(begin))
    for t, n in enumerate(live.tolist()):
        own, at = now[:n], begin[:n] + t
        if t:
            best = own.argmax(1)
            top = (own[every[:n], best] - switch)[:, None]
            stays[at] = own >= top
            came[at] = best
            np.maximum(own, top, out=own)
        own += scores[at]
    labels, label = np.zeros(len(scores), np.int32), now.argmax(1).astype(np.int32)
    for t in range(len(live) - 1, -1, -1):
        at = begin[: live[t]] + t
        own = label[: live[t]]
        labels[at] = own
        label[: live[t]] = np.where(stays[at, own], own, came[at])
    return labels


def _counter(languages: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), (1 << BITS) + len(SCRIPTS)), np.int64)
        for part in slices(batches, "text", SLICE // 2):
            own = pa.compute.index_in(part.batch.column(1), pa.array(languages, pa.string())).to_numpy(zero_copy_only=False)
            words = Words(part)
            if not len(words.name):
                continue
            grams, owner, script = words.grams(np.arange(len(words.hashes)))
            for k in np.unique(own[words.doc]).astype(int):
                n = np.bincount(words.name[own[words.doc] == k], minlength=len(words.hashes)).astype(np.float64)
                counts[k, : 1 << BITS] += np.bincount(grams, n[owner], 1 << BITS).astype(np.int64)
                counts[k, 1 << BITS :] += np.bincount(script, n, len(SCRIPTS)).astype(np.int64)
        k, gram = np.nonzero(counts)
        if len(k):
            yield pa.RecordBatch.from_pydict({"k": k.astype(np.int32), "gram": gram.astype(np.int32), "n": counts[k, gram]})

    return count


def fold(doc_id: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(-1))


def train(docs: DataFrame, train_docs: int = 8000, switch: float = 12.0) -> Model | None:
    """Learn from (text, lang) of docs; about train_docs documents, chosen by a hash, are read."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_language = labelled.groupBy("lang").count().collect()
    if not by_language:
        return None
    languages = sorted(r["lang"] for r in by_language)
    each = max(1, train_docs // len(languages))
    share = F.create_map(*[x for r in by_language for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["count"])))])
    chosen = labelled.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    rows = chosen.select("text", "lang").mapInArrow(_counter(languages), "k int, gram int, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), (1 << BITS) + len(SCRIPTS)), np.int64)
    counts[rows["k"].to_numpy(), rows["gram"].to_numpy()] = rows["n"].to_numpy()
    return Model(languages, counts[:, : 1 << BITS], counts[:, 1 << BITS :], switch)


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def _labeller(shared, spans: bool):
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer, n_labels = Scorer(model), len(model.languages)
        # Words times languages bound the memory of a slice.
        for part in slices(batches, "_text", max(100_000, min(SLICE, 80_000_000 // n_labels))):
            words, n = Words(part), len(part)
            names, score = np.full(n, "und", object), np.zeros(n)
            first = last = own = np.zeros(0, np.int64)
            if len(words.doc):
                some = runs(words.doc)
                bounds = np.append(some, len(words.doc))
                labels = viterbi(scorer(words), bounds, model.switch)
                doc = np.repeat(np.arange(len(some)), np.diff(bounds))
                letters = np.bincount(doc * n_labels + labels, words.letters, len(some) * n_labels).reshape(-1, n_labels)
                best = letters.argmax(1)
                names[words.doc[some]] = np.array(model.languages, object)[best]
                score[words.doc[some]] = letters[np.arange(len(some)), best] / letters.sum(1)
                first = np.flatnonzero(np.append(True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])))
                last, own = np.append(first[1:], len(labels)) - 1, labels[first]
            columns = {name: part.batch.column(i) for i, name in enumerate(part.batch.schema.names) if name != "_text"}
            columns |= {"lang_pred": pa.array(names, pa.string()), "score": pa.array(score)}
            if spans:
                values = pa.StructArray.from_arrays([pa.array(words.start[first], pa.int32()), pa.array(words.end[last], pa.int32()), pa.array(model.languages, pa.string()).take(pa.array(own))], ["start", "end", "lang"])
                columns["spans"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(words.doc[first], minlength=n))), pa.int32()), values)
            yield pa.RecordBatch.from_pydict(columns)

    return label


def predict(rows: DataFrame, text: Column, model: Model | None, spans: bool = False) -> DataFrame:
    """rows with lang_pred and score, and with spans (code points, end exclusive) if asked for."""
    added = ["_text", "lang_pred", "score", *["spans"] * spans]
    if clash := {c.lower() for c in rows.columns} & set(added):
        raise ValueError(f"rows already have columns {sorted(clash)}")
    small_batches(rows.sparkSession)
    if model is None:
        out = rows.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
        return out.withColumn("spans", F.array().cast(SPAN)) if spans else out
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    schema = schema.add(T.StructField("spans", SPAN)) if spans else schema
    return rows.withColumn("_text", text).mapInArrow(_labeller(shared, spans), schema)


def held_out_predictions(docs: DataFrame, train_docs: int = 8000) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (start:end:language, comma-joined). Fold 0 takes no part in training."""
    rest = fold(F.col("doc_id"))
    model = train(docs.where(rest != 0), train_docs)
    out = predict(docs.select("doc_id", (rest == 0).alias("held_out"), F.col("text").alias("_t")), F.col("_t"), model, spans=True)
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["lang"])), ",")
    return out.select("doc_id", "held_out", "lang_pred", "score", spans.alias("spans"))


def reject_documents(docs: DataFrame, least: float = 0.5, train_docs: int = 8000) -> DataFrame:
    """docs without those that have no language or whose main language holds less than half of the letters."""
    model = train(docs.where(fold(F.col("doc_id")) != 0), train_docs)
    found = predict(docs.select(F.struct("*").alias("doc")), F.col("doc.text"), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("doc.*")
