"""Secret scans with a character convolutional network (operator 3).

Base findings come from three patterns over every whole text. Every other token that could be a secret (16 or more of
``[A-Za-z0-9+/_=-]`` with a letter and a digit) is a candidate. A small convolutional network reads the bytes of a
candidate and of its surroundings and decides whether it becomes a span of kind ``cnn``. A token longer than a window
is read in overlapping windows over its whole length, in training too; the highest score is the token's.

The network is trained on the tokens of all documents that have 8 or more bytes: base findings are labelled secrets,
other tokens of the texts are not (candidates only if a first fit, made without them, finds them unlike secrets). Half of the examples are
moved into plain surroundings, so that the network can't lean on keywords alone. Its scores are calibrated on held-out findings by a
logistic fit. The threshold keeps 0.98 of the held-out secrets: it is the largest that does, or half way down to the
next other token where the two are apart.

Up to ``most`` windows of each label are learned from in numpy on the driver. With more of them, such a fit on about
``most`` of each label (a hash of the document's id and the token's place picks them) is only where the training starts,
and its plain surroundings are those that examples are moved into: then each round of L-BFGS sums loss and gradient over
the windows of all tokens in Spark tasks, and slope, shift and threshold come from the counted scores of all held-out
tokens, a fifth by a hash.

All patterns are ASCII, so bytes are scanned and positions are turned into code points (end exclusive).
Defined cases: null and empty texts have no spans; overlapping spans of different kinds all count; repeated rows each
get their result; with fewer than ``least`` findings or without other tokens to learn from no spans are added; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .text import mix, slices

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_KEYWORDS = (b"passw", b"secret", b"token", b"api")
_LETTER, _DIGIT, _HEX, _TOKEN = (np.zeros(256, bool) for _ in range(4))
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_HEX[48:58] = _HEX[97:103] = True
_TOKEN[:] = _LETTER | _DIGIT
for _c in b"+/_=-":
    _TOKEN[_c] = True
AROUND, INSIDE = 16, 48
WIDTH = 2 * AROUND + INSIDE


def _runs(part, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    start, end, _ = part.words(part.data, member)
    keep = end - start >= least
    return start[keep], end[keep]


def _holding(part, raw: bytes, keys: tuple[bytes, ...]) -> list[int]:
    """The documents in which one of the keys starts."""
    out = set()
    for key in keys:
        at = raw.find(key)
        while at >= 0:
            i = int(np.searchsorted(part.start, at, "right")) - 1
            out.add(i)
            at = raw.find(key, int(part.end[i]))
    return sorted(out)


def find_base(part) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) in bytes from the slice's start, for each document."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(part))]
    raw = part.data.tobytes()
    for i in _holding(part, raw.lower(), _KEYWORDS):
        out[i] += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(raw, int(part.start[i]), int(part.end[i])) if len(m[2]) >= 8]
    for i in _holding(part, raw, (b"AKIA",)):
        out[i] += [(m.start(), m.end(), 1) for m in ACCESS.finditer(raw, int(part.start[i]), int(part.end[i])) if m.end() - m.start() >= 16]
    start, end = _runs(part, _HEX, 32)
    for i, s, e in zip((np.searchsorted(part.start, start, "right") - 1).tolist(), start.tolist(), end.tolist(), strict=True):
        out[i].append((s, e, 2))
    return out


def find_candidates(part, base: list[list[tuple[int, int, int]]], least: int = 16) -> list[list[tuple[int, int]]]:
    start, end = _runs(part, _TOKEN, least)
    digits, letters = (np.append(0, np.cumsum(m[part.data])) for m in (_DIGIT, _LETTER))
    keep = (digits[end] > digits[start]) & (letters[end] > letters[start])
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(part))]
    for i, s, e in zip((np.searchsorted(part.start, start[keep], "right") - 1).tolist(), start[keep].tolist(), end[keep].tolist(), strict=True):
        if not any(s < y and x < e for x, y, _ in base[i]):
            out[i].append((s, e))
    return out


def window(raw: bytes, low: int, high: int, start: int, end: int) -> bytes:
    """The token's bytes and what stands around them in its document, padded with zeros to a fixed width.

    A token of more than INSIDE bytes gives several windows, one after the other, each half over the one before.
    """
    starts = [*range(start, end - INSIDE, INSIDE // 2), end - INSIDE] if end - start > INSIDE else [start]
    out = []
    for s in starts:
        e = min(end, s + INSIDE)
        out += [raw[max(low, s - AROUND) : s].rjust(AROUND, b"\0"), raw[s:e].ljust(INSIDE, b"\0"), raw[e : min(high, e + AROUND)].ljust(AROUND, b"\0")]
    return b"".join(out)


def pieces(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The single windows of all tokens, and how many each token has."""
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WIDTH), np.array([len(w) // WIDTH for w in windows], np.int64)


def elsewhere(x: np.ndarray, plain: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The candidates of x in the surroundings of tokens that aren't secrets."""
    return elsewhere_in(x, plain[rng.integers(0, len(plain), len(x))])


def elsewhere_in(x: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The candidates of x, each in the surroundings of its row of other."""
    return np.concatenate([other[:, :AROUND], x[:, AROUND : AROUND + INSIDE], other[:, AROUND + INSIDE :]], 1)


class CharCNN:
    """Embedding, convolution of width 5, ReLU, maximum over places, one logistic unit; calibrated."""

    def __init__(self, seed: int = 7, size: int = 8, filters: int = 24, width: int = 5):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {"e": rng.normal(0, 0.3, (128, size)), "k": rng.normal(0, 0.2, (width * size, filters)), "b": np.zeros(filters), "w": rng.normal(0, 0.2, filters), "c": np.zeros(1)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        e = self.p["e"][x]
        n = x.shape[1] - self.width + 1
        patches = np.concatenate([e[:, i : i + n] for i in range(self.width)], 2)
        h = patches @ self.p["k"] + self.p["b"]
        at = h.argmax(1)
        top = np.take_along_axis(h, at[:, None, :], 1)[:, 0]
        return patches, at, top, np.maximum(top, 0) @ self.p["w"] + self.p["c"][0]

    def logits(self, windows: list[bytes]) -> np.ndarray:
        """The highest of each token's windows."""
        x, n = pieces(windows)
        z = np.concatenate([self._forward(np.minimum(x[i : i + 512], 127))[3] for i in range(0, len(x), 512)])
        return np.maximum.reduceat(z, np.cumsum(n) - n)

    def score(self, windows: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.logits(windows) + self.shift)))

    def fit(self, windows: list[bytes], labels: np.ndarray, steps: int = 600, rate: float = 0.01, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        x, n = pieces(windows)
        x, labels = np.minimum(x, 127), np.repeat(labels, n)
        t, plain = 0, np.flatnonzero(labels == 0)
        m, v = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}
        weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))
        batches = max(1, len(x) // 128)
        for _ in range(-(-steps // batches)):
            for some in np.array_split(rng.permutation(len(x)), batches):
                b = x[some].copy()
                swapped = np.flatnonzero(rng.random(len(b)) < 0.5)
                b[swapped] = elsewhere(b[swapped], x[plain], rng)
                patches, at, top, z = self._forward(b)
                dz = (1 / (1 + np.exp(-z)) - labels[some]) * weight[some] / len(b)
                g = {"w": np.maximum(top, 0).T @ dz, "c": np.array([dz.sum()])}
                dtop = dz[:, None] * self.p["w"] * (top > 0)
                chosen = np.take_along_axis(patches[:, :, :, None], at[:, None, None, :], 1)[:, 0]  # rows x patch x filters
                g["k"], g["b"] = np.einsum("npf,nf->pf", chosen, dtop), dtop.sum(0)
                dpatch = np.einsum("nf,pf->nfp", dtop, self.p["k"]).reshape(len(b), -1, self.width, self.p["e"].shape[1])
                g["e"] = np.zeros_like(self.p["e"])
                for i in range(self.width):
                    np.add.at(g["e"], np.take_along_axis(b, at + i, 1), dpatch[:, :, i])
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, windows: list[bytes], labels: np.ndarray, recall: float) -> None:
        # Each finding counts in its own and in plain surroundings, as candidates mostly lack the keywords of findings.
        x, n = pieces(windows)
        plain = np.repeat(labels == 0, n)
        moved = elsewhere(x, x[plain], np.random.default_rng(1)) if plain.any() else x
        windows, labels = windows + [r.tobytes() for r in np.split(moved, np.cumsum(n)[:-1])], np.concatenate([labels, labels])
        self.calibrate_scores(self.logits(windows), labels, np.ones(len(labels)), recall)

    def calibrate_scores(self, z: np.ndarray, labels: np.ndarray, times: np.ndarray, recall: float) -> None:
        """``times`` tokens of a label have the logit z."""
        for _ in range(200):  # logistic fit of slope and shift by gradient steps
            d = 1 / (1 + np.exp(-(self.slope * z + self.shift))) - labels
            self.slope -= 0.05 * float(np.average(d * z, weights=times))
            self.shift -= 0.05 * float(np.average(d, weights=times))
        z = self.slope * z + self.shift
        secrets, others = np.sort(z[labels == 1]), z[labels == 0]
        upto = np.cumsum(times[labels == 1][np.argsort(z[labels == 1])])
        limit = secrets[np.searchsorted(upto, int((1 - recall) * upto[-1]), "right")] if len(secrets) else np.inf
        # Any threshold between the others and the limit keeps the recall; the middle leaves both sides most room.
        best = (limit + others.max()) / 2 if len(others) and others.max() < limit else limit
        self.threshold = float(1 / (1 + np.exp(-best)))


#: So many windows at a time stay in the processor's cache.
CHUNK = 256


class Quick:
    """The network's loss and gradient for many windows: what pairs of bytes add to the filters is looked up."""

    def __init__(self, model: CharCNN):
        self.p, self.width = model.p, model.width
        k = self.p["k"].reshape(self.width, -1, self.p["k"].shape[1])
        t = (self.p["e"] @ k).astype(np.float32)
        t[-1] += self.p["b"].astype(np.float32)
        self.tables = [(a[:, None] + b[None]).reshape(-1, a.shape[1]) for a, b in zip(t[:-1:2], t[1::2], strict=True)]
        self.last, self.filters = t[-1], t.shape[2]
        self.row, self.column = np.indices((CHUNK, self.filters)).reshape(2, -1)

    def _filters(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - self.width + 1
        at = x.astype(np.int64)
        pairs = at[:, :-1] * 128 + at[:, 1:]
        h = self.last.take(at[:, self.width - 1 :], 0)
        for i, table in enumerate(self.tables):
            h += table.take(pairs[:, 2 * i : 2 * i + n], 0)
        return h

    @staticmethod
    def _tops(h: np.ndarray) -> list[np.ndarray]:
        """Maxima over places, by halves that may share a place: the last has one place left."""
        levels = [h]
        while levels[-1].shape[1] > 1:
            half = -(-levels[-1].shape[1] // 2)
            levels.append(np.maximum(levels[-1][:, :half], levels[-1][:, -half:]))
        return levels

    def _place(self, levels: list[np.ndarray], one: np.ndarray) -> np.ndarray:
        """A place that has the maximum, for these of all rows' filters, from the last half to the first."""
        f, row, column = self.filters, self.row.take(one), self.column.take(one)
        at, top = np.zeros(len(one), np.int64), levels[-1].ravel().take(one)
        for h, halved in zip(levels[-2::-1], levels[:0:-1], strict=True):
            at += (h.ravel().take((row * h.shape[1] + at) * f + column) != top) * (h.shape[1] - halved.shape[1])
        return at

    def short(self, x: np.ndarray, around: Surroundings | None = None, which: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of windows of about one length, and the windows without zeros that only repeat a place of nothing but zeros.

        With other surroundings the places that reach into the token are left, as the others are looked up; no token may fill
        its place then.
        """
        used = _used(x)
        order = np.argsort(used.astype(np.uint8), kind="stable")
        for i in range(0, len(x), CHUNK):
            some = order[i : i + CHUNK]
            kept = AROUND + min(INSIDE, int(used[some[-1]]) + self.width)
            if around is None:
                yield some, np.concatenate([x[some, :kept], x[some, AROUND + INSIDE :]], 1)
            else:
                yield some, np.concatenate([around.plain[which[some], AROUND - self.width + 1 : AROUND], x[some, AROUND:kept]], 1)

    def logits(self, x: np.ndarray, around: Surroundings | None = None, which: np.ndarray | None = None) -> np.ndarray:
        """Of single windows, or of their tokens in these of other surroundings."""
        z = np.zeros(len(x))
        for at, windows, looked_up, place in _shown(x, around, which):
            for rows, short in self.short(windows, looked_up, place):
                top = self._tops(self._filters(short))[-1][:, 0]
                for _, tops, _ in looked_up.sides if looked_up else ():
                    top = np.maximum(top, tops[place[rows]])
                z[at[rows]] = np.maximum(top, 0).astype(np.float64) @ self.p["w"] + self.p["c"][0]
        return z

    def best(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row and filter the maximum over places, and a place that has it."""
        top, at = np.zeros((len(x), self.filters), np.float32), np.zeros((len(x), self.filters), np.int64)
        for i in range(0, len(x), CHUNK):
            levels = self._tops(self._filters(x[i : i + CHUNK]))
            top[i : i + CHUNK] = levels[-1][:, 0]
            at[i : i + CHUNK] = self._place(levels, np.arange(levels[-1].size)).reshape(-1, self.filters)
        return top, at

    def sums(self, x: np.ndarray, label: int) -> np.ndarray:
        """Loss, number of windows and gradient (as ``flat`` orders the parameters), summed over windows of one label."""
        out = Sums(self, label)
        out.add(x)
        return out.total()


def _used(x: np.ndarray) -> np.ndarray:
    """How many bytes of a window's token aren't zeros at its end (all, if there is none else)."""
    return INSIDE - (x[:, AROUND : AROUND + INSIDE] != 0)[:, ::-1].argmax(1)


class Surroundings:
    """Windows that tokens are moved into: what the filters find before and after a token is the same for every token."""

    def __init__(self, quick: Quick, plain: np.ndarray):
        self.plain = plain
        zeros = np.zeros((len(plain), quick.width - 1), np.uint8)
        self.sides = [(x, *quick.best(x)) for x in (plain[:, :AROUND], np.concatenate([zeros, plain[:, AROUND + INSIDE :]], 1))]
        self.room = INSIDE - quick.width  # bytes of a token that leaves a place of nothing but zeros after it


def _shown(x: np.ndarray, around: Surroundings | None, which: np.ndarray | None):
    """Rows, their windows, the surroundings to look up and which of them: tokens too long for that are really moved."""
    if which is None:
        yield np.arange(len(x)), x, None, None
        return
    fits = _used(x) <= around.room
    yield np.flatnonzero(fits), x[fits], around, which[fits]
    if not fits.all():
        yield np.flatnonzero(~fits), elsewhere_in(x[~fits], around.plain[which[~fits]]), None, None


class Sums:
    """Loss, number of windows and gradient of one label, summed over windows in their own and in other surroundings."""

    def __init__(self, quick: Quick, label: int, around: Surroundings | None = None):
        self.quick, self.label, self.around = quick, label, around
        f = quick.filters
        self.loss, self.n, self.w, self.c = 0.0, 0, np.zeros(f), 0.0
        self.tables = np.zeros((quick.width, 128 * f))
        self.sides = [np.zeros(len(around.plain) * f) if around else np.zeros(0) for _ in range(2)]

    def _spread(self, x: np.ndarray, first: np.ndarray, column: np.ndarray, weight: np.ndarray) -> None:
        """To the bytes from a first one on (as an index of all of x)."""
        f, x = self.quick.filters, x.ravel()
        for j, table in enumerate(self.tables):
            table += np.bincount(x.take(first + j).astype(np.int64) * f + column, weight, 128 * f)

    def add(self, x: np.ndarray, which: np.ndarray | None = None) -> None:
        """Windows as they are, or their tokens in these of the other surroundings."""
        quick, sign = self.quick, 1 - 2 * self.label
        self.n += len(x)
        for _, windows, looked_up, place in _shown(x, self.around, which):
            for rows, short in quick.short(windows, looked_up, place):
                levels = quick._tops(quick._filters(short))
                middle = top = levels[-1][:, 0]
                beside = [tops[place[rows]] for _, tops, _ in looked_up.sides] if looked_up else []
                for tops in beside:
                    top = np.maximum(top, tops)
                positive = np.maximum(top, 0)
                z = positive.astype(np.float64) @ quick.p["w"] + quick.p["c"][0]
                self.loss += float(np.logaddexp(0, sign * z).sum())
                dz = sign / (1 + np.exp(-sign * z))
                self.w += positive.T @ dz
                self.c += float(dz.sum())
                dtop, left = (dz[:, None] * quick.p["w"]).ravel(), top > 0
                here = left & (middle == top)
                one = np.flatnonzero(here)
                self._spread(short, quick.row.take(one) * short.shape[1] + quick._place(levels, one), quick.column.take(one), dtop.take(one))
                for tops, side in zip(beside, self.sides, strict=False):
                    left = left & ~here
                    here = left & (tops == top)
                    one = np.flatnonzero(here)
                    np.add.at(side, place[rows].take(quick.row.take(one)) * quick.filters + quick.column.take(one), dtop.take(one))

    def total(self) -> np.ndarray:
        """As ``Quick.sums``; what was looked up goes to its bytes only now, once for all windows."""
        quick, f = self.quick, self.quick.filters
        for side, (x, _, at) in zip(self.sides, self.around.sides if self.around else (), strict=False):
            some = np.flatnonzero(side)
            self._spread(x, some // f * x.shape[1] + at.ravel()[some], some % f, side[some])
            side[:] = 0
        t = self.tables.reshape(quick.width, 128, f)
        k = quick.p["k"].reshape(quick.width, -1, f)
        g = {"e": sum(a @ b.T for a, b in zip(t, k, strict=True)), "k": quick.p["e"].T @ t, "b": t[0].sum(0), "w": self.w, "c": np.array([self.c])}
        return np.concatenate([[self.loss, self.n], *(g[name].ravel() for name in quick.p)])


def flat(model: CharCNN) -> np.ndarray:
    return np.concatenate([v.ravel() for v in model.p.values()])


def with_parameters(model: CharCNN, values: np.ndarray) -> CharCNN:
    """A network of the same shape with these parameters, not yet calibrated."""
    out = CharCNN(width=model.width)
    cuts = np.cumsum([v.size for v in model.p.values()])[:-1]
    out.p = {k: part.reshape(v.shape) for (k, v), part in zip(model.p.items(), np.split(values, cuts), strict=True)}
    return out


def all_windows(part, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``window`` gives for many tokens of a slice, with the token of each window."""
    n = np.where(end - start > INSIDE, -(-(end - start - INSIDE) // (INSIDE // 2)) + 1, 1)
    of = np.repeat(np.arange(len(start)), n)
    s = start[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * (INSIDE // 2)
    s = np.minimum(s, np.maximum(start[of], end[of] - INSIDE))
    e = np.minimum(end[of], s + INSIDE)
    padded = np.concatenate([np.zeros(AROUND, np.uint8), np.minimum(part.data, 127), np.zeros(WIDTH, np.uint8)])
    x = np.empty((len(of), WIDTH), np.uint8)
    x[:, :-AROUND] = np.lib.stride_tricks.sliding_window_view(padded, WIDTH - AROUND)[s]
    x[:, -AROUND:] = np.lib.stride_tricks.sliding_window_view(padded, AROUND)[e + AROUND]
    # Bytes before and after the document, and after the token within its place, are zeros.
    column = np.arange(WIDTH, dtype=np.int16)
    before, inside, after = (np.minimum(v, WIDTH).astype(np.int16)[:, None] for v in (s - part.start[row[of]], e - s, part.end[row[of]] - e))
    x[:, :AROUND] *= column[:AROUND] >= AROUND - before
    x[:, AROUND:-AROUND] *= column[:INSIDE] < inside
    x[:, -AROUND:] *= column[:AROUND] < after
    return x, of


def _tokens(part, base: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, end, label and number of windows of what can be learned from: values of base findings (1) and all other tokens of 8 bytes or more (0; candidates: 2)."""
    raw, found = part.data.tobytes(), [x for own in base for x in own]
    start, end = _runs(part, _TOKEN, 8)
    free = np.ones(len(start), bool)
    for s, e, _ in found:
        free[np.searchsorted(end, s, "right") : np.searchsorted(start, e, "left")] = False
    start, end = start[free], end[free]
    open_ = end - start >= 16
    if open_.any():
        size = (end - start)[open_]
        first = np.cumsum(size) - size
        inside = part.data[np.arange(size.sum()) + np.repeat(start[open_] - first, size)]
        open_[open_] = np.logical_or.reduceat(_DIGIT[inside], first) & np.logical_or.reduceat(_LETTER[inside], first)
    values = np.array([(ASSIGN.match(raw, s, e).start(2) if kind == 0 else s, e) for s, e, kind in found], np.int64).reshape(-1, 2)
    start, end = np.append(values[:, 0], start), np.append(values[:, 1], end)
    label = np.append(np.ones(len(values), np.int64), np.where(open_, 2, 0))
    return start, end, label, np.where(end - start > INSIDE, -(-(end - start - INSIDE) // (INSIDE // 2)) + 1, 1)


def _drawn(part, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each token and a hash of the document's id and the token's place in it."""
    row = np.searchsorted(part.start, start, "right") - 1
    ids = part.batch.column(0).fill_null(0).to_numpy().astype(np.uint64)[row]
    return row, mix(mix(ids + np.uint64(1)) + (start - part.start[row]).astype(np.uint64))


def _held(drawn: np.ndarray) -> np.ndarray:
    return mix(drawn + np.uint64(5)) % np.uint64(5) == 0


def _count_examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, windows = np.zeros(3, np.int64), np.zeros(3, np.int64)
    for part in slices(batches):
        _, _, label, n = _tokens(part, find_base(part))
        tokens += np.bincount(label, minlength=3)
        windows += np.bincount(label, n, 3).astype(np.int64)
    yield pa.RecordBatch.from_pydict({"label": np.arange(3, dtype=np.int32), "tokens": tokens, "windows": windows})


def _take_examples(limits: list[float]):
    """Windows of the tokens whose hash is below their label's limit."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            start, end, label, _ = _tokens(part, find_base(part))
            row, drawn = _drawn(part, start)
            some = np.flatnonzero((drawn >> np.uint64(11)) < np.array(limits)[label] * 2.0**53)
            raw = part.data.tobytes()
            windows = [window(raw, int(part.start[row[i]]), int(part.end[row[i]]), int(start[i]), int(end[i])) for i in some]
            yield pa.RecordBatch.from_pydict({"window": pa.array(windows, pa.binary()), "label": pa.array(label[some], pa.int32()), "held": pa.array(_held(drawn[some]))})

    return take


def _examples(docs: DataFrame, most: int) -> tuple[list[bytes], np.ndarray, np.ndarray, dict[int, tuple[int, int]]]:
    """Windows, labels and whether they are held out of what ``examples`` describes; tokens and windows of each label."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    summed = texts.mapInArrow(_count_examples, "label int, tokens long, windows long").groupBy("label").agg(F.sum("tokens").alias("tokens"), F.sum("windows").alias("windows")).collect()
    counts = {k: (0, 0) for k in range(3)} | {r["label"]: (r["tokens"], r["windows"]) for r in summed}
    limits = [min(1.0, most / max(1, counts[k][1])) for k in range(3)]
    rows = texts.mapInArrow(_take_examples(limits), "window binary, label int, held boolean").toArrow().to_pydict()
    different = {(w, k): i for i, (w, k) in enumerate(zip(rows["window"], rows["label"], strict=True))}
    order = sorted(different.values(), key=lambda i: (hashlib.md5(rows["window"][i]).digest(), rows["label"][i]))
    return [rows["window"][i] for i in order], np.array([rows["label"][i] for i in order], np.float64), np.array([rows["held"][i] for i in order], bool), counts


def examples(docs: DataFrame, most: int = 6000) -> tuple[list[bytes], np.ndarray, int]:
    """Different windows and labels of about ``most`` windows of each label, and how many findings or other tokens, the rarer, there are."""
    windows, labels, _, counts = _examples(docs, most)
    return windows, labels, min(counts[0][0], counts[1][0])


def _learned(part, plain: np.ndarray, judge: CharCNN | None, held: bool | None):
    """For labels 0 and 1 the windows of all tokens held out or not (None: both), the plain surroundings they are moved into,
    the token of each, and whether it is shown there.

    Candidates are of label 0 if the judge finds them unlike secrets; others, and all without a judge, have no label.
    """
    start, end, label, _ = _tokens(part, find_base(part))
    row, drawn = _drawn(part, start)
    if judge is not None and (label == 2).any():
        some = np.flatnonzero(label == 2)
        x, of = all_windows(part, row[some], start[some], end[some])
        z = np.full(len(some), -np.inf)
        np.maximum.at(z, of, Quick(judge).logits(x))
        label[some[z < 0]] = 0
    for k in (0, 1):
        some = np.flatnonzero((label == k) & ((held is None) | (_held(drawn) == held)))
        x, of = all_windows(part, row[some], start[some], end[some])
        which = (mix(drawn[some] + np.uint64(7)) % np.uint64(len(plain))).astype(np.int64)[of]
        yield k, x, which, of, (drawn[some] & np.uint64(1) == 1)[of]


def _sum_losses(model: CharCNN, shared, judge: CharCNN | None, held: bool | None):
    """Loss, number of windows and gradient of each label over all tokens held out or not (None: both), as rows of a place and a value."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = Quick(model)
        around = Surroundings(quick, shared.value)
        both = [Sums(quick, k, around) for k in (0, 1)]
        for part in slices(batches):
            for k, x, which, _, swapped in _learned(part, shared.value, judge, held):
                # A finding counts in both surroundings, of the many others each in one.
                own, other = (slice(None), slice(None)) if k == 1 else (~swapped, swapped)
                both[k].add(x[own])
                both[k].add(x[other], which[other])
        out = np.stack([s.total() for s in both])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size), pa.int32()), pa.array(out.ravel())], names=["place", "value"])

    return add


def _count_scores(model: CharCNN, shared, judge: CharCNN | None, held: bool | None):
    """How many held-out tokens of a label, in their own and in plain surroundings, have a logit of (about) so many 1024ths."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = Quick(model)
        around = Surroundings(quick, shared.value)
        for part in slices(batches):
            for k, x, which, of, _ in _learned(part, shared.value, judge, held):
                z = np.full((2, of[-1] + 1 if len(of) else 0), -np.inf)
                for own, shown in zip(z, (quick.logits(x), quick.logits(x, around, which)), strict=True):
                    np.maximum.at(own, of, shown)
                # Findings are rounded down and others up, so that the recall is kept.
                at, n = np.unique(np.floor(z * 1024) if k == 1 else np.ceil(z * 1024), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at.astype(np.int64)), pa.array(n)], names=["label", "at", "n"])

    return count


def least_loss(loss, x: np.ndarray, rounds: int) -> np.ndarray:
    """Where the loss, which is called ``rounds`` times, was least on the way of L-BFGS from x."""
    value, g = loss(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    size = min(1.0, 0.1 / max(np.linalg.norm(g), 1e-12))
    for _ in range(rounds - 1):
        d, kept = g.copy(), []
        for s, y in reversed(steps):
            kept.append((s @ d) / (s @ y))
            d -= kept[-1] * y
        if steps:
            d *= (steps[-1][0] @ steps[-1][1]) / (steps[-1][1] @ steps[-1][1])
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            d += (a - (y @ d) / (s @ y)) * s
        there = x - size * d
        new, slope = loss(there)
        if new > value:
            size /= 4
            continue
        if (there - x) @ (slope - g) > 1e-12:
            steps = [*steps[-9:], (there - x, slope - g)]
            size = 1.0
        x, value, g = there, new, slope
    return x


def _fit_all(texts: DataFrame, start: CharCNN, shared, judge: CharCNN | None, held: bool | None, rounds: int) -> CharCNN:
    """The network with the least loss, both labels weighing the same, over all tokens held out or not (None: both), from a start on."""

    def loss(values: np.ndarray) -> tuple[float, np.ndarray]:
        model = with_parameters(start, values)
        out = np.zeros((2, len(values) + 2))
        for r in texts.mapInArrow(_sum_losses(model, shared, judge, held), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
            out.ravel()[r["place"]] = r["value"]
        out = (out / np.maximum(out[:, 1:2], 1)).mean(0)
        return float(out[0]), out[2:]

    return with_parameters(start, least_loss(loss, flat(start), rounds))


def train(docs: DataFrame, most: int = 6000, recall: float = 0.98, seed: int = 7, least: int = 10, rounds: int = 4) -> CharCNN | None:
    """Fit on the tokens of all documents; a fifth of them calibrate. With over ``most`` windows of a label in about ``rounds`` rounds.

    With fewer than ``least`` findings or other tokens in all documents there is nothing to learn from: None.
    """
    windows, labels, by_hash, counts = _examples(docs, most)
    fewest = min(counts[0][0], counts[1][0])
    if fewest < least:
        warnings.warn(f"only {fewest} findings or other tokens in all documents: no network is trained", stacklevel=2)
        return None
    if max(n for _, n in counts.values()) > most:
        return _train_on_all(docs, windows, labels, by_hash, counts[2][0] > 0, recall, seed, rounds)
    sure = labels < 2
    model = CharCNN(seed)
    model.fit([w for w, k in zip(windows, sure, strict=True) if k], labels[sure])
    # No pattern has judged the candidates; those that look unlike secrets join the other tokens.
    unlike = ~sure & (model.logits(windows) < 0)
    labels[unlike] = 0
    windows, labels = [w for w, k in zip(windows, sure | unlike, strict=True) if k], labels[sure | unlike]
    held = np.zeros(len(labels), bool)  # a fifth of each label
    for k in (0, 1):
        own = np.flatnonzero(labels == k)
        held[own[: max(1, len(own) // 5)]] = True
    model = CharCNN(seed)
    model.fit([w for w, k in zip(windows, held, strict=True) if not k], labels[~held])
    model.calibrate([w for w, k in zip(windows, held, strict=True) if k], labels[held], recall)
    return model


def _train_on_all(docs: DataFrame, windows: list[bytes], labels: np.ndarray, held: np.ndarray, candidates: bool, recall: float, seed: int, rounds: int) -> CharCNN:
    """From a start on the given examples to all tokens. If no finding or all of them are held out, all serve fit and calibration."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    split = all((held & (labels == k)).any() and (~held & (labels == k)).any() for k in (0, 1))
    fitted, rest = (False, True) if split else (None, None)
    some = (labels < 2) & ~(held & split)
    start = CharCNN(seed)
    start.fit([w for w, k in zip(windows, some, strict=True) if k], labels[some])
    plain, _ = pieces([w for w, k in zip(windows, labels, strict=True) if k == 0])
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(plain, 127))
    model, judge = _fit_all(texts, start, shared, None, fitted, rounds), None
    if candidates:
        # No pattern has judged the candidates; those that look unlike secrets join the other tokens.
        judge = model
        model = _fit_all(texts, judge, shared, judge, fitted, rounds)
    scores = texts.mapInArrow(_count_scores(model, shared, judge, rest), "label int, at long, n long").groupBy("label", "at").agg(F.sum("n").alias("n")).collect()
    label, at, n = (np.array([r[k] for r in scores], np.float64) for k in ("label", "at", "n"))
    model.calibrate_scores(at / 1024, label, n, recall)
    return model


def _finder(shared):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            base = find_base(part)
            spans = [list(x) for x in base]
            if shared is not None:
                raw = part.data.tobytes()
                flat = [(i, s, e) for i, own in enumerate(find_candidates(part, base)) for s, e in own]
                if flat:
                    model = shared.value
                    score = model.score([window(raw, int(part.start[i]), int(part.end[i]), s, e) for i, s, e in flat])
                    for (i, s, e), p in zip(flat, score, strict=True):
                        if p >= model.threshold:
                            spans[i].append((s, e, 3))
            points = np.append(0, np.cumsum((part.data & 0xC0) != 0x80))
            text = lambda i, found: ",".join(f"{KINDS[k]}:{points[s] - points[part.start[i]]}:{points[e] - points[part.start[i]]}" for s, k, e in sorted((s, k, e) for s, e, k in found))  # noqa: E731,B023
            columns = {"doc_id": part.batch.column(0)}
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                columns[name] = pa.array([sum(x[2] == k for x in own) for own in base], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(text(i, own).encode()).hexdigest() for i, own in enumerate(base)])
            columns["spans"] = pa.array([text(i, own) for i, own in enumerate(spans)])
            yield pa.RecordBatch.from_pydict(columns)

    return find


def scan(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points, comma-joined)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = train(docs, **options)
    shared = None if model is None else spark.sparkContext.broadcast(model)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_finder(shared), schema)
