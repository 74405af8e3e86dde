"""Suffix-array deduplication of byte strings across documents (operator 6).

A byte of a document goes when a string of 50 bytes that covers it also starts in a document with a smaller id.

1. Anchors. Every 50-byte window picks one of its 24-byte grams, the one with the smallest hash, so equal windows
   pick the same gram. Neighbouring windows mostly pick the same one: an anchor, with the segment of text that its
   windows cover.
2. Sort in a slice. Segments of a slice of text that share a gram are mergesorted as suffixes; two are compared through
   polynomial prefix hashes, where binary search finds how far they agree. Neighbours that agree over their length are
   verified byte by byte. The smallest document of each class goes on, the ranges of the others are done.
3. Buckets. The other anchors (6 bytes of the gram's hash, 5 of the segment's, place and shape) are packed by buckets of
   the gram's hash. A gram that only one document has settles its windows. Of segments with equal hashes the smallest
   document's stands for the others. Segments that share a gram otherwise are open.
4. Verification. Neighbouring segments of a document with the same representative, equally far apart, form one range.
   Its bytes and those of the representative are compared by their SHA-256. Where they differ, as after a collision,
   all segments of the grams concerned become open.
5. Suffix sort of open segments. Their text is fetched, and the suffixes at all their windows are mergesorted by gram
   and offset, compared and verified as in step 2; the smallest document of each class stays.
6. Removed ranges meet their document, and the remaining bytes are hashed or returned.

Hot grams: if a slice has more than ``hot_segments`` different segments of a gram, they are dealt over all buckets by
their own hash, and all segments of the gram are open in step 5. There their windows are dealt by the hash of the 44
bytes that windows with the gram at about the same place have in common; so are those of a gram with over
``split_rows`` open segments. Grams with over a thousandth of all open segments, too, have their windows dealt one by
one, by the hash of all their bytes. So no task gets all segments of a gram.

Defined cases: a null or empty text has no bytes; a text below 50 bytes is left alone; a null doc_id neither removes
nor loses anything; rows that repeat a doc_id must repeat its text, and don't count as smaller than each other; an
empty table gives no rows; a text of any length is handled whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import salted_join, small_batches, stored
from .text import mix, powers, prefix_hashes, runs, slices, span_hashes

GRAM = 24
#: kind 0: anchors of a bucket, 1: ranges settled in the slice, 2: anchors of hot grams, 3: the hot grams' names.
_PACKED = "kind int, bucket long, grams binary, segments binary, starts binary, shapes binary, docs binary, counts binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]
#: gram null: a settled range; rep_doc not null: all windows go if the representative's bytes are equal; else open.
_SETTLED = "doc_id long, start int, windows int, offset int, gram long, rep_doc long, rep_start int, split int"
#: kind 0: bytes of an open segment or a part of one; 1: a range to verify; 2: a settled range.
_FETCHED = "kind int, doc_id long, start int, end int, windows int, offset int, gram long, part int, piece binary, rep_doc long, rep_start int, digest binary"
_RANGES = "doc_id long, start int, end int"
HOT_PARTS, CUTS = 256, 4


def _masked(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits == 64 else x & np.uint64((1 << bits) - 1)


def anchors(data: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int, bits: int = 64) -> dict[str, np.ndarray]:
    """Of each anchor: gram and segment hash, document row, first window (from the document's start), windows, offset."""
    n, width = len(data), length - gram + 1
    long_enough = end - start >= length
    if not long_enough.any():
        return {k: np.zeros(0, np.int64) for k in ("gram", "segment", "row", "start", "windows", "offset")}
    prefix = prefix_hashes(data)
    _, down = powers(n + 1)
    hashes = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    packed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    best = packed
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    best = np.minimum(best[: len(packed) - width + 1], best[width - size :])
    chosen = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    usable = np.zeros(n + 1, np.int64)
    np.add.at(usable, start[long_enough], 1)
    np.add.at(usable, end[long_enough] - length + 1, -1)
    windows = np.flatnonzero(np.cumsum(usable)[: len(chosen)] > 0)
    chosen = chosen[windows]
    new = np.append(True, (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    at, anchor = windows[first], chosen[first]
    # Two documents that touch may share an anchor position only if they share bytes, so a run never crosses them.
    row = np.searchsorted(start, at, "right") - 1
    offset = anchor - at
    segment = span_hashes(prefix, at, at + count - 1 + length) + mix((offset * 64 + count).astype(np.uint64))
    return {"gram": _masked(hashes[anchor], bits), "segment": _masked(mix(segment), bits), "row": row, "start": at - start[row], "windows": count, "offset": offset}


def _bytes(values: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _whole(blob: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(blob) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _rows_of(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(columns, kinds, strict=True)], names=_NAMES)


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first, start and end of maximal runs of overlapping or touching ranges, sorted by row and start.

    Ranges whose ``same`` differs aren't joined. Ends must not decrease within a row.
    """
    apart = (row[1:] != row[:-1]) | (start[1:] > end[:-1])
    if same is not None:
        apart |= same[1:] != same[:-1]
    first = np.flatnonzero(np.append(True, apart)) if len(row) else np.zeros(0, np.int64)
    last = np.append(first[1:], len(row)) - 1 if len(row) else first
    return first, start[first], end[last]


def _scanner(buckets: int, length: int, gram: int, hot_segments: int, bits: int, thorough: bool):
    """(doc_id, text) -> packed anchors by bucket, and ranges settled within the slice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, most=2_000_000):
            a = anchors(part.data, part.start, part.end, length, gram, bits)
            doc = np.asarray(part.batch.column(0).cast(pa.int64()))[a["row"]]
            late = settled_here(part, a, doc, length, bits, thorough)
            if len(gone := np.flatnonzero(late)):
                gone = gone[np.lexsort((a["start"][gone], a["row"][gone]))]
                first, start, end = merged(a["row"][gone], a["start"][gone], a["start"][gone] + a["windows"][gone] - 1 + length)
                own = doc[gone][first]
                yield _rows_of([[1], [0], [b""], [b""], [start.astype("<i4").tobytes()], [end.astype("<i4").tobytes()], [own.astype("<i8").tobytes()], [b""]])
            keep = np.flatnonzero(~late)
            if not len(keep):
                continue
            name, which, n = np.unique(a["gram"][keep], return_inverse=True, return_counts=True)
            hot = (n > hot_segments)[which]
            bucket = mix(np.where(hot, a["gram"][keep] ^ a["segment"][keep], a["gram"][keep]) + np.uint64(1)) % np.uint64(buckets)
            order = np.lexsort((a["start"][keep], doc[keep], bucket, hot))
            keep, bucket, hot = keep[order], bucket[order].astype(np.int64), hot[order]
            rows: list[list] = [[] for _ in _NAMES]
            grams, segments = _bytes(a["gram"][keep], 6), _bytes(a["segment"][keep], 5)
            starts, shapes = a["start"][keep].astype("<i4"), np.stack([a["windows"][keep], a["offset"][keep]], 1).astype(np.uint8)
            edges = np.append(np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (hot[1:] != hot[:-1]))), len(keep))
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                own = doc[keep[s:e]]
                firsts = runs(own)
                counts = np.diff(np.append(firsts, len(own))).astype("<i4")
                for r, v in zip(rows, (2 if hot[s] else 0, int(bucket[s]), grams[s:e].tobytes(), segments[s:e].tobytes(), starts[s:e].tobytes(), shapes[s:e].tobytes(), own[firsts].astype("<i8").tobytes(), counts.tobytes()), strict=True):
                    r.append(v)
            for g in name[n > hot_segments]:
                for r, v in zip(rows, (3, int(mix(np.array([g]) + np.uint64(1))[0] % np.uint64(buckets)), _bytes(np.array([g]), 6).tobytes(), *[b""] * 5), strict=True):
                    r.append(v)
            yield _rows_of(rows)

    return scan


def settled_here(part, a: dict[str, np.ndarray], doc: np.ndarray, length: int, bits: int, thorough: bool = False) -> np.ndarray:
    """Which anchors have the same segment in a smaller document of the slice: suffix sort of those with a common gram."""
    late = np.zeros(len(doc), bool)
    order = np.argsort(a["gram"], kind="stable")
    first = runs(a["gram"][order])
    if not len(first):
        return late
    size = np.diff(np.append(first, len(order)))
    common = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
    order = order[np.repeat(common, size)]
    if not len(order):
        return late
    shape = a["windows"] * 64 + a["offset"]
    order = order[np.lexsort((shape[order], a["gram"][order]))]
    new = np.append(True, (a["gram"][order][1:] != a["gram"][order][:-1]) | (shape[order][1:] != shape[order][:-1]))
    at = part.start[a["row"][order]] + a["start"][order]
    by, same = classes(part.data, prefix_hashes(part.data), at, np.cumsum(new), a["windows"][order] - 1 + length, bits, thorough)
    order = order[by]
    head = np.flatnonzero(~same)
    least = np.repeat(np.minimum.reduceat(doc[order], head), np.diff(np.append(head, len(order))))
    late[order] = doc[order] > least
    return late


def _settler(length: int, split_rows: int):
    """Packed anchors and ranges, sorted by bucket -> _SETTLED."""

    def solve(rows: list[tuple], named: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """named: the hot grams of this bucket; None: all grams are hot."""
        gram = np.concatenate([_whole(r[0], 6) for r in rows])
        segment = np.concatenate([_whole(r[1], 5) for r in rows])
        start = np.concatenate([np.frombuffer(r[2], "<i4") for r in rows])
        shape = np.concatenate([np.frombuffer(r[3], np.uint8).reshape(-1, 2) for r in rows])
        doc = np.concatenate([np.repeat(np.frombuffer(r[4], "<i8"), np.frombuffer(r[5], "<i4")) for r in rows])
        order = np.argsort(gram, kind="stable")
        first = runs(gram[order])
        size = np.diff(np.append(first, len(order)))
        ordered = doc[order]
        shared = np.minimum.reduceat(ordered, first) < np.maximum.reduceat(ordered, first)
        shared |= True if named is None else np.isin(gram[order][first], named)
        order = order[np.repeat(shared, size)]
        if not len(order):
            return
        order = order[np.lexsort((start[order], doc[order], shape[order, 0], shape[order, 1], segment[order], gram[order]))]
        gram, segment, start, shape, doc = gram[order], segment[order], start[order], shape[order], doc[order]
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new_segment = new_gram | np.append(True, (segment[1:] != segment[:-1]) | (shape[1:] != shape[:-1]).any(1))
        of_gram, of_segment = np.cumsum(new_gram) - 1, np.cumsum(new_segment) - 1
        rep_doc, rep_start = doc[new_segment][of_segment], start[new_segment][of_segment]
        late = doc > rep_doc
        open_ = np.add.reduceat((~late).astype(np.int64), np.flatnonzero(new_gram))[of_gram]
        hot = np.ones(len(doc), bool) if named is None else np.isin(gram, named)
        several = (np.add.reduceat(new_segment.astype(np.int64), np.flatnonzero(new_gram))[of_gram] > 1) | hot
        split = np.where(hot | (open_ > split_rows), CUTS, 1)
        out = np.flatnonzero(late | several)
        for at in range(0, len(out), 50_000):
            o = out[at : at + 50_000]
            columns = [doc[o], start[o].astype(np.int32), shape[o, 0].astype(np.int32), shape[o, 1].astype(np.int32), gram[o].view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(rep_doc[o], mask=~late[o]), pa.array(rep_start[o].astype(np.int32), mask=~late[o]), pa.array(split[o].astype(np.int32))], names=[x.split()[0] for x in _SETTLED.split(", ")])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {0: [], 2: [], 3: []}
        now = None

        def done() -> Iterator[pa.RecordBatch]:
            if held[0]:
                yield from solve(held[0], np.unique(np.concatenate([_whole(r[0], 6) for r in held[3]])) if held[3] else np.zeros(0, np.uint64))
            if held[2]:
                yield from solve(held[2], None)
            for rows in held.values():
                rows.clear()

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)) for n in _NAMES]
            for i in range(batch.num_rows):
                kind, bucket, *values = (c[i].as_py() for c in columns)
                if kind == 1:
                    doc, start, end = (np.frombuffer(values[k], t) for k, t in ((4, "<i8"), (2, "<i4"), (3, "<i4")))
                    none, n = pa.nulls(len(doc), pa.int64()), np.zeros(len(doc), np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array((end - start - length + 1).astype(np.int32)), pa.array(n), none, none, pa.nulls(len(doc), pa.int32()), pa.array(n)], names=[x.split()[0] for x in _SETTLED.split(", ")])
                    continue
                if bucket != now:
                    yield from done()
                now = bucket
                held[kind].append(tuple(values))
        yield from done()

    return settle


def agree(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray, bits: int = 64) -> np.ndarray:
    """How many bytes, up to length, the suffixes at x and y have in common: binary search over prefix hashes."""
    _, down = powers(len(prefix))
    low, high = np.zeros(len(x), np.int64), length.astype(np.int64)
    base_x, base_y, down_x, down_y = prefix[x], prefix[y], down[x], down[y]
    for _ in range(int(length.max()).bit_length() if len(x) else 0):
        middle = (low + high + 1) >> 1
        same = _masked((prefix[x + middle] - base_x) * down_x, bits) == _masked((prefix[y + middle] - base_y) * down_y, bits)
        low = np.where(same, middle, low)
        high = np.where(same, high, np.maximum(middle - 1, 0))
    return low


def sort_suffixes(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, group: np.ndarray, length: np.ndarray, bits: int = 64) -> np.ndarray:
    """Order of suffixes data[at:at + length] within each run of equal group: bottom-up mergesort of all runs at once.

    Each suffix finds its place in the neighbouring run by binary search, so a merge is a few vector steps. All
    suffixes of a group have the same length.
    """
    order = np.arange(len(at))
    first = runs(group)
    begin = np.repeat(first, np.diff(np.append(first, len(group))))
    finish = np.repeat(np.append(first[1:], len(group)), np.diff(np.append(first, len(group))))
    width = 1
    while len(live := np.flatnonzero(finish - begin > width)):
        index = live - begin[live]
        run = index // width
        left = run % 2 == 0
        low = np.where(left, begin[live] + (run + 1) * width, begin[live] + (run - 1) * width)
        high = np.minimum(low + width, finish[live])
        low = np.minimum(low, high)
        base = low.copy()
        mine = at[order[live]]
        searching = np.flatnonzero(low < high)
        while len(searching):
            middle = (low[searching] + high[searching]) >> 1
            x, y, most = at[order[middle]], mine[searching], length[live[searching]]
            common = agree(prefix, x, y, most, bits)
            ends = common >= most
            before = np.where(ends, ~left[searching], data[np.minimum(x + common, len(data) - 1)] < data[np.minimum(y + common, len(data) - 1)])
            low[searching] = np.where(before, middle + 1, low[searching])
            high[searching] = np.where(before, high[searching], middle)
            searching = searching[low[searching] < high[searching]]
        pair = begin[live] + (run // 2) * 2 * width
        place = pair + index % width + (low - base)
        new = order.copy()
        new[place] = order[live]
        order = new
        width *= 2
    return order


def _compared(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray, at_once: int = 4_000_000) -> np.ndarray:
    """-1, 0 or 1 as the bytes data[x:x + length] come before, are equal to or come after data[y:y + length]."""
    out = np.zeros(len(x), np.int8)
    total = np.append(0, np.cumsum(length))
    low = 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(total, total[low] + at_once, "right")) - 1)
        n = length[low:high]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        one, other = data[np.repeat(x[low:high], n) + step], data[np.repeat(y[low:high], n) + step]
        apart = np.flatnonzero(one != other)
        at = np.searchsorted(apart, first)
        differs = np.flatnonzero((at < len(apart)) & (apart[np.minimum(at, len(apart) - 1)] < first + n)) if len(apart) else apart
        place = apart[at[differs]]
        out[low + differs] = np.where(one[place] < other[place], -1, 1)
        low = high
    return out


def classes(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, group: np.ndarray, length: np.ndarray, bits: int = 64, thorough: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): suffixes sorted within their groups; same: it has the bytes of the one before it.

    Neighbours whose hashes agree over their length, or all of them if ``thorough``, are compared on their bytes. A
    group that a collision left out of order is sorted again by its bytes. Without ``thorough`` a false agreement
    within a comparison (odds of one in 2**64 for each) could hide an equal suffix, but never make one.
    """
    order = sort_suffixes(data, prefix, at, group, length, bits)
    same = np.zeros(len(at), bool)
    c = np.flatnonzero(np.append(False, group[1:] == group[:-1])) if len(at) else np.zeros(0, np.int64)
    if not thorough:
        c = c[agree(prefix, at[order[c - 1]], at[order[c]], length[c], bits) >= length[c]]
    sign = _compared(data, at[order[c - 1]], at[order[c]], length[c])
    same[c] = sign == 0
    lost = np.flatnonzero(np.bincount(order, minlength=len(at)) != 1)  # two places for one: the comparisons contradict each other
    for g in np.unique(np.append(group[c[sign != 0] if not thorough else c[sign > 0]], group[lost])):
        s, e = np.searchsorted(group, [g, g + 1])
        text = {i: data[at[i] : at[i] + length[s]].tobytes() for i in range(s, e)}
        order[s:e] = sorted(text, key=text.__getitem__)
        same[s + 1 : e] = [text[i] == text[j] for i, j in zip(order[s : e - 1].tolist(), order[s + 1 : e].tolist(), strict=True)]
    return order, same


def _sorter(length: int, bits: int, thorough: bool, rows_at_once: int = 20_000):
    """Pieces sorted by gram and part -> ranges that a smaller document also has."""

    def key(t: pa.Table) -> np.ndarray:
        """True at the first row of each gram and part."""
        gram, part = t["gram"].to_numpy(), t["part"].to_numpy()
        return np.append(True, (gram[1:] != gram[:-1]) | (part[1:] != part[:-1]))

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, start, count, offset = (t[n].to_numpy() for n in ("doc_id", "start", "windows", "offset"))
        piece = t["piece"].combine_chunks().cast(pa.large_binary())
        bounds = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
        data = np.frombuffer(piece.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        row = np.repeat(np.arange(len(doc)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = bounds[:-1][row] + step
        group = np.cumsum(key(t))[row] * 64 + offset[row] - step
        by_group = np.argsort(group, kind="stable")
        group, at, row, step = group[by_group], at[by_group], row[by_group], step[by_group]
        order, same = classes(data, prefix_hashes(data), at, group, np.full(len(at), length), bits, thorough)
        row, step = row[order], step[order]
        first = np.flatnonzero(~same)
        least = np.repeat(np.minimum.reduceat(doc[row], first), np.diff(np.append(first, len(row))))
        gone = np.flatnonzero(doc[row] > least)
        if not len(gone):
            return
        gone = gone[np.lexsort((step[gone], row[gone]))]
        r, s = row[gone], step[gone]
        first, s, e = merged(r, s, s + length)
        r = r[first]
        yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array((start[r] + s).astype(np.int32)), pa.array((start[r] + e).astype(np.int32))], names=["doc_id", "start", "end"])

    def dedup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, rows_at_once
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= limit:
                t = pa.Table.from_batches(held)
                cut = int(np.flatnonzero(key(t))[-1])
                if cut:
                    yield from solve(t.slice(0, cut))
                    held = [pa.concat_tables([t.slice(cut)]).combine_chunks().to_batches()[0]]
                    size = t.num_rows - cut
                limit = max(rows_at_once, 2 * size)
        if held:
            yield from solve(pa.Table.from_batches(held))

    return dedup


def _fetcher(length: int, width: int):
    """(doc_id, text, x: its settled rows) -> _FETCHED. Segments with a split over 1 are cut into so many at most."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _FETCHED.split(", "))])

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([(c if isinstance(c := columns[f.name], pa.Array) else pa.array(np.broadcast_to(c, n), f.type)) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def pieces(part, row, doc, start, windows, offset, gram, own) -> pa.RecordBatch:
        size = windows + length - 1
        where = np.append(0, np.cumsum(size))
        octets = part.data[np.repeat(part.start[row] + start - where[:-1], size) + np.arange(where[-1])]
        whole = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(where.astype(np.int32)), pa.py_buffer(octets)])
        return rows(len(row), kind=0, doc_id=doc, start=start.astype(np.int32), windows=windows.astype(np.int32), offset=offset.astype(np.int32), gram=gram, part=own, piece=whole)

    def split_pieces(part, step, row, doc, start, windows, offset, gram) -> Iterator[pa.RecordBatch]:
        """Windows whose gram stands at about the same place in them have most bytes in common; these bytes deal them."""
        prefix = prefix_hashes(part.data)
        for least in range(0, length - width + 1, step):
            high, low = np.minimum(offset, least + step - 1), np.maximum(offset - windows + 1, least)
            some = np.flatnonzero(high >= low)
            if len(some):
                at = part.start[row[some]] + start[some] + offset[some] - least
                own = (span_hashes(prefix, at, at + length - step + 1) % np.uint64(HOT_PARTS)).astype(np.int32)
                yield pieces(part, row[some], doc[some], (start + offset - high)[some], (high - low + 1)[some], high[some], gram[some], own)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = part.batch.column(part.batch.schema.get_field_index("x"))
            n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            fields = lists.flatten().flatten()
            start, windows, offset, split = (np.asarray(fields[i]).astype(np.int64) for i in (0, 1, 2, 6))
            gram, rep_doc, rep_start = (np.asarray(fields[i].fill_null(0)) for i in (3, 4, 5))
            settled, late = np.asarray(fields[3].is_null()), np.asarray(fields[4].is_valid())
            row = np.repeat(np.arange(len(part)), n)
            doc = np.asarray(part.batch.column(0))[row]
            end = start + windows - 1 + length
            if len(i := np.flatnonzero(settled)):
                i = i[np.lexsort((start[i], row[i]))]
                # Ends may decrease here, as ranges may hold others.
                first, s, e = merged(row[i], start[i], np.maximum.accumulate(end[i] + row[i] * (1 << 40)) - row[i] * (1 << 40))
                yield rows(len(first), kind=2, doc_id=doc[i][first], start=s, end=e)
            if len(i := np.flatnonzero(late)):
                i = i[np.lexsort((start[i], start[i] - rep_start[i], rep_doc[i], row[i]))]
                pair = np.cumsum(np.append(True, (rep_doc[i][1:] != rep_doc[i][:-1]) | ((start[i] - rep_start[i])[1:] != (start[i] - rep_start[i])[:-1])))
                first, s, e = merged(row[i], start[i], end[i], pair)
                i = i[first]
                digest = [hashlib.sha256(part.data[a:b]).digest() for a, b in zip((part.start[row[i]] + s).tolist(), (part.start[row[i]] + e).tolist(), strict=True)]
                yield rows(len(i), kind=1, doc_id=doc[i], start=s, end=e, rep_doc=rep_doc[i], rep_start=rep_start[i], digest=pa.array(digest, pa.binary()))
            if len(i := np.flatnonzero(~settled & ~late & (split == 1))):
                yield pieces(part, row[i], doc[i], start[i], windows[i], offset[i], gram[i], 0)
            for cuts in np.unique(split[split > 1]):
                if len(i := np.flatnonzero(~settled & ~late & (split == cuts))):
                    yield from split_pieces(part, -(-(length - width + 1) // int(cuts)), row[i], doc[i], start[i], windows[i], offset[i], gram[i])

    return fetch


def _prover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, x: ranges asked of it) -> the questions whose digest is that of the document's bytes."""
    for part in slices(batches):
        lists = part.batch.column(part.batch.schema.get_field_index("x"))
        n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        start, size, digest, asked = lists.flatten().flatten()
        row = np.repeat(np.arange(len(part)), n)
        at = part.start[row] + np.asarray(start)
        good = pa.array([hashlib.sha256(part.data[a:b]).digest() == d for a, b, d in zip(at.tolist(), (at + np.asarray(size)).tolist(), digest.to_pylist(), strict=True)], pa.bool_())
        own = pa.array(np.asarray(part.batch.column(0))[row])
        yield pa.RecordBatch.from_arrays([c.filter(good) for c in (own, start, size, digest, asked)], names=["rep_doc", "rep_start", "size", "digest", "asked"])


def removed_ranges(docs: DataFrame, texts: DataFrame, length: int = 50, gram: int = GRAM, bucket_bytes: int = 16_000_000, hot_segments: int = 64, split_rows: int = 4000, hash_bits: int = 64, verify_order: bool = False) -> DataFrame:
    """doc_id, start, end (bytes, end exclusive) of all removed strings; they overlap. texts: docs dealt by doc_id.

    hash_bits shortens all hashes, so that tests meet collisions; verify_order compares all sorted neighbours on bytes.
    """
    known = docs.where("doc_id IS NOT NULL AND octet_length(text) >= " + str(length)).select("doc_id", "text")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-size // bucket_bytes))
    packed = known.mapInArrow(_scanner(buckets, length, gram, hot_segments, hash_bits, verify_order), _PACKED)
    # One exchange carries all kinds: settled ranges go anywhere, packed anchors to their bucket.
    dealt = packed.repartition(max(parts, buckets), F.when(F.col("kind") != 1, F.col("bucket")).otherwise(F.xxhash64("docs"))).sortWithinPartitions("bucket", "kind")
    settled = stored(dealt.mapInArrow(_settler(length, split_rows), _SETTLED))

    # At most a thousand grams have over a thousandth of the open segments.
    open_rows = settled.where("gram IS NOT NULL AND rep_doc IS NULL")
    most = max(split_rows, open_rows.count() // 1000)
    hottest = open_rows.where("split > 1").groupBy("gram").count().where(F.col("count") > most).select("gram", F.lit(True).alias("_hottest"))
    settled = settled.join(F.broadcast(hottest), "gram", "left").withColumn("split", F.when(F.col("_hottest"), length - gram + 1).otherwise(F.col("split"))).drop("_hottest")

    def fetched(rows: DataFrame) -> DataFrame:
        entry = F.struct("start", "windows", "offset", "gram", "rep_doc", "rep_start", "split")
        own = rows.groupBy("doc_id").agg(F.collect_list(entry).alias("x"))
        return texts.where("text IS NOT NULL AND doc_id IS NOT NULL").join(own, "doc_id").select("doc_id", "text", "x").mapInArrow(_fetcher(length, gram), _FETCHED)

    def sorted_(pieces: DataFrame) -> DataFrame:
        in_order = pieces.where("kind = 0").repartition(parts, "gram", "part").sortWithinPartitions("gram", "part")
        return in_order.select("gram", "part", "doc_id", "start", "windows", "offset", "piece").mapInArrow(_sorter(length, hash_bits, verify_order), _RANGES)

    rows = stored(fetched(settled))
    # Copies ask the same of their representative, so each question is put once.
    claims = rows.where("kind = 1").withColumn("question", F.struct("rep_doc", "rep_start", (F.col("end") - F.col("start")).alias("size"), "digest"))
    questions = claims.groupBy("question").agg(F.count("*").alias("asked")).select("question.*", "asked")
    by_rep = questions.groupBy(F.col("rep_doc").alias("doc_id")).agg(F.collect_list(F.struct("rep_start", "size", "digest", "asked")).alias("x"))
    proven = texts.where("text IS NOT NULL AND doc_id IS NOT NULL").join(by_rep, "doc_id").select("doc_id", "text", "x").mapInArrow(_prover, "rep_doc long, rep_start int, size int, digest binary, asked long")
    proven = proven.groupBy(F.struct("rep_doc", "rep_start", "size", "digest").alias("question")).agg(F.max("asked").alias("asked"))
    judged = stored(salted_join(claims, proven.withColumn("good", F.lit(True)), "question", F.col("doc_id"), "asked").select("doc_id", "start", "end", "rep_doc", F.coalesce("good", F.lit(False)).alias("good")))
    ranges = [rows.where("kind = 2").select("doc_id", "start", "end"), judged.where("good").select("doc_id", "start", "end"), sorted_(rows)]
    bad = judged.where("NOT good")
    if bad.limit(1).count():
        # After a collision all segments of the grams of these ranges are compared window by window.
        late = settled.where("rep_doc IS NOT NULL")
        inside = (F.col("start") >= F.col("_s")) & (F.col("start") < F.col("_e"))
        wrong = late.join(bad.select("doc_id", "rep_doc", F.col("start").alias("_s"), F.col("end").alias("_e")), ["doc_id", "rep_doc"]).where(inside).select("gram").distinct()
        again = settled.where("gram IS NOT NULL").join(wrong, "gram", "left_semi")
        whole = ["windows", "offset", "gram", F.lit(None).cast("long").alias("rep_doc"), F.lit(None).cast("int").alias("rep_start"), "split"]
        again = again.select("doc_id", "start", *whole).union(again.where("rep_doc IS NOT NULL").select("rep_doc", "rep_start", *whole)).distinct()
        ranges.append(sorted_(fetched(again)))
    out = ranges[0]
    for more in ranges[1:]:
        out = out.union(more)
    return out


def _remover(texts_out: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lists = [part.batch.column(part.batch.schema.get_field_index(n)) for n in ("starts", "ends")]
            n = pa.compute.fill_null(pa.compute.list_value_length(lists[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.repeat(part.start, n)
            cover = np.zeros(len(part.data) + 1, np.int64)
            np.add.at(cover, base + np.asarray(lists[0].flatten()), 1)
            np.add.at(cover, base + np.asarray(lists[1].flatten()), -1)
            gone = np.cumsum(cover)[:-1] > 0
            before = np.append(False, gone[:-1])
            full = part.end > part.start
            before[part.start[full]] = False
            spans = np.append(0, np.cumsum(gone & ~before))
            total = np.append(0, np.cumsum(gone))
            kept = [part.data[a:b][~gone[a:b]].tobytes() if total[b] > total[a] else part.data[a:b].tobytes() for a, b in zip(part.start.tolist(), part.end.tolist(), strict=True)]
            columns = [part.batch.column(0), pa.array(part.end - part.start), pa.array(total[part.end] - total[part.start]), pa.array(spans[part.end] - spans[part.start]), pa.array(kept, pa.binary()) if texts_out else pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if texts_out else "kept_sha256"])

    return remove


def deduplicate(docs: DataFrame, length: int = 50, texts_out: bool = False, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256, or the kept bytes themselves as binary column kept."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    ranges = removed_ranges(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), texts, length, **options)
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("x")).select("doc_id", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))
    joined = texts.join(by_doc, "doc_id", "left").select("doc_id", "text", "starts", "ends")
    kind = "kept binary" if texts_out else "kept_sha256 string"
    return joined.mapInArrow(_remover(texts_out), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kind}")
