"""Suffix-array dedup: column-wise construction over many strings.

The collection's order of suffixes is built from the right: every round inserts one symbol of each
string, sorts the suffixes stably by it, and updates the common prefixes of neighbours. The symbols
before the sorted suffixes are the Burrows-Wheeler transform of that column, so a round needs nothing
but the round before it. Suffixes that share 100 bytes are neighbours with a common prefix of 100.

Strings are short: around each anchor (the run of bytes that hashes least in a window of 100) they hold
the windows that it serves. Equal windows have equal anchors at the same offset, so strings are
aligned at the anchor, grouped by it, and equal windows always meet in the same column of the same
group; suffixes of different columns need not be interleaved. Anchors that occur once are dropped
before. The rows come sorted by anchor from the shuffle's files and are read in sequence, some
thousands at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, materialize, n_partitions, packed_by_row, unpacked, with_row_ids
from plumbline.llm.hashing import ANCHORS, BYTE_VALUES, SLICE, anchors, byte_groups, dealt_anchors, firsts, marked_hot, merged, numbered, prefix, repeated_anchors, runs_of, spread, whole_groups

WINDOW, GRAM = 100, 24
_PACK = 128
RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"]


def byte_anchors(window: int, gram: int):
    """The anchors of every document, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, keys, rids, ats = batch.column(0).to_numpy(), [], [], []
            for places, group in byte_groups(batch.column(1)):
                data = np.frombuffer(b"".join(group), dtype=np.uint8)
                bounds = np.cumsum([0] + [len(b) for b in group])
                key, place, a, b = anchors(prefix(BYTE_VALUES[data]), bounds[:-1], bounds[1:], gram, window)
                doc = np.searchsorted(bounds, place, side="right") - 1
                keys.append(key.view(np.int64))
                rids.append(rid[np.array(places)[doc]])
                ats.append(((place - bounds[doc]) * _PACK + (place - a)) * _PACK + (b - a))
            yield dealt_anchors(keys, rids, ats)

    return run


STRINGS = "h long, _rid long, at long, end long, piece binary"


def _strings(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]]) -> pa.RecordBatch:
    *columns, pieces = zip(*parts)
    arrays = [pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([p for some in pieces for p in some], pa.binary())], ["h", "_rid", "at", "end", "piece"])


def _told(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple:
    """Stretches of later copies as rows without a piece."""
    r, a, b = merged(row, first, end)
    return spread(r), r, a, b, [None] * len(r)


def strings_at(window: int, rows: int = SLICE):
    """(h, _rid, at, end, piece): the bytes of all windows that each candidate anchor serves, some ``rows`` anchors at a time.

    Of equal strings among these only the earliest is passed on. The windows of the others are later copies
    by that alone; they come as rows without a piece, merged to stretches from ``at`` to ``end``. So a
    string that a third of all documents share, or one document repeats, reaches a task a few times only.

    A hot anchor's strings go by a hash of their own bytes, with ``end`` -1 to say so: equal ones meet, all others spread.
    """

    def distinct(held: list[tuple]) -> pa.RecordBatch:
        key, row, at, hot = map(np.concatenate, list(zip(*held))[:4])
        pieces = [p for some in held for p in some[4]]
        first, size = at // (_PACK * _PACK) - at // _PACK % _PACK, at % _PACK + window
        kept, _, later = firsts(numbered(key.tolist(), pieces), row, first)
        hot = hot[kept]
        pieces = [pieces[k] for k in kept]
        key = key[kept]
        key[hot] = np.fromiter((xxhash.xxh3_64_intdigest(pieces[k]) for k in np.flatnonzero(hot)), np.uint64, hot.sum()).view(np.int64)
        return _strings([(key, row[kept], at[kept], np.where(hot, -1, 0), pieces), _told(row[later], first[later], (first + size)[later])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, found = batch.column(0).to_numpy(), batch.column(1)
            held, n = [], 0
            for i, b in enumerate(unpacked(batch.column(2), batch.column(3))):
                key, at, hot = (found[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("h", "at", "hot"))
                for k in range(0, len(key), rows):
                    places = at[k : k + rows]
                    first, size = places // (_PACK * _PACK) - places // _PACK % _PACK, places % _PACK + window
                    held.append((key[k : k + rows], np.full(len(places), rid[i]), places, hot[k : k + rows], [b[x : x + y] for x, y in zip(first.tolist(), size.tolist())]))
                    n += len(places)
                    if n >= rows:
                        yield distinct(held)
                        held, n = [], 0
            if held:
                yield distinct(held)

    return run


def _least_between(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of ``e[a+1 .. b]`` for each pair, by a table of minima over doubling spans."""
    span = b - a
    level = np.zeros(len(span), dtype=np.int64)
    out, current, k = np.empty(len(span), dtype=e.dtype), e, 0
    level[span > 1] = np.log2(span[span > 1]).astype(np.int64)
    top = int(level.max()) if len(level) else 0
    while True:
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(current[a[at] + 1], current[b[at] - (1 << k) + 1])
        if k == top:
            return out
        current = np.minimum(current[: -(1 << k)], current[1 << k :])
        k += 1


def later_windows(group: np.ndarray, start: np.ndarray, length: np.ndarray, flat: np.ndarray, rank: np.ndarray, window: int, columns: int) -> np.ndarray:
    """Marks [column, string]: the window that begins there is also that of a string of lower rank.

    ``group`` numbers the anchors, ``start`` is a string's first column, ``flat`` holds the strings' bytes.
    """
    m = len(group)
    symbols = np.zeros((columns, m), dtype=np.uint8)
    row = np.repeat(np.arange(m, dtype=np.int32), length)
    symbols[np.repeat((start - (np.cumsum(length) - length)).astype(np.int32), length) + np.arange(len(flat), dtype=np.int32), row] = flat
    marks = np.zeros((columns - window + 1, m), dtype=bool)
    end = start + length
    by_end = np.argsort(-end, kind="stable")
    entered = 0
    order, e = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int16)
    for c in range(columns - 1, -1, -1):
        upto = int(np.searchsorted(-end[by_end], -c - 1, side="right"))
        fresh = by_end[entered:upto]
        entered = upto
        if len(fresh):
            order = np.concatenate([fresh, order])
            e = np.concatenate([np.full(len(fresh), c + 1, dtype=np.int16), e])
        if len(order):
            e[0] = c + 1
        live = np.flatnonzero(start[order] <= c)
        if not len(live):
            order, e = order[:0], e[:0]
            continue
        key = group[order[live]] * 256 + symbols[c, order[live]]
        at = live[np.argsort(key, kind="stable")]
        key = group[order[at]] * 256 + symbols[c, order[at]]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        after = np.full(len(at), c, dtype=np.int16)
        after[same] = _least_between(e, at[same - 1], at[same])
        order, e = order[at], after
        if c <= columns - window:
            new = e < c + window
            new[0] = True
            if not new.all():
                heads = np.flatnonzero(new)
                r = rank[order]
                first = np.minimum.reduceat(r, heads)[np.cumsum(new) - 1]
                marks[c, order[r != first]] = True
    return marks


def _later_stretches(table: pa.Table, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of the bytes that later windows cover, from strings sorted by anchor."""
    lead = window - gram
    table = table.combine_chunks()
    h, rid, at = (table.column(c).to_numpy() for c in ("h", "_rid", "at"))
    if len(h) < 2:
        return (np.zeros(0, np.int64),) * 3
    place, before = at // (_PACK * _PACK), at // _PACK % _PACK
    group = np.cumsum(np.r_[0, h[1:] != h[:-1]])
    rank = np.empty(len(h), dtype=np.int64)
    rank[np.lexsort((place, rid))] = np.arange(len(h))
    piece = table.column("piece").chunk(0)
    offsets = np.frombuffer(piece.buffers()[1], dtype=np.int32)[piece.offset : piece.offset + len(piece) + 1]
    flat = np.frombuffer(piece.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    marks = later_windows(group, lead - before, np.diff(offsets).astype(np.int64), flat, rank, window, lead + window).T
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (r, a), (_, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    return rid[r], place[r] + a - lead, place[r] + b - 1 - lead + window


def _windows(table: pa.Table, window: int, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Of equal strings of hot anchors all but the earliest are told; the others go on as their windows, each by a hash of its own bytes."""
    h, rid, at = (table.column(c).to_numpy() for c in ("h", "_rid", "at"))
    pieces = table.column("piece").to_pylist()
    first, n = at // (_PACK * _PACK) - at // _PACK % _PACK, at % _PACK + 1
    kept, _, later = firsts(numbered(h.tolist(), pieces), rid, first)
    yield _strings([_told(rid[later], first[later], (first + n - 1 + window)[later])])
    for run in runs_of(n[kept], rows):
        k, m = kept[run], n[kept[run]]
        at2 = np.repeat(first[k] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
        row2, pieces2 = np.repeat(rid[k], m), [pieces[j][i : i + window] for j in k for i in range(n[j])]
        key2 = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in pieces2), np.uint64, len(pieces2)).view(np.int64)
        kept2, _, later2 = firsts(numbered(key2.tolist(), pieces2), row2, at2)
        whole = key2[kept2], row2[kept2], at2[kept2] * _PACK * _PACK, np.zeros(len(kept2), np.int64), [pieces2[j] for j in kept2]
        yield _strings([whole, _told(row2[later2], at2[later2], at2[later2] + window)])


def _split(window: int, gram: int):
    """Strings sorted by anchor: as (h, _rid, at, end, piece) the stretches that later windows cover, and the windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], size=1 << 22):
            whole = pc.is_valid(table.column("piece"))
            hot = pc.and_(whole, pc.less(table.column("end"), 0))
            yield from table.filter(pc.invert(whole)).to_batches()
            r, a, b = _later_stretches(table.filter(pc.and_not(whole, hot)), window, gram)
            yield _strings([(spread(r), r, a, b, [None] * len(r))])
            yield from _windows(table.filter(hot), window)

    return run


def _removed(window: int, gram: int):
    """(_rid, first, last) of the bytes to remove, from strings sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], size=1 << 22):
            whole = pc.is_valid(table.column("piece"))
            told = table.filter(pc.invert(whole))
            if told.num_rows:
                yield pa.RecordBatch.from_arrays([told.column(c).combine_chunks() for c in ("_rid", "at", "end")], ["_rid", "first", "last"])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _later_stretches(table.filter(whole), window, gram)], ["_rid", "first", "last"])

    return run


def _kept(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, out = batch.column(3), []
            for i, b in enumerate(unpacked(batch.column(1), batch.column(2))):
                removed = spans = 0
                kept = b
                if marks[i].is_valid:
                    cover = np.zeros(len(b) + 1, dtype=np.int32)
                    np.add.at(cover, marks[i].values.field("first").to_numpy(), 1)
                    np.add.at(cover, marks[i].values.field("last").to_numpy(), -1)
                    gone = np.cumsum(cover)[:-1] > 0
                    removed, spans = int(gone.sum()), int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum())
                    kept = np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()
                out.append((len(b), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            cols = list(zip(*out)) or [[]] * 5
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_rid", *RESULT])

    return run


def remove_repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, with_text: bool = True, group_rows: int = 2000) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes``: later copies of ``window`` bytes go.

    Texts are UTF-8 bytes, null being empty; a byte goes if a string of ``window`` bytes covers it that
    also starts earlier (at a smaller id, or earlier in the document). Overlapping strings count. Rows
    with null or repeated ids are documents of their own, in the order of id (nulls last). Bytes may be
    cut inside a character, hence the binary column. Texts shorter than a window stay whole; other
    columns are not read; an empty table gives an empty result. ``with_text`` False leaves it null. Anchors
    found more than ``group_rows`` times are split into their windows, once for each distinct string.
    """
    if not 0 < window - gram < _PACK:
        raise ValueError("the window may hold up to 127 more bytes than the anchor")
    n = n_partitions(docs.sparkSession)
    rows, name = with_row_ids(docs.select("doc_id", "text"))
    all_ = rows.select("_rid", "text").mapInArrow(byte_anchors(window, gram), ANCHORS)
    shared = all_.repartition(n, "k").sortWithinPartitions("k").mapInArrow(repeated_anchors, "h long, _rid long, at long")
    shared = marked_hot(materialize(shared, "shared-anchors"), group_rows)
    places = shared.groupBy("_rid").agg(F.collect_list(F.struct("h", "at", "hot")).alias("found"))
    by_row = packed_by_row(rows)
    pieces = places.join(by_row, "_rid").select("_rid", "found", "size", "packed").mapInArrow(strings_at(window), STRINGS)
    pieces = pieces.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_split(window, gram), STRINGS)
    marks = pieces.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_removed(window, gram), "_rid long, first long, last long")
    marks = marks.groupBy("_rid").agg(F.collect_list(F.struct("first", "last")).alias("marks"))
    last = by_row.join(marks, "_rid", "left").select("_rid", "size", "packed", "marks")
    out = last.mapInArrow(_kept(with_text), "_rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return name(out, "_rid", "doc_id").select("doc_id", *RESULT)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir), with_text=False).drop("kept_bytes")
