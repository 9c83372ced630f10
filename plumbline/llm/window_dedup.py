"""Substring dedup over windows of words: a log-structured fingerprint index.

Documents come in batches. The fingerprints of a batch's windows are written as a run: an immutable
table, bucketed and sorted by fingerprint. A new run is merge-joined with the runs before it, bucket by
bucket and without a shuffle of the history; shared fingerprints become candidates, and small runs are
compacted into one. Candidates are verified against the words themselves before anything is removed.

A window's fingerprint is that of its anchor, the run of a few words that hashes least in it. Equal
windows have equal anchors at the same offset, and neighbouring windows mostly share one, so the index
holds about one row for fifteen windows and still misses none.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import check_warehouse, documents, materialize, n_partitions, new_path, packed_by_row, remove, unpacked, with_row_ids
from plumbline.llm.hashing import ANCHORS, OTHER_VALUES, SLICE, anchors, byte_groups, dealt_anchors, firsts, marked_hot, merged, mix, numbered, prefix, run_hashes, runs_of, spread, whole_groups, word_hashes

WINDOW, GRAM = 35, 8
#: An anchor's place, how many windows lie before it and how many it serves, in one number.
_PACK = 64
#: Bytes of stretches that a task hashes at a time.
_TEXT = 1 << 21
RESULT = ["n_words", "n_removed", "kept_sha256", "kept_text"]


def fingerprints(window: int, gram: int):
    """The anchors of every document, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, keys, rids, ats = batch.column(0).to_numpy(), [], [], []
            for places, group in byte_groups(batch.column(1)):
                h, starts, _ = word_hashes(np.frombuffer(b"\n".join(group), dtype=np.uint8))
                bounds = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in group]))
                key, place, a, b = anchors(prefix(h), bounds[:-1], bounds[1:], gram, window)
                doc = np.searchsorted(bounds, place, side="right") - 1
                keys.append(key.view(np.int64))
                rids.append(rid[np.array(places)[doc]])
                ats.append(((place - bounds[doc]) * _PACK + (place - a)) * _PACK + (b - a))
            yield dealt_anchors(keys, rids, ats)

    return run


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, kept as bucketed tables: in the folder for intermediate tables, or by name in the warehouse.

    An index with a ``name`` outlives the call: made again under that name, window and anchor, in this or a later
    session of the same catalog, it goes on from the runs that are there. Adding a batch once more, after a job
    that died, does no harm, as places of candidates are told apart before they are counted.
    """

    def __init__(self, spark: SparkSession, window: int = WINDOW, gram: int = GRAM, fanout: int = 2, name: str | None = None):
        if not 0 < window - gram < _PACK:
            raise ValueError("the window may hold up to 63 more words than the anchor")
        if name is not None and not name.isidentifier():
            raise ValueError("the name of an index has to be a plain table name")
        self.spark, self.window, self.gram, self.fanout = spark, window, gram, fanout
        self.buckets = n_partitions(spark)
        self.paths: dict[str, str] = {}  # of the runs outside the warehouse
        self.named = name is not None
        self.name = f"{name.lower()}_{window}_{gram}_run" if name else f"plumbline_run_{uuid.uuid4().hex}"
        self.runs = sorted(t.name for t in spark.catalog.listTables(pattern=f"{self.name}_*")) if name else []

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{uuid.uuid4().hex}"  # what a failed job leaves behind is never in the way
        out = rows.repartition(self.buckets, "k").write.bucketBy(self.buckets, "k").sortBy("k")
        if self.named:
            check_warehouse(self.spark)
        else:
            self.paths[table] = new_path(self.spark, "run")
            out = out.option("path", self.paths[table])
        out.saveAsTable(table)
        return table

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE {run}")
        if run in self.paths:
            remove(self.spark, self.paths.pop(run))

    def add(self, batch: DataFrame) -> DataFrame:
        """Index a batch (_rid, text); the fingerprint rows, old and new, that it shares with itself or with history."""
        new = self._write(batch.select("_rid", "text").mapInArrow(fingerprints(self.window, self.gram), ANCHORS))
        rows = self.spark.table(new)
        plain = ["h", "_rid", F.when(F.col("at") < 0, F.bitwise_not("at")).otherwise(F.col("at")).alias("at")]
        # a window over the buckets' own key: equal keys stay together however a bucket's file is cut
        n = F.count(F.lit(1)).over(Window.partitionBy("k"))
        shared = rows.withColumn("_n", n).filter((F.col("_n") > 1) | (F.col("at") < 0)).select(*plain)
        for run in self.runs:
            old = self.spark.table(run)
            for mine, other in ((old, rows), (rows, old)):
                shared = shared.union(mine.join(other.select("k"), "k", "left_semi").select(*plain))
        found = materialize(shared, "shared-fingerprints")
        self.runs.append(new)
        return found

    def compact(self) -> None:
        """Merge the runs into one when there are ``fanout`` of them."""
        if len(self.runs) >= self.fanout:
            whole = self.spark.table(self.runs[0])
            for run in self.runs[1:]:
                whole = whole.union(self.spark.table(run))
            merged = self._write(whole)
            for run in self.runs:
                self._drop(run)
            self.runs = [merged]

    def drop(self) -> None:
        for run in self.runs:
            self._drop(run)
        self.runs = []


STRETCHES = "h long, _rid long, first long, last long, weight long, piece binary"


def _stretches(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]]) -> pa.RecordBatch:
    *columns, pieces = zip(*parts)
    arrays = [pa.array(np.concatenate(c).astype(np.int64, copy=False)) for c in columns]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([p for some in pieces for p in some], pa.binary())], ["h", "_rid", "first", "last", "weight", "piece"])


def _told(row: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> tuple:
    """Ranges of starts of repeated windows as rows without a piece."""
    r, a, b = merged(row, first, last + window)
    return spread(r), r, a, b - window, np.zeros(len(r), np.int64), [None] * len(r)


def stretches_of(window: int, rows: int = SLICE):
    """(h, _rid, first, last, weight, piece): the words of all windows that each candidate anchor serves, some ``rows`` anchors at a time.

    A piece is the words from the first window's first to the last window's last, joined by one space. Of
    equal stretches among these only one is passed on, with weight 2: all its windows are repeated. The
    others come as rows without a piece, merged to ranges of window starts from ``first`` to ``last``. So
    a stretch that a third of all documents share, or one document repeats, reaches a task a few times only.

    A hot anchor's stretches go by a hash of their own words, with their weight negated to say so: equal ones meet, all others spread.
    """

    def distinct(held: list[tuple]) -> pa.RecordBatch:
        key, row, first, last, hot = map(np.concatenate, list(zip(*held))[:5])
        pieces = [p for some in held for p in some[5]]
        kept, often, others = firsts(numbered(key.tolist(), pieces), row, first)
        weight, hot = np.minimum(often, 2), hot[kept]
        pieces = [pieces[k] for k in kept]
        key = key[kept]
        key[hot] = np.fromiter((xxhash.xxh3_64_intdigest(pieces[k]) for k in np.flatnonzero(hot)), np.uint64, hot.sum()).view(np.int64)
        return _stretches([(key, row[kept], first[kept], last[kept], np.where(hot, -weight, weight), pieces), _told(row[others], first[others], last[others], window)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, found = batch.column(0).to_numpy(), batch.column(1)
            held, n = [], 0
            for i, b in enumerate(unpacked(batch.column(2), batch.column(3))):
                words = b.split()
                text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
                key, at, hot = (found[i].values.field(c).to_numpy(zero_copy_only=False) for c in ("h", "at", "hot"))
                for k in range(0, len(key), rows):
                    places = at[k : k + rows]
                    first = places // (_PACK * _PACK) - places // _PACK % _PACK
                    last = first + places % _PACK
                    pieces = [text[x:y] for x, y in zip(np.r_[0, ends][first].tolist(), (ends[last + window - 1] - 1).tolist())]
                    held.append((key[k : k + rows], np.full(len(places), rid[i]), first, last, hot[k : k + rows], pieces))
                    n += len(places)
                    if n >= rows:
                        yield distinct(held)
                        held, n = [], 0
            if held:
                yield distinct(held)

    return run


def repeated(text: bytes, begin: np.ndarray, end: np.ndarray, row: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Marks the windows (their bytes, their piece, a hash, a weight) whose words have a weight of 2 and more together.

    Windows of one hash are compared with the first of them, word for word: runs of windows that follow each
    other on both sides are compared as one. Where words differ, the windows of that hash are sorted out by words.
    """
    if not len(value):
        return np.zeros(0, dtype=bool)
    _, at, group = np.unique(value, return_index=True, return_inverse=True)
    like = at[group]
    hit = np.bincount(group, weights=weight)[group] > 1
    other = np.flatnonzero(like != np.arange(len(value)))
    if len(other):
        x, y = other, like[other]
        new = np.r_[True, (np.diff(x) != 1) | (np.diff(y) != 1) | (np.diff(row[x]) != 0) | (np.diff(row[y]) != 0)]
        last = np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]
        spans = zip(*(v.tolist() for v in (x[new], begin[x[new]], end[x[last]], begin[y[new]], end[y[last]])))
        wrong = [group[k] for k, a, b, c, d in spans if text[a:b] != text[c:d]]
        for k in np.flatnonzero(np.isin(group, wrong)) if wrong else ():
            # few or none: hashes of different words agree only by chance
            mine = text[begin[k] : end[k]]
            hit[k] = weight[[j for j in np.flatnonzero(group == group[k]) if text[begin[j] : end[j]] == mine]].sum() > 1
    return hit


def _repeated_ranges(table: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of window starts whose window is also elsewhere, from stretches sorted by anchor."""
    h, rid, first, last, weight = (table.column(c).to_numpy() for c in ("h", "_rid", "first", "last", "weight"))
    n = last - first + 1
    text = b" ".join(table.column("piece").to_pylist())
    hashes, starts, ends = word_hashes(np.frombuffer(text, dtype=np.uint8), OTHER_VALUES)
    row = np.repeat(np.arange(len(n)), n)
    # a piece of n windows has n + window - 1 words, so each piece before has pushed the words window - 1 further
    at = np.arange(len(row)) + row * (window - 1)
    pre = prefix(hashes)
    value = mix(run_hashes(pre, at, at + window) + mix(h.view(np.uint64))[row])
    hit = np.flatnonzero(repeated(text, starts[at], ends[at + window - 1], row, value, weight[row]))
    start = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    new = np.r_[True, (row[hit][1:] != row[hit][:-1]) | (hit[1:] != hit[:-1] + 1)][: len(hit)]
    a, b = hit[new], hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1][: new.sum()]]
    return rid[row[a]], start[a], start[b]


def _windows(table: pa.Table, window: int, rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Of equal stretches of hot anchors all but one are told; the others go on as their windows, each by a hash of its own words."""
    h, rid, first, last, weight = (table.column(c).to_numpy() for c in ("h", "_rid", "first", "last", "weight"))
    pieces, n = table.column("piece").to_pylist(), last - first + 1
    same = numbered(h.tolist(), pieces)
    kept, _, others = firsts(same, rid, first)
    total = np.minimum(np.bincount(same, weights=-weight, minlength=1)[same[kept]], 2).astype(np.int64)
    yield _stretches([_told(rid[others], first[others], last[others], window)])
    for run in runs_of(n[kept], rows):
        k, m = kept[run], n[kept[run]]
        row2, weight2, first2, pieces2 = np.repeat(rid[k], m), np.repeat(total[run], m), [], []
        for j in k:
            words = pieces[j].split(b" ")
            first2 += range(first[j], first[j] + n[j])
            pieces2 += [b" ".join(words[i : i + window]) for i in range(n[j])]
        first2 = np.array(first2, dtype=np.int64)
        key2 = np.fromiter((xxhash.xxh3_64_intdigest(p) for p in pieces2), np.uint64, len(pieces2)).view(np.int64)
        same2 = numbered(key2.tolist(), pieces2)
        kept2, _, others2 = firsts(same2, row2, first2)
        total2 = np.minimum(np.bincount(same2, weights=weight2)[same2[kept2]], 2).astype(np.int64)
        whole = key2[kept2], row2[kept2], first2[kept2], first2[kept2], total2, [pieces2[j] for j in kept2]
        yield _stretches([whole, _told(row2[others2], first2[others2], first2[others2], window)])


def _split(window: int):
    """Stretches sorted by anchor: as (h, _rid, first, last, weight, piece) the ranges of repeated windows, and the windows of hot anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], size=_TEXT):
            whole = pc.is_valid(table.column("piece"))
            hot = pc.and_(whole, pc.less(table.column("weight"), 0))
            yield from table.filter(pc.invert(whole)).to_batches()
            r, a, b = _repeated_ranges(table.filter(pc.and_not(whole, hot)), window)
            yield _stretches([(spread(r), r, a, b, np.zeros(len(r), np.int64), [None] * len(r))])
            yield from _windows(table.filter(hot), window)

    return run


def _verified(window: int):
    """(_rid, first, last) of runs of window starts whose window is also elsewhere, from rows sorted by anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["h"], size=_TEXT):
            whole = pc.is_valid(table.column("piece"))
            told = table.filter(pc.invert(whole))
            if told.num_rows:
                yield pa.RecordBatch.from_arrays([told.column(c).combine_chunks() for c in ("_rid", "first", "last")], ["_rid", "first", "last"])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _repeated_ranges(table.filter(whole), window)], ["_rid", "first", "last"])

    return run


def _kept(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, out = batch.column(3), []
            for i, t in enumerate(unpacked(batch.column(1), batch.column(2))):
                words = t.split()
                n = len(words)
                if marks[i].is_valid:
                    cover = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(cover, marks[i].values.field("first").to_numpy(), 1)
                    np.add.at(cover, marks[i].values.field("last").to_numpy() + window, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(cover)[:n] == 0)]
                text = b" ".join(words)
                out.append((n, n - len(words), hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            cols = list(zip(*out)) or [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["_rid", *RESULT])

    return run


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = 3, fanout: int = 2, with_text: bool = True, group_rows: int = 2000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text``: every word goes that a repeated window covers.

    A window is ``window`` words in a row of one document; it is repeated if the same words start
    anywhere else, in the same document too. All its occurrences go. Windows whose hashes
    agree are compared word for word. Null and empty texts have no word; texts shorter than
    a window stay whole. Rows with null or repeated ids are documents of their own. Other columns are
    not read; an empty table gives an empty result. ``with_text`` False leaves ``kept_text`` null.
    Anchors found more than ``group_rows`` times are split into their windows, once for each distinct stretch.
    """
    spark = docs.sparkSession
    rows, name = with_row_ids(docs.select("doc_id", "text"))
    index = FingerprintIndex(spark, window, gram, fanout)
    candidates = None
    try:
        for k in range(batches):
            found = index.add(rows.filter(F.pmod(F.xxhash64("_rid"), F.lit(batches)) == k))
            candidates = found if candidates is None else candidates.union(found)
            if k < batches - 1:
                index.compact()
    finally:
        index.drop()
    by_row = packed_by_row(rows)
    out = _without(by_row, _marks(candidates, by_row, window, group_rows), window, with_text)
    return name(out, "_rid", "doc_id").select("doc_id", *RESULT)


def _marks(candidates: DataFrame, by_row: DataFrame, window: int, group_rows: int) -> DataFrame:
    """(_rid, marks): the window starts of each document whose window is also elsewhere, in ranges."""
    places = marked_hot(candidates, group_rows).groupBy("_rid").agg(F.collect_set(F.struct("h", "at", "hot")).alias("found"))
    texts = places.join(by_row, "_rid").select("_rid", "found", "size", "packed")
    n = n_partitions(by_row.sparkSession)
    stretches = texts.mapInArrow(stretches_of(window), STRETCHES)
    stretches = stretches.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_split(window), STRETCHES)
    marks = stretches.repartition(n, "h").sortWithinPartitions("h").mapInArrow(_verified(window), "_rid long, first long, last long")
    return marks.groupBy("_rid").agg(F.collect_list(F.struct("first", "last")).alias("marks"))


def _without(by_row: DataFrame, marks: DataFrame, window: int, with_text: bool) -> DataFrame:
    last = by_row.join(marks, "_rid", "left").select("_rid", "size", "packed", "marks")
    return last.mapInArrow(_kept(window, with_text), "_rid long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def remove_windows_of_history(batch: DataFrame, history: DataFrame, index: FingerprintIndex, with_text: bool = True, group_rows: int = 2000) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` of a new batch, which ``index`` then holds too.

    A word goes if a window covers it that also starts elsewhere in the batch or in ``history``, the documents that
    the index was built from; these stay as they are. Of the history only documents with a candidate are read
    whole. Ids are whole numbers, present, and distinct over both; others in the batch raise an error. Of null and empty texts and empty tables the
    same holds as in ``remove_repeated_windows``; other columns are not read.
    """
    new = batch.select(F.col("doc_id").cast("long").alias("_rid"), "text")
    ids = new.groupBy("_rid").count()
    if not ids.filter("_rid is null or count > 1").isEmpty() or not ids.join(history.select(F.col("doc_id").cast("long").alias("_rid")), "_rid", "left_semi").isEmpty():
        raise ValueError("the ids of a batch have to be present, distinct, and none of the history's")
    candidates = index.add(new)
    index.compact()
    met = candidates.select(F.col("_rid").alias("_met")).distinct()
    old = history.select(F.col("doc_id").cast("long").alias("_rid"), "text")
    old = old.join(met, old["_rid"] == met["_met"], "left_semi")
    marks = _marks(candidates, packed_by_row(new.unionByName(old)), index.window, group_rows)
    out = _without(packed_by_row(new), marks, index.window, with_text)
    return out.select(F.col("_rid").cast(batch.schema["doc_id"].dataType).alias("doc_id"), *RESULT)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir), with_text=False).drop("kept_text")
