"""Vectorised hashes of words and of runs of symbols, on NumPy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize

U = np.uint64
_BASE = U(0x9E3779B97F4A7C55)
_rng = np.random.default_rng(2024)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
OTHER_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 21, 1 << n.bit_length())
        inverse = U(pow(int(_BASE), -1, 1 << 64))
        for name, b in (("up", _BASE), ("down", inverse)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial, one longer than ``values``; differences give the hash of any run."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:], dtype=np.uint64)
    return out


def run_hashes(pre: np.ndarray, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    down = powers(len(pre))[1]
    return mix((pre[ends] - pre[starts]) * down[starts])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word.

    A word's hash sums one value for each byte at its place in the word, mixed from both: not a polynomial,
    whose values modulo a power of two repeat for long words of a regular build. Other ``values`` give an
    independent hash.
    """
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    size = ends - starts
    upto = np.r_[0, np.cumsum(size)]
    place = np.arange(upto[-1], dtype=np.uint64) - np.repeat(upto[:-1].astype(np.uint64), size)
    total = np.zeros(upto[-1] + 1, dtype=np.uint64)
    np.cumsum(mix(values[data[~_SPACE[data]]] + place * _BASE), out=total[1:], dtype=np.uint64)
    return mix(total[upto[1:]] - total[upto[:-1]] + size.astype(np.uint64) * _BASE), starts, ends


def byte_groups(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts' bytes in groups of about ``limit`` bytes, with their places; nulls come as empty."""
    places: list[int] = []
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        b = t.as_buffer().to_pybytes() if t.is_valid else b""
        places.append(i)
        group.append(b)
        size += len(b)
        if size >= limit:
            yield places, group
            places, group, size = [], [], 0
    if places:
        yield places, group


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    n = len(x)
    if n < w:
        return x[:0]
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:n] = x
    padded = padded.reshape(blocks, w)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(pre: np.ndarray, first: np.ndarray, last: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of ``window`` symbols, each inside one document.

    ``first`` and ``last`` bound each document's symbols (``last`` exclusive) in the array that ``pre``
    sums up. A window's anchor is the place of its least hashed run of ``gram`` symbols, the leftmost of
    equals, so equal windows have their anchor at the same offset. Returns (anchor's hash, its place, first
    and last start of the windows that it serves).
    """
    n = len(pre) - 1
    empty = np.zeros(0, np.int64)
    if n < window:
        return np.zeros(0, np.uint64), empty, empty, empty
    h = run_hashes(pre, slice(0, n - gram + 1), slice(gram, n + 1))
    bits = U(int(n).bit_length())
    best = sliding_min((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), window - gram + 1)
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(first, last) if b - a >= window] or [empty])
    if not len(starts):
        return np.zeros(0, np.uint64), empty, empty, empty
    place = (best[starts] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return h[place[new]], place[new], starts[new], starts[np.r_[new[1:], len(starts)] - 1]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000, size: int = 1 << 31) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows or ``size`` bytes from batches sorted by ``keys``, cut between keys; one key's rows stay together."""
    held: list[pa.RecordBatch] = []
    n = held_size = 0
    for part in parts(batches, rows, size):
        held.append(part)
        n += part.num_rows
        held_size += part.nbytes
        if n >= rows or held_size >= size:
            table = pa.Table.from_batches(held)
            cut = boundaries(table, keys)[-2] if table.num_rows else 0
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut).combine_chunks()
            held = rest.to_batches()
            n, held_size = (rest.num_rows, rest.nbytes) if cut else (rows - max(rows // 4, 1), size - max(size // 4, 1))
    if held:
        yield pa.Table.from_batches(held)


def parts(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``rows`` rows and, in the mean of a batch, a quarter of ``size`` bytes."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // (4 * max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def boundaries(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Starts of the runs of equal keys, and the number of rows."""
    n = table.num_rows
    new = np.zeros(max(n - 1, 0), dtype=bool)
    for k in keys:
        v = table.column(k).to_numpy()
        new |= v[1:] != v[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, n]


ANCHORS = "k long, h long, _rid long, at long"


def dealt_anchors(h: list[np.ndarray], rid: list[np.ndarray], at: list[np.ndarray]) -> pa.RecordBatch:
    """Anchors of a batch as rows (k, h, _rid, at) to be dealt and sorted by ``k``.

    ``k`` is the anchor's hash, but for anchors that occur again in the batch: these are candidates
    already (``at`` is complemented to say so) and all but one of them go anywhere, so that an anchor that
    a third of all documents hold does not gather in one partition.
    """
    h, rid, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (h, rid, at))
    order = np.argsort(h, kind="stable")
    new = np.r_[True, h[order][1:] != h[order][:-1]][: len(h)]
    heads = np.flatnonzero(new)
    many = np.repeat(np.diff(np.r_[heads, len(h)]) > 1, np.diff(np.r_[heads, len(h)]))
    k, told = h.copy(), at.copy()
    told[order[many]] = ~at[order[many]]
    loose = order[many & ~new]
    k[loose] = spread(rid[loose] * 1_000_003 + at[loose])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k, h, rid, told)], ["k", "h", "_rid", "at"])


def repeated_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, _rid, at) of the anchors that occur more than once, from rows sorted by ``k``; holds one row between batches."""
    pending, before = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if pending is not None:
            batch = pa.Table.from_batches([pending, batch]).combine_chunks().to_batches()[0]
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        hit = np.r_[before, same] | np.r_[same, False]
        n = batch.num_rows - 1
        pending, before = batch.slice(n), bool(hit[n])
        yield _candidates(batch.slice(0, n), hit[:n])
    if pending is not None:
        yield _candidates(pending, np.array([before]))


def _candidates(batch: pa.RecordBatch, hit: np.ndarray) -> pa.RecordBatch:
    at = batch.column(3).to_numpy()
    keep = pa.array(hit | (at < 0))
    plain = pa.array(np.where(at < 0, ~at, at))
    return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), plain], ["h", "_rid", "at"]).filter(keep)


def merged(rid: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching intervals ``[first, end)`` of each row as one; both bounds grow together within a row."""
    order = np.lexsort((first, rid))
    rid, first, end = rid[order], first[order], end[order]
    if not len(rid):
        return rid, first, end
    new = np.r_[True, (rid[1:] != rid[:-1]) | (first[1:] > end[:-1])]
    return rid[new], first[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]


def spread(rid: np.ndarray) -> np.ndarray:
    """A sort key for rows that need no company: any partition will do."""
    return mix(rid.astype(np.int64).view(np.uint64)).view(np.int64)


def numbered(keys: list[int], pieces: list[bytes]) -> np.ndarray:
    """A number for each distinct pair of a key and a piece."""
    seen: dict[tuple[int, bytes], int] = {}
    return np.fromiter((seen.setdefault(x, len(seen)) for x in zip(keys, pieces)), dtype=np.int64, count=len(keys))


def firsts(same: np.ndarray, row: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, how often, others): the earliest of equals by row and start, the size of its group, and all others."""
    order = np.lexsort((first, row, same))
    heads = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]][: len(order)])
    other = np.ones(len(order), dtype=bool)
    other[order[heads]] = False
    return order[heads], np.diff(np.r_[heads, len(order)]), np.flatnonzero(other)


#: Anchors, and windows of hot anchors, whose bytes a task holds at a time.
SLICE = 100_000


def runs_of(n: np.ndarray, limit: int = SLICE) -> Iterator[slice]:
    """Slices of consecutive places whose counts ``n`` add up to about ``limit``."""
    at = np.cumsum(n) // limit
    cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(n)]
    return (slice(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()) if a < b)


#: Ways in which the rows of a hot anchor are dealt where hot anchors are too many to be broadcast.
SALTS = 64


def marked_hot(found: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """``found`` (h, _rid, ..) with ``hot``: whether its anchor is found more than ``rows`` times.

    Up to ``most`` hot anchors are broadcast. More are joined by anchor and a salt of the row, so that no task gets
    all rows of an anchor.
    """
    hot = materialize(found.groupBy("h").count().filter(F.col("count") > rows).select("h", F.lit(True).alias("hot")), "hot-anchors")
    n = hot.count()
    if not n:
        return found.withColumn("hot", F.lit(False))
    if n <= most:
        return found.join(F.broadcast(hot), "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    salted = hot.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["h", "_salt"], "left").withColumn("hot", F.coalesce("hot", F.lit(False))).drop("_salt")
