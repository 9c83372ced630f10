"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed from left to right into phrases, each the shortest string that isn't a phrase yet (the
dictionary of LZ78). Two texts that compress well together have many phrases in common, so the Jaccard
similarity of phrase sets stands in for a compression distance. A fingerprint keeps the least ``K`` hashes of
the set, from which the similarity of two sets is estimated; sets of fewer phrases are kept whole, and
compared exactly.

The parse is a loop over code points in Python, which holds some 100 bytes a phrase of the longest text; hashes
are sums over a phrase's code points, made for all phrases of a text at once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline.llm.common import documents, n_partitions, unpacked

#: Hashes in a fingerprint, and hexadecimal digits of each.
K, DIGITS = 128, 10
_BASE = 0x9E3779B97F4A7C15 | 1


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v + np.uint64(0x9E3779B97F4A7C15)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


class Parse:
    """The phrases of a text that may go on: in the order in which they were found, and as a set.

    A phrase under way at the end of the text is one already, so the set is complete without it.
    """

    def __init__(self, text: str = ""):
        self.seen: set[str] = set()
        self.found: list[str] = []
        self.under_way = ""
        self.extend(text)

    def extend(self, text: str) -> None:
        seen, add, find, now = self.seen, self.seen.add, self.found.append, self.under_way
        for c in text:
            now += c
            if now not in seen:
                add(now)
                find(now)
                now = ""
        self.under_way = now

    def mark(self) -> tuple[int, str]:
        return len(self.found), self.under_way

    def back(self, mark: tuple[int, str]) -> None:
        """Undo what came after ``mark``."""
        n, self.under_way = mark
        self.seen.difference_update(self.found[n:])
        del self.found[n:]


#: Mixed values of the code points of the basic plane.
_POINTS = _mixed(np.arange(1 << 16, dtype=np.uint64))


def hashes_of(phrases: list[str]) -> np.ndarray:
    """A hash of every phrase."""
    if not phrases:
        return np.zeros(0, np.uint64)
    sizes = np.fromiter(map(len, phrases), np.int64, len(phrases))
    begin = np.cumsum(sizes) - sizes
    points = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    mixed = _POINTS[points] if points.max() < 1 << 16 else _mixed(points.astype(np.uint64))
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()) - 1, _BASE, dtype=np.uint64)])
    place = np.arange(len(points)) - np.repeat(begin, sizes)
    return _mixed(np.add.reduceat(mixed * powers[place], begin)) >> np.uint64(64 - 4 * DIGITS)


def least(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The least ``k`` of the hashes, ascending."""
    return np.unique(np.partition(hashes, k)[:k] if len(hashes) > k else hashes)


def fingerprint(text: str, k: int = K) -> np.ndarray:
    return least(hashes_of(Parse(text).found), k)


def written(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def alike(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity of two phrase sets; exact where both are held whole. Two empty sets are equal."""
    both = np.sort(np.concatenate([a, b]))
    if not len(both):
        return 1.0
    twice = both[1:] == both[:-1]
    rank = np.cumsum(np.concatenate([[True], ~twice]))
    union = int(rank[-1]) if len(a) < k and len(b) < k else min(k, int(rank[-1]))
    return int((twice & (rank[1:] <= union)).sum()) / union


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """``alike`` for two columns of fingerprints; null where one is null."""
    hashes = lambda c: F.transform(F.sequence(F.lit(0), (F.length(c) / DIGITS).cast("int") - 1), lambda i: F.substr(c, i * DIGITS + 1, F.lit(DIGITS)))
    listed = lambda c: F.when(F.length(c) > 0, hashes(c)).otherwise(F.array().cast("array<string>"))
    whole = (F.length(a) < k * DIGITS) & (F.length(b) < k * DIGITS)
    union = F.array_sort(F.array_union(listed(a), listed(b)))
    least = F.when(whole, union).otherwise(F.slice(union, 1, k))
    shared = F.array_intersect(least, F.array_intersect(listed(a), listed(b)))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(F.size(least) == 0, 1.0).otherwise(F.size(shared).cast("double") / F.size(least)))


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` with the ``fingerprint`` of the whole ``text``: up to ``k`` hashes in hexadecimal, ascending, joined.

    A null or empty text has an empty fingerprint, equal texts have equal ones. A column named ``fingerprint``
    is replaced, all others stay. Memory grows with the longest text only.
    """
    kept = docs.drop("fingerprint")
    schema = StructType(kept.schema.fields + [StructField("fingerprint", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_text(t.as_buffer().to_pybytes()) if t.is_valid else "" for t in batch.column(batch.num_columns - 1)]
            made = pa.array([written(fingerprint(t, k)) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "fingerprint"])

    return kept.select("*", F.col("text").alias("_text_")).mapInArrow(run, schema)


def _order(row) -> tuple:
    """Ascending: a null id first; rows of one id by a hash of their text, equal ones by their place in the input."""
    return (row[0] is not None, row[0] if row[0] is not None else 0, row[1], row[2])


def with_neighbours(docs: DataFrame) -> DataFrame:
    """(bucket, real, id, .., size, packed): the texts in runs that ascend by ``doc_id``, each run in one partition and led
    by a copy (``real`` false) of the row before it; before the first row comes the last one.

    The runs' last rows are found by a range partitioning of the ids alone, and there are as many as shuffle
    partitions. The texts then travel once, compressed.
    """
    n = n_partitions(docs.sparkSession)
    keyed = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("by_text"), F.monotonically_increasing_id().alias("place"), "text")
    order = [F.col("id").asc_nulls_first(), F.col("by_text"), F.col("place")]
    ranges = keyed.select("id", "by_text", "place").repartitionByRange(n, *order)
    lasts = sorted(_order(r["last"]) for r in ranges.groupBy(F.spark_partition_id()).agg(F.max(F.struct("id", "by_text", "place")).alias("last")).collect())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            keys = [_order(r) for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            bucket = [min(bisect_left(lasts, key), len(lasts) - 1) for key in keys]
            rows = list(range(len(keys)))
            ends = [i for i in rows if keys[i] == lasts[bucket[i]]]
            texts = [t.as_buffer() if t.is_valid else b"" for t in batch.column(3)]
            packed = [codec.compress(t, asbytes=True) for t in texts]
            every = pa.array(rows + ends)
            to = [*bucket, *((bucket[i] + 1) % len(lasts) for i in ends)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            columns = [batch.column(0), batch.column(1), batch.column(2), sizes, pa.array(packed, pa.binary())]
            real = [True] * len(rows) + [False] * len(ends)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(real), *(c.take(every) for c in columns)], ["bucket", "real", "id", "by_text", "place", "size", "packed"])

    dealt = keyed.mapInArrow(deal, f"bucket int, real boolean, id {kind}, by_text long, place long, size long, packed binary")
    return dealt.repartitionById(max(1, len(lasts)), F.col("bucket")).sortWithinPartitions("bucket", "real", *order)


def with_edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of the text edited with the next one's beginning.

    The next document is the one with the next smaller id; after the smallest comes the largest, null ids come
    last, rows of one id in an order by their texts. In the edited text the last half of the code points, rounded down,
    gives way to as many first ones of the next text, or all of them. A single row is its own next one. The
    likeness to the edited and to the next text is estimated from fingerprints alone. Both texts are parsed on from the same
    state at the end of the kept half, so the edited one costs half a parse more.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, before, print_before = [None, pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()], "", np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for real, key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), unpacked(batch.column(5), batch.column(6))):
                text = _text(text)
                half = len(text) // 2
                left = len(text) - half
                phrases = Parse(text[:left])
                mark = phrases.mark()
                phrases.extend(text[left:])
                hashes = hashes_of(phrases.found)
                own = least(hashes, k)
                if real:
                    phrases.back(mark)
                    edited = text[:left] + before[:half]
                    phrases.extend(edited[left:])
                    changed = least(np.concatenate([hashes[: mark[0]], hashes_of(phrases.found[mark[0] :])]), k)
                    digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                    out.append((key, len(text), digest, written(own), written(changed), alike(own, changed, k), alike(own, print_before, k)))
                before, print_before = text, own
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.schema.field(2).type, *kinds[1:]])], names)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_neighbours(docs).mapInArrow(run, schema)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edited(documents(spark, sf_dir).select("doc_id", "text"))
