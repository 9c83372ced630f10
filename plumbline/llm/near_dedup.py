"""MinHash near-duplicates by tensored banding.

Two small collections of ``tables`` band keys are made, each key from ``band`` minhashes; every pair of
a key of the first and one of the second is a table key. So ``tables ** 2`` tables cost only
``2 * tables * band`` minhashes. Texts that meet in a table are put into families; inside a family the
full shingle sets are compared, and links join texts of ``percent`` similarity and more.

Texts with equal shingle sets are one class from the start, whatever their number. Large families are
dealt into blocks, and all blocks are compared with the first one, each pair of blocks in a task of its own. What
that links is one cluster, most of a family of copies as a rule; then only members outside the largest
cluster are compared with all. So the work grows with the family and with its square only as far as
its members are no copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, materialize, n_partitions, shielded, with_row_ids
from plumbline.llm.components import connected_components
from plumbline.llm.hashing import OTHER_VALUES, U, boundaries, byte_groups, mix, whole_groups, word_hashes

SHINGLE = 5
_rng = np.random.default_rng(85)
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) * U(2) + U(1)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, int]]:
    """(place, sorted distinct shingle hashes, second hash) of every text; A-Z are lower-cased.

    The second hash is an independent one of the only shingle of a set of one, and 0 for other sets: equal
    sets are found by 128 bits, which for larger sets are two sums over all shingles.
    """
    for places, group in byte_groups(texts):
        data = np.frombuffer(b"\n".join(group).lower(), dtype=np.uint8)
        h, starts, ends = word_hashes(data)
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(b) + 1 for b in group]))
        five = np.zeros(max(len(h) - SHINGLE + 1, 0), dtype=np.uint64)
        for i in range(SHINGLE):
            five += h[i : len(h) - SHINGLE + 1 + i] * _PLACE[i] if len(five) else five
        five = mix(five)
        for place, a, b in zip(places, bounds, bounds[1:]):
            n = b - a
            if n >= SHINGLE:
                out = np.unique(five[a : b - SHINGLE + 1])
            elif n:
                out = mix(np.array([(h[a:b] * _PLACE[8 : 8 + n]).sum(dtype=np.uint64) + U(n)]))
            else:
                out = np.zeros(0, np.uint64)
            yield place, out, _other_hash(data[starts[a] : ends[min(b, a + SHINGLE) - 1]]) if len(out) == 1 else 0


def _other_hash(words: np.ndarray) -> int:
    h, _, _ = word_hashes(words, OTHER_VALUES)
    return int(mix(np.array([(h * _PLACE[: len(h)]).sum(dtype=np.uint64) + U(len(h))]))[0])


def signature(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 1 << 13):
        np.minimum(out, (h[i : i + (1 << 13), None] * a + b).min(axis=0), out=out)
    return out


def signatures(docs: DataFrame, tables: int, band: int, seed: int) -> DataFrame:
    """(_rid, n_shingles, f1, f2, left, right): a fingerprint of the set and the keys of both collections."""
    rng = np.random.default_rng(seed)
    m = 2 * tables * band
    a, b = rng.integers(1, 2**63, m, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 2**63, m, dtype=np.uint64)
    fold = rng.integers(1, 2**63, band, dtype=np.uint64) * U(2) + U(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f = np.zeros(batch.num_rows, np.int64), np.zeros((batch.num_rows, 2), np.uint64)
            keys = np.zeros((batch.num_rows, 2 * tables), np.uint64)
            for i, h, other in shingle_sets(batch.column(1)):
                n[i] = len(h)
                if len(h):
                    f[i] = mix(h).sum(dtype=np.uint64), U(other) if len(h) == 1 else mix(h ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                    keys[i] = mix((signature(h, a, b).reshape(2 * tables, band) * fold).sum(axis=1, dtype=np.uint64))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(k.ravel().view(np.int64)), tables).cast(pa.list_(pa.int64())) for k in (keys[:, :tables].copy(), keys[:, tables:].copy())]
            cols = [batch.column(0), pa.array(n), pa.array(f[:, 0].copy().view(np.int64)), pa.array(f[:, 1].copy().view(np.int64)), *lists]
            yield pa.RecordBatch.from_arrays(cols, ["_rid", "n_shingles", "f1", "f2", "left", "right"])

    return docs.select("_rid", "text").mapInArrow(sign, "_rid long, n_shingles long, f1 long, f2 long, left array<long>, right array<long>")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from the first text of each table key to the others, from rows sorted by key and text."""
    key, first = None, None
    for batch in batches:
        k, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.r_[True, k[1:] != k[:-1]]
        group = np.cumsum(new) - 1
        heads = r[new].copy()
        if key is not None and k[0] == key:
            heads[0] = first
        head = heads[group]
        other = head != r
        key, first = k[-1], head[-1]
        yield pa.RecordBatch.from_arrays([pa.array(head[other]), pa.array(r[other])], ["u", "v"])


def linked(sizes: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The least place that each set is connected with, through pairs of ``percent`` similarity and more.

    Sets of one shingle are in one class if they are equal, so two of them that come here differ.
    """
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    run = np.cumsum(np.r_[False, values[1:] != values[:-1]])
    shared = np.bincount(run)[run] > 1
    owner, run = owner[shared], np.unique(run[shared], return_inverse=True)[1]
    common = np.zeros((n, n), dtype=np.float32)
    width = max(1, (1 << 22) // n)
    for a in range(0, int(run[-1]) + 1 if len(run) else 0, width):
        lo, hi = np.searchsorted(run, [a, a + width])
        m = np.zeros((n, width), dtype=np.float32)
        m[owner[lo:hi], run[lo:hi] - a] = 1
        common += m @ m.T
    common = common.astype(np.int64)
    near = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    near &= (sizes[:, None] > 1) | (sizes[None, :] > 1)
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = np.minimum(least, least[least])
        if (least == label).all():
            return label
        label = least


def compare(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["family", "i", "j"], 2000):
            ids = table.column("_rid").to_numpy()
            offsets = np.r_[0, np.cumsum([len(x) for x in table.column("sets")])]
            flat = pa.concat_arrays([c.flatten() for c in table.column("sets").chunks]).to_numpy()
            u, v = [], []
            cuts = boundaries(table, ["family", "i", "j"])
            for a, b in zip(cuts, cuts[1:]):
                at = a + np.argsort(ids[a:b], kind="stable")
                if b - a > 1:
                    label = linked(np.diff(offsets)[at], [flat[offsets[x] : offsets[x + 1]] for x in at], percent)
                    joined = label != np.arange(b - a)
                    u.append(ids[at][label[joined]])
                    v.append(ids[at][joined])
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return run


def _links_in_cells(docs: DataFrame, placed: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (u, v) between the texts that share a cell of their family; ``placed`` is (_rid, family, cells of i and j)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, family, cells = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            out: list[tuple] = []
            for at, h, _ in shingle_sets(batch.column(3)):
                out += [(family[at], c["i"], c["j"], rid[at], h.view(np.int64)) for c in cells[at]]
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["family", "i", "j", "_rid", "sets"])

    texts = placed.select("_rid", "family", "cells").join(docs.select("_rid", "text"), "_rid").select("_rid", "family", "cells", "text")
    sets = texts.mapInArrow(sets_of, "family long, i int, j int, _rid long, sets array<long>")
    sets = sets.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    return sets.mapInArrow(compare(percent), "u long, v long")


def tables_for(percent: int, band: int, miss: float = 1.5e-4) -> int:
    """Keys of each collection with which a pair at the threshold is missed with probability ``miss`` at most."""
    apart = 1 - (percent / 100) ** band
    return max(1, math.ceil(math.log(miss / 2) / math.log(apart))) if apart > 0 else 1


def near_duplicates(docs: DataFrame, percent: int = 85, tables: int | None = None, band: int = 3, block: int = 400, first_block: int = 128, seed: int = 8) -> DataFrame:
    """(_rid, n_shingles, root): the least row that each row of ``docs`` (with ``_rid``, ``text``) is linked to.

    A pair at the threshold is missed by all tables with probability about 2 * (1 - (percent/100) ** band) **
    tables, and much less above it; ``tables`` follows from the threshold if it is not given (10 at 85, 14 at
    80), so that this is 0.00015 at most. Every pair that meets is compared exactly, unless its texts are
    linked already. Families are dealt into blocks of ``first_block``, of which the first meets all others, so a
    task of the first comparison holds two blocks; members outside the main cluster go in blocks of ``block``.
    """
    spark = docs.sparkSession
    tables = tables or tables_for(percent, band)
    n = n_partitions(spark)
    sig = materialize(signatures(docs, tables, band, seed), "signatures")
    # written out, so that the join below has plain shuffles on both sides and a hot class can be split
    classes = materialize(sig.filter("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("_rid").alias("class")), "set-classes")
    reps = materialize(sig.join(classes, ["f1", "f2", "n_shingles"], "left").select("_rid", "n_shingles", F.coalesce("class", "_rid").alias("class")), "classes")

    first = sig.filter("n_shingles > 0").join(reps.filter("_rid = class").select("_rid"), "_rid", "left_semi")
    pairs = F.flatten(F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(i, j, x, y))))
    keys = first.select(F.explode(pairs).alias("key"), "_rid")
    met = keys.repartition(n, "key").sortWithinPartitions("key", "_rid").mapInArrow(_meetings, "u long, v long")
    families = materialize(connected_components(met), "families")

    sized = families.join(reps, families.node == reps._rid)
    whole = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("n_shingles"))
    in_blocks = lambda size: F.greatest(F.ceil(F.col("n") / size), F.ceil(F.col("n_shingles") / (size * 2000))).cast("int")
    members = families.join(whole, "component").select(F.col("node").alias("_rid"), F.col("component").alias("family"), in_blocks(min(first_block, block)).alias("blocks"), in_blocks(block).alias("large_blocks"))
    members = members.withColumn("mine", F.pmod(F.xxhash64("_rid"), F.col("blocks")).cast("int"))

    # all meet the first block of their family; of a small family that is all of it
    every = lambda n, cell: F.transform(F.sequence(F.lit(0), F.col(n) - 1), cell)
    cell = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    meets_first = F.when(F.col("mine") == 0, every("blocks", lambda j: cell(F.lit(0), j))).otherwise(F.array(cell(F.lit(0), F.col("mine"))))
    links = materialize(_links_in_cells(docs, members.withColumn("cells", meets_first), percent, n), "links-to-first-block")
    roots = connected_components(links)
    large = members.filter("blocks > 1")
    if not large.isEmpty():
        large = large.join(roots, large["_rid"] == roots.node, "left").select("_rid", "family", F.col("large_blocks").alias("blocks"), F.coalesce("component", "_rid").alias("root"))
        large = large.withColumn("mine", F.pmod(F.xxhash64("_rid", F.lit(2)), F.col("blocks")).cast("int"))
        large = materialize(large, "large-families")
        clusters = large.groupBy("family", "root").agg(F.count(F.lit(1)).alias("n"))
        main = clusters.groupBy("family").agg(F.max(F.struct("n", F.col("root").alias("main"))).alias("m"), F.sum("n").alias("all")).select("family", "m.main", (F.col("all") - F.col("m.n")).alias("rest"), "all")
        # of most of a family outside its main cluster there is no main cluster to speak of: all blocks meet all
        main = main.filter("rest > 0").withColumn("rest_blocks", F.when(2 * F.col("rest") <= F.col("all"), F.ceil(F.col("rest") / block)).otherwise(0).cast("int"))
        open_ = large.join(main, "family").withColumn("outside", F.col("root") != F.col("main"))
        meets_all = every("blocks", lambda j: cell(F.least("mine", j), F.greatest("mine", j)))
        as_any = every("rest_blocks", lambda i: cell(i, F.col("mine")))
        as_rest = every("blocks", lambda j: cell(F.pmod(F.xxhash64("_rid", F.lit(1)), F.col("rest_blocks")), j))
        cells = F.when(F.col("rest_blocks") == 0, meets_all).when(F.col("outside"), F.array_union(as_any, as_rest)).otherwise(as_any)
        more = materialize(_links_in_cells(docs, open_.withColumn("cells", cells), percent, n), "links-to-the-rest")
        roots = connected_components(roots.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    out = reps.join(roots, reps["class"] == roots.node, "left")
    return out.select("_rid", "n_shingles", F.coalesce("component", "class").alias("root"))


def label_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    A set is the distinct 5-word shingles, or the whole sequence as one for 1 to 4 words. Empty and null
    texts have no shingle, no link, and are kept. ``component_id`` is the least id reachable. Where ids
    are null or repeated, rows are told apart in the order of id and text; the first of a component is
    kept. Other columns are not read; an empty table gives an empty result.
    """
    rows, name = with_row_ids(docs.select("doc_id", "text"))
    out = name(name(near_duplicates(rows, **how), "_rid", "doc_id"), "root", "component_id")
    return out.select("doc_id", "n_shingles", "component_id", (F.col("_rid") == F.col("root")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates; columns stay as they are."""
    own, back = shielded(docs)
    rows, _ = with_row_ids(own)
    kept = near_duplicates(rows, **how).filter("_rid = root").select("_rid")
    return back(rows.join(kept, "_rid", "left_semi").select(*own.columns))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_near_duplicates(documents(spark, sf_dir), percent=85)
