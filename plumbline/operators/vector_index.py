"""A coarse index for vector search: vectors lie in cells around centroids, and a search reads the nearest cells only.

The centroids come from k-means by cosine over all rows, one distributed pass a round; a task sends one sum
for each cell. The rows are written by cell, so that a search prunes all others before it reads. The exact search
stays in ``operators.retrieval``; ``probes_for`` measures against it how many cells a recall needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.retrieval import _best_of_blocks, _unit, ranked, vector_search
from plumbline.sources.storage import settled

#: Rows of a cell that one task compares with the questions that probe it.
BLOCK = 16384


@dataclass(frozen=True)
class CoarseIndex:
    """Rows (chunk_id, embedding) below ``path``, in a folder for each cell; ``centroids`` are unit vectors, ``sizes`` the rows of each cell."""

    path: str
    centroids: np.ndarray
    sizes: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("chunk_id long, embedding array<double>, cell int").parquet(self.path)


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.flatten().to_numpy().reshape(len(column), -1))


def _nearest_cell(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (m @ centroids.T).argmax(axis=1)


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one pass: the direction of the sum of each cell's vectors; an empty cell stays."""
    schema, d = "cell int, s array<double>", centroids.shape[1]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(centroids)
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(1))
                np.add.at(sums, _nearest_cell(m, centroids), m)
        some = np.flatnonzero(sums.any(axis=1))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * d, pa.int32()), pa.array(sums[some].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), lists], ["cell", "s"])

    def add(t: pa.Table) -> pa.Table:
        total = t.column("s").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1).sum(axis=0)
        return pa.table({"cell": pa.array([t["cell"][0].as_py()], pa.int32()), "s": pa.array([total], pa.list_(pa.float64()))})

    out = centroids.copy()
    for cell, s in rows.mapInArrow(assign, schema).groupBy("cell").applyInArrow(add, schema).collect():
        if np.any(s):
            out[cell] = _unit(np.array([s]))[0]
    return out


def build_index(chunks: DataFrame, path: str, cells: int | None = None, rounds: int = 6) -> CoarseIndex:
    """Index all ``chunks`` (chunk_id, embedding) that have an embedding; all embeddings are of one length.

    ``cells`` is the root of the number of rows by default, 4096 at most; the driver holds that many
    centroids and nothing that grows with the rows. The first centroids are distinct ones of the rows least by a hash of
    their id. A cell of
    any size is written by as many tasks as its rows ask for.
    """
    spark = chunks.sparkSession
    rows = chunks.filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n = rows.count()
    cells = max(1, min(cells or math.isqrt(n), 4096, n or 1))
    first = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(2 * cells).collect()
    centroids = _unit(np.array(list(dict.fromkeys(tuple(r["embedding"]) for r in first))[:cells], dtype=np.float64)) if first else np.zeros((1, 1))
    for _ in range(rounds if first else 0):
        centroids = _moved(rows, centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell = _nearest_cell(_matrix(b.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell, pa.int32())], ["chunk_id", "embedding", "cell"])

    dealt = rows.mapInArrow(assign, "chunk_id long, embedding array<double>, cell int")
    dealt.repartitionByRange("cell", F.xxhash64("chunk_id")).write.partitionBy("cell").parquet(path)
    sizes = np.zeros(len(centroids), dtype=np.int64)
    if n:
        for cell, count in spark.read.schema("chunk_id long, cell int").parquet(path).groupBy("cell").count().collect():
            sizes[cell] = count
    return CoarseIndex(path, centroids, sizes)


def probed(index: CoarseIndex, queries: DataFrame, probes: int) -> DataFrame:
    """(query_id, embedding, cell): each query (query_id, embedding) with each of its ``probes`` nearest cells."""
    centroids = index.centroids

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = np.argsort(-(_matrix(b.column(1)) @ centroids.T), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(order.tolist(), pa.list_(pa.int32()))], ["query_id", "embedding", "cells"])

    rows = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(near, "query_id long, embedding array<double>, cells array<int>").select("query_id", "embedding", F.explode("cells").alias("cell"))


def indexed_search(index: CoarseIndex, queries: DataFrame, k: int, probes: int) -> DataFrame:
    """As ``vector_search``, among the rows of each query's ``probes`` nearest cells: (query_id, chunk_id, rank, score).

    Only the cells that some query probes are read. A cell's rows and the queries that probe it meet in blocks, so neither a
    large cell nor a cell that all queries want is one task's work.
    """
    spark = queries.sparkSession
    asked = settled(probed(index, queries, probes))
    wanted = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
    blocks = spark.createDataFrame([(int(c), int(max(1, -(-index.sizes[c] // BLOCK))), int(max(1, -(-n // BLOCK)))) for c, n in wanted], "cell int, row_blocks int, query_blocks int")
    rows = index.rows(spark).filter(F.col("cell").isin([c for c, _ in wanted]))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(F.broadcast(blocks), "cell").withColumn("_q", dealt("query_id", "query_blocks")).withColumn("_c", every("row_blocks")).select("cell", "_q", "_c", "query_id", "embedding")
    c = rows.join(F.broadcast(blocks), "cell").withColumn("_c", dealt("chunk_id", "row_blocks")).withColumn("_q", every("query_blocks")).select("cell", "_q", "_c", "chunk_id", "embedding")
    keys = ["cell", "_q", "_c"]
    out = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_best_of_blocks(k), "query_id long, chunk_id long, distance double")
    best = ranked(out, F.col("distance"), F.col("chunk_id")).filter(F.col("rank") < k)
    return best.select("query_id", "chunk_id", "rank", F.round(1 - F.col("distance"), 4).alias("score"))


def scanned_share(index: CoarseIndex, queries: DataFrame, probes: int) -> float:
    """The share of all rows that a query is compared with, on average."""
    per = probed(index, queries, probes).groupBy("cell").count().collect()
    n = sum(c for _, c in per) / max(probes and min(probes, len(index.centroids)), 1)
    return float(sum(index.sizes[cell] * c for cell, c in per) / max(n * index.sizes.sum(), 1))


def recall_of(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact search's rows that were found."""
    both = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return float(both.agg(F.coalesce(F.avg(F.coalesce("_hit", F.lit(0))), F.lit(1.0))).first()[0])


def probes_for(index: CoarseIndex, spark: SparkSession, k: int, recall: float = 0.95, queries: int = 128) -> int:
    """The fewest probes, among powers of two and all cells, that reach a recall for up to ``queries`` of the index's own rows, against the exact search."""
    rows = index.rows(spark)
    sample = settled(rows.orderBy(F.xxhash64("chunk_id", F.lit(7)), "chunk_id").limit(queries).select(F.col("chunk_id").alias("query_id"), "embedding"))
    exact = settled(vector_search(rows, sample, k))
    n, probes = len(index.centroids), 1
    while probes < n and recall_of(indexed_search(index, sample, k, probes), exact) < recall:
        probes *= 2
    return min(probes, n)
