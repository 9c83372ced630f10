"""Sharding by a hypergeometric communication matrix.

The rows are dealt to logical partitions by a hash. For each partition the exact number of rows that
go to each shard is drawn from the multivariate hypergeometric law, so that the row sums are the
partitions' sizes and the column sums the shards' fixed sizes. A partition then permutes its rows (a
rank by a seeded hash), hands them out by those counts, and every shard permutes what it has received.
The result is a uniform shuffle with exact shard sizes.

The matrix is a tree of two levels: the driver draws one row for each group of partitions, and a task
splits a group's row among its partitions. Both laws are the same, so the result is too. A shard orders
its rows by a second seeded hash; equal ranges of that hash are its blocks, whose counts give the slots
at which they begin, so no task holds a shard.

Rows that are equal in all columns are numbered, and each copy is dealt by itself. Every choice is a
function of the row's values, the number of the copy and the seed, so a task that runs again after an
executor was lost makes the same choice, and all passes over the rows agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import documents, materialize, n_partitions, shielded, small

OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without replacement are of the ``good``: inversion over all values with weight.

    The ratios of neighbouring probabilities are plain products, so one way serves counts of any size; what
    lies more than 12 standard deviations off has a probability below what a double holds.
    """
    low, high = max(0, n - bad), min(good, n)
    if low == high:
        return low
    total = good + bad
    mode = (good + 1) * (n + 1) // (total + 2)
    p = good / total
    reach = 40 + int(12 * math.sqrt(max(n * p * (1 - p) * (total - n) / max(total - 1, 1), 0.0)))
    first, last = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(first, last, dtype=np.float64)
    log = np.cumsum(np.r_[0.0, np.log((good - x) * (n - x) / ((x + 1) * (bad - n + x + 1)))])
    upto = np.cumsum(np.exp(log - log.max()))
    return first + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def communication_matrix(counts: list[int], places: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Counts of rows from each partition to each shard; its margins are ``counts`` and ``places``."""
    free, rows = [int(c) for c in places], []
    for n in counts:
        left, total, row = int(n), sum(free), []
        for c in free:
            total -= c
            row.append(hypergeometric(rng, c, total, left))
            left -= row[-1]
        rows.append(row)
        free = [c - x for c, x in zip(free, row)]
    return rows


def _hashable(docs: DataFrame) -> list[Column]:
    """All columns in a form that has a hash; what holds a map goes as its JSON."""
    holds_map = lambda t: isinstance(t, (T.MapType, T.VariantType)) or "map<" in t.simpleString()
    return [F.to_json(F.struct(F.col(f"`{f.name}`"))) if holds_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields]


#: Copies of a row that one task makes.
COPIES = 4096


def _numbered_copies(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with two hashes of their values (_h1, _h2) and the number of the copy among equal rows (_copy).

    Where no row occurs twice, which the hashes tell, nothing moves. Otherwise equal rows are counted, map-side first,
    and made again with their numbers, those of a row with many copies in several tasks.
    """
    columns = rows.columns
    keyed = rows.withColumns({"_h1": F.xxhash64(F.lit(seed), *_hashable(rows)), "_h2": F.xxhash64(F.lit(seed + 3), *_hashable(rows))})
    if keyed.groupBy("_h1", "_h2").count().filter("count > 1").isEmpty():
        return keyed.withColumn("_copy", F.lit(0).cast("long"))
    once = keyed.groupBy("_h1", "_h2").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("_row"), F.count(F.lit(1)).alias("_m"))
    few = once.filter(F.col("_m") <= COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    parts = once.filter(F.col("_m") > COPIES).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / COPIES))))
    parts = parts.repartition(n_partitions(rows.sparkSession), "_h1", "_h2", "_part")
    last = F.least(F.col("_m"), (F.col("_part") + 1) * COPIES) - 1
    many = parts.withColumn("_copy", F.explode(F.sequence(F.col("_part") * COPIES, last))).drop("_part")
    return few.unionByName(many).select("_row.*", "_h1", "_h2", "_copy")


def shard_rows(docs: DataFrame, n_shards: int = 40, seed: int = 20, rows_per_partition: int = 16384, group: int = 2048) -> DataFrame:
    """``docs`` with a shard, a slot and the row's size: law ``rows``, a uniform random permutation.

    Adds ``size`` (UTF-8 bytes plus 16; null text counts none), ``text_crc32`` (0 for a null or empty
    text), ``law``, ``shard``, ``slot`` (0, 1, ... within the shard) and a null ``grown_shard``; input
    columns with these names are replaced. Null ids are dealt like others, an empty table gives an empty
    result; rows that agree in id and text are told apart by their other columns, and copies of a row that
    is repeated as a whole are dealt independently of each other, at the price of a shuffle more. Shards differ by one row at most, whatever group of equal texts there is, so equal
    texts are not held together. Partitions and blocks hold some ``rows_per_partition`` rows, so their
    number grows with the table; the driver holds one row of ``n_shards`` counts for ``group`` of them.
    """
    spark = docs.sparkSession
    docs, back = shielded(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = _numbered_copies(docs.drop(*OUT), seed)
    n = docs.count()
    parts = max(n_partitions(spark) if n else 1, -(-n // rows_per_partition))
    per_shard = max(1, -(-n // (n_shards * rows_per_partition)))
    key = lambda i: F.xxhash64(F.lit(seed + i), "_h1", "_h2", "_copy")
    keys = {"_pid": F.pmod(key(0), F.lit(parts)), "_local": key(1), "_final": key(2)}

    counts = kept.select(keys["_pid"].alias("_pid")).groupBy("_pid").count().withColumn("_group", F.floor(F.col("_pid") / group))
    counts = materialize(counts.select("_group", "_pid", "count"), "partition-counts")
    totals = sorted((r[0], r[1]) for r in counts.groupBy("_group").agg(F.sum("count")).collect())
    shards = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    top = communication_matrix([c for _, c in totals], shards, np.random.default_rng(seed))
    margins = spark.createDataFrame([(g, row) for (g, _), row in zip(totals, top)], "_group long, _margin array<bigint>")

    def split(pdf):
        import pandas as pd

        pdf = pdf.sort_values("_pid")
        matrix = communication_matrix(pdf["count"].tolist(), pdf["_margin"].iloc[0].tolist(), np.random.default_rng([seed, int(pdf["_group"].iloc[0])]))
        return pd.DataFrame({"_pid": pdf["_pid"].values, "_ends": [np.cumsum(row).tolist() for row in matrix]})

    dealt = materialize(counts.join(F.broadcast(margins), "_group").groupBy("_group").applyInPandas(split, "_pid long, _ends array<bigint>"), "matrix")

    rank = lambda *by: F.row_number().over(Window.partitionBy(*by[0]).orderBy(*by[1])) - 1

    def sharded(rows: DataFrame) -> DataFrame:
        out = rows.withColumns(keys).withColumn("_rank", rank(["_pid"], ["_local", "_final"])).join(small(dealt, parts, 2048), "_pid")
        block = F.floor(F.shiftrightunsigned("_final", 12) / F.lit(float(1 << 52)) * per_shard).cast("int")
        return out.withColumns({"shard": F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int"), "_block": block}).drop("_ends", "_rank", "_pid")

    sizes = sharded(kept).groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("shard").orderBy("_block")) - F.col("_n")
    first = materialize(sizes.select("shard", "_block", upto.alias("_first")), "block-starts")
    out = sharded(kept.withColumns({"size": F.octet_length(text).cast("long") + 16, "text_crc32": F.crc32(text).cast("long")}))
    out = out.withColumn("_place", rank(["shard", "_block"], ["_final", "_local"])).join(small(first, n_shards * per_shard), ["shard", "_block"])
    out = out.withColumns({"slot": (F.col("_first") + F.col("_place")).cast("long"), "law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
    return back(out.select(*[F.col(f"`{c}`") for c in kept.columns if c not in ("_h1", "_h2", "_copy")], *OUT))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_rows(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", *OUT)
