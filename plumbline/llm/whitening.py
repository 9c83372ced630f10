"""Whitening of embeddings by matrix-free block subspace iteration.

Every pass over the rows computes Xᵀ(XQ) for the centred rows X and a thin orthonormal block Q, so no
covariance matrix is formed from a pass of its own and a task holds one d x p block besides its batch. The
blocks of the tasks are added up along a tree, in a fixed order. A Rayleigh-Ritz step on the driver turns
the block into Ritz pairs, whose residuals need no further pass; QR gives the next block. The iteration
ends when the residuals certify the leading k components.

A flat spectrum makes subspace iteration slow: it converges as the ratio of the first eigenvalue outside the
block to the k-th. Where the residuals say that more than ``patience`` passes are left, the block is doubled
by random directions, to all d dimensions at most, where one pass is enough.

Vectors are turned into whole numbers, so sums and deviations are exact at any order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from plumbline.llm.common import table

SCALE, SHIFT = 1024, 100_000
#: Entries beyond it are no exact doubles after scaling.
LARGEST = float(1 << 53)
#: How many partial results meet in a task of the tree.
FAN = 32
#: Entries of a batch that are worked on at once.
ENTRIES = 1 << 20


class Whitening(NamedTuple):
    """``components`` (d x k) are unit eigenvectors of the covariance, ``eigenvalues`` fall; ``drift`` is the mean of the centred rows, which is rounding."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    drift: np.ndarray
    identity_error: float
    passes: int
    residual: float


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole numbers) of the usable vectors, some ``ENTRIES`` at once, one length each."""
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
    flat = column.flatten()
    at = np.concatenate([[0], np.cumsum(np.maximum(sizes, 0))])
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(values * SCALE)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(whole) < LARGEST))])
    good = (sizes > 0) & (bad[at[1:]] == bad[at[:-1]])
    for size in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == size))
        step = max(1, ENTRIES // int(size))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield some, whole[at[some][:, None] + np.arange(size)].astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: as 64-bit integers, or as Python's where those are too short."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _deviations(z: np.ndarray) -> list[int | None]:
    most = max(abs(int(z.max(initial=0))), abs(int(z.min(initial=0))))
    if most * most * z.shape[1] >= 1 << 63:
        out = [int(v) for v in (z.astype(object) ** 2).sum(axis=1)]
        return [v if v < 1 << 63 else None for v in out]
    return (z.astype(np.int64) ** 2).sum(axis=1).tolist()


def _added(parts: DataFrame, schema: str, add: Callable[[pa.Table], pa.Table], by: list[str]) -> DataFrame:
    """One row of each ``by`` from the tasks' rows (part, ..): neighbours are added in groups of ``FAN``, then those sums in groups, then the rest."""
    for _ in range(2):
        parts = parts.withColumn("part", F.floor(F.col("part") / FAN).cast("long")).groupBy("part", *by).applyInArrow(add, schema)
    return parts.withColumn("part", F.lit(0).cast("long")).groupBy("part", *by).applyInArrow(add, schema)


def _usable(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).cast("array<double>").alias("v"))


def _totals(rows: DataFrame, column: str) -> tuple[int, list[int]]:
    """How many vectors there are of the length that most have, and their sums, as exact integers.

    Sums travel as 32 low bits and the rest, so that no partial sum is too long.
    """
    schema = "part long, size long, n long, high array<bigint>, low array<bigint>"
    arrow = pa.schema([("part", pa.int64()), ("size", pa.int64()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for some, x in _vectors(batch.column(0)):
                n, high, low = held.get(x.shape[1], [0, 0, 0])
                low = low + (x & 0xFFFFFFFF).sum(axis=0)
                held[x.shape[1]] = [n + len(some), high + (x >> 32).sum(axis=0) + (low >> 32), low & 0xFFFFFFFF]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pylist([{"part": part, "size": s, "n": n, "high": high.tolist(), "low": low.tolist()} for s, (n, high, low) in held.items()], arrow)

    def add(t: pa.Table) -> pa.Table:
        wide = lambda name: np.array(t.column(name).to_pylist(), dtype=np.int64).sum(axis=0)
        low = wide("low")
        row = {"part": t["part"][0].as_py(), "size": t["size"][0].as_py(), "n": sum(t["n"].to_pylist()), "high": (wide("high") + (low >> 32)).tolist(), "low": (low & 0xFFFFFFFF).tolist()}
        return pa.Table.from_pylist([row], arrow)

    best = _added(_usable(rows, column).mapInArrow(count, schema), schema, add, ["size"]).orderBy(F.col("n").desc(), F.col("size").desc()).first()
    return (0, []) if best is None else (best["n"], [(h << 32) + low for h, low in zip(best["high"], best["low"])])


def _summed(rows: DataFrame, column: str, n: int, sums: list[int], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what ``of`` makes of the centred rows of a batch."""
    d, schema = len(sums), "part long, s array<double>"
    arrow = pa.schema([("part", pa.int64()), ("s", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                if x.shape[1] == d:
                    got = of(_centred(x, n, sums).astype(np.float64) / n)
                    total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "s": total}], arrow)

    def add(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        flat = t.column("s").combine_chunks().flatten().to_numpy()
        return pa.Table.from_pylist([{"part": t["part"][0].as_py(), "s": flat.reshape(t.num_rows, -1).sum(axis=0)}], arrow)

    return np.array(_added(_usable(rows, column).mapInArrow(run, schema), schema, add, []).first()["s"])


def fit_whitening(rows: DataFrame, k: int = 8, column: str = "embedding", tolerance: float = 1e-13, patience: int = 8, max_passes: int = 200, seed: int = 11) -> Whitening:
    """The leading ``k`` components of the vectors in ``column``, all rows counted.

    A vector that is null, empty, or holds a null, an infinite or an undefined entry isn't used, nor one with
    an entry beyond 2^53 / 1024, and of vectors of several lengths only those of the length that most have
    (the longer one of equals). Repeated rows count as often as they occur. There are fewer components where
    the vectors have fewer dimensions, and none for a direction without variance. The residuals end below
    ``tolerance`` times the largest eigenvalue, or where rounding lets them fall no further, below 1e-9 of it.
    """
    n, sums = _totals(rows, column)
    d = len(sums)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0.0, 0, 0.0)
    rng = np.random.default_rng(seed)
    k = min(k, d)
    q = np.linalg.qr(rng.standard_normal((d, min(d, max(2 * k, 16)))))[0]
    worst, trace, drift = [], 0.0, np.zeros(d)
    for passes in range(1, max_passes + 1):
        got = _summed(rows, column, n, sums, lambda z, q=q: np.concatenate([(z.T @ (z @ q)).ravel(), z.sum(axis=0), [(z * z).sum()]]))
        y, drift, trace = got[: q.size].reshape(q.shape) / n, got[q.size : -1] / n, got[-1] / n
        y = y - np.outer(drift, drift @ q)
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = q @ turn
        residual = np.linalg.norm(y @ turn[:, :k] - ritz[:, :k] * values[:k], axis=0).max()
        scale = max(values[0], 0.0)
        worst.append(residual / scale if scale else 0.0)
        stuck = len(worst) > 3 and min(worst[-3:]) >= min(worst[:-3]) / 2 and max(worst[-3:]) < 1e-9
        if worst[-1] <= tolerance or stuck:
            break
        rate = worst[-1] / worst[-2] if len(worst) > 1 else 0.0
        q = y @ turn
        if q.shape[1] < d and rate and (rate >= 1 or np.log(tolerance / worst[-1]) / np.log(rate) > patience):
            q = np.hstack([q, scale * rng.standard_normal((d, min(d, 2 * q.shape[1]) - q.shape[1]))])
        q = np.linalg.qr(q)[0]
    else:
        raise RuntimeError(f"the residuals are at {worst[-1]:.1e} after {max_passes} passes")
    some = values[:k] > max(scale * 1e-12, 0.0)
    components, values = ritz[:, :k][:, some], values[:k][some]
    heaviest = components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])]
    components = components * np.where(heaviest < 0, -1.0, 1.0)
    if not len(values):
        return Whitening(n, sums, components, values, trace, drift, 0.0, passes, worst[-1])
    scaled = components / np.sqrt(values)
    mean = drift @ scaled

    def products(z: np.ndarray) -> np.ndarray:
        w = z @ scaled - mean
        return (w.T @ w).ravel()

    error = np.abs(_summed(rows, column, n, sums, products).reshape(len(values), -1) / n - np.eye(len(values))).max()
    return Whitening(n, sums, components, values, trace, drift, float(error), passes, worst[-1])


def whitened(rows: DataFrame, fit: Whitening, column: str = "embedding") -> DataFrame:
    """The rows whose vector is usable, with ``deviation`` (long) and ``whitened`` (array, a value for each component).

    ``deviation`` is the exact sum over dimensions of ``(n * x - S) ** 2``, null where a long can't hold it. Input
    columns with these names are replaced, all others stay; a table without usable vectors gives no row.
    """
    kept = rows.drop("deviation", "whitened")
    schema = StructType(kept.schema.fields + [StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    n, sums, d = fit.n, fit.sums, len(fit.sums)
    scaled = fit.components / np.sqrt(fit.eigenvalues) if d else fit.components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in _vectors(batch.column(batch.num_columns - 1)):
                if x.shape[1] != d:
                    continue
                z = _centred(x, n, sums)
                w = z.astype(np.float64) / n @ scaled
                part = batch.take(pa.array(some))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(_deviations(z), pa.int64()), lists], names=[*part.schema.names[:-1], "deviation", "whitened"])

    return kept.select("*", F.col(column).cast("array<double>").alias("_vector_")).mapInArrow(run, schema)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fit = fit_whitening(rows)
    told = F.lit([float(v / fit.trace) for v in fit.eigenvalues]) if len(fit.eigenvalues) else F.array().cast("array<double>")
    out = whitened(rows, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return out.select(
        "vec_id", (F.col("_at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(told, F.col("_at") + 1).alias("explained"), F.lit(fit.identity_error).alias("identity_error"),
    )
