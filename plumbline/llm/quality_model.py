"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn on one binned feature at a time, so that each feature ends with a
lookup table from bin to log-odds; the strongest pairs of features get a table each in a second phase.
A score is a sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import crc_bucket, documents, table

FEATURES = ["log_words", "word_length", "upper", "symbols", "punctuation", "exclamation", "digits", "distinct", "distinct_pairs", "repeated_lines", "non_ascii", "lines"]
_SYMBOLS = np.frombuffer(b"#*$%&|<>", dtype=np.uint8)
_PUNCTUATION = np.frombuffer(b".,;:?", dtype=np.uint8)


def features(text: str | None) -> list[float]:
    """Statistics of a whole text, in the order of FEATURES; an empty or null text gives zeros."""
    t = text or ""
    h = np.bincount(np.frombuffer(t.encode(), dtype=np.uint8), minlength=256)
    words, lines = t.split(), t.split("\n")
    n, chars, letters = max(len(words), 1), max(int(h.sum()), 1), max(int(h[65:91].sum() + h[97:123].sum()), 1)
    return [
        float(np.log1p(len(words))), sum(map(len, words)) / n, h[65:91].sum() / letters, h[_SYMBOLS].sum() / n, h[_PUNCTUATION].sum() / n, h[33] / n,
        h[48:58].sum() / chars, len(set(words)) / n, len(set(zip(words, words[1:]))) / n, 1 - len(set(lines)) / len(lines), h[128:].sum() / chars, len(lines) / n,
    ]


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values of a tree of at most four leaves over ordered bins."""

    def cut(a: int, b: int) -> int:
        cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        gain = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
        return a + 1 + int(gain.argmax()) if b - a > 1 else b

    mid = cut(0, len(g))
    edges = sorted({0, cut(0, mid), mid, cut(mid, len(g)) if mid < len(g) else mid, len(g)})
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values of the best pair of cuts of a grid, one on each axis, and what they gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for x in (cg, ch):
        a, row, col, all_ = x[:-1, :-1], x[:-1, -1:], x[-1:, :-1], x[-1, -1]
        parts.append([a, row - a, col - a, all_ - row - col + a])
    gain = sum(_gain(p, q) for p, q in zip(*parts))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    v = [p[i, j] / (q[i, j] + 1.0) for p, q in zip(*parts)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j] - _gain(cg[-1, -1], ch[-1, -1]))


@dataclass
class AdditiveModel:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (a, b), t in self.pairs.items():
            z += t[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 60, n_pairs: int = 6, bins: int = 32, coarse: int = 8, rate: float = 0.1) -> AdditiveModel:
    """Cyclic boosting: every round visits each feature once; then every round visits each chosen pair."""
    model = AdditiveModel()
    if not len(y):
        return model
    mean = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(mean / (1 - mean)))
    if y.min() == y.max():
        return model
    quantiles = lambda c, k: np.unique(np.quantile(c, np.linspace(0, 1, k + 1)[1:-1]))
    model.edges = [quantiles(c, bins) for c in x.T]
    model.coarse = [quantiles(c, coarse) for c in x.T]
    fine = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    grid = [np.searchsorted(e, c, side="right") for e, c in zip(model.coarse, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j, b in enumerate(fine):
            p = 1 / (1 + np.exp(-z))
            k = len(model.tables[j])
            step = rate * _tree(np.bincount(b, y - p, k), np.bincount(b, p * (1 - p), k))
            model.tables[j] += step
            z += step[b]

    def sums(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
        cell = grid[a] * shape[1] + grid[b]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    able = [(a, b) for a, b in combinations(range(x.shape[1]), 2) if len(model.coarse[a]) and len(model.coarse[b])]
    strongest = sorted(able, key=lambda ab: -_quadrants(*sums(*ab))[1])[:n_pairs]
    model.pairs = {ab: np.zeros((len(model.coarse[ab[0]]) + 1, len(model.coarse[ab[1]]) + 1)) for ab in strongest}
    for _ in range(pair_rounds):
        for (a, b), t in model.pairs.items():
            step = rate * _quadrants(*sums(a, b))[0]
            t += step
            z += step[grid[a], grid[b]]
    return model


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` columns and the array of FEATURES of every whole text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(rows, pa.list_(pa.float64()))], [*carry, "features"])

    kinds = dict(docs.dtypes)
    return docs.select(*carry, "text").mapInArrow(measure, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", features array<double>")


def score_quality(docs: DataFrame, labels: DataFrame, max_labels: int = 6000, threshold: float = 0.7, seed: int = 6) -> DataFrame:
    """Quality of every whole text as ``labels.quality`` marks it.

    Learns from at most ``max_labels`` labelled rows with ``crc32(doc_id) % 4 <> 2``, chosen by a seeded
    hash; labels, ``lang``, ``source`` and ``doc_id`` are no input of a score. Returns ``doc_id,
    held_out, score, predicted``. Null and empty texts are scored as texts without words; without any
    label all scores are 0.5. A null id is not held out and not learned from; repeated rows give a row
    each; a label that disagrees with another counts as a row of its own.
    """
    usable = labels.filter(F.col("quality").isNotNull() & (crc_bucket() != 2)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    picked = usable.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality").limit(max_labels)
    got = measured(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), ["doc_id", "quality"])
    got = got.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "quality", "features").limit(2 * max_labels).collect()
    got.sort(key=lambda r: (r["doc_id"], r["quality"], r["features"]))
    x = np.array([r["features"] for r in got]).reshape(len(got), len(FEATURES))
    model = fit(x, np.array([float(r["quality"] > 0) for r in got]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(np.array([features(t.as_py()) for t in batch.column(2)]).reshape(batch.num_rows, len(FEATURES)))
            out = [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(crc_bucket() == 2, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
