"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its hashed character n-grams; a linear softmax reads
the language from it. Both are trained together by stochastic gradient descent on a bounded, seeded
sample. As the mean and the softmax are linear, embedding and weights fold into one table of logits
per n-gram bucket, which is all that scoring needs. A temperature and a rejection threshold are
calibrated on a part of the sample that the training does not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import crc_bucket, documents

BITS = 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text's place) of every n-gram inside a word; a word carries a blank on both sides."""
    code = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le"), dtype=np.uint32) for t in texts]
    owner = np.repeat(np.arange(len(code)), [len(c) for c in code])
    c = np.concatenate(code) if code else np.zeros(0, np.uint32)
    letter = letter_table()[c]
    blank = ~letter
    # one blank between words, two between texts
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & blank[:-1] & (owner[1:] == owner[:-1]) & np.r_[True, owner[1:-1] != owner[:-2]] if len(c) > 1 else False
    c, owner, blank = np.where(letter, c, 32)[keep].astype(np.uint32), owner[keep], blank[keep]
    runs = np.cumsum(blank)
    grams, owners = [], []
    for n in ORDERS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        ok = (runs[n - 2 : n - 2 + m] == runs[:m]) & ~(blank[:m] & blank[1 : m + 1]) & (owner[:m] == owner[n - 1 :])
        h = np.full(m, 2166136261 * n & 0xFFFFFFFF, dtype=np.uint32)
        for i in range(n):
            h = (h ^ c[i : i + m]) * np.uint32(2654435761)
            h ^= h >> np.uint32(15)
        grams.append((h >> np.uint32(32 - BITS))[ok])
        owners.append(owner[:m][ok])
    return (np.concatenate(grams), np.concatenate(owners)) if grams else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    langs: list[str] = field(default_factory=list)
    logits: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0), np.float32))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    temperature: float = 1.0
    reject_below: float = 0.0

    def raw(self, texts: list[str]) -> np.ndarray:
        """Logits of each text: the mean of its n-grams' rows plus the bias."""
        grams, owner = subwords(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        sums = [np.bincount(owner, weights=self.logits[:, k][grams], minlength=len(texts)) for k in range(len(self.langs))]
        return (np.stack(sums, axis=1) if sums else np.zeros((len(texts), 0))) / n[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.raw(texts) / self.temperature)


def train(
    texts: list[str], langs: list[str], dim: int = 16, epochs: int = 6, rate: float = 0.5, piece: int = 400, seed: int = 1, accept: float = 0.99
) -> LanguageModel:
    """Fit by SGD on pieces of ``piece`` n-grams; every fifth text calibrates temperature and rejection."""
    names = sorted(set(langs))
    if not names:
        return LanguageModel()
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    held = np.arange(len(texts)) % 5 == 4
    units = []
    for i in np.flatnonzero(~held):
        grams, _ = subwords([texts[i]])
        starts = rng.permutation(max(1, -(-len(grams) // piece)))[:3] * piece
        for s in starts:
            ids, n = np.unique(grams[s : s + piece], return_counts=True)
            if len(ids):
                units.append((ids, (n / n.sum()).astype(np.float32), y[i]))
    share = np.bincount([u[2] for u in units], minlength=len(names)).astype(float)
    weight = np.where(share > 0, share.sum() / np.maximum(share, 1) / len(names), 0).clip(0.2, 5)
    emb = rng.uniform(-1, 1, (1 << BITS, dim)).astype(np.float32) 
    w, b = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, at = max(1, epochs * len(units)), 0
    for _ in range(epochs):
        for u in rng.permutation(len(units)):
            ids, share_u, k = units[u]
            lr = np.float32(rate * (1 - at / steps) * weight[k])
            x = share_u @ emb[ids]
            g = softmax(x @ w + b)
            g[k] -= 1
            back = w @ g
            w -= lr * np.outer(x, g)
            b -= lr * g
            emb[ids] -= lr * np.outer(share_u * np.float32(10), back)
            at += 1
    model = LanguageModel(names, (emb @ w).astype(np.float32), b)
    if held.any():
        z, t = model.raw([texts[i] for i in np.flatnonzero(held)]), y[held]
        losses = {temp: -np.log(softmax(z / temp)[np.arange(len(t)), t] + 1e-12).mean() for temp in np.geomspace(0.05, 5, 41)}
        model.temperature = float(min(losses, key=losses.get))
        p = softmax(z / model.temperature)
        order = np.argsort(-p.max(axis=1), kind="stable")
        right = np.cumsum(p.argmax(axis=1)[order] == t[order]) / np.arange(1, len(t) + 1)
        good = np.flatnonzero(right >= accept)
        model.reject_below = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return model


def training_sample(docs: DataFrame, per_lang: int, max_docs: int, crop_chars: int, seed: int, max_langs: int, few: int = 8) -> tuple[list[str], list[str]]:
    """A bounded sample for the driver: about ``per_lang`` texts of each language and ``max_docs`` in all, but some
    ``few`` of every language; a seeded stretch of ``crop_chars`` characters of each.

    Rows are taken by a hash of their id and text below a rate that follows from the language's count, so no
    language's rows have to come together. Of more than ``max_langs`` languages the most frequent are learned.
    """
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_bucket() != 2))
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_langs).collect()
    if not counts:
        return [], []
    share = min(1.0, max_docs / sum(min(r["n"], per_lang) for r in counts))
    rates = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, max(share * per_lang, few) / r["n"])) for r in counts], "lang string, _rate double")
    taken = usable.join(F.broadcast(rates), "lang").filter(F.shiftrightunsigned(h, 12) < F.col("_rate") * (1 << 52))
    start = F.when(F.length("text") > crop_chars, F.pmod(h, F.greatest(F.length("text") - crop_chars + 1, F.lit(1)))).otherwise(0).cast("int") + 1
    got = taken.select("doc_id", "lang", F.col("text").substr(start, F.lit(crop_chars)).alias("text"), h.alias("_h"))
    got = got.orderBy("_h", "doc_id", "lang").limit(2 * (max_docs + few * len(counts))).collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    order = np.random.default_rng(seed).permutation(len(got))
    return [got[i]["text"] for i in order], [got[i]["lang"] for i in order]


def identify_language(docs: DataFrame, per_lang: int = 1200, max_docs: int = 6000, crop_chars: int = 4000, max_langs: int = 5000, seed: int = 1) -> DataFrame:
    """Language of every whole text.

    Learns from rows with a text, a language and ``crc32(doc_id) % 4 <> 2`` only (a bounded sample, the
    bound being the parameters); ``lang``, ``source`` and ``doc_id`` are no input of a prediction.
    Returns ``doc_id, held_out, lang_pred, score, rejected``: ``und`` with score 0 for a null text, one
    without a letter, or when there is nothing to learn from; ``rejected`` is true for these and where
    the calibrated score is below the threshold. A null id is not held out and not learned from.
    Repeated rows give a row each.
    """
    texts, langs = training_sample(docs, per_lang, max_docs, crop_chars, seed, max_langs)
    model = train(texts, langs, seed=seed)
    # plain values: a broadcast object would need this package on the executors
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(**shared.value)
        for batch in batches:
            texts = [x.as_py() if ok.as_py() and m.langs else None for x, ok in zip(batch.column(2), batch.column(3))]
            best, score = np.full(len(texts), -1), np.zeros(len(texts))
            group: list[int] = []
            size = 0
            for i, t in enumerate([*texts, None]):
                last = i == len(texts)
                if t is not None:
                    group.append(i)
                    size += len(t)
                if group and (size > _CHUNK or last):
                    p = m.probabilities([texts[j] for j in group])
                    best[group], score[group] = p.argmax(axis=1), p.max(axis=1)
                    group, size = [], 0
            names = [m.langs[k] if k >= 0 else UNKNOWN for k in best]
            rejected = (best < 0) | (score < m.reject_below)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    rows = docs.select(
        "doc_id",
        F.coalesce(crc_bucket() == 2, F.lit(False)).alias("held_out"),
        "text",
        F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"),
    )
    return rows.mapInArrow(predict, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, rejected boolean")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(documents(spark, sf_dir).select("doc_id", "text", "lang"))
