"""Quality rules: robust multivariate outliers of text statistics, by DataFrame operations only.

Each text becomes a vector of transformed statistics. For every language and source the minimum-
covariance-determinant estimate is found by concentration steps from the medians: keep the three
quarters of the rows that are nearest by Mahalanobis distance, estimate centre and scatter from them,
repeat, then reweight once. Texts beyond a chi-square quantile are rejected.

Quantiles come from histograms of fixed bins, which merge exactly, so verdicts don't depend on how
the rows are partitioned. Each statistic has a least standard deviation: statistics that are constant
in clean text (no symbol, no repeated line) would otherwise make a single symbol an outlier.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import SPACES, documents, let, materialize, shielded, small, words_of

#: Statistic, its transformation's column, and its least standard deviation.
LEAST_SD = {"_x0": 0.1, "_x1": 0.04, "_x2": 0.15, "_x3": 0.12, "_x4": 1.5}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8
P = len(LEAST_SD)


def chi_square_cdf(x: float, k: float) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    term = total = 1 / (k / 2)
    n = k / 2
    while term > total * 1e-15:
        n += 1
        term *= x / 2 / n
        total += term
    return min(1.0, math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2)) * total)


def chi_square_quantile(p: float, k: float) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, k) < p else (low, mid)
    return (low + high) / 2


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the text.

    Windows are hashed by doubling (pairs, fours, eights). Most texts have distinct windows only and
    end there; for the others, windows sorted by hash show the repeated starts, whose union is counted.
    """
    pair = lambda h, step: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def union(starts: Column) -> Column:
        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda a, s: F.struct(s.alias("last"), (a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def of_sorted(s: Column) -> Column:
        same = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
        starts = F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.get(s, i - 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))
        return union(starts)

    def of_windows(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(ordered, of_sorted))

    eights = let(hashes, lambda h: let(pair(h, 1), lambda h2: let(pair(h2, 2), lambda h4: pair(h4, 4))))
    windows = F.slice(eights, 1, F.size(words) - (WINDOW - 1))
    return F.when(F.size(words) > WINDOW, let(windows, of_windows)).otherwise(0).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the base statistics of the whole text and the base verdict."""
    text = F.coalesce(F.col("text"), F.lit(""))
    without = lambda chars: F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.drop(*BASE, "_words", "_lines", "_n_lines").withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    out = out.select(
        *docs.drop(*BASE, "_words", "_lines", "_n_lines").columns,
        F.size("_words").cast("long").alias("n_words"),
        without(SPACES).cast("long").alias("word_chars"),
        (F.length(text) - without("#*$%&|<>")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def vector() -> dict[str, Column]:
    """Transformed statistics: rates, on scales where clean texts of any length lie close together."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return {
        "_x0": F.log(chars / words),
        "_x1": F.sqrt(F.col("n_symbols") / chars),
        "_x2": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")),
        "_x3": F.sqrt(F.col("n_repeat_words") / words),
        "_x4": F.log(words),
    }


def _distance(df: DataFrame) -> DataFrame:
    """``df`` with ``_d2``, by forward substitution through the Cholesky factor ``_l<i><j>``."""
    for i in range(P):
        rest = F.col(f"_x{i}") - F.col(f"_m{i}")
        for j in range(i):
            rest = rest - F.col(f"_l{i}{j}") * F.col(f"_y{j}")
        df = df.withColumn(f"_y{i}", rest / F.col(f"_l{i}{i}"))
    return df.withColumn("_d2", sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(P)), F.lit(0.0)))


def _cholesky(df: DataFrame, scale: float) -> DataFrame:
    """Centres and factors from the moments ``_a<i>`` (means of offsets) and ``_p<i><j>`` (means of their products)."""
    least = list(LEAST_SD.values())
    for i in range(P):
        for j in range(i + 1):
            c = (F.col(f"_p{i}{j}") - F.col(f"_a{i}") * F.col(f"_a{j}")) * scale
            if i == j:
                c = F.greatest(c, F.lit(least[i] ** 2))
            for k in range(j):
                c = c - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            df = df.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(c, F.lit((least[i] / 100) ** 2))) if i == j else c / F.col(f"_l{j}{j}"))
    return df.select("_group", *[(F.col(f"_o{i}") + F.col(f"_a{i}")).alias(f"_m{i}") for i in range(P)], *[f"_l{i}{j}" for i in range(P) for j in range(i + 1)])


def _moments(df: DataFrame) -> DataFrame:
    y = [F.col(f"_x{i}") - F.col(f"_m{i}") for i in range(P)]
    products = [F.avg(y[i] * y[j]).alias(f"_p{i}{j}") for i in range(P) for j in range(i + 1)]
    return df.groupBy("_group").agg(*[F.first(f"_m{i}").alias(f"_o{i}") for i in range(P)], *[F.avg(y[i]).alias(f"_a{i}") for i in range(P)], *products)


def _quantile_bin(hist: DataFrame, by: list[str], share: float) -> DataFrame:
    """The first bin at which ``share`` of the rows of its group is reached; ``hist`` has ``_bin`` and ``_n``."""
    w = Window.partitionBy(*by)
    cum = hist.withColumns({"_cum": F.sum("_n").over(w.orderBy("_bin")), "_all": F.sum("_n").over(w)})
    return cum.filter(F.col("_cum") >= share * F.col("_all")).groupBy(*by).agg(F.min("_bin").alias("_bin"))


def mcd(stats: DataFrame, n_groups: int, keep: float = 0.75, steps: int = 3) -> DataFrame:
    """Centre ``_m<i>`` and Cholesky factor ``_l<i><j>`` of each ``_group`` of ``stats``."""
    least = list(LEAST_SD.values())
    x = stats.select("_group", *LEAST_SD)
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.floor(F.col(f"_x{i}") * 4 / least[i]).alias("_bin")) for i in range(P)])).alias("_b")
    hist = x.select("_group", bins).groupBy("_group", F.col("_b._i").alias("_i"), F.col("_b._bin").alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    medians = _quantile_bin(hist, ["_group", "_i"], 0.5)
    medians = medians.groupBy("_group").agg(*[F.max(F.when(F.col("_i") == i, (F.col("_bin") + 0.5) * least[i] / 4)).alias(f"_m{i}") for i in range(P)])
    model = medians.select("*", *[F.lit(least[i] if i == j else 0.0).alias(f"_l{i}{j}") for i in range(P) for j in range(i + 1)])
    model = materialize(model, "mcd-start")
    inside = chi_square_quantile(keep, P)
    scale = keep / chi_square_cdf(inside, P + 2)
    near = chi_square_quantile(0.975, P)
    for step in range(steps + 1):
        d = _distance(x.join(small(model, n_groups), "_group"))
        if step < steps:
            d = d.withColumn("_bin", F.floor(F.log(F.col("_d2") + 1e-6) * 20))
            cut = _quantile_bin(d.groupBy("_group", "_bin").agg(F.count(F.lit(1)).alias("_n")), ["_group"], keep).withColumnRenamed("_bin", "_cut")
            chosen = d.join(small(cut, n_groups), "_group").filter(F.col("_bin") <= F.col("_cut"))
        else:  # reweighting: all rows that the raw estimate doesn't call outliers
            chosen, scale = d.filter(F.col("_d2") <= near), 0.975 / chi_square_cdf(near, P + 2)
        fresh = _cholesky(_moments(chosen), scale)
        # a group may have no row that near; it keeps what it had
        had = model.select("_group", F.struct(*[c for c in model.columns if c != "_group"]).alias("_had"))
        new = fresh.select("_group", F.struct(*[c for c in fresh.columns if c != "_group"]).alias("_new"))
        model = had.join(new, "_group", "left").select("_group", F.coalesce("_new", "_had").alias("_model")).select("_group", "_model.*")
        model = materialize(model.coalesce(1), "mcd-step")
    return model


def quality_rules(docs: DataFrame, carry: list[str] | None = None, tail: float = 1e-6, min_rows: int = 50) -> DataFrame:
    """``carry`` columns of ``docs`` (all by default) with base statistics, ``base_failed``, ``outlier_distance`` and ``kept``.

    Groups are languages and sources, nulls being values of their own; groups of under ``min_rows``
    rows that pass the base rule share one pooled estimate. A null text has no word and fails the base
    rule, as any text of under 20 words does. Repeated rows and null ids are judged row by row. Columns
    of ``docs`` named like an output are replaced. An empty table gives an empty result. The table of
    statistics, and what is carried, is written to the shared folder once.
    """
    outputs = [*BASE, "base_failed", "outlier_distance", "kept"]
    docs, back = shielded(docs.select(*dict.fromkeys([*(carry or docs.columns), "text", "lang", "source"])) if carry else docs)
    carry = [c for c in (carry or docs.columns) if c not in outputs]
    stats = materialize(text_statistics(docs).withColumns(vector()).select(*carry, *[F.struct("lang", "source").alias("_of")], *BASE, "base_failed", *LEAST_SD), "statistics")
    passed = stats.filter(~F.col("base_failed"))
    key = F.xxhash64(F.coalesce(F.concat(F.lit("="), F.col("_of.lang")), F.lit("-")), F.coalesce(F.concat(F.lit("="), F.col("_of.source")), F.lit("-")))
    sizes = materialize(passed.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).coalesce(1), "group-sizes")
    n_groups = sizes.count()
    large = sizes.filter(F.col("_rows") >= min_rows).select("_key", F.lit(True).alias("_own"))
    grouped = lambda df: df.withColumn("_key", key).join(small(large, n_groups), "_key", "left").withColumn("_group", F.when(F.col("_own"), F.col("_key")).otherwise(F.lit(0))).drop("_key", "_own")
    model = mcd(grouped(passed), n_groups)
    judged = _distance(grouped(stats).join(small(model, n_groups), "_group", "left"))
    inside = F.coalesce(F.col("_d2") <= chi_square_quantile(1 - tail, P), F.lit(True))
    return back(judged.select(*carry, *BASE, "base_failed", F.col("_d2").alias("outlier_distance"), (~F.col("base_failed") & inside).alias("kept")))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(documents(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", *BASE, "base_failed", "kept", F.round("outlier_distance", 6).alias("outlier_distance"))
