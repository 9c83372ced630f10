"""Mixing sources to target weights: entropy balancing, by DataFrame operations only.

Rates of documents stay as close to one as the targets allow, in relative entropy within 0 to 3
copies: the solution tilts each document exponentially in its size, ``3 / (1 + 2 exp(-t))`` with ``t``
the source's multiplier times the relative size. The multipliers solve the convex dual by Newton's
method; documents enter it as counts per source and size, so a step costs little, whatever the corpus.

Rates become whole copies by seeded priorities: from the largest documents down to the smallest, size
class by size class, the cut up to which copies are taken is set so that what the larger ones left
over is made up. All of this works on histograms whose size per source is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, documents, materialize, n_partitions, shielded, small

CAP = 3
BINS = 1024  # of the priority, for each unit of it
_LAST = 8 * BINS


def _key(source: Column | str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source) if isinstance(source, str) else source), F.lit("-"))


def ranked_sources(per: DataFrame) -> DataFrame:
    """``per`` with ``rank`` (from 0) by code point, nulls last: sorted in ranges, whose counts say where each begins."""
    n = n_partitions(per.sparkSession)
    order = F.col("source").asc_nulls_last()
    rows = materialize(per.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("_at", 33)
    before, upto = [], 0
    for p, count in sorted(rows.groupBy(part).count().collect()):  # a row a partition
        before.append((p, upto))
        upto += count
    starts = per.sparkSession.createDataFrame(before, "_part long, _before long")
    rows = rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return rows.withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at")


def targets(sizes: DataFrame) -> DataFrame:
    """(_source, source, source_size, target, n) from (source, size): weights 1, 2, 3, ... by code point, nulls last.

    Targets are the weights times a level. Sources that the level would lift above their limit stay at it,
    and the level for the others follows, until no other source is above: sums over all sources a round.
    """
    per = sizes.groupBy(_key().alias("_source"), "source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n"))
    per = ranked_sources(per).withColumn("weight", (F.col("rank") % 3 + 1).cast("double")).withColumn("full", (CAP * F.col("source_size")).cast("double"))
    per = materialize(per.drop("rank"), "weighted-sources")
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, above = 0.0, -1
    while True:
        limited = F.col("full") <= F.col("weight") * level
        sums = per.agg(F.count_if(limited), F.sum(F.when(limited, F.col("full")).otherwise(0.0)), F.sum(F.when(limited, 0.0).otherwise(F.col("weight")))).first()
        if sums[0] == above or not sums[2]:
            break
        above, level = sums[0], (total - sums[1]) / sums[2]
    return per.select("_source", "source", "source_size", F.least("full", F.col("weight") * level).alias("target"), "n")


def _few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of some ``rows`` rows in one file for each half million."""
    return df.coalesce(1 + rows // 500_000)


def _rate(tilt: Column) -> Column:
    return F.lit(float(CAP)) / (F.lit(1.0) + F.lit(CAP - 1.0) * F.exp(-tilt))


def solve(sizes: DataFrame, per: DataFrame, n_sources: int, tolerance: float = 1e-9, steps: int = 40) -> DataFrame:
    """``per`` with the multiplier ``tilt`` and the mean size of each source."""
    counts = materialize(sizes.filter("size > 0").groupBy(_key().alias("_source"), "size").agg(F.count(F.lit(1)).alias("_n")), "size-counts")
    mean = F.greatest(F.col("source_size"), F.lit(1)) / F.greatest(F.col("n"), F.lit(1))
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    now = per.withColumns({"mean_size": mean, "full": full, "tilt": F.lit(0.0), "_low": F.lit(float("-inf")), "_high": F.lit(float("inf")), "_off": F.when(full, 0.0).otherwise(1.0)})
    now = materialize(_few_files(now, n_sources), "multipliers")
    for _ in range(steps):
        z = F.col("size") / F.col("mean_size")
        rate = _rate(F.col("tilt") * z)
        open_ = now.filter(~F.col("full")).select("_source", "mean_size", "tilt")
        sums = counts.join(small(open_, n_sources), "_source").select("_source", (F.col("_n") * F.col("size") * rate).alias("_f"), (F.col("_n") * F.col("size") * z * rate * (1 - rate / CAP)).alias("_h"))
        sums = sums.groupBy("_source").agg(F.sum("_f").alias("_f"), F.sum("_h").alias("_h"))
        low = F.when(F.col("_f") < F.col("target"), F.col("tilt")).otherwise(F.col("_low"))
        high = F.when(F.col("_f") < F.col("target"), F.col("_high")).otherwise(F.col("tilt"))
        step = F.least(F.greatest((F.col("target") - F.col("_f")) / F.greatest(F.col("_h"), F.lit(1e-300)), F.lit(-4.0)), F.lit(4.0))
        newton = F.col("tilt") + step
        inside = (newton > F.col("_low2")) & (newton < F.col("_high2"))
        after = now.join(small(sums, n_sources), "_source", "left").withColumns({"_low2": low, "_high2": high})
        after = after.withColumn("_new", F.when(F.col("full") | F.col("_f").isNull(), F.col("tilt")).when(inside, newton).otherwise((F.col("_low2") + F.col("_high2")) / 2))
        off = F.when(F.col("full") | F.col("_f").isNull(), 0.0).otherwise(F.abs(F.col("_f") - F.col("target")) / F.col("target"))
        after = after.select("_source", "source", "source_size", "target", "n", "mean_size", "full", F.when(off <= tolerance, F.col("tilt")).otherwise(F.col("_new")).alias("tilt"), F.col("_low2").alias("_low"), F.col("_high2").alias("_high"), off.alias("_off"))
        now = materialize(_few_files(after, n_sources), "multipliers")
        if (now.agg(F.max("_off")).first()[0] or 0) <= tolerance:
            break
    return now.drop("_low", "_high", "_off")


def _priced(rows: DataFrame) -> DataFrame:
    """``rows`` with their rate, size class, and the bins of the priorities of their copies.

    Copy ``k`` has priority ``(k - 1 + u) / rate`` with a seeded ``u`` in 0 to 1: at a cut of one, a
    document takes its rate in the mean; a lower or higher cut scales all rates of the class.
    """
    rate = F.when(F.col("size") <= 0, 0.0).when(F.col("full"), float(CAP)).otherwise(_rate(F.col("tilt") * F.col("size") / F.col("mean_size")))
    rows = rows.withColumn("_rate", rate)

    def bin_(k: int) -> Column:
        v = (F.col("_u") + (k - 1)) / F.greatest("_rate", F.lit(1e-12))
        fine, coarse = F.floor(v * BINS), 2 * BINS + F.floor(BINS / 4 * F.log2(F.greatest(v, F.lit(2.0)) / 2))
        return F.least(F.when(v < 2, fine).otherwise(coarse), F.lit(_LAST)).cast("int")

    bins = F.when(F.col("size") > 0, F.array(*[bin_(k) for k in range(1, CAP + 1)]))
    return rows.withColumns({"_class": F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)).cast("double")) / 2).cast("int"), "_bins": bins})


def cuts(priced: DataFrame) -> DataFrame:
    """(_source, _class, _cut): copies whose bin is at most the cut are taken.

    The cut of a class is where its words come nearest to the sum of its rates and what larger classes
    have left over.
    """
    due = priced.filter("size > 0").groupBy("_source", "_class").agg(F.sum(F.col("size") * F.col("_rate")).alias("due"))
    bins = priced.select("_source", "_class", "size", F.explode("_bins").alias("_bin")).groupBy("_source", "_class", "_bin").agg(F.sum(F.col("size").cast("double")).alias("_words"))
    per = bins.groupBy("_source", "_class").agg(F.sort_array(F.collect_list(F.struct("_bin", "_words"))).alias("bins")).join(due, ["_source", "_class"])
    per = per.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct(F.col("_class").alias("class"), "due", "bins")), asc=False).alias("classes"))

    def best(goal: Column, bins: Column) -> Column:
        """The cut whose words come nearest to the goal, and those words."""
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("words"), F.lit(-1).alias("cut"))

        def step(a: Column, b: Column) -> Column:
            total = a["sum"] + b["_words"]
            nearer = F.abs(goal - total) < F.abs(goal - a["words"])
            return F.struct(total.alias("sum"), F.when(nearer, total).otherwise(a["words"]).alias("words"), F.when(nearer, b["_bin"]).otherwise(a["cut"]).alias("cut"))

        return F.aggregate(bins, start, step)

    none = F.array().cast("array<struct<class:int,cut:int>>")
    start = F.struct(F.lit(0.0).alias("left"), none.alias("cuts"))

    def fold(a: Column, c: Column) -> Column:
        goal = a["left"] + c["due"]
        chosen = F.transform(F.array(best(goal, c["bins"])), lambda x: F.struct((goal - x["words"]).alias("left"), F.concat(a["cuts"], F.array(F.struct(c["class"].alias("class"), x["cut"].alias("cut")))).alias("cuts")))
        return chosen[0]

    folded = per.select("_source", F.explode(F.aggregate("classes", start, fold)["cuts"]).alias("_c"))
    return folded.select("_source", F.col("_c.class").alias("_class"), F.col("_c.cut").alias("_cut"))


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's) and ``copies``.

    Sizes are words; a null text has size 0, and its document no copy. A null source is a source. Repeated
    rows are separate documents with equal copies, null ids are allowed, an empty table gives an empty
    result. Columns of ``docs`` named like an output are replaced. No document exceeds 3 copies.
    """
    outputs = ["size", "source_size", "target", "copies"]
    docs, back = shielded(docs)
    own = [c for c in docs.columns if c not in outputs]
    priority = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 12) / F.lit(float(1 << 52))
    rows = docs.select(*own).withColumns({"size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_u": priority})
    sizes = materialize(rows.select("source", "size", "_u"), "sizes")
    per = targets(sizes)
    n_sources = per.count()
    solved = solve(sizes, per, n_sources).drop("source", "n")
    cut = materialize(cuts(_priced(sizes.withColumn("_source", _key()).join(small(solved, n_sources), "_source"))), "cuts")
    out = _priced(rows.withColumn("_source", _key()).join(small(solved, n_sources), "_source"))
    out = out.join(small(cut, cut.count(), 20_000), ["_source", "_class"], "left")
    copies = F.coalesce(F.size(F.filter("_bins", lambda b: b <= F.col("_cut"))), F.lit(0))
    return back(out.select(*own, "size", "source_size", "target", copies.alias("copies")))


def mix_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: every document of ``docs`` as often as it is taken, with the columns of ``docs``."""
    clash = {c: f"own_{c}" for c in ("size", "source_size", "target", "copies") if c in docs.columns}
    own, back = shielded(docs.withColumnsRenamed(clash))
    out = mixed(own, seed).filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return back(out.select(*own.columns)).withColumnsRenamed({v: k for k, v in clash.items()})


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")
