"""Benchmark decontamination: spaced seeds, by DataFrame operations only.

A mask reads five word positions of a short stretch and ignores the others, so that a changed word at
an ignored position leaves the hash as it is. The hashes of all stretches of the documents are joined
with those of the benchmark. A hit fixes how the two texts align; the words around it are then
compared one by one.

The two masks are chosen so that every alignment of 12 words with at most two substitutions holds a
stretch that one of them reads unchanged; no overlap that counts is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import documents, let, materialize, small, table, words_of

#: Word positions that each mask reads.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 6, 7))
#: Words of a window and how many have to be equal; items of fewer words than the last occur within a text only whole.
WINDOW, LEAST_EQUAL, LEAST_WORDS = 12, 10, 5
_SEEDS = "array<struct<p:int,h:bigint>>"


def seeds(hashes: Column) -> Column:
    """Structs (position, hash) of every masked stretch of an array of word hashes."""

    def of(h: Column, mask: tuple[int, ...]) -> Column:
        last = F.size(h) - (mask[-1] + 1)
        read = lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(str(mask)), *[F.get(h, i + m) for m in mask]).alias("h"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), read)).otherwise(F.array().cast(_SEEDS))

    return let(hashes, lambda h: F.concat(*[of(h, m) for m in MASKS]))


def whole(hashes: Column, sizes: list[int]) -> Column:
    """Structs (position, hash) of every unmasked stretch of the given lengths."""

    def of(h: Column, n: int) -> Column:
        read = lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(n), F.slice(h, i + 1, n)).alias("h"))
        return F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.size(h) - n), read)).otherwise(F.array().cast(_SEEDS))

    return let(hashes, lambda h: F.concat(*[of(h, n) for n in sizes]))


def all_of(hashes: Column) -> Column:
    """The seed of a text that has under ``LEAST_WORDS`` words: all of them."""
    alone = F.array(F.struct(F.lit(0).alias("p"), F.xxhash64(F.lit("whole"), hashes).alias("h")))
    return F.when(F.size(hashes).between(1, LEAST_WORDS - 1), alone).otherwise(F.array().cast(_SEEDS))


def _words(df: DataFrame, keep: list[Column]) -> DataFrame:
    return df.select(*keep, F.transform(words_of(F.lower("text")), lambda w: F.xxhash64(w)).alias("_w"))


def contamination(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """Pairs of a document and a benchmark item whose texts overlap, one row per ``doc_id`` and ``item_id``.

    Words are lower-cased. They overlap if 12 words in a row of the item stand in the document with at
    least 10 of them equal, place by place; an item of 5 to 11 words must stand there whole and equal, and
    one of 1 to 4 words must be all of the document's words; one without words is ignored. Returns ``n_item_words``, ``n_equal`` and ``doc_start`` (equal words of the
    best alignment, and the document's word at which it would begin) and ``best_window`` (most equal
    words among 12). Null texts overlap with nothing; null ids are kept as a value; repeated rows give
    one pair, and of different texts under one id the best alignment counts. Hashes of words stand for
    the words: 64 bits each, and 10 of them have to agree. The benchmark's seeds are broadcast up to
    ``max_broadcast`` rows and shuffled beyond.
    """
    best = F.max(F.struct("n_equal", "best_window", (-F.col("doc_start")).alias("back"), "n_item_words")).alias("_b")
    out = overlaps(docs, benchmark, max_broadcast).groupBy("doc_id", "item_id").agg(best)
    return out.select(
        "doc_id", "item_id", F.col("_b.n_item_words").cast("long").alias("n_item_words"), F.col("_b.n_equal").cast("long").alias("n_equal"), F.col("_b.best_window").cast("long").alias("best_window"), (-F.col("_b.back")).cast("long").alias("doc_start")
    )


def overlaps(docs: DataFrame, benchmark: DataFrame, max_broadcast: int = 200_000) -> DataFrame:
    """The alignments that count, as ``contamination`` describes them, of each text: ``_text`` is the hash of the
    document's, and items are told apart by id and text (``_item``)."""
    items = _words(benchmark.select("item_id", "text").distinct(), ["item_id", F.xxhash64("item_id", "text").alias("_item")]).filter(F.size("_w") > 0).withColumnsRenamed({"_w": "_iw"})
    items = materialize(items, "benchmark-words")
    short = sorted(r[0] for r in items.filter(F.size("_iw").between(LEAST_WORDS, WINDOW - 1)).select(F.size("_iw")).distinct().collect())
    stretches = lambda w: F.concat(seeds(w), all_of(w), *[whole(w, short)] if short else [])
    of_item = F.when(F.size("_iw") >= WINDOW, seeds(F.col("_iw"))).when(F.size("_iw") < LEAST_WORDS, all_of(F.col("_iw")))
    probe = items.select("_item", "_iw", F.explode(of_item.otherwise(whole(F.col("_iw"), short) if short else F.array().cast(_SEEDS))).alias("_s"))
    probe = probe.filter(~F.size("_iw").between(LEAST_WORDS, WINDOW - 1) | (F.col("_s.h") == F.xxhash64(F.size("_iw"), "_iw")))
    probe = materialize(probe.select("_item", F.size("_iw").alias("_n"), F.col("_s.p").alias("_q"), F.col("_s.h").alias("_h")), "benchmark-seeds")
    n_seeds = probe.count()

    d = _words(docs, [F.col("doc_id"), F.xxhash64("text").alias("_text")])
    # the document's words from where the item would begin, and how many of the item's come before the text
    offset = F.col("_p") - F.col("_q")
    from_ = lambda start: F.slice("_w", F.greatest(start, F.lit(0)) + 1, F.greatest(F.col("_n") + F.least(start, F.lit(0)), F.lit(0)))
    by = ["doc_id", "_text", "_item", "doc_start"]
    if n_seeds <= max_broadcast:  # the words stay where they are, only those around a hit travel
        found = d.select("doc_id", "_text", "_w", F.explode(stretches(F.col("_w"))).alias("_s")).withColumns({"_p": F.col("_s.p"), "_h": F.col("_s.h")})
        hits = found.join(F.broadcast(probe), "_h")
        lines = hits.select("doc_id", "_text", "_item", offset.alias("doc_start"), from_(offset).alias("_dw")).groupBy(*by).agg(F.first("_dw").alias("_dw"))
    else:  # seeds are shuffled without the words, which then join the hits of their text
        found = d.select("doc_id", "_text", F.explode(stretches(F.col("_w"))).alias("_s")).select("doc_id", "_text", F.col("_s.p").alias("_p"), F.col("_s.h").alias("_h"))
        hits = found.join(probe, "_h").select("doc_id", "_text", "_item", "_n", offset.alias("doc_start")).distinct()
        texts = d.select(F.col("doc_id").alias("_id"), F.col("_text").alias("_of"), "_w").dropDuplicates(["_id", "_of"])
        hits = hits.join(texts, hits["doc_id"].eqNullSafe(texts["_id"]) & (hits["_text"] == texts["_of"]))
        lines = hits.select(*by, from_(F.col("doc_start")).alias("_dw"))
    both = lines.join(small(items, n_seeds, max_broadcast // 40), "_item")
    part = F.slice("_iw", F.greatest(-F.col("doc_start"), F.lit(0)) + 1, F.size("_dw"))
    both = both.withColumn("_same", F.zip_with("_dw", part, lambda a, b: F.when(a == b, 1).otherwise(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    windows = F.transform(F.sequence(F.lit(0), F.size("_same") - WINDOW), lambda i: total(F.slice("_same", i + 1, WINDOW)))
    both = both.withColumn("best_window", F.when(F.size("_same") >= WINDOW, F.array_max(windows)).otherwise(total(F.col("_same"))))
    both = both.withColumns({"n_equal": total(F.col("_same")), "n_item_words": F.size("_iw")})
    counts = F.when(F.col("n_item_words") >= WINDOW, (F.size("_same") >= WINDOW) & (F.col("best_window") >= LEAST_EQUAL))
    return both.filter(counts.otherwise(F.col("n_equal") == F.col("n_item_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps with a benchmark item; columns and other rows stay as they are.

    Rows go by their id and their own text, so a clean text stays whatever other rows share its id, null or not.
    """
    bad = overlaps(docs, benchmark).select(F.col("doc_id").alias("_bad"), F.col("_text").alias("_bad_text")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"]), "left_anti")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
