"""Mixing, sharding and the whole pipeline: exact properties."""

import random
import zlib
from collections import Counter
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tables import SMALL
from plumbline.llm import mixing, queries
from plumbline.llm.mixing import mix_documents, mixed
from plumbline.llm.sharding import communication_matrix, hypergeometric, shard_rows


def targets(sizes):
    """Targets by repeated sharing, in plain Python."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    free, full = set(order), {}
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        total = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free}
        above = {s for s in free if share[s] > 3 * sizes[s]}
        if not above:
            return full | share
        full |= {s: 3 * sizes[s] for s in above}
        free -= above


def check_mix(rows, texts, slack):
    sizes = Counter()
    for r in rows:
        assert r["size"] == len(brute.words(texts[r["doc_id"]][0]))
        sizes[texts[r["doc_id"]][1]] += r["size"]
    want, taken = targets(dict(sizes)), Counter()
    for r in rows:
        s = texts[r["doc_id"]][1]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= slack * want[s] + 3, (s, taken[s], want[s])


def test_mix_of_the_small_table(spark):
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    once = [r.asDict() for r in queries.QUERIES["op7_mixing"](spark, SMALL).orderBy("doc_id").collect()]
    check_mix(once, texts, 0.25)
    assert once == [r.asDict() for r in queries.QUERIES["op7_mixing"](spark, SMALL).orderBy("doc_id").collect()]


def test_mix_edges(spark):
    rng = random.Random(7)
    rows = [(i, "w " * int(rng.lognormvariate(5, 1)), rng.choice(["a", "B", "é", None, "hot", "hot", "hot"])) for i in range(600)]
    rows += [(700, None, "a"), (701, "", "nothing"), (702, "w " * 50, "tiny"), (703, "w " * 100_000, "hot")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("own"))
    out = mixed(df)
    got = [r.asDict() | {"taken": r["size"] * r["copies"]} for r in out.collect()]
    check_mix(got, {i: (t, s) for i, t, s in rows}, 0.02)
    assert next(r for r in got if r["doc_id"] == 702)["copies"] == 3
    assert mixed(df.filter("false")).count() == 0
    copies = {r["doc_id"]: r["copies"] for r in got}
    mix = mix_documents(df)
    assert mix.columns == df.columns and {r["size"] for r in mix.select("size").distinct().collect()} == {"own"}
    assert {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {i: c for i, c in copies.items() if c}


def test_mix_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (None, "a", "t"), (None, None, None)], "doc_id long, text string, source string")
    rows = mixed(df).collect()
    assert len(rows) == 4 and len({r["copies"] for r in rows if r["doc_id"] == 1}) == 1


def test_matrix_margins():
    rng = random.Random(1)
    counts = [rng.randrange(50) for _ in range(30)]
    places = [sum(counts) // 40 + (i < sum(counts) % 40) for i in range(40)]
    m = np.array(communication_matrix(counts, places, np.random.default_rng(5)))
    assert (m.sum(axis=1) == counts).all() and (m.sum(axis=0) == places).all() and (m >= 0).all()
    large = np.array(communication_matrix([3 * 10**10, 5, 7 * 10**10], [25 * 10**9] * 4 + [5], np.random.default_rng(5)))
    assert large.sum(axis=1).tolist() == [3 * 10**10, 5, 7 * 10**10] and large.sum(axis=0).tolist() == [25 * 10**9] * 4 + [5] and (large >= 0).all()


def test_multipliers_against_bisection(spark):
    """The dual's solution of every source, found by halving an interval instead of Newton's steps."""
    rng = random.Random(12)
    rows = [(f"s{k}", rng.choice([0, 1, 7, 30, 400, 5000]) + rng.randint(0, 40)) for k in range(9) for _ in range(rng.choice([3, 40, 300]))] + [(None, 50), (None, 0), ("empty", 0)]
    sizes = spark.createDataFrame(rows, "source string, size long")
    solved = mixing.solve(sizes, per := mixing.targets(sizes), per.count()).collect()
    assert len(solved) == 11 and any(r["full"] for r in solved) and sum(not r["full"] for r in solved) >= 3
    for r in solved:
        mine = np.array([n for s, n in rows if s == r["source"] and n > 0], dtype=float)
        assert r["source_size"] == mine.sum() and r["target"] <= 3 * mine.sum() * (1 + 1e-12)
        if r["full"] or not len(mine):
            continue
        words = lambda t: (mine * 3 / (1 + 2 * np.exp(-t * mine / r["mean_size"]))).sum()
        low, high = -100.0, 100.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < r["target"] else (low, mid)
        assert abs(words(r["tilt"]) - r["target"]) <= 1e-6 * r["target"] and abs(r["tilt"] - low) <= 1e-4 * max(1, abs(low))


def test_hypergeometric_law():
    """Frequencies of all values against the exact law, and moments beyond the sizes that common generators draw."""
    rng = np.random.default_rng(3)
    for good, bad, n in [(5, 7, 6), (1, 30, 4), (40, 3, 20), (3, 0, 2)]:
        got = np.bincount([hypergeometric(rng, good, bad, n) for _ in range(4000)], minlength=n + 1) / 4000
        law = [comb(good, k) * comb(bad, n - k) / comb(good + bad, n) for k in range(n + 1)]
        assert np.abs(got - law).max() < 0.04
    good, bad, n = 10**11, 3 * 10**11, 10**10
    x = np.array([hypergeometric(rng, good, bad, n) for _ in range(400)], dtype=float)
    sd = (n * 0.25 * 0.75 * (1 - n / (good + bad))) ** 0.5
    assert abs(x.mean() - n / 4) < 4 * sd / 20 and 0.85 < x.std() / sd < 1.15


def check_shards(rows, n_shards=40):
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    sizes = [len(slots.get(s, [])) for s in range(n_shards)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(n_shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_of_the_small_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_sharding"](spark, SMALL).collect()
    check_shards(rows)
    for r in rows:
        b = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 16, zlib.crc32(b), "rows", None)
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.QUERIES["op9_sharding"](spark, SMALL).collect()}
    assert again == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_shards_with_hot_copies_nulls_and_clashes(frame):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(500)] + [(None, None), (None, None), (7, "x"), (7, "x"), (8, "")]
    df = frame(rows)
    out = shard_rows(df, rows_per_partition=4, group=7)
    got = out.collect()
    assert len(got) == len(rows) and "shard" in out.columns
    check_shards(got)
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(16, 0)}
    assert shard_rows(df.filter("false")).count() == 0


def test_rows_that_differ_elsewhere_are_dealt_alike_again(spark):
    """Rows of one id and text get the same place in every run, also when they come in another order; maps and long texts pass."""
    rows = [(1, "same", f"url{i}", {"k": i}) for i in range(60)] + [(2, "x" * 3_000_000, "long", {})]
    df = spark.createDataFrame(rows, "doc_id long, text string, url string, more map<string,int>")
    place = lambda d: {r["url"]: (r["shard"], r["slot"]) for r in shard_rows(d, n_shards=7, rows_per_partition=5).select("url", "shard", "slot").collect()}
    once = place(df)
    assert len(once) == 61 and once == place(df.orderBy(F.rand(1)))


def test_shuffle_is_uniform(spark):
    """Neighbours in the input land in all shards alike: a chi-square test over shard and slot."""
    df = spark.range(8000).selectExpr("id as doc_id", "'t' as text")
    rows = shard_rows(df, n_shards=8, rows_per_partition=200).collect()
    seen = np.zeros((8, 8))
    for r in rows:
        seen[r["doc_id"] // 1000, r["shard"]] += 1
    half = np.array([r["doc_id"] for r in rows if r["slot"] < 500])
    assert ((seen - 125) ** 2 / 125).sum() < 100 and abs(half.mean() - 4000) < 150


def test_copies_of_a_row_are_dealt_independently(spark):
    """Three copies each of 4000 rows: all in one shard one time in 1600, and neighbours by chance only."""
    df = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text", "explode(sequence(1, 3)) as _c").drop("_c")
    rows = shard_rows(df, rows_per_partition=1000).collect()
    check_shards(rows)
    places = {}
    for r in rows:
        places.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    assert len(places) == 4000 and all(len(set(p)) == 3 for p in places.values())
    together = sum(len({s for s, _ in p}) == 1 for p in places.values())
    pairs = sum(a[0] == b[0] for p in places.values() for a, b in ((p[0], p[1]), (p[0], p[2]), (p[1], p[2])))
    adjacent = sum(a[0] == b[0] and abs(a[1] - b[1]) == 1 for p in places.values() for a in p for b in p) // 2
    assert together <= 10 and abs(pairs - 300) < 70 and adjacent < 15
    assert sorted(map(tuple, rows)) == sorted(map(tuple, shard_rows(df.orderBy(F.rand(1)), rows_per_partition=1000).collect()))


def test_one_row_repeated_a_hundred_thousand_times(spark):
    df = spark.range(100_000).selectExpr("7L as doc_id", "'hot' as text").unionByName(spark.range(100_000).selectExpr("id + 10 as doc_id", "'t' as text"))
    out = shard_rows(df, n_shards=10).select("shard", "slot", (F.col("doc_id") == 7).alias("hot"))
    per = out.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("hot").alias("h"), F.count_distinct("slot").alias("d"), F.avg(F.when(F.col("hot"), F.col("slot"))).alias("m")).collect()
    assert [(r["n"], r["d"]) for r in per] == [(20_000, 20_000)] * 10 and sum(r["h"] for r in per) == 100_000
    assert all(abs(r["h"] - 10_000) < 350 and abs(r["m"] - 10_000) < 300 for r in per)  # both five deviations off


# --- the pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    columns, state = docs.columns, docs
    for name, stage in p.STAGES:
        before = [(r["doc_id"], r["text"]) for r in state.collect()]
        state = stage(spark, state, SMALL)
        after = Counter(r["doc_id"] for r in state.collect())
        if name != "sharding":
            assert state.columns == columns
        if name == "quality_rules":
            kept = {r["doc_id"] for r in queries.QUERIES["op4_quality_rules"](spark, SMALL).filter("kept").collect()}
            assert set(after) == kept
        elif name == "near_dedup":
            assert set(after) == {i for i, v in brute.near_dedup(before, 80).items() if v[2]}
        elif name == "decontamination":
            assert set(after) == {i for i, _ in before} - {d for d, _ in brute.contamination(before, bench)}
        elif name == "mixing":
            assert set(after) <= {i for i, _ in before} and max(after.values()) <= 3
        else:
            assert sum(after.values()) == len(before)
            check_shards(state.collect())
    final = p.run(spark, SMALL)
    assert Counter(r["doc_id"] for r in final.collect()) == after


def test_pipeline_of_odd_rows(spark, frame):
    """Null texts and ids, repeated rows and clashing columns go through every stage."""
    import corpus_pipeline as p

    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(999)}" for _ in range(60))) for i in range(30)] + [(None, None), (None, "x " * 30), (3, "y z " * 40), (3, "y z " * 40), (99, "")]
    docs = frame(rows)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() > 0
    assert p.STAGES[0][1](spark, frame([]), SMALL).count() == 0
