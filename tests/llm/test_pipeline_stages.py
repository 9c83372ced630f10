"""Stages of the pipeline on rows that an operator's defaults would treat differently."""

import random

import brute
import corpus_pipeline
from plumbline.llm.decontamination import contamination, decontaminate
from plumbline.llm.near_dedup import tables_for

STAGES = dict(corpus_pipeline.STAGES)


def test_near_dedup_from_80_percent(spark, frame):
    """Pairs of 0.81 to 0.846 are one document to the stage; pairs of 0.794 and less stay two."""
    rng = random.Random(80)
    rows = []
    for i in range(80):
        words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        changed = 8 + i % 4  # 88/104, 87/105, 86/106; 85/107 is below
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-changed] + [f"x{rng.randrange(10**9)}" for _ in range(changed)]))]
    want = {i for i, v in brute.near_dedup(rows, 80).items() if v[2]}
    assert len(want) == 100
    assert {r["doc_id"] for r in STAGES["near_dedup"](spark, frame(rows), "").collect()} == want


def test_tables_follow_the_threshold():
    assert (tables_for(85, 3), tables_for(80, 3), tables_for(100, 3)) == (10, 14, 1)
    for percent in range(50, 100):
        assert 2 * (1 - (percent / 100) ** 3) ** tables_for(percent, 3) <= 1.5e-4


def test_decontamination_by_row(spark, frame, tmp_path):
    """Of rows with null or repeated ids only those go whose own text overlaps."""
    leak = " ".join(f"w{i}" for i in range(15))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = frame([(None, leak), (None, "clean"), (None, None), (3, f"a {leak} b"), (3, "clean too"), (3, "clean too"), (4, leak), (5, "")])
    out = STAGES["decontamination"](spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(None, "clean"), (None, None), (3, "clean too"), (3, "clean too"), (5, "")], key=repr)


def test_item_texts_under_one_id(spark, frame):
    """Texts of one item, and items without an id, are compared each with its own words."""
    long, other, lone = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 30), ("b", 14), ("c", 20)))
    bench = spark.createDataFrame([(1, long), (1, other), (None, lone)], "item_id long, text string")
    df = frame([(1, f"x {long}"), (2, f"{other} y"), (3, lone), (4, f"{other} z {long}"), (5, "clean")])
    got = {(r["doc_id"], r["item_id"]): (r["n_item_words"], r["n_equal"], r["doc_start"]) for r in contamination(df, bench).collect()}
    assert got == {(1, 1): (30, 30, 1), (2, 1): (14, 14, 0), (3, None): (20, 20, 0), (4, 1): (30, 30, 15)}
    # both texts of the item align with the document at its first word
    a = [f"v{i}" for i in range(24)]
    twice = spark.createDataFrame([(7, " ".join(a[:13] + ["p"] * 11)), (7, " ".join(a))], "item_id long, text string")
    rows = contamination(frame([(1, " ".join(a))]), twice).collect()
    assert [(r["item_id"], r["n_item_words"], r["n_equal"]) for r in rows] == [(7, 24, 24)]
    assert decontaminate(df, bench).count() == 1
