"""Language identification and the quality classifier: held-out accuracy and edge cases."""

import numpy as np
import pytest

from tables import SMALL
from plumbline.llm import language, quality_model, queries

FULL = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FULL}/documents.parquet")
    got = queries.QUERIES["op1_language_id"](spark, FULL)
    held = got.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert got.count() == docs.count() and len(held) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_edges(spark):
    rows = [(i, "der die das und nicht ein " * 5, "de") for i in range(40)] + [(100 + i, "the and of with that this " * 5, "en") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "en"), (202, "123 ... 456", "en"), (203, "the and", None), (None, "und der", "de"), (204, "the and of " * 20000, None), (205, "the and", "en"), (205, "the and", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "1 as held_out", "2 as has_letter")
    got = {}
    for r in language.identify_language(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["rejected"]))
    assert got[200] == got[201] == got[202] == [("und", True)]
    assert got[203][0][0] == got[204][0][0] == "en" and got[None][0][0] == "de" and len(got[205]) == 2
    assert language.identify_language(docs.filter("false")).count() == 0
    unlabelled = language.identify_language(docs.filter("lang is null")).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}


def test_table_of_logits_is_the_mean_embedding():
    texts = ["der die das", "the of and", "und nicht"] * 20
    model = language.train(texts, ["de", "en", "de"] * 20, epochs=2)
    grams, owner = language.subwords(["the of", "das"])
    direct = np.stack([model.logits[grams[owner == i]].mean(axis=0) for i in range(2)]) + model.bias
    assert np.allclose(direct, model.raw(["the of", "das"]), atol=1e-5)


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{FULL}/labels.parquet")
    got = queries.QUERIES["op6_quality_classifier"](spark, FULL)
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert len(held) > 50 and sum((r["quality"] == r["predicted"]) for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.collect())


def test_quality_edges(spark, frame):
    docs = frame([(i, "good clean words here " * 9 if i % 2 else "### $$$ %%% " * 9) for i in range(80)] + [(90, None), (91, ""), (None, "x"), (92, "long " * 50000), (93, "a"), (93, "a")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(1, None), (None, 1), (999, 1)], "doc_id long, quality int").selectExpr("*", "'x' as text", "1 as features")
    got = quality_model.score_quality(docs, labels).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["predicted"] == i % 2 for i in range(80)) and 0 <= by[90]["score"] == by[91]["score"] <= 1
    assert {r["score"] for r in quality_model.score_quality(docs, labels.filter("false")).collect()} == {0.5}
    assert quality_model.score_quality(docs.filter("false"), labels).count() == 0
    assert all(r["predicted"] == 1 for r in quality_model.score_quality(docs, labels.filter("quality = 1")).collect())


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


@pytest.mark.parametrize("name", ["op1_language_id", "op6_quality_classifier"])
def test_one_row_a_document(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    assert got.count() == got.select("doc_id").distinct().count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
