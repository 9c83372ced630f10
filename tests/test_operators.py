"""Behaviour of operators on small literal cases; order-dependent ones against plain Python."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import alignment, checks, chunking, compare, judge, reports, retrieval, truth, verdicts
from plumbline.plans.profiles import FINANCE, SCORES, Profile


def one(spark, value, *cols):
    """Columns over a one-row frame with column ``t``."""
    row = spark.createDataFrame([(value,)], "t string").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return row[0] if len(cols) == 1 else tuple(row)


# --- chunks ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,starts", [(0, []), (1, [0]), (400, [0]), (401, [0, 320]), (720, [0, 320, 640]), (1000, [0, 320, 640, 960])])
def test_windows(spark, n, starts):
    words = [f"w{i}" for i in range(n)]
    got = chunking.chunk_fixed(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).orderBy("seq").collect()
    assert [r["text"].split()[0] for r in got] == [f"w{s}" for s in starts]
    assert [r["token_count"] for r in got] == [min(400, n - s) for s in starts]


def test_short_text_stays_verbatim(spark):
    got = chunking.chunk_fixed(spark.createDataFrame([(1, " a   b\n c ")], "doc_id long, text string")).collect()
    assert [(r["text"], r["token_count"]) for r in got] == [(" a   b\n c ", 3)]


@pytest.mark.parametrize(
    "line,want",
    [("RISK FACTORS", True), ("RISK", True), ("1.2 Scope", True), ("1.2.3. of the", True), ("article IV of this", True), ("Short Title Here", True), ("Ends with period.", False),
     ("ab", False), ("", False), ("all of these words are lower case", False), ("A b c d E f", False), ("  PART two  ", True)],
)
def test_heading(spark, line, want):
    assert one(spark, line, T.is_heading(F.col("t"))) is want


def test_sections(spark):
    text = "preamble text that runs on.\nSCOPE OF RULES\nbody one that is long.\n\nbody two goes here.\nEMPTY HEADING HERE\nNEXT PART OF IT\nlast body text here."
    got = chunking.chunk_sections(spark.createDataFrame([(1, text), (2, "no heading in this text."), (3, "ONLY HEADINGS\nAND MORE HEADINGS"), (4, None)], "doc_id long, text string"))
    rows = [(r["doc_id"], r["section_path"], r["text"], r["token_count"]) for r in got.orderBy("doc_id", "section", "seq").collect()]
    assert rows == [
        (1, "", "preamble text that runs on.", 5),
        (1, "SCOPE OF RULES", "SCOPE OF RULES\nbody one that is long. body two goes here.", 9),
        (1, "NEXT PART OF IT", "NEXT PART OF IT\nlast body text here.", 4),
        (2, None, "no heading in this text.", 5),
        (3, None, "ONLY HEADINGS\nAND MORE HEADINGS", 5),
    ]


def test_embedding_input(spark):
    assert one(spark, "  a b ", T.embedding_input(F.col("t"))) == "search_document: a b"
    assert len(one(spark, "x " * 1000, T.embedding_input(F.col("t"), "", 4000, 600)).split()) == 600
    assert len(one(spark, "y" * 5000, T.embedding_input(F.col("t"), ""))) == 4000


# --- retrieval ---------------------------------------------------------------------------------------------


def ranked(spark, rows, q=1):
    return spark.createDataFrame([(q, i, r[0], *r[1:]) for i, r in enumerate(rows)], "query_id long, rank int, chunk_id long, document string, score double, text string")


def order(df):
    return [r["chunk_id"] for r in df.orderBy("rank").collect()]


def test_fusion_prefers_what_both_lists_have(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2)], "query_id long, chunk_id long, rank int")
    b = spark.createDataFrame([(1, 12, 0), (1, 13, 1)], "query_id long, chunk_id long, rank int")
    got = retrieval.rank_fusion([a, b]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [12, 10, 11, 13]
    assert got[0]["score"] == round(1 / 63 + 1 / 61, 4)
    assert order(retrieval.rank_fusion([a])) == [10, 11, 12]


def greedy(rows, threshold):
    kept = []
    for cid, *_, text in rows:
        w = set(text.lower().split())
        if not any(w | k and len(w & k) / len(w | k) > threshold for _, k in kept):
            kept.append((cid, w))
    return [c for c, _ in kept]


def test_greedy_near_duplicates_against_python(spark):
    rng = random.Random(3)
    rows = [(i, "d", 1.0, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 9)))) for i in range(60)]
    for threshold in (0.5, 0.7, 0.85):
        assert order(retrieval.drop_near_duplicates(ranked(spark, rows), threshold)) == greedy(rows, threshold)
    assert order(retrieval.drop_near_duplicates(ranked(spark, rows), 1.0)) == list(range(60))


def diverse(rows, top_k, per_doc, least, threshold):
    counts, first, late = {}, [], []
    for r in rows:
        counts[r[1]] = counts.get(r[1], 0) + 1
        (late if per_doc and counts[r[1]] > per_doc else first).append(r)
    rows = first + late
    if least > 1 and len(rows) > top_k:
        best = {}
        for r in rows:
            best[r[1]] = max(best.get(r[1], -1), r[2])
        chosen, seen = [], set()
        for r in rows:
            if len(seen) < least and r[1] not in seen and best[r[1]] >= threshold:
                chosen.append(r)
                seen.add(r[1])
        rows = chosen + [r for r in rows if r not in chosen]
    return [r[0] for r in rows[:top_k]]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6), st.integers(1, 8), st.integers(0, 3), st.integers(1, 4))
def test_diversity_against_python(spark, seed, top_k, per_doc, least):
    rng = random.Random(seed)
    rows = [(i, rng.choice("xyz"), round(rng.random(), 2), "t") for i in range(12)]
    df = retrieval.select_diverse(retrieval.cap_per_document(ranked(spark, rows), per_doc), top_k, least, 0.5)
    assert order(df) == diverse(rows, top_k, per_doc, least, 0.5)


def test_vector_search_exact_with_ties(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, None), (5, [1.0, 1.0])], "chunk_id long, embedding array<double>")
    queries = spark.createDataFrame([(7, [3.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = retrieval.vector_search(chunks, queries, 3).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == [(7, 1, 1.0), (7, 3, 1.0), (7, 5, 0.7071)]
    assert retrieval.vector_search(chunks, queries.filter("false"), 3).count() == 0


def test_keyword_search_needs_all_terms(spark):
    chunks = spark.createDataFrame([(1, "Red fox runs"), (2, "red dog"), (3, "the fox, red fox")], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "the red fox"), (2, "the"), (3, "fox bird")], "query_id long, text string")
    got = retrieval.keyword_search(chunks, queries, 10).orderBy("rank").collect()
    assert [(r["query_id"], r["chunk_id"]) for r in got] == [(1, 3), (1, 1)]


def test_merge_keeps_best_score_and_first_owner(spark):
    rows = [(1, 0, 5, 0, 0.5), (1, 0, 6, 1, 0.4), (1, 1, 6, 0, 0.9), (1, 1, 5, 1, 0.5), (1, 2, 7, 0, 0.9)]
    lists = spark.createDataFrame(rows, "query_id long, sub_query int, chunk_id long, rank int, score double")
    got = retrieval.merge_sub_queries(lists).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"], r["sub_query"]) for r in got] == [(6, 0.9, 1), (7, 0.9, 2), (5, 0.5, 0)]
    assert [(r["chunk_id"], r["score"]) for r in retrieval.debug_merge(lists).orderBy("rank").collect()] == [(7, 0.9), (5, 0.5), (6, 0.4)]


def test_sub_query_swap(spark):
    schema = "query_id long, rank int, chunk_id long, score double, sub_query int"
    chosen = spark.createDataFrame([(1, 0, 1, 0.9, 0), (1, 1, 2, 0.5, 0)], schema)
    pool = spark.createDataFrame([(1, 0, 1, 0.9, 0), (1, 1, 3, 0.6, 1), (1, 2, 2, 0.5, 0), (1, 3, 4, 0.2, 2)], schema)
    swapped = retrieval.represent_sub_queries(chosen, pool, 2, 0.3, 1.1)
    assert order(swapped) == [1, 3]
    assert order(retrieval.represent_sub_queries(chosen, pool, 5, 0.1, 1.1)) == [1, 2, 3, 4]
    assert order(retrieval.represent_sub_queries(chosen, pool, 2, 0.6, 1.1)) == [1, 2]


def test_pipeline_without_vectors_uses_keywords(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", "d", [1.0, 0.0]), (2, "alpha gamma", "e", [0.0, 1.0])], "chunk_id long, text string, document string, embedding array<double>")
    queries = spark.createDataFrame([(1, "alpha", None), (2, "alpha", [1.0, 0.1]), (3, "zeta", [0.1, 1.0])], "query_id long, text string, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.retrieve(chunks, queries, FINANCE.retrieval, 2).collect()}
    assert got[1, 0] == (1, round(0.1 / 1.64493406685, 4)) and got[2, 0] == (1, round(2 / 61, 4)) and got[3, 0][0] == 2 and got[3, 0][1] > 0.9


def test_vector_search_by_blocks(spark):
    """The same result whether queries are broadcast or meet the chunks block by block."""
    rng = random.Random(1)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300, None)]
    chunks = spark.createDataFrame(v, "chunk_id long, embedding array<float>")
    queries = chunks.filter("chunk_id % 3 = 0").withColumnRenamed("chunk_id", "query_id")
    rows = lambda **how: {tuple(r) for r in retrieval.vector_search(chunks, queries, 5, **how).collect()}
    once = rows()
    assert len(once) == 500 and once == rows(block=10, grid=40)


def test_nothing_found_takes_the_newest_chunks(spark):
    rows = [(1, "alpha", "d", None, 5, None), (2, "beta", "e", None, 9, None), (3, "gamma", "e", None, 10, "gone")]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string, document string, embedding array<double>, created_at long, deleted_at string")
    queries = spark.createDataFrame([(1, "alpha", None), (2, "gamma", None)], "query_id long, text string, embedding array<double>")
    docs = spark.createDataFrame([("ready", None), ("ready", "x"), ("error", None)], "status string, deleted_at string")
    assert retrieval.ready_documents(docs).first()["n"] == 1
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.retrieve(chunks, queries, FINANCE.retrieval, retrieval.ready_documents(docs)).collect()}
    assert got == {(1, 0): (1, 0.0608), (2, 0): (2, 0.0), (2, 1): (1, 0.0)}


def fold(chosen, pool, top_k, least):
    """The swap of sub-queries in plain Python; lists of (chunk, score, sub_query)."""
    out, present = list(chosen), {c[2] for c in chosen}
    for sub in sorted({c[2] for c in pool} - present):
        best = next(c for c in pool if c[2] == sub)
        if best[1] < least:
            continue
        if len(out) < top_k:
            out.append(best)
            continue
        worst = min(range(len(out)), key=lambda i: out[i][1])
        if best[1] > out[worst][1]:
            out[worst] = best
    return out


def test_swap_against_plain_python(spark):
    rng = random.Random(4)
    chosen, pool, want = [], [], {}
    for q in range(60):
        p = sorted(((100 * q + i, round(rng.random(), 1), rng.randrange(6)) for i in range(rng.randrange(1, 14))), key=lambda c: -c[1])
        c = sorted(rng.sample(p, min(len(p), rng.randrange(1, 6))), key=p.index)
        chosen += [(q, i, *x) for i, x in enumerate(c)]
        pool += [(q, i, *x) for i, x in enumerate(p)]
        want[q] = [x[0] for x in fold(c, p, 4, 0.3 * 0.8)]
    shape = "query_id long, rank int, chunk_id long, score double, sub_query int"
    got = {}
    for r in retrieval.represent_sub_queries(spark.createDataFrame(chosen, shape), spark.createDataFrame(pool, shape), 4, 0.3, 0.8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    assert got == want


@pytest.mark.parametrize("cap,want", [(2048, [2048, 1024, 512, 512]), (4096, [4096, 2048, 512, 512]), (8192, [8192, 4096, 1024, 512]), (256, [512, 512, 512, 512])])
def test_retries_are_cut_again_and_again(spark, cap, want):
    assert [spark.range(1).select(judge.retry_payload(F.lit(9), F.lit(i), F.lit(cap))["max_tokens"]).first()[0] for i in range(4)] == want


def test_formats_of_the_front_end(spark):
    shown = lambda c: spark.range(1).select(c).first()[0]
    assert [shown(T.shown_score(F.lit(x))) for x in (0.125, 0.5, 0.0, None)] == ["13%", "50%", "0%", "--"]
    assert shown(T.shown_metric(F.lit("latency_ms"), F.lit(1234.5))) == "1235ms" and shown(T.shown_metric(F.lit("relevancy"), F.lit(0.5))) == "50%"
    assert shown(T.shown_metric(F.lit("latency_ms"), F.lit(None).cast("double"))) == "--"
    assert shown(T.shown_time(F.timestamp_seconds(F.lit(0)))) == "1/1/1970, 12:00:00 AM" and shown(T.shown_time(F.timestamp_seconds(F.lit(0)), True)) == "1/1/1970" and shown(T.shown_time(F.lit(None).cast("timestamp"))) == ""


# --- alignment and checks ------------------------------------------------------------------------------------


def chunk_frame(spark, chunks, **cols):
    fields = ", ".join(f"{k} array<string>" for k in cols)
    return spark.createDataFrame([(chunks, *cols.values())], f"chunks {alignment.CHUNKS}, {fields}")


CHUNKS = [(1, "a.pdf", "3", "one two three four five six seven"), (2, "b.pdf", None, "other words")]


@pytest.mark.parametrize(
    "refs,texts,want",
    [([], None, 1.0), (["chunk:1", "chunk:9"], None, 0.5), (["chunk:x"], None, 0.0), (["a.pdf:3", "b.pdf:1"], None, 0.5), (["b.pdf"], None, 1.0), (["chunk:9"], ["one two three four five six"], 1.0),
     (["chunk:9"], ["one two three four five"], 0.0), (["chunk:9"], ["two three"], 1.0), (["chunk:1", "chunk:9"], ["one two three four five six"], 0.5)],
)
def test_alignment(spark, refs, texts, want):
    df = chunk_frame(spark, CHUNKS, refs=refs, texts=texts)
    assert df.select(alignment.alignment_recall(F.col("chunks"), F.col("refs"), F.col("texts"))).first()[0] == want


def test_checks(spark):
    schema = "struct<answer_truth:struct<required_concepts:array<string>,abstention_expected:boolean>,retrieval_truth:struct<required_documents:array<string>,expected_chunk_refs:array<string>,expected_chunk_texts:array<string>,supporting_documents:array<string>,supporting_chunk_refs:array<string>,evidence_mode:string>>"
    t = (([], True), (["a.pdf", "z.pdf"], ["chunk:1", "chunk:5"], [], ["y.pdf"], ["chunk:2"], "traced_from_synthesis"))
    df = spark.createDataFrame([(t, CHUNKS, "see c.pdf"), (t, CHUNKS, ""), (None, CHUNKS, "x")], f"truth {schema}, chunks {alignment.CHUNKS}, answer string")
    got = [r[0] for r in df.select(checks.run_checks(F.col("truth"), F.col("chunks"), F.col("answer"))).collect()]
    assert [(c["check_name"], c["passed"], c["detail"]) for c in got[0]] == [
        ("document_presence", False, "Missing 1/2 required documents: ['z.pdf']. Also missing 1 supporting documents: ['y.pdf']"),
        ("chunk_alignment", True, "Chunk recall: 1/2 (50%), 1/1 supporting"),
        ("abstention_validation", False, "Model answered when it should have abstained"),
        ("source_reference", False, "Answer references documents not in context: ['c.pdf']"),
    ]
    assert len(got[1]) == 2 and got[2] == []


# --- model outputs ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "raw,want",
    [('{"a": 0.5, "b": "0.25"}', (0.5, 0.25)), ('```json\n{"a": 2, "b": -1}\n```', (1.0, 0.0)), ('{"a": null}', (None, None)), ('{"a": true, "b": [1]}', (1.0, None)),
     ('"a": 0.5 then "A": 0.75, "b": null', (0.75, None)), ('"a": -0.5', (None, None)), ("", (None, None)), ('{"A": 0.5}', (None, None)), ('{"a": NaN', (None, None))],
)
def test_scores(spark, raw, want):
    assert one(spark, raw, *judge.parse_scores(F.col("t"), ["a", "b"]).values()) == want


def test_clamp_nan(spark):
    assert spark.range(1).select(judge.clamp(F.lit(float("nan")))).first()[0] == 1.0


def test_concepts(spark):
    assert one(spark, '["a ", "", "b"]', judge.concept_list(F.col("t"))) == ["a", "b"]
    assert one(spark, "nope", judge.concept_list(F.col("t"))) is None
    assert one(spark, '["covered"]', judge.coverage_statuses(F.col("t"), F.lit(2))) == ["covered", "missing"]
    assert one(spark, "big words here", T.concept_in_contexts(F.col("t"), F.array(F.lit("Words, and more.")))) is False
    assert one(spark, "big words", T.concept_in_contexts(F.col("t"), F.array(F.lit("Words, and more.")))) is True
    assert one(spark, "a of", T.concept_in_contexts(F.col("t"), F.array(F.lit("a of")))) is False


LONG = "This is the final answer and it goes on for long enough to count as an answer body of eighty characters."


@pytest.mark.parametrize(
    "raw,want",
    [("<think>x</think> Hi", "Hi"), ("a<THINK b='1'>x\ny</think>c", "ac"), ("junk </think> one </think> two", "two"), (f"Okay, let me think.\n\nIn summary\n\n{LONG}", LONG),
     ("Okay, let me think.\n\nIn summary\n\nshort", "Okay, let me think.\n\nIn summary\n\nshort"), (f"Okay, I should consider it.\n\n1. {LONG}", f"1. {LONG}"), ("Fine.\n\nI need to check that", "Fine."), (None, "")],
)
def test_reasoning(spark, raw, want):
    assert one(spark, raw, T.strip_reasoning(F.col("t"))) == want


def test_error_summary(spark):
    assert one(spark, '{"error": {"message": " ", "detail": "d"}}', judge.error_summary(F.col("t"))) == "d"
    assert one(spark, '{"error": "plain"}', judge.error_summary(F.col("t"))) == "plain"
    assert one(spark, "x" * 600, judge.error_summary(F.col("t"))) == "x" * 500


def test_guard_and_gate(spark):
    refusal = judge.gated(F.lit("answer"), judge.guard(F.col("t")), judge.guard(F.lit("safe")), "no", "withheld")
    assert one(spark, "unsafe\nS2", refusal) == "no" and one(spark, None, refusal) == "answer"


# --- verdicts and comparison -----------------------------------------------------------------------------------


def verdict(spark, scores, **more):
    row = {s: scores.get(s, 0.9) for s in SCORES}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{s} double" for s in SCORES)).withColumns(more)
    r = verdicts.question_verdicts(df, FINANCE).first()
    return r["verdict"], r["fail_reasons"]


def checked(presence, chunks):
    c = lambda name, ok: F.struct(F.lit(name).alias("check_name"), F.lit(ok).alias("passed"))
    return F.array(c("document_presence", presence), c("chunk_alignment", chunks))


def test_verdict_order(spark):
    assert verdict(spark, {}) == ("PASS", [])
    assert verdict(spark, {"relevancy_score": 0.4}) == ("REVIEW_REQUIRED", ["FAIL_LOW_RELEVANCY"])
    assert verdict(spark, {"groundedness_score": 0.4, "relevancy_score": 0.4}) == ("FAIL", ["FAIL_LOW_GROUNDEDNESS", "FAIL_LOW_RELEVANCY"])
    assert verdict(spark, {"groundedness_score": 0.7}) == ("PASS", [])
    assert verdict(spark, dict.fromkeys(SCORES)) == ("PASS", [])
    assert verdict(spark, {}, checks=checked(False, False)) == ("FAIL", ["FAIL_RETRIEVAL_INCOMPLETE"])
    assert verdict(spark, {}, checks=checked(True, False), evidence_mode=F.lit("grounded_from_synthesis")) == ("PASS", [])
    gap = F.struct(F.array(F.lit("a")).alias("missing"), F.array().cast("array<string>").alias("retrieval_failures"), F.array(F.lit("a")).alias("generation_failures"))
    assert verdict(spark, {}, checks=checked(True, False), coverage_gaps=gap) == ("PASS", [])
    assert verdict(spark, {}, checks=checked(False, False), coverage_gaps=gap)[0] == "FAIL"


def run(name, verdict_="PASS", fails=0, reviews=0, gates=(0.9, 0.9, 0.9), **metrics):
    base = {f"avg_{m}": 0.8 for m in compare.METRICS if m != "hallucination_rate"} | {"hallucination_rate": 0.1}
    base |= dict(zip(("avg_completeness", "avg_correctness", "avg_compliance_accuracy"), gates)) | metrics
    return {"run_id": name, "model_name": name, "overall_verdict": verdict_, "fail_count": fails, "review_count": reviews, **base}


@pytest.mark.parametrize(
    "a,b,want",
    [(run("A"), run("B", gates=(0.4, 0.9, 0.9)), ("run_a", "decisive", ["OPPONENT_DISQUALIFIED"])),
     (run("A", gates=(0.1, 1.0, 1.0)), run("B", gates=(1.0, 0.1, 1.0)), (None, "inconclusive", ["BOTH_DISQUALIFIED"])),
     (run("A", "FAIL"), run("B", "REVIEW_REQUIRED"), ("run_b", "decisive", ["BETTER_VERDICT"])),
     (run("A", fails=1), run("B", fails=3), ("run_a", "decisive", ["FEWER_FAILURES"])), (run("A", fails=2), run("B", fails=1), ("run_b", "marginal", ["FEWER_FAILURES"])),
     (run("A", reviews=2), run("B", reviews=1), ("run_b", "marginal", ["FEWER_REVIEWS"])), (run("A", avg_relevancy=0.9), run("B"), ("run_a", "marginal", ["METRIC_ADVANTAGE"])),
     (run("A", avg_relevancy=0.84), run("B"), ("tie", "inconclusive", []))],
)
def test_decision(spark, a, b, want):
    both = compare.paired(spark.createDataFrame([("A", "B")], "run_a string, run_b string"), spark.createDataFrame([a, b]))
    r = compare.decide(both, FINANCE).first()
    assert (r["winner"], r["decision_status"], r["reason_codes"]) == want
    assert "No evaluation profile" in compare.decide(both, None).first()["risk_flags"][0]


def test_hallucination_and_latency_are_lower_better(spark):
    both = compare.paired(spark.createDataFrame([("A", "B")], "run_a string, run_b string"), spark.createDataFrame([run("A", hallucination_rate=0.3, avg_latency_ms=5.0), run("B", avg_latency_ms=4.99)]))
    won = {r["metric"]: r["winner"] for r in compare.compare_metrics(both).collect()}
    assert won["hallucination_rate"] == "run_b" and won["latency_ms"] == "tie" and won["relevancy"] == "tie"


def test_aggregates_count_errors_for_latency_only(spark):
    cols = [*SCORES, "chunk_alignment_score", "latency_ms"]
    rows = [(1, "a", None, 10, False, *[0.5] * 8, 1.0, 100.0), (1, None, "broke", None, None, *[None] * 8, None, None), (1, None, None, None, None, *[None] * 10)]
    df = spark.createDataFrame(rows, "run_id int, answer string, error_message string, total_tokens long, is_hallucination boolean, " + ", ".join(f"{c} double" for c in cols))
    r = verdicts.run_aggregates(df).first()
    assert (r["completed_questions"], r["avg_latency_ms"], r["avg_relevancy"], r["hallucination_rate"], r["total_tokens"]) == (2, 50.0, 0.5, 0.0, 10)


# --- truth ------------------------------------------------------------------------------------------------------


def sample_sizes(sizes, budget, least=2):
    """Chunks taken of each document, in plain Python."""
    rest, taken = budget, {}
    for d in sorted(sizes):
        taken[d] = min(sizes[d], least, rest)
        rest -= taken[d]
        if rest <= 0:
            break
    left = {d: n - taken.get(d, 0) for d, n in sizes.items() if n > taken.get(d, 0)}
    total = sum(left.values())
    for d in sorted(left) if rest > 0 else []:
        share = min(max(1, round(rest * left[d] / total)), left[d], rest)
        taken[d] = taken.get(d, 0) + share
        rest -= share
        if rest <= 0:
            break
    return {d: n for d, n in taken.items() if n}


@pytest.mark.parametrize("sizes,budget", [({1: 20, 2: 5, 3: 3}, 10), ({1: 100}, 50), ({1: 1, 2: 40, 3: 7}, 12), ({d: 3 for d in range(30)}, 20), ({1: 2, 2: 2}, 3)])
def test_balanced_sample(spark, sizes, budget):
    rows = [(d, 100 * d + i) for d, n in sizes.items() for i in range(n)]
    got = truth.balanced_sample(spark.createDataFrame(rows, "document_id long, chunk_id long"), budget)
    assert {r[0]: r[1] for r in got.groupBy("document_id").count().collect()} == sample_sizes(sizes, budget)
    assert truth.balanced_sample(spark.createDataFrame([], "document_id long, chunk_id long"), budget).count() == 0


def test_classification(spark):
    docs = F.array(F.lit("b"), F.lit("a"), F.lit("c"))
    c = lambda raw: tuple(one(spark, raw, truth.classify(F.col("t"), docs)))
    assert c('{"required": ["b", "zz"], "supporting": []}') == (["b"], ["a", "c"])
    assert c('```json\n{"required": [], "supporting": ["c"]}\n```') == (["a"], ["b", "c"])
    assert one(spark, "no json", truth.classify(F.col("t"), docs)) is None


def test_reports(spark):
    assert one(spark, "Missing 1/3 required", reports.required_progress(F.lit(3), F.lit(False), F.col("t"))) == (2, 3)
    assert one(spark, "x", reports.required_progress(F.lit(3), F.lit(True), F.col("t"))) == (3, 3)
    assert one(spark, "a_b", T.title_label(F.col("t"))) == "A B"
    assert one(spark, "x", T.percent(F.lit(0.125))) == "12%"
    assert one(spark, "x", T.format_bytes(F.lit(2048))) == "2.0 KB"
    health = spark.createDataFrame([(True, True), (False, False)], "critical boolean, healthy boolean")
    assert reports.service_health(health).first()[0] == "degraded"


def test_profile_without_thresholds(spark):
    df = spark.createDataFrame([tuple([0.1] * 8)], ", ".join(f"{s} double" for s in SCORES))
    assert verdicts.question_verdicts(df, Profile(id="x")).first()["verdict"] == "PASS"
    assert math.isclose(FINANCE.thresholds["groundedness_score"], 0.7)
