"""Sources, sinks, plans and the stream."""

from pyspark.sql import functions as F

from plumbline.operators.retrieval import retrieve_merged
from plumbline.plans.evaluation import REFUSAL, chat, coverage_by_calls, decomposed, evaluate, summarize
from plumbline.plans.models import CallingClient, ReplayClient, attempts
from plumbline.plans.profiles import FINANCE
from plumbline.plans.synthesis import answer_truth, grounded_truth, synthesize, traced_truth
from plumbline.sources import ingest
from plumbline.streaming.ingest import stream_chunks, windowed_scores


def test_files_are_checked_and_parsed(spark, tmp_path):
    (tmp_path / "good.pdf").write_bytes(b"%PDF-1.4 page one|  |page two")
    (tmp_path / "bad.pdf").write_bytes(b"hello")
    (tmp_path / "note.txt").write_bytes(b"%PDF")
    files = ingest.read_pdfs(spark, str(tmp_path))
    assert {r["filename"]: r["problem"] for r in files.collect()} == {"good.pdf": None, "bad.pdf": "File is not a valid PDF", "note.txt": "Only PDF files are supported"}

    def breaks(content):
        raise ValueError("layout")

    parsed = ingest.parse_pages(files, [("layout", breaks), ("text", lambda b: b.decode().split("|"))])
    row = parsed.first()
    assert (row["text"], row["page_count"], row["parser_used"], row["error"]) == ("%PDF-1.4 page one\n\npage two", 3, "text", None)
    failed = ingest.parse_pages(files, [("layout", breaks)]).first()
    assert failed["error"] == "layout: layout"
    both = parsed.withColumn("doc_id", F.lit(1)).unionByName(ingest.parse_pages(files, [("layout", breaks)]).withColumn("doc_id", F.lit(2)))
    documents, chunks = ingest.chunk_store(both)
    assert {r["doc_id"]: (r["status"], r["chunk_count"]) for r in documents.collect()} == {1: ("processing", 1), 2: ("error", 0)}
    assert chunks.count() == 1


def test_addresses(spark):
    urls = spark.createDataFrame([("https://h.org/a/B.PDF?x=1",), ("https://h.org",), ("ftp://h/x",), ("/rel/a.pdf",), ("http:///a",)], "url string")
    rows = ingest.address_rows(urls)
    assert [r["filename"] for r in rows.collect()] == ["B.PDF", "downloaded.pdf", "x.pdf", None, None]
    assert tuple(ingest.batch_totals(rows).first()) == (5, 3, 2)


def test_embedding_and_deletes(spark):
    c = spark.createDataFrame([(1, 1, [1.0]), (1, 2, None), (2, 3, [1.0]), (3, 4, None)], "document_id int, chunk_id int, embedding array<double>")
    assert {r[0]: (r[1], r[2]) for r in ingest.embedding_status(c).collect()} == {1: ("ready", "1/2 chunks missing embeddings"), 2: ("ready", None), 3: ("embedding_failed", None)}
    docs = c.select("document_id").distinct()
    assert {r[0] for r in ingest.needs_embedding(docs, c).collect()} == {1, 3}
    assert ingest.delete_rows(c, docs.filter("document_id = 1"), "document_id").count() == 2


def test_model_metadata(spark):
    body = '[{"id": "m", "name": "n", "contextLength": 8, "supportsVision": true}]'
    r = ingest.model_metadata(spark.createDataFrame([(body,)], "body string")).first()
    assert (r["id"], r["context_length"], r["capabilities"], r["supports_vision"], r["supports_reasoning"]) == ("m", 8, [], True, False)


TRUTH = "struct<answer_truth:struct<required_concepts:array<string>,abstention_expected:boolean>,retrieval_truth:struct<required_documents:array<string>,expected_chunk_refs:array<string>,expected_chunk_texts:array<string>,supporting_documents:array<string>,supporting_chunk_refs:array<string>,evidence_mode:string>>"


def test_run_end_to_end(spark):
    chunks = spark.createDataFrame([(1, "a.pdf", None, "", "alpha beta gamma", [1.0, 0.0]), (2, "b.pdf", "2", "S", "delta", [0.0, 1.0])], "chunk_id long, document string, page string, section string, text string, embedding array<double>")
    truth = ((["gamma"], False), (["a.pdf"], ["chunk:1"], [], [], [], "traced_from_synthesis"))
    rows = [(1, 10, "what is alpha", [1.0, 0.1], "beta", truth), (1, 11, "broken", [0.5, 0.5], None, None)]
    questions = spark.createDataFrame(rows, f"run_id int, query_id long, question string, embedding array<double>, expected_answer string, truth {TRUTH}")

    def call(kind, prompts):
        scores = '"relevancy": 0.9, "context_relevancy": 0.9, "abstention_quality": 1' if kind == "judge_a" else '"completeness": 0.9, "correctness": 0.9, "compliance_accuracy": 0.9, "context_precision": 0.9, "concept_coverage": ["covered"]'
        good = {"answer": "<think>hm</think> beta", "judge_a": '{"faithfulness": 0.9, ' + scores + "}", "judge_b": "{" + scores + "}"}[kind]
        return [None if "broken" in p else good for p in prompts]

    results = evaluate(questions, chunks, FINANCE, CallingClient(call), 2).cache()
    got = {r["query_id"]: r for r in results.collect()}
    assert (got[10]["answer"], got[10]["verdict"], got[10]["chunk_alignment_score"]) == ("beta", "PASS", 1.0)
    assert got[10]["coverage_gaps"]["covered"] == ["gamma"] and len(got[10]["checks"]) == 4
    assert got[11]["error_message"] and got[11]["verdict"] is None
    timed = results.withColumns({"latency_ms": F.lit(10.0), "total_tokens": F.lit(5)})
    r = summarize(timed).first()
    assert (r["completed_questions"], r["pass_count"], r["overall_verdict"], r["avg_latency_ms"]) == (2, 1, "PASS", 5.0)


def test_replay(spark):
    recorded = spark.createDataFrame([("answer", "p", "r")], "kind string, prompt string, raw string")
    out = ReplayClient(recorded).complete("answer", spark.createDataFrame([(1, "p"), (2, "q")], "key int, prompt string"))
    assert {r["key"]: (r["raw"], r["error"]) for r in out.collect()} == {1: ("r", None), 2: (None, "no recorded response")}


def test_stream_chunks_each_file_once(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    docs = spark.createDataFrame([(1, "a b c"), (2, " ".join(["w"] * 401))], "doc_id long, text string")
    docs.write.parquet(src)
    for more in (False, True):
        if more:
            docs.filter("doc_id = 1").write.mode("append").parquet(src)
        stream_chunks(spark, src, docs.schema, out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_windowed_scores(spark):
    df = spark.createDataFrame([("2024-01-01 00:01:00", 1, 0.5), ("2024-01-01 00:02:00", 1, 1.0), ("2024-01-01 00:06:00", 1, 0.0)], "ts string, run_id int, score double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r["n"], r["mean_score"]) for r in windowed_scores(df).collect()) == [(1, 0.0), (2, 0.75)]


def test_synthesis_and_truth(spark):
    rows = [(1, 10, "a.pdf", None, "red foxes run over the long hill", [1.0, 0.0]), (1, 11, "a.pdf", None, "blue birds sing", [0.8, 0.2]), (2, 20, "b.pdf", None, "green trees grow in the wide park", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, "document_id long, chunk_id long, document string, page string, text string, embedding array<double>")

    def call(kind, prompts):
        made = '{"questions": [{"question": "Where?", "expected_answer": "red foxes run"}, {"question": " ", "expected_answer": "x"}, {"question": "What?", "expected_answer": "none of it"}]}'
        return [{"synthesize": made, "classify": '{"required": ["b.pdf"], "supporting": []}', "concepts": '["foxes"]'}[kind] for _ in prompts]

    client = CallingClient(call)
    questions, sample = synthesize(chunks, FINANCE, client)
    assert [(r["question"], r["expected_answer"]) for r in questions.orderBy("question_id").collect()] == [("Where?", "red foxes run"), ("What?", "none of it")]
    truths = {r["question_id"]: r for r in traced_truth(questions, sample).collect()}
    assert truths[0]["expected_chunk_refs"] == ["chunk:10"] and truths[1]["required_documents"] == ["a.pdf"] and truths[1]["supporting_chunk_refs"] == ["chunk:20"]
    asked = spark.createDataFrame([(7, "foxes", [1.0, 0.0])], "question_id long, question string, embedding array<double>")
    plain, told = (grounded_truth(asked, chunks, FINANCE, c, doc_count=2).first() for c in (None, client))
    assert plain["required_documents"] == ["a.pdf"] and told["required_documents"] == ["b.pdf"] and told["supporting_documents"] == ["a.pdf"]
    assert {r["question_id"]: r["required_concepts"] for r in answer_truth(questions, client).collect()} == {0: ["foxes"], 1: ["foxes"]}


def test_embed_missing(spark):
    c = spark.createDataFrame([(1, "a", [9.0]), (2, "bb", None), (3, "", None)], "chunk_id long, text string, embedding array<double>")
    out = ingest.embed_missing(c, lambda texts: [None if t.endswith(": ") else [float(len(t))] for t in texts])
    assert {r["chunk_id"]: r["embedding"] for r in out.collect()} == {1: [9.0], 2: [19.0], 3: None}


def test_attempts():
    """Lost connections are tried again with shorter prompts, statuses are not; a pair tells that reasoning came apart."""
    sent, slept = [], []

    def call(kind, prompts):
        sent.append(prompts)
        if len(sent) < 3:
            raise ConnectionError("lost")
        return [("a", True), "b"]

    ask = attempts(call, 3, 2.0, slept.append)
    assert ask("answer", ["p", "q"], [["p1", "p2"], None]) == [("a", None, True), ("b", None, False)]
    assert sent == [["p", "q"], ["p1", "q"], ["p2", "q"]] and slept == [2.0, 4.0]

    def refused(kind, prompts):
        sent.append(prompts)
        raise ValueError("status 400")

    sent.clear()
    assert attempts(refused, 3, 2.0)("answer", ["p"], [None]) == [(None, "status 400", False)] and len(sent) == 1

    def dead(kind, prompts):
        raise TimeoutError("slow")

    assert attempts(dead, 2, 0.0)("answer", ["p"], [None]) == [(None, "no answer after 2 tries: slow", False)]


CHUNK_SHAPE = "chunk_id long, document string, page string, section string, text string, embedding array<double>"


def test_broad_question_is_split_and_merged(spark):
    """Parts find what the whole question misses; they are embedded by the model or searched by words."""
    rows = [(i, f"d{i}.pdf", None, "", f"text {w} number {i}", [1.0, i / 10]) for i, w in enumerate(["fees"] * 6)] + [(20, "risk.pdf", None, "", "market risk disclosures", [0.0, 1.0])]
    chunks = spark.createDataFrame(rows, CHUNK_SHAPE)
    broad = "Give a comprehensive overview of the key fees and the main risks please"
    questions = spark.createDataFrame([(1, 10, broad, [1.0, 0.0], None, None), (1, 11, "fees", [1.0, 0.0], None, None)], f"run_id int, query_id long, question string, embedding array<double>, expected_answer string, truth {TRUTH}")

    def call(kind, prompts):
        return [{"decompose": '["fees text", "market risk"]', "embed": "[0.0, 1.0]" if "risk" in p else "none", "answer": ("ok", True), "judge_a": "{}", "guard_input": "unsafe\nS1" if "overview" in p else "safe", "guard_output": None}[kind] for p in prompts]

    client = CallingClient(call)
    parts = {(r["query_id"], r["sub_query"]): (r["text"], r["embedding"]) for r in decomposed(questions, client).collect()}
    assert parts == {(10, 0): (broad, [1.0, 0.0]), (10, 1): ("fees text", None), (10, 2): ("market risk", [0.0, 1.0]), (11, 0): ("fees", [1.0, 0.0])}
    found = retrieve_merged(chunks, decomposed(questions, client), FINANCE.retrieval, 7).collect()
    assert any(r["query_id"] == 10 and r["chunk_id"] == 20 and r["sub_query"] == 2 for r in found)
    assert {r["sub_query"] for r in found if r["query_id"] == 11} == {0}
    got = {r["query_id"]: r for r in evaluate(questions, chunks, FINANCE, client, 7).collect()}
    assert got[10]["answer"] == "ok" and "market risk" in got[10]["contexts"]
    told = {r["query_id"]: r for r in chat(questions, chunks, FINANCE, client, 7).collect()}
    assert (told[10]["answer"], told[10]["sources"]) == (REFUSAL, []) and told[11]["answer"] == "ok" and told[11]["sources"]


def test_coverage_by_two_calls(spark):
    rows = [(1, "q", "red and blue", "red", None, ["blue sky here"]), (2, "q", "x", "y", ["given"], []), (3, "q", "", "y", None, None), (4, "q", "odd", "y", None, None)]
    df = spark.createDataFrame(rows, "query_id long, question string, expected_answer string, answer string, concepts array<string>, contexts array<string>")

    def call(kind, prompts):
        return [("none" if "odd" in p else '["red", "blue"]') if kind == "concepts" else ('["missing"]' if "given" in p else '["covered", "missing"]') for p in prompts]

    got = {r["query_id"]: r["coverage_gaps"] for r in coverage_by_calls(df, CallingClient(call)).collect()}
    assert (got[1]["covered"], got[1]["missing"], got[1]["generation_failures"]) == (["red"], ["blue"], ["blue"])
    assert got[2]["concepts"] == ["given"] and got[2]["retrieval_failures"] is None and got[3] is None and got[4] is None
