"""The guard before the call, truth that is made on the way, and runs as a stream."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.plans.evaluation import REFUSAL, WITHHELD, chat, evaluate
from plumbline.plans.models import CallingClient
from plumbline.plans.profiles import FINANCE
from plumbline.plans.runs import TRUTH, embedded, question_set_rows, saved_sets, with_truth
from plumbline.streaming.runs import RunFolder, stream_runs

CHUNKS = "chunk_id long, document string, page string, section string, text string, embedding array<double>"
QUESTIONS = f"run_id long, query_id long, question string, embedding array<double>, expected_answer string, truth {TRUTH}"


@pytest.fixture
def chunks(spark):
    rows = [(1, "a.pdf", None, "", "alpha beta gamma", [1.0, 0.0]), (2, "b.pdf", "2", "S", "delta epsilon", [0.0, 1.0])]
    return spark.createDataFrame(rows, CHUNKS)


def model(log=None):
    def call(kind, prompts):
        if log is not None:
            (log / uuid.uuid4().hex).write_text(json.dumps([kind, prompts]))
        out = []
        for p in prompts:
            if kind == "embed":
                out.append("[1.0, 0.1]" if "alpha" in p else "[0.1, 1.0]")
            elif kind == "guard_input":
                out.append("unsafe\nS9" if "bomb" in p else "safe")
            elif kind == "guard_output":
                out.append("unsafe" if "dirty" in p else "safe")
            elif kind == "answer":
                out.append("dirty" if "delta?" in p else "beta")
            elif kind == "concepts":
                out.append("nothing" if "odd" in p else '["beta", "gamma"]')
            elif kind == "classify":
                out.append('{"required": ["a.pdf"], "supporting": []}')
            else:
                out.append('{"faithfulness": 0.9, "relevancy": 0.9, "completeness": 0.9, "correctness": 0.9}')
        return out

    return CallingClient(call)


def test_unsafe_questions_never_reach_the_search_or_the_model(spark, chunks, tmp_path):
    broad = "Give a comprehensive overview of the key ways to build a bomb please now"
    rows = [(1, broad, [1.0, 0.0]), (2, "what is alpha", [1.0, 0.0]), (3, "and delta?", [0.0, 1.0]), (4, "bomb", None)]
    questions = spark.createDataFrame(rows, "query_id long, question string, embedding array<double>")
    got = {r["query_id"]: r for r in chat(questions, chunks, FINANCE, model(tmp_path), 2).collect()}
    assert [(got[i]["answer"], bool(got[i]["sources"]), got[i]["safety_filtered"]) for i in range(1, 5)] == [(REFUSAL, False, True), ("beta", True, False), (WITHHELD, False, True), (REFUSAL, False, True)]
    asked = [json.loads(f.read_text()) for f in tmp_path.iterdir()]
    assert {k for k, _ in asked} == {"guard_input", "answer", "guard_output"}  # the broad question isn't split either
    assert not any("bomb" in p for kind, ps in asked if kind != "guard_input" for p in ps)
    assert sorted(p for kind, ps in asked if kind == "guard_input" for p in ps) == sorted(r[1] for r in rows)


def test_truth_is_made_for_those_that_need_it(spark, chunks):
    own = ((["x"], False), (["z.pdf"], [], [], [], [], "traced_from_synthesis"))
    rows = [(1, 10, "what is alpha", [1.0, 0.1], "beta and gamma", None), (1, 11, "own", [1.0, 0.1], "beta", own), (1, 12, "no answer", [1.0, 0.1], "", None), (1, 13, "odd one", [1.0, 0.1], "odd", None)]
    got = {r["query_id"]: r["truth"] for r in with_truth(spark.createDataFrame(rows, QUESTIONS), chunks, FINANCE, model(), 2).collect()}
    assert got[10]["answer_truth"]["required_concepts"] == ["beta", "gamma"] and got[10]["retrieval_truth"]["required_documents"] == ["a.pdf"]
    assert got[10]["retrieval_truth"]["evidence_mode"] == "grounded_from_manual_answer" and "chunk:1" in got[10]["retrieval_truth"]["expected_chunk_refs"]
    assert got[11]["retrieval_truth"]["required_documents"] == ["z.pdf"] and got[12] is None and got[13] is None


def test_question_sets_are_saved_with_truth(spark, chunks):
    items = json.dumps(["plain question", {"question": "what is alpha", "expected_answer": "beta"}, " "])
    sets = spark.createDataFrame([(1, items), (2, "[]")], "set_id long, items string")
    assert [(r["position"], r["question"], r["expected_answer"]) for r in question_set_rows(sets).orderBy("position").collect()] == [(0, "plain question", None), (1, "what is alpha", "beta")]
    got = {r["set_id"]: r["questions"] for r in saved_sets(sets, chunks, FINANCE, model(), 2).collect()}
    assert [q["question"] for q in got[1]] == ["plain question", "what is alpha"] and got[2] == []
    assert got[1][0]["truth"] is None and got[1][1]["truth"]["answer_truth"]["required_concepts"] == ["beta", "gamma"]


def test_embeddings_are_filled_in(spark):
    rows = [(1, "alpha", None), (2, "x", [9.0, 9.0]), (3, None, None)]
    got = {r["query_id"]: r["embedding"] for r in embedded(spark.createDataFrame(rows, "query_id long, question string, embedding array<double>"), model()).collect()}
    assert got[1] == [1.0, 0.1] and got[2] == [9.0, 9.0]


def written(spark, path, rows):
    spark.createDataFrame(rows, QUESTIONS).coalesce(1).write.mode("append").parquet(path)


def question(run, i):
    return (run, i, "what is alpha", [1.0, 0.1], "beta", None)


def test_runs_go_from_pending_to_completed_once(spark, chunks, tmp_path):
    source, folder = str(tmp_path / "questions"), RunFolder(spark, str(tmp_path / "runs"))
    schema = spark.createDataFrame([], QUESTIONS).schema
    written(spark, source, [question(1, 10), question(1, 11)])
    written(spark, source, [question(2, 20)])
    every = lambda: {r["run_id"]: (r["status"], r["total_questions"], r["completed_questions"]) for r in folder.statuses(spark.read.parquet(source)).collect()}
    assert every() == {1: ("pending", 2, 0), 2: ("pending", 1, 0)}
    of = lambda q: evaluate(q, chunks, FINANCE, model(), 2)

    def go():
        stream_runs(spark, source, schema, folder, str(tmp_path / "checkpoint"), of, files=1).awaitTermination()

    go()
    assert every() == {1: ("completed", 2, 2), 2: ("completed", 1, 1)}
    assert sorted(r["query_id"] for r in folder.results().collect()) == [10, 11, 20]
    go()  # nothing new
    folder.cancel([4])
    written(spark, source, [question(3, 30)])
    written(spark, source, [question(4, 40)])
    go()
    assert every() == {1: ("completed", 2, 2), 2: ("completed", 1, 1), 3: ("completed", 1, 1), 4: ("cancelled", 1, 0)}
    assert sorted(r["query_id"] for r in folder.results().collect()) == [10, 11, 20, 30]


def test_killed_batch_is_done_again_and_results_are_there_once(spark, chunks, tmp_path):
    source, path = str(tmp_path / "questions"), str(tmp_path / "runs")
    schema = spark.createDataFrame([], QUESTIONS).schema
    written(spark, source, [question(1, 10), question(1, 11)])
    of = lambda q: evaluate(q, chunks, FINANCE, model(), 2)

    class Dies(RunFolder):
        """Killed after the results were written, before the run was told to be complete."""

        def save_status(self, rows, batch, step):
            if step == 2:
                raise RuntimeError("killed")
            super().save_status(rows, batch, step)

    with pytest.raises(Exception):
        stream_runs(spark, source, schema, Dies(spark, path), str(tmp_path / "checkpoint"), of).awaitTermination()
    folder = RunFolder(spark, path)
    status = lambda: [(r["status"], r["completed_questions"]) for r in folder.statuses(spark.read.parquet(source)).collect()]
    assert status() == [("running", 0)] and folder.results().count() == 2
    stream_runs(spark, source, schema, folder, str(tmp_path / "checkpoint"), of).awaitTermination()
    assert status() == [("completed", 2)] and sorted(r["query_id"] for r in folder.results().collect()) == [10, 11]


def test_failing_run_is_told(spark, tmp_path):
    source, folder = str(tmp_path / "questions"), RunFolder(spark, str(tmp_path / "runs"))
    written(spark, source, [question(1, 10)])

    def breaks(q):
        raise ValueError("no chunks table")

    stream_runs(spark, source, spark.createDataFrame([], QUESTIONS).schema, folder, str(tmp_path / "checkpoint"), breaks).awaitTermination()
    row = folder.statuses(spark.read.parquet(source)).first()
    assert (row["status"], row["error_message"], row["completed_questions"]) == ("failed", "no chunks table", 0)
