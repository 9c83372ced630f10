"""Questions made from documents, and the truth of questions, as plans over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import source_header
from plumbline.operators import alignment, judge, truth
from plumbline.operators.retrieval import narrowed, retrieve
from plumbline.plans.models import ModelClient
from plumbline.plans.profiles import Profile
from plumbline.sources.storage import settled

RULES = {
    "fsi": "Ask about regulatory duties, limits, deadlines, reporting and escalation, and how the text defines them.",
    "": "Ask about requirements, duties, limits and definitions.",
}


def synthesis_prompt(sample: DataFrame, domain: str, count: int) -> DataFrame:
    """One row (key, prompt): excerpts of sampled chunks (chunk_id, document, page, text) with the task.

    The sample is bounded by its budget, so gathering it into one prompt is too.
    """
    part = F.struct("chunk_id", F.concat(F.lit("["), F.col("document"), F.lit("]\n"), F.col("text")).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n")
    rules = RULES.get(domain, RULES[""])
    head = f"Write {count} questions that the excerpts below answer, each with its answer in their words. {rules}\nGive JSON: {{\"questions\": [{{\"question\": \"\", \"expected_answer\": \"\"}}]}}\n\n"
    return sample.agg(F.lit("synthesis").alias("key"), F.concat(F.lit(head), body).alias("prompt"))


def synthesize(chunks: DataFrame, profile: Profile, client: ModelClient, count: int = 3, budget: int = 50, seed: str = "0", documents: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, sample): questions (question_id, question, expected_answer) from a balanced sample of chunks.

    ``chunks`` has (document_id, chunk_id, document, page, text); ``documents`` restricts them. Answers that
    hold no list of questions give none.
    """
    pool = chunks.filter(F.col("document_id").isin(documents)) if documents else chunks
    sample = pool.join(truth.balanced_sample(pool, budget, seed=seed), ["document_id", "chunk_id"], "left_semi")
    raw = client.complete("synthesize", synthesis_prompt(sample, profile.domain, count))
    listed = F.filter(judge.question_pairs(F.col("raw")), lambda q: F.trim(F.coalesce(q["question"], F.lit(""))) != "")
    questions = raw.select(F.posexplode(F.slice(listed, 1, count)).alias("question_id", "q")).select(F.col("question_id").cast("long").alias("question_id"), "q.question", "q.expected_answer")
    return questions, sample


def traced_truth(questions: DataFrame, sample: DataFrame) -> DataFrame:
    """Retrieval truth of synthesized questions from the sampled chunks that their answers share words with."""
    every = questions.select("question_id").join(F.broadcast(sample.select("chunk_id", "document", "text")))
    kept = alignment.answer_alignment(questions.select("question_id", F.col("expected_answer").alias("answer")), every)
    own = every.join(kept, ["question_id", "chunk_id"], "left_semi").withColumn("rank", F.col("chunk_id"))
    return truth.retrieval_truth(own, truth.fallback_classes(own))


def grounded_truth(questions: DataFrame, chunks: DataFrame, profile: Profile, client: ModelClient | None = None, mode: str = "grounded_from_manual_answer", doc_count: int = 1) -> DataFrame:
    """Retrieval truth of questions (question_id, question, embedding) from what the retrieval finds for them.

    With a client, a model says which documents are required; an answer that can't be read, or no client,
    leaves it to the count of chunks.
    """
    asked = questions.select(F.col("question_id").alias("query_id"), F.col("question").alias("text"), "embedding")
    found = settled(retrieve(chunks, asked, profile.retrieval, doc_count).select(F.col("query_id").alias("question_id"), "chunk_id", "rank"))
    own = found.join(narrowed(chunks, found).select("chunk_id", "document", "text"), "chunk_id")
    classes = truth.fallback_classes(own)
    if client is not None:
        listed = own.groupBy("question_id").agg(F.array_sort(F.collect_set("document")).alias("documents"))
        excerpts = own.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", source_header(F.col("rank") + 1, F.col("document"), F.lit(""), F.col("text")).alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
        prompt = F.concat(F.lit("Which of these documents does the question need? Give JSON with lists named required and supporting.\n\nQuestion: "), "question", F.lit("\n\n"), "context")
        told = client.complete("classify", questions.join(excerpts, "question_id").select(F.col("question_id").alias("key"), prompt.alias("prompt")))
        told = told.join(listed, told["key"] == listed["question_id"]).select("question_id", truth.classify(F.col("raw"), F.col("documents")).alias("c"))
        classes = classes.join(told, "question_id", "left").select("question_id", F.coalesce("c.required", "required").alias("required"), F.coalesce("c.supporting", "supporting").alias("supporting"))
    return truth.retrieval_truth(own, classes, mode)


def answer_truth(questions: DataFrame, client: ModelClient) -> DataFrame:
    """(question_id, required_concepts, error) of questions with an expected answer; equal pairs are asked once."""
    prompt = F.concat(F.lit("List 3 to 10 concepts that an answer has to hold, as a JSON list.\n\nQuestion: "), "question", F.lit("\n\nAnswer: "), "expected_answer")
    asked = questions.filter(F.coalesce("expected_answer", F.lit("")) != "").select(F.col("question_id").alias("key"), prompt.alias("prompt"))
    got = client.complete("concepts", asked).withColumn("required_concepts", judge.concept_list(F.col("raw")))
    failed = F.when(F.col("required_concepts").isNull(), F.coalesce("error", F.lit("no list of concepts")))
    return got.select(F.col("key").alias("question_id"), "required_concepts", failed.alias("error"))
