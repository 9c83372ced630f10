"""Truth of questions: required documents, references, balanced samples, question sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let, strip_fence_lines


def fallback_classes(chunks: DataFrame) -> DataFrame:
    """(question_id, required, supporting): the document with most chunks is required, the first seen of equals.

    ``chunks`` has (question_id, document, rank); the others are supporting, sorted.
    """
    per = chunks.groupBy("question_id", "document").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    per = per.withColumn("place", F.row_number().over(Window.partitionBy("question_id").orderBy(F.col("n").desc(), "first")))
    name = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("document"))))
    return per.groupBy("question_id").agg(name(F.col("place") == 1).alias("required"), name(F.col("place") > 1).alias("supporting"))


def classify(raw: Column, documents: Column) -> Column:
    """(required, supporting) from a model's JSON: known documents only, the unnamed ones supporting, both sorted.

    Without a required one the first supporting moves up; null if the answer is no JSON object.
    """
    parsed = F.from_json(strip_fence_lines(raw), "required array<string>, supporting array<string>")
    empty = F.array().cast("array<string>")

    def of(p: Column) -> Column:
        known = lambda a: F.filter(F.coalesce(a, empty), lambda d: F.array_contains(documents, d))
        required, supporting = known(p["required"]), known(p["supporting"])
        rest = F.array_except(documents, F.concat(required, supporting))
        pair = F.struct(F.array_sort(required).alias("r"), F.array_sort(F.concat(supporting, rest)).alias("s"))
        move = lambda x: F.when(F.size(x["r"]) == 0, F.struct(F.slice(x["s"], 1, 1).alias("required"), F.slice(x["s"], 2, 1_000_000).alias("supporting"))).otherwise(
            F.struct(x["r"].alias("required"), x["s"].alias("supporting"))
        )
        return let(pair, move)

    return let(parsed, lambda p: F.when(p["required"].isNotNull() | p["supporting"].isNotNull(), of(p)))


def retrieval_truth(chunks: DataFrame, classes: DataFrame, mode: str = "traced_from_synthesis") -> DataFrame:
    """Documents, references and texts of each question from its chunks (question_id, chunk_id, document, text, rank)."""
    both = chunks.join(classes, "question_id").withColumn("_required", F.array_contains("required", F.col("document")))
    ref = F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string"))
    ordered = lambda cond, value: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("rank", value.alias("v"))))), lambda x: x["v"])
    need = F.col("_required")
    return both.groupBy("question_id", "required", "supporting").agg(
        ordered(need, ref).alias("expected_chunk_refs"), ordered(need, F.col("text")).alias("expected_chunk_texts"), ordered(~need, ref).alias("supporting_chunk_refs")
    ).select(
        "question_id", F.col("required").alias("required_documents"), "expected_chunk_refs", "expected_chunk_texts", F.col("supporting").alias("supporting_documents"), "supporting_chunk_refs",
        F.lit(mode).alias("evidence_mode"),
    )


def balanced_sample(chunks: DataFrame, budget: int = 50, least: int = 2, seed: str = "0") -> DataFrame:
    """At most ``budget`` chunks (document_id, chunk_id), spread over documents.

    First ``least`` chunks (or all) of each document in order of id while the budget lasts, then the rest
    in proportion to what documents have left, at least one each. Chunks of a document are drawn in a
    seeded order. Only the shares need an order over documents; as each takes a chunk at least, no more
    than ``budget`` documents matter in either phase.
    """
    draw = F.row_number().over(Window.partitionBy("document_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("chunk_id").cast("string"))), "chunk_id"))
    pool = chunks.select("document_id", "chunk_id").withColumn("_n", draw)
    sizes = pool.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("size"))
    total = sizes.agg(F.sum("size").alias("_all"), F.sum(F.least(F.col("size"), F.lit(least))).alias("_sure"))
    first = sizes.orderBy("document_id").limit(budget).select("document_id", "size", F.lit(0).alias("part"))
    extra = sizes.filter(F.col("size") > least).orderBy("document_id").limit(budget).select("document_id", "size", F.lit(1).alias("part"))
    listed = first.union(extra).agg(F.array_sort(F.collect_list(F.struct("part", "document_id", "size"))).alias("docs"))

    def take(acc: Column, d: Column, eligible: Column) -> Column:
        left = d["size"] - least
        share = F.greatest(F.lit(1), F.bround(acc["rest"] * left / eligible).cast("int"))
        n = F.when(d["part"] == 0, F.least(d["size"], F.lit(least), acc["rest"])).otherwise(F.least(share, left, acc["rest"]))
        given = F.greatest(n, F.lit(0))
        return F.struct((acc["rest"] - given).alias("rest"), F.concat(acc["out"], F.array(F.struct(d["document_id"].alias("document_id"), d["part"].alias("part"), given.alias("n")))).alias("out"))

    none = F.array().cast("array<struct<document_id:bigint,part:int,n:int>>")
    start = F.struct(F.lit(budget).alias("rest"), none.alias("out"))
    cast = F.transform("docs", lambda d: F.struct(d["part"].alias("part"), d["document_id"].cast("bigint").alias("document_id"), d["size"].alias("size")))
    folded = listed.join(F.broadcast(total)).select(F.explode(F.aggregate(cast, start, lambda a, d: take(a, d, F.greatest(F.col("_all") - F.col("_sure"), F.lit(1))))["out"]).alias("o"))
    quota = folded.groupBy(F.col("o.document_id").alias("document_id")).agg(F.sum("o.n").alias("_quota"))
    return pool.join(F.broadcast(quota), "document_id").filter(F.col("_n") <= F.col("_quota")).select("document_id", "chunk_id")


def normalised_questions(items: Column) -> Column:
    """Array of (question, expected_answer) from JSON items, which may be plain strings."""
    as_struct = lambda i: F.from_json(i, "question string, expected_answer string")
    item = lambda i: F.when(i.startswith("{"), as_struct(i)).otherwise(F.struct(i.alias("question"), F.lit(None).cast("string").alias("expected_answer")))
    return F.transform(F.from_json(items, "array<string>"), item)


def truth_metadata(model: Column, chunk_ids: Column, generated_at: Column) -> Column:
    """Versions and provenance of a question's truth; the time is UTC without a zone."""
    # fixed values: versions of the payload's parts
    return F.struct(
        F.lit("1.1").alias("truth_schema_version"), F.lit("v1").alias("concept_extraction_version"), F.lit("v1").alias("evidence_alignment_version"),
        model.alias("generated_by_model"), generated_at.cast("timestamp_ntz").alias("generated_at"), F.coalesce(chunk_ids, F.array().cast("array<bigint>")).alias("source_chunk_ids"),
    )


def attached(questions: DataFrame, truths: DataFrame) -> DataFrame:
    """``questions`` (question_id, .., truth) with the truth made for those that had none; failures leave it null."""
    made = truths.select("question_id", F.col("truth").alias("_made"))
    return questions.join(made, "question_id", "left").withColumn("truth", F.coalesce("truth", "_made")).drop("_made")


def needing_truth(questions: DataFrame) -> DataFrame:
    """Questions with an expected answer and no truth yet."""
    return questions.filter((F.coalesce("expected_answer", F.lit("")) != "") & F.col("truth").isNull())


def merge_question_sets(sets: DataFrame, changes: DataFrame) -> DataFrame:
    """``sets`` (id, name, questions) with the parts that ``changes`` give."""
    new = changes.select("id", F.col("name").alias("_name"), F.col("questions").alias("_questions"))
    return sets.join(new, "id", "left").select("id", F.coalesce("_name", "name").alias("name"), F.coalesce("_questions", "questions").alias("questions"))


def new_questions(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Generated questions whose text isn't there yet, and isn't blank."""
    return generated.filter(F.trim("question") != "").join(existing.select("question"), "question", "left_anti")


def rerun_questions(results: DataFrame, truth_schema: str) -> DataFrame:
    """(run_id, position, question, expected_answer, truth, truth_lost) to run again, in order of the result's id."""
    truth = F.from_json("truth_payload", truth_schema)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("id")) - 1
    lost = F.col("truth_payload").isNotNull() & F.try_parse_json("truth_payload").isNull()
    return results.select("run_id", place.alias("position"), "question", "expected_answer", F.when(~lost, truth).alias("truth"), lost.alias("truth_lost"))
