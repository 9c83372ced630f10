"""Ingestion: files and addresses, validated into accepted and rejected rows; documents and chunks as tables."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import embedding_input
from plumbline.operators.chunking import chunk_sections
from plumbline.plans.models import attempts
from plumbline.sources.storage import path_exists

MAX_BYTES = 50 * 1024 * 1024
MAX_ADDRESSES = 20


def safe_name(path: Column) -> Column:
    """The last part of a path, without parent references."""
    return F.replace(F.regexp_replace(path, r"^.*[/\\]", ""), F.lit(".."), F.lit(""))


def file_problem(name: Column, length: Column, head: Column) -> Column:
    """Why a file is no acceptable PDF, or null."""
    return (
        F.when(~F.lower(name).endswith(".pdf"), "Only PDF files are supported")
        .when(length > MAX_BYTES, "File exceeds 50 MB limit")
        .when(~F.coalesce(F.hex(F.substring(head, 1, 4)) == "25504446", F.lit(False)), "File is not a valid PDF")
    )


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, length, content, problem) of a folder's files, on any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.withColumn("filename", safe_name(F.col("path")))
    return files.select("path", "filename", "length", "content", file_problem(F.col("filename"), F.col("length"), F.col("content")).alias("problem"))


def address_rows(urls: DataFrame) -> DataFrame:
    """(url, filename, status, message) of addresses; one without scheme or host is an error row.

    The name is the path's last part, ``downloaded.pdf`` without one, and ends in ``.pdf``.
    """
    scheme, host = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]+)", 1)
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    base = F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("")), F.lit("downloaded.pdf"))
    name = F.when(F.lower(base).endswith(".pdf"), base).otherwise(F.concat(base, F.lit(".pdf")))
    bad = (scheme == "") | (host == "")
    return urls.select("url", F.when(~bad, name).alias("filename"), F.when(bad, "error").otherwise("processing").alias("status"), F.when(bad, F.concat(F.lit("Invalid URL: "), F.col("url"))).alias("message"))


def batch_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") != "error").alias("succeeded"), F.count_if(F.col("status") == "error").alias("failed"))


def request_problems(requests: DataFrame) -> DataFrame:
    """Requests (question, top_k) with the reason for a rejection, or null."""
    n = F.length(F.coalesce("question", F.lit("")))
    return requests.withColumn("problem", F.when((n < 1) | (n > 2000), "question has to have 1 to 2000 characters").when((F.col("top_k") < 1) | (F.col("top_k") > 20), "top_k has to lie within 1 and 20"))


Parser = Callable[[bytes], list[str]]


def parse_pages(files: DataFrame, parsers: list[tuple[str, Parser]]) -> DataFrame:
    """(filename, text, page_count, parser_used, error): pages by the first parser that doesn't fail.

    Blank pages are dropped, the others joined by blank lines; ``page_count`` counts all. Parsers are
    optional libraries, so they are given as functions from bytes to the pages' texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                row = (name, None, None, None, "no parser")
                for label, parse in parsers:
                    try:
                        pages = parse(content.as_py())
                        row = (name, "\n\n".join(p.strip() for p in pages if p and p.strip()), len(pages), label, None)
                        break
                    except Exception as e:  # a parser may fail in any way; the next one is tried
                        row = (name, None, None, None, f"{label}: {e}"[:500])
                out.append(row)
            cols = list(zip(*out)) or [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["filename", "text", "page_count", "parser_used", "error"])

    good = files.filter(F.col("problem").isNull()).select("filename", "content")
    return good.mapInArrow(run, "filename string, text string, page_count int, parser_used string, error string")


def chunk_store(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) from parsed files (doc_id, filename, text, page_count, error): rows for the two tables."""
    chunks = chunk_sections(parsed.filter(F.col("error").isNull()).select("doc_id", "text")).withColumns({"page": F.lit(None).cast("string"), "embedding": F.lit(None).cast("array<float>")})
    n = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    documents = parsed.join(n, "doc_id", "left").select(
        "doc_id", "filename", "page_count", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.when(F.col("error").isNull(), "processing").otherwise("error").alias("status"), F.col("error").alias("message")
    )
    return documents, chunks


def embedding_status(chunks: DataFrame) -> DataFrame:
    """(document_id, status, message) after embedding: ready, ready with some missing, or failed."""
    per = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull()).alias("k"))
    told = F.concat(F.col("k").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" chunks missing embeddings"))
    return per.select("document_id", F.when(F.col("k") == F.col("n"), "embedding_failed").otherwise("ready").alias("status"), F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), told).alias("message"))


def embed_missing(chunks: DataFrame, call: Callable[[list[str]], list[list[float] | None]], batch: int = 16, wait: float = 2.0, limited: int = 5) -> DataFrame:
    """``chunks`` (chunk_id, text, embedding) with embeddings for those without one, in batches of ``batch`` texts.

    ``call`` gets prepared texts and returns a vector, None or an exception for each. Where it raises ``RateLimited`` the
    batch is sent again, ``limited`` times at most, after waits from ``wait`` seconds on that double; any other
    exception costs the texts that cause it their embedding and no others. Only rows without an embedding go through
    Python.
    """
    ask = attempts(lambda _, texts: call(texts), 1, wait, limited=limited)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, out = b.column(1).to_pylist(), []
            for i in range(0, len(texts), batch):
                some = texts[i : i + batch]
                out += [vector for vector, _, _ in ask("embed", some, [None] * len(some))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float32()))], ["chunk_id", "_new"])

    todo = chunks.filter(F.col("embedding").isNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), embedding_input(F.col("text")).alias("text"))
    made = todo.mapInArrow(run, "chunk_id long, _new array<float>")
    return chunks.join(made, "chunk_id", "left").withColumn("embedding", F.coalesce(F.col("embedding").cast("array<float>"), "_new")).drop("_new")


def needs_embedding(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with a chunk that has no embedding yet."""
    return documents.join(chunks.filter(F.col("embedding").isNull()).select("document_id"), "document_id", "left_semi")


def delete_rows(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``table`` without the rows of the given ids; used for the table itself and those that point to it."""
    return table.join(ids.select(key), key, "left_anti")


def model_metadata(raw: DataFrame) -> DataFrame:
    """Models from an admin interface's JSON (body): camel case to columns, with capabilities as a list."""
    shape = (
        "array<struct<id:string,name:string,contextLength:bigint,maxTokens:bigint,pricing:struct<input:double,output:double,unit:string>,capabilities:array<string>,"
        "tpm:bigint,rpm:bigint,supportsVision:boolean,supportsFunctionCalling:boolean,supportsReasoning:boolean,supportsEmbeddings:boolean>>"
    )
    m = raw.select(F.explode(F.from_json("body", shape)).alias("m"))
    return m.select(
        "m.id", "m.name", F.col("m.contextLength").alias("context_length"), F.col("m.maxTokens").alias("max_tokens"), "m.pricing", F.coalesce("m.capabilities", F.array().cast("array<string>")).alias("capabilities"),
        "m.tpm", "m.rpm", F.coalesce("m.supportsVision", F.lit(False)).alias("supports_vision"), F.coalesce("m.supportsFunctionCalling", F.lit(False)).alias("supports_function_calling"),
        F.coalesce("m.supportsReasoning", F.lit(False)).alias("supports_reasoning"), F.coalesce("m.supportsEmbeddings", F.lit(False)).alias("supports_embeddings"),
    )


def model_snapshots(spark: SparkSession, path: str, fetch: Callable[[], str], ttl: float = 300.0, now: Callable[[], float] = time.time) -> DataFrame:
    """Models from the newest snapshot below ``path`` that is at most ``ttl`` seconds old, else from ``fetch``.

    ``fetch`` gives the admin interface's JSON, a list or an object with the list in ``data``; what it gave is kept as a snapshot of its own, named by
    the time. If it raises, or gives no JSON, the last snapshot is read however old it is; without one there are no models.
    """
    shape, at = "body string, taken long", round(now() * 1000)
    held = spark.read.schema(shape).option("recursiveFileLookup", "true").parquet(path) if path_exists(spark, path) else spark.createDataFrame([], shape)
    last = held.agg(F.max_by("body", "taken").alias("body"), F.max("taken").alias("taken")).first()
    body = last["body"]
    if body is None or at - last["taken"] >= ttl * 1000:
        try:
            told = json.loads(fetch())
            body = json.dumps(told.get("data", []) if isinstance(told, dict) else told)
            spark.createDataFrame([(body, at)], shape).coalesce(1).write.parquet(f"{path}/taken-{at}-{uuid.uuid4().hex}")
        except Exception as e:  # a service fails in any way; what is known stays good
            logging.getLogger(__name__).warning("model metadata could not be fetched: %s", e)
    return model_metadata(spark.createDataFrame([(body,)] if body is not None else [], "body string"))


def configured_models(spark: SparkSession, model_a: str, model_b: str) -> DataFrame:
    return spark.createDataFrame([(1, model_a, "available"), (2, model_b, "available")], "id int, name string, status string")


def search_models(models: DataFrame, text: str) -> DataFrame:
    return models.filter(F.contains(F.lower("name"), F.lit(text.lower()))).orderBy("id")
