"""Streaming ingestion: documents that arrive as files become chunks, each once; and running run totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.operators.chunking import chunk_fixed


def stream_chunks(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str, size: int = 400, overlap: int = 80) -> StreamingQuery:
    """Chunk what is new in a folder of Parquet documents (doc_id, text) and append it to ``out``; then stop.

    Chunking is row by row, so the stream keeps no state; the checkpoint makes each file count once.
    """
    docs = spark.readStream.schema(schema).parquet(path)
    return chunk_fixed(docs, size, overlap).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_scores(results: DataFrame, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Mean score and count by run in windows of event time, over a stream or a table of (ts, run_id, score)."""
    seen = results.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", every), "run_id").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
