"""The life of a run as a stream: questions arrive as files, each run is evaluated once and tells its status.

A micro-batch writes its results and its status to folders named by the number of the batch. If it is
killed, the stream does the same batch again after a restart and overwrites what it had written, so that each
result is there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from plumbline.sources.storage import path_exists

STATUS = "run_id long, status string, total_questions long, completed_questions long, error_message string"
#: In the order in which a run goes through them; the last three end it.
PENDING, RUNNING, COMPLETED, FAILED, CANCELLED = "pending", "running", "completed", "failed", "cancelled"


class RunFolder:
    """Results, statuses and cancellations of runs below one path that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save_results(self, results: DataFrame, batch: int) -> None:
        results.write.mode("overwrite").parquet(f"{self.path}/results/batch={batch}")

    def save_status(self, rows: DataFrame, batch: int, step: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/status/batch={batch}/step={step}")

    def cancel(self, run_ids: list[int]) -> None:
        """No question of these runs is evaluated from the next batch on."""
        self.spark.createDataFrame([(i,) for i in run_ids], "run_id long").write.mode("append").parquet(f"{self.path}/cancelled")

    def results(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/results").drop("batch")

    def cancelled(self) -> DataFrame:
        where = f"{self.path}/cancelled"
        return self.spark.read.schema("run_id long").parquet(where).distinct() if path_exists(self.spark, where) else self.spark.createDataFrame([], "run_id long")

    def statuses(self, questions: DataFrame) -> DataFrame:
        """(run_id, status, total_questions, completed_questions, error_message): where each run of the question folder is now.

        Numbers add up over the batches in which a run came; it has failed if one of them has.
        """
        waiting = questions.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_questions"))
        where = f"{self.path}/status"
        if not path_exists(self.spark, where):
            seen = self.spark.createDataFrame([], STATUS + ", batch int, step int")
        else:
            seen = self.spark.read.option("basePath", where).schema(STATUS + ", batch int, step int").parquet(where)
        last = seen.groupBy("run_id", "batch").agg(F.max_by(F.struct("status", "completed_questions", "error_message"), "step").alias("s"))
        order = F.array_position(F.array(*map(F.lit, (PENDING, COMPLETED, CANCELLED, RUNNING, FAILED))), F.col("s.status"))
        worst = last.groupBy("run_id").agg(F.max_by("s.status", order).alias("status"), F.sum("s.completed_questions").alias("completed_questions"), F.max("s.error_message").alias("error_message"))
        out = waiting.join(worst, "run_id", "left")
        return out.select("run_id", F.coalesce("status", F.lit(PENDING)).alias("status"), "total_questions", F.coalesce("completed_questions", F.lit(0)).alias("completed_questions"), "error_message")


def run_batch(questions: DataFrame, batch: int, folder: RunFolder, evaluate: Callable[[DataFrame], DataFrame]) -> None:
    """Evaluate the questions of one micro-batch and tell the status of their runs, before and after."""
    per = questions.groupBy("run_id").agg(F.count(F.lit(1)).alias("total_questions"))
    stopped = folder.cancelled()
    live = per.join(stopped, "run_id", "left_anti")
    told = lambda rows, status, done, error=None: rows.select("run_id", F.lit(status).alias("status"), "total_questions", done.cast("long").alias("completed_questions"), F.lit(error).cast("string").alias("error_message"))
    over = told(per.join(stopped, "run_id", "left_semi"), CANCELLED, F.lit(0))
    folder.save_status(told(live, RUNNING, F.lit(0)).unionByName(over), batch, 1)
    try:
        folder.save_results(evaluate(questions.join(stopped, "run_id", "left_anti")), batch)
        done = folder.spark.read.parquet(f"{folder.path}/results/batch={batch}").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
        end = told(live.join(done, "run_id", "left"), COMPLETED, F.coalesce("n", F.lit(0)))
    except Exception as e:  # whatever stops an evaluation is told as the run's failure; the stream goes on
        end = told(live, FAILED, F.lit(0), (str(e) or type(e).__name__)[:500])
    folder.save_status(end.unionByName(over), batch, 2)


def stream_runs(spark: SparkSession, questions: str, schema: StructType, folder: RunFolder, checkpoint: str, evaluate: Callable[[DataFrame], DataFrame], files: int = 16, forever: bool = False) -> StreamingQuery:
    """Evaluate what is new in a folder of Parquet questions (run_id, query_id, question, ..), up to ``files`` files a batch.

    ``evaluate`` makes results from questions, such as ``lambda q: evaluate(q, chunks, profile, client)``. The stream
    stops when all files are done, or, with ``forever``, waits for more.
    """
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(questions)
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: run_batch(rows, batch, folder, evaluate))
    return (writer if forever else writer.trigger(availableNow=True)).start()
