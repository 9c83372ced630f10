"""Facts that a front end shows, as columns: narratives, insights, progress, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import format_tokens
from plumbline.operators.compare import backfill_expected


def _sentence(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def documents_found(documents: Column, contexts: Column) -> Column:
    """How many of the documents are among the retrieved ones, whatever case and outer blanks."""
    plain = lambda a: F.transform(a, lambda d: F.lower(F.trim(d)))
    return F.size(F.filter(plain(documents), lambda d: F.array_contains(plain(contexts), d)))


def required_progress(total: Column, passed: Column, detail: Column) -> Column:
    """(found, total) of required documents, from the check's verdict or its text."""
    missing = F.nullif(F.regexp_extract(detail, r"(?i)Missing\s+(\d+)/(\d+)", 1), F.lit("")).cast("int")
    told = F.nullif(F.regexp_extract(detail, r"(?i)Missing\s+(\d+)/(\d+)", 2), F.lit("")).cast("int")
    of = F.when(told > 0, told).otherwise(total)
    pair = lambda found, n: F.struct(found.cast("int").alias("found"), n.cast("int").alias("total"))
    none = F.lit(None).cast("int")
    return (
        F.when(total == 0, pair(none, F.lit(0))).when(passed.isNull(), pair(none, total)).when(passed, pair(total, total))
        .when(missing.isNotNull(), pair(F.greatest(F.lit(0), of - missing), of)).otherwise(pair(none, total))
    )


def _context_note(a: Column, b: Column, name_a: Column, name_b: Column, verb: str, tail: str) -> Column:
    ratio = a / F.nullif(b, F.lit(0))
    whole = lambda x: F.floor(x + 0.5).cast("string")
    return F.when(ratio > 1.5, _sentence(name_a, f" {verb}", whole(ratio), f"x larger context window{tail}")).when(ratio < 1 / 1.5, _sentence(name_b, f" {verb}", whole(1 / ratio), f"x larger context window{tail}"))


def _price_note(a: Column, b: Column, name_a: Column, name_b: Column, unit: str) -> Column:
    pct = F.floor((1 - F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0.0))) * 100 + 0.5)
    return F.when((a > 0) & (b > 0) & (pct >= 10), _sentence(F.when(a < b, name_a).otherwise(name_b), " is ", pct.cast("string"), f"% cheaper per {unit}"))


def narratives(metrics: DataFrame, decisions: DataFrame, specs: DataFrame) -> DataFrame:
    """(run_a, run_b, narrative): who is ahead, wins by metric, speed, price and context of each pair.

    ``specs`` has (run_a, run_b, name_a, name_b, price_a, price_b, context_a, context_b).
    """
    scored = (F.col("metric") != "latency_ms") & F.col("value_a").isNotNull() & F.col("value_b").isNotNull()
    latency = lambda v: F.max(F.when(F.col("metric") == "latency_ms", F.col(v)))
    counts = metrics.groupBy("run_a", "run_b").agg(
        F.count_if(scored).alias("n"), F.count_if(scored & (F.col("winner") == "run_a")).alias("wins_a"), F.count_if(scored & (F.col("winner") == "run_b")).alias("wins_b"),
        F.count_if(scored & (F.coalesce("winner", F.lit("tie")) == "tie")).alias("ties"), latency("value_a").alias("ms_a"), latency("value_b").alias("ms_b"),
    )
    df = counts.join(decisions.select("run_a", "run_b", "winner", "winner_name", "decision_status"), ["run_a", "run_b"]).join(specs, ["run_a", "run_b"])
    a, b = F.col("name_a"), F.col("name_b")
    loser = F.when(F.col("winner_name") == a, b).otherwise(a)
    ahead = _sentence(F.col("winner_name"), F.when(F.col("decision_status") == "marginal", " marginally").otherwise(""), " outperforms ", loser, " on this evaluation.")
    lead = F.when(F.col("winner_name").isNotNull() & (F.col("decision_status") != "inconclusive"), ahead).otherwise(_sentence(a, " and ", b, " perform comparably on this evaluation."))
    s = lambda c: F.col(c).cast("string")
    wins = _sentence("Across ", s("n"), " metrics: ", a, " wins ", s("wins_a"), ", ", b, " wins ", s("wins_b"), F.when(F.col("ties") > 0, _sentence(", ", s("ties"), " tied")).otherwise(""), ".")
    gap = F.abs(F.col("ms_a") - F.col("ms_b"))
    faster = F.when(gap > 1000, _sentence(F.when(F.col("ms_a") < F.col("ms_b"), a).otherwise(b), " is ", F.format_string("%.0fms", gap), " faster per question."))
    price = F.concat(_price_note(F.col("price_a"), F.col("price_b"), a, b, "token"), F.lit("."))
    context = _context_note(F.col("context_a"), F.col("context_b"), a, b, "has a ", ".")
    return df.select("run_a", "run_b", F.concat_ws(" ", lead, F.when(F.col("n") > 0, wins), faster, price, context).alias("narrative"))


def model_insights(pairs: DataFrame) -> DataFrame:
    """(run_a, run_b, insights) from (.., name_a, name_b, price_*, context_*, capabilities_*, vision_*)."""
    a, b = F.col("name_a"), F.col("name_b")
    only = lambda x, y, n: F.when(
        (F.size(x) > 0) & (F.size(y) > 0) & (F.size(F.array_except(x, y)) > 0), _sentence(n, " uniquely supports: ", F.array_join(F.array_except(x, y), ", "))
    )
    caps_a, caps_b = F.col("capabilities_a"), F.col("capabilities_b")
    vision = lambda x, y, n: F.when(x & ~F.coalesce(y, F.lit(False)), _sentence(n, " supports vision"))
    notes = F.array(
        _context_note(F.col("context_a"), F.col("context_b"), a, b, "has ", ""),
        _price_note(F.col("price_a"), F.col("price_b"), a, b, "input token"),
        only(caps_a, caps_b, a), only(caps_b, caps_a, b), vision(F.col("vision_a"), F.col("vision_b"), a), vision(F.col("vision_b"), F.col("vision_a"), b),
    )
    return pairs.select("run_a", "run_b", F.filter(notes, lambda x: x.isNotNull()).alias("insights"))


def spec_lines(models: DataFrame) -> DataFrame:
    """Context length, price and release of models, as shown."""
    price = F.when(F.col("price").isNotNull(), F.concat(F.lit("$"), F.format_string("%.2f", F.col("price") * 1_000_000), F.lit("/1M")))
    context = F.when(F.coalesce("context", F.lit(0)) == 0, "--").otherwise(F.concat(format_tokens(F.col("context")), F.lit(" tokens")))
    return models.select("id", context.alias("context_shown"), F.coalesce(price, F.lit("--")).alias("price_shown"))


def comparison_header(both: DataFrame, n_questions: DataFrame) -> DataFrame:
    """(run_a, run_b, profile_id, n_questions, indexed_documents) of pairs of runs."""
    profile = F.coalesce(F.nullif(F.col("a.profile_id"), F.lit("")), F.col("b.profile_id"))
    return both.join(n_questions, ["run_a", "run_b"], "left").select("run_a", "run_b", profile.alias("profile_id"), F.coalesce("n_questions", F.lit(0)).alias("n_questions"), F.coalesce("a.total_documents", "b.total_documents").alias("indexed_documents"))


def valid_questions(questions: DataFrame) -> DataFrame:
    return questions.filter(F.trim("question") != "")


def readiness(runs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: ``compare`` with two completed runs, ``evaluate`` with a document, else ``setup``."""
    n = runs.agg(F.count_if(F.col("status") == "completed").alias("completed"))
    d = documents.agg(F.count(F.lit(1)).alias("documents"))
    state = F.when(F.col("completed") >= 2, "compare").when(F.col("documents") > 0, "evaluate").otherwise("setup")
    return n.join(F.broadcast(d)).select("completed", "documents", state.alias("state"))


def recent_completed(runs: DataFrame, n: int = 3) -> DataFrame:
    return runs.filter(F.col("status") == "completed").orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(n)


def comparison_history(viewed: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` distinct pairs (run_a, run_b, viewed_at)."""
    last = viewed.groupBy("run_a", "run_b").agg(F.max("viewed_at").alias("viewed_at"))
    return last.orderBy(F.col("viewed_at").desc(), "run_a", "run_b").limit(n)


def service_health(services: DataFrame) -> DataFrame:
    """One row: ready if all services (critical, healthy) are, not_ready if no critical one is, else degraded."""
    all_, critical = F.bool_and("healthy"), F.max(F.when(F.col("critical"), F.col("healthy")))
    return services.agg(F.when(all_, "ready").when(~critical, "not_ready").otherwise("degraded").alias("state"))


def newest_first(df: DataFrame, id_col: str) -> DataFrame:
    """A listing: what is not deleted, newest first, ids as tie-break."""
    shown = df.filter(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df
    return shown.orderBy(F.col("created_at").desc(), F.col(id_col).desc())


def numbered(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def run_detail(results: DataFrame, items: DataFrame) -> DataFrame:
    """(run_id, results): a run's results in order of their ids, each with its expected answer: its own, or where that is
    blank the one of the first item (question, expected_answer, position) with that question.

    A run has a hundred questions at most, so its list is a short one.
    """
    full = backfill_expected(results, items)
    one = F.struct("id", *[c for c in full.columns if c not in ("run_id", "id")])
    return full.groupBy("run_id").agg(F.array_sort(F.collect_list(one), lambda a, b: F.when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("results"))
