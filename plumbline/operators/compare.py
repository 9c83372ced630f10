"""Comparison of runs: metrics, warnings, decision and matched questions, for many pairs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import percent
from plumbline.plans.profiles import Profile

TIE = 0.05
# Compared metrics in order, those where less is better, and the priority of the tie-break.
METRICS = [
    "groundedness", "relevancy", "context_precision", "context_relevancy", "completeness", "correctness", "compliance_accuracy", "abstention",
    "hallucination_rate", "latency_ms",
]
LOWER_IS_BETTER = ("hallucination_rate", "latency_ms")
PRIORITY = ["groundedness", "completeness", "correctness", "compliance_accuracy", "relevancy", "context_precision", "context_relevancy", "abstention"]
GATES = {"completeness_score": "avg_completeness", "correctness_score": "avg_correctness", "compliance_accuracy_score": "avg_compliance_accuracy"}


def metric_winner(a: Column, b: Column, lower: bool = False) -> Column:
    """``run_a``, ``run_b`` or ``tie`` within the band; null if a value is."""
    better = a < b if lower else a > b
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.abs(a - b) < TIE, "tie").when(better, "run_a").otherwise("run_b")


def paired(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Pairs (run_a, run_b) with both runs' columns as structs ``a`` and ``b``: two equi-joins."""
    whole = F.struct(*[F.col(c) for c in runs.columns])
    a, b = runs.select(F.col("run_id").alias("run_a"), whole.alias("a")), runs.select(F.col("run_id").alias("run_b"), whole.alias("b"))
    return pairs.select("run_a", "run_b").join(a, "run_a").join(b, "run_b")


def _value(run: str, metric: str) -> Column:
    return F.col(f"{run}.{metric if metric == 'hallucination_rate' else 'avg_' + metric}").cast("double")


def compare_metrics(both: DataFrame) -> DataFrame:
    """(run_a, run_b, metric, value_a, value_b, winner), ten rows a pair."""
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), _value("a", m).alias("value_a"), _value("b", m).alias("value_b"), metric_winner(_value("a", m), _value("b", m), m in LOWER_IS_BETTER).alias("winner"))
        for m in METRICS
    ])
    return both.select("run_a", "run_b", F.explode(rows).alias("m")).select("run_a", "run_b", "m.*")


def decide(both: DataFrame, profile: Profile | None) -> DataFrame:
    """Winner, status, reasons, risk flags and summary of each pair.

    Runs below a gate's threshold are out; then the verdict, the failures, the reviews and the count of
    priority metrics decide, in this order.
    """
    strings = "array<string>"
    none = F.array().cast(strings)
    compact = lambda cols: F.filter(F.array(*cols).cast(strings), lambda x: x.isNotNull()) if cols else none
    gates = [(m.removesuffix("_score"), f, profile.thresholds[m]) for m, f in GATES.items() if m in profile.thresholds] if profile else []
    out_of = lambda r: compact([F.when(F.col(f"{r}.{f}") < t, F.lit(f"{label}_below_threshold")) for label, f, t in gates])
    flag = lambda r, label, f, t: F.when(
        F.col(f"{r}.{f}") < t,
        F.concat(F.col(f"{r}.model_name"), F.lit(f": {label} ("), percent(F.col(f"{r}.{f}")), F.lit(") below threshold ("), percent(F.lit(t)), F.lit(")")),
    )
    df = both.withColumns({"out_a": out_of("a"), "out_b": out_of("b"), "flags": compact([flag(r, *g) for g in gates for r in "ab"])})

    out_a, out_b = F.size("out_a") > 0, F.size("out_b") > 0
    rank = lambda r: F.when(F.col(f"{r}.overall_verdict") == "PASS", 0).when(F.col(f"{r}.overall_verdict") == "REVIEW_REQUIRED", 1).when(F.col(f"{r}.overall_verdict") == "FAIL", 2)
    count = lambda r, c: F.coalesce(F.col(f"{r}.{c}"), F.lit(0))
    wins = lambda w: sum((F.when(metric_winner(_value("a", m), _value("b", m)) == w, 1).otherwise(0) for m in PRIORITY), F.lit(0))

    def choice(winner: Column | str, status: Column | str, reason: str | None) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        reasons = F.array(F.lit(reason)) if reason else none
        return F.struct(lit(winner).alias("winner"), lit(status).alias("status"), reasons.cast(strings).alias("reasons"))

    fewer = lambda a, b: F.when(a < b, "run_a").otherwise("run_b")
    fails, reviews, leads = (count("a", "fail_count"), count("b", "fail_count")), (count("a", "review_count"), count("b", "review_count")), (wins("run_a"), wins("run_b"))
    decision = (
        F.when(out_a & out_b, choice(F.lit(None).cast("string"), "inconclusive", "BOTH_DISQUALIFIED"))
        .when(out_a, choice("run_b", "decisive", "OPPONENT_DISQUALIFIED"))
        .when(out_b, choice("run_a", "decisive", "OPPONENT_DISQUALIFIED"))
        .when(rank("a") != rank("b"), choice(fewer(rank("a"), rank("b")), "decisive", "BETTER_VERDICT"))
        .when(fails[0] != fails[1], choice(fewer(*fails), F.when(F.abs(fails[0] - fails[1]) > 1, "decisive").otherwise("marginal"), "FEWER_FAILURES"))
        .when(reviews[0] != reviews[1], choice(fewer(*reviews), "marginal", "FEWER_REVIEWS"))
        .when(leads[0] != leads[1], choice(F.when(leads[0] > leads[1], "run_a").otherwise("run_b"), "marginal", "METRIC_ADVANTAGE"))
        .otherwise(choice("tie", "inconclusive", None))
    )
    df = df.withColumn("d", decision)
    both_out = F.array_contains("d.reasons", "BOTH_DISQUALIFIED")
    extra = F.when(both_out, F.array(F.lit("Both models fail critical quality gates"))).otherwise(
        none if profile else F.array(F.lit("No evaluation profile: verdict and gate checks were skipped"))
    )
    df = df.withColumn("risk_flags", F.concat("flags", extra))
    name = F.when(F.col("d.winner") == "run_a", F.col("a.model_name")).when(F.col("d.winner") == "run_b", F.col("b.model_name"))
    return df.select(
        "run_a", "run_b", F.col("d.winner").alias("winner"), name.alias("winner_name"), F.col("d.status").alias("decision_status"), F.col("d.reasons").alias("reason_codes"),
        decision_summary(F.col("d.winner"), name, F.col("d.reasons"), F.col("risk_flags")).alias("summary"), "risk_flags", F.col("out_a").alias("disqualified_a"), F.col("out_b").alias("disqualified_b"),
    )


def decision_summary(winner: Column, name: Column, reasons: Column, flags: Column) -> Column:
    has = lambda code: F.array_contains(reasons, code)
    why = (
        F.when(has("BETTER_VERDICT"), "has a better overall verdict")
        .when(has("FEWER_FAILURES"), "has fewer critical failures")
        .when(has("FEWER_REVIEWS"), "requires fewer manual reviews")
        .when(has("METRIC_ADVANTAGE"), "leads on more business-priority metrics")
        .otherwise("leads overall")
    )
    noted = F.when(F.size(flags) > 0, F.concat(F.lit(" ("), F.size(flags).cast("string"), F.when(F.size(flags) == 1, " risk flag").otherwise(" risk flags"), F.lit(" noted)"))).otherwise("")
    return (
        F.when(winner == "tie", "Both models perform comparably with no decisive advantage.")
        .when(name.isNull() & has("BOTH_DISQUALIFIED"), "No winner: both models fail minimum quality thresholds.")
        .when(name.isNull(), "Comparison inconclusive.")
        .when(has("OPPONENT_DISQUALIFIED"), F.concat(name, F.lit(" wins because the other model fails critical quality gates.")))
        .otherwise(F.concat(name, F.lit(" wins: "), why, F.lit("."), noted))
    )


def warnings(both: DataFrame) -> DataFrame:
    """(run_a, run_b, code, message): what makes the runs of a pair hard to compare, in fixed order."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    unset = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    shown = lambda c, none: F.when(unset(c), none).otherwise(c.cast("string"))
    missing = lambda c: F.when(unset(a(c)), "run A").otherwise("run B")
    known = lambda c: ~unset(a(c)) & ~unset(b(c))
    differ = lambda c: ~a(c).eqNullSafe(b(c))

    def warn(when: Column, code: str, *message: Column | str) -> Column:
        text = F.concat(*[F.lit(m) if isinstance(m, str) else m for m in message])
        return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message")))

    all_ = F.array(
        warn(differ("profile_id"), "PROFILE_MISMATCH", "Runs use different profiles: ", shown(a("profile_id"), "none"), " vs ", shown(b("profile_id"), "none")),
        warn(differ("question_set_id"), "QUESTION_SET_MISMATCH", "Runs use different question sets"),
        warn(known("profile_id") & ~differ("profile_id") & differ("profile_version"), "PROFILE_VERSION_MISMATCH", "Same profile but different versions: ", shown(a("profile_version"), "unknown"), " vs ", shown(b("profile_version"), "unknown")),
        warn(known("judge_model_name") & differ("judge_model_name"), "JUDGE_MODEL_MISMATCH", "Runs used different judge models: ", a("judge_model_name"), " vs ", b("judge_model_name")),
        warn(~known("judge_model_name"), "JUDGE_MODEL_UNKNOWN", "Judge model not recorded for ", missing("judge_model_name"), "; scoring conditions may differ"),
        warn(known("corpus_snapshot") & differ("corpus_snapshot"), "CORPUS_MISMATCH", "Corpus changed between runs; retrieval results may not be comparable"),
        warn(~known("corpus_snapshot"), "CORPUS_UNKNOWN", "Corpus snapshot not recorded for ", missing("corpus_snapshot"), "; cannot verify same corpus"),
        warn(unset(a("profile_id")) & unset(b("profile_id")), "NO_PROFILE", "Neither run has a profile; verdict and gate checks are skipped"),
    )
    return both.select("run_a", "run_b", F.explode(F.filter(all_, lambda w: w.isNotNull())).alias("w")).select("run_a", "run_b", "w.code", "w.message")


def match_questions(pairs: DataFrame, results: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Questions of both runs of each pair, matched by text: (run_a, run_b, position, question, expected_answer, id_a, id_b).

    The last row counts if a run has a question twice. Order: as in run A, then what only B has. The
    expected answer is A's, else B's, else that of the question sets: ``expected`` (run_id, question,
    expected_answer), A's set first.
    """
    w = Window.partitionBy("run_id", "question")
    last = results.withColumns({"_n": F.row_number().over(w.orderBy(F.col("id").desc())), "_pos": F.min("id").over(w)}).filter("_n = 1")
    side = lambda run, tag: pairs.select("run_a", "run_b").join(last.withColumnRenamed("run_id", run), run).select(
        "run_a", "run_b", "question", F.col("id").alias(f"id_{tag}"), F.nullif(F.col("expected_answer"), F.lit("")).alias(f"exp_{tag}"), F.col("_pos").alias(f"pos_{tag}")
    )
    both = side("run_a", "a").join(side("run_b", "b"), ["run_a", "run_b", "question"], "full_outer")
    answer = F.coalesce("exp_a", "exp_b")
    if expected is not None:
        filled = expected.filter("coalesce(expected_answer, '') <> ''").groupBy("run_id", "question").agg(F.first("expected_answer").alias("_e"))
        for run in ("run_a", "run_b"):
            both = both.join(filled.select(F.col("run_id").alias(run), "question", F.col("_e").alias(f"_{run}")), [run, "question"], "left")
        answer = F.coalesce("exp_a", "exp_b", "_run_a", "_run_b")
    place = F.row_number().over(Window.partitionBy("run_a", "run_b").orderBy(F.col("pos_a").asc_nulls_last(), F.col("pos_b"))) - 1
    return both.select("run_a", "run_b", place.alias("position"), "question", answer.alias("expected_answer"), "id_a", "id_b")


def backfill_expected(results: DataFrame, items: DataFrame) -> DataFrame:
    """``results`` whose blank expected answers come from the first item (question, expected_answer, position) of that text."""
    first = items.filter("coalesce(expected_answer, '') <> ''").groupBy("question").agg(F.min_by("expected_answer", "position").alias("_from_set"))
    out = results.join(first, "question", "left")
    return out.withColumn("expected_answer", F.coalesce(F.nullif(F.col("expected_answer"), F.lit("")), "_from_set")).drop("_from_set")


#: Characters of the piece of an id by which names that hold it are found.
PIECE = 6


def match_models(names: DataFrame, metadata: DataFrame) -> DataFrame:
    """(model_name, id): the model's metadata by id, by name, by id whatever the case, or by an id that the name holds.

    The first of these tiers counts, in it the first entry by position. All four are joins by equality. For the
    last, each id is looked up by its rarest piece of up to ``PIECE`` characters among the pieces of the names,
    and what has met is compared whole; an id as short as a piece needs no comparison, and of ids that
    differ in case only the first one counts. Names are distinct afterwards; blank ids are held by every name.
    """
    names = names.select("model_name").distinct()
    m = metadata.select("id", "name", "position")
    entry = lambda t: F.struct(F.lit(t).alias("tier"), "position", "id").alias("e")
    found = names.join(m, F.col("id") == F.col("model_name")).select("model_name", entry(0))
    found = found.union(names.join(m, F.col("name") == F.col("model_name")).select("model_name", entry(1)))
    first = m.filter(F.col("id").isNotNull()).groupBy(F.lower("id").alias("low")).agg(F.min(F.struct("position", "id")).alias("f")).select("low", "f.position", "f.id")
    lowered = names.filter(F.col("model_name").isNotNull()).select("model_name", F.lower("model_name").alias("text"))
    found = found.union(lowered.join(first, F.col("low") == F.col("text")).select("model_name", entry(2)))
    size = F.least(F.length("low"), F.lit(PIECE))
    sizes = [r[0] for r in first.select(size).distinct().collect()]  # seven at most
    pieces = lambda text, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n)))
    of_size = lambda text, n: F.when(F.length(text) >= n, pieces(text, n) if n else F.array(F.lit("")))
    nothing = F.array().cast("array<string>")
    held = lowered.withColumn("piece", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(of_size("text", n), nothing) for n in sizes]))))) if sizes else lowered.withColumn("piece", F.lit(None).cast("string")).limit(0)
    frequency = held.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    by_size = F.lit(None).cast("array<string>")
    for n in sizes:
        by_size = F.when(size == n, of_size("low", n)).otherwise(by_size)
    lead = first.withColumn("piece", F.explode(by_size)).join(frequency, "piece").groupBy("low", "position", "id").agg(F.min(F.struct("n", "piece")).alias("l"))
    met = held.join(lead.select("low", "position", "id", F.col("l.piece").alias("piece")), "piece").filter(F.contains("text", "low"))
    found = found.union(met.select("model_name", entry(3)))
    best = found.groupBy("model_name").agg(F.min("e").alias("e"))
    return names.join(best, "model_name", "left").select("model_name", "e.id")
