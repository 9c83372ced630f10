"""Queries over the test tables, one or more for each operator, with their SQL for an independent engine.

The tables stand in for evaluation data: events are results of runs, documents are chunks with their source
as document, benchmark items are questions and expected texts, conversations are questions and answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import stem
from plumbline.functions import text as T
from plumbline.operators import alignment, checks, chunking, compare, fulltext, judge, reports, retrieval, truth, verdicts
from plumbline.plans.profiles import FINANCE, SCORES
from plumbline.sources import ingest
from plumbline.sources.storage import settled

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- results of runs, in expressions that both engines read -------------------------------------------


def _score(k: int) -> str:
    return f"case when (event_id + {k}) % 11 = 0 then null else ((event_id * {7 + 2 * k} + user_id * 13) % 101) / 100.0e0 end"


RESULT_EXPRESSIONS = [
    "event_id as id",
    "user_id % 12 as run_id",
    "concat('question ', cast(event_id % 40 as string)) as question",
    "case when event_id % 3 = 0 then '' else concat('expected ', cast(event_id % 7 as string)) end as expected_answer",
    "case when event_id % 29 = 0 then null else concat('answer ', cast(event_id as string)) end as answer",
    "case when event_id % 29 = 0 then 'timeout' end as error_message",
    "value as latency_ms",
    "event_id % 500 as total_tokens",
    *[f"{_score(k)} as {s}" for k, s in enumerate(SCORES)],
    f"({_score(0)}) < 0.7e0 as is_hallucination",
    "case when event_id % 5 = 0 then null else (event_id % 4) / 3.0e0 end as chunk_alignment_score",
]
_RESULTS_SQL = f"results as (select {', '.join(RESULT_EXPRESSIONS)} from events)"


def results(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").selectExpr(*RESULT_EXPRESSIONS)


_AVERAGES = [f"avg_{s.removesuffix('_score')}" for s in SCORES] + ["avg_chunk_alignment", "hallucination_rate", "avg_latency_ms"]
_AGGREGATE_SQL = f"""aggregates as (select run_id, count(*) as completed_questions,
 {", ".join(f"avg(case when error_message is null then {s} end) as avg_{s.removesuffix('_score')}" for s in SCORES)},
 avg(case when error_message is null then chunk_alignment_score end) as avg_chunk_alignment,
 count(case when is_hallucination and error_message is null then 1 end)::double / nullif(count(case when is_hallucination is not null and error_message is null then 1 end), 0) as hallucination_rate,
 nullif(coalesce(sum(case when error_message is null then total_tokens end), 0), 0)::bigint as total_tokens,
 coalesce(sum(case when error_message is null then latency_ms end), 0.0e0) / count(*) as avg_latency_ms
 from results where answer is not null or error_message is not null group by run_id)"""
_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in _AVERAGES)


@query("run_aggregate", f"with {_RESULTS_SQL}, {_AGGREGATE_SQL} select run_id, completed_questions, total_tokens, {_ROUNDED} from aggregates")
def run_aggregate(spark: SparkSession, d: str) -> DataFrame:
    out = verdicts.run_aggregates(results(spark, d))
    return out.select("run_id", "completed_questions", "total_tokens", *[F.round(c, 6).alias(c) for c in _AVERAGES])


_CHECKED = """array(named_struct('check_name', 'document_presence', 'passed', id % 17 <> 0, 'detail', '', 'category', 'retrieval'),
 named_struct('check_name', 'chunk_alignment', 'passed', id % 5 <> 0, 'detail', '', 'category', 'retrieval'))"""
_GAPS = """case when id % 2 = 0 then named_struct('missing', array('a'), 'retrieval_failures', filter(array('a'), x -> false), 'generation_failures', array('a')) end"""
_REASON_SQL = "\n".join(f"case when {m} < {t}e0 then '{verdicts.REASONS[m]}' end," for m, t in FINANCE.critical.items())
_REVIEW_SQL = "\n".join(
    f"case when {m} < {t}e0{f' and not {m} < {FINANCE.critical[m]}e0' if m in FINANCE.critical else ''} then '{verdicts.REASONS[m]}' end," for m, t in FINANCE.thresholds.items()
)
_VERDICT_SQL = f"""checked as (select *, id % 17 = 0 as no_document,
  id % 5 = 0 and not (id % 3 in (0, 1) or (id % 17 <> 0 and id % 2 = 0)) as no_chunk from results where error_message is null),
 judged as (select *, case when no_document or no_chunk then ['FAIL_RETRIEVAL_INCOMPLETE'] else [] end as gates,
  list_filter([{_REASON_SQL.rstrip(",")}], lambda x: x is not null) as critical,
  list_filter([{_REVIEW_SQL.rstrip(",")}], lambda x: x is not null) as review from checked),
 verdicts as (select *, case when len(gates) + len(critical) > 0 then 'FAIL' when len(review) > 0 then 'REVIEW_REQUIRED' else 'PASS' end as verdict,
  array_to_string(list_concat(list_concat(gates, critical), review), ',') as reasons from judged)"""


def question_verdicts(spark: SparkSession, d: str) -> DataFrame:
    df = results(spark, d).filter("error_message is null")
    mode = "case id % 3 when 0 then 'grounded_from_synthesis' when 1 then 'grounded_from_manual_answer' else 'traced_from_synthesis' end"
    df = df.withColumns({"checks": F.expr(_CHECKED), "coverage_gaps": F.expr(_GAPS), "evidence_mode": F.expr(mode)})
    return verdicts.question_verdicts(df, FINANCE)


@query("question_verdict", f"with {_RESULTS_SQL}, {_VERDICT_SQL} select id, run_id, verdict, reasons as fail_reasons from verdicts")
def question_verdict(spark: SparkSession, d: str) -> DataFrame:
    return question_verdicts(spark, d).select("id", "run_id", "verdict", F.array_join("fail_reasons", ",").alias("fail_reasons"))


_RUN_VERDICT_SQL = """run_verdicts as (select run_id, count(case when verdict = 'PASS' then 1 end) as pass_count, count(case when verdict = 'FAIL' then 1 end) as fail_count,
 count(case when verdict = 'REVIEW_REQUIRED' then 1 end) as review_count, count(*) as total,
 case when count(case when verdict = 'FAIL' then 1 end) > 0 then 'FAIL' when count(case when verdict = 'REVIEW_REQUIRED' then 1 end) > 0 then 'REVIEW_REQUIRED' else 'PASS' end as overall_verdict,
 concat(count(case when verdict = 'PASS' then 1 end), '/', count(*), ' questions passed all criteria') as summary from verdicts group by run_id)"""


@query("run_verdict", f"with {_RESULTS_SQL}, {_VERDICT_SQL}, {_RUN_VERDICT_SQL} select * from run_verdicts")
def run_verdict(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.run_verdicts(question_verdicts(spark, d))


_RUN_EXPRESSIONS = [
    "concat('model ', cast(run_id as string)) as model_name",
    "case when run_id % 4 = 3 then null else concat('profile ', cast(run_id % 3 as string)) end as profile_id",
    "cast(run_id % 2 as string) as profile_version",
    "cast(floor(run_id / 3.0e0) as bigint) as question_set_id",
    "case when run_id % 5 = 4 then null else concat('judge ', cast(run_id % 2 as string)) end as judge_model_name",
    "case when run_id % 6 = 5 then null else concat('corpus ', cast(floor(run_id / 4.0e0) as bigint)) end as corpus_snapshot",
]
_RUNS_SQL = f"""{_RESULTS_SQL}, {_AGGREGATE_SQL}, {_VERDICT_SQL}, {_RUN_VERDICT_SQL},
 runs as (select a.*, v.overall_verdict, v.fail_count, v.review_count, {", ".join(_RUN_EXPRESSIONS).replace("run_id", "a.run_id")} from aggregates a join run_verdicts v on a.run_id = v.run_id)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Twelve runs with averages, verdicts and settings."""
    agg = verdicts.run_aggregates(results(spark, d))
    v = verdicts.run_verdicts(question_verdicts(spark, d)).select("run_id", "overall_verdict", "fail_count", "review_count")
    return agg.join(v, "run_id").selectExpr("*", *_RUN_EXPRESSIONS)


def pairs(spark: SparkSession) -> DataFrame:
    return spark.range(11).selectExpr("id as run_a", "id + 1 as run_b")


_METRICS_SQL = "metrics as (" + " union all ".join(
    f"""select a.run_id as run_a, b.run_id as run_b, '{m}' as metric, a.{c} as value_a, b.{c} as value_b,
 case when a.{c} is null or b.{c} is null then null when abs(a.{c} - b.{c}) < 0.05e0 then 'tie' when a.{c} {"<" if m in compare.LOWER_IS_BETTER else ">"} b.{c} then 'run_a' else 'run_b' end as winner
 from runs a join runs b on b.run_id = a.run_id + 1"""
    for m, c in ((m, m if m == "hallucination_rate" else f"avg_{m}") for m in compare.METRICS)
) + ")"


@query("metric_compare_pairs", f"with {_RUNS_SQL}, {_METRICS_SQL} select run_a, run_b, metric, round(value_a, 6) as value_a, round(value_b, 6) as value_b, winner from metrics")
def metric_compare_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = compare.compare_metrics(compare.paired(pairs(spark), runs(spark, d)))
    return out.select("run_a", "run_b", "metric", F.round("value_a", 6).alias("value_a"), F.round("value_b", 6).alias("value_b"), "winner")


_GATE_SQL = [(m.removesuffix("_score"), f, FINANCE.thresholds[m]) for m, f in compare.GATES.items()]
_PERCENT_SQL = "concat(cast(round_even({} * 100, 0) as bigint), '%')"
_FLAGS_SQL = ", ".join(
    f"case when {r}.{f} < {t}e0 then concat({r}.model_name, ': {label} (', {_PERCENT_SQL.format(f'{r}.{f}')}, ') below threshold (', {_PERCENT_SQL.format(f'{t}e0')}, ')') end"
    for label, f, t in _GATE_SQL
    for r in "ab"
)
_OUT_SQL = lambda r: "(" + " or ".join(f"coalesce({r}.{f} < {t}e0, false)" for _, f, t in _GATE_SQL) + ")"
_RANK_SQL = lambda r: f"case {r}.overall_verdict when 'PASS' then 0 when 'REVIEW_REQUIRED' then 1 else 2 end"
_DECISION_SQL = f"""leads as (select run_a, run_b, count(case when winner = 'run_a' then 1 end) as la, count(case when winner = 'run_b' then 1 end) as lb
  from metrics where metric in ({", ".join(f"'{m}'" for m in compare.PRIORITY)}) group by all),
 steps as (select l.*, a.model_name as na, b.model_name as nb, {_OUT_SQL("a")} as oa, {_OUT_SQL("b")} as ob, {_RANK_SQL("a")} as ra, {_RANK_SQL("b")} as rb,
  a.fail_count as fa, b.fail_count as fb, a.review_count as va, b.review_count as vb, list_filter([{_FLAGS_SQL}], lambda x: x is not null) as flags
  from leads l join runs a on a.run_id = l.run_a join runs b on b.run_id = l.run_b),
 reasons as (select *, case when oa and ob then 'BOTH_DISQUALIFIED' when oa or ob then 'OPPONENT_DISQUALIFIED' when ra <> rb then 'BETTER_VERDICT' when fa <> fb then 'FEWER_FAILURES'
  when va <> vb then 'FEWER_REVIEWS' when la <> lb then 'METRIC_ADVANTAGE' end as reason from steps),
 decisions as (select *, case reason when 'BOTH_DISQUALIFIED' then null when 'OPPONENT_DISQUALIFIED' then if(oa, 'run_b', 'run_a') when 'BETTER_VERDICT' then if(ra < rb, 'run_a', 'run_b')
  when 'FEWER_FAILURES' then if(fa < fb, 'run_a', 'run_b') when 'FEWER_REVIEWS' then if(va < vb, 'run_a', 'run_b') when 'METRIC_ADVANTAGE' then if(la > lb, 'run_a', 'run_b') else 'tie' end as winner,
  case reason when 'BOTH_DISQUALIFIED' then 'inconclusive' when 'OPPONENT_DISQUALIFIED' then 'decisive' when 'BETTER_VERDICT' then 'decisive'
  when 'FEWER_FAILURES' then if(abs(fa - fb) > 1, 'decisive', 'marginal') when 'FEWER_REVIEWS' then 'marginal' when 'METRIC_ADVANTAGE' then 'marginal' else 'inconclusive' end as decision_status,
  case when reason = 'BOTH_DISQUALIFIED' then list_append(flags, 'Both models fail critical quality gates') else flags end as risk from reasons),
 told as (select *, case winner when 'run_a' then na when 'run_b' then nb end as winner_name from decisions)"""
_SUMMARY_SQL = """case when winner = 'tie' then 'Both models perform comparably with no decisive advantage.' when reason = 'BOTH_DISQUALIFIED' then 'No winner: both models fail minimum quality thresholds.'
 when reason = 'OPPONENT_DISQUALIFIED' then concat(winner_name, ' wins because the other model fails critical quality gates.')
 else concat(winner_name, ' wins: ', case reason when 'BETTER_VERDICT' then 'has a better overall verdict' when 'FEWER_FAILURES' then 'has fewer critical failures' when 'FEWER_REVIEWS' then 'requires fewer manual reviews'
 else 'leads on more business-priority metrics' end, '.', case when len(risk) = 0 then '' when len(risk) = 1 then ' (1 risk flag noted)' else concat(' (', len(risk), ' risk flags noted)') end) end"""


@query(
    "compare_decision",
    f"""with {_RUNS_SQL}, {_METRICS_SQL}, {_DECISION_SQL} select run_a, run_b, winner, winner_name, decision_status, coalesce(reason, '') as reason_codes, {_SUMMARY_SQL} as summary,
 array_to_string(risk, ' | ') as risk_flags from told""",
)
def compare_decision(spark: SparkSession, d: str) -> DataFrame:
    out = compare.decide(compare.paired(pairs(spark), runs(spark, d)), FINANCE)
    return out.select("run_a", "run_b", "winner", "winner_name", "decision_status", F.array_join("reason_codes", ",").alias("reason_codes"), "summary", F.array_join("risk_flags", " | ").alias("risk_flags"))


_WARN_SQL = [
    ("a.profile_id is distinct from b.profile_id", "PROFILE_MISMATCH", "concat('Runs use different profiles: ', coalesce(a.profile_id, 'none'), ' vs ', coalesce(b.profile_id, 'none'))"),
    ("a.question_set_id <> b.question_set_id", "QUESTION_SET_MISMATCH", "'Runs use different question sets'"),
    ("a.profile_id = b.profile_id and a.profile_version <> b.profile_version", "PROFILE_VERSION_MISMATCH", "concat('Same profile but different versions: ', a.profile_version, ' vs ', b.profile_version)"),
    ("a.judge_model_name <> b.judge_model_name", "JUDGE_MODEL_MISMATCH", "concat('Runs used different judge models: ', a.judge_model_name, ' vs ', b.judge_model_name)"),
    ("a.judge_model_name is null or b.judge_model_name is null", "JUDGE_MODEL_UNKNOWN", "concat('Judge model not recorded for ', if(a.judge_model_name is null, 'run A', 'run B'), '; scoring conditions may differ')"),
    ("a.corpus_snapshot <> b.corpus_snapshot", "CORPUS_MISMATCH", "'Corpus changed between runs; retrieval results may not be comparable'"),
    ("a.corpus_snapshot is null or b.corpus_snapshot is null", "CORPUS_UNKNOWN", "concat('Corpus snapshot not recorded for ', if(a.corpus_snapshot is null, 'run A', 'run B'), '; cannot verify same corpus')"),
    ("a.profile_id is null and b.profile_id is null", "NO_PROFILE", "'Neither run has a profile; verdict and gate checks are skipped'"),
]


@query(
    "compare_warnings",
    f"with {_RUNS_SQL} " + " union all ".join(f"select a.run_id as run_a, b.run_id as run_b, '{code}' as code, {message} as message from runs a join runs b on b.run_id = a.run_id + 1 where {when}" for when, code, message in _WARN_SQL),
)
def compare_warnings(spark: SparkSession, d: str) -> DataFrame:
    return compare.warnings(compare.paired(pairs(spark), runs(spark, d)))


@query(
    "compare_questions",
    f"""with {_RESULTS_SQL}, sets as (select run_id, question, concat('set ', question) as expected_answer from results group by all),
 last as (select *, row_number() over (partition by run_id, question order by id desc) as n, min(id) over (partition by run_id, question) as pos from results),
 p as (select range as run_a, range + 1 as run_b from range(11)),
 a as (select run_a, run_b, question, id as id_a, nullif(expected_answer, '') as ea, pos as pa from p join last on run_id = run_a where n = 1),
 b as (select run_a, run_b, question, id as id_b, nullif(expected_answer, '') as eb, pos as pb from p join last on run_id = run_b where n = 1)
 select run_a, run_b, row_number() over (partition by run_a, run_b order by pa nulls last, pb) - 1 as position, question, coalesce(ea, eb, sa.expected_answer, sb.expected_answer) as expected_answer, id_a, id_b
 from a full join b using (run_a, run_b, question) left join sets sa on sa.run_id = run_a and sa.question = question left join sets sb on sb.run_id = run_b and sb.question = question""".replace("sa.question = question", "sa.question = coalesce(a.question, b.question)").replace("sb.question = question", "sb.question = coalesce(a.question, b.question)"),
)
def compare_questions(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    sets = r.select("run_id", "question", F.concat(F.lit("set "), "question").alias("expected_answer")).distinct()
    return compare.match_questions(pairs(spark), r, sets).withColumn("position", F.col("position").cast("bigint"))


@query(
    "expected_backfill",
    f"""with {_RESULTS_SQL}, items as (select question, min_by(expected_answer, id) as filled from results where expected_answer <> '' group by question)
 select id, coalesce(nullif(expected_answer, ''), filled) as expected_answer from results left join items using (question)""",
)
def expected_backfill(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return compare.backfill_expected(r, r.select("question", "expected_answer", F.col("id").alias("position"))).select("id", "expected_answer")


@query("run_status", "select event_id, case when event_id % 4 = 0 and event_id % 3 = 0 then 'running' when event_id % 4 = 1 and event_id % 3 = 1 then 'completed' when event_id % 4 in (0, 1) and event_id % 3 = 2 then 'cancelled' when event_id % 4 = 0 then 'pending' when event_id % 4 = 1 then 'running' when event_id % 4 = 2 then 'completed' else 'failed' end as status from events")
def run_status(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").withColumns({
        "old": F.element_at(F.array(*map(F.lit, ("pending", "running", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int")),
        "what": F.element_at(F.array(*map(F.lit, ("start", "finish", "cancel"))), (F.col("event_id") % 3 + 1).cast("int")),
    })
    return e.select("event_id", verdicts.run_status(F.col("old"), F.col("what")).alias("status"))


# --- chunks ----------------------------------------------------------------------------------------------

_WORDS_SQL = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"
_FIXED_SQL = """select {key}, s.seq::int as seq, case when n <= 400 then body else array_to_string(w[s.seq * 320 + 1 : s.seq * 320 + 400], ' ') end as text, least(400, n - s.seq * 320)::int as token_count
 from (select *, len(w) as n from (select *, {words} as w from {source})) t, lateral (select unnest(range(0, case when n <= 400 then least(n, 1) else ((n - 1) // 320 + 1) end)) as seq) s"""


@query("chunk_fixed", _FIXED_SQL.format(key="doc_id", words=_WORDS_SQL.format("body"), source="(select doc_id, text as body from documents)"))
def chunk_fixed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_fixed(_t(spark, d, "documents"))


_HEADING_SQL = """lines as (select doc_id, i, regexp_replace(line, '^\\s+|\\s+$', '', 'g') as t from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
 worded as (select *, list_filter(string_split_regex(t, '\\s+'), lambda x: x <> '') as w from lines where t <> ''),
 marked as (select *, length(t) >= 3 and (regexp_matches(t, '^\\d+(\\.\\d+)+\\.?\\s') or regexp_matches(t, '(?i)^(Article|Section|Part|Chapter|Item)\\s+[\\dIVXLCDM]+')
  or (len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) >= 2 and len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}') and x <> upper(x))) = 0)
  or (len(w) <= 12 and not ends_with(t, '.') and 2 * len(list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}'))) >= len(w))) as h from worded)"""


@query("heading_lines", f"with {_HEADING_SQL} select doc_id, count(*) as n_lines, count(case when h then 1 end) as n_headings from marked group by doc_id")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = _t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(T.strip(F.col("line")) != "")
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.is_heading(F.col("line"))).alias("n_headings"))


@query(
    "chunk_sections",
    f"""with {_HEADING_SQL}, numbered as (select *, sum(case when h then 1 else 0 end) over (partition by doc_id order by i) as section from marked),
 parts as (select doc_id, section::int as section, coalesce(max(case when h then t end), '') as heading, coalesce(string_agg(case when not h then t end, ' ' order by i), '') as body from numbered group by all),
 kinds as (select doc_id, max(section) > 0 as headed, bool_or(body <> '') as filled from parts group by doc_id),
 sectioned as (select * from ({_FIXED_SQL.format(key="doc_id, section, heading", words=_WORDS_SQL.format("body"), source="(select p.* from parts p join kinds k using (doc_id) where headed and body <> '')")})),
 plain as (select * from ({_FIXED_SQL.format(key="doc_id", words=_WORDS_SQL.format("body"), source="(select doc_id, text as body from documents left join kinds k using (doc_id) where not coalesce(headed and filled, false))")}))
 select doc_id, section, seq, heading as section_path, case when heading <> '' then concat(heading, chr(10), text) else text end as text, token_count from sectioned
 union all select doc_id, 0, seq, null, text, token_count from plain""",
)
def chunk_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_sections(_t(spark, d, "documents"))


@query(
    "embed_truncate",
    """select doc_id, concat('search_document: ', case when len(w) > 600 then array_to_string(w[1:600], ' ') else cut end) as input from
 (select *, list_filter(string_split_regex(cut, '\\s+'), lambda x: x <> '') as w from (select doc_id, substring(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 4000) as cut from documents))""",
)
def embed_truncate(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.embedding_input(F.col("text")).alias("input"))


def _selected(spark: SparkSession, d: str) -> DataFrame:
    """All documents of each source, in selections of five."""
    docs = _t(spark, d, "documents").select(F.col("source").alias("query_id"), F.concat("source", F.lit(".pdf")).alias("document"), "lang", "text", "doc_id")
    return retrieval.ranked(docs, F.col("doc_id")).select(
        F.concat_ws("-", "query_id", F.expr("cast(rank div 5 as string)")).alias("query_id"), (F.col("rank") % 5).alias("rank"), "document", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("page"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("").alias("section"), "text"
    )


_SELECTED_SQL = """placed as (select *, row_number() over (partition by source order by doc_id) - 1 as place from documents),
 selected as (select concat(source, '-', place // 5) as query_id, place % 5 as rank, concat(source, '.pdf') as document, case when doc_id % 2 = 0 then cast(doc_id as varchar) end as page,
 case when doc_id % 3 = 0 then lang else '' end as section, text from placed)"""


@query(
    "context_block",
    f"with {_SELECTED_SQL} select query_id, string_agg(concat('[Source ', rank + 1, ': ', document, case when page is not null then concat(', page ', page) else '' end, ']', chr(10), text), chr(10) || chr(10) order by rank) as context from selected group by query_id",
)
def context_block(spark: SparkSession, d: str) -> DataFrame:
    return chunking.context_blocks(_selected(spark, d))


@query("context_roundtrip", f"with {_SELECTED_SQL} select query_id, document, page, nullif(section, '') as section, regexp_replace(text, '^ +| +$', '', 'g') as text from selected")
def context_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    parsed = chunking.stored_contexts(_selected(spark, d)).select("query_id", F.explode(T.parse_stored_contexts(F.col("contexts"))).alias("c"))
    return parsed.select("query_id", "c.document", "c.page", "c.section", "c.text")


@query("preview", "select doc_id, case when length(text) > 200 then concat(text[1:200], '...') else text end as preview from documents")
def preview(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


# --- retrieval ---------------------------------------------------------------------------------------------


@query(
    "vector_topk",
    """with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 50 = 0), d as (select q.query_id, v.vec_id as chunk_id, 1 - list_cosine_similarity(q.e, v.embedding::double[]) as dist from q, embeddings v)
 select query_id, chunk_id, (row_number() over (partition by query_id order by dist, chunk_id) - 1)::int as rank, round(1 - dist, 4) as score from d qualify rank < 10""",
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.vector_search(v, v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id"), 10)


def _in_sql(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _mapped_sql(step: dict[str, str]) -> str:
    return "case e " + " ".join(f"when '{a}' then '{b}'" for a, b in step.items()) + " end"


def _ending_sql(of, name: str, source: str) -> str:
    """The longest of the endings of w as e, and what stands before it as p."""
    return f"{name}e as (select *, regexp_extract(w, '({'|'.join(of)})$') as e, w[: length(w) - length(regexp_extract(w, '({'|'.join(of)})$'))] as p from {source})"


_SHORT_SQL = "'(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$'"
#: Tokens (doc_id, place, word) of the documents, their stems as (word, stem), and the stems' places as posted (doc_id, stem, place).
_POSTED_SQL = f"""tokens as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as place from (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as ws from documents)),
 v as (select distinct word from tokens where word not in {_in_sql(fulltext.STOP_WORDS)}),
 whole as (select * from (values {", ".join(f"('{a}', '{b}')" for a, b in stem.WHOLE.items())}) t(word, stem)),
 s0 as (select word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') as w from v where length(word) > 2 and word not in (select word from whole)),
 s1 as (select *, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen|[^aeiouy]*[aeiouy]+[^aeiouy])')), 0), length(w)) as r1 from s0),
 s2 as (select *, r1 + coalesce(nullif(length(regexp_extract(w[r1 + 1 :], '^[^aeiouy]*[aeiouy]+[^aeiouy]')), 0), length(w) - r1) as r2 from s1),
 {_ending_sql(["sses", "ied", "ies", "us", "ss", "s"], "s2", "s2")},
 s3 as (select word, r1, r2, case when e = 'sses' then w[: length(w) - 2] when e in ('ied', 'ies') then w[: length(w) - case when length(w) > 4 then 2 else 1 end]
  when e = 's' and regexp_matches(w[: length(w) - 2], '[aeiouy]') then p else w end as w from s2e),
 ready as (select word, w as stem from s3 where w in {_in_sql(sorted(stem.WHOLE_AFTER_PLURAL))}),
 {_ending_sql(["eed", "eedly", "ed", "edly", "ing", "ingly"], "s3", "(select * from s3 where word not in (select word from ready))")},
 s4 as (select word, r1, r2, case when e = '' then w when e[:2] = 'ee' then case when length(p) >= r1 then concat(p, 'ee') else w end when not regexp_matches(p, '[aeiouy]') then w
  when regexp_matches(p, '(at|bl|iz)$') then concat(p, 'e') when regexp_matches(p, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then p[: length(p) - 1]
  when length(p) <= r1 and regexp_matches(p, {_SHORT_SQL}) then concat(p, 'e') else p end as w from s3e),
 s5 as (select word, r1, r2, regexp_replace(w, '(.[^aeiouy])[yY]$', '\\1i') as w from s4),
 {_ending_sql(stem.SECOND, "s5", "s5")},
 s6 as (select word, r1, r2, case when e <> '' and length(p) >= r1 and (e <> 'ogi' or suffix(p, 'l')) and (e <> 'li' or regexp_matches(p, '[cdeghkmnrt]$')) then concat(p, {_mapped_sql(stem.SECOND)}) else w end as w from s5e),
 {_ending_sql(stem.THIRD, "s6", "s6")},
 s7 as (select word, r1, r2, case when e <> '' and length(p) >= r1 and (e <> 'ative' or length(p) >= r2) then concat(p, {_mapped_sql(stem.THIRD)}) else w end as w from s6e),
 {_ending_sql(stem.FOURTH, "s7", "s7")},
 s8 as (select word, r1, r2, case when e <> '' and length(p) >= r2 and (e <> 'ion' or regexp_matches(p, '[st]$')) then p else w end as w from s7e),
 {_ending_sql(["e", "ll"], "s8", "s8")},
 s9 as (select word, case when e <> '' and length(w) - 1 >= r2 or e = 'e' and length(p) >= r1 and not regexp_matches(p, {_SHORT_SQL}) then w[: length(w) - 1] else w end as w from s8e),
 stems as (select word, replace(w, 'Y', 'y') as stem from s9 union all select * from ready union all select * from whole where word in (select word from v) union all select word, word from v where length(word) <= 2),
 posted as (select doc_id, stem, place from tokens join stems using (word))"""

_RANKED_SQL = f"""hits as (select query_id, doc_id as chunk_id, stem, list(place order by place) as ats from asked join posted using (stem) group by all),
 sizes as (select query_id, count(*) as wanted from asked group by query_id),
 held as (select query_id, chunk_id, count(*) as n from hits join sizes using (query_id) group by query_id, chunk_id, wanted having count(*) = wanted),
 placed as (select query_id, chunk_id, n, stem, unnest(ats) as place, unnest(range(1, len(ats) + 1)) as i from hits join held using (query_id, chunk_id)),
 alone as (select query_id, chunk_id, sum({fulltext.WEIGHT}e0 / (i * i)) / {fulltext.SQUARES}e0 as score from placed where n = 1 group by all),
 pairs as (select query_id, chunk_id, sum(ln(1 - {fulltext.WEIGHT}e0 * sqrt(1 / (1.005e0 + 0.05e0 * exp(abs(a.place - b.place) / 1.5e0 - 2))))) as s from placed a join placed b using (query_id, chunk_id) where a.stem < b.stem and abs(a.place - b.place) <= {fulltext.FAR} group by all),
 scored as (select query_id, chunk_id, round(coalesce(score, 1 - exp(s), 0), 6) as score from held left join alone using (query_id, chunk_id) left join pairs using (query_id, chunk_id))
 select query_id, chunk_id, (row_number() over (partition by query_id order by score desc, chunk_id) - 1)::int as rank, round(score, 4) as score from scored qualify rank < 20"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The text of every document whose id is divisible by 50 as a keyword query."""
    return _t(spark, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")


def _searched(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


@query("keyword_topk", f"with {_POSTED_SQL}, asked as (select distinct doc_id as query_id, stem from posted where doc_id % 50 = 0), {_RANKED_SQL}")
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as queries: what they find holds every one of their terms."""
    return retrieval.keyword_search(_searched(spark, d), _asked(spark, d), 20)


@query("keyword_ranked", f"with {_POSTED_SQL}, asked as (select distinct doc_id as query_id, stem from posted where doc_id % 50 = 0 and place between 3 and 5), {_RANKED_SQL}")
def keyword_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Three words of a text, some of which are stop words or the same: many texts hold them, at many places."""
    words = F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), 0), 3, 3), " ")
    return retrieval.keyword_search(_searched(spark, d), _asked(spark, d).withColumn("text", words), 20)


@query("stemmed_vocabulary", f"with {_POSTED_SQL} select doc_id, count(distinct stem) as n_terms, count(*) as n_places, max(stem) as last_term from posted group by doc_id")
def stemmed_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Distinct stems and places of each document, stop words left out; texts without any are absent."""
    held = fulltext.term_places(_t(spark, d, "documents"), "doc_id")
    n = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + F.size(p))
    return held.select("doc_id", F.size("terms").cast("long").alias("n_terms"), n.alias("n_places"), F.array_max("terms").alias("last_term"))


def _list(spark: SparkSession, d: str, a: int, m: int, k: int = 20) -> DataFrame:
    """A ranked list of documents for each of ten queries, by an arithmetic score."""
    docs = _t(spark, d, "documents").select((F.col("doc_id") % 10).alias("query_id"), F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), "text", (F.col("doc_id") * a % m / float(m)).alias("score"))
    return retrieval.ranked(docs, F.col("score").desc(), F.col("chunk_id")).filter(F.col("rank") < k)


_LIST_SQL = "select doc_id % 10 as query_id, doc_id as chunk_id, source as document, (doc_id * {a} % {m}) / {m}.0e0 as score, (row_number() over (partition by doc_id % 10 order by (doc_id * {a} % {m}) desc, doc_id) - 1)::int as rank from documents qualify rank < {k}"


@query(
    "rrf_hybrid",
    f"""with l as (select 0 as list, * from ({_LIST_SQL.format(a=7, m=1009, k=20)}) union all select 1, * from ({_LIST_SQL.format(a=11, m=1013, k=20)})),
 f as (select query_id, chunk_id, sum(1.0e0 / (61 + rank)) as s, min(list * 1000 + rank) as first from l group by all)
 select query_id, chunk_id, (row_number() over (partition by query_id order by round(s, 12) desc, first, chunk_id) - 1)::int as rank, round(s, 4) as score from f""",
)
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rank_fusion([_list(spark, d, 7, 1009), _list(spark, d, 11, 1013)])


@query(
    "doc_cap",
    f"""with l as ({_LIST_SQL.format(a=7, m=1009, k=40)}), n as (select *, row_number() over (partition by query_id, document order by rank) > 2 as late from l)
 select query_id, chunk_id, document, (row_number() over (partition by query_id order by late, rank) - 1)::int as rank from n""",
)
def doc_cap(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.cap_per_document(_list(spark, d, 7, 1009, 40), 2).select("query_id", "chunk_id", "document", "rank")


@query(
    "diversity_select",
    f"""with l as ({_LIST_SQL.format(a=7, m=1009, k=40)}),
 f as (select *, count(*) over (partition by query_id) as n, row_number() over (partition by query_id, document order by rank) = 1 and max(score) over (partition by query_id, document) >= 0.97e0 as first from l),
 g as (select *, first and n > 8 and row_number() over (partition by query_id, first order by rank) <= 2 as sure from f)
 select query_id, chunk_id, document, score, (row_number() over (partition by query_id order by (not sure), rank) - 1)::int as rank from g qualify rank < 8""",
)
def diversity_select(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.select_diverse(_list(spark, d, 7, 1009, 40), 8, 2, 0.97).select("query_id", "chunk_id", "document", "score", "rank")


@query("dedup_near")
def dedup_near(spark: SparkSession, d: str) -> DataFrame:
    """All documents, dealt by source and id into candidate lists of the search depth's cap at most."""
    docs = _t(spark, d, "documents").select(F.concat_ws("-", "source", F.expr("doc_id div 10000")).alias("query_id"), F.col("doc_id").alias("chunk_id"), "text")
    n = retrieval.ranked(docs, F.col("chunk_id"))
    part = F.floor(F.col("rank") / retrieval.POOL_CAP)
    lists = n.select(F.concat_ws("-", "query_id", part).alias("query_id"), "chunk_id", (F.col("rank") % retrieval.POOL_CAP).alias("rank"), "text")
    return retrieval.drop_near_duplicates(lists).select("query_id", "chunk_id", "rank")


def _lists(spark: SparkSession, d: str) -> DataFrame:
    parts = [_list(spark, d, a, m).withColumn("sub_query", F.lit(i)) for i, (a, m) in enumerate([(7, 1009), (11, 1013), (13, 1019)])]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LISTS_SQL = "lists as (" + " union all ".join(f"select *, {i} as sub_query from ({_LIST_SQL.format(a=a, m=m, k=20)})" for i, (a, m) in enumerate([(7, 1009), (11, 1013), (13, 1019)])) + ")"


@query(
    "multi_query_merge",
    f"""with {_LISTS_SQL}, b as (select *, row_number() over (partition by query_id, chunk_id order by score desc, sub_query, rank) as n, min(sub_query * 1000 + rank) over (partition by query_id, chunk_id) as seen from lists)
 select query_id, chunk_id, score, sub_query, (row_number() over (partition by query_id order by score desc, seen, chunk_id) - 1)::int as rank from b where n = 1""",
)
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.merge_sub_queries(_lists(spark, d)).select("query_id", "chunk_id", "score", "sub_query", "rank")


@query(
    "debug_rollup",
    f"""with {_LISTS_SQL}, b as (select *, row_number() over (partition by query_id, chunk_id order by sub_query, rank) as n from lists),
 r as (select query_id, document, count(*) as n_chunks, max(score) as best_score, max(score) >= 0.9e0 as qualifies from b where n = 1 group by all)
 select *, (row_number() over (partition by query_id order by best_score desc, document) - 1)::int as rank from r""",
)
def debug_rollup(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.document_rollup(retrieval.debug_merge(_lists(spark, d)), 0.9)


@query("subquery_swap")
def subquery_swap(spark: SparkSession, d: str) -> DataFrame:
    merged = retrieval.merge_sub_queries(_lists(spark, d))
    return retrieval.represent_sub_queries(retrieval.select_diverse(merged, 5, 3, 0.9), merged, 5, 0.8)


@query("retrieve_pipeline")
def retrieve_pipeline(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("label "), F.col("label").cast("string")).alias("document"), "embedding")
    # every search reads the texts; they meet their vectors once, and in a merge join, which deals the rows that stay evenly
    chunks = settled(v.join(_t(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text").hint("merge"), "chunk_id"))
    asked = _asked(spark, d).join(v.select(F.col("chunk_id").alias("query_id"), "embedding"), "query_id", "left")
    return retrieval.retrieve(chunks, asked, FINANCE.retrieval, 10).select("query_id", "chunk_id", "document", "rank", "score")


@query("low_confidence", f"with l as ({_LIST_SQL.format(a=7, m=1009, k=20)}) select query_id, max(score * (query_id % 3) / 2.0e0) < 0.5e0 as low_confidence from l group by query_id")
def low_confidence(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.low_confidence(_list(spark, d, 7, 1009).withColumn("score", F.col("score") * (F.col("query_id") % 3) / 2.0))


@query("search_depth", "select source, least(400, greatest(45, count(*) * 45)) as depth, 20 as plain from documents group by source")
def search_depth(spark: SparkSession, d: str) -> DataFrame:
    n = _t(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.select("source", retrieval.search_depth(F.col("n"), 45, 3).alias("depth"), retrieval.search_depth(F.col("n"), 20, 1).alias("plain"))


_DOCS_SQL = "docs as (select doc_id as document_id, concat(source, '.pdf') as filename, n_chars as chunk_count, case when doc_id % 7 = 0 then 'error' else 'ready' end as status, case when doc_id % 11 = 0 then 'x' end as deleted_at, doc_id * 37 % 1009 as created_at from documents)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").selectExpr(
        "doc_id as document_id", "concat(source, '.pdf') as filename", "n_chars as chunk_count", "case when doc_id % 7 = 0 then 'error' else 'ready' end as status",
        "case when doc_id % 11 = 0 then 'x' end as deleted_at", "doc_id * 37 % 1009 as created_at", "text",
    )


@query(
    "corpus_snapshot",
    f"with {_DOCS_SQL} select string_agg(concat(document_id, ':', filename, ':', chunk_count), ',' order by document_id) as documents, count(*) as total_documents, sum(chunk_count)::bigint as total_chunks from docs where status = 'ready' and deleted_at is null",
)
def corpus_snapshot(spark: SparkSession, d: str) -> DataFrame:
    s = retrieval.corpus_snapshot(_docs(spark, d))
    return s.withColumn("documents", F.array_join(F.transform("documents", lambda x: F.concat_ws(":", x["document_id"].cast("string"), x["filename"], x["chunk_count"].cast("string"))), ","))


@query("recent_fallback", f"with {_DOCS_SQL} select document_id as chunk_id, (row_number() over (order by created_at desc, document_id desc) - 1)::int as rank, 0.0e0 as score from docs where deleted_at is null qualify rank < 5")
def recent_fallback(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.recent_chunks(_docs(spark, d).withColumnRenamed("document_id", "chunk_id"), 5).select("chunk_id", "rank", "score")


@query("listing", f"with {_DOCS_SQL} select document_id, filename, created_at from docs where deleted_at is null")
def listing(spark: SparkSession, d: str) -> DataFrame:
    return reports.newest_first(_docs(spark, d), "document_id").select("document_id", "filename", "created_at")


# --- overlap, checks, model outputs ----------------------------------------------------------------------------


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Turns with phrases of abstention, survey questions and file names worked in."""
    return _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.expr(_SPOKEN), "text").alias("text"))


_SPOKEN = """case (conv_id + turn) % 6 when 0 then 'I cannot answer. ' when 1 then 'Give an overview of the key and main points, please: ' when 2 then 'See report_1.pdf and Src3.PDF, src3.pdf. '
 when 3 then 'Not enough context; the framework differences vary ' when 4 then 'As notes.docx and a-b.xlsx say, ' else '' end"""
_SPOKEN_SQL = f"spoken as (select conv_id, turn, concat({_SPOKEN}, text) as text from conversations)"
_ANY_SQL = lambda phrases: "(" + " or ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


@query("abstention_check", f"with {_SPOKEN_SQL} select conv_id, turn, {_ANY_SQL(T.ABSTENTION)} as abstains from spoken")
def abstention_check(spark: SparkSession, d: str) -> DataFrame:
    return _spoken(spark, d).select("conv_id", "turn", T.abstains(F.col("text")).alias("abstains"))


@query(
    "decompose_gate",
    f"""with {_SPOKEN_SQL} select conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) >= 8 and ({_ANY_SQL(T.SURVEY_PHRASES)} or
 {" + ".join(f"contains(lower(text), '{w}')::int" for w in T.BROAD_WORDS)} >= 2) as broad from spoken""",
)
def decompose_gate(spark: SparkSession, d: str) -> DataFrame:
    return _spoken(spark, d).select("conv_id", "turn", T.is_broad(F.col("text")).alias("broad"))


_FILES_SQL = "list_sort(list_distinct(regexp_extract_all(text, '(?i)\\b([\\w\\-]+\\.(?:pdf|docx?|txt|csv|xlsx?))\\b', 1)))"


@query(
    "source_reference",
    f"""with {_SPOKEN_SQL}, f as (select *, {_FILES_SQL} as files from spoken), u as (select *, list_filter(files, lambda x: x not in ('src3.pdf', 'notes.docx', 'a-b.xlsx')) as odd from f)
 select conv_id, turn, len(odd) = 0 as passed, case when len(files) = 0 then 'No document references found in answer' when len(odd) > 0 then concat('Answer references documents not in context: [''', array_to_string(odd, ''', '''), ''']')
 else concat('All ', len(files), ' document references are supported by context') end as detail from u""",
)
def source_reference(spark: SparkSession, d: str) -> DataFrame:
    held = F.array(*map(F.lit, ("src3.pdf", "notes.docx", "a-b.xlsx")))
    return _spoken(spark, d).withColumn("c", checks.source_reference(F.col("text"), held)).select("conv_id", "turn", "c.passed", "c.detail")


@query(
    "document_presence",
    """with r as (select doc_id, list_filter(['src1', 'src2', 'src3'], lambda x: (doc_id + length(x) + ascii(x[4])) % 3 <> 0) as req, case when doc_id % 4 = 0 then ['src4'] when doc_id % 4 = 1 then ['src5', 'src6'] else [] end as sup, ['src1', 'src2', 'src5', 'src4'][1 : (doc_id % 5)::int] as got from documents),
 m as (select *, list_filter(req, lambda x: not list_contains(got, x)) as mr, list_filter(sup, lambda x: not list_contains(got, x)) as ms from r)
 select doc_id, len(mr) = 0 as passed, case when len(req) = 0 and len(sup) = 0 then 'No required documents specified'
 when len(mr) = 0 then concat('All ', len(req), ' required documents present', case when len(ms) > 0 then concat('. Missing ', len(ms), ' supporting documents: [''', array_to_string(ms, ''', '''), ''']') when len(sup) > 0 then concat('. all ', len(sup), ' supporting documents also present') else '' end)
 else concat('Missing ', len(mr), '/', len(req), ' required documents: [''', array_to_string(mr, ''', '''), ''']', case when len(ms) > 0 then concat('. Also missing ', len(ms), ' supporting documents: [''', array_to_string(ms, ''', '''), ''']') else '' end) end as detail from m""",
)
def document_presence(spark: SparkSession, d: str) -> DataFrame:
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    i = F.col("doc_id")
    req = F.filter(arr("src1", "src2", "src3"), lambda x: (i + F.length(x) + F.ascii(F.substring(x, 4, 1))) % 3 != 0)
    sup = F.when(i % 4 == 0, arr("src4")).when(i % 4 == 1, arr("src5", "src6")).otherwise(arr())
    got = F.slice(arr("src1", "src2", "src5", "src4"), F.lit(1), (i % 5).cast("int"))
    df = _t(spark, d, "documents").select("doc_id", req.alias("req"), sup.alias("sup"), got.alias("got"))
    return df.withColumn("c", checks.document_presence(F.col("req"), F.col("sup"), F.col("got"))).select("doc_id", "c.passed", "c.detail")


def _with_chunks(spark: SparkSession, d: str) -> DataFrame:
    """All documents in lists of ten as retrieved chunks, each with a benchmark item and some references."""
    docs = _t(spark, d, "documents")
    c = F.struct(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("page"), "text")
    per = docs.groupBy(F.expr("doc_id div 10").alias("list_id")).agg(F.array_sort(F.collect_list(c)).cast(alignment.CHUNKS).alias("chunks")).withColumn("item_id", F.col("list_id") % 40)
    refs = F.expr("array(concat('chunk:', cast(item_id as string)), concat('chunk:', cast(item_id * 3 as string)), concat('src', cast(item_id % 25 as string), ':', cast(item_id as string)), concat('src', cast(item_id % 25 as string)), 'chunk:x')")
    return _t(spark, d, "benchmark").join(per, "item_id").withColumn("refs", F.when(F.col("item_id") % 5 == 0, F.array(F.lit("chunk:-1"))).when(F.col("item_id") % 7 == 0, F.array().cast("array<string>")).otherwise(refs))


_GRAMS_SQL = "list_transform(range(1, len({w}) - 2), lambda i: array_to_string({w}[i : i + 3], ' '))"
_CHUNKS_SQL = f"""w as (select item_id, text, {_WORDS_SQL.format("lower(text)")} as iw from benchmark), dw as (select doc_id, doc_id // 10 as list_id, doc_id // 10 % 40 as item_id, source, case when doc_id % 2 = 0 then cast(doc_id as varchar) end as page, {_WORDS_SQL.format("lower(text)")} as w from documents),
 hit as (select list_id, bool_or(len(list_filter({_GRAMS_SQL.format(w="w")}, lambda g: list_contains({_GRAMS_SQL.format(w="iw")}, g))) >= 3) as found from w join dw using (item_id) group by list_id),
 got as (select list_id, any_value(item_id) as item_id, list(doc_id) as ids, list(source || ':' || page) as pages, list(source) as sources from dw group by list_id),
 r as (select list_id, b.item_id, ids, pages, sources, found, case when b.item_id % 5 = 0 then ['chunk:-1'] when b.item_id % 7 = 0 then [] else ['chunk:' || b.item_id, 'chunk:' || (b.item_id * 3), 'src' || (b.item_id % 25) || ':' || b.item_id, 'src' || (b.item_id % 25), 'chunk:x'] end as refs
  from benchmark b join got using (item_id) join hit using (list_id)),
 n as (select *, len(list_filter(refs, lambda x: starts_with(x, 'chunk:') and list_contains(ids, try_cast(x[7:] as bigint)))) as by_id,
  len(list_filter(refs, lambda x: not starts_with(x, 'chunk:') and case when contains(x, ':') then list_contains(pages, x) else list_contains(sources, x) end)) as by_name from r)"""


@query("chunk_alignment", f"with {_CHUNKS_SQL} select list_id, case when len(refs) = 0 then 1.0e0 when by_id + by_name > 0 then (by_id + by_name)::double / len(refs) else found::int::double / len(refs) end as recall from n")
def chunk_alignment(spark: SparkSession, d: str) -> DataFrame:
    return _with_chunks(spark, d).select("list_id", alignment.alignment_recall(F.col("chunks"), F.col("refs"), F.array("text")).alias("recall"))


@query(
    "chunk_recall_check",
    f"""with {_CHUNKS_SQL}, k as (select *, case when by_id > 0 then by_id else found::int end as hits from n) select list_id, case when len(refs) = 0 then true else hits::double / len(refs) >= 0.5e0 end as passed,
 case when len(refs) = 0 then 'No expected chunk references specified' else concat('Chunk recall: ', hits, '/', len(refs), ' (', cast(round_even(hits::double / len(refs) * 100, 0) as bigint), '%)') end as detail from k""",
)
def chunk_recall_check(spark: SparkSession, d: str) -> DataFrame:
    none = F.array().cast("array<string>")
    df = _with_chunks(spark, d).withColumn("c", checks.chunk_alignment(F.col("refs"), F.array("text"), none, F.col("chunks")))
    return df.select("list_id", "c.passed", "c.detail")


@query(
    "ngram_overlap",
    f"""with g as (select distinct item_id, unnest({_GRAMS_SQL.format(w="w")}) as g from (select item_id, {_WORDS_SQL.format("lower(text)")} as w from benchmark)),
 p as (select doc_id, unnest({_GRAMS_SQL.format(w="w")}) as g from (select doc_id, {_WORDS_SQL.format("lower(text)")} as w from documents)) select item_id, doc_id, count(*) as hits from p join g using (g) group by all having count(*) >= 3""",
)
def ngram_overlap(spark: SparkSession, d: str) -> DataFrame:
    return alignment.overlapping_texts(_t(spark, d, "benchmark"), _t(spark, d, "documents"))


@query(
    "answer_alignment",
    f"""with a as (select conv_id as question_id, text from conversations where turn = 1), c as (select conv_id as question_id, turn as chunk_id, text from conversations where turn <> 1 and conv_id in (select question_id from a)),
 g as (select distinct question_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) as g from (select question_id, {_WORDS_SQL.format("lower(text)")} as w from a)),
 p as (select distinct question_id, chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) as g from (select question_id, chunk_id, {_WORDS_SQL.format("lower(text)")} as w from c)),
 s as (select distinct question_id, chunk_id from p join g using (question_id, g)) select * from s union all select question_id, chunk_id from c where question_id not in (select question_id from s)""",
)
def answer_alignment(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").withColumnRenamed("conv_id", "question_id")
    answers = c.filter("turn = 1").select("question_id", F.col("text").alias("answer"))
    chunks = c.filter("turn <> 1").select("question_id", F.col("turn").alias("chunk_id"), "text").join(answers.select("question_id"), "question_id", "left_semi")
    return alignment.answer_alignment(answers, chunks)


@query(
    "coverage_gaps",
    f"""with c as (select item_id, list_filter(string_split_regex(text, '[.,]\\s*'), lambda x: x <> '') as concepts from benchmark), d as (select doc_id // 10 as list_id, doc_id // 10 % 40 as item_id, string_agg(text, ' ' order by doc_id) as body from documents group by all),
 t as (select list_id, concepts, list_distinct(list_transform(list_filter(string_split_regex(lower(body), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[.,;:!?''")\\]}}]+$', ''))) as tokens from c join d using (item_id)),
 m as (select *, list_filter(concepts, lambda x, i: i % 2 = 0) as missing, list_filter(concepts, lambda x, i: i % 2 = 1) as covered from t),
 f as (select *, list_filter(missing, lambda c: len(list_filter(string_split_regex(c, '\\s+'), lambda x: length(x) >= 3)) > 0 and
   len(list_filter(list_distinct(list_transform(list_filter(string_split_regex(c, '\\s+'), lambda x: length(x) >= 3), lambda x: lower(x))), lambda x: list_contains(tokens, x)))::double / len(list_distinct(list_transform(list_filter(string_split_regex(c, '\\s+'), lambda x: length(x) >= 3), lambda x: lower(x)))) >= 0.4e0) as gen from m)
 select list_id, array_to_string(covered, '|') as covered, array_to_string(missing, '|') as missing, round(len(covered)::double / len(concepts), 6) as coverage_ratio,
 case when len(missing) > 0 then array_to_string(gen, '|') end as generation_failures, case when len(missing) > 0 then array_to_string(list_filter(missing, lambda x: not list_contains(gen, x)), '|') end as retrieval_failures from f""",
)
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    body = _t(spark, d, "documents").groupBy(F.expr("doc_id div 10").alias("list_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]).alias("contexts")).withColumn("item_id", F.col("list_id") % 40)
    concepts = F.filter(F.split("text", r"[.,]\s*"), lambda x: x != "")
    df = _t(spark, d, "benchmark").join(body, "item_id").withColumn("concepts", concepts)
    df = df.withColumn("statuses", F.transform("concepts", lambda c, i: F.when(i % 2 == 0, "covered").otherwise("missing")))
    df = df.withColumn("g", judge.coverage_gaps(F.col("concepts"), F.col("statuses"), F.col("contexts")))
    return df.select("list_id", *[F.array_join(f"g.{c}", "|").alias(c) for c in ("covered", "missing", "generation_failures", "retrieval_failures")], F.round("g.coverage_ratio", 6).alias("coverage_ratio"))


_RAW = """case event_id % 7 when 0 then concat('{"faithfulness": ', cast(value as string), ', "relevancy": "0.5"}') when 1 then '```json\\n{"faithfulness": 0.25, "relevancy": null}\\n```'
 when 2 then 'scores: "faithfulness": 0.75, and "relevancy": 1.5 or so' when 3 then '{"faithfulness": true, "relevancy": false}' when 4 then 'no numbers' when 5 then '{"faithfulness": [1], "relevancy": -2}' else '"Relevancy": 0.125 "faithfulness": null' end"""


@query(
    "judge_parse",
    """select event_id, case event_id % 7 when 0 then least(1.0e0, value) when 1 then 0.25e0 when 2 then 0.75e0 when 3 then 1.0e0 end as faithfulness,
 case event_id % 7 when 0 then 0.5e0 when 2 then 1.0e0 when 3 then 0.0e0 when 5 then 0.0e0 when 6 then 0.125e0 end as relevancy from events""",
)
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = _t(spark, d, "events").select("event_id", F.expr(_RAW).alias("raw"))
    return raw.select("event_id", *[c.alias(k) for k, c in judge.parse_scores(F.col("raw"), ["faithfulness", "relevancy"]).items()])


@query(
    "concept_status_parse",
    """select event_id, case event_id % 4 when 0 then 'covered,missing,missing' when 1 then 'missing,covered,missing' when 2 then 'covered,covered,covered' end as statuses from events""",
)
def concept_status_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = """case event_id % 4 when 0 then '{"concept_coverage": ["Covered ", "other"]}' when 1 then 'text "concept_coverage": ["missing", "COVERED"' || ']' when 2 then '{"concept_coverage": ["covered","covered","covered","missing"]}' else '{"x": 1}' end"""
    return _t(spark, d, "events").select("event_id", F.array_join(judge.concept_statuses(F.expr(raw), F.lit(3)), ",").alias("statuses"))


@query("guard_parse", "select doc_id, case when toxic = 1 then false else true end as is_safe, case when toxic = 1 and quality = 1 then 's1' end as category from labels")
def guard_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = "case when toxic = 1 and quality = 1 then ' unsafe\\nS1 ' when toxic = 1 then 'Unsafe' when quality = 0 then null else ' Safe' end"
    return _t(spark, d, "labels").withColumn("g", judge.guard(F.expr(raw))).select("doc_id", "g.is_safe", "g.category")


@query("reasoning_strip")
def reasoning_strip(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.expr("case conv_id % 4 when 0 then concat('<think>plan</think> ', text) when 1 then concat('plan </think>', text) when 2 then concat('Okay, let me think about it.\\n\\nIn summary\\n\\n', text) else concat(text, '\\n\\nLet me check this') end")
    return _t(spark, d, "conversations").select("conv_id", "turn", T.strip_reasoning(wrapped).alias("answer"))


@query("sub_query_parse", "select event_id, case event_id % 4 when 0 then 'a|b' when 1 then 'a|b' when 2 then 'a b|c' end as parsed from events")
def sub_query_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = """case event_id % 4 when 0 then '["a", "b", " "]' when 1 then '["a",\\n "b",]' when 2 then 'first "a b" then "c"' else 'none' end"""
    return _t(spark, d, "events").select("event_id", F.array_join(judge.sub_queries(F.expr(raw)), "|").alias("parsed"))


@query("synthesis_parse", "select event_id, case event_id % 3 when 0 then 'q=a' when 1 then 'q=a|r=b' end as parsed from events")
def synthesis_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = """case event_id % 3 when 0 then '{"questions": [{"question": "q", "expected_answer": "a"},]}' when 1 then 'so "question": "q", "expected_answer": "a" and "question": "r", "expected_answer": "b"' else 'none' end"""
    pairs_ = judge.question_pairs(F.expr(raw))
    return _t(spark, d, "events").select("event_id", F.array_join(F.transform(pairs_, lambda p: F.concat_ws("=", p["question"], p["expected_answer"])), "|").alias("parsed"))


@query("retry_payload", "select event_id, case when event_id % 4 <= 0 then event_id % 23 else least(event_id % 23, greatest(4, event_id % 23 - greatest(1, (event_id % 23) // 4) * (event_id % 4))) end::int as chunks, case event_id % 4 when 0 then 2048 when 1 then 1024 else 512 end::int as max_tokens from events")
def retry_payload(spark: SparkSession, d: str) -> DataFrame:
    p = judge.retry_payload((F.col("event_id") % 23).cast("int"), (F.col("event_id") % 4).cast("int"), F.lit(2048))
    return _t(spark, d, "events").withColumn("p", p).select("event_id", "p.chunks", "p.max_tokens")


# --- truth, question sets ----------------------------------------------------------------------------------------


def _question_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, 7, 1009, 12).select(F.col("query_id").alias("question_id"), "chunk_id", F.concat("document", F.lit(".pdf")).alias("document"), "text", "rank")


_QC_SQL = f"qc as (select query_id as question_id, chunk_id, document || '.pdf' as document, rank from ({_LIST_SQL.format(a=7, m=1009, k=12)}))"
_CLASS_SQL = """per as (select question_id, document, count(*) as n, min(rank) as first from qc group by all), placed as (select *, row_number() over (partition by question_id order by n desc, first) as place from per)"""


@query("doc_classify_fallback", f"with {_QC_SQL}, {_CLASS_SQL} select question_id, max(case when place = 1 then document end) as required, coalesce(string_agg(case when place > 1 then document end, ',' order by document), '') as supporting from placed group by question_id")
def doc_classify_fallback(spark: SparkSession, d: str) -> DataFrame:
    return truth.fallback_classes(_question_chunks(spark, d)).select("question_id", F.array_join("required", ",").alias("required"), F.array_join("supporting", ",").alias("supporting"))


@query(
    "retrieval_truth",
    f"""with {_QC_SQL}, {_CLASS_SQL}, r as (select q.*, p.place = 1 as need from qc q join placed p using (question_id, document)) select question_id, max(case when need then document end) as required_documents,
 coalesce(string_agg(case when need then 'chunk:' || chunk_id end, ',' order by rank), '') as expected_chunk_refs, coalesce(string_agg(case when not need then 'chunk:' || chunk_id end, ',' order by rank), '') as supporting_chunk_refs, 'traced_from_synthesis' as evidence_mode from r group by question_id""",
)
def retrieval_truth(spark: SparkSession, d: str) -> DataFrame:
    qc = _question_chunks(spark, d)
    out = truth.retrieval_truth(qc, truth.fallback_classes(qc))
    return out.select("question_id", *[F.array_join(c, ",").alias(c) for c in ("required_documents", "expected_chunk_refs", "supporting_chunk_refs")], "evidence_mode")


@query("balanced_sample")
def balanced_sample(spark: SparkSession, d: str) -> DataFrame:
    chunks = _t(spark, d, "documents").select((F.pmod(F.col("doc_id") * 7, F.lit(13)) % 7).alias("document_id"), F.col("doc_id").alias("chunk_id"))
    return truth.balanced_sample(chunks, 50)


@query("question_set_normalise", "select conv_id, concat('q', conv_id) as first_question, null::varchar as first_answer, 'w' as second_question, concat('a', turn) as second_answer, turn from conversations")
def question_set_normalise(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""concat('["q', cast(conv_id as string), '", {"question": "w", "expected_answer": "a', cast(turn as string), '"}]')""")
    q = _t(spark, d, "conversations").select("conv_id", "turn", truth.normalised_questions(raw).alias("q"))
    return q.select("conv_id", "turn", *[F.col("q")[i][f].alias(f"{n}_{f.removeprefix('expected_')}") for i, n in enumerate(("first", "second")) for f in ("question", "expected_answer")])


# --- sources, tables, reports -------------------------------------------------------------------------------------


@query(
    "address_rows",
    """with u as (select page_id, case when page_id % 5 = 0 then replace(url, 'http', '') when page_id % 5 = 1 then concat(regexp_replace(url, '[?#].*$', ''), '/file.PDF') else url end as url from pages),
 p as (select *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]+)([^?#]*)', 1) as scheme, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]+)([^?#]*)', 3) as path from u),
 b as (select *, coalesce(nullif(regexp_extract(path, '([^/]*)$', 1), ''), 'downloaded.pdf') as base from p)
 select url, case when scheme = '' then null when lower(base) like '%.pdf' then base else base || '.pdf' end as filename, case when scheme = '' then 'error' else 'processing' end as status, case when scheme = '' then 'Invalid URL: ' || url end as message from b""",
)
def address_rows(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr("case when page_id % 5 = 0 then replace(url, 'http', '') when page_id % 5 = 1 then concat(regexp_replace(url, '[?#].*$', ''), '/file.PDF') else url end")
    return ingest.address_rows(_t(spark, d, "pages").select(url.alias("url")))


@query("embedding_status", "with c as (select source as document_id, count(*) as n, count(case when doc_id % 3 = 0 or source in ('src1', 'src2') then 1 end) as k from documents where source <> 'src3' or doc_id % 3 <> 0 group by source) select document_id, case when k = n then 'embedding_failed' else 'ready' end as status, case when k > 0 and k < n then concat(k, '/', n, ' chunks missing embeddings') end as message from c")
def embedding_status(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "documents").filter("source <> 'src3' or doc_id % 3 <> 0")
    e = F.when(~((F.col("doc_id") % 3 == 0) | F.col("source").isin("src1", "src2")), F.array(F.lit(1.0)))
    return ingest.embedding_status(c.select(F.col("source").alias("document_id"), e.alias("embedding")))


@query("cascade_delete", "select o_orderkey, count(*) as n_lines from orders join lineitem on l_orderkey = o_orderkey where o_custkey % 7 <> 0 group by o_orderkey")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    gone = orders.filter("o_custkey % 7 = 0").select("o_orderkey")
    kept = ingest.delete_rows(lines, gone.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    left = ingest.delete_rows(orders, gone, "o_orderkey")
    return left.join(kept, left.o_orderkey == kept.l_orderkey).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))


_MODELS = [("model 1", "alpha", 1), ("MODEL 2", "beta", 2), ("x3", "model 3", 3), ("odel 4", "gamma", 4), ("model 1", "delta", 5)]
_MODELS_SQL = "m as (select * from (values " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in _MODELS) + ") t(id, name, position))"


@query(
    "model_match",
    f"""with {_MODELS_SQL}, n as (select distinct concat('model ', user_id % 6) as model_name from events),
 t as (select model_name, id, position, case when id = model_name then 0 when name = model_name then 1 when lower(id) = lower(model_name) then 2 when contains(lower(model_name), lower(id)) then 3 end as tier from n, m)
 select n.model_name, b.id from n left join (select * from t where tier is not null qualify row_number() over (partition by model_name order by tier, position) = 1) b using (model_name)""",
)
def model_match(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "events").select(F.concat(F.lit("model "), (F.col("user_id") % 6).cast("string")).alias("model_name")).distinct()
    return compare.match_models(names, spark.createDataFrame(_MODELS, "id string, name string, position int"))


_SPEC_SQL = "specs as (select a.run_id as run_a, b.run_id as run_b, a.model_name as name_a, b.model_name as name_b, (1 + a.run_id % 4) / 1000.0e0 as price_a, (1 + b.run_id % 4) / 1000.0e0 as price_b, 1000 * (1 + a.run_id % 3) as context_a, 1000 * (1 + b.run_id % 3) as context_b from runs a join runs b on b.run_id = a.run_id + 1)"


@query(
    "narrative",
    f"""with {_RUNS_SQL}, {_METRICS_SQL}, {_DECISION_SQL}, {_SPEC_SQL},
 c as (select run_a, run_b, count(case when s then 1 end) as n, count(case when s and winner = 'run_a' then 1 end) as wa, count(case when s and winner = 'run_b' then 1 end) as wb, count(case when s and coalesce(winner, 'tie') = 'tie' then 1 end) as ties
  from (select *, metric <> 'latency_ms' and value_a is not null and value_b is not null as s from metrics) group by all)
 select run_a, run_b, concat_ws(' ', case when winner_name is not null and decision_status <> 'inconclusive' then concat(winner_name, case when decision_status = 'marginal' then ' marginally' else '' end, ' outperforms ', if(winner_name = name_a, name_b, name_a), ' on this evaluation.')
  else concat(name_a, ' and ', name_b, ' perform comparably on this evaluation.') end, concat('Across ', n, ' metrics: ', name_a, ' wins ', wa, ', ', name_b, ' wins ', wb, case when ties > 0 then concat(', ', ties, ' tied') else '' end, '.'),
  case when floor((1 - least(price_a, price_b) / greatest(price_a, price_b)) * 100 + 0.5) >= 10 then concat(if(price_a < price_b, name_a, name_b), ' is ', floor((1 - least(price_a, price_b) / greatest(price_a, price_b)) * 100 + 0.5)::bigint, '% cheaper per token.') end,
  case when context_a / context_b::double > 1.5 then concat(name_a, ' has a ', floor(context_a / context_b::double + 0.5)::bigint, 'x larger context window.') when context_a / context_b::double < 1 / 1.5e0 then concat(name_b, ' has a ', floor(context_b / context_a::double + 0.5)::bigint, 'x larger context window.') end) as narrative
 from c join told using (run_a, run_b) join specs using (run_a, run_b)""",
)
def narrative(spark: SparkSession, d: str) -> DataFrame:
    both = compare.paired(pairs(spark), runs(spark, d))
    specs = both.select(
        "run_a", "run_b", F.col("a.model_name").alias("name_a"), F.col("b.model_name").alias("name_b"), ((1 + F.col("run_a") % 4) / 1000.0).alias("price_a"), ((1 + F.col("run_b") % 4) / 1000.0).alias("price_b"),
        (1000 * (1 + F.col("run_a") % 3)).alias("context_a"), (1000 * (1 + F.col("run_b") % 3)).alias("context_b"),
    )
    return reports.narratives(compare.compare_metrics(both), compare.decide(both, FINANCE), specs)


@query("score_band", f"select id, case when groundedness_score * 100 >= 80 then 'good' when groundedness_score * 100 >= 60 then 'fair' when groundedness_score is not null then 'poor' end as band from (with {_RESULTS_SQL} select * from results)")
def score_band(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("id", T.score_band(F.col("groundedness_score")).alias("band"))


@query("readiness", "with r as (select user_id % 12 as run_id, case when user_id % 12 % 3 = 0 then 'completed' else 'failed' end as status from events group by all) select count(case when status = 'completed' then 1 end) as completed, (select count(*) from documents) as documents, 'compare' as state from r")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "events").selectExpr("user_id % 12 as run_id").distinct().selectExpr("run_id", "case when run_id % 3 = 0 then 'completed' else 'failed' end as status")
    return reports.readiness(r, _t(spark, d, "documents"))


@query("comparison_history", "select user_id % 12 as run_a, event_id % 7 as run_b, max(event_id) as viewed_at from events group by all order by viewed_at desc limit 20")
def comparison_history(spark: SparkSession, d: str) -> DataFrame:
    v = _t(spark, d, "events").selectExpr("user_id % 12 as run_a", "event_id % 7 as run_b", "event_id as viewed_at")
    return reports.comparison_history(v)


@query("volume_by_part", "select l_partkey, count(*) as n, sum(cast(l_extendedprice as decimal(12, 2)) * (1 - cast(l_discount as decimal(4, 2))))::double as revenue from lineitem where l_quantity > 10 group by l_partkey")
def volume_by_part(spark: SparkSession, d: str) -> DataFrame:
    """A plain aggregation over the largest table: what a run's totals cost at volume."""
    lines = _t(spark, d, "lineitem").filter("l_quantity > 10")
    return lines.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"))
