"""Queries of the smaller operators: checks, model outputs, truth, lookups and what a front end shows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import alignment, checks, judge, layout, reports, retrieval, truth, vector_index
from plumbline.plans.profiles import SCORES
from plumbline.queries import _DOCS_SQL, _RESULTS_SQL, _SPOKEN_SQL, _docs, _spoken, _t, query, results
from plumbline.sources import ingest
from plumbline.sources.storage import checkpoint_folder

# --- checks and model outputs -----------------------------------------------------------------------------------

_ABSTAINS_SQL = "(" + " or ".join(f"contains(lower(text), '{p.replace(chr(39), chr(39) * 2)}')" for p in T.ABSTENTION) + ")"


@query(
    "abstention_validation",
    f"""with {_SPOKEN_SQL}, s as (select conv_id, turn, conv_id % 2 = 0 as expected, {_ABSTAINS_SQL} as seen from spoken) select conv_id, turn, expected = seen as passed,
 case when expected and not seen then 'Model answered when it should have abstained' when seen and not expected then 'Model abstained when it should have answered' else 'Abstention behavior matches expectation' end as detail from s""",
)
def abstention_validation(spark: SparkSession, d: str) -> DataFrame:
    c = checks.abstention(F.col("conv_id") % 2 == 0, F.col("text"))
    return _spoken(spark, d).withColumn("c", c).select("conv_id", "turn", "c.passed", "c.detail")


_TRUTH = """case when conv_id % 4 <> 3 then named_struct('answer_truth', named_struct('required_concepts', array('a'), 'abstention_expected', conv_id % 2 = 0),
 'retrieval_truth', named_struct('required_documents', array('d0'), 'expected_chunk_refs', cast(array() as array<string>), 'expected_chunk_texts', cast(array() as array<string>), 'supporting_documents', cast(array() as array<string>), 'supporting_chunk_refs', cast(array() as array<string>))) end"""


@query(
    "check_runner",
    f"""with {_SPOKEN_SQL}, s as (select conv_id, turn, {_ABSTAINS_SQL} as seen, turn % 2 = 0 as answered, len(regexp_extract_all(text, '(?i)\\b([\\w\\-]+\\.(?:pdf|docx?|txt|csv|xlsx?))\\b')) = 0 as plain from spoken)
 select conv_id, turn, case when conv_id % 4 = 3 then '' else concat('document_presence=', turn % 3 = 0, ',chunk_alignment=true', case when answered then concat(',abstention_validation=', (conv_id % 2 = 0) = seen, ',source_reference=', plain) else '' end) end as results from s""",
)
def check_runner(spark: SparkSession, d: str) -> DataFrame:
    chunk = F.array(F.struct(F.lit(1).alias("chunk_id"), F.concat(F.lit("d"), (F.col("turn") % 3).cast("string")).alias("document"), F.lit(None).cast("string").alias("page"), F.lit("x").alias("text"))).cast(alignment.CHUNKS)
    answer = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("")
    df = _spoken(spark, d).withColumns({"truth": F.expr(_TRUTH), "chunks": chunk, "answer": answer})
    shown = F.transform(checks.run_checks(F.col("truth"), F.col("chunks"), F.col("answer")), lambda c: F.concat(c["check_name"], F.lit("="), c["passed"].cast("string")))
    return df.select("conv_id", "turn", F.array_join(shown, ",").alias("results"))


@query("fence_lines", "select doc_id, case when doc_id % 3 = 0 then regexp_replace(text, '^\\s+|\\s+$', '', 'g') else text end as text from documents")
def fence_lines(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```\n"))).otherwise(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", T.strip_fence_lines(raw).alias("text"))


@query(
    "score_assembly",
    "select event_id, least(1.0e0, value) as groundedness_score, 0.5e0 as relevancy_score, case when event_id % 2 = 0 then (event_id % 5) / 4.0e0 end as correctness_score, least(1.0e0, value) < 0.7e0 as is_hallucination from events",
)
def score_assembly(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat(F.lit('{"faithfulness": '), F.col("value").cast("string"), F.lit(', "relevancy": 0.5}'))
    b = F.concat(F.lit('{"correctness": '), ((F.col("event_id") % 5) / 4).cast("string"), F.lit("}"))
    out = judge.assembled(a, b, F.when(F.col("event_id") % 2 == 0, "expected"))
    return _t(spark, d, "events").select("event_id", *[out[c].alias(c) for c in ("groundedness_score", "relevancy_score", "correctness_score", "is_hallucination")])


@query("concept_parse", "select event_id, case event_id % 3 when 0 then concat('c', event_id, '|b') when 1 then 'x' end as concepts from events")
def concept_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""case event_id % 3 when 0 then concat('[" c', cast(event_id as string), '", "", "b "]') when 1 then '```\\n["x"]\\n```' else 'no list' end""")
    return _t(spark, d, "events").select("event_id", F.array_join(judge.concept_list(raw), "|").alias("concepts"))


@query("coverage_parse", "select event_id, case event_id % 3 when 0 then array_to_string(list_resize(['covered'], (event_id % 4 + 1)::int, 'missing'), ',') when 1 then array_to_string((['missing', 'covered', 'missing', 'covered'])[1 : (event_id % 4 + 1)::int], ',') end as statuses from events")
def coverage_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""case event_id % 3 when 0 then '["Covered"]' when 1 then '["odd", " covered", "missing", "COVERED", "covered"]' else '{}' end""")
    return _t(spark, d, "events").select("event_id", F.array_join(judge.coverage_statuses(raw, (F.col("event_id") % 4 + 1).cast("int")), ",").alias("statuses"))


@query("gated_answers", "select doc_id, case when toxic = 1 then 'refused' when quality = 0 then 'withheld' else concat('answer ', doc_id) end as answer from labels")
def gated_answers(spark: SparkSession, d: str) -> DataFrame:
    told = judge.guard(F.expr("case when toxic = 1 then 'unsafe\\nS9' end")), judge.guard(F.expr("case when quality = 0 then 'Unsafe' else 'safe' end"))
    return _t(spark, d, "labels").select("doc_id", judge.gated(F.concat(F.lit("answer "), F.col("doc_id").cast("string")), *told, "refused", "withheld").alias("answer"))


@query("judge_choice", "select event_id, case when event_id % 2 = 0 then 'judge' when event_id % 3 = 0 then 'model a' when event_id % 5 = 0 then 'model b' end as model from events")
def judge_choice(spark: SparkSession, d: str) -> DataFrame:
    names = [F.expr(f"case when event_id % {k} = 0 then ' {n} ' when event_id % 7 = 0 then '  ' end") for k, n in ((2, "judge"), (3, "model a"), (5, "model b"))]
    return _t(spark, d, "events").select("event_id", judge.first_set(*names).alias("model"))


@query("error_summary", "select doc_id, substring(case doc_id % 4 when 0 then 'top' when 1 then 'detail' when 2 then 'plain' else text end, 1, 500) as summary from documents")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""case doc_id % 4 when 0 then '{"error": {"message": "top"}}' when 1 then '{"error": {"message": "  "}, "detail": "detail"}' when 2 then '{"error": "plain"}' else text end""")
    return _t(spark, d, "documents").select("doc_id", judge.error_summary(body).alias("summary"))


@query(
    "retry_lengths",
    """with a as (select event_id, event_id % 4 as i, [2048, 4096, 8192][event_id % 3 + 1] as c0 from events), b as (select *, greatest(512, c0 // 2) as c1 from a), c as (select *, greatest(512, c1 // 4) as c2 from b)
 select event_id, case i when 0 then c0 when 1 then c1 when 2 then c2 else greatest(512, c2 // 8) end::int as max_tokens from c""",
)
def retry_lengths(spark: SparkSession, d: str) -> DataFrame:
    cap = F.element_at(F.array(*map(F.lit, (2048, 4096, 8192))), (F.col("event_id") % 3 + 1).cast("int"))
    p = judge.retry_payload(F.lit(9), (F.col("event_id") % 4).cast("int"), cap)
    return _t(spark, d, "events").select("event_id", p["max_tokens"].alias("max_tokens"))


# --- truth and question sets ---------------------------------------------------------------------------------------


@query(
    "doc_classify",
    """select event_id, case event_id % 4 when 0 then 'b' when 1 then 'a' when 2 then 'a,c' end as required, case event_id % 4 when 0 then 'a,c' when 1 then 'b,c' when 2 then 'b' end as supporting from events""",
)
def doc_classify(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("""case event_id % 4 when 0 then '{"required": ["b", "odd"], "supporting": ["c"]}' when 1 then '```json\\n{"required": [], "supporting": ["c"]}\\n```' when 2 then '{"required": ["c", "a"]}' else 'none' end""")
    c = truth.classify(raw, F.array(*map(F.lit, "cab")))
    return _t(spark, d, "events").withColumn("c", c).select("event_id", F.array_join("c.required", ",").alias("required"), F.array_join("c.supporting", ",").alias("supporting"))


@query("truth_metadata", "select doc_id, '1.1' as truth_schema_version, 'v1' as evidence_alignment_version, source as generated_by_model, '2026-01-02 03:04:05' as generated_at, concat(doc_id, ',', doc_id + 1) as source_chunk_ids from documents")
def truth_metadata(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(F.col("doc_id"), F.col("doc_id") + 1)
    m = truth.truth_metadata(F.col("source"), ids, F.lit("2026-01-02 03:04:05"))
    out = _t(spark, d, "documents").withColumn("m", m)
    return out.select("doc_id", "m.truth_schema_version", "m.evidence_alignment_version", "m.generated_by_model", F.date_format("m.generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"), F.array_join("m.source_chunk_ids", ",").alias("source_chunk_ids"))


@query("needing_truth", f"with {_RESULTS_SQL} select id from results where expected_answer <> '' and id % 4 <> 0")
def needing_truth(spark: SparkSession, d: str) -> DataFrame:
    return truth.needing_truth(results(spark, d).withColumn("truth", F.when(F.col("id") % 4 == 0, "made"))).select("id")


@query("truth_attached", f"with {_RESULTS_SQL} select id as question_id, case when id % 4 = 0 then 'own' when id % 4 = 1 then concat('made ', id) end as truth from results")
def truth_attached(spark: SparkSession, d: str) -> DataFrame:
    q = results(spark, d).select(F.col("id").alias("question_id"), F.when(F.col("id") % 4 == 0, "own").alias("truth"))
    made = q.filter("question_id % 4 < 2").select("question_id", F.concat(F.lit("made "), F.col("question_id").cast("string")).alias("truth"))
    return truth.attached(q, made)


@query("question_set_merge", "select o_custkey as id, count(*) as n, max(case when o_custkey % 3 = 0 then 'new' else 'old' end) as name from orders group by o_custkey")
def question_set_merge(spark: SparkSession, d: str) -> DataFrame:
    sets = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.lit("old").alias("name"), F.collect_list(F.col("o_orderkey").cast("string")).alias("questions"))
    changes = sets.filter("id % 3 = 0").select("id", F.lit("new").alias("name"), F.lit(None).cast("array<string>").alias("questions"))
    return truth.merge_question_sets(sets, changes).select("id", F.size("questions").cast("long").alias("n"), "name")


@query("generated_questions", "select conv_id, turn, text as question from conversations where turn > 0 and trim(text) <> '' and text not in (select text from conversations where turn = 0)")
def generated_questions(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "conversations").withColumnRenamed("text", "question")
    return truth.new_questions(c.filter("turn > 0").select("conv_id", "turn", "question"), c.filter("turn = 0")).select("conv_id", "turn", "question")


@query(
    "rerun_questions",
    f"with {_RESULTS_SQL} select run_id, (row_number() over (partition by run_id order by id) - 1)::int as position, question, expected_answer, case when id % 3 = 0 then id::varchar end as truth, id % 3 = 1 as truth_lost from results",
)
def rerun_questions(spark: SparkSession, d: str) -> DataFrame:
    payload = F.expr("""case id % 3 when 0 then concat('{"a": "', cast(id as string), '"}') when 1 then '{broken' end""")
    out = truth.rerun_questions(results(spark, d).withColumn("truth_payload", payload), "a string")
    return out.withColumn("truth", F.col("truth.a"))


# --- laid-out documents -------------------------------------------------------------------------------------------


@query(
    "layout_chunks",
    r"""with t as (select page_id, regexp_extract_all(html, '(?i)<(title|h1|p|li)(?:\s[^>]*)?>([^<]*)', 1) as tags, regexp_extract_all(html, '(?i)<(title|h1|p|li)(?:\s[^>]*)?>([^<]*)', 2) as texts from pages),
 l as (select page_id, unnest(range(len(tags))) as i, lower(unnest(tags)) as tag, trim(regexp_replace(unnest(texts), '\s+', ' ', 'g')) as text from t),
 p as (select page_id, max(i) filter (tag = 'title') over w as a, max(i) filter (tag = 'h1') over w as b, count(*) filter (tag in ('title', 'h1')) over w as section, i, tag, text from l where text <> '' window w as (partition by page_id order by i)),
 s as (select p.page_id, p.i, p.section, p.text, concat_ws(' > ', x.text, case when p.b > coalesce(p.a, -1) then y.text end) as path from p left join l x on x.page_id = p.page_id and x.i = p.a left join l y on y.page_id = p.page_id and y.i = p.b where p.tag in ('p', 'li'))
 select page_id, (row_number() over (partition by page_id order by section) - 1)::int as seq, nullif(path, '') as section_path, string_agg(text, chr(10) order by i) as text, sum(len(string_split(text, ' ')))::int as token_count from s group by page_id, section, path""",
)
def layout_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The text of web pages under their title and main heading."""
    lines = layout.html_lines(F.col("html"), {"title": 1, "h1": 2, "p": 0, "li": 0})
    out = layout.layout_chunks(_t(spark, d, "pages").select("page_id", "html"), lines, 1_000_000)
    return out.select("page_id", "seq", "section_path", "text", "token_count")


@query("vector_topk_indexed")
def vector_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """As ``vector_topk``, through a coarse index over all rows with as many probes as a recall of 0.95 needs."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    index = vector_index.build_index(v, f"{checkpoint_folder(spark)}/coarse-index-{uuid.uuid4().hex}")
    asked = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    return vector_index.indexed_search(index, asked, 10, vector_index.probes_for(index, spark, 10))


# --- tables ------------------------------------------------------------------------------------------------------


@query("ready_documents", f"with {_DOCS_SQL} select count(*) as n from docs where status = 'ready' and deleted_at is null")
def ready_documents(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ready_documents(_docs(spark, d))


@query("chunks_of_ready_documents", f"with {_DOCS_SQL} select l_orderkey as chunk_id, l_linenumber as line, filename from lineitem join docs on document_id = l_partkey where status = 'ready' and deleted_at is null")
def chunks_of_ready_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their document, as the searches and the synthesis read them."""
    shown = _docs(spark, d).filter((F.col("status") == "ready") & F.col("deleted_at").isNull())
    lines = _t(spark, d, "lineitem")
    return lines.join(shown, lines.l_partkey == shown.document_id).select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("line"), "filename")


@query("run_detail", f"with {_RESULTS_SQL} select run_id, string_agg(id, ',' order by id) as ids, count(*) as n from results group by run_id")
def run_detail(spark: SparkSession, d: str) -> DataFrame:
    """A run's results in order of their ids."""
    per = results(spark, d).groupBy("run_id").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return per.select("run_id", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.size("ids").cast("long").alias("n"))


@query("run_projection", f"with {_RESULTS_SQL} select id, run_id, question, {', '.join(SCORES)} from results")
def run_projection(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).select("id", "run_id", "question", *SCORES)


@query("needs_embedding", "select distinct source as document_id from documents where doc_id % 3 = 0")
def needs_embedding(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    c = docs.select(F.col("source").alias("document_id"), F.when(F.col("doc_id") % 3 != 0, F.array(F.lit(1.0))).alias("embedding"))
    return ingest.needs_embedding(c.select("document_id").distinct(), c)


@query("chosen_documents", "select doc_id, source from documents where source in ('src1', 'src3')")
def chosen_documents(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").filter(F.col("source").isin("src1", "src3")).select("doc_id", "source")


@query("batch_totals", "select count(*) as total, count(case when page_id % 5 <> 0 then 1 end) as succeeded, count(case when page_id % 5 = 0 then 1 end) as failed from pages")
def batch_totals(spark: SparkSession, d: str) -> DataFrame:
    url = F.expr("case when page_id % 5 = 0 then concat('no scheme ', cast(page_id as string)) else url end")
    return ingest.batch_totals(ingest.address_rows(_t(spark, d, "pages").select(url.alias("url")))).toDF("total", "succeeded", "failed")


@query(
    "model_metadata",
    "select concat('m', p_partkey) as id, p_size * 1000 as context_length, 'a,b' as capabilities, p_size % 2 = 0 as supports_vision, false as supports_reasoning from part",
)
def model_metadata(spark: SparkSession, d: str) -> DataFrame:
    body = F.expr("""concat('[{"id": "m', cast(p_partkey as string), '", "contextLength": ', cast(p_size * 1000 as string), ', "capabilities": ["a", "b"]', case when p_size % 2 = 0 then ', "supportsVision": true' else '' end, '}]')""")
    m = ingest.model_metadata(_t(spark, d, "part").select(body.alias("body")))
    return m.select("id", "context_length", F.array_join("capabilities", ",").alias("capabilities"), "supports_vision", "supports_reasoning")


@query("model_search", "select p_partkey as id, p_name as name from part where contains(lower(p_name), 'an')")
def model_search(spark: SparkSession, d: str) -> DataFrame:
    return ingest.search_models(_t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "AN")


@query("service_health", "select case when bool_and(s_suppkey % 7 <> 3) then 'ready' when not max(case when s_suppkey % 2 = 0 then s_suppkey % 7 <> 3 end) then 'not_ready' else 'degraded' end as state from supplier")
def service_health(spark: SparkSession, d: str) -> DataFrame:
    return reports.service_health(_t(spark, d, "supplier").selectExpr("s_suppkey % 2 = 0 as critical", "s_suppkey % 7 <> 3 as healthy"))


# --- what a front end shows ------------------------------------------------------------------------------------------


@query("documents_found", "select doc_id, (case when source in ('src1', 'src2') then 1 else 0 end + 1)::int as found from documents")
def documents_found(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(F.upper("source"), F.lit(" Always "))
    return _t(spark, d, "documents").select("doc_id", reports.documents_found(wanted, F.array(*map(F.lit, ("src1 ", "SRC2", "always")))).alias("found"))


@query(
    "required_progress",
    """select event_id, case event_id % 4 when 0 then 3 when 1 then 3 when 2 then null else 0 end::int as found, case event_id % 4 when 0 then 3 when 1 then 5 when 2 then 3 else 5 end::int as total from events""",
)
def required_progress(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id") % 4
    detail = F.when(e == 1, "missing 2/5 required").when(e == 3, "Missing 9/5 of them").otherwise("nothing said")
    p = reports.required_progress(F.lit(3), F.when(e == 0, True).when(e > 0, False), detail)
    return _t(spark, d, "events").withColumn("p", p).select("event_id", "p.found", "p.total")


@query(
    "model_insights",
    """select p_partkey as run_a, p_partkey + 1 as run_b, array_to_string(list_filter([case when p_size > 15 then concat('A has ', floor(p_size / 10.0e0 + 0.5e0)::bigint, 'x larger context window') when p_size / 10.0e0 < 1 / 1.5e0 then concat('B has ', floor(10.0e0 / p_size + 0.5e0)::bigint, 'x larger context window') end,
 'A is 50% cheaper per input token', 'A uniquely supports: x', case when p_size % 2 = 0 then 'B supports vision' end], lambda s: s is not null), '; ') as insights from part""",
)
def model_insights(spark: SparkSession, d: str) -> DataFrame:
    strings = lambda *x: F.array(*map(F.lit, x))
    pairs = _t(spark, d, "part").select(
        F.col("p_partkey").alias("run_a"), (F.col("p_partkey") + 1).alias("run_b"), F.lit("A").alias("name_a"), F.lit("B").alias("name_b"), F.lit(1.0).alias("price_a"), F.lit(2.0).alias("price_b"),
        F.col("p_size").alias("context_a"), F.lit(10).alias("context_b"), strings("x", "y").alias("capabilities_a"), strings("y").alias("capabilities_b"), F.lit(False).alias("vision_a"), (F.col("p_size") % 2 == 0).alias("vision_b"),
    )
    return reports.model_insights(pairs).withColumn("insights", F.array_join("insights", "; "))


@query(
    "formatted_values",
    """select event_id, coalesce(concat(floor(value * 100 + 0.5e0)::bigint, '%'), '--') as score, concat(floor(value * 1000 + 0.5e0)::bigint, 'ms') as latency,
 case when event_id < 1024 then concat(event_id, ' B') when event_id < 1048576 then printf('%.1f KB', floor(event_id / 1024.0e0 * 10 + 0.5e0) / 10) else printf('%.1f MB', floor(event_id / 1048576.0e0 * 10 + 0.5e0) / 10) end as size,
 case when event_id >= 1000000 then printf('%.1fM', floor(event_id / 1e6 * 10 + 0.5e0) / 10) when event_id >= 1000 then concat(floor(event_id / 1e3 + 0.5e0)::bigint, 'K') else event_id::varchar end as tokens from events""",
)
def formatted_values(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events")
    return e.select("event_id", T.shown_score(F.col("value")).alias("score"), T.shown_metric(F.lit("latency_ms"), F.col("value") * 1000).alias("latency"), T.format_bytes(F.col("event_id")).alias("size"), T.format_tokens(F.col("event_id")).alias("tokens"))


@query("spec_lines", "select p_partkey as id, case when p_size % 5 = 0 then '--' else concat(p_size, 'K tokens') end as context_shown, case when p_size % 3 = 0 then '--' else concat('$', printf('%.2f', p_size::double), '/1M') end as price_shown from part")
def spec_lines(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("p_size") % 3 != 0, F.col("p_size") / 1e6)
    m = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), price.alias("price"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 1000).alias("context"))
    return reports.spec_lines(m)


@query("recent_completed", "select o_orderkey as run_id from orders where o_orderkey % 3 = 0 order by o_custkey desc, o_orderkey desc limit 3")
def recent_completed(spark: SparkSession, d: str) -> DataFrame:
    r = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, "completed").otherwise("failed").alias("status"))
    return reports.recent_completed(r).select("run_id")


@query("valid_questions", "select conv_id, turn from conversations where turn % 2 = 0 and trim(text) <> ''")
def valid_questions(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "conversations").withColumn("question", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("  "))
    return reports.valid_questions(q).select("conv_id", "turn")


@query("labels_shown", "select event_id, case event_id % 3 when 0 then 'Some Snake Case' when 1 then 'FAIL Now' else 'X' end as label, case event_id % 2 when 0 then 'Traced from synthesis' else 'other mode' end as evidence from events")
def labels_shown(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.when(e % 3 == 0, "some_snake_case").when(e % 3 == 1, "FAIL_now").otherwise("x")
    return _t(spark, d, "events").select("event_id", T.title_label(raw).alias("label"), T.evidence_label(F.when(e % 2 == 0, "traced_from_synthesis").otherwise("other_mode")).alias("evidence"))
