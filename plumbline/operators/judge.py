"""Outputs of models as columns: scores, concept coverage, guard verdicts, lists of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import concept_in_contexts, let, repair_json, strip, strip_fence, strip_fence_lines

HALLUCINATION_BELOW = 0.7
# Keys of a judge's answer, and the scores that they become.
JUDGED = {
    "faithfulness": "groundedness_score", "relevancy": "relevancy_score", "context_relevancy": "context_relevancy_score", "abstention_quality": "abstention_score",
    "completeness": "completeness_score", "correctness": "correctness_score", "compliance_accuracy": "compliance_accuracy_score", "context_precision": "context_precision_score",
}
_STRINGS = r'"((?:[^"\\]|\\.)+)"'


def clamp(x: Column) -> Column:
    """Into 0 to 1; NaN becomes 1, null stays."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def parse_scores(raw: Column, keys: list[str]) -> dict[str, Column]:
    """A score per key from a judge's answer: of a JSON object, or of ``"key": number`` anywhere.

    Numbers may be strings, booleans count 1 and 0; lists, objects and missing keys give null. In the
    second form keys are lower-cased, the last counts, and negative numbers are not seen.
    """
    text = strip_fence(raw)
    good = F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), F.from_json(text, "map<string,string>"))

    def number(v: Column) -> Column:
        return clamp(F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(F.trim(v).try_cast("double")))

    def loose(key: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(rf'(?i)"{key}":\s*([\d.]+|null)'), F.lit(1))
        return clamp(F.try_element_at(found, F.lit(-1)).try_cast("double"))

    return {k: F.when(good.isNotNull(), number(F.try_element_at(good, F.lit(k)))).otherwise(loose(k)) for k in keys}


def _padded(statuses: Column, n: Column) -> Column:
    valid = F.transform(statuses, lambda s: let(F.lower(strip(F.coalesce(s, F.lit("")))), lambda x: F.when(x.isin("covered", "missing"), x).otherwise("missing")))
    return F.slice(F.concat(valid, F.array_repeat(F.lit("missing"), n)), F.lit(1), n)


def concept_statuses(raw: Column, n: Column) -> Column:
    """``covered`` or ``missing`` for each of ``n`` concepts from a judge's ``concept_coverage``; null if it has none."""
    text = strip_fence(raw)
    listed = F.from_json(F.get_json_object(text, "$.concept_coverage"), "array<string>")
    inner = F.regexp_extract(text, r'(?i)"concept_coverage"\s*:\s*\[([^\]]*)\]', 1)
    loose = F.regexp_extract_all(inner, F.lit(r'(?i)"(covered|missing)"'), F.lit(1))
    return F.coalesce(_padded(listed, n), F.when(F.size(loose) > 0, _padded(loose, n)))


def coverage_statuses(raw: Column, n: Column) -> Column:
    """The same from an answer that is the list itself; null if it is none."""
    return _padded(F.from_json(strip_fence_lines(raw), "array<string>"), n)


def concept_list(raw: Column) -> Column:
    """Concepts from a JSON list, trimmed, without blanks; null if it is none."""
    return F.filter(F.transform(F.from_json(strip_fence_lines(raw), "array<string>"), strip), lambda c: c != "")


def coverage_gaps(concepts: Column, statuses: Column, contexts: Column) -> Column:
    """Covered and missing concepts, their ratio, and which missing ones the contexts hold.

    Held by the contexts they are failures of the generation, else of the retrieval; without contexts or
    missing concepts the two lists are null.
    """
    pick = lambda s: F.transform(F.filter(F.arrays_zip(concepts.alias("c"), statuses.alias("s")), lambda x: x["s"] == s), lambda x: x["c"])

    def of(missing: Column) -> Column:
        told = (F.size(missing) > 0) & (F.size(F.coalesce(contexts, F.array().cast("array<string>"))) > 0)
        inside = F.filter(missing, lambda c: concept_in_contexts(c, contexts))
        outside = F.filter(missing, lambda c: ~concept_in_contexts(c, contexts))
        covered = F.transform(F.filter(F.arrays_zip(concepts.alias("c"), statuses.alias("s")), lambda x: x["s"] == "covered"), lambda x: x["c"])
        return F.struct(
            concepts.alias("concepts"), covered.alias("covered"), missing.alias("missing"), (F.size(covered) / F.size(concepts)).alias("coverage_ratio"),
            F.when(told, outside).alias("retrieval_failures"), F.when(told, inside).alias("generation_failures"),
        )

    usable = (F.size(F.coalesce(concepts, F.array().cast("array<string>"))) > 0) & statuses.isNotNull() & (F.size(statuses) > 0)
    return F.when(usable, let(pick("missing"), of))


def assembled(raw_a: Column, raw_b: Column, expected: Column) -> dict[str, Column]:
    """The eight scores from the two judge answers, and whether the answer is a hallucination.

    The second answer counts only where there is an expected answer.
    """
    a = parse_scores(raw_a, [k for k in list(JUDGED)[:4]])
    b = parse_scores(raw_b, [k for k in list(JUDGED)[4:]])
    has = F.coalesce(expected, F.lit("")) != ""
    out = {JUDGED[k]: v for k, v in a.items()} | {JUDGED[k]: F.when(has, v) for k, v in b.items()}
    return out | {"is_hallucination": a["faithfulness"] < HALLUCINATION_BELOW}


def guard(raw: Column) -> Column:
    """(is_safe, category) from a guard model's answer; no answer counts as safe."""
    low = F.lower(strip(raw))
    after = strip(F.regexp_replace(low, r"^[^\n]*\n?", ""))
    return F.struct(F.coalesce(low.startswith("safe"), F.lit(True)).alias("is_safe"), F.when(~low.startswith("safe") & (after != ""), after).alias("category"))


def gated(answer: Column, input_guard: Column, output_guard: Column, refusal: str, withheld: str) -> Column:
    """The answer behind both guards: a refusal for unsafe input, a notice for unsafe output."""
    return F.when(~input_guard["is_safe"], refusal).when(~output_guard["is_safe"], withheld).otherwise(answer)


def first_set(*names: Column) -> Column:
    """The first name that is not blank."""
    return F.coalesce(*[F.when(F.trim(n) != "", F.trim(n)) for n in names])


def sub_queries(raw: Column, most: int = 5) -> Column:
    """Sub-questions from a model's answer: a JSON list, a repaired one, or its quoted strings; null if none."""
    text = strip_fence(raw)
    array = lambda t: let(F.from_json(t, "array<string>"), lambda a: F.when(F.size(a) > 0, a))
    quoted = let(F.regexp_extract_all(text, F.lit(_STRINGS), F.lit(1)), lambda a: F.when(F.size(a) > 0, a))
    listed = F.coalesce(array(text), array(repair_json(text)), quoted)
    return F.slice(F.filter(listed, lambda q: strip(F.coalesce(q, F.lit(""))) != ""), 1, most)


def question_pairs(raw: Column) -> Column:
    """(question, expected_answer) pairs from a model's answer: JSON, repaired JSON, or a pattern; null if none."""
    text = strip_fence(raw)
    shape = "questions array<struct<question:string,expected_answer:string>>"
    pattern = r'"question"\s*:\s*"((?:[^"\\]|\\.)*)"\s*[,}]\s*"expected_answer"\s*:\s*"((?:[^"\\]|\\.)*)"'
    q, a = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    loose = F.when(F.size(q) > 0, F.transform(F.arrays_zip(q.alias("question"), a.alias("expected_answer")), lambda x: F.struct(x["question"], x["expected_answer"])))
    return F.coalesce(F.from_json(text, shape)["questions"], F.from_json(repair_json(text), shape)["questions"], loose)


def error_summary(body: Column, limit: int = 500) -> Column:
    """The first message of an upstream error body that is not blank, else the body."""
    paths = ["$.error.message", "$.error.detail", "$.error.msg", "$.detail", "$.message"]
    plain = F.get_json_object(body, "$.error")
    named = first_set(*[F.get_json_object(body, p) for p in paths[:3]], F.when(~F.coalesce(plain, F.lit("")).startswith("{"), plain), *[F.get_json_object(body, p) for p in paths[3:]])
    return F.left(F.coalesce(named, body), F.lit(limit))


def retry_payload(n_chunks: Column, attempt: Column, cap: Column, least_chunks: int = 4, least_tokens: int = 512) -> Column:
    """(chunks, max_tokens) of an attempt (from 0): each retry drops a quarter of the chunks.

    An attempt's length is that of the attempt before it divided by two to the number of the attempt, so the cuts
    compound: 8192, 4096, 1024.
    """
    step = F.greatest(F.lit(1), F.floor(n_chunks / 4))
    kept = F.when(attempt <= 0, n_chunks).otherwise(F.least(n_chunks, F.greatest(F.lit(least_chunks), n_chunks - step * attempt)))
    shorter = lambda n, i: F.greatest(F.lit(least_tokens), F.floor(n / F.pow(F.lit(2.0), i)).cast("int"))
    length = F.aggregate(F.sequence(F.lit(0), F.greatest(attempt.cast("int"), F.lit(0))), cap.cast("int"), shorter)
    return F.struct(kept.cast("int").alias("chunks"), length.alias("max_tokens"))
