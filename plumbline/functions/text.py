"""Text functions as column expressions.

White space means Unicode white space, as ``(?U)\\s`` matches it. Expressions that a lambda needs more
than once are bound with ``let``, so that they are evaluated once per row and not once per element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
HEADING_MAX_WORDS = 12

# Phrases of an answer that abstains.
ABSTENTION = [
    "i don't have enough information",
    "i do not have enough information",
    "the provided context does not",
    "the context does not contain",
    "insufficient information",
    "cannot answer",
    "unable to answer",
    "not enough context",
    "no relevant information",
    "does not address",
    "not mentioned in",
    "not covered in the provided",
    "i cannot determine",
    "based on the available context, i cannot",
]

# Phrases that mark a survey question, and weaker words of which two are needed.
SURVEY_PHRASES = [
    "overview of", "summarize all", "summarize the", "comprehensive overview", "compare and contrast",
    "key requirements for", "main requirements for", "what are the key", "what are the main",
    "describe the framework", "explain the framework", "all requirements", "various aspects",
    "multiple areas", "across all", "disclosure requirements", "reporting requirements",
    "compliance requirements", "regulatory requirements", "filing requirements", "what requirements",
]
BROAD_WORDS = ["key", "main", "overview", "framework", "comprehensive", "summary", "compare", "differences", "various", "multiple", "categories"]

# Patterns of untagged reasoning in an answer.
REASONING_START = (
    r"(?is)^(okay|ok|alright|so|well|hmm|let me|i need to|i('ll| will) ).*\b(figure out|think|analyze|go through|work through|reason|consider)\b"
)
TRANSITION = (
    r"(?i)^(based on (?:the |all |these )?(?:above|provided|context|sources|analysis|information)|in (?:summary|conclusion)|to (?:summarize|conclude|answer)"
    r"|here(?:'s| is| are) |therefore|overall|thus|so,? (?:the |in |to )|putting (?:it|this|everything) (?:all )?together)"
)
ANSWER_BODY = r"(?i)\n\s*\n(?=(?:1|I)[\.\)]\s+\*?\*?[A-Z]|\*\*1)"
TRAILING_REASONING = (
    r"(?i)\n\s*\n\s*(?:I should |I need to |I('ll| will) |Let me |Now,? I |I think I should |I want to make sure |I have to )[^\n]*$"
)
FILE_NAME = r"(?i)\b([\w\-]+\.(?:pdf|docx?|txt|csv|xlsx?))\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once: it becomes the variable of a lambda over one element."""
    return F.transform(F.array(value), body)[0]


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def words(s: Column) -> Column:
    """Words between white space; no empty ones. Null gives an empty array."""
    return F.filter(F.split(F.coalesce(s, F.lit("")), SPACE), lambda w: w != "")


def ngrams(ws: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by blanks."""
    run = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return let(ws, lambda w: F.when(F.size(w) >= n, run(w)).otherwise(F.array().cast("array<string>")))


def fixed_chunks(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Array of (seq, text, token_count): windows of ``size`` words that overlap.

    A text of at most ``size`` words stays verbatim, an empty one gives no chunk; windows begin at every
    step while words are left, so the last may lie wholly inside the one before.
    """
    step = max(size - overlap, 1)
    piece = lambda seq, t, n: F.struct(seq.cast("int").alias("seq"), t.alias("text"), n.cast("int").alias("token_count"))

    def of(w: Column) -> Column:
        window = lambda start, i: let(F.slice(w, start + 1, size), lambda x: piece(i, F.array_join(x, " "), F.size(x)))
        many = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), window)
        none = F.array().cast("array<struct<seq:int,text:string,token_count:int>>")
        return F.when(F.size(w) == 0, none).when(F.size(w) <= size, F.array(piece(F.lit(0), text, F.size(w)))).otherwise(many)

    return let(words(text), of)


def is_heading(line: Column) -> Column:
    """Capitals, a numbered section, a named section, or a short title-like line without a final period."""

    def of(s: Column) -> Column:
        def by_words(w: Column) -> Column:
            alpha = F.filter(w, lambda x: x.rlike(r"\p{L}"))
            capitals = (F.size(alpha) >= 2) & F.forall(alpha, lambda x: x == F.upper(x))
            capped = F.size(F.filter(w, lambda x: F.substring(x, 1, 1).rlike(r"^\p{Lu}")))
            title = (F.size(w) <= HEADING_MAX_WORDS) & ~s.endswith(".") & (2 * capped >= F.size(w))
            return capitals | title

        numbered = s.rlike(r"^\d+(\.\d+)+\.?\s") | s.rlike(r"(?i)^(Article|Section|Part|Chapter|Item)\s+[\dIVXLCDM]+")
        return (F.length(s) >= 3) & (numbered | let(words(s), by_words))

    return let(strip(F.coalesce(line, F.lit(""))), of)


def embedding_input(text: Column, prefix: str = "search_document: ", max_chars: int = 4000, max_words: int = 600) -> Column:
    """What an embedding model gets: trimmed, cut to characters, then to words, after a task prefix."""
    cut = F.substring(strip(text), 1, max_chars)
    short = let(words(cut), lambda w: F.when(F.size(w) > max_words, F.array_join(F.slice(w, 1, max_words), " ")))
    return F.concat(F.lit(prefix), F.coalesce(short, cut))


def preview(text: Column, limit: int = 200) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def source_header(rank: Column, document: Column, page: Column, text: Column) -> Column:
    """``[Source i: document, page p]`` and the text on the next line; a blank page is left out."""
    shown = F.when(F.coalesce(page, F.lit("")) != "", F.concat(F.lit(", page "), page)).otherwise("")
    return F.concat(F.lit("[Source "), rank.cast("string"), F.lit(": "), document, shown, F.lit("]\n"), text)


def stored_context(document: Column, page: Column, section: Column, text: Column) -> Column:
    """``[document | p.N | section]`` and the text; empty parts are left out."""
    full = lambda c: F.when(c != "", c)
    return F.concat(F.lit("["), F.concat_ws(" | ", full(document), F.concat(F.lit("p."), full(page)), full(section)), F.lit("]\n"), text)


def parse_stored_contexts(contexts: Column) -> Column:
    """Array of (document, page, section, text) from stored contexts; chunks without text are dropped."""

    def one(piece: Column) -> Column:
        header = F.regexp_extract(piece, r"^\[([^\]\n]*)\]\n", 1)
        body = F.trim(F.regexp_replace(piece, r"^\[[^\]\n]*\]\n", ""))

        def of(parts: Column) -> Column:
            page = F.get(F.filter(F.slice(parts, 2, 2), lambda p: p.startswith("p.")), F.lit(0))
            section = F.get(F.filter(F.slice(parts, 2, 2), lambda p: ~p.startswith("p.")), F.lit(0))
            return F.struct(F.get(parts, F.lit(0)).alias("document"), F.substring(page, 3, 1_000_000).alias("page"), section.alias("section"), body.alias("text"))

        return let(F.split(header, r" \| "), of)

    return F.filter(F.transform(F.split(F.coalesce(contexts, F.lit("")), r"\n---\n"), one), lambda c: c["text"] != "")


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """Whether the lower-cased text holds one of the phrases."""
    import re

    pattern = "|".join(re.escape(p) for p in phrases)
    return F.lower(text).rlike(pattern)


def abstains(answer: Column) -> Column:
    return contains_any(answer, ABSTENTION)


def is_broad(question: Column, least_words: int = 8) -> Column:
    """Whether a question is worth splitting: long enough, and survey-like."""
    low = F.lower(question)
    weak = F.size(F.filter(F.array(*map(F.lit, BROAD_WORDS)), lambda w: F.contains(low, w)))
    return (F.size(words(question)) >= least_words) & (contains_any(question, SURVEY_PHRASES) | (weak >= 2))


def file_references(answer: Column) -> Column:
    """Distinct file names that a text mentions, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(answer, F.lit(FILE_NAME), F.lit(1))))


def overlap_match(expected: Column, retrieved: Column, n: int = 4, least: int = 3) -> Column:
    """Whether one retrieved text has ``least`` positions whose n-gram the expected text has.

    An expected text of under ``n`` words has to be contained whole.
    """
    low = F.lower(expected)
    contained = F.exists(retrieved, lambda r: F.contains(F.lower(r), low))
    shared = lambda wanted: F.exists(retrieved, lambda r: F.size(F.filter(ngrams(words(F.lower(r)), n), lambda g: F.array_contains(wanted, g))) >= least)
    return F.when(F.size(words(low)) < n, contained).otherwise(let(F.array_distinct(ngrams(words(low), n)), shared))


def concept_in_contexts(concept: Column, contexts: Column) -> Column:
    """Whether 40 % of the concept's words of three letters and more are tokens of the contexts."""
    wanted = F.array_distinct(F.transform(F.filter(words(concept), lambda w: F.length(w) >= 3), F.lower))
    tokens = F.transform(words(F.lower(F.array_join(contexts, " "))), lambda w: F.regexp_replace(w, r"""[.,;:!?'")\]}]+$""", ""))
    return F.coalesce(let(wanted, lambda w: (F.size(w) > 0) & (F.size(F.array_intersect(w, tokens)) / F.greatest(F.size(w), F.lit(1)) >= 0.4)), F.lit(False))


def strip_fence(raw: Column) -> Column:
    """Without the first and the last line if these are code fences."""
    s = strip(raw)
    inner = F.regexp_replace(F.regexp_replace(s, r"^```[^\n]*(\n|$)", ""), r"(^|\n)\s*```\s*$", "")
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


def strip_fence_lines(raw: Column) -> Column:
    """Without every line that begins with a fence, if the text does."""
    lines = F.filter(F.split(raw, "\n"), lambda x: ~strip(x).startswith("```"))
    return F.when(raw.startswith("```"), strip(F.array_join(lines, "\n"))).otherwise(raw)


def repair_json(text: Column) -> Column:
    """Without commas before a closing bracket, with commas between strings on separate lines."""
    return F.regexp_replace(F.regexp_replace(text, r",\s*([}\]])", "$1"), r'"\s*\n(\s*")', '",\n$1')


def strip_reasoning(answer: Column) -> Column:
    """The answer without reasoning: tagged, before an orphan closing tag, untagged at the start, or trailing."""
    text = strip(F.coalesce(answer, F.lit("")))
    for tag in ("think", "redacted_thinking"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>\s*", "")
    for tag in ("think", "redacted_thinking"):
        text = F.regexp_replace(text, rf"(?is)^.*</{tag}>", "")

    def untagged(t: Column) -> Column:
        parts = F.split(t, ANSWER_BODY, 2)
        body = strip(F.get(parts, F.lit(1)))

        def by_paragraph(p: Column) -> Column:
            rest = lambda i: strip(F.array_join(F.slice(p, i + 2, F.size(p)), "\n\n"))
            good = F.filter(F.transform(p, lambda x, i: F.when(strip(x).rlike(TRANSITION), rest(i))), lambda r: F.length(r) >= 80)
            return F.get(good, F.lit(0))

        found = F.when(F.size(parts) > 1, F.when(F.length(body) >= 80, body)).otherwise(let(F.split(t, r"\n\s*\n"), by_paragraph))
        return F.when(t.rlike(REASONING_START), F.coalesce(found, t)).otherwise(t)

    return strip(F.regexp_replace(let(strip(text), untagged), TRAILING_REASONING, ""))


def percent(x: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def shown_score(x: Column) -> Column:
    """A share as whole percent, halves up, ``--`` without one."""
    return F.coalesce(F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%")), F.lit("--"))


def shown_metric(metric: Column, x: Column) -> Column:
    """A metric as the front end shows it: milliseconds of the latency, percent of all others."""
    return F.when(metric == "latency_ms", F.coalesce(F.concat(F.floor(x + 0.5).cast("string"), F.lit("ms")), F.lit("--"))).otherwise(shown_score(x))


def shown_time(ts: Column, date_only: bool = False) -> Column:
    """A UTC time as text, blank without one."""
    return F.coalesce(F.date_format(ts, "M/d/yyyy" if date_only else "M/d/yyyy, h:mm:ss a"), F.lit(""))


def title_label(s: Column) -> Column:
    """snake_case as words that begin with capitals; other letters stay."""
    return F.array_join(F.transform(F.split(s, "_"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1_000_000))), " ")


def evidence_label(mode: Column) -> Column:
    named = {"traced_from_synthesis": "Traced from synthesis", "grounded_from_synthesis": "Grounded from synthesis", "grounded_from_manual_answer": "Grounded from manual answer"}
    out = F.when(F.lit(False), "")
    for k, v in named.items():
        out = out.when(mode == k, v)
    return out.otherwise(F.replace(mode, F.lit("_"), F.lit(" ")))


def format_bytes(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024))
        .otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.0fK", n / 1e3)).otherwise(n.cast("string"))


def score_band(score: Column) -> Column:
    p = score * 100
    return F.when(p >= 80, "good").when(p >= 60, "fair").when(score.isNotNull(), "poor")
