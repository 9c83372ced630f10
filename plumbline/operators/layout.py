"""Chunks from laid-out documents: lines with their page and heading level become text under a path of headings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import is_heading, strip

CHUNK = "seq int, section_path string, page_number string, text string, token_count int"
LINES = "array<struct<page:int,level:int,text:string>>"
JOINT = " > "


class LayoutChunks:
    """Table function from a document's lines (page, level, text) and the most words of a chunk to its chunks.

    A line of level 1 and more is a heading: it ends the chunk before it, and takes the place of all headings of its level
    and below in the path. Lines of level 0 are body: they are joined while they fit, and a longer one is cut.
    A chunk bears the page of its first line. Blank lines give nothing, nor do headings without a body.
    """

    def eval(self, lines: list, size: int) -> Iterator[tuple]:
        path: list[tuple[int, str]] = []
        held: list[str] = []
        words, page, seq = 0, None, 0

        def chunk() -> tuple:
            where = JOINT.join(t for _, t in path) if path else None
            return seq, where, None if page is None else str(page), "\n".join(held), words

        for line in lines or []:
            text = " ".join((line["text"] or "").split())
            if not text:
                continue
            if line["level"] and line["level"] > 0:
                if held:
                    yield chunk()
                    held, words, seq = [], 0, seq + 1
                while path and path[-1][0] >= line["level"]:
                    path.pop()
                path.append((line["level"], text))
                continue
            tokens = text.split(" ")
            for i in range(0, len(tokens), size):
                part = tokens[i : i + size]
                if held and words + len(part) > size:
                    yield chunk()
                    held, words, seq = [], 0, seq + 1
                if not held:
                    page = line["page"]
                held.append(" ".join(part))
                words += len(part)
        if held:
            yield chunk()


def text_lines(pages: Column) -> Column:
    """Lines of a document's pages (array of texts). A numbered heading has as many levels as numbers, any other one."""
    number = lambda t: F.regexp_extract(t, r"^(\d+(?:\.\d+)*)\.?\s", 1)
    level = lambda t: F.when(~is_heading(t), 0).when(number(t) != "", F.size(F.split(number(t), r"\."))).otherwise(1)
    line = lambda t, page: F.struct((page + 1).cast("int").alias("page"), level(t).cast("int").alias("level"), t.alias("text"))
    return F.flatten(F.transform(pages, lambda p, i: F.transform(F.split(F.coalesce(p, F.lit("")), "\n"), lambda t: line(strip(t), i)))).cast(LINES)


def html_lines(html: Column, levels: dict[str, int]) -> Column:
    """Lines of a web page: what follows the opening tags of ``levels`` up to the next tag; level 0 is body."""
    pattern = F.lit(rf"(?i)<({'|'.join(levels)})(?:\s[^>]*)?>([^<]*)")
    level = F.create_map(*[x for tag, n in levels.items() for x in (F.lit(tag), F.lit(n))])
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("tag"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("text"))
    return F.transform(both, lambda x: F.struct(F.lit(None).cast("int").alias("page"), level[F.lower(x["tag"])].alias("level"), x["text"].alias("text"))).cast(LINES)


def layout_chunks(docs: DataFrame, lines: Column, size: int = 400) -> DataFrame:
    """``docs`` joined to the chunks of their lines: (.., seq, section_path, page_number, text, token_count), row by row."""
    table = F.udtf(LayoutChunks, returnType=CHUNK)
    kept = [c for c in docs.columns if c not in ("seq", "section_path", "page_number", "text", "token_count")]
    return docs.select(*kept, lines.alias("_lines")).lateralJoin(table(F.col("_lines").outer(), F.lit(size))).drop("_lines")
