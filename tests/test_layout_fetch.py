"""Layout chunks against plain Python; files fetched from a local server."""

import json
import random
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from plumbline.operators import layout
from plumbline.sources import ingest
from plumbline.sources.fetch import FetchSource, fetch_all, fetched


def plain(lines, size):
    """Every body line with its path and page first; then neighbours of one path run together while they fit."""
    pieces, stack, section = [], {}, 0
    for page, level, text in lines:
        words = (text or "").split()
        if not words:
            continue
        if level:
            stack = {k: v for k, v in stack.items() if k < level} | {level: " ".join(words)}
            section += 1
        else:
            pieces += [(section, " > ".join(stack[k] for k in sorted(stack)) or None, page, words[i : i + size]) for i in range(0, len(words), size)]
    out = []
    for section, path, page, words in pieces:
        if out and out[-1][0] == section and out[-1][4] + len(words) <= size:
            out[-1][3].append(" ".join(words))
            out[-1][4] += len(words)
        else:
            out.append([section, path, page, [" ".join(words)], len(words)])
    return [(i, path, None if page is None else str(page), "\n".join(t), n) for i, (_, path, page, t, n) in enumerate(out)]


def test_layout_against_plain_python(spark):
    rng = random.Random(6)
    docs = []
    for d in range(40):
        lines = [(rng.choice([None, 1, 2]), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice(["", "  ", "a b c", "heading here", "w " * rng.randint(1, 25)])) for _ in range(rng.randint(0, 25))]
        docs.append((d, lines, "old text"))
    docs += [(40, None, "x"), (41, [], "y"), (42, [(1, 1, "only"), (1, 2, "headings")], "z")]
    df = spark.createDataFrame(docs, f"doc_id long, lines {layout.LINES}, text string")
    got = layout.layout_chunks(df, F.col("lines"), 10).collect()
    want = {(d, *c) for d, lines, _ in docs for c in plain(lines or [], 10)}
    assert {(r["doc_id"], r["seq"], r["section_path"], r["page_number"], r["text"], r["token_count"]) for r in got} == want and len(got) == len(want)


def test_lines_of_texts_and_web_pages(spark):
    pages = ["INTRO PART\nbody one is here.\n1. Scope Of Rules\n1.2 Inner Scope\nbody two is here.", None, "2. Next Part\nlast body here."]
    df = spark.createDataFrame([(1, pages)], "doc_id long, pages array<string>")
    got = [(r["section_path"], r["page_number"], r["text"]) for r in layout.layout_chunks(df, layout.text_lines(F.col("pages"))).orderBy("seq").collect()]
    assert got == [("INTRO PART", "1", "body one is here."), ("1. Scope Of Rules > 1.2 Inner Scope", "1", "body two is here."), ("2. Next Part", "3", "last body here.")]
    html = '<title>T</title><ul><li>one</li><LI class="x">two</li></ul><h1>H</h1><p><b>lost</b><p>three &amp; four<h1>I</h1><p>five'
    df = spark.createDataFrame([(1, html)], "doc_id long, html string")
    got = [(r["section_path"], r["text"]) for r in layout.layout_chunks(df, layout.html_lines(F.col("html"), {"title": 1, "h1": 2, "p": 0, "li": 0})).orderBy("seq").collect()]
    assert got == [("T", "one\ntwo"), ("T > H", "three &amp; four"), ("T > I", "five")]


class Pages(BaseHTTPRequestHandler):
    def do_GET(self):
        where = self.path.split("?")[0]
        if where == "/moved.pdf":
            self.send_response(302)
            self.send_header("Location", "/deeper")
            self.end_headers()
        elif where == "/deeper":
            self.send_response(307)
            self.send_header("Location", "/good.pdf")
            self.end_headers()
        elif where == "/gone.pdf":
            self.send_error(404)
        else:
            self.send_response(200)
            if where == "/told.pdf":
                self.send_header("Content-Length", str(10**9))
            self.end_headers()
            if where == "/slow.pdf":
                for _ in range(50):
                    self.wfile.write(b"%PDF" + b"x" * 10)
                    self.wfile.flush()
                    time.sleep(0.1)
            elif where == "/large.pdf":
                for _ in range(64):  # no length is told, so only reading shows it
                    self.wfile.write(b"%PDF" + b"x" * (1 << 15))
            elif where == "/page":
                self.wfile.write(b"<html>" * 100)
            elif where == "/empty.pdf":
                pass
            else:
                self.wfile.write(b"%PDF-1.4 good body")

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_addresses_become_rows(spark, server):
    paths = ["good.pdf?x=1", "moved.pdf", "gone.pdf", "told.pdf", "large.pdf", "slow.pdf", "page", "empty.pdf", ""]
    urls = [f"{server}/{p}" for p in paths] + ["no address", "ftp://h/x.pdf", "http://127.0.0.1:1/closed.pdf"]
    spark.dataSource.register(FetchSource)
    df = spark.read.format("fetch").option("urls", json.dumps(urls)).option("seconds", "1.5").option("maxBytes", str(1 << 20)).load()
    assert df.rdd.getNumPartitions() == len(urls)
    rows = {r["url"]: r for r in df.collect()}
    of = lambda p: (rows[f"{server}/{p}"]["filename"], rows[f"{server}/{p}"]["status"], rows[f"{server}/{p}"]["message"])
    assert of("good.pdf?x=1") == ("good.pdf", "processing", None) and of("moved.pdf") == ("moved.pdf", "processing", None) and of("") == ("downloaded.pdf", "processing", None)
    assert bytes(rows[f"{server}/moved.pdf"]["content"]) == b"%PDF-1.4 good body"
    assert of("gone.pdf")[1:] == ("error", "Download failed: HTTP 404 Not Found")
    assert of("told.pdf")[2] == of("large.pdf")[2] == "Download failed: File exceeds 1 MB limit"
    assert "timed out" in of("slow.pdf")[2]
    assert of("page") == ("page", "error", "Download failed: Downloaded file is not a valid PDF") and of("empty.pdf")[2] == of("page")[2]
    assert rows["no address"]["message"] == "Download failed: Invalid URL: no address" and "unsupported" in rows["ftp://h/x.pdf"]["message"] and rows["http://127.0.0.1:1/closed.pdf"]["status"] == "error"
    assert tuple(ingest.batch_totals(df).first()) == (12, 3, 9)


def test_table_of_addresses_through_to_chunks(spark, server):
    urls = spark.createDataFrame([(f"{server}/good.pdf",), (f"{server}/gone.pdf",), (None,)], "url string")
    rows = fetch_all(urls, 2).cache()
    assert {r["url"]: r["status"] for r in rows.collect()} == {f"{server}/good.pdf": "processing", f"{server}/gone.pdf": "error", None: "error"}
    parsed = ingest.parse_pages(rows.withColumn("problem", F.col("message")), [("text", lambda b: [b.decode()])])
    documents, chunks = ingest.chunk_store(parsed.withColumn("doc_id", F.lit(1)))
    assert [(r["filename"], r["chunk_count"], r["status"]) for r in documents.collect()] == [("good.pdf", 1, "processing")] and chunks.first()["text"] == "%PDF-1.4 good body"
    assert fetched("")[2:4] == ("error", "Download failed: Invalid URL: ")
