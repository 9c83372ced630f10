"""A data source that fetches files from web addresses, one partition an address.

    spark.dataSource.register(FetchSource)
    spark.read.format("fetch").option("urls", json.dumps(urls)).load()

Each address gives one row: the file's bytes, or why there are none. A failure is a row and stops nothing else.
A task that runs again asks again, which changes nothing on the other side.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from plumbline.sources.ingest import MAX_BYTES

SCHEMA = "url string, filename string, status string, message string, content binary"
SECONDS = 60.0
STEP = 1 << 16
_ARROW = pa.schema([("url", pa.string()), ("filename", pa.string()), ("status", pa.string()), ("message", pa.string()), ("content", pa.binary())])


def file_name(path: str) -> str:
    """The last part of an address's path, ``downloaded.pdf`` without one, ending in ``.pdf``."""
    name = path.rsplit("/", 1)[-1] or "downloaded.pdf"
    return name if name.lower().endswith(".pdf") else name + ".pdf"


def body_of(url: str, seconds: float, most: int) -> bytes:
    """The bytes behind an address. Redirects are followed; reading ends beyond ``most`` bytes, after ``seconds`` in
    all, and, as soon as four bytes are there, where they don't begin a PDF."""
    until, parts, size = time.monotonic() + seconds, [], 0
    with urllib.request.urlopen(url, timeout=seconds) as answer:
        told = answer.headers.get("Content-Length")
        if told and told.isdigit() and int(told) > most:
            raise ValueError(f"File exceeds {most // (1024 * 1024)} MB limit")
        while part := answer.read1(STEP):
            parts.append(part)
            size += len(part)
            if size > most:
                raise ValueError(f"File exceeds {most // (1024 * 1024)} MB limit")
            if size >= 4 and not (parts[0] if len(parts[0]) >= 4 else b"".join(parts)).startswith(b"%PDF"):
                break
            if time.monotonic() > until:
                raise TimeoutError("timed out")
    body = b"".join(parts)
    if not body.startswith(b"%PDF"):
        raise ValueError("Downloaded file is not a valid PDF")
    return body


def fetched(url: str | None, seconds: float = SECONDS, most: int = MAX_BYTES) -> tuple:
    """(url, filename, status, message, content) of an address."""
    try:
        parsed = urlparse(url or "")
        if not parsed.scheme or not parsed.netloc:
            raise ValueError(f"Invalid URL: {url}")
        if parsed.scheme not in ("http", "https"):
            raise ValueError(f"Request URL has an unsupported protocol '{parsed.scheme}://'")
        return url, file_name(parsed.path), "processing", None, body_of(url, seconds, most)
    except Exception as e:  # addresses fail in any way; the others go on
        why = f"HTTP {e.code} {e.reason}" if isinstance(e, urllib.error.HTTPError) else str(e) or type(e).__name__
        return url, (url or "").rsplit("/", 1)[-1] or "unknown", "error", f"Download failed: {why[:200]}", None


class _Address(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], seconds: float, most: int):
        self.urls, self.seconds, self.most = urls, seconds, most

    def partitions(self) -> list[InputPartition]:
        return [_Address(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield fetched(partition.value, self.seconds, self.most)


class FetchSource(DataSource):
    """Options: ``urls``, a JSON list of addresses; ``seconds`` and ``maxBytes``, the limits of one."""

    @classmethod
    def name(cls) -> str:
        return "fetch"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        urls = json.loads(self.options.get("urls", "[]"))
        return _Reader(urls, float(self.options.get("seconds", SECONDS)), int(self.options.get("maxBytes", MAX_BYTES)))


def fetch_all(urls: DataFrame, parallel: int = 6, seconds: float = SECONDS, most: int = MAX_BYTES) -> DataFrame:
    """The same rows for the addresses of a table (url), of any number; ``parallel`` bounds how many are under way at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url in batch.column(0).to_pylist():  # a file at a time, as each may be large
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, fetched(url, seconds, most)))], _ARROW)

    return urls.select("url").repartition(parallel).mapInArrow(run, SCHEMA)
