"""Secret scans: fixed patterns, and strings that a tokenizer's vocabulary compresses badly.

A byte-pair vocabulary packs several characters of prose or of an identifier into a token; a random
string gets few characters per token. Long unbroken strings below a ratio are reported, after known
digests and identifiers are put aside.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.common import documents

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces of text that the vocabulary's merges apply to.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KINDS = ["assign", "access", "hex", "token"]
SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so runs of 24 and more are the matches that stay
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: UUIDs, and hexadecimal strings as long as the common digests, between other characters than letters and digits.
IDENTIFIER = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})(?![0-9A-Za-z])")
LEAST = 20


class TokenEfficiency:
    """Characters per token under a vocabulary of ranks."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines()) if a}
        self.encoding = tiktoken.Encoding("plumbline", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, s: str, piece: int = 256) -> float:
        return len(s) / sum(len(self.encoding.encode_ordinary(s[i : i + piece])) for i in range(0, len(s), piece))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def random_spans(text: str, taken: list[tuple[int, int, int]], model: TokenEfficiency, below: float, letters_below: float, known: frozenset[str]) -> list[tuple[int, int, int]]:
    """Spans of unbroken strings of few characters per token that no base span touches.

    Digests and UUIDs in a string are put aside; what is left of it counts if it has the least length. Numbers
    alone are no random string; one of letters alone has to lie below ``letters_below``, and parts joined by
    ``_``, ``-`` or ``/`` without a digit are a name.
    """
    found = []
    starts, upto = [a for a, _, _ in taken], list(accumulate((b for _, _, b in taken), max))
    for m in LONG.finditer(text):
        before = bisect_left(starts, m.end())
        if before and upto[before - 1] > m.start() or m[0] in known:
            continue
        rest = IDENTIFIER.sub("", m[0])
        if len(rest) < LEAST or not re.search(r"[A-Za-z]", rest):
            continue
        digits = re.search(r"[0-9]", rest)
        if not digits and re.search(r"[_/-]", rest):
            continue
        if model.ratio(rest) < (below if digits else letters_below):
            found.append((m.start(), 3, m.end()))
    return found


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, vocabulary: str = VOCABULARY, below: float = 2.0, letters_below: float = 1.8, known: Iterable[str] = ()) -> DataFrame:
    """One row per row of ``docs`` with the secrets found in its whole text.

    ``known`` strings (digests of public files, ids of the house) are left alone. A null or empty text
    has no span: counts 0, ``spans`` empty. Repeated rows and null ids give rows of their own; other
    columns of ``docs`` are not read. ``vocabulary`` is read once, on the driver, and broadcast.
    """
    with open(vocabulary, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    known = frozenset(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = TokenEfficiency(ranks.value)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                t = text.as_py() or ""
                base = base_spans(t)
                more = random_spans(t, base, model, below, letters_below, known)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)), len(more)))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)]], names)

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
