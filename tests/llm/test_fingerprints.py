import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import fingerprints as P


def phrases(text):
    """The dictionary of the plain parse, symbol by symbol."""
    seen, now = set(), ""
    for c in text:
        now += c
        if now not in seen:
            seen.add(now)
            now = ""
    return seen


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def texts():
    rng = random.Random(4)
    words = [rng.choice(["the", "of", "and", "café", "東京", "x", "running", "a"]) for _ in range(900)]
    return ["", "a", "ab", "aaaa", "a" * 5000, "abcabcabcabc", " ".join(words), " ".join(words[:300]), "𝔘nicode 𝔘nicode", "\n\t ", "x" * 17 + "y"]


def test_parse_finds_the_phrases():
    for t in texts():
        p = P.Parse(t)
        assert len(p.found) == len(p.seen) and p.seen == phrases(t) and "".join(p.found) + p.under_way == t


def test_parse_goes_on_and_back():
    for t in texts():
        for left in {0, 1, len(t) // 3, len(t) // 2, len(t)}:
            p = P.Parse(t[:left])
            mark = p.mark()
            for more in (t[left:], "other text, other phrases " * 5, t[left:]):
                p.extend(more)
                assert p.found == P.Parse(t[:left] + more).found
                p.back(mark)
            assert p.found == P.Parse(t[:left]).found and p.seen == set(p.found)


def test_hashes_tell_phrases_apart():
    every = sorted(set().union(*(phrases(t) for t in texts())))
    one_by_one = [int(P.hashes_of([p])[0]) for p in every]
    assert len(set(one_by_one)) == len(every) and P.hashes_of(every).tolist() == one_by_one


def test_likeness_of_whole_sets_is_exact_and_estimates_are_near():
    rng = random.Random(8)
    prose = [" ".join(rng.choice(["data", "model", "spark", "text", "near", "far", "copy", "shard"]) + str(rng.randint(0, 9)) for _ in range(600)) for _ in range(4)]
    pairs = [(a, b) for a in [*texts(), *prose] for b in [*texts(), *prose, prose[0][:1500] + prose[1][1500:]]]
    for a, b in pairs:
        x, y = P.fingerprint(a), P.fingerprint(b)
        got, want = P.alike(x, y), jaccard(phrases(a), phrases(b))
        if len(x) < P.K and len(y) < P.K:
            assert got == pytest.approx(want)
        else:
            assert abs(got - want) < 0.2
        assert (got == 1.0) == (x.tolist() == y.tolist())


def test_column_form_agrees(spark):
    prints = [P.written(P.fingerprint(t)) for t in texts()]
    rows = [(a, b, P.alike(*(np.array([int(s[i : i + P.DIGITS], 16) for i in range(0, len(s), P.DIGITS)], dtype=np.uint64) for s in (a, b)))) for a in prints for b in prints]
    df = spark.createDataFrame([*rows, (None, "", None)], "a string, b string, want double")
    got = df.withColumn("got", P.likeness(F.col("a"), F.col("b"))).collect()
    assert all((r["got"] is None) == (r["want"] is None) and (r["got"] is None or abs(r["got"] - r["want"]) < 1e-12) for r in got)


def test_fingerprints_keep_rows_and_replace_their_column(spark):
    rows = [(i, t, "old", 5) for i, t in enumerate([*texts(), None, "abcabcabcabc"])]
    out = P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, _text int")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in out] == list(range(len(rows))) and out[0]["_text"] == 5
    assert out[0]["fingerprint"] == out[11]["fingerprint"] == "" and out[5]["fingerprint"] == out[12]["fingerprint"]
    assert P.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def expected(rows):
    """(doc_id, n_chars, edited digest, likeness of whole sets) in descending order of ids, which have to differ."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0]), reverse=True)
    out = []
    for k, (i, t) in enumerate(rows):
        t, follow = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follow[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.written(P.fingerprint(edited)), edited, follow))
    return out


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_edited_texts(spark, frame, corpus, partitions):
    rows = [*corpus, *((100 + i, t) for i, t in enumerate(texts())), (None, "no id here, no id there")]
    got = {r["doc_id"]: r for r in P.with_edited(frame(rows).repartition(partitions)).collect()}
    want = expected(rows)
    assert len(got) == len(want)
    for i, n, digest, fingerprint, edited, follow in want:
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["edited_fingerprint"]) == (n, digest, fingerprint)
        t = dict(rows)[i] or ""
        for name, other in (("near_edited", edited), ("near_next", follow)):
            assert r[name] == pytest.approx(P.alike(P.fingerprint(t), P.fingerprint(other)))


def test_one_row_no_rows_and_repeated_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert P.with_edited(make([])).count() == 0
    (r,) = P.with_edited(make([(5, "abcdef")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and r["near_next"] == 1.0
    rows = [(1, "same text")] * 200 + [(None, "other")] * 100 + [(1, "third text")] * 3 + [(7, None)]
    got = P.with_edited(make(rows).repartition(9)).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in got) == sorted((i is not None, i) for i, _ in rows)
    assert sum(r["near_next"] < 1 for r in got) == 4  # where runs of equal rows end
