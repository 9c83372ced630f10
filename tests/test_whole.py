"""Queries judge all rows of their tables, whatever a source holds."""

import hashlib

import numpy as np

import plumbline.more_queries  # noqa: F401
from plumbline.operators import fulltext
from plumbline.plans.profiles import FINANCE
from plumbline.queries import QUERIES
from tables import SMALL


def test_dedup_near_judges_every_document(spark, tmp_path):
    """One source with more documents than a list holds: every third is a copy of the one before it."""
    rows = [(i, "src1", " ".join(f"w{i - (i % 3 == 2)}x{k}" for k in range(8))) for i in range(950)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["dedup_near"](spark, str(tmp_path)).collect()
    # the copy 800 begins a list of its own
    want = {i for i in range(950) if i % 3 != 2} | {800}
    assert {r["chunk_id"] for r in got} == want
    assert max(r["rank"] for r in got) < 400 and len({r["query_id"] for r in got}) == 3


# --- queries without SQL against plain Python, over the whole small tables ---------------------------------------------


def documents(spark):
    return [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]


def deduplicated(rows, threshold):
    """(id, document, score, text) in order, without those whose words are too like those of one that stays."""
    kept = []
    for r in rows:
        w = set(r[3].lower().split())
        if not any(w | k and len(w & k) / len(w | k) > threshold for _, k in kept):
            kept.append((r, w))
    return [r for r, _ in kept]


def capped(rows, most):
    counts, first, late = {}, [], []
    for r in rows:
        counts[r[1]] = counts.get(r[1], 0) + 1
        (late if counts[r[1]] > most else first).append(r)
    return first + late


def diverse(rows, top_k, least, threshold):
    if least > 1 and len(rows) > top_k:
        best, chosen, seen = {}, [], set()
        for r in rows:
            best[r[1]] = max(best.get(r[1], -1), r[2])
        for r in rows:
            if len(seen) < least and r[1] not in seen and best[r[1]] >= threshold:
                chosen.append(r)
                seen.add(r[1])
        rows = chosen + [r for r in rows if r not in chosen]
    return rows[:top_k]


def test_retrieve_pipeline_against_plain_python(spark):
    """Vectors, keywords, fusion, near-duplicates, the cap for each document, and diversity, one question after the other."""
    s = FINANCE.retrieval
    docs = {i: t for i, _, t in documents(spark)}
    rows = [r for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect() if r["vec_id"] in docs]
    unit = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    every = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    label = {r["vec_id"]: f"label {r['label']}" for r in rows}
    held = {i: fulltext.places(docs[i]) for i in unit}
    depth = min(400, max(s.rerank_depth, 10 * s.rerank_depth))
    want = {}
    for q in sorted(i for i in docs if i % 50 == 0):
        asked = sorted(fulltext.places(docs[q]))
        scores = {i: round(fulltext.rank_of([np.array(p[a]) for a in asked]), 6) for i, p in held.items() if asked and all(a in p for a in asked)}
        keyword = sorted(scores, key=lambda i: (-scores[i], i))[:depth]
        vector = []
        if q in every:
            v = every[q] / np.linalg.norm(every[q])
            away = {i: 1 - u @ v for i, u in unit.items()}
            vector = sorted(away, key=lambda i: (round(away[i], 12), i))[:depth]
        if vector and keyword:
            fused, first = {}, {}
            for at, lst in enumerate((vector, keyword)):
                for rank, i in enumerate(lst):
                    fused[i] = fused.get(i, 0) + 1 / (61 + rank)
                    first.setdefault(i, (at, rank))
            order = sorted(fused, key=lambda i: (-round(fused[i], 12), first[i], i))
            listed = [(i, label[i], round(fused[i], 4), docs[i]) for i in order]
        elif vector:
            listed = [(i, label[i], round(1 - away[i], 4), docs[i]) for i in vector]
        else:
            listed = [(i, label[i], round(scores[i], 4), docs[i]) for i in keyword]
        listed = capped(deduplicated(listed, s.dedup_threshold), s.max_per_document)
        want[q] = [(i, d, sc) for i, d, sc, _ in diverse(listed, s.top_k, s.diversity_min, s.diversity_threshold)]
    got = {}
    for r in QUERIES["retrieve_pipeline"](spark, SMALL).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["document"], r["score"]))
    assert {q for q, w in want.items() if w} == set(got)
    for q, rows in got.items():
        assert [r[:2] for r in rows] == [w[:2] for w in want[q]] and all(abs(a[2] - b[2]) <= 1e-4 for a, b in zip(rows, want[q]))


def test_subquery_swap_against_plain_python(spark):
    docs, lists = documents(spark), {}
    for sub, (a, m) in enumerate([(7, 1009), (11, 1013), (13, 1019)]):
        for q in range(10):
            mine = sorted(((i * a % m / m, i, s) for i, s, _ in docs if i % 10 == q), key=lambda x: (-x[0], x[1]))[:20]
            lists.setdefault(q, []).append(mine)
    want = set()
    for q, three in lists.items():
        best, seen = {}, {}
        for sub, mine in enumerate(three):
            for rank, (score, i, source) in enumerate(mine):
                seen.setdefault(i, (sub, rank))
                if i not in best or score > best[i][0]:
                    best[i] = (score, sub, source)
        merged = [(i, best[i][2], best[i][0], best[i][1]) for i in sorted(best, key=lambda i: (-best[i][0], seen[i], i))]
        out = [(i, score, sub) for i, _, score, sub in diverse(merged, 5, 3, 0.9)]
        for sub in sorted({m[3] for m in merged} - {c[2] for c in out}):
            i, _, score, _ = next(m for m in merged if m[3] == sub)
            if score < 0.8 * 1.1:
                continue
            worst = min(range(len(out)), key=lambda k: out[k][1])
            if len(out) < 5:
                out.append((i, score, sub))
            elif score > out[worst][1]:
                out[worst] = (i, score, sub)
        want |= {(q, rank, *c) for rank, c in enumerate(out)}
    got = {(r["query_id"], r["rank"], r["chunk_id"], r["score"], r["sub_query"]) for r in QUERIES["subquery_swap"](spark, SMALL).collect()}
    assert got == want


def test_reasoning_strip_gives_the_text_back(spark):
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    wrong = []
    for r in QUERIES["reasoning_strip"](spark, SMALL).collect():
        text, kind = texts[r["conv_id"], r["turn"]].strip(), r["conv_id"] % 4
        said = f"Okay, let me think about it.\n\nIn summary\n\n{text}"
        if "think" in text.lower() or "\n\n" in text:
            continue  # texts that look like reasoning themselves
        if r["answer"] != (text if kind != 2 or len(text) >= 80 else said.strip()):
            wrong.append((kind, text, r["answer"]))
    assert not wrong and len(texts) > 50


def test_balanced_sample_against_plain_python(spark):
    sizes, ids = {}, {}
    for i, _, _ in documents(spark):
        d = i * 7 % 13 % 7
        sizes[d] = sizes.get(d, 0) + 1
        ids.setdefault(d, []).append(i)
    rest = 50 - sum(min(n, 2) for n in sizes.values())
    left, total = {d: n - 2 for d, n in sizes.items() if n > 2}, sum(n - 2 for n in sizes.values() if n > 2)
    want = set()
    for d in sorted(sizes):
        share = min(max(1, round(rest_before * left[d] / total)), left[d], rest) if (rest_before := rest) >= 0 and d in left else 0
        rest -= share
        order = sorted(ids[d], key=lambda i: (hashlib.md5(f"0:{i}".encode()).hexdigest(), i))
        want |= {(d, i) for i in order[: min(sizes[d], 2) + share]}
    got = {(r["document_id"], r["chunk_id"]) for r in QUERIES["balanced_sample"](spark, SMALL).collect()}
    assert got == want


def test_indexed_search_finds_most_of_the_exact_result(spark):
    exact = {(r["query_id"], r["chunk_id"]) for r in QUERIES["vector_topk"](spark, SMALL).collect()}
    found = {(r["query_id"], r["chunk_id"]) for r in QUERIES["vector_topk_indexed"](spark, SMALL).collect()}
    assert len(exact & found) >= 0.9 * len(exact) and len(found) == len(exact)


def test_texts_that_were_not_found_go_through_no_shuffle(spark):
    """Ids that were found meet the documents below the join that chunks are made of."""
    from plumbline.operators.retrieval import narrowed
    from plumbline.run_queries import _chunks

    chunks = _chunks(spark, SMALL)
    found = spark.createDataFrame([(3,), (10,), (17,), (999999,)], "chunk_id long")
    few = narrowed(chunks.hint("merge"), found).select("chunk_id", "text")
    lines = few._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda kind: min(len(x) - len(x.lstrip(" :+-")) for x in lines if f"Join {kind}" in x)
    assert depth("LeftSemi") > depth("Inner")
    want = chunks.join(found, "chunk_id").select("chunk_id", "text")
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, want.collect())) != []
    assert narrowed(chunks, found, 2) is chunks


def test_texts_and_vectors_meet_once_for_all_searches(spark, monkeypatch):
    """What ``retrieve`` reads several times is no join any more."""
    from plumbline.operators import retrieval

    seen = []
    whole = retrieval.retrieve
    monkeypatch.setattr(retrieval, "retrieve", lambda chunks, *rest: seen.append(chunks) or whole(chunks, *rest))
    QUERIES["retrieve_pipeline"](spark, SMALL)
    (chunks,) = seen
    assert "Join" not in chunks._jdf.queryExecution().optimizedPlan().toString()
    texts, vectors = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "embeddings"))
    want = texts.join(vectors, texts["doc_id"] == vectors["vec_id"]).select("doc_id", "text")
    assert sorted(map(tuple, chunks.select("chunk_id", "text").collect())) == sorted(map(tuple, want.collect())) != []
