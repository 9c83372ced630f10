"""Retrieval for many questions at once: top-k searches, fusion, near-duplicate removal, diversity.

Candidates are rows ``(query_id, chunk_id, rank, score)`` with a rank from 0; lists are ordered by rank,
and ties end with the chunk's id. All operators work per ``query_id``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import words
from plumbline.operators.fulltext import keyword_search
from plumbline.plans.profiles import Retrieval
from plumbline.sources.storage import settled

POOL_CAP = 400


def search_depth(doc_count: Column, rerank_depth: int, diversity_min: int, cap: int = POOL_CAP) -> Column:
    """Size of the candidate pool; wider with more documents, up to a cap, if diversity is asked for."""
    if diversity_min <= 1:
        return F.lit(rerank_depth)
    return F.least(F.lit(cap), F.greatest(F.lit(rerank_depth), doc_count * rerank_depth))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 0 per query in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def vector_search(chunks: DataFrame, queries: DataFrame, k: int, block: int = 2048, grid: int = 16384) -> DataFrame:
    """The ``k`` chunks (chunk_id, embedding) nearest to each query (query_id, embedding) by cosine distance.

    Up to ``block`` queries are broadcast, and chunks stay where they are: a batch of chunks meets them in one
    matrix product and keeps its own best ``k``. More queries are dealt, as the chunks are, into blocks of
    some ``grid`` vectors; each pair of blocks meets in a task, so the chunks are read once and travel once
    for each block of queries. A window takes the best of the bests. Null embeddings are left out; the score
    is one minus the distance, rounded to 4 digits.
    """
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    usable = chunks.filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").cast("long").alias("chunk_id"), vector)
    rows = queries.filter(F.col("embedding").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), vector)
    schema = "query_id long, chunk_id long, distance double"
    total = rows.count()
    if total <= block:
        out = usable.mapInArrow(_nearest([(r[0], r[1]) for r in rows.collect()], k), schema)
    else:
        n_queries, n_chunks = (max(1, -(-n // grid)) for n in (total, usable.count()))
        dealt = lambda df, c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = rows.withColumn("_q", dealt(rows, "query_id", n_queries)).withColumn("_c", every(n_chunks))
        c = usable.withColumn("_c", dealt(usable, "chunk_id", n_chunks)).withColumn("_q", every(n_queries))
        out = q.groupBy("_q", "_c").cogroup(c.groupBy("_q", "_c")).applyInArrow(_best_of_blocks(k), schema)
    best = ranked(out, F.col("distance"), F.col("chunk_id")).filter(F.col("rank") < k)
    return best.select("query_id", "chunk_id", "rank", F.round(1 - F.col("distance"), 4).alias("score"))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _best(ids: np.ndarray, q: np.ndarray, cid: np.ndarray, m: np.ndarray, k: int, cells: int = 1 << 19) -> pa.RecordBatch:
    """The ``k`` nearest of the chunks for each query, both given as unit vectors.

    Some ``cells`` distances are held at a time, and of them what is not further than the ``k`` nearest so far.
    """
    width = max(1, min(len(ids), 1024))
    height = max(1, cells // width)
    out = []
    for x in range(0, len(ids), width):
        col, near, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(ids[x : x + width]), np.inf)
        for y in range(0, len(cid), height):
            d = 1 - m[y : y + height] @ q[x : x + width].T
            if len(d) > k:
                least = np.fmin(least, np.partition(d, k - 1, axis=0)[k - 1])
            row, c = np.nonzero(~(d > least))  # what is no number comes last
            col, near, dist = np.r_[col, c], np.r_[near, cid[y : y + height][row]], np.r_[dist, d[row, c]]
            order = np.lexsort((near, dist, col))
            place = np.arange(len(order)) - np.searchsorted(col[order], col[order])
            order = order[place < k]
            col, near, dist = col[order], near[order], dist[order]
            full = np.flatnonzero(np.bincount(col, minlength=len(least)) == k)
            least[full] = dist[np.searchsorted(col, full, side="right") - 1]
        out.append((ids[x + col], near, dist))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "chunk_id", "distance"])


def _nearest(queries: list[tuple[int, list[float]]], k: int):
    ids = np.array([q for q, _ in queries], dtype=np.int64)
    q = _unit(np.array([v for _, v in queries], dtype=np.float64)) if queries else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and len(ids):
                yield _best(ids, q, batch.column(0).to_numpy(), _unit(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)), k)

    return run


def _best_of_blocks(k: int, step: int = 512):
    def run(queries: pa.Table, chunks: pa.Table) -> pa.Table:
        sides = []
        for t, name in ((queries, "query_id"), (chunks, "chunk_id")):
            flat = t.column("embedding").combine_chunks().flatten().to_numpy()
            sides += [t.column(name).to_numpy(), _unit(flat.reshape(max(t.num_rows, 1), -1)) if t.num_rows else None]
        ids, q, cid, m = sides
        parts = [_best(ids[i : i + step], q[i : i + step], cid, m, k) for i in range(0, len(ids) if len(cid) else 0, step)]
        empty = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("distance", pa.float64())])
        return pa.Table.from_batches(parts, empty)

    return run


def rank_fusion(lists: list[DataFrame], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: the sum of ``1 / (k + rank + 1)``; ties in order of first appearance.

    Rounded to 4 digits after sorting.
    """
    parts = [d.select("query_id", "chunk_id", "rank", F.lit(i).alias("list")) for i, d in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    fused = every.groupBy("query_id", "chunk_id").agg(F.sum(F.lit(1.0) / (k + 1 + F.col("rank"))).alias("_sum"), F.min(F.struct("list", "rank")).alias("_first"))
    out = ranked(fused, F.round("_sum", 12).desc(), F.col("_first"), F.col("chunk_id"))
    return out.select("query_id", "chunk_id", "rank", F.round("_sum", 4).alias("score"))


def drop_near_duplicates(candidates: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Candidates (with ``text`` or ``words``) whose word set is not too like that of a better one that stays.

    The greedy order is kept. A query's list is bounded by the search depth, so it is one small group:
    word sets become hashes before they travel, all shared counts come from a product of incidence
    matrices, and the walk down the list looks up similarities. A threshold of 1 and more changes nothing.
    """
    if threshold >= 1:
        return candidates
    sets = F.col("words") if "words" in candidates.columns else word_set(F.col("text"))
    lists = candidates.select(F.col("query_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("rank").cast("int").alias("rank"), sets.alias("words"))
    kind = dict(candidates.dtypes)["query_id"]

    def keep(group: pa.Table) -> pa.Table:
        group = group.sort_by([("rank", "ascending"), ("chunk_id", "ascending")]).combine_chunks()
        lists = group.column("words").chunk(0)
        size = np.diff(lists.offsets.to_numpy())
        shared = _shared_counts(lists.flatten().to_numpy(), size)
        like = shared > threshold * (size[:, None] + size[None, :] - shared)
        kept: list[int] = []
        for i in range(len(size)):
            if not like[i, kept].any():
                kept.append(i)
        return group.select(["query_id", "chunk_id"]).take(pa.array(kept))

    ids = lists.groupBy("query_id").applyInArrow(keep, f"query_id {kind}, chunk_id long")
    return candidates.join(ids, ["query_id", "chunk_id"], "left_semi")


def word_set(text: Column) -> Column:
    """Hashes of the distinct lower-cased words of a text."""
    return F.array_distinct(F.transform(words(F.lower(text)), lambda w: F.xxhash64(w)))


def _shared_counts(values: np.ndarray, size: np.ndarray, width: int = 4096) -> np.ndarray:
    """How many values each two of the sets share."""
    owner = np.repeat(np.arange(len(size)), size)
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    often = count[column] > 1
    owner, column = owner[often], np.unique(column[often], return_inverse=True)[1]
    out = np.diag(size).astype(np.float64)
    for a in range(0, int(column.max()) + 1 if len(column) else 0, width):
        inside = (column >= a) & (column < a + width)
        m = np.zeros((len(size), width), dtype=np.float32)
        m[owner[inside], column[inside] - a] = 1
        product = (m @ m.T).astype(np.float64)
        np.fill_diagonal(product, 0)
        out += product
    return out


def cap_per_document(candidates: DataFrame, most: int | None) -> DataFrame:
    """New ranks: chunks (with ``document``) beyond ``most`` of their document come after all others."""
    if not most:
        return candidates
    place = F.row_number().over(Window.partitionBy("query_id", "document").orderBy("rank", "chunk_id"))
    return ranked(candidates.withColumn("_late", place > most).withColumnRenamed("rank", "_rank"), F.col("_late"), F.col("_rank"), F.col("chunk_id")).drop("_late", "_rank")


def select_diverse(candidates: DataFrame, top_k: int, diversity_min: int, threshold: float = 0.3) -> DataFrame:
    """The ``top_k``: first one chunk of each of up to ``diversity_min`` documents that qualify, then by rank.

    A document qualifies if its best score reaches the threshold. Without a demand for diversity, or with
    ``top_k`` candidates or fewer, the first ``top_k`` by rank.
    """
    by_doc = Window.partitionBy("query_id", "document")
    all_ = Window.partitionBy("query_id")
    df = candidates.withColumns({
        "_n": F.count(F.lit(1)).over(all_),
        "_first": (F.row_number().over(by_doc.orderBy("rank", "chunk_id")) == 1) & (F.max("score").over(by_doc) >= threshold),
    })
    order = F.row_number().over(Window.partitionBy("query_id", "_first").orderBy("rank", "chunk_id"))
    df = df.withColumn("_sure", F.col("_first") & (order <= diversity_min) & (F.lit(diversity_min) > 1) & (F.col("_n") > top_k))
    out = ranked(df.withColumnRenamed("rank", "_rank"), (~F.col("_sure")), F.col("_rank"), F.col("chunk_id"))
    return out.filter(F.col("rank") < top_k).drop("_n", "_first", "_sure", "_rank")


def recent_chunks(chunks: DataFrame, top_k: int) -> DataFrame:
    """The newest chunks of documents that are not deleted, with score 0: what is left when no search works."""
    newest = chunks.filter(F.col("deleted_at").isNull()).orderBy(F.col("created_at").desc(), F.col("chunk_id").desc()).limit(top_k)
    w = Window.orderBy(F.col("created_at").desc(), F.col("chunk_id").desc())
    return newest.withColumns({"rank": F.row_number().over(w) - 1, "score": F.lit(0.0)})


def ready_documents(documents: DataFrame) -> DataFrame:
    """One row with the number ``n`` of documents that are ready and not deleted."""
    return documents.filter((F.col("status") == "ready") & F.col("deleted_at").isNull()).agg(F.count(F.lit(1)).alias("n"))


def narrowed(chunks: DataFrame, found: DataFrame, most: int = 200_000) -> DataFrame:
    """``chunks`` without those that are not in ``found``, if that has ``most`` rows at most: their ids then travel to where the
    texts are read, below the joins that ``chunks`` are made of, and other texts go through no shuffle. Counts ``found``."""
    ids = found.select("chunk_id")
    return chunks.join(F.broadcast(ids), "chunk_id", "left_semi") if ids.count() <= most else chunks


def retrieve(chunks: DataFrame, queries: DataFrame, settings: Retrieval, doc_count: int | DataFrame = 1, cap: int = POOL_CAP) -> DataFrame:
    """The whole pipeline for queries (query_id, text, embedding) over chunks (chunk_id, text, document, embedding).

    Queries with an embedding get the vector list, fused with the keyword list where that has rows. Those
    without one get the keyword list alone, and where it is empty the newest chunks as they are, if the
    chunks have ``created_at`` and ``deleted_at``; deleted ones are never found then. ``doc_count`` is the
    number of ready documents or the result of ``ready_documents``.
    """
    n_docs = 1 if settings.diversity_min <= 1 else doc_count if isinstance(doc_count, int) else doc_count.first()["n"]
    depth = settings.rerank_depth if settings.diversity_min <= 1 else min(cap, max(settings.rerank_depth, n_docs * settings.rerank_depth))
    dated = {"created_at", "deleted_at"} <= set(chunks.columns)
    shown = chunks.filter(F.col("deleted_at").isNull()) if dated else chunks
    merged = settled(vector_search(shown, queries, depth))  # some hundred rows a query, as the other lists
    without_vector = queries.filter(F.col("embedding").isNull()).select("query_id")
    if settings.keyword_enabled:
        keyword = settled(keyword_search(shown, queries, depth))
        with_vector = queries.filter(F.col("embedding").isNotNull()).select("query_id")
        hybrid = keyword.select("query_id").distinct().join(with_vector, "query_id", "left_semi")
        fused = rank_fusion([merged.join(hybrid, "query_id", "left_semi"), keyword.join(hybrid, "query_id", "left_semi")])
        merged = fused.unionByName(merged.join(hybrid, "query_id", "left_anti")).unionByName(keyword.join(with_vector, "query_id", "left_anti"))
        without_vector = without_vector.join(keyword.select("query_id").distinct(), "query_id", "left_anti")
    # word sets are made once for each chunk, not for each query that finds it
    full = settled(merged.join(narrowed(shown, merged).select("chunk_id", "document", word_set(F.col("text")).alias("words")), "chunk_id"))
    out = finish(full, settings).drop("words")
    if not dated:
        return out
    newest = recent_chunks(chunks, settings.top_k).select("chunk_id", "document", "rank", "score")
    return out.unionByName(without_vector.crossJoin(F.broadcast(newest)).select(*out.columns))  # top_k rows for each such query


def retrieve_merged(chunks: DataFrame, queries: DataFrame, settings: Retrieval, doc_count: int | DataFrame = 1) -> DataFrame:
    """One selection for each query from several texts (query_id, sub_query, text, embedding), numbered from 0.

    Each text is searched by itself. A query of one text keeps its list; the lists of others are merged, freed
    of near-duplicates and made diverse again, and texts without a chunk may bring their best one.
    """
    numbered = settled(queries.withColumn("_key", F.xxhash64("query_id", "sub_query")))
    sizes = numbered.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    found = retrieve(chunks, numbered.select(F.col("_key").alias("query_id"), "text", "embedding"), settings, doc_count).withColumnRenamed("query_id", "_key")
    lists = settled(found.join(numbered.select("_key", "query_id", "sub_query"), "_key").join(sizes, "query_id"))
    columns = ["query_id", "sub_query", "chunk_id", "document", "score", "rank"]
    alone = lists.filter("n = 1").select(*columns)
    pool = settled(merge_sub_queries(lists.filter("n > 1").select(*columns)))
    few = narrowed(chunks, pool)
    pool = pool.join(few.select("chunk_id", word_set(F.col("text")).alias("words")), "chunk_id")
    pool = settled(drop_near_duplicates(settled(pool), settings.dedup_threshold))
    chosen = select_diverse(cap_per_document(pool, settings.max_per_document), settings.top_k, settings.diversity_min, settings.diversity_threshold)
    if settings.represent_sub_queries:
        swapped = represent_sub_queries(chosen, pool, settings.top_k, settings.diversity_threshold, settings.swap_multiplier)
        chosen = swapped.join(few.select("chunk_id", "document"), "chunk_id")
    return alone.unionByName(chosen.select(*columns))


def finish(candidates: DataFrame, settings: Retrieval) -> DataFrame:
    kept = cap_per_document(drop_near_duplicates(candidates, settings.dedup_threshold), settings.max_per_document)
    return select_diverse(kept, settings.top_k, settings.diversity_min, settings.diversity_threshold)


def merge_sub_queries(lists: DataFrame) -> DataFrame:
    """One list per query from lists (query_id, sub_query, chunk_id, rank, score) of its sub-queries.

    A chunk keeps its highest score and the sub-query that gave it, the first of equals; chunks are
    sorted by score, ties in order of first appearance.
    """
    w = Window.partitionBy("query_id", "chunk_id")
    df = lists.withColumns({
        "_n": F.row_number().over(w.orderBy(F.col("score").desc(), F.col("sub_query"), F.col("rank"))),
        "_seen": F.min(F.struct("sub_query", "rank")).over(w),
    })
    return ranked(df.filter("_n = 1").drop("_n", "rank"), F.col("score").desc(), F.col("_seen"), F.col("chunk_id")).drop("_seen")


def debug_merge(lists: DataFrame) -> DataFrame:
    """As ``merge_sub_queries``, but the first appearance of a chunk counts, not its best score."""
    w = Window.partitionBy("query_id", "chunk_id").orderBy("sub_query", "rank")
    first = lists.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("rank", "_rank")
    return ranked(first, F.col("score").desc(), F.col("sub_query"), F.col("_rank"), F.col("chunk_id")).drop("_rank")


def document_rollup(candidates: DataFrame, threshold: float) -> DataFrame:
    """Chunks, best score and whether it qualifies, for each document of a query, best first."""
    out = candidates.groupBy("query_id", "document").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("score").alias("best_score"))
    out = out.withColumn("qualifies", F.col("best_score") >= threshold)
    return ranked(out, F.col("best_score").desc(), F.col("document"))


def represent_sub_queries(selected: DataFrame, merged: DataFrame, top_k: int, threshold: float, multiplier: float = 1.1) -> DataFrame:
    """``selected`` after each sub-query without a chunk in it had the chance to bring its best one.

    ``merged`` is the deduplicated list with ``sub_query``. A sub-query's best chunk comes in if its score
    reaches ``threshold * multiplier``: at the end while there is room, else in place of the chunk with the
    lowest score, the first of equals, if it is better. A fold over a query's few sub-queries, in order.
    """
    kind = "array<struct<rank:int,chunk_id:bigint,score:double,sub_query:int>>"
    listed = lambda first: F.array_sort(F.collect_list(F.struct(first, "rank", F.col("chunk_id").cast("long").alias("chunk_id"), "score", F.col("sub_query").cast("int").alias("sub_query"))))
    chosen = selected.groupBy("query_id").agg(listed(F.col("rank").alias("at")).alias("_chosen"))
    best = F.row_number().over(Window.partitionBy("query_id", "sub_query").orderBy("rank", "chunk_id"))
    pool = merged.withColumn("_n", best).filter("_n = 1").groupBy("query_id").agg(listed(F.col("sub_query").alias("at")).alias("_pool"))
    plain = lambda a: F.transform(a, lambda x: F.struct(x["rank"], x["chunk_id"], x["score"], x["sub_query"])).cast(kind)
    both = chosen.join(pool, "query_id", "left").select("query_id", plain(F.col("_chosen")).alias("_chosen"), plain(F.coalesce("_pool", F.array().cast("array<struct<at:int,rank:int,chunk_id:bigint,score:double,sub_query:int>>"))).alias("_pool"))
    present = F.transform("_chosen", lambda c: c["sub_query"])
    missing = F.filter("_pool", lambda b: ~F.array_contains(present, b["sub_query"]) & (b["score"] >= threshold * multiplier))

    def step(acc: Column, b: Column) -> Column:
        scores = F.transform(acc, lambda c: c["score"])
        worst = F.array_position(scores, F.array_min(scores)) - 1
        swapped = F.transform(acc, lambda c, i: F.when(i == worst, b).otherwise(c))
        return F.when(F.size(acc) < top_k, F.concat(acc, F.array(b))).when(b["score"] > F.array_min(scores), swapped).otherwise(acc)

    folded = both.select("query_id", F.posexplode(F.aggregate("_chosen", F.array().cast(kind), lambda a, c: F.concat(a, F.array(c)), lambda start: F.aggregate(missing, start, step))).alias("rank", "c"))
    return folded.select("query_id", "rank", "c.chunk_id", "c.score", "c.sub_query")


def low_confidence(selected: DataFrame, bound: float = 0.5) -> DataFrame:
    """Queries with results, and whether all scores lie below the bound."""
    return selected.groupBy("query_id").agg((F.max("score") < bound).alias("low_confidence"))


def corpus_snapshot(documents: DataFrame) -> DataFrame:
    """One row: ready documents that are not deleted, by id, with totals."""
    ready = documents.filter((F.col("status") == "ready") & F.col("deleted_at").isNull())
    listed = F.array_sort(F.collect_list(F.struct("document_id", "filename", "chunk_count")))
    return ready.agg(listed.alias("documents"), F.count(F.lit(1)).alias("total_documents"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("total_chunks"))
