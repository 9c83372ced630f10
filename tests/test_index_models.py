"""The coarse index against the exact search; model names against all pairs; snapshots of model metadata."""

import json
import random

import numpy as np
import pytest

from plumbline.operators import compare, retrieval, vector_index
from plumbline.sources import ingest
from tables import SMALL


def vectors(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>")


def asked(df, condition="chunk_id % 20 = 0"):
    return df.filter(condition).withColumnRenamed("chunk_id", "query_id")


@pytest.fixture
def clustered(spark):
    """Thirty directions, one of which a third of all rows has exactly, and some rows without a vector."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16)) * 4
    rows = [(i, (centres[i % 30] + rng.standard_normal(16)).tolist()) for i in range(1200)]
    rows += [(2000 + i, centres[0].tolist()) for i in range(600)] + [(5000 + i, None) for i in range(5)]
    return vectors(spark, rows).repartition(5)


def test_recall_and_scanned_share(spark, clustered, tmp_path):
    index = vector_index.build_index(clustered, str(tmp_path / "index"))
    assert index.sizes.sum() == 1800 and index.rows(spark).count() == 1800 and 30 <= len(index.centroids) <= 42
    probes = vector_index.probes_for(index, spark, 10)
    q = asked(clustered, "chunk_id % 7 = 0")  # of all directions
    exact = retrieval.vector_search(clustered, q, 10)
    assert vector_index.recall_of(vector_index.indexed_search(index, q, 10, probes), exact) >= 0.9
    assert vector_index.scanned_share(index, q, probes) < 0.5 and vector_index.scanned_share(index, q, len(index.centroids)) == pytest.approx(1.0)


def test_all_cells_give_the_exact_result(spark, clustered, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)  # a hot cell and a wanted cell go in blocks
    index = vector_index.build_index(clustered, str(tmp_path / "index"), cells=7)
    q = asked(clustered)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(vector_index.indexed_search(index, q, 5, 7)) == rows(retrieval.vector_search(clustered, q, 5))


def test_recall_on_the_table(spark, tmp_path):
    v = spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id as chunk_id", "embedding")
    index = vector_index.build_index(v, str(tmp_path / "index"))
    probes, q = vector_index.probes_for(index, spark, 10), asked(v, "chunk_id % 50 = 0")
    recall = vector_index.recall_of(vector_index.indexed_search(index, q, 10, probes), retrieval.vector_search(v, q, 10))
    assert recall >= 0.9 and probes <= len(index.centroids)


def test_index_of_nothing(spark, tmp_path):
    none = vectors(spark, [(1, None)])
    index = vector_index.build_index(none, str(tmp_path / "index"))
    assert index.sizes.sum() == 0 and index.rows(spark).count() == 0
    assert vector_index.indexed_search(vector_index.build_index(vectors(spark, [(1, [1.0, 0.0])]), str(tmp_path / "one")), asked(none, "true"), 3, 1).count() == 0


def first_match(name, metadata):
    tiers = [lambda m: m[0] == name, lambda m: m[1] == name, lambda m: m[0] is not None and m[0].lower() == name.lower(), lambda m: m[0] is not None and m[0].lower() in name.lower()]
    for tier in tiers:
        hits = [m for m in metadata if tier(m)]
        if hits:
            return min(hits, key=lambda m: m[2])[0]
    return None


def test_models_against_all_pairs(spark):
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abA-") for _ in range(n))
    metadata = [(make(rng.randint(1, 9)), rng.choice([None, make(4)]), i) for i in range(60)] + [("common-prefix-" + make(3), None, 100 + i) for i in range(20)] + [(None, "only name", 300)]
    names = [make(rng.randint(0, 14)) for _ in range(150)] + [f"X/common-prefix-{make(3)}:v1" for _ in range(20)] + [m[1] for m in metadata if m[1]] + ["nothing like it", "COMMON-PREFIX"]
    got = compare.match_models(spark.createDataFrame([(n,) for n in names], "model_name string"), spark.createDataFrame(metadata, "id string, name string, position int"))
    rows = {r["model_name"]: r["id"] for r in got.collect()}
    assert rows == {n: first_match(n, metadata) for n in names}
    with_blank = compare.match_models(spark.createDataFrame([("x",)], "model_name string"), spark.createDataFrame([("", "n", 1)], "id string, name string, position int"))
    assert with_blank.first()["id"] == ""
    assert compare.match_models(spark.createDataFrame([("x",)], "model_name string"), spark.createDataFrame([], "id string, name string, position int")).first()["id"] is None


def test_models_join_by_equality_only(spark):
    """Names by ids in the thousands: no pair of a name and an id is made that has nothing in common."""
    names = spark.range(20_000).selectExpr("concat('vendor/model-', id, '-chat') as model_name")
    metadata = spark.range(20_000).selectExpr("concat('model-', id, '-') as id", "cast(null as string) as name", "cast(id as int) as position")
    out = compare.match_models(names, metadata)
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("model_name = concat('vendor/', id, 'chat')").count() == 20_000


def test_snapshots_fresh_expired_and_failing(spark, tmp_path):
    path, asked_at, clock = str(tmp_path / "snapshots"), [], [1000.0]

    def fetch():
        asked_at.append(clock[0])
        if clock[0] == 2000.0:
            raise ConnectionError("down")
        if clock[0] == 2100.0:
            return "<html>no json"
        return json.dumps({"data": [{"id": f"m{clock[0]:.0f}", "supportsEmbeddings": True}]})

    ids = lambda: [(r["id"], r["supports_embeddings"]) for r in ingest.model_snapshots(spark, path, fetch, now=lambda: clock[0]).collect()]
    assert ids() == [("m1000", True)]
    clock[0] = 1299.0
    assert ids() == [("m1000", True)] and asked_at == [1000.0]  # fresh
    for at, want in ((1300.0, "m1300"), (2000.0, "m1300"), (2100.0, "m1300"), (2200.0, "m2200")):  # expired, failing twice, well again
        clock[0] = at
        assert ids() == [(want, True)]
    assert asked_at == [1000.0, 1300.0, 2000.0, 2100.0, 2200.0]


def test_no_snapshot_and_no_service(spark, tmp_path):
    def fetch():
        raise TimeoutError

    assert ingest.model_snapshots(spark, str(tmp_path / "none"), fetch).count() == 0


def test_nearest_in_slices(monkeypatch):
    """The same ids, ties and vectors that are no numbers included, whatever the size of a slice; and little memory."""
    import tracemalloc

    import numpy as np

    from plumbline.operators import retrieval

    rng = np.random.default_rng(8)
    m = rng.integers(-2, 3, (3000, 8)).astype(float)
    m[::5], m[7] = m[0], np.nan
    m[:, 0] += 10
    unit, ids, cid = retrieval._unit(m), np.arange(1100), rng.permutation(3000)
    d = 1 - unit @ unit[:1100].T
    tracemalloc.start()
    got = retrieval._best(ids, unit[:1100], cid, unit, 6)
    assert tracemalloc.get_traced_memory()[1] < 30e6
    tracemalloc.stop()
    want = np.lexsort((np.broadcast_to(np.round(cid[:, None], 0), d.shape), np.round(d, 12)), axis=0)[:6]
    rows = sorted(zip(got.column(0).to_pylist(), np.round(got.column(2).to_numpy(), 12), got.column(1).to_pylist()))
    assert len(rows) == 6600 and [r[1] for r in rows if r[0] != 7] == [x for i in ids if i != 7 for x in np.round(d[want[:, i], i], 12)]
    few = retrieval._best(ids[:2], unit[:2], cid[:9], unit[:9], 20, 4)
    assert few.num_rows == 18 and np.isnan(few.column(2).to_numpy()).sum() == 2
