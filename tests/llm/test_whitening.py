import numpy as np
import pytest

from plumbline.llm import whitening as W


def whole(v):
    return np.floor(np.array(v, dtype=np.float64) * 1024).astype(np.int64) + 100_000


def reference(vectors, k=8):
    """Deviations, whitened values and explained shares from the full covariance."""
    x = np.array([whole(v) for v in vectors])
    n, sums = len(x), [int(c) for c in x.sum(axis=0)]
    z = x.astype(object) * n - np.array(sums, dtype=object)
    centred = z.astype(np.float64) / n
    cov = centred.T @ centred / n
    values, vec = np.linalg.eigh(cov)
    values, vec = values[::-1][:k], vec[:, ::-1][:, :k]
    return [int(v) for v in (z**2).sum(axis=1)], centred @ vec / np.sqrt(values), values / np.trace(cov)


def same_up_to_sign(a, b, tolerance):
    return all(min(np.abs(a[:, j] - b[:, j]).max(), np.abs(a[:, j] + b[:, j]).max()) < tolerance for j in range(a.shape[1]))


def checked(spark, rows, vectors, k):
    fit = W.fit_whitening(rows, k)
    got = sorted((r["vec_id"], r["deviation"], r["whitened"]) for r in W.whitened(rows, fit).collect())
    deviation, white, explained = reference(vectors, k)
    assert [g[1] for g in got] == deviation
    assert same_up_to_sign(np.array([g[2] for g in got]), white, 1e-6)
    np.testing.assert_allclose(fit.eigenvalues / fit.trace, explained, rtol=1e-9)
    assert fit.n == len(vectors) and fit.identity_error < 1e-9
    return fit


@pytest.mark.parametrize("d, k", [(3, 8), (24, 8), (40, 5)])
def test_agrees_with_the_full_covariance(spark, d, k):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((300, d)) * np.linspace(3, 0.5, d)).tolist()
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(7)
    assert len(checked(spark, rows, vectors, k).eigenvalues) == min(k, d)


def test_flat_spectrum_widens_the_block(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 64)).tolist()
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    assert checked(spark, rows, vectors, 8).passes < 20


def test_unusable_vectors_ties_and_clashing_columns(spark):
    rng = np.random.default_rng(3)
    good = (rng.standard_normal((60, 4)) * [4, 3, 2, 1]).tolist()
    good[10:20] = [good[9]] * 10  # repeated vectors, and repeated ids below
    bad = [None, [], [1.0, None, 2.0, 3.0], [1.0, float("nan"), 2.0, 3.0], [float("inf"), 1.0, 1.0, 1.0], [1e300, 1.0, 1.0, 1.0], [1.0, 2.0, 3.0], [1.0] * 5]
    rows = [(i, v, "w", 7, i) for i, v in enumerate(good)] + [(1, v, "w", 7, -1) for v in bad] + [(None, good[0], "w", 7, 99)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened string, deviation int, _row long").repartition(5)
    fit = W.fit_whitening(df)
    got = sorted((r["_row"], r["deviation"], r["whitened"]) for r in W.whitened(df, fit).collect())
    deviation, white, _ = reference([*good, good[0]])
    assert [g[0] for g in got] == [*range(60), 99] and [g[1] for g in got] == deviation
    assert same_up_to_sign(np.array([g[2] for g in got]), white, 1e-9)


def test_no_rows_one_row_and_no_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        df = spark.createDataFrame(rows, schema)
        assert W.whitened(df, W.fit_whitening(df)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)
    fit = W.fit_whitening(df)
    assert fit.n == 2 and len(fit.eigenvalues) == 0
    assert [(r["deviation"], r["whitened"]) for r in W.whitened(df, fit).collect()] == [(0, []), (0, [])]
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0])], schema)  # one direction only
    assert len(W.fit_whitening(df).eigenvalues) == 1


def test_entries_that_64_bits_cannot_multiply(spark):
    vectors = [[8e12, 1.0], [-8e12, 2.0], [1e12, 5.0]] * 50
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    fit = W.fit_whitening(df)
    assert fit.sums == [sum(int(whole(v)[j]) for v in vectors) for j in range(2)]
    assert all(r["deviation"] is None for r in W.whitened(df, fit).collect())  # no long holds them


def test_query_on_the_table(spark):
    from tables import SMALL

    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    deviation, white, explained = reference([r["embedding"] for r in rows])
    got = W.op11(spark, SMALL).orderBy("vec_id", "component").collect()
    assert len(got) == 8 * len(rows)
    assert [g["deviation"] for g in got[::8]] == deviation
    assert same_up_to_sign(np.array([g["whitened"] for g in got]).reshape(-1, 8), white, 1e-7)
    np.testing.assert_allclose([g["explained"] for g in got[:8]], explained, rtol=1e-9)
    assert {g["n"] for g in got} == {len(rows)} and max(g["identity_error"] for g in got) < 1e-9
