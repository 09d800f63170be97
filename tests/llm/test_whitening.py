import numpy as np
import pytest
from pyspark.sql import functions as F

from merset.llm.queries import op13_whitening
from merset.llm.whitening import count_above, intervals, leading, whiten


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain(x, k):
    """Whitened values (columns of either sign), eigenvalue shares and deviations by a dense solver."""
    n, c = len(x), x - x.mean(0)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    whole = x.astype(np.int64)
    return c @ u / np.sqrt(e), e / np.trace(c.T @ c / n), ((n * whole - whole.sum(0)) ** 2).sum(1)


def compare(got, ids, x, k, close=1e-9):
    w, share, deviation = plain(x, k)
    got = got.orderBy("vec_id", "component").collect()
    order = np.argsort(ids)
    assert [(r.vec_id, r.component) for r in got] == [(ids[i], c + 1) for i in order for c in range(k)]
    g = np.array([r.whitened for r in got]).reshape(-1, k)
    sign = np.sign((g * w[order]).sum(0))
    assert np.abs(g * sign - w[order]).max() < close
    assert [r.deviation for r in got[::k]] == deviation[order].tolist() and {r.n for r in got} == {len(ids)}
    assert np.allclose([r.explained for r in got[:k]], share, rtol=1e-9) and max(r.identity_error for r in got) < 1e-9


def test_query_agrees_with_a_dense_solver(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows], float)) + 100_000
    compare(op13_whitening(spark, sf_dir), [r.vec_id for r in rows], x, 8)


def test_inertia_counts(rng):
    for d in (1, 2, 3, 17, 40):
        for rank in (d, max(1, d // 3)):
            m = rng.standard_normal((d, rank))
            a = m @ m.T - 0.3 * np.eye(d)
            e = np.linalg.eigvalsh(a)
            for shift in rng.uniform(-1, 2 * d, 12):
                assert count_above(a, shift) == (e > shift).sum()
    assert count_above(np.zeros((3, 3)), 0.0) == 0 and count_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize("values", [[5, 4, 3, 2, 1, 0.5], [1, 1, 1, 1, 1, 1, 1, 1, 1, 0.1], [1, 1 - 1e-9, 1 - 2e-9, 0.5], [1, 1e-7, 1e-9, 0, 0], [1e-3] * 3 + [1e-6] * 20])
def test_spectra(spark, rng, values):
    """Well separated, equal, clustered and vanishing eigenvalues: none is missed, and vectors are orthonormal and solve the matrix."""
    d = len(values)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = q * values @ q.T
    a = (a + a.T) / 2
    e, u = leading(spark, a, 4)
    want = sorted((v for v in values if v > 1e-12 * sum(values)), reverse=True)[:4]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-13) and np.allclose(u.T @ u, np.eye(len(want)), atol=1e-10)
    assert np.abs(a @ u - u * e).max() < 1e-12
    assert sum(n for _, _, n in intervals(a, 4, sum(values) * (1 + 1e-9))) >= len(want)


def test_unsound_rows_ranks_and_clashing_columns(spark, rng):
    x = rng.standard_normal((40, 3)) * [3, 2, 0]
    x[5] = x[6]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(100, None), (101, []), (102, [1.0]), (103, [1.0, None, 2.0]), (104, [float("nan")] * 3), (105, [float("inf"), 0.0, 0.0])]
    t = table(spark, rows + bad).withColumns({"n": F.lit(1), "x": F.lit("a"), "e": F.lit(None)})
    compare(whiten(t), list(range(40)), np.floor(1024 * x) + 100_000, 2)  # the third eigenvalue is zero
    assert whiten(t.limit(0)).isEmpty() and whiten(table(spark, [(1, [1.0, 2.0])] * 3)).isEmpty()
    again = whiten(table(spark, [(None, v) for _, v in rows] + rows))
    assert again.where("vec_id is null").count() == 80 and again.count() == 160


def test_deviations_beyond_bigint_are_null(spark):
    rows = [(i, [3e38 if i % 2 else -3e38, float(i)]) for i in range(100)]
    got = whiten(table(spark, rows)).collect()
    assert len(got) == 200 and {r.deviation for r in got} == {None} and max(r.identity_error for r in got) < 1e-4
    big = 2.0**17 / 1024
    x = np.array([[big * (i % 2) * 200, float(i)] for i in range(100)])
    compare(whiten(table(spark, list(enumerate(x.tolist())))), list(range(100)), np.floor(1024 * x) + 100_000, 2)
