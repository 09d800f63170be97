import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_entry import check

from merset.llm.centroids import cluster_vectors, integer_vectors, lane_bits, with_nearest
from merset.llm.queries import ORACLES, op12_centroids


def brute(rows, centroids, rounds, scale=256, seed=2):
    x = np.floor(scale * np.array([r[1] for r in rows], float)).astype(np.int64)
    names = [hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest() for r in rows]
    c = x[sorted(range(len(rows)), key=lambda i: (names[i], x[i].tolist()))[:centroids]].copy()
    for _ in range(rounds + 1):
        last = c.copy()
        d = ((x[:, None, :] - c) ** 2).sum(2)
        at = d.argmin(1)
        for j in set(at.tolist()):
            c[j] = x[at == j].sum(0) // (at == j).sum()
    d = d.min(1)
    return sorted([(str(r[0]), int(j), int(v), int(d[at == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, last[j])).encode()).hexdigest()) for r, j, v in zip(rows, at, d, strict=True)])


def listed(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_query_agrees_with_sql_and_brute_force(spark, sf_dir):
    check(spark, sf_dir, op12_centroids, ORACLES["op12_centroids"])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert listed(op12_centroids(spark, sf_dir)) == brute(rows, 40, 5)


@pytest.mark.parametrize("spread_", [0.01, 1.0, 300.0, 90_000.0])
def test_lanes_of_any_width(spark, rng, spread_):
    """Short and long numbers, negative ones, ties, repeated rows and ids, and a null id."""
    x = (rng.standard_normal((120, 5)) * spread_).astype(np.float32).astype(float)
    x[60:80] = x[0]
    rows = [(None if i == 3 else i % 90, v.tolist()) for i, v in enumerate(x)]
    assert listed(cluster_vectors(table(spark, rows), 7, 3, 5)) == brute(rows, 7, 3)


def test_equally_near_centroids_and_empty_ones(spark):
    rows = [(i, [0.0, 0.0]) for i in range(9)] + [(9, [1.0, 0.0])]
    got = cluster_vectors(table(spark, rows), 6, 2, 2)
    assert listed(got) == brute(rows, 6, 2)
    far = integer_vectors(table(spark, [(1, [0.5, 0.0])]), 2, 2)
    near = with_nearest(far, [[2, 0], [0, 0], [1, 5]], 8).first().near
    assert (near.distance, near.cluster) == (1, 0)


def test_unsound_vectors_few_vectors_and_clashing_columns(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [])]
    t = table(spark, rows).withColumns({"cluster": F.lit("x"), "q": F.lit(1), "norm": F.lit(None)})
    assert listed(cluster_vectors(t, 4, 2, 2)) == brute(rows[:1], 4, 2)
    assert cluster_vectors(t.limit(0), 4, 2, 2).isEmpty()
    huge = cluster_vectors(table(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]), 1, 1, 64)
    assert huge.count() == 3 and huge.where("distance < 0").isEmpty()
    with pytest.raises(ValueError):
        cluster_vectors(t, dims=65)


def test_no_python_and_no_row_in_the_driver(spark, sf_dir):
    plan = op12_centroids(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert lane_bits(65536, [[256] + [0] * 63]) == 18  # a sum of products up to 65,536, with its sign
