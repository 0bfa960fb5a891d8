import numpy as np
import pytest
from pyspark.sql import functions as F

from convene.llm import neighbours, queries


def brute(rows, is_query, k):
    """Every row that asks, against all others, in double precision."""
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    out = []
    for r, (i, q) in enumerate(zip(ids, x)):
        if is_query(i):
            score = np.cumsum(x * q, axis=1)[:, -1]
            order = [j for j in np.lexsort((ids, -score)) if j != r][:k]
            out += [(i, n + 1, ids[j], score[j]) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["normal", "tied", "wild"])
def test_brute_force(spark, shape):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 24))
    if shape == "tied":
        x = np.round(x)[rng.integers(0, 40, 700)]
        x[np.abs(x).sum(1) == 0] = 1
    if shape == "wild":
        x *= 10.0 ** rng.integers(-12, 12, (700, 1))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 7 == 0, 10, 2400, 700).collect()))
    assert got == brute(list(enumerate(x)), lambda i: i % 7 == 0, 10)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for _ in range(50):
        q, c = rng.normal(size=(20, 17)) * 10 ** rng.uniform(-3, 3), rng.normal(size=(30, 17))
        (qc, qs, qe, qn), (cc, cs, ce, cn) = neighbours.quantise(q), neighbours.quantise(c)
        near = (qc * qs[:, None]) @ (cc * cs[:, None]).T
        decoded = np.sqrt(((qc * qs[:, None]) ** 2).sum(1))
        assert (np.abs(q @ c.T - near) <= qe[:, None] * cn + decoded[:, None] * ce + 1e-12 * qn[:, None] * cn).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [9.0]), (None, [5.0, 5.0]), (40, [0.0, 0.0]), (60, [3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "1 AS row", "2 AS h1", "3 AS dim")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 20 == 0, 3).collect()))
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 1.0), (20, 1, 1, 2.0), (20, 2, 2, 2.0), (20, 3, 0, 1.0), (60, 1, 9, 27.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_rows_that_share_ids_or_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(1, [1.0, 1.0]), (1, [5.0, 5.0]), (20, [1.0, 0.0]), (20, [0.0, 3.0]), (20, [0.0, 3.0]), (40, [5.0, 5.0])]
    rows += [(20 * (i % 30) + i % 2, [2.0, -1.0]) for i in range(90)] + [(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(60, 2)))) if v.any()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") % 20 == 0, 4, 64, 16).collect()))
    assert got == brute(rows, lambda i: i % 20 == 0, 4)


def test_whole_numbers_keep_their_precision(spark):
    rows = [(0, [16777217, 0]), (1, [16777217, 1]), (2, [-1, 0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>")
    assert sorted(map(tuple, neighbours.nearest(df, F.col("vec_id") == 0, 2).collect())) == [(0, 1, 1, float(16777217**2)), (0, 2, 2, -16777217.0)]


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = sorted(map(tuple, queries.op5_neighbours(spark, sf).collect()))
    assert got == brute([(r.vec_id, r.embedding) for r in rows], lambda i: i % 20 == 0, 20)
