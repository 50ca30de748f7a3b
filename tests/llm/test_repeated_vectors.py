"""Neighbours where rows, or ids with different vectors, occur many times."""

import numpy as np
from pyspark.sql import functions as F

from pathwatch.llm import neighbours


def plain(rows, queries, k=10):
    """Each query's nearest distinct ids, by brute force."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for q in queries:
        best = {}
        for own in x[ids == q]:
            for i, d in zip(ids, np.sqrt(((x - own) ** 2).sum(axis=1))):
                if i != q:
                    best[i] = min(d, best.get(i, np.inf))
        out[q] = sorted(best, key=lambda i: (best[i], i))[:k]
    return out


def found(spark, rows, is_query):
    got = {}
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    for r in sorted(neighbours.search(df, is_query).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    once = list(enumerate(x))
    nearest = 1 + int(np.argmin(((x[1:] - x[0]) ** 2).sum(axis=1)))
    want = plain(once, range(0, 200, 50))
    assert found(spark, once * 2 + [once[nearest]] * 20, F.col("vec_id") % 50 == 0) == want


def test_ids_with_different_vectors_are_one_candidate(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    rows = list(enumerate(x)) + [(7, x[0] + np.float32(0.001 * k)) for k in range(1, 15)]
    assert found(spark, rows, F.col("vec_id") == 0) == plain(rows, [0])
