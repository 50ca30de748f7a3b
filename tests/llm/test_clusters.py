"""Lloyd rounds against a plain loop over Python integers."""

import hashlib
import math
from collections import Counter

import numpy as np

from pathwatch.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, q string, cluster string, v int"


def plain(rows, k, rounds, size):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    c = [q for _, q in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min(range(len(c)), key=lambda j: (far(q, c[j]), j))
    for _ in range(rounds):
        own = [near(q) for _, q in kept]
        c = [[sum(x) // len(g) for x in zip(*g)] if (g := [q for (_, q), o in zip(kept, own) if o == j]) else c[j] for j in range(len(c))]
    own = [(i, near(q), far(q, c[near(q)])) for i, q in kept]
    sums = Counter()
    for _, j, d in own:
        sums[j] += d
    return [(i, j, d, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in own]


def found(spark, rows, **how):
    return sorted(map(tuple, clusters.report(spark.createDataFrame([(i, v, "q", "c", 1) for i, v in rows], SCHEMA), **how).collect()), key=str)


def test_against_a_plain_loop(spark):
    g = np.random.default_rng(3)
    rows = [(int(i), (g.normal(size=4) + i % 5).tolist()) for i in range(300)]
    rows += rows[:7] + [(None, rows[3][1]), (7, [0.5] * 4), (2**60 + 1, [-0.001] * 4), (9, None), (10, [1.0] * 3), (11, [1.0, None, 0.0, 0.0]), (12, [math.inf, 0.0, 0.0, 0.0]), (13, [math.nan] * 4), (14, [])]
    assert found(spark, rows, clusters=6, rounds=3, size=4) == sorted(plain(rows, 6, 3, 4), key=str)


def test_ties_few_vectors_and_empty_clusters(spark):
    # equal vectors: the later of two equal centroids stays empty and where it is
    rows = [(k, [1.0, 2.0]) for k in range(5)] + [(9, [-7.3, 2.0])]
    got = found(spark, rows, clusters=40, rounds=2, size=2)
    assert got == sorted(plain(rows, 40, 2, 2), key=str) and len({r[1] for r in got}) == 2
    assert found(spark, [], size=2) == []
    big = found(spark, [(1, [1e300, -1e300]), (2, [0.0, 0.0])], clusters=1, rounds=1, size=2)
    assert len(big) == 2 and all(r[2] > 2**50 for r in big)


def test_lowest_number_wins():
    best, far = clusters.nearest(np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [5, 5], [5, 5]]))
    assert best.tolist() == [0, 2] and far.tolist() == [1, 0]
