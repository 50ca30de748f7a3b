"""Order statistics of large groups, and the water level of trimming."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathwatch.operators import references, statistics


def test_large_groups_are_narrowed_down_exactly(spark, monkeypatch):
    g = random.Random(1)
    rows = [("even", g.uniform(-5, 5)) for _ in range(3000)] + [("steep", math.exp(g.uniform(-300, 300))) for _ in range(800)] + [("ties", float(g.randrange(3))) for _ in range(900)]
    rows += [("same", 7.0)] * 500 + [("far", x) for x in (-1e308, 1e308)] + [("far", g.gauss(0, 1e-9)) for _ in range(300)] + [(f"s{k}", float(k)) for k in range(30)] + [("even", None)] * 5
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    key = lambda r: r["k"]
    want = sorted(statistics.median_ci(df, ["k"], "x").collect(), key=key)
    got = sorted(statistics.median_ci(df, ["k"], "x", large=40).collect(), key=key)
    assert got == want and len(got) == 35
    x = sorted(v for k, v in rows if k == "even" and v is not None)
    assert next(r.median for r in got if r.k == "even") == pytest.approx((x[1499] + x[1500]) / 2)


def test_no_window_sees_a_large_group(spark, monkeypatch):
    """One group with nine tenths of all rows: what is sorted in one task stays under the bound, and samples are never dealt out by group."""
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(-1).alias("k"), F.sin(F.col("id").cast("double")).alias("x"))
    seen = []
    real = statistics.written
    monkeypatch.setattr(statistics, "written", lambda d, name: seen.append((name, real(d, name))) or seen[-1][1])
    got = {r.k: r for r in statistics.medians(df, ["k"], "x", large=500).collect()}
    assert got[-1].n == 18000 and got[-1].median == pytest.approx(float(np.median(np.sin([i for i in range(20000) if i % 10]))))
    sizes = [d.count() for name, d in seen if name == "hot_rows"]
    assert sizes[0] == 18000 and max(sizes[1:]) <= 1000  # two ranks, each in a part of the bound at most


def test_deviation_of_hot_links(spark, monkeypatch):
    rows = [("a", "b", float((k * 37) % 101)) for k in range(700)] + [("c", "d", float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "ip1 string, ip2 string, rtt_diff double")
    medians = statistics.medians
    monkeypatch.setattr(references, "medians", lambda d, keys, value, sizes: medians(d, keys, value, sizes, large=64))
    for r in references.link_distribution_stats(df).collect():
        x = np.array([v for a, _, v in rows if a == r.ip1])
        assert (r.n, r.median, r.mad) == (len(x), np.median(x), np.median(np.abs(x - np.median(x)))) and r.std == pytest.approx(x.std())


def step_by_step(counts, min_asn, min_entropy):
    """One sample of the most frequent network after the other."""
    c, k = list(counts), len(counts)
    heap = [(-v, i) for i, v in enumerate(c)]
    heapq.heapify(heap)

    def entropy():
        n = sum(c)
        return (math.log(n) - sum(v * math.log(v) for v in c if v) / n) / math.log(k) if k > 1 else 0

    while k > min_asn and entropy() < min_entropy:
        v, i = heapq.heappop(heap)
        c[i] = -v - 1
        heapq.heappush(heap, (v + 1, i))
    return c if k >= min_asn and entropy() >= min_entropy else None


def test_water_level_equals_the_loop():
    g = random.Random(2)
    for _ in range(400):
        counts = [g.choice([1, 2, 3, 50, 400, g.randrange(1, 900)]) for _ in range(g.randint(1, 7))]
        assert statistics.trim_counts(counts, 3, 0.5) == step_by_step(counts, 3, 0.5), counts
        assert statistics.trim_counts(counts, 2, 0.8) == step_by_step(counts, 2, 0.8), counts
    huge = statistics.trim_counts([10**15, 5, 5, 5], 3, 0.5)
    assert huge[1:] == [5, 5, 5] and 5 < huge[0] < 10**4
