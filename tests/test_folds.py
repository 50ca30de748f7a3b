"""Folds as compositions of maps against stepping through the bins."""

import random

import pytest
from pyspark.sql import functions as F

from pathwatch.operators import delay, folds, forwarding
from pathwatch.schema import PREFIXES, Params


def stats_of(spark, seed, links=4, bins=40, start=0):
    g = random.Random(seed)
    rows = []
    for k in range(links):
        t = start
        for _ in range(bins + k):
            t += 3600 * g.choice([1, 1, 1, 2, 30])
            m = 10 + g.gauss(0, 1) + (80 if g.random() < 0.1 else 0)
            rows.append((t, f"a{k}", "b", 10, m, m - g.random(), m + g.random(), g.random() < 0.3))
    return spark.createDataFrame(rows, "time_bin long, ip1 string, ip2 string, n long, median double, lo double, hi double, trimmed boolean"), rows[-1][0]


def alike(got, want):
    key = lambda r: tuple(str(r[c]) for c in ("ip1", "ip2", "time_bin") if c in r.__fields__)
    a, b = sorted(got.collect(), key=key), sorted(want.collect(), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for c in want.columns:
            if c == "boot":
                assert [pytest.approx(tuple(r)) for r in y[c]] == [tuple(r) for r in x[c]]
            else:
                assert x[c] == (pytest.approx(y[c], abs=1e-9) if isinstance(y[c], float) else y[c]), (c, x, y)


@pytest.mark.parametrize("p", [Params(), Params(expire_days=1, min_seen=4), Params(alpha=0.3, min_seen=1)], ids=["plain", "expiring", "steep"])
def test_long_links_equal_the_fold(spark, p, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 7)
    first, last = stats_of(spark, 1)
    then, _ = stats_of(spark, 2, links=5, bins=2, start=last)
    old = None
    for stats in (first, then):
        want = delay.detect_delay_changes(stats, old, p)
        got = delay.detect_delay_changes(stats, old, p, large=0)
        if want[0].count():
            alike(*(x.select(want[0].columns) for x in (got[0], want[0])))
        alike(*(x.select(want[1].columns) for x in (got[1], want[1])))
        old = want[1]


def test_a_long_key_is_split(spark):
    n = 3000
    df = spark.range(1, n + 1).select(F.lit("k").alias("key"), F.col("id").alias("k"), F.sin("id").alias("x"), F.lit(1.0).alias("s"))
    got = {r.k: r for r in folds.smoothed(df, ["key"], "k", {"m": ("x", "s")}, 0.01, block=100).collect()}
    import math

    m = 1.0
    for k in range(1, n + 1):
        assert got[k].m_before == pytest.approx(m, abs=1e-12)
        m = 0.99 * m + 0.01 * math.sin(k)
        assert got[k].m_after == pytest.approx(m, abs=1e-12)
    split = folds.running(df, ["key"], "k", F.lit(2), large=50)
    assert sorted(r.run for r in split.select("run").collect()) == list(range(2, 2 * n + 2, 2))


@pytest.mark.parametrize("p", [Params(min_seen=2, min_corr=0.3), Params(expire_days=1, alpha=0.2, min_seen=1, min_corr=0.5)], ids=["plain", "expiring"])
def test_long_routers_equal_the_fold(spark, p, monkeypatch):
    monkeypatch.setattr(folds, "BLOCK", 5)
    g = random.Random(6)
    rib = spark.createDataFrame([(f"20.{k}.0.0/16", 16, 100 + k, "", "") for k in range(4)], PREFIXES)

    def packets(start, bins):
        rows, t = [], start
        for b in range(bins):
            t += 3600 * g.choice([1, 1, 2, 40])
            for r in ("r", "s") if b % 3 else ("r",):
                for k in range(4):
                    rows += [(t, "d", r, g.choice(["n1", "n2", "x", f"m{b % 4}"]), f"20.{k}.0.1", g.choice([0.5, 1.5, 4.0])) for _ in range(2)]
        df = spark.createDataFrame(rows, "time_bin long, dst string, ip0 string, ip1 string, probe string, weight double")
        return df.groupBy("time_bin", "dst", "ip0", "ip1", "probe").agg(F.sum("weight").alias("weight")), t

    first, last = packets(0, 23)
    old, alarms = None, 0
    for counts in (first, packets(last, 3)[0]):
        want = forwarding.detect_forwarding_changes(counts, rib, old, p)
        got = forwarding.detect_forwarding_changes(counts, rib, old, p, large=0)
        for a, b in zip(got, want):
            a, b = (sorted((r.asDict() for r in f.select(want[0].columns if f in (got[0], want[0]) else want[1].columns).collect()), key=lambda r: (r.get("time_bin", 0), r["ip0"])) for f in (a, b))
            assert len(a) == len(b) > 0
            for x, y in zip(a, b):
                for c in y:
                    assert x[c] == (pytest.approx(y[c], abs=1e-9) if isinstance(y[c], (float, dict)) else y[c]), (c, x, y)
        old = want[1]
        alarms += want[0].where("alarm").count()
    assert alarms
