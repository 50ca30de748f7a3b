"""Expansion, statistics and detection on small traces with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from pathwatch.functions import addresses, expand
from pathwatch.operators import delay, forwarding, statistics
from pathwatch.schema import PREFIXES, TRACEROUTE, Params


def trace(spark, hops, probe="50.69.116.108", dst="192.203.230.10", ts=0, first_error=None):
    result = [(h, first_error if h == 1 else None, None if replies is None else [(ip, rtt, None, None, None, None if ip else "*") for ip, rtt in replies]) for h, replies in hops]
    return spark.createDataFrame([(ts, None, 4, 1, 7, probe, None, dst, None, None, None, None, None, None, None, None, result)], TRACEROUTE)


ONE = [(1, [("192.168.1.1", 1.0)] * 3), (2, [("75.154.217.108", 20.7)] * 3), (3, [("206.81.80.80", 17.951)] * 3), (4, [("192.203.230.10", 20.694)] * 3)]


def test_differential_rtts(spark):
    got = {(r.ip1, r.ip2): round(r.rtt_diff, 3) for r in expand.differential_rtts(trace(spark, ONE)).collect()}
    assert got == {("206.81.80.80", "75.154.217.108"): -2.749, ("192.203.230.10", "206.81.80.80"): 2.743}


def test_next_hop_packets(spark):
    got = {(r.ip0, r.ip1): round(r.w, 6) for r in expand.next_hop_packets(trace(spark, ONE)).groupBy("ip0", "ip1").agg(F.sum("weight").alias("w")).collect()}
    assert got == {("50.69.116.108", "75.154.217.108"): 3.0, ("75.154.217.108", "206.81.80.80"): 3.0, ("206.81.80.80", "192.203.230.10"): 3.0}


def test_two_repliers_and_a_private_hop_in_between(spark):
    t = trace(spark, [(1, [("10.0.0.1", 1.0)] * 3), (2, [("83.0.0.1", 16.0), ("83.0.0.1", 18.0), ("83.0.0.2", 40.0)]), (3, [("10.0.0.2", 2.0)] * 3), (4, [("88.0.0.1", 13.0), ("88.0.0.1", 13.0)])], probe="95.0.0.1")
    assert expand.differential_rtts(t).count() == 0  # the private hop breaks the chain of delays
    got = {(r.ip0, r.ip1): round(r.w, 6) for r in expand.next_hop_packets(t).groupBy("ip0", "ip1").agg(F.sum("weight").alias("w")).collect()}
    assert got == {("95.0.0.1", "83.0.0.1"): 2.0, ("95.0.0.1", "83.0.0.2"): 1.0, ("83.0.0.1", "88.0.0.1"): round(4 / 3, 6), ("83.0.0.2", "88.0.0.1"): round(2 / 3, 6)}


def test_hop_without_result_is_bridged_and_lost_replies_are_x(spark):
    t = trace(spark, [(1, [("83.0.0.1", 10.0)]), (2, None), (3, [("88.0.0.1", 12.0)])])
    assert [r.rtt_diff for r in expand.differential_rtts(t).collect()] == [2.0]
    lost = trace(spark, [(1, [(None, None)] * 3), (2, [("192.168.0.9", 1.0)])], probe="188.0.0.1")
    assert {(r.ip0, r.ip1) for r in expand.next_hop_packets(lost).collect()} == {("188.0.0.1", "x")}


def test_invalid_traces(spark):
    assert delay.valid_traces(trace(spark, ONE, first_error="sendto")).count() == 0
    assert delay.valid_traces(trace(spark, [])).count() == 0
    assert expand.differential_rtts(trace(spark, [(1, [("8.8.8.8", 1.0)])])).count() == 0
    same = trace(spark, [(1, [("8.8.8.8", 1.0)]), (2, [("8.8.8.8", 2.0)])])
    assert expand.differential_rtts(same).count() == 0 and expand.next_hop_packets(same).count() == 4


@pytest.mark.parametrize(("n", "lo", "hi"), [(1, 0, 0), (3, 0, 2), (10, 2, 7), (100, 40, 59)])
def test_wilson_ranks(spark, n, lo, hi):
    r = statistics.median_ci(spark.range(n).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("x")), ["k"], "x").first()
    assert (r.n, r.lo, r.hi, r.median) == (n, lo, hi, (n - 1) / 2)


def test_trim():
    assert statistics.trim_counts([5, 5, 5], 3, 0.5) == [5, 5, 5]
    assert statistics.trim_counts([1000, 1, 1], 3, 0.5) is None  # exactly the least number of networks: dropped untrimmed
    got = statistics.trim_counts([1000, 2, 2, 2], 3, 0.5)
    n = sum(got)
    entropy = (math.log(n) - sum(c * math.log(c) for c in got) / n) / math.log(4)
    assert got[1:] == [2, 2, 2] and entropy >= 0.5
    assert statistics.trim_counts([7], 3, 0.5) is None


def test_trim_keeps_the_counts_and_is_independent_of_order(spark):
    rows = [("k", 1, i) for i in range(400)] + [("k", a, 1000 + i) for a in (2, 3, 4) for i in range(2)] + [("l", 1, 1), ("l", 2, 2)]
    df = spark.createDataFrame(rows, "k string, asn long, id long")
    a = statistics.trim_to_diversity(df, ["k"], order=["id"])
    b = statistics.trim_to_diversity(df.orderBy(F.desc("id")).repartition(3), ["k"], order=["id"])
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    want = statistics.trim_counts([400, 2, 2, 2], 3, 0.5)
    assert {r.asn: r["count"] for r in a.groupBy("asn").count().collect()} == dict(zip((1, 2, 3, 4), want))


def stats_of(spark, medians):
    return spark.createDataFrame([(3600 * t, "a", "b", 10, m, m - 1, m + 1) for t, m in medians], "time_bin long, ip1 string, ip2 string, n long, median double, lo double, hi double")


def test_delay_fold(spark):
    alarms, ref = delay.detect_delay_changes(stats_of(spark, [(0, 10.0), (1, 12.0), (2, 11.0), (3, 30.0), (4, 11.0)]), None, Params())
    a = alarms.collect()
    assert [r.time_bin for r in a] == [3 * 3600] and a[0].ref == 11.0 and a[0].nb_seen == 3
    assert a[0].diff_med == 19.0 and a[0].diff == 17.0 and a[0].deviation == 19.0 and a[0].dev_bound == 17.0
    r = ref.first()
    assert r["mean"] == pytest.approx(0.99 * (0.99 * 11 + 0.01 * 30) + 0.01 * 11) and r.nb_seen == 5 and r.nb_reported == 1


def test_replay_equals_batch(spark):
    medians = [(t, 10.0 + (t * 7 % 5)) for t in range(8)] + [(8, 60.0)]
    p = Params()
    batch, want = delay.detect_delay_changes(stats_of(spark, medians), None, p)
    ref, told = None, []
    for m in medians:
        alarms, ref = delay.detect_delay_changes(stats_of(spark, [m]), ref, p)
        told += [tuple(r) for r in alarms.collect()]
    assert told == sorted(tuple(r) for r in batch.collect()) and [r.asDict() for r in ref.collect()] == [r.asDict() for r in want.collect()]


def test_silence_resets_the_reference(spark):
    far = 24 * 8
    _, kept = delay.detect_delay_changes(stats_of(spark, [(0, 10.0), (1, 10.0), (24 * 7 + 2, 10.0)]), None, Params(expire_days=7))
    _, reset = delay.detect_delay_changes(stats_of(spark, [(0, 10.0), (1, 10.0), (far + 3, 10.0)]), None, Params(expire_days=7))
    assert kept.first().nb_seen == 3 and reset.first().nb_seen == 1


def test_forwarding_fold_and_responsibility(spark):
    rib = spark.createDataFrame([(f"20.{k}.0.0/16", 16, 100 + k, "", "") for k in range(3)], PREFIXES)
    rows = [(3600 * t, "d", "r", "n2" if t == 4 else "n1", f"20.{k}.0.1", 4.0) for t in range(5) for k in range(3)]
    steps, ref = forwarding.detect_forwarding_changes(spark.createDataFrame(rows, "time_bin long, dst string, ip0 string, ip1 string, probe string, weight double"), rib, None, Params())
    s = {r.time_bin // 3600: r for r in steps.collect()}
    assert s[0].corr is None and s[3].corr == pytest.approx(1.0) and s[4].alarm and s[4].corr < 0
    assert s[4].nb_peers == 3 and s[4].obs == {"n1": 0.0, "n2": 12.0, "0": 0.0}
    got = {r.ip: r for r in forwarding.responsibility(steps.where("alarm")).collect()}
    assert got["n2"].label == "+" and got["n1"].label == "-" and sum(r.resp_abs for r in got.values()) == pytest.approx(abs(s[4].corr))
    assert ref.first().nb_seen == 5


def test_longest_prefix_and_ipv6(spark):
    rib = spark.createDataFrame([("10.1.0.0/16", 16, 1, "a", "A"), ("10.1.2.0/24", 24, 2, "b", "B"), ("2001:db8::/32", 32, 3, "c", "C")], PREFIXES)
    ips = spark.createDataFrame([("10.1.2.3",), ("10.1.9.9",), ("2001:db8::7",), ("8.8.8.8",), (None,), ("nonsense",), ("10.1.2.3",)], "ip string")
    got = [(r.ip, r.asn) for r in addresses.with_asn(ips, "ip", rib, v6=True).collect()]
    assert len(got) == 7 and dict(got) == {"10.1.2.3": 2, "10.1.9.9": 1, "2001:db8::7": 3, "8.8.8.8": 0, None: 0, "nonsense": 0}
    private = ips.select(addresses.is_private_ip(F.col("ip")).alias("p"), addresses.prefix24(F.col("ip")).alias("n")).collect()
    assert [r.p for r in private] == [True, True, False, False, None, False, True] and private[0].n == "10.1.2.0/24" and private[2].n is None


def test_shapiro():
    import numpy as np

    rng = np.random.default_rng(0)
    assert statistics.shapiro_wilk(rng.normal(size=200)) > 0.01 and statistics.shapiro_wilk(rng.exponential(size=200)) < 1e-6
    assert math.isnan(statistics.shapiro_wilk(np.ones(10)))
