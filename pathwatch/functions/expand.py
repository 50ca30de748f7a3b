"""From nested traceroutes to flat samples, inside the row: one explode, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwatch.functions.addresses import is_private_ip

LOST = "x"
EDGES = "array<struct<ip0:string,ip1:string,weight:double>>"


def median_of(values: Column) -> Column:
    """Median of an array without nulls."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def _usable(r: Column) -> Column:
    return r["from"].isNotNull() & ~is_private_ip(r["from"]) & (r["rtt"] > 0)


def hop_medians(result: Column) -> Column:
    """array over the hops that have a result, of arrays of (ip, median rtt) over the usable replies of each address.

    A hop without a result is left out, so the hops on both sides of it count as adjacent; a hop whose replies are all
    lost, private or without a positive delay stays, empty.
    """
    def of(hop: Column) -> Column:
        replies = F.filter(hop["result"], _usable)
        ips = F.array_distinct(F.transform(replies, lambda r: r["from"]))
        return F.transform(ips, lambda ip: F.struct(ip.alias("ip"), median_of(F.transform(F.filter(replies, lambda r: r["from"] == ip), lambda r: r["rtt"])).alias("med")))

    return F.transform(F.filter(result, lambda h: h["result"].isNotNull()), of)


def hop_median_rtt(traces: DataFrame, *keep: str) -> DataFrame:
    """(*keep, hop_pos, ip, med): the median delay of each address at each hop position."""
    hops = traces.select(*keep, hop_medians(F.col("result")).alias("m"))
    return hops.select(*keep, F.posexplode_outer("m").alias("hop_pos", "h")).select(*keep, "hop_pos", F.explode_outer("h").alias("h")).where("h IS NOT NULL").select(*keep, "hop_pos", F.col("h.ip").alias("ip"), F.col("h.med").alias("med"))


def differential_rtts(traces: DataFrame, *keep: str) -> DataFrame:
    """(*keep, ip1, ip2, rtt_diff): delay differences over all address pairs of consecutive hops, as an ordered link.

    The link's ends are sorted as strings; the sign of the difference is kept. A hop without a usable reply breaks the
    chain; an address is never paired with itself. Null and empty results give nothing.
    """
    hops = traces.select(*keep, hop_medians(F.col("result")).alias("m"))

    def between(i: Column) -> Column:
        return F.flatten(F.transform(F.get("m", i - 1), lambda a: F.transform(F.filter(F.get("m", i), lambda b: b["ip"] != a["ip"]), lambda b: F.struct(a["ip"].alias("a"), b["ip"].alias("b"), (b["med"] - a["med"]).alias("d")))))

    pairs = F.when(F.size("m") > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.size("m") - 1), between)))
    # outer: an inferred filter would expand every trace twice
    flat = hops.select(*keep, F.explode_outer(pairs).alias("p")).where("p IS NOT NULL")
    return flat.select(*keep, F.least("p.a", "p.b").alias("ip1"), F.greatest("p.a", "p.b").alias("ip2"), F.col("p.d").alias("rtt_diff"))


def next_hop_edges(probe: Column, result: Column) -> Column:
    """array of (ip0, ip1, weight): the packets of one trace over its links.

    Each reply (a lost one is ``x``, private ones are skipped) adds an equal share of itself to every reply of the hop
    before, at first to the probe. A hop without such replies is bridged.
    """
    def step(acc: Column, hop: Column) -> Column:
        now = F.transform(F.filter(F.coalesce(hop["result"], F.array()), lambda r: r["from"].isNull() | ~is_private_ip(r["from"])), lambda r: F.coalesce(r["from"], F.lit(LOST)))
        prev = acc["prev"]
        edges = F.flatten(F.transform(now, lambda n: F.transform(prev, lambda p: F.struct(p.alias("ip0"), n.alias("ip1"), (F.lit(1.0) / F.size(prev)).alias("weight"))))).cast(EDGES)
        return F.struct(F.when(F.size(now) > 0, now).otherwise(prev).alias("prev"), F.concat(acc["edges"], edges).alias("edges"))

    start = F.struct(F.array_repeat(probe, 3).alias("prev"), F.array().cast(EDGES).alias("edges"))
    return F.aggregate(F.coalesce(result, F.array()), start, step, lambda acc: acc["edges"])


def next_hop_packets(traces: DataFrame, *keep: str) -> DataFrame:
    """(*keep, dst, probe, ip0, ip1, weight) for each reply and reply of the hop before; see next_hop_edges."""
    e = traces.where("dst_addr IS NOT NULL").select(*keep, F.col("dst_addr").alias("dst"), F.col("from").alias("probe"), F.explode_outer(next_hop_edges(F.col("from"), F.col("result"))).alias("e"))
    return e.where("e IS NOT NULL").select(*keep, "dst", "probe", "e.ip0", "e.ip1", "e.weight")
