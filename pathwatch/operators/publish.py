"""What is published: filtered alarms for the tables, CSV exports, measurement lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwatch.functions.addresses import with_asn


def publishable_delay_alarms(alarms: DataFrame, rib: DataFrame, window: int) -> DataFrame:
    """One row for each link end of clear alarms, at the bin's centre, with its network."""
    a = alarms.where((F.col("dev_bound") >= 5) & (F.abs("diff_med") >= 5))
    ends = a.withColumn("ip", F.explode(F.array("ip1", "ip2"))).withColumn("ts", F.col("time_bin") + F.lit(window // 2))
    out = with_asn(ends, "ip", rib)
    return out.withColumn("msm_prb_ids", F.to_json("msm")) if "msm" in alarms.columns else out


def publishable_forwarding_alarms(resp: DataFrame, rib: DataFrame, registry: DataFrame, window: int, time_bin: int) -> DataFrame:
    """Responsibilities above 0.1 in the given bin for registered networks, at the bin's centre."""
    r = with_asn(resp.where((F.col("resp") > 0.1) & (F.col("time_bin") == time_bin)), "ip", rib).join(registry.select("asn"), "asn", "left_semi")
    r = r.withColumn("ts", F.col("time_bin") + F.lit(window // 2))
    return r.withColumn("msm_prb_ids", F.to_json(F.try_element_at("msm", "ip"))) if "msm" in resp.columns else r


def select_msm_metadata(meta: DataFrame) -> DataFrame:
    """Distinct ids of running, frequent, widely probed IPv4 traceroute measurements outside the excluded target range."""
    ok = (F.col("status") == 2) & (F.col("type") == "traceroute") & (F.col("af") == 4) & (F.col("interval") <= 1800)
    ok &= F.col("participant_count").isNull() | (F.col("participant_count") > 100)
    return meta.where(ok & ~F.coalesce(F.col("target_ip").startswith("184.164.224"), F.lit(False))).select("id").distinct()


def split_msm_by_af(meta: DataFrame) -> DataFrame:
    """(af, ids): the traceroute measurements of each address family, sorted."""
    return meta.where(F.col("type") == "traceroute").groupBy("af").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def delay_alarm_rows(alarms: DataFrame, rib: DataFrame) -> DataFrame:
    """The columns of the delay alarms' CSV, for increases; nulls become 0."""
    a = with_asn(with_asn(alarms.where(F.col("diff_med") > 1), "ip1", rib, "asn0"), "ip2", rib, "asn1")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0")).alias(c)
    when = F.date_format(F.timestamp_seconds("time_bin"), "yyyy-MM-dd HH:mm:ss").alias("_t")
    label = F.col("label") if "label" in alarms.columns else F.lit("none")
    return a.select(F.concat(when, F.lit("+00")).alias("time_bin"), text("asn0"), text("asn1"), F.col("ip1").alias("ip0"), F.col("ip2").alias("ip1"), text("dev_bound"), text("diff_med"), text("ref"), text("median"), label.alias("label"))


def forwarding_alarm_rows(resp: DataFrame, rib: DataFrame) -> DataFrame:
    """One row for each forwarding alarm with its most and least responsible next hop and their networks.

    Responsibilities that agree to nine digits are ties, of which the smaller address counts.
    """
    r = F.round("resp", 9)
    g = resp.groupBy("time_bin", "dst", "ip0").agg(
        F.min(F.struct((-r).alias("k"), F.col("ip"), F.col("resp").alias("r"))).alias("top"), F.min(F.struct(r.alias("k"), F.col("ip"), F.col("resp").alias("r"))).alias("low"))
    g = g.select("time_bin", "dst", "ip0", F.col("top.ip").alias("ip_most"), F.col("top.r").alias("resp_most"), F.col("low.ip").alias("ip_least"), F.col("low.r").alias("resp_least"))
    return with_asn(with_asn(g, "ip_most", rib, "asn_most"), "ip_least", rib, "asn_least")


def as_series_rows(series: DataFrame, label: str) -> DataFrame:
    """metric, value, label, time, asn of every network's hour."""
    return series.select("magnitude", "value", F.lit(label).alias("label"), F.date_format(F.timestamp_seconds("time_bin"), "yyyy-MM-dd HH:mm:ss").alias("time_bin"), F.col("asn").cast("string").alias("asn"))


def as_names(asns: DataFrame, table: DataFrame) -> DataFrame:
    """(asn, asname): the names of networks, from the prefix table (the first in order, if it has several); ``Unk`` without one."""
    names = table.groupBy("asn").agg(F.min("asname").alias("asname"))
    return asns.select("asn").distinct().join(names, "asn", "left").select("asn", F.coalesce("asname", F.lit("Unk")).alias("asname"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV without a header."""
    rows.write.mode("overwrite").option("header", False).csv(path)
