"""Statistics over links, references and alarms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwatch.functions.addresses import with_asn
from pathwatch.operators.statistics import medians, normal_scores, pearson, shapiro_of_sums
from pathwatch.session import ship_code, written

DAY = 86400


def daily_trace_counts(traces: DataFrame) -> DataFrame:
    """(af, date, n) with totals where a column is null."""
    return traces.select("af", F.to_date(F.timestamp_seconds("timestamp")).alias("date")).rollup("af", "date").agg(F.count("*").alias("n"))


def distinct_link_ips(links: DataFrame) -> DataFrame:
    return links.select(F.col("ip1").alias("ip")).union(links.select("ip2")).distinct()


def distinct_routers(ref: DataFrame) -> DataFrame:
    """(is_probe, n): distinct routers of the forwarding reference, those named probe... apart."""
    return ref.groupBy(F.col("ip0").startswith("probe").alias("is_probe")).agg(F.countDistinct("ip0").alias("n"))


def ips_per_asn(ref: DataFrame, rib: DataFrame) -> DataFrame:
    """(asn, n_ips): distinct next hops in the forwarding reference for each network."""
    hops = ref.select(F.explode(F.map_keys("ref")).alias("ip")).where(~F.col("ip").isin("0", "x")).distinct()
    return with_asn(hops, "ip", rib).groupBy("asn").agg(F.count("*").alias("n_ips"))


def link_asns(links: DataFrame, rib: DataFrame) -> DataFrame:
    """Links with the networks of both ends."""
    return with_asn(with_asn(links, "ip1", rib, "asn1"), "ip2", rib, "asn2")


def asn_link_counts(links: DataFrame) -> DataFrame:
    """(asn, n): links of each network; one inside a network counts once."""
    return links.select(F.explode(F.array_distinct(F.array("asn1", "asn2"))).alias("asn")).groupBy("asn").agg(F.count("*").alias("n"))


def endpoint_counts(links: DataFrame, a: str = "asn1", b: str = "asn2") -> DataFrame:
    """(key, n): link ends of each network or country; both ends count."""
    return links.select(F.explode(F.array(a, b)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def as_ranking(ends: DataFrame, counts: DataFrame, unit: str, min_ips: int = 0) -> DataFrame:
    """(asn, score): the unit's sum over the network's links and the number of bins, for networks with more than ``min_ips`` link ends."""
    bins = ends.agg(F.countDistinct("time_bin").alias("bins"))  # one row
    s = ends.groupBy("asn").agg(F.sum(unit).alias("s")).join(counts.where(F.col("n") > min_ips).select(F.col("key").alias("asn"), "n"), "asn")
    return s.crossJoin(F.broadcast(bins)).select("asn", (F.col("s") / F.col("n") / F.col("bins")).alias("score"))


def link_distribution_stats(samples: DataFrame, min_n: int = 48, value: str = "rtt_diff") -> DataFrame:
    """(ip1, ip2, n, mean, std, median, mad) of links with more than ``min_n`` samples; null values are left out.

    The median, and that of the distances from it, are exact, and no link's samples are in one place.
    """
    link = ["ip1", "ip2"]
    samples = written(samples.select(*link, value), "samples")  # traces are expanded once
    moments = written(samples.groupBy(*link).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).where(F.col("n") > min_n), "moments")
    own = samples.where(F.col(value).isNotNull()).select(*link, F.col(value).alias("_v")).join(moments.select(*link), link, "left_semi")
    middle = written(medians(own, link, "_v", moments).select(*link, "median"), "medians")
    off = own.join(middle, link).select(*link, F.abs(F.col("_v") - F.col("median")).alias("_off"))
    mad = medians(off, link, "_off", moments).select(*link, F.col("median").alias("mad"))
    return moments.join(middle, link).join(mad, link)


def histogram(values: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n): counts in equal bins of [low, high], the last one closed; values outside are left out."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return values.where(F.col(value).between(low, high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def normality(samples: DataFrame, min_n: int = 96, value: str = "rtt_diff") -> DataFrame:
    """(ip1, ip2, n, p): Shapiro-Wilk p value of all samples of links with more than ``min_n``; null values are left out.

    Equal samples are one row with a count; ranks come from a window sorted within a link, and the statistic from sums,
    so no link's samples are in one place. Royston fitted the p value up to 5,000 samples; as in the reference, the
    same formula is carried on for larger links, whose p is less accurate.
    """
    ship_code(samples.sparkSession)
    link = ["ip1", "ip2"]
    w = Window.partitionBy(*link)
    x = samples.where(F.col(value).isNotNull()).groupBy(*link, F.col(value).alias("x")).agg(F.count("*").alias("c"))
    x = x.select(*link, "x", "c", F.sum("c").over(w).alias("n"), (F.sum(F.col("x") * F.col("c")).over(w) / F.sum("c").over(w)).alias("mean"),
                 F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)).alias("high")).where(F.col("n") > min_n)

    def scores(low: pd.Series, high: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([normal_scores(*r) for r in zip(low, high, n)], columns=["s", "ss"])

    x = x.withColumn("m", F.pandas_udf(scores, "s double, ss double")(F.col("high") - F.col("c"), F.col("high"), F.col("n")))
    off = F.col("x") - F.col("mean")
    at = lambda rank: F.max(F.when((F.col("high") - F.col("c") < rank) & (rank <= F.col("high")), F.col("x")))
    sums = x.groupBy(*link, "n").agg(
        F.sum(F.col("m.s") * off).alias("mx"), F.sum("m.ss").alias("ss"), F.sum(off * off * F.col("c")).alias("spread"),
        F.min("x").alias("first"), at(F.lit(2)).alias("second"), at(F.col("n") - 1).alias("before"), F.max("x").alias("last"))

    def p(*columns: pd.Series) -> pd.Series:
        return pd.Series([shapiro_of_sums(*r) for r in zip(*columns)], dtype=float)

    return sums.select(*link, "n", F.pandas_udf(p, "double")("n", "mx", "ss", "spread", "first", "second", "before", "last").alias("p"))


def normality_and_samples(stats: DataFrame, min_n: int = 40, value: str = "median") -> DataFrame:
    """(ip1, ip2, n, p, mean_samples): normality of the bins' values of links with more than ``min_n`` bins, beside their mean number of samples."""
    samples = stats.groupBy("ip1", "ip2").agg(F.avg("n").alias("mean_samples"))
    return normality(stats.select("ip1", "ip2", value), min_n, value).join(samples, ["ip1", "ip2"])


def running_sum(df: DataFrame, order: str, weight: Column, series: list[str]) -> DataFrame:
    """``df`` with ``run`` and ``total``: the sum of the weights up to each row, in order, and of all, in each series.

    Rows are dealt out by ranges of the order, so that no series is in one task; the ranges' sums (a row for each range
    and series) give what lies before. The ranges are written, as they would not be the same if made again.
    """
    placed = written(df.withColumn("_w", weight).repartitionByRange(*series, order).withColumn("_p", F.spark_partition_id()), "ranges")
    keys = [*series, "_p"]
    w = Window.partitionBy(*series)
    sums = placed.groupBy(*keys).agg(F.sum("_w").alias("_s"))
    sums = sums.select(*keys, F.coalesce(F.sum("_s").over(w.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"), F.sum("_s").over(w).alias("total"))
    here = F.sum("_w").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_h", here).join(sums, keys).withColumn("run", F.col("_h") + F.col("_b")).drop("_w", "_p", "_h", "_b")


def ecdf(df: DataFrame, value: str, series: list[str], complementary: bool = False) -> DataFrame:
    """(*series, value, y): rank over count (from 0) in each series, or one minus that."""
    r = running_sum(df.select(*series, F.col(value).alias("value")), "value", F.lit(1), series)
    y = (F.col("run") - 1) / F.col("total")
    return r.select(*series, "value", (1 - y if complementary else y).alias("y"))


def summary(df: DataFrame, value: Column, name: str) -> list[Column]:
    """Aggregates of one value: mean, std, min, max, median."""
    return [F.avg(value).alias(f"{name}_mean"), F.stddev_pop(value).alias(f"{name}_std"), F.min(value).alias(f"{name}_min"), F.max(value).alias(f"{name}_max"), F.median(value).alias(f"{name}_median")]


def delay_reference_stats(ref: DataFrame) -> DataFrame:
    """One row over all links: interval above, below and whole, probes, reported links and their share."""
    up, down = F.col("high") - F.col("mean"), F.col("mean") - F.col("low")
    return ref.agg(*summary(ref, up, "up"), *summary(ref, down, "down"), *summary(ref, F.col("high") - F.col("low"), "size"), *summary(ref, F.col("nb_probes"), "probes"),
                   F.count("*").alias("links"), F.count_if(F.col("nb_reported") > 0).alias("reported"), F.try_divide(F.count_if(F.col("nb_reported") > 0), F.count("*")).alias("reported_share"))


def delay_reference_mad(ref: DataFrame) -> DataFrame:
    """One row over all links: the median absolute deviation of interval above, below and whole, and of the probes."""
    parts = {"up": F.col("high") - F.col("mean"), "down": F.col("mean") - F.col("low"), "size": F.col("high") - F.col("low"), "probes": F.col("nb_probes").cast("double")}
    x = ref.select(*[v.alias(k) for k, v in parts.items()])
    middle = x.agg(*[F.median(k).alias(f"m_{k}") for k in parts])  # one row
    return x.crossJoin(F.broadcast(middle)).agg(*[F.median(F.abs(F.col(k) - F.col(f"m_{k}"))).alias(f"{k}_mad") for k in parts])


def delay_reference_correlation(ref: DataFrame, min_seen: int = 24, min_probes: int = 3) -> DataFrame:
    """One row: Pearson and Spearman correlation of interval size and number of probes.

    Sizes are compared to nine digits, so that ties don't hang on the order of sums. Ranks come from the distinct values' counts (a running sum over one row for each value), not from a sort of all rows.
    """
    x = ref.where((F.col("nb_seen") > min_seen) & (F.col("nb_probes") > min_probes)).select(F.round(F.col("high") - F.col("low"), 9).alias("a"), F.col("nb_probes").cast("double").alias("b"))

    def ranks(c: str) -> DataFrame:
        n = x.groupBy(c).agg(F.count("*").alias("n"))
        return running_sum(n, c, F.col("n"), []).select(c, (F.col("run") - F.col("n") + (F.col("n") + 1) / 2).alias(f"r{c}"))

    return x.join(ranks("a"), "a").join(ranks("b"), "b").agg(pearson("a", "b").alias("pearson"), pearson("ra", "rb").alias("spearman"), F.count("*").alias("n"))


def observation_ratio(ref: DataFrame, window: int = 3600) -> DataFrame:
    """(bucket, n, mean, median): bins seen over bins between first and last, for links known under a day, a week, 30 days."""
    period = 1 + (F.col("last_seen") - F.col("first_seen")) / window
    span = F.col("last_seen") - F.col("first_seen")
    b = F.when(span < DAY, "day").when(span < 7 * DAY, "week").when(span < 30 * DAY, "month").otherwise("longer")
    return ref.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(F.col("nb_seen") / period).alias("mean"), F.median(F.col("nb_seen") / period).alias("median"))


def links_first_last_seen(ref: DataFrame) -> DataFrame:
    """(kind, ts, n): links by when they were first and last seen."""
    return ref.select(F.explode(F.array(F.struct(F.lit("first").alias("kind"), F.col("first_seen").alias("ts")), F.struct(F.lit("last").alias("kind"), F.col("last_seen").alias("ts")))).alias("s")).groupBy("s.kind", "s.ts").agg(F.count("*").alias("n"))


def forwarding_reference_stats(ref: DataFrame) -> DataFrame:
    """(dst, ip0, next_hops, reported) of every router but the lost one."""
    return ref.where(F.col("ip0") != "x").select("dst", "ip0", F.size(F.map_filter("ref", lambda k, v: k != "0")).alias("next_hops"), (F.col("nb_reported") > 0).alias("reported"))


def large_routers(ref: DataFrame, least: int = 1000) -> DataFrame:
    """(ip0, n): routers in more than ``least`` references."""
    return ref.where(F.col("ip0") != "x").groupBy("ip0").agg(F.count("*").alias("n")).where(F.col("n") > least)


def alarms_per_probe_count(alarms: DataFrame, links: DataFrame) -> DataFrame:
    """(nb_probes, ratio): alarms of links with so many probes over such links; 0 where there are none."""
    a = alarms.groupBy("nb_probes").agg(F.count("*").alias("a"))
    n = links.groupBy("nb_probes").agg(F.count("*").alias("n"))
    return n.join(a, "nb_probes", "left").select("nb_probes", (F.coalesce("a", F.lit(0)) / F.col("n")).alias("ratio"))


def metric_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(pearson(x, y).alias("r"))


def outlier_share(samples: DataFrame, value: str = "rtt_diff") -> DataFrame:
    """(ip1, ip2, share): samples beyond three population deviations from the link's mean."""
    s = samples.groupBy("ip1", "ip2").agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    far = F.abs(F.col(value) - F.col("m")) > 3 * F.col("s")
    return samples.join(s, ["ip1", "ip2"]).groupBy("ip1", "ip2").agg(F.avg(far.cast("double")).alias("share"))


def anomaly_graph(alarms: DataFrame, time_bin: int) -> DataFrame:
    """(ip1, ip2, deviation, diff_med): one undirected edge for each link with a delay increase in a bin."""
    return alarms.where((F.col("diff_med") > 1) & (F.col("time_bin") == time_bin)).groupBy("ip1", "ip2").agg(F.max_by("deviation", "deviation").alias("deviation"), F.max_by("diff_med", "deviation").alias("diff_med"))


def root_server_links(links: DataFrame, alarms: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, links, reported): distinct links with a listed address (the first end that is one), overall and among the alarms.

    ``roots``: (ip, name), a short list that is broadcast.
    """
    def matched(df: DataFrame) -> DataFrame:
        a = F.broadcast(roots.select(F.col("ip").alias("ip1"), F.col("name").alias("n1")))
        b = F.broadcast(roots.select(F.col("ip").alias("ip2"), F.col("name").alias("n2")))
        return df.join(a, "ip1", "left").join(b, "ip2", "left").withColumn("name", F.coalesce("n1", "n2")).where("name IS NOT NULL").groupBy("name").agg(F.countDistinct("ip1", "ip2").alias("n"))

    every, told = matched(links), matched(alarms).withColumnRenamed("n", "m")
    return roots.select("name").distinct().join(every, "name", "left").join(told, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("links"), F.coalesce("m", F.lit(0)).alias("reported"))


def register_asns(seen: DataFrame, registry: DataFrame, flag: str = "delay") -> DataFrame:
    """The registry of networks with those seen added, and the flag set on those seen."""
    s = seen.select("asn").distinct().withColumn("_s", F.lit(True))
    return registry.join(s, "asn", "full_outer").select("asn", *[F.coalesce(F.col("_s"), F.col(c), F.lit(False)).alias(c) if c == flag else F.col(c) for c in registry.columns if c != "asn"])
