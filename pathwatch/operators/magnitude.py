"""Hourly series of each network, their magnitudes, events and keywords."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pathwatch.functions.addresses import prefix24, with_asn
from pathwatch.functions.expand import median_of
from pathwatch.operators.statistics import mad_of
from pathwatch.session import ship_code

HOUR = 3600


def hourly_grid(df: DataFrame, value: str, start: int, end: int, asn: str = "asn", ts: str = "time_bin", asns: DataFrame | None = None) -> DataFrame:
    """(asn, time_bin, value): the sum for each hour from ``start`` to ``end``, 0 where there is nothing.

    ``asns`` names the networks (default: those in ``df``).
    """
    hour = (F.floor(F.col(ts) / HOUR) * HOUR).alias("time_bin")
    sums = df.where((F.col(ts) >= start) & (F.col(ts) < end + HOUR)).groupBy(F.col(asn).alias("asn"), hour).agg(F.sum(value).alias("_v"))
    names = (df.select(F.col(asn).alias("asn")) if asns is None else asns.select("asn")).distinct()
    grid = names.withColumn("time_bin", F.explode(F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(HOUR).cast("long"))))
    return grid.join(sums, ["asn", "time_bin"], "left").select("asn", "time_bin", F.coalesce("_v", F.lit(0.0)).alias("value"))


def _nearest(w: list[float], center: float, k: int) -> float:
    """The k-th smallest (from 0) distance from ``center`` in a sorted list, by bisection between its two sides."""
    left = bisect.bisect_left(w, center)
    below, above = lambda i: center - w[left - 1 - i], lambda i: w[left + i] - center
    low, high = max(0, k + 1 - (len(w) - left)), min(k + 1, left)
    while low < high:
        i = (low + high) // 2
        low, high = (i + 1, high) if above(k - i) > below(i) else (low, i)
    return max(below(low - 1) if low else 0.0, above(k - low) if low <= k else 0.0)


def sliding_magnitude(values: np.ndarray, rows: int, min_periods: int = 1, true_mad: bool = True) -> np.ndarray:
    """Each value's distance from the median of the last ``rows``, over 1 + 1.4826 MAD; NaN where too few are there.

    The frame is kept sorted: a row takes one value in and one out, and both medians are looked up in it, so the cost of
    a row hardly depends on the length of the frame. NaN values are left out.
    """
    w: list[float] = []
    out = np.full(len(values), np.nan)
    x = values.tolist()
    for i, v in enumerate(x):
        if v == v:
            bisect.insort(w, v)
        if i >= rows and x[i - rows] == x[i - rows]:
            del w[bisect.bisect_left(w, x[i - rows])]
        n = len(w)
        if n and n >= min_periods:
            median = (w[(n - 1) // 2] + w[n // 2]) / 2
            mad = (_nearest(w, median, (n - 1) // 2) + _nearest(w, median, n // 2)) / 2 if true_mad else 0.0
            out[i] = (v - median) / (1 + 1.4826 * mad)
    return out


def rolling_magnitude(series: DataFrame, history: int = 168, min_periods: int = 1, by: str | None = "asn", mad: str = "values", rows: int | None = None) -> DataFrame:
    """``series`` with its magnitude: distance from the median of the last ``history`` rows over 1 + 1.4826 MAD.

    Null while a row has fewer than ``min_periods`` rows in its frame. mad="notnull" takes the deviation of which values
    are present instead of the values', which is 0 on a full grid. by=None: one overall series, a row for each hour.
    A task holds one network's series, a number for each hour.
    """
    ship_code(series.sparkSession)
    length, true_mad = rows or history, mad != "notnull"

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("time_bin")
        x = t["value"].cast(pa.float64()).to_numpy(zero_copy_only=False)
        made = sliding_magnitude(np.where([v is None for v in t["value"].to_pylist()], np.nan, x) if t["value"].null_count else x, length, min_periods, true_mad)
        return t.append_column("magnitude", pa.array(made, from_pandas=True))

    schema = StructType([*series.schema.fields, StructField("magnitude", DoubleType())])
    return series.groupBy(*([by] if by else [])).applyInArrow(run, schema)


def as_magnitude(series: DataFrame, history: int = 168, mad: str = "values") -> DataFrame:
    """Magnitude of every hour against itself and the ``history`` hours before."""
    return rolling_magnitude(series, mad=mad, rows=history + 1)


def link_ends(alarms: DataFrame, rib: DataFrame) -> DataFrame:
    """One row for each end of an alarm's link, with its network and /24 prefix; an internal link counts twice."""
    ends = alarms.withColumn("ip", F.explode(F.array("ip1", "ip2")))
    return with_asn(ends, "ip", rib).withColumn("prefix", prefix24(F.col("ip")))


def derived_alarm_columns(alarms: DataFrame, rib: DataFrame) -> DataFrame:
    """Link ends with absolute values and packet-weighted units."""
    return link_ends(alarms, rib).withColumns({"diff_med_abs": F.abs("diff_med"), "diff_abs": F.abs("diff"), "dev_bound_pkt": F.col("dev_bound") * F.col("n")})


def magnitudes_at(units: DataFrame, unit: str, bins: list[int], history: int = 168, asns: DataFrame | None = None, mad: str = "values") -> DataFrame:
    """(asn, time_bin, value, magnitude) of each network at each of the given bins.

    The magnitude of a bin compares its hour's sum with the median of that and the ``history`` hours before; as many
    values as hours are needed, so what ``units`` does not have is filled up with zeros, and the hour at the far end is
    one (it lies outside the history). A network's hour goes to the bins that look back on it, at most ``history`` times;
    an array holds history + 1 numbers. ``asns``: the networks (with time_bin: of each bin), default: those with units.
    """
    hour, last = lambda c: (F.floor(c / HOUR) * HOUR).cast("long"), HOUR * (history - 1)
    at = F.array(*[F.struct(F.lit(b).cast("long").alias("time_bin"), F.lit(b // HOUR * HOUR).cast("long").alias("h")) for b in bins])
    near = units.where(F.col("time_bin").between(min(bins) // HOUR * HOUR - last, max(bins) // HOUR * HOUR + HOUR - 1))
    sums = near.groupBy("asn", hour(F.col("time_bin")).alias("hour")).agg(F.sum(unit).alias("v"))
    past = sums.select("asn", "hour", "v", F.explode(F.filter(at, lambda b: F.col("hour").between(b["h"] - last, b["h"]))).alias("b"))
    known = past.groupBy("asn", "b.time_bin").agg(F.collect_list("v").alias("vs"), F.coalesce(F.sum(F.when(F.col("hour") == F.col("b.h"), F.col("v"))), F.lit(0.0)).alias("value"))
    if asns is not None:
        wanted = asns.select("asn", "time_bin") if "time_bin" in asns.columns else asns.select("asn", F.explode(F.transform(at, lambda b: b["time_bin"])).alias("time_bin"))
        known = wanted.distinct().join(known, ["asn", "time_bin"], "left").select("asn", "time_bin", F.coalesce("vs", F.array().cast("array<double>")).alias("vs"), F.coalesce("value", F.lit(0.0)).alias("value"))
    known = known.withColumn("vs", F.concat("vs", F.array_repeat(F.lit(0.0), F.lit(history + 1) - F.size("vs")))).withColumn("median", median_of(F.col("vs")))
    spread = F.lit(0.0) if mad == "notnull" else mad_of(F.col("vs"), F.col("median"))
    return known.select("asn", "time_bin", "value", ((F.col("value") - F.col("median")) / (1 + F.lit(1.4826) * spread)).alias("magnitude"))


def delay_magnitude(alarms: DataFrame, rib: DataFrame, at: int | list[int], history: int = 168, asns: DataFrame | None = None, mad: str = "values") -> DataFrame:
    """(asn, time_bin, value, magnitude) at the given bins: increases only, both link ends, summed deviation bounds for each hour."""
    bins = [at] if isinstance(at, int) else at
    a = alarms.where((F.col("diff_med") > 1) & (F.col("time_bin") > min(bins) - history * HOUR) & (F.col("time_bin") <= max(bins)))
    return magnitudes_at(link_ends(a, rib), "dev_bound", bins, history, asns, mad)


def forwarding_magnitude(resp: DataFrame, rib: DataFrame, at: int | list[int], history: int = 168, asns: DataFrame | None = None, mad: str = "values") -> DataFrame:
    """(asn, time_bin, value, magnitude) at the given bins, of the summed responsibilities of each network."""
    bins = [at] if isinstance(at, int) else at
    r = with_asn(resp.where((F.col("time_bin") > min(bins) - history * HOUR) & (F.col("time_bin") <= max(bins))), "ip", rib)
    return magnitudes_at(r, "resp", bins, history, asns, mad)


def sum_by_time(alarms: DataFrame, metric: str, where: str | None = None) -> DataFrame:
    """(time_bin, value): the metric's sum for each bin over the rows that satisfy a condition."""
    return (alarms.where(where) if where else alarms).groupBy("time_bin").agg(F.sum(metric).alias("value"))


def alarm_count_events(alarms: DataFrame, corr_max: float = 0.05) -> DataFrame:
    """(dst, time_bin, n, event): alarms for each destination and bin; event: more than mean + 3 population deviations."""
    n = alarms.where(F.col("corr") < corr_max).groupBy("dst", "time_bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("dst")
    return n.withColumn("event", F.col("n") > F.avg("n").over(w) + 3 * F.stddev_pop("n").over(w))


def magnitude_events(series: DataFrame, tau: float, absolute: bool = False) -> DataFrame:
    """Rows whose magnitude exceeds tau (or whose absolute value does)."""
    m = F.abs("magnitude") if absolute else F.col("magnitude")
    return series.where(m > tau)


def event_counts(events: DataFrame) -> DataFrame:
    """One row: networks with events, and mean, median, deviation and sum of their numbers of events."""
    per = events.groupBy("asn").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_asn"), F.avg("n").alias("mean"), F.median("n").alias("median"), F.stddev_samp("n").alias("std"), F.sum("n").alias("total"))


def signed_as_groups(resp: DataFrame) -> DataFrame:
    """(time_bin, label, resp): responsibilities by network and sign, networks labelled +asn and -asn."""
    label = F.concat(F.when(F.col("resp") < 0, "-").otherwise("+"), F.col("asn").cast("string"))
    return resp.groupBy("time_bin", label.alias("label")).agg(F.sum("resp").alias("resp"))


def event_keywords(df: DataFrame, events: DataFrame, metric: str, word: str = "word", history: int = 168 * HOUR, threshold: float = 0.0, min_tf: float = 0.0) -> DataFrame:
    """(time_bin, word, tf, tfidf) of the words that stand out in each event bin.

    tf: the word's share of the bin's metric; idf: the log of one plus the whole frame's metric over the word's in the
    history before the bin, the bin included. One aggregation by word and bin and one range frame; words are keys, so
    a frame never spans more than a word's bins.
    """
    per = df.groupBy(F.col(word).alias("word"), "time_bin").agg(F.sum(metric).alias("v"))
    past = Window.partitionBy("word").orderBy("time_bin").rangeBetween(-history, 0)
    bins = df.groupBy("time_bin").agg(F.sum(metric).alias("bin_v"))
    total = df.agg(F.sum(metric).alias("total"))  # one row
    x = per.withColumn("h", F.sum("v").over(past)).join(events.select("time_bin").distinct(), "time_bin", "left_semi").join(bins, "time_bin").crossJoin(F.broadcast(total))
    tf = F.abs(F.try_divide("v", "bin_v"))
    idf = F.log(1 + F.abs(F.try_divide("total", "h")))
    return x.select("time_bin", "word", tf.alias("tf"), (tf * idf).alias("tfidf")).where((F.col("tfidf") > threshold) & (F.col("tf") > min_tf))


def event_labels(keywords: DataFrame) -> DataFrame:
    """(time_bin, label): each event's words with their shares, the most telling first."""
    one = F.concat(F.col("word"), F.lit(" ("), F.round(F.col("tf") * 100).cast("int").cast("string"), F.lit("%)"))
    top = F.array_sort(F.collect_list(F.struct((-F.col("tfidf")).alias("k"), F.col("word").alias("w"), one.alias("t"))))
    return keywords.groupBy("time_bin").agg(F.array_join(F.transform(top, lambda x: x["t"]), ", ").alias("label"))


def as_bin_stats(df: DataFrame, value: str, ip: str = "ip", big: float = 10.0) -> DataFrame:
    """(asn, time_bin, mean, median, total, std, n_ips, n_big_ips) of a metric."""
    return df.groupBy("asn", "time_bin").agg(
        F.avg(value).alias("mean"), F.median(value).alias("median"), F.sum(value).alias("total"), F.stddev_samp(value).alias("std"),
        F.countDistinct(ip).alias("n_ips"), F.countDistinct(F.when(F.col(value) > big, F.col(ip))).alias("n_big_ips"))
