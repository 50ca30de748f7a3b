"""Delay-change detection: statistics of every link and bin, and the ordered comparison with a moving reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwatch.functions.addresses import with_asn
from pathwatch.functions.expand import differential_rtts, median_of
from pathwatch.operators.folds import running, smoothed
from pathwatch.operators.statistics import LARGE, entropy_of, median_ci, trim_plan, trimmed_samples
from pathwatch.schema import DELAY_REFERENCE, Params
from pathwatch.session import ship_code, written

LINK = ["time_bin", "ip1", "ip2"]


def time_range(df: DataFrame, start: int, end: int, ts: str = "timestamp") -> DataFrame:
    """start <= ts < end; prunes the day partitions where there is a ``date`` column."""
    out = df.where((F.col(ts) >= start) & (F.col(ts) < end))
    if "date" in df.columns:
        out = out.where(F.col("date").between(F.to_date(F.timestamp_seconds(F.lit(start))), F.to_date(F.timestamp_seconds(F.lit(end)))))
    return out


def time_bin(ts: Column, start: int, window: int) -> Column:
    """Start of the bin of ``window`` seconds, counted from ``start``."""
    return start + F.floor((ts - start) / window) * window


def valid_traces(df: DataFrame) -> DataFrame:
    """Traces with at least one hop whose first hop carries no error."""
    return df.where((F.size("result") > 0) & F.col("result")[0]["error"].isNull())


def seen_prefix(df: DataFrame, regex: str) -> DataFrame:
    """Traces in which any reply's address matches."""
    return df.where(F.coalesce(F.exists("result", lambda h: F.exists(h["result"], lambda r: r["from"].rlike(regex))), F.lit(False)))


def link_samples(traces: DataFrame, p: Params) -> DataFrame:
    """(time_bin, ip1, ip2, rtt_diff, probe_ip, msm_id, prb_id) of all valid traces of the experiment, long form."""
    t = time_range(valid_traces(traces), p.start, p.end)
    if p.prefixes:
        t = seen_prefix(t, p.prefixes)
    t = t.withColumn("time_bin", time_bin(F.col("timestamp"), p.start, p.window)).withColumn("probe_ip", F.col("from"))
    return differential_rtts(t, "time_bin", "probe_ip", "msm_id", "prb_id")


def link_filter(links: DataFrame, prefix: str) -> DataFrame:
    """Links with either end under a prefix."""
    return links.where(F.col("ip1").startswith(prefix) | F.col("ip2").startswith(prefix))


def delay_stats(samples: DataFrame, rib: DataFrame, p: Params, trim: bool = True) -> DataFrame:
    """One row for each bin and link that enough networks see: n, median, lo, hi, n_asn, entropy, nb_probes, asns, trimmed.

    The samples are written once, so that traces are expanded once. Networks come from a table of samples for each
    probe, where each distinct probe is looked up; diversity and trimming are decided on counts. nb_probes are all
    distinct probes of the link, trimmed or not; asns are the networks left.
    """
    s = written(samples.select(*LINK, "rtt_diff", "probe_ip", "msm_id", "prb_id"), "samples")
    probes = written(with_asn(s.groupBy(*LINK, "probe_ip").agg(F.count("*").alias("c")), "probe_ip", rib), "probes")
    counts = probes.groupBy(*LINK, "asn").agg(F.sum("c").alias("c"), F.count("*").alias("p"))
    sizes = counts.groupBy(*LINK).agg(F.sum("c").alias("n"))
    if not trim:
        seen = counts.groupBy(*LINK).agg(F.sum("p").alias("nb_probes"), F.array_sort(F.collect_list("asn")).alias("asns"))
        ent = entropy_of(counts, LINK).drop("n").where((F.col("n_asn") >= p.min_asn) & (F.col("entropy") >= p.min_entropy))
        return median_ci(s, LINK, "rtt_diff", p.confidence, sizes).join(ent.join(seen, LINK), LINK).withColumn("trimmed", F.lit(False))
    plan = written(trim_plan(counts.select(*LINK, "asn", "c"), LINK, "asn", p.min_asn, p.min_entropy), "trim_plan")
    groups = plan.groupBy(*LINK).agg(F.max("trimmed").alias("trimmed"), F.max("n_asn").alias("n_asn"), F.max("entropy").alias("entropy"), F.array_sort(F.collect_list(F.when(F.col("keep") > 0, F.col("asn")))).alias("asns"))
    groups = groups.join(probes.groupBy(*LINK).agg(F.count("*").alias("nb_probes")), LINK)
    known = s.join(probes.select(*LINK, "probe_ip", "asn"), [*LINK, "probe_ip"])
    kept = trimmed_samples(known, plan, LINK, "asn", ["probe_ip", "msm_id", "prb_id"], ["rtt_diff"])
    sizes = plan.groupBy(*LINK).agg(F.sum("keep").alias("n"))
    return median_ci(kept, LINK, "rtt_diff", p.confidence, sizes).join(groups, LINK)


def with_measurements(alarms: DataFrame, samples: DataFrame) -> DataFrame:
    """Alarms with ``msm``, the map from each measurement to its probes, of all samples of their link and bin.

    Samples of other links are dropped before anything is grouped.
    """
    own = samples.select(*LINK, "msm_id", "prb_id").join(alarms.select(*LINK).distinct(), LINK, "left_semi")
    return alarms.join(msm_probe_map(own, LINK), LINK, "left")


def link_probes(samples: DataFrame, stats: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """(ip1, ip2, probe_ip): every probe that has seen a link in a bin with statistics; ``old`` are those of earlier runs."""
    now = samples.select(*LINK, "probe_ip").distinct().join(stats.select(*LINK), LINK, "left_semi").select("ip1", "ip2", "probe_ip")
    return (now if old is None else now.unionByName(old.select("ip1", "ip2", "probe_ip"))).distinct()


def msm_probe_map(samples: DataFrame, keys: list[str], msm: str = "msm_id", prb: str = "prb_id") -> DataFrame:
    """(*keys, msm): a map from measurement to its sorted distinct probes."""
    one = samples.groupBy(*keys, msm).agg(F.array_sort(F.collect_set(prb)).alias("_p"))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(msm).alias("m"), F.col("_p").alias("p"))))).alias("msm"))


def deviation_columns(med: Column, lo: Column, hi: Column, mean: Column, low: Column, high: Column) -> dict[str, Column]:
    """How far a bin lies from its reference; null instead of infinite where the reference's bound is its mean."""
    down = med < mean
    diff_med = med - mean
    diff = F.when(down, hi - low).otherwise(lo - high)
    divisor = F.when(down, low - mean).otherwise(high - mean)
    return {"alarm": (high < lo) | (low > hi), "diff": diff, "diff_med": diff_med, "deviation": F.try_divide(diff_med, divisor), "dev_bound": F.try_divide(diff, divisor)}


def delay_deviation(stats: DataFrame, ref: DataFrame) -> DataFrame:
    """Single-bin form: statistics with the reference of their link and how far they deviate; unmatched links have nulls."""
    x = stats.join(ref.select("ip1", "ip2", "mean", "low", "high"), ["ip1", "ip2"], "left")
    return x.withColumns(deviation_columns(F.col("median"), F.col("lo"), F.col("hi"), F.col("mean"), F.col("low"), F.col("high")))


def attach_reference(stats: DataFrame, ref: DataFrame, keys: list[str] = ["ip1", "ip2"], columns: list[str] | None = None) -> DataFrame:  # noqa: B006
    """Statistics beside the reference of their key (``columns`` of it, default: all); keys that only one side has stay, with nulls."""
    own = ref.select(*keys, *[c for c in (columns or ref.columns) if c not in keys])
    return stats.join(own, keys, "full_outer")


STEP = "time_bin long, ip1 string, ip2 string, n long, median double, lo double, hi double, ref double, ref_low double, ref_high double, nb_seen int, alarm boolean, diff double, diff_med double, deviation double, dev_bound double, mean double, low double, high double, boot array<struct<med:double,hi:double,lo:double>>, first_seen long, last_seen long, nb_reported int, nb_trimmed int, is_last boolean"


def _fold(p: Params):
    def run(key, now: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        ip1, ip2 = key
        boot, mean, low, high, seen, told, cut, first, last = [], None, None, None, 0, 0, 0, None, None
        if len(old):
            o = old.iloc[0]
            seen, told, cut, first, last = int(o.nb_seen), int(o.nb_reported), int(o.nb_trimmed), int(o.first_seen), int(o.last_seen)
            boot = [(b["med"], b["hi"], b["lo"]) for b in (o.boot if o.boot is not None else [])]
            mean, low, high = (None if pd.isna(v) else float(v) for v in (o["mean"], o["low"], o["high"]))
        out = []
        for r in now.sort_values("time_bin").itertuples(index=False):
            if p.expire_days is not None and last is not None and r.time_bin - p.window - last > p.expire_days * 86400:
                boot, mean, low, high, seen, told, cut, first = [], None, None, None, 0, 0, 0, None
            row = dict(time_bin=r.time_bin, ip1=ip1, ip2=ip2, n=r.n, median=r.median, lo=r.lo, hi=r.hi, ref=mean, ref_low=low, ref_high=high, nb_seen=seen, alarm=False, diff=None, diff_med=None, deviation=None, dev_bound=None)
            if seen >= p.min_seen and mean is not None:
                down = r.median < mean
                diff, div = (r.hi - low, low - mean) if down else (r.lo - high, high - mean)
                row |= dict(alarm=bool(high < r.lo or low > r.hi), diff=diff, diff_med=r.median - mean)
                if div:
                    row |= dict(deviation=(r.median - mean) / div, dev_bound=diff / div)
            told += row["alarm"]
            cut += r.trimmed
            seen += 1
            first, last = (r.time_bin if first is None else first), r.time_bin
            if mean is None:
                boot.append((r.median, r.hi, r.lo))
                if seen >= p.min_seen:
                    mean, high, low = (float(np.median(v)) for v in zip(*boot))
                    boot = []
            else:
                mean, high, low = ((1 - p.alpha) * a + p.alpha * b for a, b in ((mean, r.median), (high, r.hi), (low, r.lo)))
            out.append(row | dict(mean=mean, low=low, high=high, boot=[dict(med=a, hi=b, lo=c) for a, b, c in boot], first_seen=first, last_seen=last, nb_reported=told, nb_trimmed=cut, is_last=False))
        if out:
            out[-1]["is_last"] = True
        elif len(old):
            return pd.DataFrame()
        return pd.DataFrame(out)

    return run


BOOT = "array<struct<med:double,hi:double,lo:double>>"


def reference_steps(stats: DataFrame, ref0: DataFrame, p: Params, large: int = LARGE) -> DataFrame:
    """Each bin of a link with the reference before it (ref, ref_low, ref_high) and after it (mean, low, high).

    A link's bins are numbered in order (i), and fall into segments (seg) where it was not seen for too long and begins
    anew; the first segment goes on from ``ref0``. seen: bins before this one. The reference is the median of a segment's
    first ``min_seen`` bins (boot: those of them that are there), then an exponential average, see ``smoothed``.
    """
    link, seg = ["ip1", "ip2"], ["ip1", "ip2", "seg"]
    old = ref0.select(*link, F.col("mean").alias("m0"), F.col("high").alias("h0"), F.col("low").alias("l0"), F.col("boot").alias("boot0"), F.col("first_seen").alias("first0"), F.col("last_seen").alias("last0"),
                      F.col("nb_seen").alias("seen0"), F.col("nb_reported").alias("told0"), F.col("nb_trimmed").alias("cut0"))
    x = running(stats.select(*LINK, "n", "median", "lo", "hi", F.col("trimmed").cast("long").alias("cut")), link, "time_bin", F.lit(1), large).withColumn("i", F.col("run") - 1).drop("run").join(old, link, "left")
    if p.expire_days is None:
        x = x.withColumns({"seg": F.lit(0).cast("long"), "j": F.col("i")})
    else:
        before = x.select(*link, (F.col("i") + 1).alias("i"), F.col("time_bin").alias("prev"))
        gap = F.col("time_bin") - p.window - F.coalesce("prev", "last0") > p.expire_days * 86400
        x = x.join(before, [*link, "i"], "left").withColumn("anew", F.coalesce(gap, F.lit(False)).cast("long")).drop("prev")
        x = running(x, link, "time_bin", F.col("anew"), large).withColumnRenamed("run", "seg").drop("anew")
        x = x.join(x.groupBy(*seg).agg(F.min("i").alias("i0")), seg).withColumn("j", F.col("i") - F.col("i0")).drop("i0")
    goes_on = (F.col("seg") == 0) & F.col("seen0").isNotNull()
    x = x.withColumns({c: F.when(goes_on, F.col(c)) for c in ("m0", "h0", "l0", "boot0", "first0", "seen0", "told0", "cut0")})
    x = x.withColumns({"at": F.greatest(F.lit(0), F.lit(p.min_seen - 1) - F.coalesce("seen0", F.lit(0))), "seen": F.coalesce("seen0", F.lit(0)) + F.col("j")})
    x = written(x, "numbered_bins")
    # at most min_seen bins of a segment
    boot = x.where(F.col("m0").isNull() & (F.col("j") <= F.col("at"))).groupBy(*seg).agg(
        F.array_sort(F.collect_list(F.struct("j", F.col("median").alias("med"), "hi", "lo"))).alias("rows"), F.first("boot0").alias("boot0"), F.first("at").alias("at"))
    rows = F.concat(F.coalesce("boot0", F.array().cast(BOOT)), F.transform("rows", lambda r: F.struct(r["med"].alias("med"), r["hi"].alias("hi"), r["lo"].alias("lo"))).cast(BOOT))
    full = F.size("rows") > F.col("at")
    base = lambda c: F.when(full, median_of(F.transform("all", lambda r: r[c])))
    boot = boot.withColumn("all", rows).select(*seg, F.when(~full, F.col("all")).alias("boot"), base("med").alias("b_med"), base("hi").alias("b_hi"), base("lo").alias("b_lo"))
    x = x.drop("boot0").join(boot, seg, "left").withColumn("k", F.when(F.col("m0").isNotNull(), F.col("j") + 1).otherwise(F.col("j") - F.col("at")))
    x = x.withColumns({"s_med": F.coalesce("m0", "b_med"), "s_hi": F.coalesce("h0", "b_hi"), "s_lo": F.coalesce("l0", "b_lo")})
    names = {"ref": "med_before", "ref_high": "hi_before", "ref_low": "lo_before", "mean": "med_after", "high": "hi_after", "low": "lo_after"}
    kept = [*seg, "time_bin", "n", "median", "lo", "hi", "cut", "j", "seen", "first0", "told0", "cut0", "boot"]
    later = smoothed(x.where("k >= 1"), seg, "k", {"med": ("median", "s_med"), "hi": ("hi", "s_hi"), "lo": ("lo", "s_lo")}, p.alpha).select(*kept, *[F.col(v).alias(c) for c, v in names.items()])
    none = F.lit(None).cast("double")
    made = lambda c: F.when(F.col("k") == 0, F.col(c))
    early = x.where("k <= 0").select(*kept, none.alias("ref"), none.alias("ref_high"), none.alias("ref_low"), made("b_med").alias("mean"), made("b_hi").alias("high"), made("b_lo").alias("low"))
    return early.unionByName(later)


def _composed(stats: DataFrame, ref0: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Alarms and references of links with very many bins, by ``reference_steps``: no task sees all bins of a link."""
    link, seg = ["ip1", "ip2"], ["ip1", "ip2", "seg"]
    off = deviation_columns(*map(F.col, ("median", "lo", "hi", "ref", "ref_low", "ref_high")))
    steps = reference_steps(stats, ref0, p).withColumns({c: F.when(F.col("seen") >= p.min_seen, v) for c, v in off.items()}).withColumn("alarm", F.coalesce("alarm", F.lit(False)))
    steps = written(steps, "delay_steps")
    ends = steps.groupBy(*seg).agg(
        F.max_by(F.struct("mean", "high", "low", "boot", "seen"), "j").alias("e"), F.coalesce(F.first("first0"), F.min("time_bin")).alias("first_seen"), F.max("time_bin").alias("last_seen"),
        (F.coalesce(F.first("told0"), F.lit(0)) + F.count_if("alarm")).alias("told"), (F.coalesce(F.first("cut0"), F.lit(0)) + F.sum("cut")).alias("cut"))
    last = ends.groupBy(*link).agg(F.max_by(F.struct("e", "first_seen", "last_seen", "told", "cut"), "seg").alias("r"))
    ref = last.select(*link, "r.e.mean", "r.e.high", "r.e.low", F.when(F.col("r.e.mean").isNull(), F.col("r.e.boot")).otherwise(F.array().cast(BOOT)).alias("boot"), "r.first_seen", "r.last_seen",
                      (F.col("r.e.seen") + 1).cast("int").alias("nb_seen"), F.col("r.told").cast("int").alias("nb_reported"), F.col("r.cut").cast("int").alias("nb_trimmed"))
    ref = ref.select(*[c.name for c in ref0.schema])
    nth = F.coalesce("told0", F.lit(0)) + F.row_number().over(Window.partitionBy(*seg).orderBy("time_bin"))
    return steps.where("alarm").select(*LINK, "n", "median", "lo", "hi", "ref", "ref_low", "ref_high", F.col("seen").cast("int").alias("nb_seen"), "alarm", "diff", "diff_med", "deviation", "dev_bound", nth.cast("int").alias("nb_reported")), ref


def _folded(stats: DataFrame, ref0: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Alarms and references by stepping through a link's bins, a row each."""
    ship_code(stats.sparkSession)
    steps = stats.groupBy("ip1", "ip2").cogroup(ref0.groupBy("ip1", "ip2")).applyInPandas(_fold(p), STEP)
    steps = written(steps, "delay_steps")
    ref = steps.where("is_last").withColumn("nb_seen", (F.col("nb_seen") + 1).cast("int")).select(*[c.name for c in ref0.schema])
    return steps.where("alarm").drop("mean", "low", "high", "boot", "first_seen", "last_seen", "nb_trimmed", "is_last"), ref


def detect_delay_changes(stats: DataFrame, ref0: DataFrame | None, p: Params, changes: bool = False, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Alarms, and the reference after the last bin (``changes``: only of the links that were seen).

    A link's bins are taken in order: a bin is compared with the reference as it was before (once that has seen
    ``min_seen`` bins), which then takes it in, first as a median of ``min_seen`` bins, then as an exponential average.
    Links of up to ``large`` bins are stepped through, so that windows analysed one by one or together give the same to
    the last bit; those with more are cut into blocks whose maps are composed, which agrees up to rounding.
    References of links not seen stay as they are. Alarms keep the other columns of their bin's statistics.
    """
    spark, link = stats.sparkSession, ["ip1", "ip2"]
    ref0 = spark.createDataFrame([], DELAY_REFERENCE) if ref0 is None else ref0
    # a row for each link and bin, read several times
    stats = written(stats, "bin_stats")
    trimmed = F.col("trimmed") if "trimmed" in stats.columns else F.lit(False)
    own = stats.select(*LINK, "n", "median", "lo", "hi", trimmed.alias("trimmed"))
    long_ = written(own.groupBy(*link).agg(F.count("*").alias("_n")).where(F.col("_n") > large).select(*link), "long_links")
    if long_.isEmpty():
        told, ref = _folded(own, ref0, p)
    else:
        few, many = (_folded(*(t.join(long_, link, "left_anti") for t in (own, ref0)), p), _composed(*(t.join(long_, link, "left_semi") for t in (own, ref0)), p))
        told, ref = few[0].unionByName(many[0]), few[1].unionByName(many[1])
    if not changes:
        ref = ref.unionByName(ref0.join(ref.select(*link), link, "left_anti").select(*ref.columns))
    more = [c for c in ("n_asn", "entropy", "asns", "nb_probes", "trimmed") if c in stats.columns]
    return (told.join(stats.select(*LINK, *more), LINK) if more else told), ref


def expire_reference(ref: DataFrame, now: int, days: int = 7) -> DataFrame:
    """References seen within the last ``days`` days."""
    return ref.where(F.col("last_seen") >= now - days * 86400)


def link_history(samples: DataFrame, p: Params, boot: int = 24, least: int = 20, least_bin: int = 3, gap: float = 1.0) -> DataFrame:
    """(ip1, ip2, time_bin, n, median, smooth, smooth_lo, smooth_hi, alarm) for links with more than ``least`` samples.

    The reference is made of the first ``boot`` bins (their medians, once they are there), then an exponential average;
    a bin is an alarm if its interval is disjoint from the band that already holds it and its median is off by more
    than ``gap``. The bin at which the reference is made is no alarm.
    """
    link = ["ip1", "ip2"]
    own = written(samples.select(*LINK, "rtt_diff"), "samples")  # traces are expanded once
    sizes = written(own.groupBy(*LINK).agg(F.count("*").alias("n")), "bin_sizes")
    big = sizes.groupBy(*link).agg(F.sum("n").alias("_n")).where(F.col("_n") > least).drop("_n")
    stats = median_ci(own.join(big, link, "left_semi"), LINK, "rtt_diff", p.confidence, sizes).where(F.col("n") >= least_bin)
    x = written(running(stats, link, "time_bin", F.lit(1)).withColumn("k", F.col("run") - 1 - boot).drop("run"), "link_bins")
    middle = lambda c: median_of(F.transform("rows", lambda r: r[c]))
    # the first ``boot`` bins of a link with more of them
    base = x.where("k < 0").groupBy(*link).agg(F.collect_list(F.struct("median", "lo", "hi")).alias("rows")).join(x.where("k = 0").select(*link), link).select(*link, *[middle(c).alias(f"b_{c}") for c in ("median", "lo", "hi")])
    x = x.join(base, link, "left")
    later = smoothed(x.where("k > 0"), link, "k", {c: (c, f"b_{c}") for c in ("median", "lo", "hi")}, p.alpha)
    band = {"smooth": "median", "smooth_lo": "lo", "smooth_hi": "hi"}
    off = ((F.col("lo") > F.col("smooth_hi")) | (F.col("hi") < F.col("smooth_lo"))) & (F.abs(F.col("median") - F.col("smooth")) > gap)
    out = x.where("k <= 0").withColumns({k: F.col(f"b_{c}") for k, c in band.items()}).withColumn("alarm", F.lit(False))
    out = out.unionByName(later.withColumns({k: F.col(f"{c}_after") for k, c in band.items()}).withColumn("alarm", off), allowMissingColumns=True)
    return out.select(*link, "time_bin", "n", "median", *band, "alarm")
