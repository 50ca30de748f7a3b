"""Forwarding anomalies: packets over next hops, and the ordered comparison with a smoothed reference."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwatch.functions.addresses import with_asn
from pathwatch.functions.expand import LOST, next_hop_packets
from pathwatch.operators.delay import msm_probe_map, time_bin, time_range, valid_traces
from pathwatch.operators.folds import running, smoothed
from pathwatch.operators.statistics import LARGE, pearson, trim_plan
from pathwatch.schema import FORWARDING_REFERENCE, Params
from pathwatch.session import ship_code, written

ZERO = "0"


def next_hop_counts(traces: DataFrame, p: Params) -> DataFrame:
    """(time_bin, dst, ip0, ip1, probe, weight): packets of each probe over each link, summed before they are shuffled."""
    t = time_range(valid_traces(traces), p.start, p.end).withColumn("time_bin", time_bin(F.col("timestamp"), p.start, p.window))
    return next_hop_packets(t, "time_bin").groupBy("time_bin", "dst", "ip0", "ip1", "probe").agg(F.sum("weight").alias("weight"))


def backfill_msm_probe_ids(alarms: DataFrame, children: DataFrame) -> DataFrame:
    """Alarms whose msm_prb_ids is null get the JSON map of their (alarm_id, msmid, probeid) child rows."""
    made = msm_probe_map(children, ["alarm_id"], "msmid", "probeid").select("alarm_id", F.to_json("msm").alias("_made"))
    return alarms.join(made, "alarm_id", "left").withColumn("msm_prb_ids", F.coalesce("msm_prb_ids", "_made")).drop("_made")


STEP = "time_bin long, dst string, ip0 string, corr double, nb_samples int, nb_peers int, nb_seen int, alarm boolean, obs map<string,double>, prior map<string,double>, ref map<string,double>, first_seen long, last_seen long, nb_reported int, is_last boolean"


def _pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    x, y = x - x.mean(), y - y.mean()
    d = np.sqrt((x * x).sum() * (y * y).sum())
    return float((x * y).sum() / d) if d > 0 else None


def _fold(p: Params):
    def run(key, now: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        dst, ip0 = key
        ref, seen, told, first, last = {}, 0, 0, None, None
        if len(old):
            o = old.iloc[0]
            ref = dict(o.ref)
            seen, told, first, last = int(o.nb_seen), int(o.nb_reported), int(o.first_seen), int(o.last_seen)
        out = []
        for t, before, hops in now.sort_values("time_bin")[["time_bin", "prev_bin", "hops"]].itertuples(index=False):
            if p.expire_days is not None and last is not None and not pd.isna(before) and before - last > p.expire_days * 86400:
                ref, seen, told, first = {}, 0, 0, None
            count = {h["ip1"]: float(h["units"]) for h in hops if h["units"] > 0}
            raw = {h["ip1"]: h["raw"] for h in hops}
            names = sorted(set(count) | {h for h, v in ref.items() if v > 0} | {ZERO})
            x, y = np.array([count.get(h, 0.0) for h in names]), np.array([ref.get(h, 0.0) for h in names])
            corr = _pearson(x, y)
            alarm = bool(corr is not None and seen >= p.min_seen and corr < p.min_corr)
            told += alarm
            prior = dict(ref)
            ref = {h: (1 - p.alpha) * ref.get(h, 0.0) + p.alpha * count.get(h, 0.0) for h in {*names, *ref}}
            first, last = (t if first is None else first), t
            out.append(dict(time_bin=t, dst=dst, ip0=ip0, corr=corr, nb_samples=int(sum(count.values())), nb_peers=len(names), nb_seen=seen, alarm=alarm, obs={h: raw.get(h, 0.0) for h in {*raw, *names}}, prior=prior, ref=None, first_seen=first, last_seen=last, nb_reported=told, is_last=False))
            seen += 1
        if out:
            out[-1] |= {"is_last": True, "ref": ref}
        return pd.DataFrame(out)

    return run


def _composed(hops: DataFrame, ref0: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Steps and references of routers with very many bins: a row for each bin and next hop, averages by composed maps.

    Bins fall into segments (seg) where the router was not seen for too long and begins anew. A segment's next hops are
    those that send anything in it, those of ``ref0`` in the first one, and the zero hop; before its first packet a hop's
    average is zero.
    """
    key, seg = ["dst", "ip0"], ["dst", "ip0", "seg"]
    old = ref0.select(*key, F.col("ref").alias("ref0"), F.col("first_seen").alias("first0"), F.col("last_seen").alias("last0"), F.col("nb_seen").alias("seen0"), F.col("nb_reported").alias("told0"))
    x = running(hops.select(*key, "time_bin", "prev_bin"), key, "time_bin", F.lit(1)).withColumn("i", F.col("run") - 1).drop("run").join(old, key, "left")
    if p.expire_days is None:
        x = x.withColumns({"seg": F.lit(0).cast("long"), "j": F.col("i")})
    else:
        last = x.select(*key, (F.col("i") + 1).alias("i"), F.col("time_bin").alias("last"))
        x = x.join(last, [*key, "i"], "left").withColumn("anew", F.coalesce(F.col("prev_bin") - F.coalesce("last", "last0") > p.expire_days * 86400, F.lit(False)).cast("long")).drop("last")
        x = running(x, key, "time_bin", F.col("anew")).withColumnRenamed("run", "seg").drop("anew")
        x = x.join(x.groupBy(*seg).agg(F.min("i").alias("i0")), seg).withColumn("j", F.col("i") - F.col("i0")).drop("i0")
    goes_on = (F.col("seg") == 0) & F.col("seen0").isNotNull()
    x = x.withColumns({c: F.when(goes_on, F.col(c)) for c in ("ref0", "first0", "seen0", "told0")})
    bins = written(x.select(*seg, "time_bin", "j", "first0", "told0", (F.coalesce("seen0", F.lit(0)) + F.col("j")).alias("seen"), "ref0"), "router_bins")
    sent = written(hops.select(*key, "time_bin", F.explode("hops").alias("h")).select(*key, "time_bin", "h.ip1", F.col("h.units").cast("double").alias("units"), "h.raw"), "hop_units")
    had = bins.where("j = 0").select(*seg, F.explode(F.coalesce("ref0", F.create_map().cast("map<string,double>"))).alias("ip1", "start"))
    now = sent.where("units > 0").join(bins.select(*seg, "time_bin"), [*key, "time_bin"]).select(*seg, "ip1").distinct().withColumn("start", F.lit(0.0))
    zero = bins.where("j = 0").select(*seg, F.lit(ZERO).alias("ip1"), F.lit(0.0).alias("start"))
    names = had.unionByName(now).unionByName(zero).groupBy(*seg, "ip1").agg(F.max("start").alias("start"), F.count_if(F.col("start").isNotNull()).alias("_n"))
    known = had.select(*seg, "ip1", F.lit(True).alias("had"))
    each = bins.drop("ref0").join(names.drop("_n").join(known, [*seg, "ip1"], "left"), seg).join(sent, [*key, "time_bin", "ip1"], "left").withColumns({"units": F.coalesce("units", F.lit(0.0)), "k": F.col("j") + 1})
    each = written(smoothed(each, [*seg, "ip1"], "k", {"ref": ("units", "start")}, p.alpha), "hop_steps")
    counts = (F.col("units") > 0) | (F.col("ref_before") > 0) | (F.col("ip1") == ZERO)
    kept = (F.col("ref_before") > 0) | ((F.col("ip1") == ZERO) & ((F.col("j") > 0) | F.col("had")))
    pair = lambda when, v: F.map_from_entries(F.filter(F.collect_list(F.when(when, F.struct("ip1", v))), lambda e: e.isNotNull()))
    at = ["time_bin", *seg]
    steps = each.groupBy(*at).agg(
        F.try_divide(F.covar_pop(F.when(counts, F.col("units")), F.when(counts, F.col("ref_before"))), F.stddev_pop(F.when(counts, F.col("units"))) * F.stddev_pop(F.when(counts, F.col("ref_before")))).alias("corr"),
        F.sum("units").cast("int").alias("nb_samples"), F.count_if(counts).cast("int").alias("nb_peers"), F.first("seen").cast("int").alias("nb_seen"), F.first("told0").alias("told0"), F.first("first0").alias("first0"),
        pair(kept, F.col("ref_before")).alias("prior"), pair((F.col("ref_after") > 0) | (F.col("ip1") == ZERO), F.col("ref_after")).alias("ref"), F.collect_list(F.when(counts, F.col("ip1"))).alias("named"))
    raw = sent.groupBy(*key, "time_bin").agg(F.map_from_entries(F.collect_list(F.struct("ip1", "raw"))).alias("raw"))
    obs = F.map_concat("raw", F.map_from_entries(F.transform(F.array_except("named", F.map_keys("raw")), lambda h: F.struct(h, F.lit(0.0)))))
    alarm = F.coalesce((F.col("nb_seen") >= p.min_seen) & (F.col("corr") < p.min_corr), F.lit(False))
    steps = steps.join(raw, [*key, "time_bin"]).withColumns({"obs": obs, "alarm": alarm})
    nth = F.coalesce("told0", F.lit(0)) + F.sum(F.col("alarm").cast("int")).over(Window.partitionBy(*seg).orderBy("time_bin").rowsBetween(Window.unboundedPreceding, 0))
    steps = written(steps.withColumn("nb_reported", nth.cast("int")), "composed_steps")
    ends = steps.groupBy(*seg).agg(F.max_by(F.struct("ref", "nb_seen", "nb_reported"), "time_bin").alias("e"), F.coalesce(F.first("first0"), F.min("time_bin")).alias("first_seen"), F.max("time_bin").alias("last_seen"))
    last = ends.groupBy(*key).agg(F.max_by(F.struct("e", "first_seen", "last_seen"), "seg").alias("r"))
    ref = last.select(*key, "r.e.ref", "r.first_seen", "r.last_seen", (F.col("r.e.nb_seen") + 1).cast("int").alias("nb_seen"), F.col("r.e.nb_reported").alias("nb_reported"))
    return steps.select("time_bin", *key, "corr", "nb_samples", "nb_peers", "nb_seen", "alarm", "obs", "prior", "nb_reported"), ref


def detect_forwarding_changes(counts: DataFrame, rib: DataFrame, ref0: DataFrame | None, p: Params, changes: bool = False, large: int = LARGE) -> tuple[DataFrame, DataFrame]:
    """Every qualified (bin, destination, router) with its correlation and alarm flag, and the reference after the last bin.

    ``changes``: the reference only of the routers that were seen.

    Packets are truncated to units for each next hop and probe. Groups seen from too few networks are dropped, and the
    units of too frequent networks are thinned out evenly over their next hops and probes, on Spark; the fold over one
    (destination, router) gets a row for each bin, which holds its next hops, never probes; routers of more than ``large``
    bins are not folded in one place, see ``_composed``. The vector holds the observed and referenced next hops and an
    artificial hop of zero.
    """
    spark = counts.sparkSession
    ship_code(spark)
    ref0 = spark.createDataFrame([], FORWARDING_REFERENCE) if ref0 is None else ref0
    key = ["time_bin", "dst", "ip0"]
    # traces are expanded once
    counts = written(counts, "packets")
    bins = counts.select("dst", "time_bin").distinct().withColumn("prev_bin", F.lag("time_bin").over(Window.partitionBy("dst").orderBy("time_bin")))
    units = with_asn(counts, "probe", rib).withColumn("u", F.floor(F.col("weight") + 1e-6).cast("long"))
    plan = written(trim_plan(units.where("u > 0").groupBy(*key, "asn").agg(F.sum("u").alias("c")), key, "asn", p.min_asn, p.min_entropy).select(*key, "asn", "c", "keep"), "forwarding_plan")
    planned = units.where("u > 0").join(plan, [*key, "asn"])
    whole, cut = planned.where("keep = c"), planned.where("keep < c")
    upto = F.sum("u").over(Window.partitionBy(*key, "asn").orderBy("ip1", "probe").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("upto", upto).withColumn("u", (F.expr("upto * keep div c") - F.expr("(upto - u) * keep div c")))
    kept = whole.select(*key, "ip1", "u").unionByName(cut.select(*key, "ip1", "u")).groupBy(*key, "ip1").agg(F.sum("u").alias("units"))
    raw = counts.join(plan.select(*key).distinct(), key, "left_semi").groupBy(*key, "ip1").agg(F.sum("weight").alias("raw"))
    hops = raw.join(kept, [*key, "ip1"], "left").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("ip1", F.coalesce("units", F.lit(0)).alias("units"), "raw"))).alias("hops"))
    hops = written(hops.join(bins, ["dst", "time_bin"]), "router_hops")
    long_ = written(hops.groupBy("dst", "ip0").agg(F.count("*").alias("_n")).where(F.col("_n") > large).select("dst", "ip0"), "long_routers")
    names, composed = [f.name for f in ref0.schema], None
    if not long_.isEmpty():
        composed = _composed(*(t.join(long_, ["dst", "ip0"], "left_semi") for t in (hops, ref0)), p)
        hops, stepped = (t.join(long_, ["dst", "ip0"], "left_anti") for t in (hops, ref0))
    else:
        stepped = ref0
    steps = written(hops.groupBy("dst", "ip0").cogroup(stepped.groupBy("dst", "ip0")).applyInPandas(_fold(p), STEP), "forwarding_steps")
    ref = steps.where("is_last").withColumn("nb_seen", (F.col("nb_seen") + 1).cast("int")).select(*names)
    steps = steps.drop("ref", "first_seen", "last_seen", "is_last")
    if composed:
        steps, ref = steps.unionByName(composed[0]), ref.unionByName(composed[1].select(*names))
    if not changes:
        ref = ref.unionByName(ref0.join(ref.select("dst", "ip0"), ["dst", "ip0"], "left_anti").select(*names))
    return steps, ref


def with_measurements(alarms: DataFrame, traces: DataFrame, p: Params) -> DataFrame:
    """Alarms with ``msm``: for each next hop the map from each measurement to the probes that have seen it there.

    Edges of routers without an alarm in the bin are dropped before anything is grouped.
    """
    key = ["time_bin", "dst", "ip0"]
    t = time_range(valid_traces(traces), p.start, p.end).withColumn("time_bin", time_bin(F.col("timestamp"), p.start, p.window))
    edges = next_hop_packets(t, "time_bin", "msm_id", "prb_id").join(alarms.select(*key).distinct(), key, "left_semi")
    hops = msm_probe_map(edges, [*key, "ip1"]).groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("ip1", "msm")), lambda a, b: F.when(a["ip1"] < b["ip1"], -1).otherwise(1))).alias("msm"))
    return alarms.join(hops, key, "left")


def next_hop_correlation(obs: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, corr): Pearson correlation of (hop, packets) tables over the union of their hops and the zero hop; null if a side is constant."""
    zero = obs.select(*keys).distinct().withColumns({"hop": F.lit(ZERO), "packets": F.lit(0.0)})
    o = obs.select(*keys, "hop", F.col("packets").alias("x")).unionByName(zero.withColumnRenamed("packets", "x"))
    both = o.join(ref.select(*keys, "hop", F.col("packets").alias("y")), [*keys, "hop"], "full_outer").na.fill(0.0, ["x", "y"])
    return both.groupBy(*keys).agg(pearson("x", "y").alias("corr")).join(obs.select(*keys).distinct(), keys, "left_semi")


def responsibility(alarms: DataFrame) -> DataFrame:
    """(time_bin, dst, ip0, ip, pkt_diff, resp, resp_abs, label): how much each next hop contributes to an alarm.

    The zero hop and lost packets count in the sum of changes but get no row.
    """
    diffs = F.transform(F.map_entries("obs"), lambda e: F.struct(e["key"].alias("ip"), (e["value"] - F.coalesce(F.try_element_at("prior", e["key"]), F.lit(0.0))).alias("d")))
    a = alarms.withColumn("_d", diffs).withColumn("_s", F.aggregate("_d", F.lit(0.0), lambda s, x: s + F.abs(x["d"])))
    msm = ["msm"] if "msm" in alarms.columns else []
    x = a.select("time_bin", "dst", "ip0", "corr", *msm, "_s", F.explode("_d").alias("e")).where(~F.col("e.ip").isin(ZERO, LOST))
    resp = F.try_divide(F.abs("corr") * F.col("e.d"), F.col("_s"))
    return x.select("time_bin", "dst", "ip0", *msm, F.col("e.ip").alias("ip"), F.col("e.d").alias("pkt_diff"), resp.alias("resp"), F.abs(resp).alias("resp_abs"), F.when(F.col("e.d") < 0, "-").otherwise("+").alias("label"))


def prune_small_targets(ref: DataFrame, min_routers: int = 500) -> DataFrame:
    """References of destinations with at least ``min_routers`` routers."""
    n = ref.groupBy("dst").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_routers)
    return ref.join(n.select("dst"), "dst", "left_semi")
