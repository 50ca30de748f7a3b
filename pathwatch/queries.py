"""Queries over the reference data model, run on the driver's tables seen as traceroutes, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwatch.functions import addresses as A
from pathwatch.functions import expand
from pathwatch.operators import delay, forwarding, magnitude, publish, references, statistics
from pathwatch.schema import DELAY_ALARM, DELAY_REFERENCE, FORWARDING_ALARM, HOPS, MAGNITUDE, Params
from pathwatch.session import ship_code, work_path, written
from pathwatch.sources import fixtures as fx
from pathwatch.sources import arrays, tables, versions
from pathwatch.streaming import jobs

P = Params(window=fx.WINDOW, start=fx.START)
HOUR0, HOURS = 1704067200, 720  # the events' month
NOW = fx.START + 16 * fx.WINDOW  # the bin of the injected anomaly
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# ---- the traceroute view in SQL

TRACES = f"""
t AS (SELECT o_orderkey AS tid, epoch(o_orderdate)::BIGINT AS ts, {fx.START} + ((epoch(o_orderdate)::BIGINT - {fx.START}) // {fx.WINDOW}) * {fx.WINDOW} AS time_bin,
  o_custkey AS prb, 5001 + o_custkey % 5 AS msm, '20.' || c_nationkey || '.' || (o_custkey // 256) || '.' || (o_custkey % 256) AS probe, '40.0.0.' || o_orderpriority[1:1] AS dst
  FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT tid, l_linenumber AS hop, CASE WHEN l_returnflag = 'R' AND l_suppkey % 10 = 0 THEN NULL WHEN l_suppkey % 11 = 0 THEN '192.168.0.1'
    WHEN l_linenumber = 3 AND dst = '40.0.0.1' AND ts >= 915148800 AND ts < 930787200 THEN '30.2.0.90'
    ELSE '30.' || (l_linenumber - 1) || '.0.' || ((l_linenumber - 1) * 3 + l_suppkey % 3) END AS ip,
  l_linenumber * 10 + l_quantity / 10 + CASE WHEN l_linenumber = 2 AND l_suppkey % 3 = 1 AND ts >= 915148800 AND ts < 930787200 THEN 40 ELSE 0 END AS rtt
  FROM lineitem JOIN t ON l_orderkey = tid),
hops AS (SELECT tid, hop, row_number() OVER (PARTITION BY tid ORDER BY hop) - 1 AS pos FROM (SELECT DISTINCT tid, hop FROM r)),
med AS (SELECT r.tid, pos, ip, median(rtt) AS med FROM r JOIN hops USING (tid, hop) WHERE ip IS NOT NULL AND ip <> '192.168.0.1' AND rtt > 0 GROUP BY ALL)"""
SAMPLES = TRACES + """,
s AS (SELECT t.time_bin, t.tid, t.probe, t.msm, t.prb, least(a.ip, b.ip) AS ip1, greatest(a.ip, b.ip) AS ip2, b.med - a.med AS d
  FROM med a JOIN med b ON a.tid = b.tid AND b.pos = a.pos + 1 AND a.ip <> b.ip JOIN t ON t.tid = a.tid)"""


def asn_sql(ip: str) -> str:
    """The prefix table's answer for one of the view's addresses."""
    part = f"split_part({ip}, '.', 2)::INT"
    return f"CASE WHEN {ip} LIKE '20.1.1.%' THEN 64601 WHEN {ip} LIKE '20.2.1.%' THEN 64602 WHEN {ip} LIKE '20.%' THEN 64500 + {part} WHEN {ip} LIKE '30.%' THEN 65000 + {part} ELSE 0 END"


Z = 1.959963984540054
STATS = SAMPLES + f""",
sa AS (SELECT *, {asn_sql('probe')} AS asn FROM s),
ac AS (SELECT time_bin, ip1, ip2, asn, count(*) AS c FROM sa GROUP BY ALL),
ent AS (SELECT time_bin, ip1, ip2, sum(c) AS n, count(*) AS n_asn, CASE WHEN count(*) > 1 THEN (ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(count(*)) END AS entropy FROM ac GROUP BY ALL),
st0 AS (SELECT time_bin, ip1, ip2, count(*) AS n, median(d) AS median, list_sort(list(d)) AS l FROM s GROUP BY ALL),
st AS (SELECT st0.time_bin, st0.ip1, st0.ip2, st0.n, median, l[1 + floor(st0.n * (0.5 - {Z} / (2 * sqrt(st0.n + {Z} * {Z}))))::INT] AS lo, l[1 + floor(st0.n * (0.5 + {Z} / (2 * sqrt(st0.n + {Z} * {Z}))))::INT] AS hi, n_asn, entropy
  FROM st0 JOIN ent USING (time_bin, ip1, ip2) WHERE n_asn >= 3 AND entropy >= 0.5)"""
REF = STATS + """,
ref AS (SELECT ip1, ip2, avg(median) AS mean, avg(lo) AS low, avg(hi) AS high, max(n_asn) AS nb_probes, min(time_bin) AS first_seen, max(time_bin) AS last_seen, count(*) AS nb_seen, count_if(median > 20) AS nb_reported FROM st GROUP BY ALL)"""
_ema = ", ".join(f"sum(CASE WHEN k > 3 THEN 0.01 * {c} * power(0.99, -k) ELSE 0 END) OVER w AS s_{c}, max(CASE WHEN k = 3 THEN b_{c} END) OVER w AS base_{c}" for c in ("median", "hi", "lo"))
_base = ", ".join(f"median({c}) OVER (PARTITION BY ip1, ip2 ORDER BY time_bin ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS b_{c}" for c in ("median", "hi", "lo"))
_now = ", ".join(f"CASE WHEN k >= 3 THEN power(0.99, k - 3) * base_{c} + power(0.99, k) * s_{c} END AS r_{c}" for c in ("median", "hi", "lo"))
_prev = ", ".join(f"lag(r_{c}) OVER (PARTITION BY ip1, ip2 ORDER BY k) AS p_{c}" for c in ("median", "hi", "lo"))
FOLD = STATS + f""",
k1 AS (SELECT *, row_number() OVER (PARTITION BY ip1, ip2 ORDER BY time_bin) AS k, {_base} FROM st),
k2 AS (SELECT *, {_ema} FROM k1 WINDOW w AS (PARTITION BY ip1, ip2 ORDER BY time_bin ROWS UNBOUNDED PRECEDING)),
k3 AS (SELECT *, {_now} FROM k2),
k4 AS (SELECT *, {_prev} FROM k3),
k5 AS (SELECT time_bin, ip1, ip2, n, n_asn, k - 1 AS nb_seen, median, lo, hi, p_median AS ref, p_lo AS ref_low, p_hi AS ref_high, median - p_median AS diff_med,
  CASE WHEN median < p_median THEN hi - p_lo ELSE lo - p_hi END AS diff, CASE WHEN median < p_median THEN p_lo - p_median ELSE p_hi - p_median END AS div, p_hi < lo OR p_lo > hi AS alarm FROM k4 WHERE k > 3),
al AS (SELECT time_bin, ip1, ip2, n, nb_seen, median, lo, hi, ref, ref_low, ref_high, diff, diff_med, CASE WHEN div <> 0 THEN diff_med / div END AS deviation, CASE WHEN div <> 0 THEN diff / div END AS dev_bound FROM k5 WHERE alarm)"""
COUNTS = TRACES + """,
fr AS (SELECT r.tid, hops.pos AS hp, coalesce(ip, 'x') AS ip FROM r JOIN hops USING (tid, hop) WHERE ip IS NULL OR ip <> '192.168.0.1'),
fh AS (SELECT tid, hp, row_number() OVER (PARTITION BY tid ORDER BY hp) AS q, m FROM (SELECT tid, hp, count(*) AS m FROM fr GROUP BY ALL)),
fn AS (SELECT fr.tid, q, ip, count(*) AS c, any_value(m) AS m FROM fr JOIN fh USING (tid, hp) GROUP BY ALL),
fp AS (SELECT tid, 0 AS q, probe AS ip, 3 AS c, 3 AS m FROM t UNION ALL SELECT tid, q, ip, c, m FROM fn),
e AS (SELECT t.time_bin, t.dst, a.ip AS ip0, b.ip AS ip1, t.probe, sum(a.c * b.c / a.m) AS weight FROM fp a JOIN fn b ON a.tid = b.tid AND b.q = a.q + 1 JOIN t ON t.tid = a.tid GROUP BY ALL)"""
_ent = "((ln(list_sum({v})) - list_sum(list_transform({v}, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / list_sum({v})) / ln(len(list_filter({v}, lambda x: x > 0))))"


def _trim_sql(name: str, counts: str, keys: str) -> str:
    """<name>_k: what trim_plan gives, by taking one sample after the other from the most frequent network; needs WITH RECURSIVE."""
    more = "len(list_filter(keep, lambda x: x > 0))"
    return f"""{name}_g AS (SELECT {keys}, list(asn ORDER BY asn) AS asns, list(c ORDER BY asn) AS cs FROM {counts} GROUP BY ALL HAVING count(*) >= 3),
{name}_t AS (SELECT *, cs AS keep FROM {name}_g UNION ALL SELECT {keys}, asns, cs, list_transform(keep, lambda x, i: CASE WHEN i = list_position(keep, list_max(keep)) THEN x - 1 ELSE x END) FROM {name}_t WHERE {more} > 3 AND {_ent.format(v='keep')} < 0.5),
{name}_k AS (SELECT {keys}, keep <> cs AS trimmed, {more} AS n_asn, {_ent.format(v='keep')} AS entropy, unnest(asns) AS asn, unnest(cs) AS c, unnest(keep) AS keep FROM {name}_t WHERE {_ent.format(v='keep')} >= 0.5)"""


_skewed = "CASE WHEN probe LIKE '20.%' THEN 64500 + greatest(0, split_part(probe, '.', 2)::INT - 19) ELSE 0 END"
TRIMMED = "RECURSIVE " + SAMPLES + f""",
sk AS (SELECT *, {_skewed} AS asn FROM s), skc AS (SELECT time_bin, ip1, ip2, asn, count(*) AS c FROM sk GROUP BY ALL),
{_trim_sql('tm', 'skc', 'time_bin, ip1, ip2')},
tr0 AS (SELECT time_bin, ip1, ip2, asn, d, row_number() OVER (PARTITION BY time_bin, ip1, ip2, asn ORDER BY md5(concat_ws('|', 1, probe, msm, prb)), probe, msm, prb, d) AS draw FROM sk),
tr1 AS (SELECT time_bin, ip1, ip2, trimmed, n_asn, entropy, count(*) AS n, median(d) AS median, list_sort(list(d)) AS l FROM tr0 JOIN tm_k USING (time_bin, ip1, ip2, asn) WHERE draw <= keep GROUP BY ALL),
tr AS (SELECT time_bin, ip1, ip2, n, median, l[1 + floor(n * (0.5 - {Z} / (2 * sqrt(n + {Z} * {Z}))))::INT] AS lo, l[1 + floor(n * (0.5 + {Z} / (2 * sqrt(n + {Z} * {Z}))))::INT] AS hi, n_asn, entropy, trimmed FROM tr1)"""
_first = ", ".join(f"median({c}) FILTER (WHERE k < 24) OVER l AS b_{c}, sum(CASE WHEN k > 24 THEN 0.01 * {c} * power(0.99, -k) ELSE 0 END) OVER (l ORDER BY time_bin ROWS UNBOUNDED PRECEDING) AS s_{c}" for c in ("median", "lo", "hi"))
_smooth = ", ".join(f"CASE WHEN bins > 24 THEN CASE WHEN k <= 24 THEN b_{c} ELSE power(0.99, k - 24) * b_{c} + power(0.99, k) * s_{c} END END AS r_{c}" for c in ("median", "lo", "hi"))
HISTORY = SAMPLES + f""",
h0 AS (SELECT time_bin, ip1, ip2, count(*) AS n, median(d) AS median, list_sort(list(d)) AS l FROM s SEMI JOIN (SELECT ip1, ip2 FROM s GROUP BY ALL HAVING count(*) > 20) big USING (ip1, ip2) GROUP BY ALL HAVING count(*) >= 3),
h1 AS (SELECT ip1, ip2, time_bin, n, median, l[1 + floor(n * (0.5 - {Z} / (2 * sqrt(n + {Z} * {Z}))))::INT] AS lo, l[1 + floor(n * (0.5 + {Z} / (2 * sqrt(n + {Z} * {Z}))))::INT] AS hi, row_number() OVER (PARTITION BY ip1, ip2 ORDER BY time_bin) - 1 AS k FROM h0),
h2 AS (SELECT *, count(*) OVER l AS bins, {_first} FROM h1 WINDOW l AS (PARTITION BY ip1, ip2)),
h3 AS (SELECT *, {_smooth} FROM h2),
h AS (SELECT ip1, ip2, time_bin, n, median, r_median AS smooth, r_lo AS smooth_lo, r_hi AS smooth_hi, coalesce(k > 24 AND (lo > r_hi OR hi < r_lo) AND abs(median - r_median) > 1, false) AS alarm FROM h3)"""
FORWARD = "RECURSIVE " + COUNTS + f""",
fu AS (SELECT *, floor(weight + 1e-6)::BIGINT AS u, {asn_sql('probe')} AS asn FROM e),
fa AS (SELECT time_bin, dst, ip0, asn, sum(u)::BIGINT AS c FROM fu WHERE u > 0 GROUP BY ALL),
{_trim_sql('fp2', 'fa', 'time_bin, dst, ip0')},
fc AS (SELECT fu.time_bin, fu.dst, fu.ip0, ip1, u, c, keep, sum(u) OVER (PARTITION BY fu.time_bin, fu.dst, fu.ip0, fu.asn ORDER BY ip1, probe ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM fu JOIN fp2_k USING (time_bin, dst, ip0, asn) WHERE u > 0),
fk AS (SELECT time_bin, dst, ip0, ip1, sum((upto * keep) // c - ((upto - u) * keep) // c) AS n FROM fc GROUP BY ALL),
fw AS (SELECT time_bin, dst, ip0, ip1, sum(weight) AS raw FROM e SEMI JOIN fp2_k USING (time_bin, dst, ip0) GROUP BY ALL),
fs AS (SELECT *, row_number() OVER (PARTITION BY dst, ip0 ORDER BY time_bin) - 1 AS k FROM (SELECT DISTINCT time_bin, dst, ip0 FROM fp2_k)),
fd AS (SELECT fs.time_bin, dst, ip0, k, ip1, coalesce(n, 0) AS n FROM fs JOIN (SELECT DISTINCT dst, ip0, ip1 FROM fk WHERE n > 0) hu USING (dst, ip0) LEFT JOIN fk USING (time_bin, dst, ip0, ip1)),
fref AS (SELECT *, coalesce(sum(0.01 * n * power(0.99, -k - 1)) OVER (PARTITION BY dst, ip0, ip1 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * power(0.99, k) AS prior FROM fd),
fm AS (SELECT * FROM fref WHERE n > 0 OR prior > 0),
fv AS (SELECT time_bin, dst, ip0, k, n, prior FROM fm UNION ALL SELECT time_bin, dst, ip0, k, 0, 0 FROM fs),
fx AS (SELECT time_bin, dst, ip0, CASE WHEN stddev_pop(n) > 0 AND stddev_pop(prior) > 0 THEN corr(n, prior) END AS corr, sum(n)::INT AS nb_samples, count(*)::INT AS nb_peers, k::INT AS nb_seen FROM fv GROUP BY ALL),
fy AS (SELECT time_bin, dst, ip0, ip1 AS ip, coalesce(raw, 0) - coalesce(prior, 0) AS pkt_diff FROM fm FULL JOIN fw USING (time_bin, dst, ip0, ip1)),
fz AS (SELECT fy.*, abs(corr) * pkt_diff / sum(abs(pkt_diff)) OVER (PARTITION BY time_bin, dst, ip0) AS resp FROM fy JOIN fx USING (time_bin, dst, ip0) WHERE corr < 0.9 AND nb_seen >= 3),
rs AS (SELECT time_bin, dst, ip0, ip, pkt_diff, resp, abs(resp) AS resp_abs, CASE WHEN pkt_diff < 0 THEN '-' ELSE '+' END AS label FROM fz WHERE ip <> 'x')"""
EVENTS = """
ev AS (SELECT user_id % 10 AS asn, floor(epoch(ts))::BIGINT // 3600 * 3600 AS time_bin, value, json_extract_string(props, '$.k') AS word, user_id FROM events),
grid AS (SELECT asn, time_bin, coalesce(sum(value), 0) AS value FROM (SELECT DISTINCT asn FROM ev) CROSS JOIN (SELECT 1704067200 + 3600 * range AS time_bin FROM range(720)) LEFT JOIN ev USING (asn, time_bin) GROUP BY ALL)"""


def _magnitude_sql(rows: int, true_mad: bool = True) -> str:
    mad = "list_median(list_transform(h, lambda x: abs(x - m)))" if true_mad else "0"
    return f"""g1 AS (SELECT asn, time_bin, value, median(value) OVER w AS m, list(value) OVER w AS h FROM grid WINDOW w AS (PARTITION BY asn ORDER BY time_bin ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)),
mag AS (SELECT asn, time_bin, value, (value - m) / (1 + 1.4826 * {mad}) AS magnitude, len(h) AS seen FROM g1)"""


# ---- the same in DataFrames


def samples(spark: SparkSession, d: str) -> DataFrame:
    return delay.link_samples(fx.traces(spark, d), P)


def full_stats(spark: SparkSession, d: str) -> DataFrame:
    return delay.delay_stats(samples(spark, d), fx.rib(spark), P, trim=False)


def stats(spark: SparkSession, d: str) -> DataFrame:
    return full_stats(spark, d).drop("nb_probes", "asns", "trimmed")


def reference(spark: SparkSession, d: str) -> DataFrame:
    return stats(spark, d).groupBy("ip1", "ip2").agg(F.avg("median").alias("mean"), F.avg("lo").alias("low"), F.avg("hi").alias("high"), F.max("n_asn").alias("nb_probes"), F.min("time_bin").alias("first_seen"), F.max("time_bin").alias("last_seen"), F.count("*").alias("nb_seen"), F.count_if(F.col("median") > 20).alias("nb_reported"))


def alarms(spark: SparkSession, d: str) -> DataFrame:
    return delay.detect_delay_changes(stats(spark, d).drop("n_asn", "entropy"), None, P)[0].drop("alarm", "nb_reported")


def counts(spark: SparkSession, d: str) -> DataFrame:
    return forwarding.next_hop_counts(fx.traces(spark, d), P)


def forwarding_reference(spark: SparkSession, d: str) -> DataFrame:
    hop = counts(spark, d).groupBy("dst", "ip0", "ip1").agg(F.sum("weight").alias("w"))
    return hop.groupBy("dst", "ip0").agg(F.map_from_entries(F.collect_list(F.struct("ip1", "w"))).alias("ref"), F.count_if(F.col("ip1") == "x").alias("nb_reported"))


def forwarding_steps(spark: SparkSession, d: str) -> DataFrame:
    return forwarding.detect_forwarding_changes(counts(spark, d), fx.rib(spark), None, P)[0]


def shares(spark: SparkSession, d: str) -> DataFrame:
    """Responsibilities of the bins whose correlation is below 0.9 (few real alarms occur in the small tables)."""
    return forwarding.responsibility(forwarding_steps(spark, d).where((F.col("corr") < 0.9) & (F.col("nb_seen") >= 3)))


def events(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    hour = F.floor(F.unix_timestamp("ts") / 3600) * 3600
    return e.select((F.col("user_id") % 10).alias("asn"), hour.alias("time_bin"), "value", F.get_json_object("props", "$.k").alias("word"), "user_id")


def grid(spark: SparkSession, d: str) -> DataFrame:
    """The month, and further hours on either side where there are events."""
    e = events(spark, d)
    low, high = e.agg(F.min("time_bin"), F.max("time_bin")).first()  # one row
    start, end = HOUR0, HOUR0 + 3600 * (HOURS - 1)
    return magnitude.hourly_grid(e, "value", start if low is None else min(start, low), end if high is None else max(end, high))


def metadata(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").select(
        k.alias("id"), (k % 3 + 1).cast("int").alias("status"), F.when(k % 4 == 0, "ping").otherwise("traceroute").alias("type"), F.when(k % 5 == 0, 6).otherwise(4).alias("af"),
        F.when(k % 7 == 0, 3600).otherwise(900).alias("interval"), F.when(k % 2 == 0, (k % 300).cast("int")).alias("participant_count"), F.concat(F.lit("184.164.22"), k % 10, F.lit(".1")).alias("target_ip"))


META = "meta AS (SELECT c_custkey AS id, c_custkey % 3 + 1 AS status, CASE WHEN c_custkey % 4 = 0 THEN 'ping' ELSE 'traceroute' END AS type, CASE WHEN c_custkey % 5 = 0 THEN 6 ELSE 4 END AS af, CASE WHEN c_custkey % 7 = 0 THEN 3600 ELSE 900 END AS ival, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 300 END AS participants, '184.164.22' || (c_custkey % 10) || '.1' AS target FROM customer)"


#: From here on every double is a whole number.
WHOLE = float(1 << 52)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits without a negative zero; not a number becomes null.

    They are rounded to nine digits first, and what then ends in a five is moved off it: neither the order of a sum nor
    the nearest binary fraction must decide where a tie at the sixth digit goes. Numbers that have no nine digits behind
    the point are multiplied and divided as SQL does it, which may move their last bit.
    """
    def large(c: str) -> Column:
        nine = F.col(c) * 1e9 / 1e9
        x = (F.when(F.abs(nine) < float("inf"), nine).otherwise(F.col(c)) + F.signum(c) * 1e-10) * 1e6
        six = F.when(F.abs(x) < WHOLE, F.signum(x) * F.floor(F.abs(x) + 0.5)).otherwise(x) / 1e6
        return F.when(F.abs(six) < float("inf"), six).otherwise(F.col(c))

    six = lambda c: F.when(F.abs(c) * 1e9 < WHOLE, F.round(F.round(c, 9) + F.signum(c) * 1e-10, 6) + F.lit(0.0)).otherwise(large(c))
    return df.select(*[F.when(~F.isnan(c), six(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "") -> None:
    """Register a query; ``sql`` is its twin, ``doubles`` the columns to be rounded in it."""
    QUERIES[name] = lambda spark, d: rounded(make(spark, d))
    if sql:
        ORACLES[name] = f"SELECT * REPLACE ({', '.join(f'round(round({c}, 9) + sign({c}) * 1e-10, 6) + 0.0 AS {c}' for c in doubles.split())}) FROM ({sql})" if doubles else sql


def rib_of(s: SparkSession) -> DataFrame:
    return fx.rib(s)


add("hop_median_rtt", lambda s, d: expand.hop_median_rtt(fx.traces(s, d), "trace_id"), f"WITH {TRACES} SELECT tid AS trace_id, pos::INT AS hop_pos, ip, med FROM med", "med")
add("differential_rtts", lambda s, d: samples(s, d).select("time_bin", "ip1", "ip2", "rtt_diff", "probe_ip", "msm_id", "prb_id"),
    f"WITH {SAMPLES} SELECT time_bin, ip1, ip2, d AS rtt_diff, probe AS probe_ip, msm AS msm_id, prb AS prb_id FROM s", "rtt_diff")
add("link_delay_stats", stats, f"WITH {STATS} SELECT * FROM st", "median lo hi entropy")
add("asn_entropy", lambda s, d: statistics.asn_entropy(A.with_asn(samples(s, d), "probe_ip", fx.rib(s)), delay.LINK), f"WITH {STATS} SELECT time_bin, ip1, ip2, n::BIGINT AS n, n_asn, entropy FROM ent", "entropy")
add("trimmed_link_delay_stats", lambda s, d: delay.delay_stats(samples(s, d), fx.rib(s, skewed=True), P).drop("nb_probes", "asns"), f"WITH {TRIMMED} SELECT * FROM tr", "median lo hi entropy")
add("link_diversity", lambda s, d: full_stats(s, d).select("time_bin", "ip1", "ip2", "nb_probes", F.array_join(F.col("asns").cast("array<string>"), ",").alias("asns")),
    f"WITH {STATS}, dv AS (SELECT time_bin, ip1, ip2, count(DISTINCT probe) AS nb_probes, array_to_string(list_sort(list(DISTINCT asn)), ',') AS asns FROM sa GROUP BY ALL) SELECT dv.* FROM dv SEMI JOIN st USING (time_bin, ip1, ip2)")
add("link_probes", lambda s, d: delay.link_probes(m := samples(s, d), delay.delay_stats(m, fx.rib(s), P, trim=False)).groupBy("ip1", "ip2").agg(F.count("*").alias("nb_probes")),
    f"WITH {STATS} SELECT ip1, ip2, count(DISTINCT probe) AS nb_probes FROM s SEMI JOIN st USING (time_bin, ip1, ip2) GROUP BY ALL")
add("delay_alarms", alarms, f"WITH {FOLD} SELECT time_bin, ip1, ip2, n, median, lo, hi, ref, ref_low, ref_high, nb_seen::INT AS nb_seen, diff, diff_med, deviation, dev_bound FROM al", "median lo hi ref ref_low ref_high diff diff_med deviation dev_bound")
add("delay_reference", lambda s, d: delay.detect_delay_changes(stats(s, d), None, P)[1].where("nb_seen >= 3").select("ip1", "ip2", "mean", "high", "low", "first_seen", "last_seen", "nb_seen"),
    f"WITH {FOLD} SELECT ip1, ip2, arg_max(r_median, k) AS mean, arg_max(r_hi, k) AS high, arg_max(r_lo, k) AS low, min(time_bin) AS first_seen, max(time_bin) AS last_seen, max(k)::INT AS nb_seen FROM k3 GROUP BY ALL HAVING max(k) >= 3", "mean high low")
add("delay_deviation", lambda s, d: delay.delay_deviation(stats(s, d).where(F.col("time_bin") == NOW), reference(s, d)).select("time_bin", "ip1", "ip2", "alarm", "diff", "diff_med", "deviation", "dev_bound"),
    f"""WITH {REF}, x AS (SELECT time_bin, ip1, ip2, high < lo OR low > hi AS alarm, median - mean AS diff_med, CASE WHEN median < mean THEN hi - low ELSE lo - high END AS diff, CASE WHEN median < mean THEN low - mean ELSE high - mean END AS div FROM st JOIN ref USING (ip1, ip2) WHERE time_bin = {NOW})
    SELECT time_bin, ip1, ip2, alarm, diff, diff_med, CASE WHEN div <> 0 THEN diff_med / div END AS deviation, CASE WHEN div <> 0 THEN diff / div END AS dev_bound FROM x""", "diff diff_med deviation dev_bound")
add("link_history", lambda s, d: delay.link_history(samples(s, d), P), f"WITH {HISTORY} SELECT * FROM h", "median smooth smooth_lo smooth_hi")
add("next_hop_counts", counts, f"WITH {COUNTS} SELECT * FROM e", "weight")
add("forwarding_detection", lambda s, d: forwarding_steps(s, d).drop("obs", "prior"), f"WITH {FORWARD} SELECT *, sum(alarm::INT) OVER (PARTITION BY dst, ip0 ORDER BY nb_seen ROWS UNBOUNDED PRECEDING)::INT AS nb_reported FROM (SELECT *, coalesce(corr < -0.25 AND nb_seen >= 3, false) AS alarm FROM fx)", "corr")
add("responsibility", shares, f"WITH {FORWARD} SELECT * FROM rs", "pkt_diff resp resp_abs")
add("next_hop_correlation", lambda s, d: forwarding.next_hop_correlation(
        (c := counts(s, d)).where(F.col("time_bin") == NOW).groupBy("dst", "ip0", F.col("ip1").alias("hop")).agg(F.sum("weight").alias("packets")),
        c.where(F.col("time_bin") < NOW).groupBy("dst", "ip0", F.col("ip1").alias("hop")).agg(F.sum("weight").alias("packets")), ["dst", "ip0"]),
    f"""WITH {COUNTS}, o AS (SELECT dst, ip0, ip1, sum(weight) AS x FROM e WHERE time_bin = {NOW} GROUP BY ALL), o0 AS (SELECT * FROM o UNION ALL SELECT DISTINCT dst, ip0, '0', 0.0 FROM o),
    f AS (SELECT dst, ip0, ip1, sum(weight) AS y FROM e WHERE time_bin < {NOW} GROUP BY ALL),
    j AS (SELECT dst, ip0, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM o0 FULL JOIN f USING (dst, ip0, ip1))
    SELECT dst, ip0, CASE WHEN stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END AS corr FROM j SEMI JOIN o USING (dst, ip0) GROUP BY ALL""", "corr")
add("msm_probe_map", lambda s, d: delay.msm_probe_map(samples(s, d), delay.LINK).select(*delay.LINK, F.explode("msm").alias("msm_id", "p")).select(*delay.LINK, "msm_id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("probes")),
    f"WITH {SAMPLES} SELECT time_bin, ip1, ip2, msm AS msm_id, array_to_string(list_sort(list(DISTINCT prb)), ',') AS probes FROM s GROUP BY ALL")
add("prefix24_private", lambda s, d: fx.traces(s, d).select(F.explode_outer("result").alias("h")).select(F.explode_outer("h.result").alias("r")).where("r.from IS NOT NULL").groupBy(A.prefix24(F.col("r.from")).alias("prefix"), A.is_private_ip(F.col("r.from")).alias("private")).agg(F.count("*").alias("n")),
    f"WITH {TRACES} SELECT regexp_replace(ip, '[.][0-9]+$', '.0/24') AS prefix, ip = '192.168.0.1' AS private, count(*) AS n FROM r WHERE ip IS NOT NULL GROUP BY ALL")
add("seen_prefix", lambda s, d: delay.seen_prefix(delay.valid_traces(fx.traces(s, d)), r"^30\.6\.").groupBy("dst_addr").agg(F.count("*").alias("n")),
    f"WITH {TRACES} SELECT dst AS dst_addr, count(DISTINCT t.tid) AS n FROM t JOIN r ON t.tid = r.tid WHERE ip LIKE '30.6.%' GROUP BY ALL")
add("selected_measurements", lambda s, d: publish.select_msm_metadata(metadata(s, d)), f"WITH {META} SELECT DISTINCT id FROM meta WHERE status = 2 AND type = 'traceroute' AND af = 4 AND ival <= 1800 AND (participants IS NULL OR participants > 100) AND target NOT LIKE '184.164.224%'")
add("measurements_by_af", lambda s, d: publish.split_msm_by_af(metadata(s, d)).select("af", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")),
    f"WITH {META} SELECT af, count(DISTINCT id) AS n, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM meta WHERE type = 'traceroute' GROUP BY af")
add("time_range_bins", lambda s, d: delay.time_range(fx.traces(s, d), 915148800, 930787200).groupBy(delay.time_bin(F.col("timestamp"), P.start, P.window).alias("time_bin")).agg(F.count("*").alias("n")),
    f"WITH {TRACES} SELECT time_bin, count(*) AS n FROM t WHERE ts >= 915148800 AND ts < 930787200 GROUP BY ALL")
add("link_prefix_filter", lambda s, d: delay.link_filter(stats(s, d).select("ip1", "ip2").distinct(), "30.2.0."), f"WITH {STATS} SELECT DISTINCT ip1, ip2 FROM st WHERE ip1 LIKE '30.2.0.%' OR ip2 LIKE '30.2.0.%'")
add("ip_to_asn", lambda s, d: A.with_asn(samples(s, d).select("probe_ip").distinct(), "probe_ip", fx.rib(s)), f"WITH {SAMPLES} SELECT DISTINCT probe AS probe_ip, ({asn_sql('probe')})::BIGINT AS asn FROM s")
add("ip6_to_asn", lambda s, d: A.with_asn(fx.addresses6(s, d), "ip", fx.rib(s).unionByName(fx.rib6(s)), v6=True, broadcast=0),
    f"""WITH n6 AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer) SELECT k, (CASE WHEN k % 10 = 9 THEN 0 WHEN n % 5 = 0 THEN 66000 WHEN n = 3 AND k % 2 = 0 THEN 66500 ELSE 66100 + n END)::BIGINT AS asn,
    CASE WHEN k % 10 = 9 THEN '2002::1:' || lower(hex(k)) WHEN k % 2 = 0 THEN '2001:db8:' || lower(hex(n)) || '::' || lower(hex(k)) ELSE '2001:0DB8:' || lpad(hex(n), 4, '0') || ':0:8000:0:0:' || hex(k) END AS ip FROM n6
    UNION ALL SELECT c_custkey, ({asn_sql('ip')})::BIGINT, ip FROM (SELECT c_custkey, '20.' || c_nationkey || '.' || (c_custkey // 256) || '.' || (c_custkey % 256) AS ip FROM customer)""")
add("ip_to_country", lambda s, d: A.with_country(fx.traces(s, d).select("from").distinct(), "from", fx.rib(s)),
    f"""WITH {TRACES} SELECT DISTINCT probe AS "from", CASE WHEN probe LIKE '20.1.1.%' OR probe LIKE '20.2.1.%' THEN 'C9' ELSE 'C' || (split_part(probe, '.', 2)::INT % 5) END AS country FROM t""")
add("attach_reference", lambda s, d: delay.attach_reference(stats(s, d).where(F.col("time_bin") == NOW).select("ip1", "ip2", "median"), reference(s, d).where("nb_seen > 20"), columns=["mean"]),
    f"WITH {REF} SELECT ip1, ip2, median, mean FROM (SELECT ip1, ip2, median FROM st WHERE time_bin = {NOW}) FULL JOIN (SELECT ip1, ip2, mean FROM ref WHERE nb_seen > 20) USING (ip1, ip2)", "median mean")
ROOTS = [("30.0.0.0", "a"), ("30.0.0.1", "a"), ("30.2.0.90", "b"), ("30.9.9.9", "c")]
add("root_server_links", lambda s, d: references.root_server_links(stats(s, d), stats(s, d).where(F.col("time_bin") == NOW), s.createDataFrame(ROOTS, "ip string, name string")),
    f"""WITH {STATS}, roots(ip, name) AS (VALUES {', '.join(map(str, ROOTS))}), m AS (SELECT coalesce(a.name, b.name) AS name, ip1, ip2, time_bin FROM st LEFT JOIN roots a ON ip1 = a.ip LEFT JOIN roots b ON ip2 = b.ip)
    SELECT n.name, count(DISTINCT m.ip1 || ' ' || m.ip2) AS links, count(DISTINCT CASE WHEN time_bin = {NOW} THEN m.ip1 || ' ' || m.ip2 END) AS reported FROM (SELECT DISTINCT name FROM roots) n LEFT JOIN m ON m.name = n.name GROUP BY n.name""")
add("register_asns", lambda s, d: references.register_asns(magnitude.link_ends(stats(s, d), fx.rib(s)), s.createDataFrame([(65001, False), (1, False), (2, True)], "asn long, delay boolean")),
    f"WITH {STATS}, seen AS (SELECT DISTINCT {asn_sql('ip')} AS asn FROM (SELECT ip1 AS ip FROM st UNION SELECT ip2 FROM st)), reg(asn, delay) AS (VALUES (65001, false), (1, false), (2, true)) SELECT coalesce(seen.asn, reg.asn)::BIGINT AS asn, seen.asn IS NOT NULL OR coalesce(delay, false) AS delay FROM seen FULL JOIN reg ON seen.asn = reg.asn")
add("sum_by_time", lambda s, d: magnitude.sum_by_time(events(s, d), "value", "value > 9"), f"WITH {EVENTS} SELECT time_bin, sum(value) AS value FROM ev WHERE value > 9 GROUP BY ALL", "value")
add("alarm_count_events", lambda s, d: magnitude.alarm_count_events(events(s, d).select(F.col("asn").alias("dst"), "time_bin", F.lit(0.0).alias("corr"))),
    f"WITH {EVENTS}, c AS (SELECT asn AS dst, time_bin, count(*) AS n FROM ev GROUP BY ALL) SELECT dst, time_bin, n, n > avg(n) OVER (PARTITION BY dst) + 3 * stddev_pop(n) OVER (PARTITION BY dst) AS event FROM c")
add("daily_trace_counts", lambda s, d: references.daily_trace_counts(fx.traces(s, d)), f"WITH {TRACES} SELECT af, date, count(*) AS n FROM (SELECT 4 AS af, to_timestamp(ts)::TIMESTAMP::DATE AS date FROM t) GROUP BY ROLLUP (af, date)")
add("distinct_link_ips", lambda s, d: references.distinct_link_ips(stats(s, d)), f"WITH {STATS} SELECT ip1 AS ip FROM st UNION SELECT ip2 FROM st")
add("distinct_routers", lambda s, d: references.distinct_routers(counts(s, d)), f"WITH {COUNTS} SELECT ip0 LIKE 'probe%' AS is_probe, count(DISTINCT ip0) AS n FROM e GROUP BY ALL")
add("ips_per_asn", lambda s, d: references.ips_per_asn(forwarding_reference(s, d), fx.rib(s)), f"WITH {COUNTS} SELECT ({asn_sql('ip1')})::BIGINT AS asn, count(DISTINCT ip1) AS n_ips FROM e WHERE ip1 <> 'x' GROUP BY ALL")
LINKS = STATS + f", lk AS (SELECT DISTINCT ip1, ip2, {asn_sql('ip1')} AS asn1, {asn_sql('ip2')} AS asn2 FROM st)"
links = lambda s, d: references.link_asns(stats(s, d).select("ip1", "ip2").distinct(), fx.rib(s))
add("asn_link_counts", lambda s, d: references.asn_link_counts(links(s, d)), f"WITH {LINKS} SELECT asn::BIGINT AS asn, count(*) AS n FROM (SELECT unnest(list_distinct([asn1, asn2])) AS asn FROM lk) GROUP BY ALL")
add("endpoint_counts", lambda s, d: references.endpoint_counts(links(s, d)), f"WITH {LINKS} SELECT key::BIGINT AS key, count(*) AS n FROM (SELECT unnest([asn1, asn2]) AS key FROM lk) GROUP BY ALL")
add("as_ranking", lambda s, d: references.as_ranking(magnitude.link_ends(stats(s, d), fx.rib(s)), references.endpoint_counts(links(s, d)), "median", 2),
    f"WITH {LINKS}, ends AS (SELECT time_bin, median, {asn_sql('ip')} AS asn FROM (SELECT time_bin, median, unnest([ip1, ip2]) AS ip FROM st)), c AS (SELECT unnest([asn1, asn2]) AS asn FROM lk), cc AS (SELECT asn, count(*) AS n FROM c GROUP BY ALL) SELECT ends.asn::BIGINT AS asn, sum(median) / any_value(n) / (SELECT count(DISTINCT time_bin) FROM st) AS score FROM ends JOIN cc ON ends.asn = cc.asn WHERE n > 2 GROUP BY ends.asn", "score")
add("link_distribution_stats", lambda s, d: references.link_distribution_stats(samples(s, d)),
    f"WITH {SAMPLES}, m AS (SELECT *, median(d) OVER (PARTITION BY ip1, ip2) AS m FROM s) SELECT ip1, ip2, count(*) AS n, avg(d) AS mean, stddev_pop(d) AS std, any_value(m) AS median, median(abs(d - m)) AS mad FROM m GROUP BY ip1, ip2 HAVING count(*) > 48", "mean std median mad")
add("sample_count_histogram", lambda s, d: references.histogram(samples(s, d).groupBy("ip1", "ip2").agg(F.count("*").alias("n")), "n", 50, 0, 8000),
    f"WITH {SAMPLES} SELECT least(floor(n / 160.0), 49)::INT AS bin, count(*) AS n FROM (SELECT count(*) AS n FROM s GROUP BY ip1, ip2) WHERE n <= 8000 GROUP BY 1")
# The normal distribution's quantiles by AS 241 (numerator, denominator; highest power first), near the middle and in the tails.
QUANTILE = [
    (["2.5090809287301226727e3", "3.3430575583588128105e4", "6.7265770927008700853e4", "4.5921953931549871457e4", "1.3731693765509461125e4", "1.9715909503065514427e3", "1.3314166789178437745e2", "3.3871328727963666080e0"],
     ["5.2264952788528545610e3", "2.8729085735721942674e4", "3.9307895800092710610e4", "2.1213794301586595867e4", "5.3941960214247511077e3", "6.8718700749205790830e2", "4.2313330701600911252e1", "1.0"]),
    (["7.7454501427834140764e-4", "2.27238449892691845833e-2", "2.41780725177450611770e-1", "1.27045825245236838258e0", "3.64784832476320460504e0", "5.76949722146069140550e0", "4.63033784615654529590e0", "1.42343711074968357734e0"],
     ["1.05075007164441684324e-9", "5.47593808499534494600e-4", "1.51986665636164571966e-2", "1.48103976427480074590e-1", "6.89767334985100004550e-1", "1.67638483018380384940e0", "2.05319162663775882187e0", "1.0"])]


def normality_sql(samples: str, value: str, min_n: int) -> str:
    """CTEs up to ``np`` (ip1, ip2, n, p): Shapiro-Wilk of each link's values, every sample ranked."""
    horner = lambda c, x: reduce(lambda a, b: f"({a}) * {x} + {b}", c)
    ratio = lambda k, x: f"({horner(QUANTILE[k][0], x)}) / ({horner(QUANTILE[k][1], x)})"
    poly = lambda c, x: horner(list(map(repr, c)), x)
    score = lambda p: f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {ratio(0, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} ELSE sign({p} - 0.5) * {ratio(1, f'(sqrt(-ln(least({p}, 1 - {p}))) - 1.6)')} END)"
    above = "list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(greatest(abs(z), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi()))))"
    return f"""n0 AS (SELECT ip1, ip2, {value} AS x, row_number() OVER (PARTITION BY ip1, ip2 ORDER BY {value}) AS i, count(*) OVER l AS n, avg({value}) OVER l AS mean FROM {samples} WINDOW l AS (PARTITION BY ip1, ip2)),
    n1 AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS pr FROM n0 WHERE n > {min_n}), n2 AS (SELECT *, {score('pr')} AS m FROM n1),
    n3 AS (SELECT ip1, ip2, n, sum(m * (x - mean)) AS mx, sum(m * m) AS ss, sum((x - mean) * (x - mean)) AS spread, min(x) AS a1, max(CASE WHEN i = 2 THEN x END) AS a2, max(CASE WHEN i = n - 1 THEN x END) AS b2, max(x) AS b1, max(m) AS t1, max(CASE WHEN i = n - 1 THEN m END) AS t2, 1 / sqrt(n) AS u FROM n2 GROUP BY ip1, ip2, n),
    n4 AS (SELECT *, {poly(statistics.END, 'u')} AS e0, {poly(statistics.NEXT, 'u')} AS e1 FROM n3), n5 AS (SELECT *, e0 * u + t1 / sqrt(ss) AS an, e1 * u + t2 / sqrt(ss) AS an1 FROM n4),
    n6 AS (SELECT *, (ss - 2 * t1 * t1 - 2 * t2 * t2) / (1 - 2 * an * an - 2 * an1 * an1) AS phi FROM n5),
    n7 AS (SELECT ip1, ip2, n, CASE WHEN a1 < b1 THEN least(1, power((mx - t1 * (b1 - a1) - t2 * (b2 - a2)) / sqrt(phi) + an1 * (b2 - a2) + an * (b1 - a1), 2) / spread) END AS w FROM n6),
    n8 AS (SELECT *, CASE WHEN w < 1 THEN (ln(1 - w) - ({poly(statistics.CENTER, 'ln(n)')})) / exp({poly(statistics.WIDTH, 'ln(n)')}) ELSE -10 END AS z FROM n7),
    np AS (SELECT ip1, ip2, n, CASE WHEN w IS NOT NULL THEN CASE WHEN abs(z) > 8 THEN CASE WHEN z > 0 THEN 0 ELSE 1 END ELSE 0.5 - sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * {above} END END AS p FROM n8)"""


add("normality", lambda s, d: references.normality(samples(s, d)), f"WITH {SAMPLES}, {normality_sql('s', 'd', 96)} SELECT * FROM np", "p")
add("normality_and_samples", lambda s, d: references.normality_and_samples(stats(s, d), 20),
    f"WITH {STATS}, {normality_sql('st', 'median', 20)} SELECT np.*, mean_samples FROM np JOIN (SELECT ip1, ip2, avg(n) AS mean_samples FROM st GROUP BY ALL) USING (ip1, ip2)", "p mean_samples")
add("ecdf", lambda s, d: references.ecdf(reference(s, d).withColumn("told", F.col("nb_reported") > 0), "mean", ["told"]),
    f"WITH {REF} SELECT nb_reported > 0 AS told, mean AS value, (row_number() OVER (PARTITION BY nb_reported > 0 ORDER BY mean) - 1) / count(*) OVER (PARTITION BY nb_reported > 0) AS y FROM ref", "value y")
_sum = lambda e, n: f"avg({e}) AS {n}_mean, stddev_pop({e}) AS {n}_std, min({e}) AS {n}_min, max({e}) AS {n}_max, median({e}) AS {n}_median"
add("delay_reference_stats", lambda s, d: references.delay_reference_stats(reference(s, d)),
    f"WITH {REF} SELECT {_sum('high - mean', 'up')}, {_sum('mean - low', 'down')}, {_sum('high - low', 'size')}, {_sum('nb_probes', 'probes')}, count(*) AS links, count_if(nb_reported > 0)::BIGINT AS reported, count_if(nb_reported > 0) / count(*) AS reported_share FROM ref",
    " ".join(f"{n}_{k}" for n in ("up", "down", "size") for k in ("mean", "std", "min", "max", "median")) + " probes_mean probes_std probes_median reported_share")
add("delay_reference_correlation", lambda s, d: references.delay_reference_correlation(reference(s, d)),
    f"""WITH {REF}, x AS (SELECT round(high - low, 9) AS a, nb_probes::DOUBLE AS b FROM ref WHERE nb_seen > 24 AND nb_probes > 3),
    rk AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM x)
    SELECT corr(a, b) AS pearson, corr(ra, rb) AS spearman, count(*) AS n FROM rk""", "pearson spearman")
add("observation_ratio", lambda s, d: references.observation_ratio(reference(s, d), P.window),
    f"WITH {REF}, x AS (SELECT CASE WHEN last_seen - first_seen < 86400 THEN 'day' WHEN last_seen - first_seen < 604800 THEN 'week' WHEN last_seen - first_seen < 2592000 THEN 'month' ELSE 'longer' END AS bucket, nb_seen / (1 + (last_seen - first_seen) / {P.window}) AS q FROM ref) SELECT bucket, count(*) AS n, avg(q) AS mean, median(q) AS median FROM x GROUP BY bucket", "mean median")
add("links_first_last_seen", lambda s, d: references.links_first_last_seen(reference(s, d)), f"WITH {REF} SELECT 'first' AS kind, first_seen AS ts, count(*) AS n FROM ref GROUP BY ALL UNION ALL SELECT 'last', last_seen, count(*) FROM ref GROUP BY ALL")
add("forwarding_reference_stats", lambda s, d: references.forwarding_reference_stats(forwarding_reference(s, d)), f"WITH {COUNTS} SELECT dst, ip0, count(DISTINCT ip1)::INT AS next_hops, bool_or(ip1 = 'x') AS reported FROM e WHERE ip0 <> 'x' GROUP BY ALL")
add("large_routers", lambda s, d: references.large_routers(forwarding_reference(s, d), 2), f"WITH {COUNTS} SELECT ip0, count(DISTINCT dst) AS n FROM e WHERE ip0 <> 'x' GROUP BY ip0 HAVING count(DISTINCT dst) > 2")
add("prune_small_targets", lambda s, d: forwarding.prune_small_targets(forwarding_reference(s, d), 100).groupBy("dst").agg(F.count("*").alias("n")), f"WITH {COUNTS} SELECT dst, count(DISTINCT ip0) AS n FROM e GROUP BY dst HAVING count(DISTINCT ip0) >= 100")
add("alarms_per_probe_count", lambda s, d: references.alarms_per_probe_count(stats(s, d).where("median > 20").withColumnRenamed("n_asn", "nb_probes"), reference(s, d)),
    f"WITH {REF} SELECT b.nb_probes, coalesce(a, 0) / n AS ratio FROM (SELECT nb_probes, count(*) AS n FROM ref GROUP BY ALL) b LEFT JOIN (SELECT n_asn AS nb_probes, count(*) AS a FROM st WHERE median > 20 GROUP BY ALL) USING (nb_probes)", "ratio")
add("metric_correlation", lambda s, d: references.metric_correlation(stats(s, d), "median", "n_asn"), f"WITH {STATS} SELECT corr(median, n_asn) AS r FROM st", "r")
add("outlier_share", lambda s, d: references.outlier_share(samples(s, d)),
    f"WITH {SAMPLES}, m AS (SELECT ip1, ip2, avg(d) AS m, stddev_pop(d) AS sd FROM s GROUP BY ALL) SELECT ip1, ip2, avg(CASE WHEN abs(d - m) > 3 * sd THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM s JOIN m USING (ip1, ip2) GROUP BY ALL", "share")
add("anomaly_graph", lambda s, d: references.anomaly_graph(alarms(s, d), NOW), f"WITH {FOLD} SELECT ip1, ip2, deviation, diff_med FROM al WHERE diff_med > 1 AND time_bin = {NOW}", "deviation diff_med")
add("publishable_delay_alarms", lambda s, d: publish.publishable_delay_alarms(alarms(s, d), fx.rib(s), P.window).select("ts", "ip", "asn", "dev_bound", "diff_med"),
    f"WITH {FOLD} SELECT time_bin + {P.window // 2} AS ts, ip, ({asn_sql('ip')})::BIGINT AS asn, dev_bound, diff_med FROM (SELECT *, unnest([ip1, ip2]) AS ip FROM al WHERE dev_bound >= 5 AND abs(diff_med) >= 5)", "dev_bound diff_med")
add("publishable_forwarding_alarms", lambda s, d: publish.publishable_forwarding_alarms(shares(s, d), fx.rib(s), s.createDataFrame([(65000 + k,) for k in range(5)], "asn long"), P.window, NOW).select("ts", "ip", "asn", "resp"),
    f"WITH {FORWARD} SELECT time_bin + {P.window // 2} AS ts, ip, ({asn_sql('ip')})::BIGINT AS asn, resp FROM rs WHERE resp > 0.1 AND time_bin = {NOW} AND {asn_sql('ip')} BETWEEN 65000 AND 65004", "resp")


def published_delay_alarms(s: SparkSession, d: str) -> DataFrame:
    """The published delay alarms with the measurements and probes behind them."""
    m = samples(s, d)
    told = delay.detect_delay_changes(delay.delay_stats(m, fx.rib(s), P, trim=False), None, P)[0]
    clear = told.where((F.col("dev_bound") >= 5) & (F.abs("diff_med") >= 5))
    return publish.publishable_delay_alarms(delay.with_measurements(clear, m), fx.rib(s), P.window).select("ts", "ip", "ip1", "ip2", "asn", "median", "nb_probes", "diff_med", "dev_bound", "msm_prb_ids")


def published_forwarding_alarms(s: SparkSession, d: str) -> DataFrame:
    """The published forwarding alarms with the measurements and probes behind each next hop."""
    now = forwarding_steps(s, d).where((F.col("corr") < 0.9) & (F.col("nb_seen") >= 3) & (F.col("time_bin") == NOW))
    resp = forwarding.responsibility(forwarding.with_measurements(now, fx.traces(s, d), P))
    registry = s.createDataFrame([(65000 + k,) for k in range(5)], "asn long")
    return publish.publishable_forwarding_alarms(resp, fx.rib(s), registry, P.window, NOW).select("ts", "dst", "ip0", "ip", "asn", "resp", "msm_prb_ids")


_ids = """'{' || string_agg('"' || msm || '":[' || ids || ']', ',' ORDER BY msm) || '}'"""
add("published_delay_alarms", published_delay_alarms,
    f"""WITH {FOLD}, pm AS (SELECT time_bin, ip1, ip2, msm, array_to_string(list_sort(list(DISTINCT prb)), ',') AS ids FROM s GROUP BY ALL), pj AS (SELECT time_bin, ip1, ip2, {_ids} AS msm_prb_ids FROM pm GROUP BY ALL),
    pn AS (SELECT time_bin, ip1, ip2, count(DISTINCT probe) AS nb_probes FROM s GROUP BY ALL)
    SELECT time_bin + {P.window // 2} AS ts, ip, ip1, ip2, ({asn_sql('ip')})::BIGINT AS asn, median, nb_probes, diff_med, dev_bound, msm_prb_ids FROM (SELECT *, unnest([ip1, ip2]) AS ip FROM al WHERE dev_bound >= 5 AND abs(diff_med) >= 5) JOIN pj USING (time_bin, ip1, ip2) JOIN pn USING (time_bin, ip1, ip2)""", "median diff_med dev_bound")
add("published_forwarding_alarms", published_forwarding_alarms,
    f"""WITH {FORWARD}, pe AS (SELECT DISTINCT t.time_bin, t.dst, a.ip AS ip0, b.ip AS ip1, t.msm, t.prb FROM fp a JOIN fn b ON a.tid = b.tid AND b.q = a.q + 1 JOIN t ON t.tid = a.tid WHERE t.time_bin = {NOW}),
    pm AS (SELECT time_bin, dst, ip0, ip1, msm, array_to_string(list_sort(list(prb)), ',') AS ids FROM pe GROUP BY ALL), pj AS (SELECT time_bin, dst, ip0, ip1 AS ip, {_ids} AS msm_prb_ids FROM pm GROUP BY ALL)
    SELECT time_bin + {P.window // 2} AS ts, dst, ip0, ip, ({asn_sql('ip')})::BIGINT AS asn, resp, msm_prb_ids FROM rs LEFT JOIN pj USING (time_bin, dst, ip0, ip) WHERE resp > 0.1 AND time_bin = {NOW} AND {asn_sql('ip')} BETWEEN 65000 AND 65004""", "resp")
add("delay_alarm_export", lambda s, d: publish.delay_alarm_rows(alarms(s, d), fx.rib(s)).select("time_bin", "asn0", "asn1", "ip0", "ip1", "label"),
    f"WITH {FOLD} SELECT strftime(to_timestamp(time_bin)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || '+00' AS time_bin, ({asn_sql('ip1')})::VARCHAR AS asn0, ({asn_sql('ip2')})::VARCHAR AS asn1, ip1 AS ip0, ip2 AS ip1, 'none' AS label FROM al WHERE diff_med > 1")
_end = lambda name, way: f"first(ip ORDER BY round(resp, 9) {way}, ip) AS ip_{name}, first(resp ORDER BY round(resp, 9) {way}, ip) AS resp_{name}"
add("forwarding_alarm_export", lambda s, d: publish.forwarding_alarm_rows(shares(s, d), fx.rib(s)),
    f"WITH {FORWARD}, x AS (SELECT time_bin, dst, ip0, {_end('most', 'DESC')}, {_end('least', 'ASC')} FROM rs GROUP BY ALL) SELECT *, ({asn_sql('ip_most')})::BIGINT AS asn_most, ({asn_sql('ip_least')})::BIGINT AS asn_least FROM x", "resp_most resp_least")
add("delay_alarm_values", lambda s, d: publish.delay_alarm_rows(rounded(alarms(s, d)), fx.rib(s)).select("time_bin", "ip0", "ip1", *[F.col(c).cast("double").alias(c) for c in ("dev_bound", "diff_med", "ref", "median")]),
    f"WITH {FOLD} SELECT strftime(to_timestamp(time_bin)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') || '+00' AS time_bin, ip1 AS ip0, ip2 AS ip1, coalesce(dev_bound, 0) AS dev_bound, diff_med, ref, median FROM al WHERE diff_med > 1", "dev_bound diff_med ref median")
add("hourly_grid", grid, f"WITH {EVENTS} SELECT asn, time_bin, value FROM grid", "value")
add("as_magnitude", lambda s, d: magnitude.as_magnitude(grid(s, d)), f"WITH {EVENTS}, {_magnitude_sql(169)} SELECT asn, time_bin, value, magnitude FROM mag", "value magnitude")
add("as_magnitude_notnull", lambda s, d: magnitude.as_magnitude(grid(s, d), mad="notnull"), f"WITH {EVENTS}, {_magnitude_sql(169, False)} SELECT asn, time_bin, value, magnitude FROM mag", "value magnitude")
add("rolling_magnitude", lambda s, d: magnitude.rolling_magnitude(grid(s, d), 168, 24), f"WITH {EVENTS}, {_magnitude_sql(168)} SELECT asn, time_bin, value, CASE WHEN seen >= 24 THEN magnitude END AS magnitude FROM mag", "value magnitude")
add("as_series_export", lambda s, d: publish.as_series_rows(magnitude.as_magnitude(grid(s, d)), "events").select("label", "time_bin", "asn", "value"),
    f"WITH {EVENTS} SELECT 'events' AS label, strftime(to_timestamp(time_bin)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS time_bin, asn::VARCHAR AS asn, value FROM grid", "value")
add("magnitude_events", lambda s, d: magnitude.magnitude_events(magnitude.as_magnitude(grid(s, d)), 2.0), f"WITH {EVENTS}, {_magnitude_sql(169)} SELECT asn, time_bin, value, magnitude FROM mag WHERE magnitude > 2", "value magnitude")
add("event_counts", lambda s, d: magnitude.event_counts(magnitude.magnitude_events(magnitude.as_magnitude(grid(s, d)), 1.0)),
    f"WITH {EVENTS}, {_magnitude_sql(169)}, p AS (SELECT asn, count(*) AS n FROM mag WHERE magnitude > 1 GROUP BY ALL) SELECT count(*) AS n_asn, avg(n) AS mean, median(n) AS median, stddev_samp(n) AS std, sum(n)::BIGINT AS total FROM p", "mean median std")
KEYWORDS = EVENTS + """, per AS (SELECT word, time_bin, sum(value) AS v FROM ev GROUP BY ALL),
ph AS (SELECT *, sum(v) OVER (PARTITION BY word ORDER BY time_bin RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW) AS h FROM per),
bv AS (SELECT time_bin, sum(value) AS b FROM ev GROUP BY ALL),
kw AS (SELECT time_bin, word, abs(v / nullif(b, 0)) AS tf, abs(v / nullif(b, 0)) * ln(1 + abs((SELECT sum(value) FROM ev) / nullif(h, 0))) AS tfidf FROM ph JOIN bv USING (time_bin))"""
keywords = lambda s, d: magnitude.event_keywords(e := events(s, d), e, "value", threshold=0.05)
add("event_keywords", keywords, f"WITH {KEYWORDS} SELECT * FROM kw WHERE tfidf > 0.05", "tf tfidf")
add("event_labels", lambda s, d: magnitude.event_labels(keywords(s, d)), f"WITH {KEYWORDS} SELECT time_bin, string_agg(word || ' (' || round(tf * 100)::INT || '%)', ', ' ORDER BY tfidf DESC, word) AS label FROM kw WHERE tfidf > 0.05 GROUP BY time_bin")
# the two above take every bin as an event; these take the bins found by magnitude
MAGNITUDE_KEYWORDS = KEYWORDS.replace(", per AS (", f", {_magnitude_sql(169)}, per AS (", 1).replace("FROM ph JOIN bv USING (time_bin)", "FROM ph JOIN bv USING (time_bin) WHERE time_bin IN (SELECT time_bin FROM mag WHERE magnitude > 2)")
magnitude_keywords = lambda s, d: magnitude.event_keywords(events(s, d), magnitude.magnitude_events(magnitude.as_magnitude(grid(s, d)), 2.0), "value", threshold=0.05)
add("magnitude_event_keywords", magnitude_keywords, f"WITH {MAGNITUDE_KEYWORDS} SELECT * FROM kw WHERE tfidf > 0.05", "tf tfidf")
add("magnitude_event_labels", lambda s, d: magnitude.event_labels(magnitude_keywords(s, d)), f"WITH {MAGNITUDE_KEYWORDS} SELECT time_bin, string_agg(word || ' (' || round(tf * 100)::INT || '%)', ', ' ORDER BY tfidf DESC, word) AS label FROM kw WHERE tfidf > 0.05 GROUP BY time_bin")
add("as_bin_stats", lambda s, d: magnitude.as_bin_stats(events(s, d), "value", "user_id"),
    f"WITH {EVENTS} SELECT asn, time_bin, avg(value) AS mean, median(value) AS median, sum(value) AS total, stddev_samp(value) AS std, count(DISTINCT user_id) AS n_ips, count(DISTINCT CASE WHEN value > 10 THEN user_id END) AS n_big_ips FROM ev GROUP BY ALL", "mean median total std")
add("signed_as_groups", lambda s, d: magnitude.signed_as_groups(events(s, d).select("asn", "time_bin", (F.col("value") - 20).alias("resp"))),
    f"WITH {EVENTS} SELECT time_bin, CASE WHEN value - 20 < 0 THEN '-' ELSE '+' END || asn AS label, sum(value - 20) AS resp FROM ev GROUP BY ALL", "resp")
add("delay_magnitude", lambda s, d: magnitude.delay_magnitude(alarms(s, d), fx.rib(s), NOW),
    f"WITH {FOLD}, ends AS (SELECT {asn_sql('ip')} AS asn, dev_bound FROM (SELECT unnest([ip1, ip2]) AS ip, dev_bound FROM al WHERE diff_med > 1 AND time_bin > {NOW} - 604800 AND time_bin <= {NOW})) SELECT asn::BIGINT AS asn, {NOW}::BIGINT AS time_bin, coalesce(sum(dev_bound), 0) AS value, coalesce(sum(dev_bound), 0) AS magnitude FROM ends GROUP BY asn", "value magnitude")
add("forwarding_magnitude", lambda s, d: magnitude.forwarding_magnitude(shares(s, d), fx.rib(s), NOW),
    f"WITH {FORWARD} SELECT ({asn_sql('ip')})::BIGINT AS asn, {NOW}::BIGINT AS time_bin, sum(resp) AS value, sum(resp) AS magnitude FROM rs WHERE time_bin = {NOW} GROUP BY ALL", "value magnitude")
add("derived_alarm_columns", lambda s, d: magnitude.derived_alarm_columns(alarms(s, d), fx.rib(s)).select("time_bin", "ip", "prefix", "asn", "diff_med_abs", "diff_abs", "dev_bound_pkt"),
    f"WITH {FOLD} SELECT time_bin, ip, regexp_replace(ip, '[.][0-9]+$', '.0/24') AS prefix, ({asn_sql('ip')})::BIGINT AS asn, abs(diff_med) AS diff_med_abs, abs(diff) AS diff_abs, dev_bound * n AS dev_bound_pkt FROM (SELECT *, unnest([ip1, ip2]) AS ip FROM al)", "diff_med_abs diff_abs dev_bound_pkt")
add("expired_reference", lambda s, d: delay.expire_reference(reference(s, d), NOW + 7 * 86400).select("ip1", "ip2", "last_seen"), f"WITH {REF} SELECT ip1, ip2, last_seen FROM ref WHERE last_seen >= {NOW}")


# ---- written, read back, streamed


def _archive(s: SparkSession, d: str) -> str:
    """A folder with the traceroutes as JSON lines and their measurements as a list."""
    path = work_path(s, "archive")
    t = fx.traces(s, d).drop("trace_id")
    t.write.option("compression", "gzip").json(f"{path}/json")
    t.select(F.concat(F.lit('"msm_id":'), F.col("msm_id").cast("string"))).write.text(f"{path}/ids")
    return path


def stored_traceroutes(s: SparkSession, d: str) -> DataFrame:
    """Archive -> measurements of the list, less a blacklisted one -> day partitions -> counts."""
    path = _archive(s, d)
    known = tables.select_measurements(tables.read_traceroutes(s, f"{path}/json", af=4), tables.read_msm_ids(s, f"{path}/ids"), (5003,))
    tables.write_traceroutes(known, f"{path}/days", files_per_day=1)
    back = s.read.parquet(f"{path}/days")
    return back.groupBy("af", "msm_id", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.size("result"), F.lit(0))).alias("hops"))


def array_traceroutes(s: SparkSession, d: str) -> DataFrame:
    """Traceroutes written as files of one JSON array each, read back in blocks: counts and sums by measurement."""
    path = work_path(s, "arrays")
    text = fx.traces(s, d).drop("trace_id").select(F.to_json(F.struct("*")).alias("value"))
    ship_code(s)
    text.mapInPandas(arrays.as_array, "value string").write.text(path)
    back = tables.read_traceroutes(s, path, af=4, arrays=True)
    replies = F.aggregate(F.coalesce("result", F.array().cast(HOPS)), F.lit(0), lambda n, h: n + F.size(h["result"]))
    return back.groupBy("af", "msm_id", "dst_addr").agg(F.count("*").alias("n"), F.sum("prb_id").alias("probes"), F.sum("timestamp").alias("seconds"), F.sum(replies).alias("replies"))


def streamed_traceroutes(s: SparkSession, d: str) -> DataFrame:
    path = _archive(s, d)
    jobs.ingest_stream(s, f"{path}/json", f"{path}/days", f"{path}/state").awaitTermination()
    return s.read.parquet(f"{path}/days").groupBy("af", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


def stored_reference(s: SparkSession, d: str) -> DataFrame:
    """Two versions of the delay reference; the one before the last is loaded."""
    path, st = work_path(s, "reference"), written(stats(s, d), "stats")
    for at in (NOW, NOW + 10 * P.window):
        tables.save_reference(delay.detect_delay_changes(st.where(F.col("time_bin") < at), None, P)[1], path, at)
    ref = tables.load_reference(s, path, DELAY_REFERENCE, before=NOW + 10 * P.window)
    return ref.where("nb_seen >= 3").select("ip1", "ip2", "mean", "high", "low", "nb_seen")


def stored_alarms(s: SparkSession, d: str) -> DataFrame:
    """A result table that is written twice holds everything once."""
    path, told = work_path(s, "alarms"), written(alarms(s, d), "told")
    for _ in range(2):
        tables.write_results(told, path, "e")
    return s.read.schema(f"exp_id string, date date, {DELAY_ALARM}").parquet(path).groupBy("exp_id", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"))


def stored_experiments(s: SparkSession, d: str) -> DataFrame:
    """The experiment over the table's time range, saved beside an older version of itself, loaded as the streaming one."""
    path = work_path(s, "experiments")
    low, high = fx.traces(s, d).agg(F.min("timestamp"), F.max("timestamp")).first()  # one row
    for at, end in ((1, low), (2, high + 1)):
        tables.save_experiment(s, Params(exp_id="stream", stream=True, start=low, end=end, expire_days=7), path, at)
    p = tables.load_experiment(s, path, stream=True)
    return s.createDataFrame([(p.exp_id, p.start, p.end, p.alpha, p.expire_days)], "exp_id string, start long, end long, alpha double, expire_days int")


def backfilled_msm_ids(s: SparkSession, d: str) -> DataFrame:
    """Alarms without measurement ids get them from the table of (alarm, measurement, probe)."""
    m = written(samples(s, d).where(F.col("time_bin") == NOW), "samples_now")
    alarm = F.concat_ws(" ", "ip1", "ip2").alias("alarm_id")
    told = m.groupBy("ip1", "ip2").agg(F.count("*").alias("n")).select(alarm, F.when(F.col("n") % 2 == 0, "{}").alias("msm_prb_ids"))
    return forwarding.backfill_msm_probe_ids(told, m.select(alarm, F.col("msm_id").alias("msmid"), F.col("prb_id").alias("probeid")))


add("stored_traceroutes", stored_traceroutes, f"""WITH {TRACES}, nh AS (SELECT tid, count(DISTINCT hop) AS hops FROM r GROUP BY tid)
    SELECT 4 AS af, msm AS msm_id, strftime(to_timestamp(ts)::TIMESTAMP, '%Y-%m-%d') AS date, count(*) AS n, sum(coalesce(hops, 0))::BIGINT AS hops FROM t LEFT JOIN nh USING (tid) WHERE msm <> 5003 GROUP BY ALL""")
add("array_traceroutes", array_traceroutes, f"""WITH {TRACES}, nr AS (SELECT tid, count(*) AS replies FROM r GROUP BY tid)
    SELECT 4 AS af, msm AS msm_id, dst AS dst_addr, count(*) AS n, sum(prb)::BIGINT AS probes, sum(ts)::BIGINT AS seconds, sum(coalesce(replies, 0))::BIGINT AS replies FROM t LEFT JOIN nr USING (tid) GROUP BY ALL""")
add("streamed_traceroutes", streamed_traceroutes, f"WITH {TRACES} SELECT 4 AS af, strftime(to_timestamp(ts)::TIMESTAMP, '%Y-%m-%d') AS date, count(*) AS n FROM t GROUP BY ALL")
add("stored_reference", stored_reference, f"WITH {FOLD} SELECT ip1, ip2, arg_max(r_median, k) AS mean, arg_max(r_hi, k) AS high, arg_max(r_lo, k) AS low, max(k)::INT AS nb_seen FROM k3 WHERE time_bin < {NOW} GROUP BY ALL HAVING max(k) >= 3", "mean high low")
add("stored_alarms", stored_alarms, f"WITH {FOLD} SELECT 'e' AS exp_id, strftime(to_timestamp(time_bin)::TIMESTAMP, '%Y-%m-%d') AS date, count(*) AS n FROM al GROUP BY ALL")
add("stored_experiments", stored_experiments, f"WITH {TRACES} SELECT 'stream' AS exp_id, min(ts) AS start, max(ts) + 1 AS \"end\", 0.01::DOUBLE AS alpha, 7 AS expire_days FROM t", "alpha")
add("backfilled_msm_ids", backfilled_msm_ids, f"""WITH {SAMPLES}, bm AS (SELECT ip1, ip2, msm, count(*) AS c, array_to_string(list_sort(list(DISTINCT prb)), ',') AS ids FROM s WHERE time_bin = {NOW} GROUP BY ALL)
    SELECT ip1 || ' ' || ip2 AS alarm_id, CASE WHEN sum(c) % 2 = 0 THEN '{{}}' ELSE {_ids} END AS msm_prb_ids FROM bm GROUP BY ip1, ip2""")
# ---- windows, streams and versions

LAST = NOW + 4 * P.window


def _arriving(s: SparkSession, d: str, path: str, late: bool = False):
    """Writes the traceroutes in three pieces of nine bins each, in no order, to where a stream finds them; after each piece the caller goes on."""
    piece = F.least(F.floor((F.col("timestamp") - P.start) / (9 * P.window)), F.lit(2))
    if late:
        piece = F.least(piece + F.when(F.col("trace_id") % 10 == 3, 1).otherwise(0), F.lit(2))
    t = written(fx.traces(s, d).withColumn("piece", piece.cast("int")), "pieces")
    for k in range(3):
        t.where(F.col("piece") == k).orderBy(F.xxhash64("trace_id")).drop("trace_id", "piece").write.mode("append").json(f"{path}/arriving")
        yield


def results(s: SparkSession, path: str, columns: str) -> DataFrame:
    """The columns of a result table; no row where nothing was ever found, and no files lie there."""
    return tables.read_results(s, path, s.createDataFrame([], columns).schema, P.exp_id)


def streamed(s: SparkSession, d: str, kind: str, p: Params = P) -> DataFrame:
    """Alarms of a stream that is stopped after each piece and goes on from its checkpoint."""
    path = work_path(s, "stream")
    for _ in _arriving(s, d, path):
        jobs.detection_stream(s, f"{path}/arriving", fx.rib(s), p, f"{path}/references", f"{path}/out", f"{path}/state", kinds=(kind,), trim=False).awaitTermination()
    return results(s, f"{path}/out/{kind}_alarms", {"delay": DELAY_ALARM, "forwarding": FORWARDING_ALARM}[kind])


def late_traceroutes(s: SparkSession, d: str) -> DataFrame:
    """A tenth of the traceroutes arrives with the piece after its own."""
    path = work_path(s, "stream")
    for _ in _arriving(s, d, path, late=True):
        jobs.detection_stream(s, f"{path}/arriving", fx.rib(s), P, f"{path}/references", f"{path}/out", f"{path}/state", kinds=()).awaitTermination()
    return jobs.late_counts(s, f"{path}/out", P)


def merged_traceroutes(s: SparkSession, d: str) -> DataFrame:
    """Arrivals of each day and batch, out of a store whose first batches were merged before the last one came; a reader that began before goes on."""
    path, seen = work_path(s, "stream"), []
    for k, _ in enumerate(_arriving(s, d, path)):
        jobs.detection_stream(s, f"{path}/arriving", fx.rib(s), P, f"{path}/references", f"{path}/out", f"{path}/state", kinds=()).awaitTermination()
        if k == 1:
            seen.append(jobs.stored_traces(s, f"{path}/out"))
            jobs.merge_stored(s, f"{path}/out")
    count = lambda df, name: df.groupBy(F.col("date").cast("string").alias("date"), "batch").agg(F.count("*").alias(name))
    return count(jobs.stored_traces(s, f"{path}/out"), "n").join(count(seen[0], "before"), ["date", "batch"], "left")


def replayed(s: SparkSession, d: str) -> DataFrame:
    """Alarms up to LAST: all but two windows in one run, then these one by one against the saved references."""
    path, t = work_path(s, "replay"), written(fx.traces(s, d), "traces")
    first = LAST - 2 * P.window
    jobs.analyse(s, t, fx.rib(s), P, P.start, first, f"{path}/references", f"{path}/out", ("delay",), trim=False)
    jobs.replay(s, t, fx.rib(s), P, first, 2, f"{path}/references", f"{path}/out", kinds=("delay",), trim=False)
    return results(s, f"{path}/out/delay_alarms", DELAY_ALARM)


def monitored_magnitudes(s: SparkSession, d: str) -> DataFrame:
    """Magnitudes of the bin NOW for every network with a link end in it, alarm or not."""
    path = work_path(s, "monitored")
    jobs.analyse(s, fx.traces(s, d), fx.rib(s), P, P.start, NOW + P.window, f"{path}/references", f"{path}/out", ("delay",), trim=False)
    return results(s, f"{path}/out/delay_magnitude", MAGNITUDE).where(F.col("time_bin") == NOW).select("asn", "time_bin", "value", "magnitude")


def versioned_reference(s: SparkSession, d: str) -> DataFrame:
    """The reference as of NOW, out of versions that hold what three steps have changed, two of them put together; a later one is there as well."""
    path, st = work_path(s, "versions"), written(stats(s, d), "stats")
    low = P.start
    for upto in (NOW - 6 * P.window, NOW - 2 * P.window, NOW, LAST):
        part = st.where((F.col("time_bin") >= low) & (F.col("time_bin") < upto))
        old = tables.load_reference(s, path, DELAY_REFERENCE, before=low, only=part)
        tables.save_reference(delay.detect_delay_changes(part, old, P, changes=True)[1], path, upto - P.window, changes=True)
        if upto == NOW - 2 * P.window:
            versions.compact(s, path, DELAY_REFERENCE, ["ip1", "ip2"], every=1)
        low = upto
    return tables.load_reference(s, path, DELAY_REFERENCE, before=NOW).where("nb_seen >= 3").select("ip1", "ip2", "mean", "high", "low", "first_seen", "last_seen", "nb_seen")


_AL = "time_bin, ip1, ip2, n, median, lo, hi, ref, ref_low, ref_high, nb_seen::INT AS nb_seen, diff, diff_med, deviation, dev_bound"
_al = [c.split("::")[0] for c in _AL.split(", ")]
_al_doubles = "median lo hi ref ref_low ref_high diff diff_med deviation dev_bound"
add("streamed_delay_alarms", lambda s, d: streamed(s, d, "delay").select(*_al), f"WITH {FOLD} SELECT {_AL} FROM al WHERE time_bin < (SELECT max(time_bin) FROM t)", _al_doubles)
add("streamed_forwarding_alarms", lambda s, d: streamed(s, d, "forwarding", Params(window=fx.WINDOW, start=fx.START, min_corr=0.9)).select("time_bin", "dst", "ip0", "corr", "nb_samples", "nb_peers", "nb_seen"),
    f"WITH {FORWARD} SELECT time_bin, dst, ip0, corr, nb_samples, nb_peers, nb_seen FROM fx WHERE corr < 0.9 AND nb_seen >= 3 AND time_bin < (SELECT max(time_bin) FROM t)", "corr")
add("late_traceroutes", late_traceroutes,
    f"""WITH {TRACES}, pc AS (SELECT *, least((ts - {fx.START}) // {9 * fx.WINDOW}, 2) AS own, least(least((ts - {fx.START}) // {9 * fx.WINDOW}, 2) + CASE WHEN tid % 10 = 3 THEN 1 ELSE 0 END, 2) AS piece FROM t),
    fr AS (SELECT b.k AS piece, (SELECT max(time_bin) FROM pc WHERE piece < b.k) AS frontier FROM (SELECT unnest([0, 1, 2]) AS k) b)
    SELECT time_bin, count(*) FILTER (WHERE NOT coalesce(time_bin < frontier, false)) AS on_time, count(*) FILTER (WHERE coalesce(time_bin < frontier, false)) AS late FROM pc JOIN fr USING (piece) GROUP BY time_bin""")
add("merged_traceroutes", merged_traceroutes,
    f"""WITH {TRACES}, dc AS (SELECT strftime(to_timestamp(ts)::TIMESTAMP, '%Y-%m-%d') AS date, least((ts - {fx.START}) // {9 * fx.WINDOW}, 2)::BIGINT AS batch, count(*) AS n FROM t GROUP BY ALL)
    SELECT *, CASE WHEN batch < 2 THEN n END AS before FROM dc""")
add("replayed_delay_alarms", lambda s, d: replayed(s, d).select(*_al), f"WITH {FOLD} SELECT {_AL} FROM al WHERE time_bin < {LAST}", _al_doubles)
add("monitored_magnitudes", monitored_magnitudes,
    f"""WITH {FOLD}, ends AS (SELECT {asn_sql('ip')} AS asn, dev_bound FROM (SELECT unnest([ip1, ip2]) AS ip, dev_bound FROM al WHERE diff_med > 1 AND time_bin = {NOW})), mo AS (SELECT DISTINCT {asn_sql('ip')} AS asn FROM (SELECT unnest([ip1, ip2]) AS ip FROM st WHERE time_bin = {NOW}))
    SELECT mo.asn::BIGINT AS asn, {NOW}::BIGINT AS time_bin, coalesce(sum(dev_bound), 0) AS value, coalesce(sum(dev_bound), 0) AS magnitude FROM mo LEFT JOIN ends ON ends.asn = mo.asn GROUP BY mo.asn""", "value magnitude")
add("versioned_reference", versioned_reference, f"WITH {FOLD} SELECT ip1, ip2, arg_max(r_median, k) AS mean, arg_max(r_hi, k) AS high, arg_max(r_lo, k) AS low, min(time_bin) AS first_seen, max(time_bin) AS last_seen, max(k)::INT AS nb_seen FROM k3 WHERE time_bin < {NOW} GROUP BY ALL HAVING max(k) >= 3", "mean high low")
# magnitudes over real hours: an alarm for each event
_HOURLY = """al0 AS (SELECT time_bin, '30.' || (user_id % 7) || '.0.1' AS ip1, '30.' || (user_id % 3) || '.0.2' AS ip2, value AS dev_bound, value / 5 AS diff_med, value - 20 AS resp FROM ev),
ends AS (SELECT unnest([ip1, ip2]) AS ip, time_bin, dev_bound AS v FROM al0 WHERE diff_med > 1), rr AS (SELECT ip1 AS ip, time_bin, resp AS v FROM al0),
hours AS (SELECT DISTINCT time_bin FROM ev)"""
_hourly_sql = lambda of: f"""WITH {EVENTS}, {_HOURLY}, u AS (SELECT 65000 + split_part(ip, '.', 2)::INT AS asn, time_bin, sum(v) AS v FROM {of} GROUP BY ALL),
    tg AS (SELECT asn, hours.time_bin FROM (SELECT DISTINCT asn FROM u) CROSS JOIN hours),
    fr AS (SELECT tg.asn, tg.time_bin, list(CASE WHEN g.k = 168 THEN 0 ELSE coalesce(u.v, 0) END) AS h, max(CASE WHEN g.k = 0 THEN coalesce(u.v, 0) END) AS value, bool_or(u.v IS NOT NULL AND g.k < 168) AS seen FROM tg CROSS JOIN (SELECT unnest(range(169)) AS k) g LEFT JOIN u ON u.asn = tg.asn AND u.time_bin = tg.time_bin - g.k * 3600 GROUP BY tg.asn, tg.time_bin)
    SELECT asn::BIGINT AS asn, time_bin, value, (value - list_median(h)) / (1 + 1.4826 * list_median(list_transform(h, lambda x: abs(x - list_median(h))))) AS magnitude FROM fr WHERE seen"""  # noqa: E731


def hourly_alarms(s: SparkSession, d: str) -> tuple[DataFrame, list[int]]:
    """An alarm for each event, and the hours in which there are any."""
    e = events(s, d)
    ip = lambda n, k: F.concat(F.lit("30."), F.col("user_id") % n, F.lit(f".0.{k}"))
    hours = sorted(r[0] for r in e.select("time_bin").distinct().collect())  # one row for each hour
    return e.select("time_bin", ip(7, 1).alias("ip1"), ip(3, 2).alias("ip2"), F.col("value").alias("dev_bound"), (F.col("value") / 5).alias("diff_med"), (F.col("value") - 20).alias("resp")), hours


add("hourly_delay_magnitude", lambda s, d: magnitude.delay_magnitude((h := hourly_alarms(s, d))[0], fx.rib(s), h[1]), _hourly_sql("ends"), "value magnitude")
add("hourly_forwarding_magnitude", lambda s, d: magnitude.forwarding_magnitude((h := hourly_alarms(s, d))[0].withColumnRenamed("ip1", "ip"), fx.rib(s), h[1]), _hourly_sql("rr"), "value magnitude")
add("as_series_values", lambda s, d: publish.as_series_rows(magnitude.as_magnitude(grid(s, d)), "events"),
    f"WITH {EVENTS}, {_magnitude_sql(169)} SELECT magnitude, value, 'events' AS label, strftime(to_timestamp(time_bin)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS time_bin, asn::VARCHAR AS asn FROM mag", "value magnitude")
add("as_names", lambda s, d: publish.as_names(magnitude.link_ends(stats(s, d), fx.rib(s)), fx.rib(s)),
    f"WITH {STATS} SELECT DISTINCT ({asn_sql('ip')})::BIGINT AS asn, CASE WHEN ip LIKE '30.%' THEN 'R' || split_part(ip, '.', 2) ELSE 'Unk' END AS asname FROM (SELECT ip1 AS ip FROM st UNION SELECT ip2 FROM st)")
_dev = lambda e, n: f"median(abs({e} - m_{n})) AS {n}_mad"
_mad_of = {"up": "(high - mean)", "down": "(mean - low)", "size": "(high - low)", "probes": "nb_probes::DOUBLE"}
add("delay_reference_mad", lambda s, d: references.delay_reference_mad(reference(s, d)),
    f"WITH {REF}, mm AS (SELECT {', '.join(f'median({e}) AS m_{n}' for n, e in _mad_of.items())} FROM ref) SELECT {', '.join(_dev(e, n) for n, e in _mad_of.items())} FROM ref, mm", " ".join(f"{n}_mad" for n in _mad_of))
