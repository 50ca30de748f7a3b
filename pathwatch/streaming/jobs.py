"""Continuous ingest and detection: references, monitored networks and progress are carried from window to window."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathwatch.operators import forwarding
from pathwatch.operators.delay import delay_stats, detect_delay_changes, link_samples, time_bin, with_measurements
from pathwatch.operators.magnitude import HOUR, delay_magnitude, forwarding_magnitude, link_ends
from pathwatch.schema import DELAY_REFERENCE, FORWARDING_REFERENCE, TRACEROUTE, Params
from pathwatch.session import written
from pathwatch.sources import parts, versions
from pathwatch.sources.tables import load_reference, read_results, save_experiment, save_reference, with_day, write_results

KINDS = ("delay", "forwarding")
HISTORY = 168
NETWORKS = "asn long, since long"
PROGRESS = "batch_id long, frontier long, newest long, n long, late long"
STORE = f"{TRACEROUTE}, batch long, late boolean, date date"
DAYS = ["late", "af", "date"]


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Store arriving traceroutes in the day partition of their own time, late ones too."""
    df = with_day(spark.readStream.schema(TRACEROUTE).json(source))
    return df.writeStream.partitionBy("af", "date").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- windows, one after the other


def analyse(spark: SparkSession, traces: DataFrame, rib: DataFrame, p: Params, first: int, upto: int, ref_path: str, out_path: str, kinds: tuple[str, ...] = KINDS, trim: bool = True) -> list[int]:
    """Analyse the windows of [first, upto) against the saved references; the bins in which links were seen.

    Stores the alarms with their measurements and probes, the magnitudes of all monitored networks, and what changed in
    the references. Networks are monitored for delays in the bins in which one of their link ends has statistics, and for
    forwarding from then on. Windows that are analysed again start from the same versions and replace their results, and
    analysing them one by one or together gives the same.
    """
    own = Params(**{**p.as_row(), "start": first, "end": upto})
    bins: list[int] = []
    if "delay" in kinds:
        samples = written(link_samples(traces, own), "samples")
        stats = written(delay_stats(samples, rib, own, trim), "stats")
        bins = sorted(r["time_bin"] for r in stats.select("time_bin").distinct().collect())  # one row for each window
        alarms, new = detect_delay_changes(stats, load_reference(spark, ref_path, DELAY_REFERENCE, before=first, only=stats), p, changes=True)
        told = _stored(with_measurements(alarms, samples), f"{out_path}/delay_alarms", p.exp_id, first)
        if bins:
            seen = written(link_ends(stats, rib).select("asn", "time_bin").distinct(), "monitored")
            write_results(delay_magnitude(told, rib, bins, HISTORY, asns=seen), f"{out_path}/delay_magnitude", p.exp_id)
            _monitor(seen, f"{ref_path}_networks", first, bins[-1])
            _carry(new, ref_path, bins[-1], DELAY_REFERENCE, p)
    if "forwarding" in kinds:
        counts, ref_path = forwarding.next_hop_counts(traces, own), f"{ref_path}_forwarding"
        seen = counts.select("dst", "ip0").distinct()
        steps, new = forwarding.detect_forwarding_changes(counts, rib, load_reference(spark, ref_path, FORWARDING_REFERENCE, before=first, only=seen), p, changes=True)
        steps = written(steps, "steps")
        own_bins = sorted(r["time_bin"] for r in steps.select("time_bin").distinct().collect())
        told = _stored(forwarding.with_measurements(steps.where("alarm"), traces, own), f"{out_path}/forwarding_alarms", p.exp_id, first)
        if own_bins:
            known = networks(spark, ref_path.removesuffix("_forwarding"), upto)
            known = known.withColumn("time_bin", F.explode(F.filter(F.array(*map(F.lit, own_bins)), lambda b: b >= F.col("since"))))
            asns = known if "delay" in kinds else None  # without delays nothing says which networks are monitored: those with alarms
            write_results(forwarding_magnitude(forwarding.responsibility(told), rib, own_bins, HISTORY, asns=asns), f"{out_path}/forwarding_magnitude", p.exp_id)
            _carry(new, ref_path, own_bins[-1], FORWARDING_REFERENCE, p)
        bins = sorted({*bins, *own_bins})
    return bins


def networks(spark: SparkSession, ref_path: str, before: int) -> DataFrame:
    """(asn, since): the networks that are monitored, and the first bin in which they were seen."""
    return versions.snapshot(spark, f"{ref_path}_networks", NETWORKS, ["asn"], before)


def _monitor(seen: DataFrame, path: str, first: int, last: int) -> None:
    """Add networks that were not monitored before to the registry."""
    spark = seen.sparkSession
    new = seen.groupBy("asn").agg(F.min("time_bin").alias("since")).join(versions.snapshot(spark, path, NETWORKS, ["asn"], first), "asn", "left_anti")
    versions.commit(new, path, last, ["asn"], buckets=1)
    versions.compact(spark, path, NETWORKS, ["asn"])


def _carry(changes: DataFrame, path: str, last: int, schema: str, p: Params) -> None:
    """Save what a window changed. References that were not seen for too long mean nothing any more and go when versions are put together."""
    save_reference(changes, path, last, changes=True)
    keep = None if p.expire_days is None else F.col("last_seen") >= last - p.expire_days * 86400
    versions.compact(changes.sparkSession, path, schema, changes.columns[:2], keep=keep)


def _stored(alarms: DataFrame, path: str, exp_id: str, first: int) -> DataFrame:
    """Write the windows' alarms; all alarms of the experiment that their magnitudes look back on."""
    write_results(alarms, path, exp_id)
    return read_results(alarms.sparkSession, path, alarms.schema, exp_id, since=first - HISTORY * HOUR)


def replay(spark: SparkSession, traces: DataFrame, rib: DataFrame, p: Params, first: int, n: int, ref_path: str, out_path: str, experiments: str | None = None, analysed_at: int = 0, kinds: tuple[str, ...] = KINDS, trim: bool = True) -> None:
    """The next n windows, one after the other; ``experiments`` gets a row with each window and the time of its analysis."""
    for k in range(n):
        at = first + k * p.window
        analyse(spark, traces, rib, p, at, at + p.window, ref_path, out_path, kinds, trim)
        if experiments:
            save_experiment(spark, Params(**{**p.as_row(), "start": at, "end": at + p.window}), experiments, analysed_at + k)


def previous_window(now: int, window: int) -> int:
    """Start of the last full window before ``now``."""
    return now // window * window - window


# ---- the same on a stream


def progress(spark: SparkSession, out_path: str) -> Row | None:
    """How far the stream has gone: the last finished batch, the bin up to which windows are analysed, the newest time seen."""
    try:
        return spark.read.schema(PROGRESS).parquet(f"{out_path}/progress").orderBy(F.desc("batch_id")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def stored_traces(spark: SparkSession, out_path: str) -> DataFrame:
    """Everything that has arrived, with the batch that brought it and whether it was late."""
    return parts.read(spark, f"{out_path}/traceroutes", STORE)


def merge_stored(spark: SparkSession, out_path: str, files_per_day: int = 1) -> str | None:
    """Put the batches' small files together, a few for each day; readers go on meanwhile."""
    return parts.merge(spark, f"{out_path}/traceroutes", STORE, DAYS, ["msm_id", "prb_id", "timestamp"], files_per_day)


def take_in(batch: DataFrame, batch_id: int, rib: DataFrame, p: Params, ref_path: str, out_path: str, delay: int = 0, kinds: tuple[str, ...] = KINDS, trim: bool = True) -> None:
    """Store a batch, then analyse the windows that it completes.

    A window is complete when something newer than its end plus ``delay`` has arrived. Rows of windows that were
    analysed before are late: they are stored, marked, and take no part in any detection. Every step replaces what an
    earlier attempt at the same batch has written, and the row of progress comes last, so a batch that is given twice,
    or broken off anywhere, has its effect once.
    """
    spark, done = batch.sparkSession, progress(batch.sparkSession, out_path)
    if done is not None and batch_id <= done["batch_id"]:
        return
    at = time_bin(F.col("timestamp"), p.start, p.window)
    late = F.isnull("timestamp") if done is None or done["frontier"] is None else F.coalesce(at < done["frontier"], F.lit(True))
    path, part = f"{out_path}/traceroutes", f"batch-{batch_id}"
    parts.add(with_day(batch.withColumns({"late": late, "batch": F.lit(batch_id).cast("long")})).repartition("af", "date"), path, part, DAYS)
    here = parts.read(spark, path, STORE, [part])
    got = here.agg(F.max("timestamp").alias("newest"), F.min(at).alias("first"), F.count("*").alias("n"), F.count_if("late").alias("late")).first()
    newest = max((x for x in (got["newest"], done and done["newest"]) if x is not None), default=None)
    frontier = done["frontier"] if done is not None and done["frontier"] is not None else got["first"]
    if newest is not None:
        upto = p.start + (newest - delay - p.start) // p.window * p.window
        if upto > frontier:
            analyse(spark, stored_traces(spark, out_path).where(~F.col("late") & (F.col("af") == p.af)), rib, p, frontier, upto, ref_path, out_path, kinds, trim)
            frontier = upto
    spark.createDataFrame([(batch_id, frontier, newest, got["n"], got["late"])], PROGRESS).coalesce(1).write.mode("append").parquet(f"{out_path}/progress")


def detection_stream(spark: SparkSession, source: str, rib: DataFrame, p: Params, ref_path: str, out_path: str, checkpoint: str, delay: int = 0, kinds: tuple[str, ...] = KINDS, trim: bool = True, files: int = 1000) -> StreamingQuery:
    """Detection over arriving traceroutes (JSON lines), up to ``files`` of them at a time; see ``take_in``.

    Started again with the same checkpoint it goes on where it was. What has arrived when it starts is worked off; a
    scheduler starts it again, hourly for windows of an hour.
    """
    arriving = spark.readStream.schema(TRACEROUTE).option("maxFilesPerTrigger", files).json(source)
    step = lambda batch, batch_id: take_in(batch, batch_id, rib, p, ref_path, out_path, delay, kinds, trim)
    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(spark: SparkSession, out_path: str, p: Params) -> DataFrame:
    """(time_bin, on_time, late): arrivals of each window."""
    t = stored_traces(spark, out_path).groupBy(time_bin(F.col("timestamp"), p.start, p.window).alias("time_bin"))
    return t.agg(F.count_if(~F.col("late")).alias("on_time"), F.count_if("late").alias("late"))
