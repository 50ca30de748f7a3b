"""Detection over stored traceroutes (a range at once, the last full window, the next windows of a replay), or over arriving ones.

    spark-submit detect.py --traces DIR --prefixes FILE --out DIR --references DIR --experiments DIR [--exp-id ID] [--replay N | --previous NOW | --stream CHECKPOINT]
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from pathwatch.schema import PREFIXES, Params
from pathwatch.sources.tables import load_experiment, save_experiment
from pathwatch.streaming.jobs import analyse, detection_stream, previous_window, replay


def main(args: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description=__doc__)
    for name in ("traces", "prefixes", "out", "references", "experiments"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--exp-id")
    way = a.add_mutually_exclusive_group()
    way.add_argument("--replay", type=int, help="how many windows after the last analysed one")
    way.add_argument("--previous", type=int, help="epoch seconds: analyse the last full window before")
    way.add_argument("--stream", metavar="CHECKPOINT", help="traces is a folder in which files of JSON lines arrive")
    a.add_argument("--delay", type=int, default=0, help="seconds after its end for which a window of a stream stays open")
    o = a.parse_args(args)
    spark = SparkSession.builder.appName("pathwatch-detect").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    p = load_experiment(spark, o.experiments, o.exp_id, stream=o.exp_id is None and (o.previous is not None or o.stream is not None)) or Params(exp_id=o.exp_id or "default")
    rib, now = spark.read.schema(PREFIXES).json(o.prefixes), int(time.time())
    if o.stream:
        detection_stream(spark, o.traces, rib, p, o.references, o.out, o.stream, o.delay).awaitTermination()
        return
    traces = spark.read.parquet(o.traces)
    traces = traces.where(traces["af"] == p.af)
    if o.replay is None and o.previous is None:
        analyse(spark, traces, rib, p, p.start, p.end, o.references, o.out)
        save_experiment(spark, p, o.experiments, now)
    else:
        first = p.end if o.replay is not None else previous_window(o.previous, p.window)
        replay(spark, traces, rib, p, first, 1 if o.replay is None else o.replay, o.references, o.out, o.experiments, now)


if __name__ == "__main__":
    main()
