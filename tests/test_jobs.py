"""Both analyses window by window, and the job's entry point."""

from pyspark.sql import functions as F

from pathwatch.jobs import detect
from pathwatch.operators import forwarding, references
from pathwatch.schema import FORWARDING_REFERENCE, PREFIXES, Params
from pathwatch.sources import fixtures, tables
from pathwatch.streaming import jobs

from tests.conftest import DATA

COUNTS = "time_bin long, dst string, ip0 string, ip1 string, probe string, weight double"


def test_forwarding_replay_equals_batch(spark):
    rib = spark.createDataFrame([(f"20.{k}.0.0/16", 16, 100 + k, "", "") for k in range(4)], PREFIXES)
    hop = lambda t, k: "n2" if t >= 5 and k != 1 else "x" if (t + k) % 3 == 0 else "n1"
    # one network sends so much that it has to be thinned out
    rows = [(3600 * t, "d", r, hop(t, k), f"20.{k}.0.{i}", 200.0 if k == 0 else 1.5) for t in range(7) for r in ("r", "s") for k in range(4) for i in range(2)]
    df, p = spark.createDataFrame(rows, COUNTS), Params()
    key = lambda r: (r.time_bin, r.dst, r.ip0)
    batch, want = forwarding.detect_forwarding_changes(df, rib, None, p)
    ref, told = None, []
    for t in range(7):
        steps, ref = forwarding.detect_forwarding_changes(df.where(F.col("time_bin") == 3600 * t), rib, ref, p)
        told += steps.collect()
    assert sorted(map(lambda r: r.asDict(), told), key=lambda r: (r["time_bin"], r["ip0"])) == [r.asDict() for r in sorted(batch.collect(), key=key)]
    assert any(r.alarm for r in told) and max(r.nb_samples for r in told) < 404
    by = lambda f: sorted((r.asDict() for r in f.collect()), key=lambda r: r["ip0"])
    assert by(ref) == by(want)


def test_detection_of_a_range_and_of_the_next_windows(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("traces", "prefixes", "out", "references", "experiments")}
    fixtures.traces(spark, DATA).write.parquet(at["traces"])
    fixtures.rib(spark).write.json(at["prefixes"])
    half = fixtures.START + 6 * fixtures.WINDOW
    tables.save_experiment(spark, Params(exp_id="e", window=fixtures.WINDOW, start=fixtures.START, end=half, min_seen=1, min_corr=0.9), at["experiments"], 1)
    common = [x for k, v in at.items() for x in (f"--{k}", v)] + ["--exp-id", "e"]
    detect.main(common)
    assert tables.load_reference(spark, at["references"] + "_forwarding", FORWARDING_REFERENCE).count() > 0
    detect.main([*common, "--replay", "1"])
    p = tables.load_experiment(spark, at["experiments"], "e")
    assert (p.start, p.end) == (half, half + fixtures.WINDOW)
    done = {name: spark.read.parquet(f"{at['out']}/{name}") for name in ("delay_alarms", "forwarding_alarms")}
    assert all({"msm", "exp_id", "date"} <= set(df.columns) for df in done.values())
    assert jobs.previous_window(7300, 3600) == 3600


def test_running_sum_over_ranges(spark):
    rows = [(k % 3, float(k * 7 % 50)) for k in range(400)]
    got = references.running_sum(spark.createDataFrame(rows, "s int, x double"), "x", F.lit(1), ["s"]).collect()
    for s in range(3):
        own = sorted((r for r in got if r.s == s), key=lambda r: r.run)
        assert [r.run for r in own] == list(range(1, len(own) + 1)) and all(r.total == len(own) for r in own)
        assert [r.x for r in own] == sorted(x for k, x in rows if k == s)
