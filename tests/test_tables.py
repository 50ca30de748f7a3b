"""Sources, sinks and streaming jobs, written and read back."""

import gzip
import json

from pyspark.sql import functions as F

from pathwatch.schema import DELAY_REFERENCE, Params
from pathwatch.sources import fixtures, tables
from pathwatch.streaming import jobs

from tests.conftest import DATA

DOC = {"timestamp": 86400, "af": 4, "msm_id": 5, "prb_id": 1, "from": "1.2.3.4", "dst_addr": "9.9.9.9", "result": [{"hop": 1, "result": [{"from": "8.8.8.8", "rtt": 1.5}, {"x": "*"}]}, {"hop": 2, "error": "e"}]}


def test_both_layouts(spark, tmp_path):
    with gzip.open(tmp_path / "lines.json.gz", "wt") as f:
        f.write("\n".join(json.dumps(DOC | {"af": a}) for a in (4, 6)))
    with gzip.open(tmp_path / "array.json.gz", "wt") as f:
        json.dump([DOC, DOC], f)
    lines = tables.read_traceroutes(spark, str(tmp_path / "lines.json.gz"), af=4)
    assert lines.count() == 1 and lines.first().result[0].result[1].x == "*"
    assert tables.read_traceroutes(spark, str(tmp_path / "array.json.gz"), arrays=True).count() == 2


def test_measurement_lists(spark, tmp_path):
    (tmp_path / "ids.txt").write_text('"msm_id":5\n"msm_id": 7\n"msm_id":5\n\nother\n')
    ids = tables.read_msm_ids(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.msm_id for r in ids.collect()) == [5, 7]
    df = spark.createDataFrame([(5,), (6,), (7,), (None,)], "msm_id long")
    assert [r.msm_id for r in tables.select_measurements(df, ids, (7,)).collect()] == [5]


def test_partitioned_store_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(DOC | {"timestamp": t}) for t in (10, 86410, 86420)))
    df = tables.read_traceroutes(spark, str(tmp_path / "in"))
    tables.write_traceroutes(df, str(tmp_path / "out"))
    q = jobs.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "stream"), str(tmp_path / "cp"))
    q.awaitTermination()
    for p in ("out", "stream"):
        got = {str(r.date): r["count"] for r in spark.read.parquet(str(tmp_path / p)).groupBy("date").count().collect()}
        assert got == {"1970-01-01": 1, "1970-01-02": 2}


def test_results_are_replaced_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([(0, 1), (90000, 2)], "time_bin long, v int")
    for _ in range(2):
        tables.write_results(df, str(tmp_path / "t"), "e")
    tables.write_results(df.where("v = 2"), str(tmp_path / "t"), "e")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_references_and_experiments(spark, tmp_path):
    path = str(tmp_path / "ref")
    assert tables.load_reference(spark, path, DELAY_REFERENCE).count() == 0
    for t in (1, 2):
        tables.save_reference(spark.createDataFrame([("a", "b", float(t), None, None, [], t, t, t, 0, 0)], DELAY_REFERENCE), path, t)
    assert tables.load_reference(spark, path, DELAY_REFERENCE).first()["mean"] == 2.0
    assert tables.load_reference(spark, path, DELAY_REFERENCE, before=2).first()["mean"] == 1.0
    p = Params(exp_id="x", alpha=0.02, stream=True, expire_days=7)
    tables.save_experiment(spark, Params(exp_id="y"), str(tmp_path / "e"), 1)
    tables.save_experiment(spark, p, str(tmp_path / "e"), 2)
    assert tables.load_experiment(spark, str(tmp_path / "e"), stream=True) == p and tables.load_experiment(spark, str(tmp_path / "e"), "y").alpha == 0.01


def test_config_dates(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"timeWindow": 3600, "start": {"$date": 1000}, "end": {"$date": 2000}}')
    assert tables.read_config(spark, str(tmp_path / "c.json")).select(F.unix_timestamp("end").alias("e")).first().e == 2


def test_replay_of_windows(spark, tmp_path):
    p = Params(window=fixtures.WINDOW, start=fixtures.START, exp_id="replay")
    jobs.replay(spark, fixtures.traces(spark, DATA).cache(), fixtures.rib(spark), p, fixtures.START, 2, str(tmp_path / "ref"), str(tmp_path / "out"))
    ref = tables.load_reference(spark, str(tmp_path / "ref"), DELAY_REFERENCE)
    assert ref.count() > 0 and ref.agg(F.max("nb_seen")).first()[0] == 2
