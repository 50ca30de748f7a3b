"""Tables in versions and in parts, sliding magnitudes, and a batch that is given twice."""

import time

import numpy as np
from pyspark.sql import functions as F

from pathwatch.operators import magnitude
from pathwatch.schema import PREFIXES, TRACEROUTE, Params
from pathwatch.sources import parts, tables, versions
from pathwatch.streaming import jobs

SCHEMA = "a string, b string, x double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_of_changes(spark, tmp_path):
    path, keys = str(tmp_path / "v"), ["a", "b"]
    make = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    at = lambda before=None, **how: rows(versions.snapshot(spark, path, SCHEMA, keys, before, **how))
    assert at() == []
    versions.commit(make(("k", "1", 1.0), ("k", "2", 2.0)), path, 10, keys)
    versions.commit(make(("k", "2", 2.5), ("l", "1", 9.0)), path, 20, keys, gone=make(("k", "1", 0.0)))
    versions.commit(make(), path, 30, keys)
    assert at(before=20) == [("k", "1", 1.0), ("k", "2", 2.0)] and at() == at(before=30) == [("k", "2", 2.5), ("l", "1", 9.0)]
    assert at(only=make(("l", "1", 0.0))) == [("l", "1", 9.0)]
    assert versions.compact(spark, path, SCHEMA, keys, every=2) and not versions.compact(spark, path, SCHEMA, keys, every=2)
    assert at() == [("k", "2", 2.5), ("l", "1", 9.0)] and at(before=20) == [("k", "1", 1.0), ("k", "2", 2.0)]
    # going back: what came later rests on something that is no more
    versions.commit(make(("m", "1", 4.0)), path, 20, keys)
    assert at() == [("k", "1", 1.0), ("k", "2", 2.0), ("m", "1", 4.0)]


def test_what_is_written_follows_the_changes(spark, tmp_path):
    path, keys = str(tmp_path / "v"), ["a", "b"]
    big = spark.range(20000).select(F.col("id").cast("string").alias("a"), F.lit("b").alias("b"), F.rand(1).alias("x"))
    versions.commit(big, path, 1, keys)
    versions.commit(big.limit(3), path, 2, keys)
    size = [sum(f.stat().st_size for f in p.rglob("*.parquet")) for p in sorted((tmp_path / "v" / "data").iterdir(), key=lambda p: p.stat().st_mtime)]
    assert size[1] < size[0] / 20 and versions.snapshot(spark, path, SCHEMA, keys).count() == 20000


def test_merging_parts_beside_a_reader(spark, tmp_path):
    path = str(tmp_path / "p")
    one = lambda k: spark.createDataFrame([(str(k), str(i % 2), float(i)) for i in range(6)], SCHEMA)
    assert parts.read(spark, path, SCHEMA).count() == 0 and parts.merge(spark, path, SCHEMA, ["b"], ["x"]) is None
    for k in range(3):
        parts.add(one(k), path, f"p{k}", ["b"])
    parts.add(one(2), path, "p2", ["b"])  # once more
    before = parts.read(spark, path, SCHEMA)
    merged = parts.merge(spark, path, SCHEMA, ["b"], ["x"])
    parts.add(one(7), path, "p7", ["b"])
    assert parts.listed(spark, path) == [merged, "p7"] and len(list((tmp_path / "p" / "data" / f"part={merged}").rglob("*.parquet"))) == 2
    want = sorted(t for k in range(3) for t in map(tuple, one(k).collect()))
    assert rows(before) == want and rows(parts.read(spark, path, SCHEMA)) == sorted(want + list(map(tuple, one(7).collect())))


def test_a_batch_that_is_given_twice_has_its_effect_once(spark, tmp_path):
    hop = lambda h, ip: (h, None, [(ip, float(h), None, None, None, None)] * 3)
    t = lambda ts: (ts, None, 4, 1, 7, "20.0.0.1", None, "d", None, None, None, None, None, None, None, None, [hop(1, "30.0.0.1"), hop(2, "30.0.0.2")])
    batch = lambda *ts: spark.createDataFrame([t(x) for x in ts], TRACEROUTE)
    rib, p, ref, out = spark.createDataFrame([], PREFIXES), Params(window=100), str(tmp_path / "r"), str(tmp_path / "o")
    give = lambda k, df: jobs.take_in(df, k, rib, p, ref, out, kinds=())
    give(0, batch(10, 250))
    assert jobs.progress(spark, out)["frontier"] == 200
    give(1, batch(150, 260, 399, None))
    give(1, batch(150, 260, 399, None))
    # the second attempt of a batch that broke off before its progress was saved
    parts.add(spark.createDataFrame([(*t(1), 2, False, None)], jobs.STORE), f"{out}/traceroutes", "batch-2", jobs.DAYS)
    give(2, batch(299, 301))
    got = {r.time_bin: (r.on_time, r.late) for r in jobs.late_counts(spark, out, p).collect()}
    assert got == {0: (1, 0), 100: (0, 1), 200: (2, 1), 300: (2, 0), None: (0, 1)}
    assert jobs.progress(spark, out)["batch_id"] == 2 and jobs.progress(spark, out)["frontier"] == 300


def test_no_experiment_yet(spark, tmp_path):
    assert tables.load_experiment(spark, str(tmp_path / "none")) is None


def test_sliding_magnitude():
    g = np.random.default_rng(5)
    x = np.round(g.normal(size=400), 1)
    x[::17] = np.nan
    for rows in (1, 2, 7, 50):
        got = magnitude.sliding_magnitude(x, rows, 1)
        for i in range(len(x)):
            w = x[max(0, i - rows + 1) : i + 1]
            w = w[~np.isnan(w)]
            want = (x[i] - np.median(w)) / (1 + 1.4826 * np.median(np.abs(w - np.median(w)))) if len(w) else np.nan
            assert np.isclose(got[i], want, equal_nan=True)
    x = g.normal(size=20000)

    def cost(rows):
        t = time.process_time()
        magnitude.sliding_magnitude(x, rows)
        return time.process_time() - t

    assert cost(10000) < 8 * cost(100)  # a hundred times the history


def test_series_of_several_networks(spark):
    df = spark.createDataFrame([(a, 3600 * t, float((a * t) % 7), "x") for a in (1, 2) for t in range(30)] + [(None, 0, 1.0, "y"), (1, 3600 * 30, None, "z")], "asn long, time_bin long, value double, more string")
    got = magnitude.rolling_magnitude(df, 10, 3)
    assert got.columns == [*df.columns, "magnitude"] and got.count() == 62 and got.where("magnitude IS NULL").count() == 6
