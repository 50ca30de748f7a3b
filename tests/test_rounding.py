"""Rounding of a query's doubles as its SQL twin does it."""

import duckdb

from pathwatch import queries as core


def test_large_numbers_are_rounded_as_in_sql(spark):
    values = [56294995342130.0, -84442493013196.0, 3.3e15, 4503599.6273704955, 4.6e6 + 1 / 3, -7654321.0000005, 1e300, -1e303, 12.3456785, 0.0, -0.0, float("inf")] + [1.1 * 10.0**k / 3 for k in range(4, 20)]
    c = duckdb.connect()
    c.execute("CREATE TABLE t (i INT, c DOUBLE)")
    c.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(values)))
    want = [r[0] for r in c.execute("SELECT round(round(c, 9) + sign(c) * 1e-10, 6) + 0.0 FROM t ORDER BY i").fetchall()]
    assert [r.c for r in core.rounded(spark.createDataFrame([(v,) for v in values], "c double").coalesce(1)).collect()] == want
