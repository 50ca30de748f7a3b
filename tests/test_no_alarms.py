"""Stored results of tables in which nothing is found, or nothing is there."""

import os

import duckdb
import pytest

from pathwatch import queries as core

from tests.conftest import DATA

QUERIES = ["stored_alarms", "replayed_delay_alarms", "streamed_delay_alarms", "streamed_forwarding_alarms"]


@pytest.fixture(scope="module", params=["o_orderdate < TIMESTAMP '1995-07-01'", "o_orderkey < 0"], ids=["two_bins", "empty"])
def cut(request, tmp_path_factory):
    """The smallest tables with the orders of two bins, too few for any reference, or with none."""
    path, c = str(tmp_path_factory.mktemp("cut")), duckdb.connect()
    for f in os.listdir(DATA):
        name = f.split(".")[0]
        c.sql(f"COPY (SELECT * FROM '{DATA}/{f}' {f'WHERE {request.param}' if name == 'orders' else ''}) TO '{path}/{f}' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/{f}'")
    return path, c


@pytest.mark.parametrize("name", QUERIES)
def test_no_alarm_is_no_error(spark, cut, name):
    path, c = cut
    twin = c.sql(core.ORACLES[name])
    df = core.QUERIES[name](spark, path)
    assert sorted(df.columns) == sorted(twin.columns) and df.collect() == twin.fetchall() == []
