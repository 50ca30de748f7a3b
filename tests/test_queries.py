"""Queries against their SQL twins on the smallest tables, and the driver's contract."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from pathwatch import queries as core

from tests.conftest import DATA

@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_twin(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    twin = duck.sql(core.ORACLES[name])
    assert sorted(twin.columns) == columns
    value = lambda v: round(v, 6) if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    rows = lambda names, found: Counter(tuple(value(r[names.index(c)]) for c in columns) for r in found)
    assert rows(df.columns, df.collect()) == rows(twin.columns, twin.fetchall())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).columns
