"""The newer training-data queries against their SQL twins on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from pathwatch.llm import queries

from tests.conftest import DATA


@pytest.mark.parametrize("name", sorted(k for k in queries.ORACLES if k.startswith(("op11", "op12", "op13"))))
def test_twin(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df, twin = queries.QUERIES[name](spark, DATA), c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(twin.columns) == columns
    rows = lambda names, found: Counter(tuple(r[names.index(x)] for x in columns) for r in found)
    assert rows(df.columns, df.collect()) == rows(twin.columns, twin.fetchall())
