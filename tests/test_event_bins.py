"""Events at any hour, and outside the month."""

import datetime

import pytest
from pyspark.sql import functions as F

from pathwatch import queries as core

from tests.conftest import DATA
from tests.test_queries import duck, test_twin as twin  # noqa: F401


@pytest.mark.parametrize("name", ["magnitude_event_keywords", "magnitude_event_labels"])
def test_magnitude_twins(spark, duck, name):  # noqa: F811
    twin(spark, duck, name)


def test_keywords_of_all_magnitude_events(spark):
    found = {r.time_bin for r in core.QUERIES["magnitude_events"](spark, DATA).select("time_bin").distinct().collect()}
    got = {r.time_bin for r in core.QUERIES["magnitude_event_labels"](spark, DATA).collect()}
    assert got and got <= found and any(t % 86400 for t in got)


def test_grid_holds_all_rows(spark, tmp_path):
    at = lambda *d: datetime.datetime(*d, tzinfo=datetime.timezone.utc)
    rows = [(at(2023, 12, 31, 22, 30), 1, 2.0, "{}"), (at(2024, 1, 5), 1, 3.0, "{}"), (at(2024, 2, 3, 4, 5), 2, 7.0, "{}")]
    spark.createDataFrame(rows, "ts timestamp, user_id long, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = core.QUERIES["hourly_grid"](spark, str(tmp_path))
    assert got.agg(F.sum("value")).first()[0] == 12.0
    assert tuple(got.agg(F.min("time_bin"), F.max("time_bin")).first()) == (core.HOUR0 - 7200, 1706932800)
