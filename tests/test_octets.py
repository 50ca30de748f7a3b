"""Addresses with a part beyond 255, as the view's probes have them from 65,536 customers on."""

import os
import random
from collections import Counter

import duckdb
import pytest

from pathwatch import queries as core
from pathwatch.functions import addresses
from pathwatch.schema import PREFIXES

from tests.conftest import DATA

NETS = ["0.0.0.0/0", "20.0.0.0/8", "20.4.0.0/14", "20.5.0.0/16", "20.5.0.0/17", "20.5.0.0/24", "20.5.0.0/32", "20.6.0.0/16", "20.6.1.0/24", "20.6.255.0/24", "21.0.0.0/15"]


def plain(ip):
    """The longest prefix whose bits are all among those of the leading parts that fit a byte."""
    known = ""
    for part in map(int, ip.split(".")):
        if part > 255:
            break
        known += f"{part:08b}"
    bits = lambda net: "".join(f"{int(x):08b}" for x in net.split("/")[0].split("."))[: int(net.split("/")[1])]
    return max((n for n in NETS if known.startswith(bits(n))), key=lambda n: int(n.split("/")[1]))


def test_nothing_is_carried_from_a_part_beyond_255(spark):
    g = random.Random(5)
    part = lambda: g.choice([0, 1, 5, 255, 256, 300, 511, 999, 3515, 70000, 10**20])
    ips = {f"20.{g.choice([4, 5, 6, 7, 300])}.{part()}.{part()}" for _ in range(200)} | {"300.1.1.1", "20.5.0.0", "20.5.256.0", "20.5.0.256", "21.256.0.0", "22.1.1.1", "256.256.256.256"}
    table = spark.createDataFrame([(n, int(n.split("/")[1]), k + 1, "", "") for k, n in enumerate(NETS)], PREFIXES)
    df = spark.createDataFrame([(ip,) for ip in sorted(ips)], "ip string").repartition(3)
    for bound in (0, 10**6):
        got = {r.ip: NETS[r.asn - 1] for r in addresses.with_asn(df, "ip", table, v6=True, broadcast=bound).collect()}
        assert got == {ip: plain(ip) for ip in ips}
    none = spark.createDataFrame([("20.5.300.17",), ("1.2.3.256",)], "ip string")
    assert none.where(addresses.address_bits(none.ip).isNotNull()).isEmpty()


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The smallest tables with customers from 899,000 on."""
    path, c = str(tmp_path_factory.mktemp("shifted")), duckdb.connect()
    for f in os.listdir(DATA):
        key = {"customer.parquet": "c_custkey", "orders.parquet": "o_custkey"}.get(f)
        c.sql(f"COPY (SELECT * {f'REPLACE ({key} + 899000 AS {key})' if key else ''} FROM '{DATA}/{f}') TO '{path}/{f}' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}/{f}'")
    return path, c


@pytest.mark.parametrize("name", ["link_delay_stats", "asn_entropy", "ip_to_asn", "ip6_to_asn", "ip_to_country", "alarms_per_probe_count"])
def test_twins_of_many_customers(spark, shifted, name):
    path, c = shifted
    df, twin = core.QUERIES[name](spark, path), c.sql(core.ORACLES[name])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    rows = lambda names, found: Counter(tuple(value(r[names.index(x)]) for x in sorted(names)) for r in found)
    got = rows(df.columns, df.collect())
    assert got and got == rows(twin.columns, twin.fetchall())
