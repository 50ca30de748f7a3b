"""The driver's relational tables seen as traceroutes, and prefix tables that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwatch.schema import HOPS, PREFIXES

START = 788918400  # 1995-01-01
WINDOW = 91 * 86400


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One traceroute for each order: a hop for each line number, a reply for each line item."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o = read("orders").join(read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    k = F.col("o_custkey")
    o = o.select(
        F.col("o_orderkey").alias("trace_id"), F.unix_timestamp("o_orderdate").alias("timestamp"), F.lit(4).alias("af"), (5001 + k % 5).alias("msm_id"), k.alias("prb_id"),
        F.concat_ws(".", F.lit("20"), F.col("c_nationkey"), F.floor(k / 256), k % 256).alias("from"), F.concat(F.lit("40.0.0."), F.substring("o_orderpriority", 1, 1)).alias("dst_addr"))
    li = read("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_returnflag").withColumnRenamed("l_orderkey", "trace_id")
    x = li.join(o.select("trace_id", "timestamp", "dst_addr"), "trace_id")
    odd = (F.col("timestamp") >= 915148800) & (F.col("timestamp") < 930787200)  # the first half of 1999
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    router = F.concat(F.lit("30."), n - 1, F.lit(".0."), (n - 1) * 3 + s % 3)
    ip = F.when((F.col("l_returnflag") == "R") & (s % 10 == 0), F.lit(None)).when(s % 11 == 0, "192.168.0.1").when((n == 3) & (F.col("dst_addr") == "40.0.0.1") & odd, "30.2.0.90").otherwise(router)
    rtt = n * 10 + F.col("l_quantity") / 10 + F.when((n == 2) & (s % 3 == 1) & odd, 40).otherwise(0)
    null = F.lit(None)
    reply = F.struct(ip.alias("from"), rtt.cast("double").alias("rtt"), null.cast("int").alias("ttl"), null.cast("int").alias("size"), null.cast("string").alias("err"), F.when(ip.isNull(), "*").alias("x"))
    hops = x.groupBy("trace_id", n.alias("hop")).agg(F.collect_list(reply).alias("result")).groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("hop", F.lit(None).cast("string").alias("error"), "result"))).cast(HOPS).alias("result"))
    return o.join(hops, "trace_id", "left")


def rib(spark: SparkSession, skewed: bool = False) -> DataFrame:
    """Prefix table: a network for each probe nation and each hop, and some more specific prefixes. skewed: most probes share one network."""
    rows = [(f"20.{n}.0.0/16", 16, 64500 + (max(0, n - 19) if skewed else n), f"P{n}", f"C{n % 5}") for n in range(25)]
    rows += [(f"30.{h}.0.0/16", 16, 65000 + h, f"R{h}", f"C{h % 5}") for h in range(7)]
    rows += [(f"20.{n}.1.0/24", 24, 64600 + n, f"S{n}", "C9") for n in (1, 2)] if not skewed else []
    return spark.createDataFrame(rows, PREFIXES)


def addresses6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, ip): an IPv6 address for each customer, short or written out, and the IPv4 address of its probe."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("long")
    low = lambda x: F.lower(F.hex(x))
    ip = F.when(k % 10 == 9, F.concat(F.lit("2002::1:"), low(k))).when(k % 2 == 0, F.concat(F.lit("2001:db8:"), low(n), F.lit("::"), low(k)))
    ip = ip.otherwise(F.concat(F.lit("2001:0DB8:"), F.lpad(F.hex(n), 4, "0"), F.lit(":0:8000:0:0:"), F.hex(k)))
    v4 = F.concat_ws(".", F.lit("20"), n, F.floor(k / 256), k % 256)
    return c.select(k.alias("k"), F.explode(F.array(ip, v4)).alias("ip"))


def rib6(spark: SparkSession) -> DataFrame:
    """IPv6 prefixes: one over all nations, one for most nations, and half of one more."""
    rows = [("2001:db8::/32", 32, 66000, "all", "C0"), ("2001:db8:3::/65", 65, 66500, "half", "C1")]
    rows += [(f"2001:db8:{n:x}::/48", 48, 66100 + n, f"N{n}", "C2") for n in range(25) if n % 5]
    return spark.createDataFrame(rows, PREFIXES)
