"""Connected components of an edge table, in rounds of joins and minimum aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathwatch.session import written


def _ordered(a, b):
    return F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``edges``; root is the smallest node of the component.

    Alternating large-star and small-star rounds: each round points a node's larger, then its smaller
    neighbours at the smallest one. Only minima are gathered per node, with partial aggregation, so a node with
    very many neighbours is no hot group; the joins that follow can be split by adaptive execution. A round's
    edges are written to the shared folder; the loop ends when they are stars (the driver sees one row at most, never
    edges). Null ends and loops are ignored; an empty table gives an empty one.
    """
    e = written(edges.where(F.col(a) != F.col(b)).select(*_ordered(F.col(a), F.col(b))).distinct(), "edges")
    while not _stars(e):
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u AND v > m").select(F.col("m").alias("lo"), F.col("v").alias("hi")), "large")
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        e = written(small.union(lowest.select("m", "hi")).distinct(), "edges")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _stars(e: DataFrame) -> bool:
    """Whether every node is either a root or hangs at one root (edges are distinct)."""
    ends = e.select(F.col("hi").alias("n"), F.lit(1).alias("up")).union(e.select("lo", F.lit(0)))
    # a root has no edge up; another node has one, and none down
    return ends.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("down")).where("ups > 1 OR (ups = 1 AND down = 0)").isEmpty()
