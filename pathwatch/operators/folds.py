"""Ordered folds over bins, as running sums and compositions of affine maps: nothing steps through a key's bins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwatch.operators.references import running_sum
from pathwatch.operators.statistics import LARGE

#: Bins that one window sees; powers of 1 - alpha stay far from the limits of a double within it.
BLOCK = 256


def running(df: DataFrame, keys: list[str], order: str, weight: Column, large: int = LARGE) -> DataFrame:
    """``df`` with ``run``: the sum of the weights of a key's rows up to each. Keys of more than ``large`` rows are split by ranges."""
    if df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > large).isEmpty():
        return df.withColumn("run", F.sum(weight).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    return running_sum(df, order, weight, keys).drop("total")


def smoothed(df: DataFrame, keys: list[str], k: str, columns: dict[str, tuple[str, str]], alpha: float, block: int = BLOCK) -> DataFrame:
    """``df`` with <name>_before and <name>_after: exponential averages before and after each of a key's rows k = 1, 2, ...

    columns: name -> (value, start), the start being the average at k = 0, the same in all rows of a key. A row maps the
    average m to (1 - alpha) m + alpha x. Such maps compose: rows of a block become one map by running sums, the
    blocks' maps are chained (a few numbers for each ``block`` rows), and each block starts from what lies before it.
    """
    q = max(1 - alpha, 1e-290)
    size = max(1, min(block, int(200 / -math.log(q)))) if q < 1 else block
    x = df.withColumns({"_b": F.floor((F.col(k) - 1) / size).cast("long"), "_r": (F.col(k) - 1) % size + 1})
    w = Window.partitionBy(*keys, "_b").orderBy(k)
    part = lambda v: F.lit(alpha) * F.col(v) * F.pow(F.lit(q), -F.col("_r"))
    x = x.withColumns({f"_t_{n}": part(v) for n, (v, _) in columns.items()})
    upto = lambda n, end: F.coalesce(F.sum(f"_t_{n}").over(w.rowsBetween(Window.unboundedPreceding, end)), F.lit(0.0))
    x = x.withColumns({f"_p_{n}": upto(n, -1) for n in columns} | {f"_u_{n}": upto(n, 0) for n in columns})
    ends = x.groupBy(*keys, "_b").agg(F.max("_r").alias("len"), *[F.sum(f"_t_{n}").alias(f"s_{n}") for n in columns], *[F.first(s).alias(f"v_{n}") for n, (_, s) in columns.items()])
    chain = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_b", "len", *[f"s_{n}" for n in columns]))).alias("blocks"), *[F.first(f"v_{n}").alias(f"v_{n}") for n in columns]).where(F.size("blocks") > 1)
    kind = "struct<_b:long," + ",".join(f"{n}:double" for n in columns) + ">"
    # a block's map, and the averages at its end, which are the start of the next one
    step = lambda acc, m: F.concat(acc, F.array(F.struct((m["_b"] + 1).alias("_b"), *[(F.pow(F.lit(q), m["len"]) * (F.element_at(acc, -1)[n] + m[f"s_{n}"])).alias(n) for n in columns]).cast(kind)))
    first = F.array(F.struct(F.lit(0).cast("long").alias("_b"), *[F.col(f"v_{n}").alias(n) for n in columns]).cast(kind))
    starts = chain.select(*keys, F.explode(F.aggregate("blocks", first, step)).alias("c")).select(*keys, "c._b", *[F.col(f"c.{n}").alias(f"_c_{n}") for n in columns]).where("_b > 0")
    x = x.join(starts, [*keys, "_b"], "left")
    power = lambda e: F.pow(F.lit(q), e)
    made = {}
    for n, (_, s) in columns.items():
        begin = F.coalesce(f"_c_{n}", s)
        made |= {f"{n}_before": power(F.col("_r") - 1) * (begin + F.col(f"_p_{n}")), f"{n}_after": power(F.col("_r")) * (begin + F.col(f"_u_{n}"))}
    return x.withColumns(made).select(*df.columns, *made)
