"""Order statistics, diversity of networks, and trimming to it."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathwatch.session import ship_code, written


def wilson_half_width(n: Column, confidence: float = 0.05) -> Column:
    """Half width of the Wilson score interval at one half."""
    z = NormalDist().inv_cdf(1 - confidence / 2)
    return F.lit(z) / (2 * F.sqrt(n + z * z))


#: Rows of a group up to which they are sorted in one task; larger groups are narrowed down to it first.
LARGE = 100_000
#: Ranges into which a large group's values are cut at once.
CELLS = 1024


def order_statistics(samples: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], sizes: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """(*keys, n, *ranks): of each group the values at the given ranks (functions of n, from 1). Exact; null values are left out.

    Groups of up to ``large`` rows are sorted, in a window that can spill. Larger ones, however hot, never meet in one
    task: their values are counted by ranges, and only the ranges in which a wanted rank lies are looked into further.
    ``sizes``: (*keys, n) of the groups, if they are known; groups without a row in it must be no larger than ``large``.
    """
    x = samples.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_x"))
    known = x.groupBy(*keys).agg(F.count("*").alias("n")) if sizes is None else sizes.select(*keys, "n")
    hot = written(known.where(F.col("n") > large), "hot_groups")
    some = not hot.isEmpty()
    w = Window.partitionBy(*keys)
    small = x.join(hot, keys, "left_anti") if some else x
    r = small.select(*keys, "_x", F.row_number().over(w.orderBy("_x")).alias("_r"), F.count("*").over(w).alias("_n"))
    out = r.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_r") == f(F.col("_n")), F.col("_x"))).alias(k) for k, f in ranks.items()])
    return out.unionByName(_narrowed(x, hot, keys, ranks, large)) if some else out


def _narrowed(x: DataFrame, hot: DataFrame, keys: list[str], ranks: dict[str, Callable[[Column], Column]], large: int) -> DataFrame:
    """``order_statistics`` of large groups.

    In each round the rows that are left are cut into ranges between the least and the greatest of their part, and
    counted with partial aggregation. A part stays open if a wanted rank lies in it, so a group has at most as many as
    ranks; it is done when it holds one value only, or few enough rows to be sorted. At least the ends of a part are
    told apart, so it shrinks in every round.
    """
    want = F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in ranks.items()])
    rows = written(x.join(hot.select(*keys), keys, "left_semi").withColumn("_c", F.lit(1)), "hot_rows")
    bounds = rows.groupBy(*keys).agg(F.min("_x").alias("low"), F.max("_x").alias("high"))
    parts = written(hot.join(bounds, keys).select(*keys, F.lit(1).alias("_c"), "low", "high", F.lit(0).cast("long").alias("before"), want.alias("want")), "parts")
    found, part = [], [*keys, "_c"]
    while not parts.isEmpty():
        place = F.floor((F.col("_x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CELLS)
        cut = rows.join(parts.select(*part, "low", "high"), part).select(*part, "_x", F.when(F.col("high") > F.col("low"), F.least(place, F.lit(CELLS - 1))).otherwise(0).cast("int").alias("_d"))
        counted = cut.groupBy(*part, "_d").agg(F.count("*").alias("c"), F.min("_x").alias("low"), F.max("_x").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*part).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0))
        placed = counted.withColumn("upto", upto).join(parts.select(*part, "before", "want"), part).withColumn("first", F.col("before") + F.col("upto") - F.col("c"))
        inside = placed.withColumn("want", F.filter("want", lambda r: (r["rank"] > F.col("first")) & (r["rank"] <= F.col("first") + F.col("c")))).where(F.size("want") > 0)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy("_c", "_d"))
        chosen = written(inside.select(*part, "_d", number.alias("_e"), "c", "low", "high", F.col("first").alias("before"), "want"), "chosen")
        found.append(chosen.where("low = high").select(*keys, F.explode("want").alias("w"), F.col("low").alias("_x")).select(*keys, "w.name", "_x"))
        left = chosen.where("low < high")
        rows = written(cut.join(left.select(*part, "_d", "_e"), [*part, "_d"]).select(*keys, F.col("_e").alias("_c"), "_x"), "hot_rows")
        few = left.where(F.col("c") <= large).select(*keys, F.col("_e").alias("_c"), "before", "want")
        at = rows.join(few, part).withColumn("_r", F.col("before") + F.row_number().over(Window.partitionBy(*part).orderBy("_x")))
        found.append(at.select(*keys, "_x", F.explode(F.filter("want", lambda r: r["rank"] == F.col("_r"))).alias("w")).select(*keys, "w.name", "_x"))
        parts = written(left.where(F.col("c") > large).select(*keys, F.col("_e").alias("_c"), "low", "high", "before", "want"), "parts")
    values = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == k, F.col("_x"))).alias(k) for k in ranks])
    return hot.join(values, keys).select(*keys, "n", *ranks)


#: The two ranks between which the median lies.
MIDDLE = {"_m1": lambda n: F.floor((n + 1) / 2), "_m2": lambda n: F.floor(n / 2) + 1}


def medians(samples: DataFrame, keys: list[str], value: str, sizes: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """(*keys, n, median) of the values that are not null."""
    return order_statistics(samples, keys, value, MIDDLE, sizes, large).select(*keys, "n", ((F.col("_m1") + F.col("_m2")) / 2).alias("median"))


def median_ci(samples: DataFrame, keys: list[str], value: str, confidence: float = 0.05, sizes: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """(*keys, n, median, lo, hi): order statistics at the Wilson bounds of the median; see ``order_statistics``."""
    at = lambda sign: lambda n: F.floor(n * (0.5 + sign * wilson_half_width(n, confidence))).cast("int") + 1
    found = order_statistics(samples, keys, value, MIDDLE | {"lo": at(-1), "hi": at(1)}, sizes, large)
    return found.select(*keys, "n", ((F.col("_m1") + F.col("_m2")) / 2).alias("median"), "lo", "hi")


def asn_entropy(samples: DataFrame, keys: list[str], asn: str = "asn") -> DataFrame:
    """(*keys, n, n_asn, entropy): samples, networks, and the entropy of their shares over its maximum (null for one network)."""
    return entropy_of(samples.groupBy(*keys, asn).agg(F.count("*").alias("c")), keys)


def trim_counts(counts: list[int], min_asn: int, min_entropy: float) -> list[int] | None:
    """How many samples of each network are kept, or None if the group isn't diverse enough.

    While the entropy is too low and there are more than ``min_asn`` networks, one sample of the most frequent network
    goes (ties: the first). That lowers the greatest counts to a common level, and the entropy only rises on the way, so
    the level is found by bisection, and then how many of those at it are one below: the time does not depend on the counts.
    """
    c, k = np.asarray(counts, dtype=np.int64), len(counts)

    def diverse(v: np.ndarray) -> bool:
        n = int(v.sum())
        return k > 1 and n > 0 and (math.log(n) - float((v * np.log(np.maximum(v, 1))).sum()) / n) / math.log(k) >= min_entropy

    def least(low: int, high: int, holds) -> int:
        """The least number from low + 1 to high that holds; ``high`` does, and all above one that does."""
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (low, middle) if holds(middle) else (middle, high)
        return high

    if k < min_asn or diverse(c) or k == min_asn:
        return c.tolist() if k >= min_asn and diverse(c) else None
    top = int(c.max())
    if not diverse(np.minimum(c, 1)):
        return None
    cut = least(0, top - 1, lambda down: diverse(np.minimum(c, top - down)))
    level = np.minimum(c, top - cut + 1)
    highest = np.flatnonzero(level == top - cut + 1)

    def lowered(m: int) -> np.ndarray:
        v = level.copy()
        v[highest[:m]] -= 1
        return v

    return lowered(least(0, len(highest), lambda m: diverse(lowered(m)))).tolist()


def entropy_of(counts: DataFrame, keys: list[str], count: str = "c") -> DataFrame:
    """(*keys, n, n_asn, entropy) from one row for each key and network with its ``count``."""
    g = counts.groupBy(*keys).agg(F.sum(count).alias("n"), F.count("*").alias("n_asn"), F.sum(F.col(count) * F.log(count)).alias("s"))
    return g.select(*keys, "n", "n_asn", F.try_divide(F.log("n") - F.col("s") / F.col("n"), F.log("n_asn")).alias("entropy"))


def trim_plan(counts: DataFrame, keys: list[str], asn: str = "asn", min_asn: int = 3, min_entropy: float = 0.5) -> DataFrame:
    """(*keys, asn, c, keep, trimmed, n_asn, entropy): how many of each network's ``c`` samples are kept, and the diversity that is left.

    Groups that are diverse already, and those that can't be, are decided with built-in functions; only the count
    vectors of the rest (a few numbers for each group) go through the trimming helper. Groups that are not diverse
    enough and can't be trimmed to be so have no rows.
    """
    ship_code(counts.sparkSession)
    groups = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(asn).alias("a"), F.col("c")))).alias("_v"), F.sum("c").alias("_n"), F.count("*").alias("_k"), F.sum(F.col("c") * F.log("c")).alias("_s"))
    entropy = F.try_divide(F.log("_n") - F.col("_s") / F.col("_n"), F.log("_k"))
    groups = groups.where(F.col("_k") >= min_asn).withColumn("_e", entropy).where((F.col("_k") > min_asn) | (F.col("_e") >= min_entropy))

    def trim(v: pd.Series) -> pd.Series:
        return v.map(lambda x: trim_counts([r["c"] for r in x], min_asn, min_entropy), na_action="ignore")

    low = F.col("_e") < min_entropy
    kept = groups.withColumn("keep", F.when(~low, F.transform("_v", lambda x: x["c"])).otherwise(F.pandas_udf(trim, "array<long>")(F.when(low, F.col("_v"))))).where("keep IS NOT NULL")
    total = F.aggregate("keep", F.lit(0).cast("long"), lambda a, x: a + x)
    logs = F.aggregate("keep", F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.log(x)).otherwise(0.0))
    left = F.size(F.filter("keep", lambda x: x > 0)).cast("long")
    kept = kept.select(*keys, low.alias("trimmed"), left.alias("n_asn"), F.try_divide(F.log(total) - logs / total, F.log(left)).alias("entropy"), F.explode(F.arrays_zip("_v", "keep")).alias("_z"))
    return kept.select(*keys, F.col("_z._v.a").alias(asn), F.col("_z._v.c").alias("c"), F.col("_z.keep").alias("keep"), "trimmed", "n_asn", "entropy")


def trimmed_samples(samples: DataFrame, plan: DataFrame, keys: list[str], asn: str, order: list[str], ties: list[str] = (), seed: int = 1) -> DataFrame:
    """The samples that a plan keeps, with its columns trimmed, n_asn and entropy.

    Which of a network's samples stay is drawn by a seeded hash of the ``order`` columns (and ``ties`` among equals);
    only networks that lose samples are sorted for it.
    """
    both = samples.join(plan, [*keys, asn])
    whole, cut = both.where("keep = c"), both.where("keep < c")
    draw = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(x).cast("string") for x in order]).cast("binary"))
    place = F.row_number().over(Window.partitionBy(*keys, asn).orderBy(draw, *order, *ties))
    cut = cut.withColumn("_d", place).where(F.col("_d") <= F.col("keep")).drop("_d")
    return whole.unionByName(cut).drop("c", "keep")


def trim_to_diversity(samples: DataFrame, keys: list[str], asn: str = "asn", order: list[str] | None = None, min_asn: int = 3, min_entropy: float = 0.5, seed: int = 1) -> DataFrame:
    """The samples that are kept in groups that are, or can be trimmed to be, diverse enough; with column ``trimmed``."""
    counts = samples.groupBy(*keys, asn).agg(F.count("*").alias("c"))
    plan = trim_plan(counts, keys, asn, min_asn, min_entropy)
    return trimmed_samples(samples, plan, keys, asn, order or [asn], seed=seed).drop("n_asn", "entropy")


def pearson(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; null, not an error, if a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mad_of(values: Column, center: Column) -> Column:
    """Median absolute deviation of an array of numbers around ``center``."""
    from pathwatch.functions.expand import median_of

    return median_of(F.transform(values, lambda x: F.abs(x - center)))


# Royston's polynomials (AS R94), highest power first; the last coefficient of the first two is the score's own.
END = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)
# Mean and log deviation of log(1 - W) from 12 values on, in log n.
CENTER, WIDTH = (0.0038915, -0.083751, -0.31082, -1.5861), (0.0030302, -0.082676, -0.4803)


def shapiro_wilk(x: np.ndarray) -> float:
    """p value of the Shapiro-Wilk test by Royston's approximation; NaN under four values or without spread."""
    x = np.sort(np.asarray(x, dtype=float))
    n = len(x)
    if n < 4:
        return float("nan")
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    return shapiro_of_sums(n, float(m @ (x - x.mean())), float(m @ m), float(((x - x.mean()) ** 2).sum()), x[0], x[1], x[-2], x[-1])


def _shapiro_p(w: float, n: int) -> float:
    nd = NormalDist()
    if n < 12:
        g, mu, sigma = 0.459 * n - 2.273, np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(g - math.log(1 - w)) - mu) / sigma if w < 1 else -10.0
    else:
        k = math.log(n)
        mu, sigma = np.polyval(CENTER, k), math.exp(np.polyval(WIDTH, k))
        z = (math.log(1 - w) - mu) / sigma if w < 1 else -10.0
    return 1 - nd.cdf(z)


def normal_scores(low: int, high: int, n: int) -> tuple[float, float]:
    """Sum and sum of squares of the expected normal scores of the ranks low + 1 to high of n, in bounded memory."""
    inv, s, ss = NormalDist().inv_cdf, 0.0, 0.0
    for at in range(low, high, 1 << 16):
        m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(at + 1, min(high, at + (1 << 16)) + 1)])
        s, ss = s + float(m.sum()), ss + float(m @ m)
    return s, ss


def shapiro_of_sums(n: int, mx: float, ss: float, spread: float, first: float, second: float, before: float, last: float) -> float:
    """As ``shapiro_wilk``, from sums over a sample that need not be in one place.

    mx: normal scores times values; ss: squares of the scores; spread: squared distances from the mean; then the two
    least and the two greatest values.
    """
    if n < 4 or first == last:
        return float("nan")
    inv, u = NormalDist().inv_cdf, 1 / math.sqrt(n)
    top, next_ = inv((n - 0.375) / (n + 0.25)), inv((n - 1.375) / (n + 0.25))
    an = float(np.polyval([*END, top / math.sqrt(ss)], u))
    rest = mx - top * (last - first)
    if n > 5:
        an1 = float(np.polyval([*NEXT, next_ / math.sqrt(ss)], u))
        phi = (ss - 2 * top**2 - 2 * next_**2) / (1 - 2 * an**2 - 2 * an1**2)
        ax = (rest - next_ * (before - second)) / math.sqrt(phi) + an1 * (before - second)
    else:
        ax = rest / math.sqrt((ss - 2 * top**2) / (1 - 2 * an**2))
    return _shapiro_p(min(1.0, (ax + an * (last - first)) ** 2 / spread), n)
