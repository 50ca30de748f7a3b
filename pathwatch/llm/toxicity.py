"""Toxicity grades by cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pathwatch.session import ship_code, written

#: Bound of the training sample: labelled documents of each class (about; never more than twice as many).
PER_CLASS = 3000
#: Features: the most telling ones of the sample, the z score from which one is telling, and the share of a class's rows that hold it at least.
VOCABULARY, LEAST_Z, LEAST_SHARE = 1024, 3.0, 0.03
#: 0 not toxic; toxic texts are 1 or, if a model fitted without them finds them worse than the median toxic text, 2.
GRADES = 3
#: Parts of the sample, each of which is graded by a model of the others.
FOLDS = 3
THRESHOLD = 0.5

_word = re.compile(r"[^\W\d_]+")


#: Besides whole words their beginnings of these lengths are features: inflected and compound words share them.
PREFIXES = (4, 5, 6)
#: Words whose features a task keeps.
KEPT = 1 << 19


def words(text: str | None) -> list[str]:
    return _word.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings, marked by a hyphen."""
    return [word, *[word[:k] + "-" for k in PREFIXES if len(word) > k]]


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(w.x - cut[k]) with one weight vector for all cuts; cuts ascend."""

    weights: dict[str, float]
    cuts: np.ndarray

    def score(self, text: str | None) -> float:
        known, found = self.__dict__.setdefault("known", {}), []
        for w in words(text):
            f = known.get(w)
            if f is None:
                if len(known) >= KEPT:
                    known.clear()
                f = known[w] = tuple(k for k in features(w) if k in self.weights)
            if f:
                found.extend(f)
        return sum(self.weights[k] * math.log1p(n) for k, n in Counter(found).items())

    def above(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, shape (n, GRADES - 1)."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - scores[:, None], -40, 40)))


def train(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, weight: np.ndarray, n_words: int, grades: int = GRADES, steps: int = 600, rate: float = 0.1, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts that maximize the weighted likelihood of the grades (Adam, full batches, sparse features)."""
    n = len(y)
    p = np.zeros(n_words + grades - 1)
    p[n_words:] = [2.0] + [0.0] * (grades - 2)  # the first cut, then the logarithms of the gaps
    a, s = np.zeros_like(p), np.zeros_like(p)
    weight = weight / weight.sum()
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        w = p[:n_words]
        cuts = p[n_words] + np.concatenate([[0], np.cumsum(np.exp(p[n_words + 1 :]))])
        score = np.bincount(row, w[col] * value, minlength=n)
        # P(grade <= k), with the ends
        below = np.concatenate([np.zeros((n, 1)), sig(cuts[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        upper, lower = below[np.arange(n), y + 1], below[np.arange(n), y]
        prob = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        d_score = weight * (du - dl) / prob
        d_cut = np.zeros(grades - 1)
        for k in range(grades - 1):
            d_cut[k] = (weight * ((y == k + 1) * dl - (y == k) * du) / prob).sum()
        gap = np.exp(p[n_words + 1 :])
        g = np.concatenate([np.bincount(col, d_score[row] * value, minlength=n_words) + l2 * w, [d_cut.sum()], [d_cut[k + 1 :].sum() * gap[k] for k in range(grades - 2)]])
        a += 0.1 * (g - a)
        s += 0.001 * (g * g - s)
        p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return p[:n_words], p[n_words] + np.concatenate([[0], np.cumsum(np.exp(p[n_words + 1 :]))])


def upper_grade(row: np.ndarray, col: np.ndarray, value: np.ndarray, toxic: np.ndarray, weight: np.ndarray, fold: np.ndarray, n_words: int) -> np.ndarray:
    """Which toxic rows a binary model of the other folds scores above the median of their fold's toxic rows."""
    upper = np.zeros(len(toxic), dtype=bool)
    for k in range(FOLDS):
        own, rest = fold == k, fold != k
        if len(set(toxic[rest])) < 2 or not toxic[own].any():
            continue
        taken = rest[row]
        at = np.cumsum(rest) - 1
        w, _ = train(at[row[taken]], col[taken], value[taken], toxic[rest].astype(int), weight[rest], n_words, grades=2, steps=200)
        score = np.bincount(row, w[col] * value, minlength=len(toxic))
        upper |= own & toxic & (score > np.median(score[own & toxic]))
    return upper


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Ordinal | None:
    """The model of a bounded sample of labelled rows (see PER_CLASS), drawn by a hash of the id.

    The sample's rows are weighted back to the classes' shares. Features and word statistics are made on Spark; the
    driver gets at most VOCABULARY words and, for each sampled row, its counts of these. None if a class is missing.
    """
    spark = docs.sparkSession
    ship_code(spark)
    known = labels.select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("y")).where("_id IS NOT NULL AND y IS NOT NULL").distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    if 0 not in sizes or len(sizes) < 2:
        return None
    share = F.coalesce(*[F.when(F.col("y") == k, F.lit(PER_CLASS / n)) for k, n in sizes.items()])
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share * 1_000_000).orderBy(F.xxhash64("_id"), "_id", "y").limit(4 * PER_CLASS)
    as_words = pandas_udf(lambda t: t.map(lambda x: words(x), na_action=None), "array<string>")
    # repeated ids are one row of the sample
    once = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id").groupBy("_id", "y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    sample = written(once.select("_id", "y", as_words("_text").alias("w")), "sample")
    n = {r["t"]: r["n"] for r in sample.groupBy((F.col("y") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    distinct = pandas_udf(lambda s: s.map(lambda x: sorted({f for w in x for f in features(w)})), "array<string>")
    seen = sample.select((F.col("y") > 0).alias("t"), F.explode(distinct("w")).alias("word")).groupBy("word").agg(F.count_if("t").alias("yes"), F.count_if(~F.col("t")).alias("no"))
    odds = F.log((F.col("yes") + 0.5) / (n[True] - F.col("yes") + 0.5)) - F.log((F.col("no") + 0.5) / (n[False] - F.col("no") + 0.5))
    z = odds / F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    common = (F.col("yes") >= LEAST_SHARE * n[True]) | (F.col("no") >= LEAST_SHARE * n[False])
    best = seen.withColumn("odds", odds).withColumn("z", F.abs(z)).where(common & (F.col("z") >= LEAST_Z)).orderBy(F.desc(F.col("z") * F.abs("odds")), "word").limit(VOCABULARY).collect()
    telling = [r["word"] for r in best]
    if not telling:
        return None
    at = {w: i for i, w in enumerate(telling)}
    sent = spark.sparkContext.broadcast(at)
    counts = pandas_udf(lambda s: s.map(lambda x: Counter(sent.value[k] for w in x for k in features(w) if k in sent.value)), "map<int,int>")
    rows = sample.select("_id", "y", counts("w").alias("c")).collect()
    rows.sort(key=lambda r: (r["_id"], r["y"]))
    flat = np.array([(i, k, c) for i, r in enumerate(rows) for k, c in sorted(r["c"].items())], dtype=np.int64).reshape(-1, 3)
    y = np.array([r["y"] for r in rows])
    have = np.bincount(y, minlength=2)
    weight = np.array([sizes.get(k, 0) / max(1, have[k]) for k in range(2)])[y]
    fold = np.array([zlib.crc32(str(r["_id"]).encode()) % FOLDS for r in rows])
    value = np.log1p(flat[:, 2])
    y = y + upper_grade(flat[:, 0], flat[:, 1], value, y == 1, weight, fold, len(telling))
    w, cuts = train(flat[:, 0], flat[:, 1], value, y, weight, len(telling))
    return Ordinal(dict(zip(telling, w.tolist())), cuts)


def severity(docs: DataFrame, model: Ordinal | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, toxic) for every row of ``docs``.

    severity: the expected grade, the sum of P(grade > k). grade: the largest k with P(grade >= k) of at least
    THRESHOLD; toxic: grade above 0. Null texts count as empty; null ids and repeated rows are kept; other columns are
    not read; an empty table gives none; without a model all is 0.
    """
    spark = docs.sparkSession
    ship_code(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for b in batches:
            p = np.zeros((len(b), GRADES - 1)) if m is None else m.above(np.array([m.score(x) for x in b]))
            yield pd.DataFrame({"severity": p.sum(axis=1), "grade": (p >= THRESHOLD).sum(axis=1).astype(np.int32), "p_toxic": p[:, 0]})

    out = pandas_udf(run, "severity double, grade int, p_toxic double")(F.coalesce(F.col(text), F.lit("")))
    return docs.select(F.col(doc_id).alias("doc_id"), out.alias("o")).select("doc_id", "o.*", (F.col("o.grade") > 0).alias("toxic"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return severity(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
