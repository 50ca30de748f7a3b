"""Nearest neighbours through learned partitions: a balanced cut of a neighbour graph, a classifier that routes, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pathwatch.session import ship_code, written

NEAREST = 10
#: The sample that the partitions are learned from, of one row in SHARE: its least and its greatest size. Every row is indexed.
SHARE, SAMPLE_LEAST, SAMPLE_MOST = 12, 4096, 32_768
#: Rows for each partition that are aimed at; there are as many partitions as the sample can tell apart, at most.
PER_PARTITION = 500
#: Recall that routing must reach on the sample.
AIM = 0.985
#: Rows, and queries, that meet in one task: larger partitions are split by a hash.
BLOCK, QUERY_BLOCK = 8192, 4096
HIDDEN, GRAPH_K, SLACK = 96, 12, 1.1
#: Numbers in a matrix of the learning, at most: the driver takes as many rows at once as fit, whatever the sample's size.
CELLS = 1 << 21


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves."""
    d = x[None, :, :] - q[:, None, :]
    return np.sqrt((d * d).sum(axis=2))


def nearest_of(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k nearest others; k < len(x)."""
    out = []
    sq = (x * x).sum(axis=1)
    step = max(1, min(512, CELLS // len(x)))
    for at in range(0, len(x), step):
        d = sq[None, :] - 2 * x[at : at + step] @ x.T
        d[np.arange(d.shape[0]), at + np.arange(d.shape[0])] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k].copy())  # a view would keep all of it
    return np.concatenate(out)


def balanced_cut(x: np.ndarray, graph: np.ndarray, parts: int, passes: int = 6) -> np.ndarray:
    """A partition of the graph's nodes with few cut edges and at most SLACK times the mean size.

    Starts from halving along the direction of most spread, again and again, then moves nodes to the part that holds
    most of their neighbours, while there is room.
    """
    part = np.zeros(len(x), dtype=np.int64)
    pieces = [np.arange(len(x))]
    while len(pieces) < parts:
        i = max(range(len(pieces)), key=lambda k: len(pieces[k]))
        p = pieces.pop(i)
        c = x[p] - x[p].mean(axis=0)
        v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
        for _ in range(8):  # power iteration
            v = c.T @ (c @ v)
            v /= np.linalg.norm(v) or 1
        order = p[np.argsort(c @ v, kind="stable")]
        pieces += [order[: len(p) // 2], order[len(p) // 2 :]]
    for k, p in enumerate(pieces):
        part[p] = k
    # each node's neighbours of either direction, once each
    ends = np.stack([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    pairs = np.unique(np.concatenate([ends[0] * len(x) + ends[1], ends[1] * len(x) + ends[0]]))
    both = np.split(pairs % len(x), np.searchsorted(pairs, np.arange(1, len(x)) * len(x)))
    room = int(np.ceil(SLACK * len(x) / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(passes):
        moved = 0
        for i, near in enumerate(both):
            have = np.bincount(part[near], minlength=parts)
            have[(size >= room) & (np.arange(parts) != part[i])] = -1
            to = int(have.argmax())
            if have[to] > have[part[i]]:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A classifier with one hidden layer: the probability that a vector's neighbours lie in each partition."""

    layers: list[np.ndarray]
    mean: np.ndarray
    scale: float
    probes: int = 1

    @property
    def parts(self) -> int:
        return self.layers[3].shape[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.scale @ w1 + b1, 0) @ w2 + b2

    def probes_of(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m most probable partitions of each row, best first."""
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :m]


def train(x: np.ndarray, part: np.ndarray, graph: np.ndarray, parts: int, epochs: int = 60, batch: int = 128, rate: float = 0.005, seed: int = 5) -> Router:
    """Adam on the cross entropy with each vector's partition and, by as much, the distribution of its neighbours over the partitions."""
    g = np.random.default_rng(seed)
    d, k = x.shape[1], graph.shape[1]
    p = [g.normal(size=(d, HIDDEN)) / np.sqrt(d), np.zeros(HIDDEN), g.normal(size=(HIDDEN, parts)) / np.sqrt(HIDDEN), np.zeros(parts)]
    r = Router(p, x.mean(axis=0), float(x.std()) or 1.0)
    z = (x - r.mean) / r.scale
    a, s, t = [np.zeros_like(v) for v in p], [np.zeros_like(v) for v in p], 0
    for _ in range(epochs):
        order = g.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            h = np.maximum(z[i] @ p[0] + p[1], 0)
            q = h @ p[2] + p[3]
            q = np.exp(q - q.max(axis=1, keepdims=True))
            target = np.zeros((len(i), parts))
            np.add.at(target, (np.repeat(np.arange(len(i)), k), part[graph[i]].ravel()), 0.5 / k)
            target[np.arange(len(i)), part[i]] += 0.5
            e = (q / q.sum(axis=1, keepdims=True) - target) / len(i)
            eh = (e @ p[2].T) * (h > 0)
            t += 1
            for v, gr, m1, m2 in zip(p, [z[i].T @ eh, eh.sum(axis=0), h.T @ e, e.sum(axis=0)], a, s):
                m1 += 0.1 * (gr - m1)
                m2 += 0.001 * (gr * gr - m2)
                v -= rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return r


def learn(x: np.ndarray, n_rows: int) -> Router:
    """Partitions and router from a sample; the number of probes is the least that reaches AIM on it."""
    # copies of one vector say nothing about neighbourhoods
    x = np.unique(x, axis=0)
    parts = int(min(max(1, n_rows // PER_PARTITION), max(1, len(x) // (4 * GRAPH_K))))
    if parts < 2:
        d = x.shape[1]
        return Router([np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)], np.zeros(d), 1.0)
    graph = nearest_of(x, GRAPH_K)
    part = balanced_cut(x, graph, parts)
    router = train(x, part, graph, parts)
    step = max(1, CELLS // parts)
    home = np.concatenate([router.probes_of(x[at : at + step], 1)[:, 0] for at in range(0, len(x), step)])
    seen = []
    for at in range(0, len(x), step):
        order = router.probes_of(x[at : at + step], parts)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
        seen.append(np.take_along_axis(rank, home[graph[at : at + step, :NEAREST]], axis=1))
    seen = np.concatenate(seen)
    recall = [(seen < m).mean() for m in range(1, parts + 1)]
    router.probes = int(np.argmax(np.array(recall) >= AIM)) + 1
    return router


def usable(embedding: Column) -> Column:
    """Neither null, empty or zero, and all components finite numbers."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda v: v != 0)


def _best(k: int):
    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if q.empty or c.empty:
            return none
        c = c.sort_values("vec_id", kind="stable")
        x = np.stack(c["v"].to_numpy()).astype(np.float64)
        # an id with several vectors is one candidate with the nearest of them
        ids, first = np.unique(c["vec_id"].to_numpy(), return_index=True)
        y, own = np.stack(q["v"].to_numpy()).astype(np.float64), q["query_id"].to_numpy()
        out = []
        step = max(1, (1 << 22) // x.size)
        for at in range(0, len(y), step):
            d = np.minimum.reduceat(distances(y[at : at + step], x), first, axis=1)
            for i, row in enumerate(d):
                row[ids == own[at + i]] = np.inf
                near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
                near = near[np.lexsort((ids[near], row[near]))][:k]
                near = near[np.isfinite(row[near])]
                out.append(pd.DataFrame({"query_id": own[at + i], "vec_id": ids[near], "score": row[near]}))
        return pd.concat(out) if out else none

    return run


def search(table: DataFrame, is_query: Column, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of ``table`` that ``is_query`` selects.

    Every usable row is indexed under its most probable partition; a query looks into as many partitions as reached the
    aimed recall on the sample, in blocks of rows and queries, and reranks exactly. A query that finds fewer than k
    there (small or empty partitions) is searched in all partitions, so it gets all candidates if there are fewer
    than k. Rows with a null id, and vectors that are null, empty, zero, not finite or not of the table's most frequent
    length, take no part; ids that occur twice are one candidate with its nearest vector; ties go to the smaller id.
    """
    spark = table.sparkSession
    ship_code(spark)
    rows = table.where(F.col(vec_id).isNotNull() & usable(F.col(embedding))).select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("nq")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not lengths:
        return rows.limit(0).select(F.col("vec_id").cast("long").alias("query_id"), F.lit(0).alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), F.lit(0.0).alias("score"))
    d, n, _ = lengths[0]
    # repeated rows are one candidate before anything is counted, drawn or indexed
    rows = rows.where(F.size("v") == d).groupBy("vec_id", "v").agg(F.max("q").alias("q"))
    size = min(SAMPLE_MOST, max(SAMPLE_LEAST, n // SHARE))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < 2_000_000 * size / n).select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size)
    # as flat numbers, without an object for each
    flat = [c.flatten().to_numpy() for c in drawn.select("v").toArrow().column("v").chunks]
    router = learn(np.concatenate([np.empty(0), *flat]).reshape(-1, d), n)
    sent = spark.sparkContext.broadcast(router)

    def routed(m: int):
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(list(sent.value.probes_of(np.stack(b.to_numpy()), m).astype(np.int32)) if len(b) else [])

        return pandas_udf(run, "array<int>")

    index = written(rows.select("vec_id", "v", "q", routed(router.probes)("v").alias("probes")), "index")
    # one row for each partition, of which there are SAMPLE_MOST / (4 * GRAPH_K) at most
    sizes = {r["part"]: r["n"] for r in index.groupBy(F.col("probes")[0].alias("part")).agg(F.count("*").alias("n")).collect()}
    each = lambda counts, block: F.create_map(*[F.lit(x) for p in range(router.parts) for x in (p, max(1, -(-counts.get(p, 0) // block)))])
    splits = each(sizes, BLOCK)
    block = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    candidates = index.select("vec_id", "v", F.col("probes")[0].alias("part")).withColumn("split", block("vec_id", splits[F.col("part")]))

    def look(queries: DataFrame, parts: Column) -> DataFrame:
        """The best of each block for each query. Only partitions that more than a block of queries asks for are sent more than once."""
        asked = queries.select(F.col("vec_id").alias("query_id"), "v", F.explode(parts).alias("part"))
        q_splits = each({r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}, QUERY_BLOCK)
        asked = asked.withColumn("q_split", block("query_id", q_splits[F.col("part")])).withColumn("split", F.explode(F.sequence(F.lit(0), splits[F.col("part")] - 1)))
        sent_to = candidates.withColumn("q_split", F.explode(F.sequence(F.lit(0), q_splits[F.col("part")] - 1)))
        keys = ["part", "split", "q_split"]
        return asked.groupBy(*keys).cogroup(sent_to.groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, score double")

    queries = index.where("q")
    found = written(look(queries, F.col("probes")), "found")
    enough = found.groupBy("query_id").agg(F.countDistinct("vec_id").alias("n")).where(F.col("n") >= min(k, max(0, n - 1)))
    short = queries.join(enough.select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
    if router.probes < router.parts and not short.isEmpty():
        found = found.unionByName(look(short, F.array(*map(F.lit, range(router.parts)))))
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(table, F.col("vec_id") % 100 == 0)
