"""Clusters of vectors around centroids: plain Lloyd rounds over exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwatch.session import ship_code, written

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, 2
#: Components are held within this, so that the squared distance of 64 of them fits into a long.
LIMIT = 1 << 27
#: Vectors compared at once; the differences to one centroid take some 2 MB.
STEP = 4096


def whole_vectors(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, q): the vectors of ``size`` components, none null or non-finite, with each component x as floor(scale * x)."""
    own = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    good = (F.size("v") == size) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    clip = lambda x: F.greatest(F.least(x, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return own.where(good).select("vec_id", F.transform("v", lambda x: F.floor(clip(x * scale)).cast("int")).alias("q"))


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row and the squared distance; ties go to the lowest number."""
    far = np.empty((len(q), len(centroids)), dtype=np.int64)
    for k, c in enumerate(centroids):
        d = q - c
        far[:, k] = (d * d).sum(axis=1)
    best = far.argmin(axis=1)
    return best, far[np.arange(len(q)), best]


def _blocks(q: pd.Series) -> Iterator[np.ndarray]:
    for at in range(0, len(q), STEP):
        yield np.stack(q.iloc[at : at + STEP].to_numpy()).astype(np.int64)


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors with the smallest hashes of their ids, in that order; null ids come last, ties go by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(digest.alias("h"), "q").orderBy(F.asc_nulls_last("h"), "q").limit(clusters).collect()
    return np.array([r["q"] for r in rows], dtype=np.int64)


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of the vectors nearest to each; an empty one stays.

    A task sums its own vectors, so a partition sends one row for each of its clusters. The merged sums (at most
    clusters times components) come to the driver.
    """
    known = kept.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = known.value
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for b in batches:
            for q in _blocks(b["q"]):
                best, _ = nearest(q, c)
                n += np.bincount(best, minlength=len(c))
                for k in np.unique(best):
                    s[k] += q[best == k].sum(axis=0)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "s": list(s[some])})

    parts = kept.select("q").mapInPandas(sums, "cluster int, n long, s array<long>")
    whole = parts.select("cluster", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in whole.collect():
        out[r["cluster"], r["pos"]] = r["x"] // r["n"]
    return out


def cluster(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) for every whole vector, and the final centroids.

    Vectors that are null, of another length, or hold a null or non-finite component take no part. Repeated rows count
    as often as they occur; null ids are kept and are the last to become centroids; fewer vectors than clusters give
    fewer centroids; other columns are not read; an empty table gives none. Components beyond 2^27 after scaling are
    held at that, so that a distance always fits.
    """
    ship_code(vectors.sparkSession)
    kept = written(whole_vectors(vectors, vector, vec_id, size, scale), "vectors")
    centroids = first_centroids(kept, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(kept, centroids)
    known = kept.sparkSession.sparkContext.broadcast(centroids)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for q in _blocks(b["q"]):
                best, far = nearest(q, known.value)
                yield pd.DataFrame({"id": b["id"].iloc[at : at + len(q)].to_numpy(), "cluster": best.astype(np.int32), "distance": far})
                at += len(q)

    # ids go as text: pandas would turn longs beside a null into floats
    out = kept.select(F.col("vec_id").cast("string").alias("id"), "q").mapInPandas(assigned, "id string, cluster int, distance long")
    return out.select(F.col("id").cast(kept.schema["vec_id"].dataType).alias("vec_id"), "cluster", "distance"), centroids


def report(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256); see ``cluster``.

    Inertias are null where they don't fit into a long.
    """
    found, centroids = cluster(vectors, **how)
    own = written(found, "clusters")
    digests = [(k, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for k, c in enumerate(centroids)]
    names = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = own.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))  # a row for each cluster
    total = own.agg(F.try_sum("distance").alias("inertia"))  # one row
    about = per.join(names, "cluster").crossJoin(F.broadcast(total))
    return own.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every whole vector."""
    return report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in SQL, a component a row."""
    near = lambda c: f"SELECT r, arg_min(k, (d, k)) AS k, min(d)::BIGINT AS d FROM (SELECT r, k, sum((x - y) * (x - y)) AS d FROM vl JOIN {c} USING (pos) GROUP BY r, k) GROUP BY r"
    rounds = ""
    for i in range(ROUNDS):
        rounds += f""", a{i} AS MATERIALIZED ({near(f'c{i}')}), s{i} AS (SELECT k, pos, sum(x) AS s, count(*) AS n FROM a{i} JOIN vl USING (r) GROUP BY k, pos),
    c{i + 1} AS MATERIALIZED (SELECT c{i}.k, c{i}.pos, CASE WHEN n IS NULL THEN y ELSE ((s - ((s % n + n) % n)) // n)::BIGINT END AS y FROM c{i} LEFT JOIN s{i} ON c{i}.k = s{i}.k AND c{i}.pos = s{i}.pos)"""
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS q
      FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE}),
    vl AS MATERIALIZED (SELECT r, generate_subscripts(q, 1) AS pos, unnest(q) AS x FROM v),
    f AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, q) - 1 AS k, q FROM v),
    c0 AS MATERIALIZED (SELECT k, generate_subscripts(q, 1) AS pos, unnest(q) AS y FROM f WHERE k < {CLUSTERS}){rounds},
    a AS MATERIALIZED ({near(f'c{ROUNDS}')}), h AS (SELECT k, sha256(string_agg(y::VARCHAR, ',' ORDER BY pos)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k)
    SELECT vec_id, a.k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a JOIN v USING (r) JOIN h USING (k)"""


OP12_SQL = _sql()
