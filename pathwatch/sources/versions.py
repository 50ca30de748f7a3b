"""A keyed table in versions: the keys that changed in each window, put together now and then.

Data lie under ``data/version=<id>/bucket=<n>``; a row of the ``manifest`` makes a version visible, so a reader sees all of
it or nothing. A version that is committed again, or before later ones, takes their place: the later ones rest on
something that is no more.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "as_of long, whole boolean, version string, saved long"
#: Versions of changes after which a whole one is written.
EVERY = 24
#: Files of a version at least, by the hash of the key.
BUCKETS = 16
_ABOUT = "_as_of long, _gone boolean, bucket int, version string"


def _manifest(spark: SparkSession, path: str) -> list:
    """The manifest's rows in the order in which they were saved: one for each window that was ever analysed."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(rows, key=lambda r: r["saved"])


def valid_versions(rows: list, before: int | None = None) -> list:
    """The versions that make up the table (before ``before``): the last whole one and the changes after it, oldest first."""
    kept: list = []
    for r in rows:
        kept = [k for k in kept if k["as_of"] < r["as_of"]] + [r]
    kept = [k for k in kept if before is None or k["as_of"] < before]
    start = max((i for i, k in enumerate(kept) if k["whole"]), default=0)
    return kept[start:]


def bucket_of(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def commit(changes: DataFrame, path: str, as_of: int, keys: list[str], gone: DataFrame | None = None, whole: bool = False, buckets: int = BUCKETS) -> None:
    """Add a version: the rows of changed keys, and the keys that are ``gone``. What is written grows with these alone.

    whole: ``changes`` are the whole table, and no earlier version is needed any more.
    """
    spark, version = changes.sparkSession, uuid.uuid4().hex
    out = changes.withColumn("_gone", F.lit(False))
    if gone is not None:
        out = out.unionByName(gone.select(*keys).withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    out = out.withColumns({"_as_of": F.lit(as_of).cast("long"), "bucket": bucket_of(keys, buckets)})
    out.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/version={version}")
    saved = max((r["saved"] for r in _manifest(spark, path)), default=0) + 1
    spark.createDataFrame([(as_of, whole, version, saved)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def snapshot(spark: SparkSession, path: str, schema: str, keys: list[str], before: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """The table as of its newest version, or of the newest one before a window; empty where there is none.

    ``only``: a table of keys; rows of other keys are dropped before anything is shuffled.
    """
    versions = valid_versions(_manifest(spark, path), before)
    empty = spark.createDataFrame([], schema)
    if not versions:
        return empty
    fields = StructType([*empty.schema.fields, *spark.createDataFrame([], _ABOUT).schema.fields])
    rows = spark.read.schema(fields).option("basePath", f"{path}/data").parquet(*[f"{path}/data/version={v['version']}" for v in versions])
    if only is not None:
        rows = rows.join(only.select(*keys).distinct(), keys, "left_semi")
    if len(versions) > 1:
        # the newest row of each key, with partial aggregation
        rest = [c for c in empty.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest, "_gone"), "_as_of").alias("_r")).select(*keys, "_r.*")
    return rows.where(~F.col("_gone")).select(*empty.columns)


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], every: int = EVERY, keep: Column | None = None) -> bool:
    """Write the table whole if it is made of more than ``every`` versions; ``keep``: a condition on the rows that stay."""
    versions = valid_versions(_manifest(spark, path))
    if len(versions) <= every:
        return False
    table = snapshot(spark, path, schema, keys)
    commit(table if keep is None else table.where(keep), path, versions[-1]["as_of"], keys, whole=True)
    return True
