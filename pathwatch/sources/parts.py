"""A table in parts that a manifest lists: readers see whole parts only, and small parts are merged beside them.

A part is a folder under ``data``. A row of the manifest adds one and takes others away, so a merge is one step for a
reader: it reads either the small parts or the merged one. Files of parts that were taken away stay until they are
removed by hand or by a rule of the store, for readers that began before.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "saved long, part string, instead_of array<string>"


def listed(spark: SparkSession, path: str) -> list[str]:
    """The parts that make up the table just now; the manifest has a row for each part that was ever added."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    gone = {x for r in rows for x in r["instead_of"]}
    return sorted({r["part"] for r in rows} - gone)


def add(df: DataFrame, path: str, part: str, by: list[str], instead_of: list[str] = ()) -> None:
    """Write a part (an earlier attempt at it is replaced), then list it in place of others. A part that was merged since is not listed again."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/data/part={part}")
    list_part(spark, path, part, instead_of)


def list_part(spark: SparkSession, path: str, part: str, instead_of: list[str] = ()) -> None:
    n = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").count() if listed(spark, path) else 0
    spark.createDataFrame([(n + 1, part, list(instead_of))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, schema: str, parts: list[str] | None = None) -> DataFrame:
    """The table as it is listed now (or the given parts); empty where nothing is listed. Columns of ``schema`` only."""
    parts = listed(spark, path) if parts is None else parts
    empty = spark.createDataFrame([], schema)
    if not parts:
        return empty
    return spark.read.schema(empty.schema).option("basePath", f"{path}/data").parquet(*[f"{path}/data/part={p}" for p in parts]).select(*empty.columns)


def merge(spark: SparkSession, path: str, schema: str, by: list[str], spread: list[str], files: int = 1, least: int = 2) -> str | None:
    """Merge all listed parts into one with ``files`` files for each combination of ``by`` (dealt out by the hash of ``spread``); its name.

    Nothing happens under ``least`` parts. Parts that are added meanwhile stay beside the merged one.
    """
    parts = listed(spark, path)
    if len(parts) < least:
        return None
    merged = f"merged-{uuid.uuid4().hex}"
    table = read(spark, path, schema, parts).repartition(*by, F.pmod(F.xxhash64(*spread), F.lit(files)))
    add(table, path, merged, by, parts)
    return merged
