"""Files in and tables out: traceroute archives, measurement lists, results, references, experiments."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pathwatch.schema import TRACEROUTE, Params
from pathwatch.sources import versions
from pathwatch.sources.arrays import read_arrays


def read_traceroutes(spark: SparkSession, path: str, af: int | None = None, arrays: bool = False, whole_files: bool = False) -> DataFrame:
    """Traceroutes from JSON lines (.bz2, .gz), or from files that hold one JSON array each (arrays=True), with the fixed schema.

    Files of arrays are cut into records by as many tasks as their size asks for; ``whole_files`` reads each in one task,
    which saves the shuffle where they are small.
    """
    if arrays and not whole_files:
        df = read_arrays(spark, path, TRACEROUTE)
    else:
        df = spark.read.schema(TRACEROUTE).option("multiLine", arrays).json(path)
    return df if af is None else df.where(F.col("af") == af)


def read_msm_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct measurement ids of ``"msm_id":N`` lines; other lines are ignored."""
    n = F.regexp_extract("value", r":\s*(\d+)", 1)
    return spark.read.text(path).where(n != "").select(n.cast("long").alias("msm_id")).distinct()


def select_measurements(df: DataFrame, ids: DataFrame, blacklist: tuple[int, ...] = ()) -> DataFrame:
    """Traceroutes of the given measurements, less the blacklisted ones."""
    keep = ids.select("msm_id").where(~F.col("msm_id").isin(*blacklist)) if blacklist else ids.select("msm_id")
    return df.join(keep.distinct(), "msm_id", "left_semi")


def with_day(df: DataFrame) -> DataFrame:
    return df.withColumn("date", F.to_date(F.timestamp_seconds("timestamp")))


def write_traceroutes(df: DataFrame, path: str, files_per_day: int = 16) -> None:
    """Store by address family and UTC day of the traceroute's own time; a day is spread over several files."""
    spread = F.pmod(F.xxhash64("msm_id", "prb_id", "timestamp"), F.lit(files_per_day))
    with_day(df).repartition("af", "date", spread).write.mode("append").partitionBy("af", "date").parquet(path)


def write_results(df: DataFrame, path: str, exp_id: str, ts: str = "time_bin") -> None:
    """Replace an experiment's bins in a result table; running a bin again gives the same table."""
    out = df.withColumns({"exp_id": F.lit(exp_id), "date": F.to_date(F.timestamp_seconds(ts)), "bin": F.col(ts)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("exp_id", "date", "bin").parquet(path)


def read_results(spark: SparkSession, path: str, schema: StructType, exp_id: str, since: int | None = None) -> DataFrame:
    """The rows of one experiment in a result table (``since``: of its bins from there on, others are not read); none where there is no table yet."""
    kept = StructType([*schema.fields, StructField("exp_id", StringType()), StructField("bin", LongType())])
    try:
        df = spark.read.schema(kept).parquet(path).where(F.col("exp_id") == exp_id)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return (df if since is None else df.where(F.col("bin") >= since)).select(*schema.names)


def keys_of(spark: SparkSession, schema: str) -> list[str]:
    """A reference's key: the first two columns of either kind."""
    return spark.createDataFrame([], schema).columns[:2]


def save_reference(ref: DataFrame, path: str, as_of: int, changes: bool = False) -> None:
    """A new version of a reference, whole or (``changes``) the rows that a window has changed; earlier ones stay readable."""
    versions.commit(ref, path, as_of, ref.columns[:2], whole=not changes)


def load_reference(spark: SparkSession, path: str, schema: str, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """The newest version (before a bin, if given; of the keys in ``only``, if given); an empty reference where there is none."""
    return versions.snapshot(spark, path, schema, keys_of(spark, schema), before, only)


def save_experiment(spark: SparkSession, p: Params, path: str, saved_at: int) -> None:
    """Append the parameters of a run; the latest row of an experiment counts."""
    row = {k: str(v) if v is not None else None for k, v in p.as_row().items()}
    spark.createDataFrame([(p.exp_id, p.stream, saved_at, json.dumps(row))], "exp_id string, stream boolean, saved_at long, params string").write.mode("append").parquet(path)


def load_experiment(spark: SparkSession, path: str, exp_id: str | None = None, stream: bool = False) -> Params | None:
    """Parameters by id, of the streaming experiment, or of the newest one; None where none was saved yet."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    df = df.where(F.col("exp_id") == exp_id) if exp_id else df.where("stream") if stream else df
    row = df.orderBy(F.desc("saved_at")).limit(1).collect()
    if not row:
        return None
    raw, kinds = json.loads(row[0]["params"]), Params.__dataclass_fields__
    cast = {"int": int, "float": float, "str": str, "bool": lambda s: s == "True", "str | None": str, "int | None": int}
    return Params(**{k: None if v is None else cast[kinds[k].type](v) for k, v in raw.items()})


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A JSON configuration whose start and end are {"$date": milliseconds}."""
    df = spark.read.option("multiLine", True).json(path)
    for c in ("start", "end"):
        if c in df.columns:
            df = df.withColumn(c, F.timestamp_millis(F.col(c)["$date"]))
    return df
