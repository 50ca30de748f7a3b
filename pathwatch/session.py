"""Session helpers that every job shares: the shared work folder, written intermediate tables, code shipping."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset on one machine (tests), a temporary folder is
    made and set as the session's checkpoint folder; on a cluster that is an error, as no other machine would see it.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="pathwatch-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/pathwatch/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Cuts the lineage: after the loss of an executor only the files are read again, nothing is recomputed.
    The schema is taken from ``df`` so that an empty table can be read as well.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


#: Rows and bytes that go to Python at once; what a helper holds is a multiple of it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors' Python (once for each application), so that helpers can be imported there.

    Also bounds the batches that go to Python in this session.
    """
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already imported from an archive
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="pathwatch-code-"), "pathwatch_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
