"""Files that hold one JSON array each, cut into records by many tasks.

A file is read as pieces that end with a closing brace, in blocks as Spark splits it. Whether a piece begins inside a
string, how deep it is and in which record follow from running sums: over the pieces within a block, and over one row a
block within a file. Records that lie within a block are put together where they are; only those cut by a block's border
are shuffled by file and record.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathwatch.session import written

BLOCK = ["file", "start"]


def _braces(quoted: Column, first: int) -> Column:
    """Opening braces outside strings, if every second part between quotes, from ``first`` on, lies outside."""
    outside = F.array_join(F.filter(quoted, lambda _, i: i % 2 == first), "")
    return F.char_length(outside) - F.char_length(F.replace(outside, F.lit("{")))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, place, piece, quotes, open0, open1) of each piece; open0 and open1: braces it opens if it begins outside or inside a string."""
    raw = spark.read.option("lineSep", "}").text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("piece"))
    # no escape ends with a brace, so none goes on over a piece's end
    parts = raw.withColumn("q", F.split(F.regexp_replace("piece", r"\\.", ""), '"', -1))
    return parts.select("*", (F.size("q") - 1).alias("quotes"), _braces(F.col("q"), 0).alias("open0"), _braces(F.col("q"), 1).alias("open1")).drop("q")


def _from_start(blocks: DataFrame, *sums: str) -> DataFrame:
    """Each column's sum over the earlier blocks of the file, and whether the block is its last."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(*BLOCK, F.lead("start").over(order).isNull().alias("final"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of each object in the files' arrays; an object that is not closed, as in a file that breaks off, is left out."""
    within = Window.partitionBy(*BLOCK).orderBy("place")
    before, upto = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    cut = written(pieces(spark, path).repartition(*BLOCK), "pieces")

    quotes = _from_start(cut.groupBy(*BLOCK).agg(F.sum("quotes").alias("quotes")), "quotes")
    inside = (F.col("quotes_before") + earlier("quotes")) % 2
    depth = cut.join(quotes, BLOCK).withColumn("inside", inside)
    # nothing closes a file's last piece: an array goes on after its last brace
    last = F.col("final") & (F.col("place") == F.max("place").over(Window.partitionBy(*BLOCK)))
    closes = (~last & ((F.col("inside") + F.col("quotes")) % 2 == 0)).cast("int")
    depth = depth.withColumn("closes", closes)
    depth = depth.select(*BLOCK, "place", "piece", (F.when(F.col("inside") == 0, F.col("open0")).otherwise(F.col("open1")) - F.col("closes")).alias("change"), "closes")

    levels = _from_start(depth.groupBy(*BLOCK).agg(F.sum("change").alias("change")), "change").drop("final")
    ends = depth.join(levels, BLOCK).withColumn("level", F.col("change_before") + F.sum("change").over(upto))
    ends = ends.withColumn("ends", ((F.col("level") == 0) & (F.col("closes") == 1)).cast("int"))
    counts = _from_start(ends.groupBy(*BLOCK).agg(F.sum("ends").alias("ends")), "ends").drop("final")
    told = ends.join(counts, BLOCK).withColumn("record", F.col("ends_before") + earlier("ends"))

    text = lambda: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "piece"))), lambda p: p["piece"]), "}")
    here = told.groupBy(*BLOCK, "record").agg(text().alias("piece"), F.min("place").alias("place"), F.max("ends").alias("ended"))
    # a record that a block begins with may have begun before it
    ranked = here.withColumn("first", F.col("place") == F.min("place").over(Window.partitionBy(*BLOCK)))
    ranked = written(ranked, "records")
    whole = ranked.where("ended = 1 AND NOT first").select("piece")
    over = ranked.where("ended = 0 OR first").groupBy("file", "record").agg(text().alias("piece"), F.max("ended").alias("ended")).where("ended = 1").select("piece")
    return whole.unionByName(over).select(F.concat(F.regexp_replace("piece", r"^[\[,\s]+", ""), F.lit("}")).alias("record"))


def read_arrays(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the files' arrays with a fixed schema; what does not fit it is null. An empty array gives no row."""
    return records(spark, path).select(F.from_json("record", schema).alias("r")).select("r.*")


def as_array(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of one JSON array from batches of records (value), for ``mapInPandas``: a frame for each batch, and the end."""
    sep = "["
    for b in batches:
        if len(b):
            lines = "," + b["value"]
            lines.iloc[0] = sep + b["value"].iloc[0]
            yield lines.to_frame()
            sep = ","
    yield pd.DataFrame({"value": ["[]" if sep == "[" else "]"]})
