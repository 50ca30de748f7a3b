"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks, exact similarity.

Built-in functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathwatch.session import written

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Differing fingerprint bits up to which a pair is verified. At a similarity of 0.8 the mean is 10 of 64 and the
#: standard deviation 3, so this is beyond four standard deviations. One block more than bits guarantees a common one.
RADIUS = 23
#: Shingles of the benchmark up to which they are broadcast (24 bytes each); beyond it Spark shuffles both sides.
BROADCAST = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space."""
    return F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles(w: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` words, in order, repeats included; none for a shorter text.

    ``w`` must be a column of the table: an expression would be evaluated again for every run.
    """
    joined = lambda i: F.xxhash64(F.lit(width), *[F.get(w, i + k) for k in range(width)])
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), joined)).otherwise(F.array().cast("array<bigint>"))


def simhash(h: Column) -> Column:
    """Fingerprint of an array of hashes: bit b is set if it is in more than half of them."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.size(F.filter(h, lambda x: F.getbit(x, b) == 1)) * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def blocks(fp: Column, radius: int = RADIUS) -> Column:
    """array<struct<block,value>>: the fingerprint in radius + 1 pieces; two within the radius agree on one at least."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of hashes, each weighted by its number of occurrences."""
    count = lambda of, x: F.size(F.filter(of, lambda y: y == x))
    once = lambda of: F.size(F.array_distinct(of)) == F.size(of)
    repeats = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))
    common = F.when(once(a) | once(b), F.size(F.array_intersect(a, b))).otherwise(repeats)
    return common / (F.size(a) + F.size(b) - common)


def _starts(least: float) -> Column:
    """Where the windows begin that can be an item's best one with a similarity of ``least`` at least.

    From columns p (sorted places in the text of the item's shingles), n and m (shingles of text and item) and size (of
    a window). Such a window has ``enough`` of these places. If its first shingle is none of them, the window one further
    on has no fewer common shingles, so only windows that begin at one, and the text's last window, need be looked at.
    """
    enough = F.greatest(F.lit(1), F.ceil(F.lit(least) * (F.col("size") + F.col("m")) / (1 + least) - 1e-9).cast("int"))
    last, there = F.col("n") - F.col("size"), F.size("p")
    full = F.filter("p", lambda x, i: (x <= last) & (F.coalesce(F.get("p", i + enough - 1), F.col("n") + F.col("size")) < x + F.col("size")))
    at_end = F.get("p", there - enough) >= last
    return F.when(there >= enough, F.array_distinct(F.concat(full, F.when(at_end, F.array(last)).otherwise(F.array().cast("array<int>"))))).otherwise(F.array().cast("array<int>"))


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity) for every row of ``docs`` and item whose best window reaches ``least``.

    A window is a run of as many words as the item has (the whole text, if that is shorter), anywhere in the text and
    with the shingles in any order. Items of fewer words than a shingle are one shingle. Texts with one of an item's
    rarest shingles (see ``_rarest``) are looked at; their windows with enough shingles of that item (see ``_starts``)
    are fingerprinted, joined by item and block with its fingerprint, kept within the radius, and verified exactly.

    Texts are looked at by content, so copies are examined once and ids may be null or repeated (each row of ``docs``
    gets its rows). Null, empty and blank texts have none; other columns are not read; empty tables give none.
    """
    best, key = _leaks(docs, items, text, least, radius), F.xxhash64(F.col(text))
    if best is None:
        item = F.lit(None).cast(items.schema["item_id"].dataType)
        return docs.select(F.col(doc_id).alias("doc_id"), item.alias("item_id"), F.lit(0.0).alias("similarity")).where(F.lit(False))
    return docs.select(F.col(doc_id).alias("doc_id"), key.alias("key")).join(best, "key").select("doc_id", "item_id", "similarity")


def _rarest(known: DataFrame, least: float) -> DataFrame:
    """(width, h, item): of each item the shingles that fewest items have, so many that a window cannot do without all of them.

    A window with a similarity of ``least`` has at least ``least`` times the item's shingles in common with it; so with
    one shingle more than the others are, one of them is in the window. A phrase that many items share is left to
    the rarer ones beside it.
    """
    each = known.select("item", "width", F.size("sh").alias("m"), F.explode("sh").alias("h")).groupBy("item", "width", "m", "h").agg(F.count("*").alias("c"))
    shared = each.groupBy("width", "h").agg(F.count("*").alias("items"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("item").orderBy("items", "h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = each.join(shared, ["width", "h"]).withColumn("before", before)
    return ranked.where(F.col("before") <= F.col("m") - F.ceil(least * F.col("m") - 1e-9)).select("width", "h", "item")


def _leaks(docs: DataFrame, items: DataFrame, text: str, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame | None:
    """(key, item_id, similarity) for every text, by its hash, and item; None if there are no items."""
    w = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(SHINGLE_WORDS))
    known = w.select("item_id", F.xxhash64("item_id", "w").alias("item"), width.alias("width"), reduce(
        lambda rest, k: F.when(F.size("w") == k, shingles(F.col("w"), k)).otherwise(rest), range(1, SHINGLE_WORDS), shingles(F.col("w"), SHINGLE_WORDS)).alias("sh"))
    # repeated items are one
    known = written(known.dropDuplicates(["item"]).withColumn("fp", simhash(F.col("sh"))), "items")
    rare = written(_rarest(known, least), "rare")
    # at most SHINGLE_WORDS rows
    sizes = {r["width"]: r["n"] for r in rare.groupBy("width").agg(F.count("*").alias("n")).collect()}
    key = F.xxhash64(F.col(text))
    body = docs.where(F.col(text).isNotNull())
    found = []
    for k, n in sorted(sizes.items()):
        own = rare.where(F.col("width") == k)
        at = body.select(key.alias("key"), words(F.col(text)).alias("w")).select("key", shingles(F.col("w"), k).alias("sh")).select("key", F.explode_outer("sh").alias("h"))  # outer: else an inferred filter makes the shingles once more
        found.append(at.join(F.broadcast(own) if n <= BROADCAST else own, "h").select("key", "width", "item").distinct())
    if not found:
        return None
    pairs = written(reduce(DataFrame.union, found), "text_items")
    texts = written(body.select(key.alias("key"), F.col(text).alias("body")).join(pairs.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("body").alias("body")), "texts")
    found = []
    for k in sorted(sizes):
        at = texts.select("key", words(F.col("body")).alias("w")).select("key", shingles(F.col("w"), k).alias("sh")).select("key", F.size("sh").alias("n"), F.posexplode_outer("sh").alias("pos", "h"))
        # each text meets the shingles of its own items only, dealt out by text and shingle
        own = pairs.where(F.col("width") == k).join(known.select("item", F.size("sh").alias("m"), F.explode(F.array_distinct("sh")).alias("h")), "item")
        spots = at.join(own.drop("width"), ["key", "h"]).groupBy("key", "item", "m", "n").agg(F.sort_array(F.collect_set("pos")).alias("p")).withColumn("size", F.least("m", "n"))
        found.append(spots.select("key", F.lit(k).alias("width"), "item", "m", F.explode(_starts(least)).alias("start")))
    windows = written(reduce(DataFrame.union, found), "windows")
    cut = []
    for k in sorted(sizes):
        sh = texts.select("key", words(F.col("body")).alias("w")).select("key", shingles(F.col("w"), k).alias("sh"))
        cut.append(windows.where(F.col("width") == k).join(sh, "key").select("key", "item", "start", F.slice("sh", F.col("start") + 1, F.col("m")).alias("sh")))
    prints = written(reduce(DataFrame.union, cut).withColumn("fp", simhash(F.col("sh"))), "window_prints")
    left = prints.select("key", "item", "start", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b"))
    right = known.select("item", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("b"))
    near = left.join(right, ["item", "b"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("key", "item", "start").distinct()
    scored = near.join(prints.drop("fp"), ["key", "item", "start"]).join(known.select("item", "item_id", F.col("sh").alias("item_sh")), "item").select(
        "key", "item_id", similarity(F.col("sh"), F.col("item_sh")).alias("similarity")).where(F.col("similarity") >= least)
    return written(scored.groupBy("key", "item_id").agg(F.max("similarity").alias("similarity")), "leaks")


def without_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark passage, whatever their id; all columns stay."""
    best = _leaks(docs, items, text)
    if best is None:
        return docs
    # all of a row's columns in one, so that no name can clash
    packed = docs.select(F.struct(*docs.columns).alias("all"), F.when(F.col(text).isNotNull(), F.xxhash64(F.col(text))).alias("key"))
    return packed.join(best.select("key").distinct(), "key", "left_anti").select("all.*")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item that it holds."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP10_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM benchmark),
it AS (SELECT item_id, len(w) AS n, least(len(w), 5) AS k, w FROM items WHERE len(w) > 0),
ish AS (SELECT item_id, n, k, list_transform(range(1, n - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')) AS sh FROM it),
iu AS (SELECT item_id, n, k, unnest(sh) AS s, generate_subscripts(sh, 1) AS off FROM ish),
ds AS (SELECT doc_id, ks.k, list_transform(range(1, len(w) - ks.k + 2), lambda i: array_to_string(w[i:i + ks.k - 1], ' ')) AS sh
       FROM docs, (SELECT DISTINCT k FROM it) ks WHERE len(w) >= ks.k),
du AS (SELECT doc_id, k, len(sh) AS m, unnest(sh) AS s, generate_subscripts(sh, 1) AS pos FROM ds),
win AS (SELECT DISTINCT du.doc_id, iu.item_id, iu.n, iu.k, greatest(0, least(pos - off, m - (iu.n - iu.k + 1))) AS start FROM du JOIN iu ON du.s = iu.s AND du.k = iu.k),
wsh AS (SELECT win.doc_id, win.item_id, start, sh[start + 1:start + n - win.k + 1] AS a FROM win JOIN ds ON win.doc_id = ds.doc_id AND win.k = ds.k),
ac AS (SELECT doc_id, item_id, start, s, count(*) AS c FROM (SELECT doc_id, item_id, start, unnest(a) AS s FROM wsh) GROUP BY ALL),
bc AS (SELECT item_id, s, count(*) AS c FROM iu GROUP BY ALL),
common AS (SELECT ac.doc_id, ac.item_id, ac.start, sum(least(ac.c, bc.c)) AS c FROM ac JOIN bc ON ac.item_id = bc.item_id AND ac.s = bc.s GROUP BY ALL),
sims AS (SELECT wsh.doc_id, wsh.item_id, c / (len(a) + len(sh) - c) AS similarity
         FROM common JOIN wsh ON common.doc_id = wsh.doc_id AND common.item_id = wsh.item_id AND common.start = wsh.start JOIN ish ON ish.item_id = wsh.item_id)
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity FROM sims WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
