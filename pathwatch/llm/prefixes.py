"""Prefix trie of conversations: digest-keyed parent edges, rolled up by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathwatch.session import ship_code, written

GROUP, HEADS = 20, 4
#: Turns that one window sees; a longer conversation is cut into pieces of it.
PIECE = 1 << 14
#: Ids in one piece of text on the way to a node's digest.
CHUNK = 4096
NODE, PARENT = ["p1", "p2"], ["q1", "q2"]
WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, digest, words): a turn's role and text as 128 bits of SHA-256, and the number of words. No text is shuffled."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # the role's length keeps role and text apart
    digest = F.sha2(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t), 256)
    return conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"), F.unhex(F.substring(digest, 1, 32)).alias("digest"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv, i, digest, words): turns numbered from 0 by turn, null first; equal turn numbers by digest.

    Rows are dealt out by ranges of that order, so that a conversation of very many turns is in no single task; what
    lies before a range is a sum over its conversation's ranges. The ranges are written, as they would not be the same
    if made again; the partition as last part of the order splits even rows that are all alike.
    """
    ranged = turns.withColumn("salt", F.spark_partition_id()).repartitionByRange("conv", "turn", "digest", "salt")
    placed = written(ranged.drop("salt").withColumn("part", F.spark_partition_id()), "turns")
    here = F.row_number().over(Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "digest"))
    upto = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("conv", "part").agg(F.count("*").alias("n")).select("conv", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    return placed.withColumn("here", here).join(counts, ["conv", "part"]).select("conv", (F.col("here") - 1 + F.col("before")).alias("i"), "digest", "words")


def rebuilt(own: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv, depth, digest, words) of the rebuilt conversations, and (conv, length) of all of them, turnless ones too.

    A conversation c begins with the first h turns of conversation c - c % group, then come its own after its first h;
    h is the CRC-32 of c in decimal modulo ``heads``. A head has fewer than ``heads`` turns, and serves ``group``
    conversations at most.
    """
    n = written(own.groupBy("conv").agg(F.count("*").alias("n")), "lengths")
    of = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % heads
    plan = n.select("conv", "n", of("conv").alias("h"), (F.col("conv") - F.col("conv") % group).alias("first"))
    plan = plan.join(n.select(F.col("conv").alias("first"), F.col("n").alias("m")), "first", "left").withColumn("b", F.least("h", F.coalesce("m", F.lit(0))))
    plan = written(plan.select("conv", "first", "h", "b", (F.col("b") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "plan")
    head = own.where(F.col("i") < heads - 1).withColumnRenamed("conv", "first").join(plan, "first").where("i < h").select("conv", (F.col("i") + 1).alias("depth"), "digest", "words", "length")
    rest = own.where(F.col("i") >= of("conv")).join(plan, "conv").select("conv", (F.col("i") - F.col("h") + F.col("b") + 1).alias("depth"), "digest", "words", "length")
    return head.unionByName(rest), plan.select("conv", "length")


def with_prefixes(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """``turns`` with the keys of the prefix up to each (p1, p2) and of the one before (q1, q2).

    A key is the exclusive-or of a hash of each turn with its place, in two lanes of 64 bits, so a long conversation's
    keys are put together from its pieces, and the key before is this one without the last turn. With 10^10 nodes two
    different ones agree with a probability of about 10^-19.
    """
    lane = lambda k: F.xxhash64(F.lit(k), "depth", "digest")
    x = turns.withColumns({"x1": lane(1), "x2": lane(2), "piece": F.floor((F.col("depth") - 1) / piece)})
    w = Window.partitionBy("conv", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    x_or = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    run = x.withColumns({"r1": F.bit_xor("x1").over(w), "r2": F.bit_xor("x2").over(w)})
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    whole = x.where(F.col("length") > piece).groupBy("conv", "piece").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"))
    offsets = whole.select("conv", "piece", F.bit_xor("s1").over(before).alias("o1"), F.bit_xor("s2").over(before).alias("o2")).where("o1 IS NOT NULL")
    out = run.join(offsets, ["conv", "piece"], "left").withColumns({f"p{k}": F.col(f"r{k}").bitwiseXOR(F.coalesce(f"o{k}", F.lit(0))) for k in (1, 2)})
    return out.select("conv", "depth", "length", "words", *NODE, x_or("p1", "x1").alias("q1"), x_or("p2", "x2").alias("q2"))


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted (p1, p2, conv) -> (p1, p2, first, ids): up to CHUNK decimal ids of a node, comma-joined."""
    node, ids = None, []
    for b in batches:
        out = []
        for p1, p2, c in zip(b["p1"].tolist(), b["p2"].tolist(), b["conv"].tolist()):
            if (p1, p2) != node or len(ids) == CHUNK:
                if ids:
                    out.append((*node, ids[0], ",".join(map(str, ids))))
                node, ids = (p1, p2), []
            ids.append(c)
        yield pd.DataFrame(out, columns=["p1", "p2", "first", "ids"])
    if ids:
        yield pd.DataFrame([(*node, ids[0], ",".join(map(str, ids)))], columns=["p1", "p2", "first", "ids"])


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted chunks -> (p1, p2, ends_sha256); a chunk is hashed and let go."""
    node, h = None, None
    for b in batches:
        out = []
        for p1, p2, ids in zip(b["p1"].tolist(), b["p2"].tolist(), b["ids"]):
            if (p1, p2) != node:
                if node:
                    out.append((*node, h.hexdigest()))
                node, h = (p1, p2), hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        yield pd.DataFrame(out, columns=["p1", "p2", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, h.hexdigest())], columns=["p1", "p2", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) from (p1, p2, conv): ids in ascending order, comma-joined, hashed.

    Ids are sorted and joined by ranges of (node, id), so that the ids of a node in which very many conversations end
    are in no single task. Only the hash itself, which has to see one piece after the other, runs in one task for a node,
    over pieces of CHUNK ids, in constant memory.
    """
    ship_code(ends.sparkSession)
    key = [*NODE, "conv"]
    pieces = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInPandas(_chunks, "p1 long, p2 long, first long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInPandas(_digests, "p1 long, p2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(p1, p2, leaves, saved): the sums over each node's subtree, its own included, in a logarithm of the depth of rounds.

    ``nodes``: (p1, p2, q1, q2, leaves, saved), the root without parent (q1 null). After round k a node holds the sums
    over its descendants less than 2^k below, and points at its ancestor 2^k above; it then sends its sums there
    (added up before the shuffle, so that an ancestor of very many is no hot key) and takes over that one's pointer. A round
    is written, so a lost executor costs a reread.
    """
    a = written(nodes.select(*NODE, *PARENT, "leaves", "saved"), "jump")
    while not a.where("q1 IS NOT NULL").isEmpty():
        sent = a.where("q1 IS NOT NULL").groupBy(*PARENT).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s")).withColumnsRenamed({"q1": "p1", "q2": "p2"})
        far = a.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("q1").alias("n1"), F.col("q2").alias("n2")).where("n1 IS NOT NULL")
        there = a.where("q1 IS NOT NULL").select(*NODE, *PARENT).join(far, PARENT).select(*NODE, F.col("n1").alias("q1"), F.col("n2").alias("q2"))
        sums = a.select(*NODE, "leaves", "saved").join(sent, NODE, "left").select(*NODE, (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        a = written(sums.join(there, NODE, "left").select(*NODE, *PARENT, "leaves", "saved"), "jump")
    return a.select(*NODE, "leaves", "saved")


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations; see op11_conversation_prefixes for the columns.

    Null roles and texts are empty; null turns come first; equal turn numbers, repeated rows among them, are turns in
    the order of their digests. Rows without a conv_id belong to no conversation. Very long texts are hashed whole; other
    columns are not read; an empty table has no root and gives none.
    """
    own = written(numbered(turns_of(conversations, conv_id, turn, role, text)), "numbered")
    turns, lengths = rebuilt(own, group, heads)
    p = written(with_prefixes(turns), "prefixes")
    lengths = written(lengths, "conversations")
    nodes = p.groupBy(*NODE).agg(F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = lengths.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(  # one row
        zero.alias("p1"), zero.alias("p2"), "conv_id", zero.alias("depth"), none.alias("q1"), none.alias("q2"), "n_convs", zero.alias("words"))
    nodes = written(nodes.unionByName(root), "trie")
    children = nodes.where("q1 IS NOT NULL").groupBy(*PARENT).agg(F.count("*").alias("n_children")).withColumnsRenamed({"q1": "p1", "q2": "p2"})
    full = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    full = written(full.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")}), "nodes")
    ends = p.where("depth = length").select(*NODE, "conv").unionByName(lengths.where("length = 0").select(zero.alias("p1"), zero.alias("p2"), "conv"))
    above = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    top = F.broadcast(nodes.where("depth = 0").select(F.col("conv_id").alias("top")))  # one row
    kept = ["conv_id", "depth", "n_convs", "n_children"]
    # the root's children know their parent, so that they need not meet at one key
    deep = full.where("depth > 1").join(above, PARENT).select(*NODE, *kept, "parent_conv_id")
    flat = full.where("depth <= 1").crossJoin(top).select(*NODE, *kept, F.when(F.col("depth") == 1, F.col("top")).alias("parent_conv_id"))
    out = deep.unionByName(flat).join(rolled_up(full), NODE).join(ends_digest(ends), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def op11_conversation_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations.

    conv_id: the smallest member; depth; parent_conv_id: the parent's; n_convs, n_children; n_leaves: nodes without
    children in the subtree; saved_tokens: words that members share with the first of them, over the subtree;
    ends_sha256: of the ids of the members that end here.
    """
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_BIT = "list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
_CRC = f"xor(4294967295, list_reduce([4294967295] || list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)), lambda a, b: {_BIT}))"
OP11_SQL = rf"""WITH o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(len(role) || ':' || role || text)) - 1 AS i FROM o),
k AS (SELECT c, m, c - c % {GROUP} AS first, {_CRC} % {HEADS} AS h FROM (SELECT c, count(*) AS m FROM o GROUP BY c)),
kb AS (SELECT k.c, k.first, k.h, least(k.h, coalesce(f.m, 0)) AS b FROM k LEFT JOIN k f ON f.c = k.first),
t AS (SELECT kb.c, i + 1 AS d, role, text FROM kb JOIN n ON n.c = kb.first WHERE i < h UNION ALL SELECT n.c, i - h + b + 1, role, text FROM n JOIN kb ON n.c = kb.c WHERE i >= h),
l AS (SELECT kb.c, coalesce(list({{'role': role, 'text': text}} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS s FROM kb LEFT JOIN t ON t.c = kb.c GROUP BY kb.c),
p AS (SELECT c, d, len(s) = d AS ends, list_transform(range(0, d + 1), lambda j: sha256(to_json(s[1:j])::VARCHAR)) AS keys, len(regexp_extract_all(coalesce(s[d].text, ''), '[^\x20\x09-\x0D]+')) AS words FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM l)),
nd AS (SELECT keys[-1] AS key, any_value(keys) AS keys, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(CASE WHEN d = 0 THEN 0 ELSE words END) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM p GROUP BY keys[-1]),
ch AS (SELECT keys[-2] AS key, count(*) AS n_children FROM nd WHERE depth > 0 GROUP BY 1),
nc AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN ch USING (key)),
up AS (SELECT a AS key, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT unnest(keys) AS a, n_children, saved FROM nc) GROUP BY a)
SELECT nc.conv_id, nc.depth, q.conv_id AS parent_conv_id, nc.n_convs, nc.n_children, n_leaves, saved_tokens, nc.ends_sha256 FROM nc JOIN up USING (key) LEFT JOIN nd q ON nc.depth > 0 AND q.key = nc.keys[-2]"""
