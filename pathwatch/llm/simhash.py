"""Near-duplicate documents by SimHash, compared exactly in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pathwatch.llm.graph import components
from pathwatch.session import ship_code, written

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: Fingerprints in one tile; two tiles (512 KB) meet in one task.
TILE = 32_768
#: Pairs that one step of the comparison holds in memory.
BLOCK = 1 << 21


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of one text: bit i is set if more than half of the shingles' XXH64 values have it. No words: 0."""
    if not text:
        return 0
    w = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: only A-Z change, only ASCII space splits
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for t in texts:
        yield pa.array(np.array([fingerprint(x.as_py()) for x in t], dtype=np.uint64).view(np.int64))


def simhash(text: Column) -> Column:
    """The 64-bit fingerprint of a text column, as a signed long."""
    return arrow_udf(_fingerprints, "long")(text)


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], axis=1).astype(np.int16)


class _Forest:
    """Which of the nodes 0..n-1 hang together so far; the labels are kept flat, so that links can be filtered by array."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        la, lb = self.label[a], self.label[b]
        differ = la != lb
        if not differ.any():
            return
        pairs = np.unique(np.stack([np.minimum(la, lb)[differ], np.maximum(la, lb)[differ]], axis=1), axis=0)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        for x, y in pairs.tolist():
            if (rx := top(x)) != (ry := top(y)):
                up[max(rx, ry)] = min(rx, ry)
        moved = np.arange(len(self.label))
        for x in up:
            moved[x] = top(x)
        self.label = moved[self.label]


def tile_links(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Links between two tiles (or within one, if both are the same) as the edges of a spanning forest, shape (n, 2).

    Each tile is cut into blocks of equal populations of its four 16-bit quarters. Two blocks are compared, by
    exclusive-or and bit count, unless their populations differ by more than the radius: a differing bit changes
    one quarter's population by one, so the skipped pairs can't be within the radius. Of a group in which
    everything is linked to everything only one tree is kept, which has the same components.
    """
    nodes = np.unique(np.concatenate([a, b]))
    forest = _Forest(len(nodes))
    sides = []
    for x in (a, b):
        q = _quarters(x)
        key = q.astype(np.int64) @ np.array([1 << 15, 1 << 10, 1 << 5, 1])
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
        sides.append((x[order], q[order][starts], starts, np.r_[starts[1:], len(x)], np.searchsorted(nodes, x[order])))
    (xa, qa, sa, ea, ia), (xb, qb, sb, eb, ib) = sides
    for k in range(len(sa)):
        near = np.flatnonzero(np.abs(qb - qa[k]).sum(axis=1) <= radius)
        if not len(near):
            continue
        cols = np.concatenate([np.arange(sb[j], eb[j]) for j in near])
        step = max(1, BLOCK // len(cols))
        for at in range(sa[k], ea[k], step):
            rows = np.arange(at, min(at + step, ea[k]))
            r, c = np.nonzero(np.bitwise_count(xa[rows, None] ^ xb[None, cols]) <= radius)
            if len(r):
                forest.add(ia[rows[r]], ib[cols[c]])
    hung = np.flatnonzero(forest.label != np.arange(len(nodes)))
    return np.stack([nodes[hung], nodes[forest.label[hung]]], axis=1)


def _compare(radius: int):
    def run(pair: pa.Table) -> pa.Table:
        sides = {"a": [], "b": []}
        for side, fps in zip(pair["side"].to_pylist(), pair["fps"]):
            sides[side].append(fps.values.to_numpy(zero_copy_only=False).view(np.uint64))
        a, b = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in sides.values())
        if pair["p"][0].equals(pair["q"][0]):
            b = a
        e = tile_links(a, b, radius) if len(a) and len(b) else np.empty((0, 2), np.uint64)
        return pa.table({"a": e[:, 0].copy().view(np.int64), "b": e[:, 1].copy().view(np.int64)})

    return run


def cut_tiles(counts: np.ndarray, tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where fingerprints go, from (q1, q2, q3, q4, n): how many have these populations of their four quarters.

    Gives (bin, chunks) of each row, and the bins' boxes: the least and the greatest population of each quarter in a bin,
    and the population count. A bin is a run of rows, in order, of one population count and about ``tile`` fingerprints;
    a row of more is a bin that is cut into chunks by a hash.
    """
    order = np.lexsort((*counts[:, 3::-1].T, counts[:, :4].sum(axis=1)))
    c = counts[order]
    pop, bins, chunks, held = c[:, :4].sum(axis=1), np.zeros(len(c), np.int64), np.ones(len(c), np.int64), 0
    for k, n in enumerate(c[:, 4].tolist()):
        new = k > 0 and (pop[k] != pop[k - 1] or held + n > tile)
        held = n if new or k == 0 else held + n
        bins[k] = bins[k - 1] + new if k else 0
        chunks[k] = max(1, -(-n // tile))
    first = np.flatnonzero(np.r_[True, np.diff(bins) != 0][: len(c)])
    boxes = np.concatenate([np.minimum.reduceat(c[:, :4], first), np.maximum.reduceat(c[:, :4], first), pop[first, None]], axis=1) if len(c) else np.empty((0, 9), np.int64)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return np.stack([bins, chunks], axis=1)[back], boxes, np.maximum.reduceat(chunks, first) if len(c) else np.empty(0, np.int64)


def near_bins(spark: SparkSession, boxes: np.ndarray, chunks: np.ndarray, radius: int) -> DataFrame:
    """(bin_a, bin_b, chunks_a, chunks_b): pairs of bins, the lower first, that can hold fingerprints within the radius.

    Their boxes are no farther apart. Bins (a bounded number) meet by their population counts, which then differ by the
    radius at most; the pairs are made and stay on Spark.
    """
    box = [f"{end}{k}" for end in ("low", "high") for k in range(4)]
    rows = np.concatenate([np.arange(len(boxes))[:, None], boxes, chunks[:, None]], axis=1).tolist() if len(boxes) else []
    bins = spark.createDataFrame(rows, "bin int, " + ", ".join(f"{c} int" for c in box) + ", pop int, chunks int")
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    above = side(bins, "a").withColumn("pop_b", F.explode(F.sequence(F.col("pop_a"), F.col("pop_a") + radius)))
    apart = reduce(lambda x, y: x + y, [F.greatest(F.lit(0), F.col(f"low{k}_b") - F.col(f"high{k}_a"), F.col(f"low{k}_a") - F.col(f"high{k}_b")) for k in range(4)])
    return above.join(side(bins, "b"), "pop_b").where((F.col("bin_a") <= F.col("bin_b")) & (apart <= radius)).select("bin_a", "bin_b", "chunks_a", "chunks_b")


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps`` (one column fp) exactly as all links within the radius do.

    A tile holds up to about ``tile`` fingerprints of one population count and of similar populations of their four
    quarters. Two tiles meet in one task, unless their populations differ by more than the radius: a differing bit
    changes one quarter's population by one, so skipped pairs of tiles, which are never shuffled, can't be within the
    radius. This is an exact comparison of all with all, made cheap by the skipping, not an index.
    """
    spark = fps.sparkSession
    part = lambda s: F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(0xFFFF)).cast("int")
    quarters = ["q1", "q2", "q3", "q4"]
    described = fps.select("fp", *[part(16 * k).alias(q) for k, q in enumerate(quarters)])
    # at most 17 ** 4 = 83,521 rows, whatever the input: each quarter has a population of 0 to 16
    counts = described.groupBy(*quarters).agg(F.count("*").alias("n")).collect()
    counts = np.array([tuple(r) for r in counts], dtype=np.int64).reshape(-1, 5)
    place, boxes, chunks = cut_tiles(counts, tile)
    where = spark.createDataFrame(np.concatenate([counts[:, :4], place], axis=1).tolist(), "q1 int, q2 int, q3 int, q4 int, bin int, chunks int")
    tiles = described.join(F.broadcast(where), quarters).select("fp", "bin", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"))
    tiles = written(tiles.groupBy("bin", "chunk").agg(F.collect_list("fp").alias("fps")), "tiles")
    near = written(near_bins(spark, boxes, chunks, radius), "near_bins")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = near.withColumn("chunk_a", upto("chunks_a")).withColumn("chunk_b", upto("chunks_b")).where("bin_a < bin_b OR chunk_a <= chunk_b")
    p, q = F.struct("bin_a", "chunk_a").alias("p"), F.struct("bin_b", "chunk_b").alias("q")
    sides = [
        tiles.join(pairs.select("p", "q", F.lit(side).alias("side"), F.col(f"{own}.bin_{side}").alias("bin"), F.col(f"{own}.chunk_{side}").alias("chunk")), ["bin", "chunk"]).select("p", "q", "side", "fps")
        for pairs in [pairs.select(p, q)] for side, own in (("a", "p"), ("b", "q"))]
    ship_code(spark)
    # struct names differ between the sides of a pair
    same = "struct<bin:int,chunk:int>"
    both = sides[0].unionByName(sides[1]).select(F.col("p").cast(same).alias("p"), F.col("q").cast(same).alias("q"), "side", "fps")
    return both.groupBy("p", "q").applyInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    fingerprint: 16 hex digits. component_id: the smallest id that can be reached over links of fingerprints with at
    most ``radius`` differing bits, the row's own id included. Null and wordless texts have fingerprint zero and are
    linked like any other; rows with a null id keep their row and get the component of their fingerprint (null if it
    has no id at all); repeated rows stay repeated; other columns of ``docs`` are not read. An empty table gives none.
    """
    ship_code(docs.sparkSession)
    # repeated fingerprints (groups of copies, however large) are one node, found with partial aggregation
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("fp")), "prints")
    member = _members(prints, F.min("doc_id"), radius)
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(member.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _members(prints: DataFrame, first: Column, radius: int) -> DataFrame:
    """(fp, first, root) for every distinct fingerprint: an aggregate over its rows, and the component's label."""
    nodes = written(prints.groupBy("fp").agg(first.alias("first")), "nodes")
    roots = components(fingerprint_links(nodes.select("fp"), radius))
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``docs`` without the near-duplicates: of each component one row stays, all columns kept.

    It is the row with the smallest id (null ids last), among these the one with the smallest hash of all columns.
    Rows are told apart by their content, so null and repeated ids neither protect a row nor drop another component's.
    """
    ship_code(docs.sparkSession)
    row = F.xxhash64(*[F.col(c) for c in docs.columns])
    prints = written(docs.select(F.col(doc_id).alias("doc_id"), row.alias("row"), simhash(F.col(text)).alias("fp")), "prints")
    # equal rows are counted: most rows that stay occur once and need not be compared with any other
    rows = prints.groupBy("fp", "doc_id", "row").agg(F.count("*").alias("n"))
    member = _members(rows, F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "row", "n")), radius)
    stay = member.groupBy("root").agg(F.min("first").alias("first")).select(
        F.col("first.doc_id").alias("_stay_id"), F.col("first.row").alias("_stay_row"), F.col("first.n").alias("_stay_n"))
    stay = written(stay, "stay")
    # all of a row's columns in one, so that no name can clash
    marked = docs.select(F.struct(*docs.columns).alias("all"), row.alias("row"))

    def kept(of: DataFrame) -> DataFrame:
        return marked.join(of, F.col("all")[doc_id].eqNullSafe(F.col("_stay_id")) & (F.col("row") == F.col("_stay_row")), "left_semi")

    single, equal = kept(stay.where("_stay_n = 1")), kept(stay.where("_stay_n > 1"))
    equal = equal.withColumn("id", F.col("all")[doc_id]).dropDuplicates(["id", "row"]).drop("id")
    return single.unionByName(equal).select("all.*")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
