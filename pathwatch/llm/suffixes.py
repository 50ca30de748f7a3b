"""Byte-exact removal of repeated passages: repeats are found in suffix arrays that are built by linear grouping."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pathwatch.session import ship_code, written

#: Length of a repeat in bytes, and of the seeds by whose hashes strings are dealt out.
REPEAT, SEED_BYTES = 200, 48
#: Widest block of leads by which strings are dealt out, and the different strings of a group above which the block is halved.
BLOCK, GROUP = 32, 256
#: Bytes whose hashes are made at once.
PIECE = 1 << 22
_INDEX_BITS = np.uint64(24)
_U64 = (1 << 64) - 1


# ---- suffix sorting


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a string of small integers, without recursion or renaming.

    The steps are linear but for one: a group's members are put in the order of their places by sorting them.

    First the suffixes are put into groups by their first symbol. From the highest group down, every suffix of a group
    finds the nearest suffix before it that is in a lower group; that one's known beginning is followed by as many
    copies of the group's beginning as point to it, so within its own group it moves up by that number, into a new
    group. At the end a group holds the suffixes with one and the same Lyndon prefix, in the right order of groups. Then
    the order inside the groups is emitted: the suffixes come out from the smallest up, and each of them, by the same
    pointers, fixes the next place in the groups of the suffixes before it.
    """
    n = len(text)
    buckets: list[list[int]] = [[] for _ in range(max(text, default=-1) + 1)]
    for i, symbol in enumerate(text):
        buckets[symbol].append(i)
    order = [i for bucket in buckets for i in bucket]
    group = [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            start = k
        group[i] = start
    place = [0] * n
    for k, i in enumerate(order):
        place[i] = k
    # by the start of a group: where it ends
    ends: dict[int, int] = {}
    for k, i in enumerate(order):
        ends[group[i]] = k + 1
    before = [-1] * n
    end = n
    while end > 0:
        low = group[order[end - 1]]
        pointed: dict[int, int] = {}
        for i in sorted(order[low:end]):
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if pointed:
            moved = defaultdict(list)
            for p, times in pointed.items():
                moved[group[p], times].append(p)
            for (g, _), members in sorted(moved.items(), reverse=True):
                tail = ends[g]
                first = tail - len(members)
                if first == g:
                    continue  # the whole rest of the group
                for p in members:
                    tail -= 1
                    other, at = order[tail], place[p]
                    order[at], order[tail] = other, p
                    place[other], place[p] = at, tail
                for p in members:
                    group[p] = first
                ends[first], ends[g] = ends[g], first
        end = low
    out = [-1] * n
    slot = list(range(n))
    done = bytearray(n)

    def emit(i: int) -> None:
        while i >= 0 and not done[i]:
            g = group[i]
            out[slot[g]] = i
            slot[g] += 1
            done[i] = 1
            i = before[i]

    emit(n - 1)
    for k in range(n):
        emit(out[k] - 1)
    return out


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """Length of the common beginning of each suffix and the one before it in the order."""
    n = len(text)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    out, h = [0] * n, 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + h < n and j + h < n and text[i + h] == text[j + h]:
                h += 1
            out[rank[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return out


def repeated_starts(strings: list[bytes], length: int = REPEAT) -> list[set[int]]:
    """For each string the starts of its substrings of ``length`` bytes that start elsewhere too, in any of the strings."""
    k = len(strings)
    text: list[int] = []
    owner: list[tuple[int, int]] = []
    for s, x in enumerate(strings):
        text.extend([b + k for b in x])
        text.append(k - 1 - s)  # every string ends in a symbol of its own
        owner.extend([(s, i) for i in range(len(x) + 1)])
    order = suffix_array(text)
    found: list[set[int]] = [set() for _ in strings]
    for at, n in enumerate(common_prefixes(text, order)):
        if n >= length:
            for i in (order[at - 1], order[at]):
                s, o = owner[i]
                found[s].add(o)
    return found


# ---- dealing out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0], k = 1, 1
    while k < n:
        e = min(k, n - k)
        out[k : k + e] = out[:e] * np.uint64(base)
        base, k = base * base & _U64, 2 * k
    return out


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def seed_runs(data: bytes, ends: np.ndarray, length: int = REPEAT, seed: int = SEED_BYTES) -> tuple[np.ndarray, ...]:
    """(start, count, lead, key, text number) for every run of positions whose ``length``-byte strings share their seed.

    A string's seed is the ``seed``-byte substring with the least hash in it (the first of equals), which depends on the
    string alone: equal strings have equal seeds, at the same distance (lead) from their start. Consecutive strings
    mostly have the same seed, so there is about one run for every 75 bytes. Texts lie one after the other in ``data``;
    ``ends`` are their ends; no string crosses one.
    """
    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    if n not in _tables:
        _tables.clear()
        _tables[n] = (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n), np.random.default_rng(1).integers(0, 1 << 64, 256, dtype=np.uint64))
    up, down, letter = _tables[n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letter[b] * down, out=sums[1:])
    h = (sums[seed:] - sums[:-seed]) * up[: n - seed + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    v = (h >> _INDEX_BITS << _INDEX_BITS) | np.arange(len(h), dtype=np.uint64)
    width, k, least = length - seed + 1, 1, v
    while 2 * k <= width:
        least, k = np.minimum(least[:-k], least[k:]), 2 * k
    m = len(v) - width + 1
    least = np.minimum(least[:m], least[width - k : width - k + m])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    text = np.searchsorted(ends, np.arange(m), side="right")
    s = np.flatnonzero(np.arange(m) + length <= ends[text])
    if not len(s):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    new = np.flatnonzero(np.r_[True, (np.diff(s) != 1) | (np.diff(at[s]) != 0) | (np.diff(text[s]) != 0)])
    start = s[new]
    return start, np.diff(np.r_[new, len(s)]), at[start] - start, h[at[start]].view(np.int64), text[start]


def _pieces(texts: list[bytes], piece: int = PIECE) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """The texts in pieces of bounded size: bytes, and for each text in it its number, where in the text the piece begins, and its end.

    A longer text is cut; its pieces overlap by one byte less than a repeat.
    """
    held, of, size = [], [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(1, len(t) - REPEAT + 1), piece):
            part = t[at : at + piece + REPEAT - 1]
            if size and size + len(part) > piece + REPEAT:
                yield b"".join(held), of
                held, of, size = [], [], 0
            held.append(part)
            of.append((k, at - size, size + len(part)))
            size += len(part)
    if held:
        yield b"".join(held), of


RUNS = "t1 long, t2 long, pos long, count int, lead int, key long, c1 long, c2 long, n long"
RUN = ["key", "c1", "c2"]


def _runs(piece: int):
    """The seed runs of texts (t1, t2, text), each with the 128-bit hash of its bytes; copies within a batch are one text with a count n."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            g = pdf.groupby(["t1", "t2"], sort=False).agg(text=("text", "first"), n=("text", "size")).reset_index()
            texts = [t.encode("utf-8", "surrogatepass") for t in g["text"]]
            for data, of in _pieces(texts, piece):
                number, shift = np.array([x[0] for x in of]), np.array([x[1] for x in of])
                start, count, lead, key, text = seed_runs(data, np.array([x[2] for x in of]))
                if not len(start):
                    continue
                digests = b"".join([xxhash.xxh3_128_digest(data[a : a + e]) for a, e in zip(start.tolist(), (count + REPEAT - 1).tolist())])
                c = np.frombuffer(digests, dtype=">i8").astype(np.int64).reshape(-1, 2)
                own = number[text]
                yield pd.DataFrame({
                    "t1": g["t1"].to_numpy()[own], "t2": g["t2"].to_numpy()[own], "pos": start + shift[text], "count": count.astype(np.int32),
                    "lead": lead.astype(np.int32), "key": key, "c1": c[:, 0], "c2": c[:, 1], "n": g["n"].to_numpy()[own]})

    return run


def _texts(docs: DataFrame, text: str) -> DataFrame:
    """Texts with their identity, two hashes of the content."""
    body = F.col(text)
    return docs.select(F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"), body.alias("text"))


# ---- strings of one seed that differ


def decide(strings: list[tuple[bytes, int]]) -> list[list[tuple[int, int]]]:
    """For each of the different strings (bytes, occurrences) of a group the first and last of each run of repeated starts."""
    found = repeated_starts([x for x, _ in strings])
    return [[(0, len(x) - REPEAT)] if n > 1 else _intervals(s) for (x, n), s in zip(strings, found)]


def _intervals(starts: set[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive starts."""
    s = np.array(sorted(starts))
    if not len(s):
        return []
    b = np.flatnonzero(np.diff(s) != 1)
    return list(zip(s[np.r_[0, b + 1]].tolist(), s[np.r_[b, len(s) - 1]].tolist()))


DEAL = ["key", "block", "core"]
DECIDED = "key long, block int, core long, p1 long, p2 long, first int, last int"


def _decide_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """decide() for every group of a partition that is sorted by group; holds one group's strings, at most GROUP, at a time."""
    held: list[tuple[bytes, int, int, int]] = []
    group = None

    def rows() -> list[tuple]:
        found = decide([(x, n) for x, n, _, _ in held])
        return [(*group, p1, p2, a, b) for (_, _, p1, p2), spans in zip(held, found) for a, b in spans]

    def frame(made: list) -> pd.DataFrame:
        return pd.DataFrame(made, columns=[*DEAL, "p1", "p2", "first", "last"]).astype({"key": "int64", "core": "int64", "p1": "int64", "p2": "int64", "block": "int32", "first": "int32", "last": "int32"})

    for pdf in batches:
        made = []
        for *deal, p1, p2, n, x in zip(*[pdf[c].tolist() for c in (*DEAL, "p1", "p2", "n")], pdf["bytes"]):
            if deal != group:
                made += rows()
                held, group = [], deal
            held.append((bytes(x), n, p1, p2))
        yield frame(made)
    yield frame(rows())


def slices(strings: DataFrame, width: int) -> DataFrame:
    """Strings (bytes, whose starts have the leads hi down to lo) cut by blocks of ``width`` leads, each with the hash of its core.

    The core of a block is what every repeat-long string with a lead in it has in common, wherever its string ends: the
    REPEAT + 1 - width bytes from the block's least lead on. Equal repeats have equal seeds and leads, so they are in
    the same block with the same core. All columns but block, core, hi, lo, bytes, p1 and p2 (a hash of the bytes) stay.
    """
    n = lambda x: F.lit(x).cast("int")
    low = F.col("block") * width
    at = strings.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / width).cast("int"), F.floor(F.col("hi") / width).cast("int"))))
    core = F.substring("bytes", F.col("hi") - low + 1, n(REPEAT + 1 - width))
    top, end = F.least("hi", low + (width - 1)), F.greatest("lo", low)
    keep = [c for c in strings.columns if c not in ("block", "core", "hi", "lo", "bytes", "p1", "p2")]
    cut = at.select(*keep, "block", F.xxhash64(core).alias("core"), top.alias("hi"), end.alias("lo"), F.substring("bytes", F.col("hi") - top + 1, top - end + REPEAT).alias("bytes"))
    return cut.withColumns({"p1": F.xxhash64("bytes"), "p2": F.xxhash64(F.lit(1), F.col("bytes"))})


def shared_starts(strings: DataFrame, group: int = GROUP) -> DataFrame:
    """(key, c1, c2, first, last): the repeated starts of different strings with the same seed.

    strings: key, c1, c2, n (occurrences), lead, hi, lo, bytes. They are cut by blocks of leads and grouped by seed,
    block and core; whatever is alone there has no repeat. The different strings of a group are sorted by linear
    grouping. A group of more than ``group`` different strings (the edge of a passage that very many texts share) is
    dealt out again by blocks of half the width, whose cores are longer, down to single starts, which are equal in a
    group: so no group is unbounded and none is counted start by start unless it has to be.
    """
    width, found = BLOCK, []
    while True:
        cut = slices(strings, width)
        sizes = cut.groupBy(*DEAL).agg(F.count_distinct("p1", "p2").alias("m"), F.count("*").alias("o")).where("o > 1")
        cut = written(cut.join(sizes, DEAL), f"slices_{width}")
        # a run that occurs twice is repeated as a whole: it is here only as a partner
        once = cut.where("n = 1")
        found.append(once.where("m = 1").select(*RUN, (F.col("lead") - F.col("hi")).alias("first"), (F.col("lead") - F.col("lo")).alias("last")))
        few = F.col("m").between(2, group if width > 1 else 1 << 30)
        different = cut.where(few).groupBy(*DEAL, "p1", "p2").agg(F.count("*").alias("n"), F.any_value("bytes").alias("bytes"))
        decided = different.repartition(*DEAL).sortWithinPartitions(*DEAL, "p1", "p2").mapInPandas(_decide_sorted, DECIDED)
        found.append(once.where(few).join(decided, [*DEAL, "p1", "p2"]).select(*RUN, (F.col("lead") - F.col("hi") + F.col("first")).alias("first"), (F.col("lead") - F.col("hi") + F.col("last")).alias("last")))
        strings, width = cut.where(F.col("m") > group).drop("m", "o"), width // 2
        if not width or strings.isEmpty():
            return reduce(DataFrame.unionByName, found)


def repeats(docs: DataFrame, text: str = "text", piece: int = PIECE, group: int = GROUP) -> DataFrame:
    """(t1, t2, spans): the byte ranges of every distinct text that repeated strings cover.

    Strings of REPEAT bytes are dealt out by their seed, in runs of consecutive starts. A run is told by its seed and a
    128-bit hash of its bytes; one that occurs twice is repeated as a whole. Where a seed has several different runs,
    ``shared_starts`` finds what these share. ``piece`` bounds the bytes that are hashed at once.
    """
    ship_code(docs.sparkSession)
    long_enough = _texts(docs, text).where(F.octet_length("text") >= REPEAT)
    runs = written(long_enough.mapInPandas(_runs(piece), RUNS), "runs")
    seeds = runs.groupBy("key").agg(F.sum("n").alias("m")).where("m > 1").select("key")
    # a seed can be one of very many texts: a plain join, whose skewed partitions are split
    seen = written(runs.join(seeds, "key"), "seen")
    strings = written(seen.groupBy(*RUN).agg(F.sum("n").alias("n"), F.min(F.struct("t1", "t2", "pos", "count", "lead")).alias("r")), "strings")
    several = strings.groupBy("key").agg(F.count("*").alias("d")).where("d > 1").select("key")
    mixed = strings.join(several, "key").select(*RUN, "n", "r.*")
    of_text = mixed.groupBy("t1", "t2").agg(F.collect_list(F.struct(*RUN, "n", "pos", "count", "lead")).alias("m"))
    # one copy of each text: sorted by its hashes, copies are merged before they are sent
    once = long_enough.groupBy("t1", "t2").agg(F.any_value("text").alias("text"))
    cut = once.join(of_text, ["t1", "t2"]).select(F.col("text").cast("binary").alias("b"), F.explode("m").alias("m"))
    different = cut.select("m.key", "m.c1", "m.c2", "m.n", "m.lead", F.col("m.lead").alias("hi"), (F.col("m.lead") - F.col("m.count") + 1).alias("lo"),
                           F.substring("b", F.col("m.pos").cast("int") + 1, F.col("m.count") + (REPEAT - 1)).alias("bytes"))
    whole = strings.where("n > 1").select(*RUN, F.lit(0).alias("first"), (F.col("r.count") - 1).alias("last"))
    starts = whole.unionByName(shared_starts(written(different, "different"), group))
    found = written(starts.groupBy(*RUN).agg(F.collect_list(F.struct("first", "last")).alias("found")), "found")
    # a set: copies of a text have the same runs
    spans = seen.select("t1", "t2", "pos", *RUN).join(found, RUN).groupBy("t1", "t2").agg(F.collect_set(F.struct("pos", "found")).alias("at"))
    placed = F.flatten(F.transform("at", lambda x: F.transform(x["found"], lambda f: F.struct((x["pos"] + f["first"]).alias("s"), (x["pos"] + f["last"] + REPEAT).alias("e")))))
    return written(spans.select("t1", "t2", placed.alias("spans")), "spans")


def _cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, spans in batches:
        out = []
        for t, s in zip(texts, spans):
            b = t.encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for a, e in sorted((x["s"], x["e"]) for x in s) if s is not None else ():
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([a, e])
            edges = [0, *[x for m in merged for x in m], len(b)]
            kept = b"".join([b[i:j] for i, j in zip(edges[::2], edges[1::2])])
            out.append((len(b), len(b) - len(kept), len(merged), hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"n_bytes": "int64", "n_removed": "int64", "n_spans": "int64"})


def without(docs: DataFrame, found: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``, whose spans ``found`` are cut out."""
    body = F.coalesce(F.col(text), F.lit(""))
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("t1"), F.xxhash64(F.lit(1), F.col(text)).alias("t2"), body.alias("text"))
    cut = pandas_udf(_cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return ids.join(found, ["t1", "t2"], "left").select("doc_id", cut("text", "spans").alias("k")).select("doc_id", "k.*")


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Every byte covered by a string of REPEAT bytes that also starts anywhere else is removed. Null texts count as empty;
    null ids and repeated rows are kept (a repeated row is a copy, so its text goes); other columns are not read; an
    empty table gives none.
    """
    return without(docs, repeats(docs, text), text, doc_id)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated passages."""
    return without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
