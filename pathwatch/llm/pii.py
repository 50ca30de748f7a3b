"""Personal data: overlapping candidates, boosted trees over their format and context, calibrated thresholds.

Built-in functions only; the trees become column expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwatch.llm import boosting
from pathwatch.llm.spans import find_spans, let, listed, running, span_sql
from pathwatch.session import written

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
#: A held-out group of candidates counts from this size on.
LEAST = 20
#: Characters before a candidate in which cue words are looked for.
NEAR = 24

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"
#: Base patterns. A match can only begin where a run of its first class begins, or where the match before ended.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: looser forms of the same kinds. Their spans may overlap each other and the base ones.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\x20?[\[(](?:at|AT)[\])]\x20?{_HOST}++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?){_HOST}++)++",
    "ip": r"(?<![0-9.:A-Fa-f])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9.:A-Fa-f])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]{0,2}[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+(])\(?[0-9](?:[\x20().-]{0,2}[0-9]){8,14}(?![0-9])",
}
#: Without this a text has no match of the kind, base or loose.
SIGN = {"email": r"@|[\[(](?:at|AT)[\])]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9][\x20.-]{0,2}[0-9]", "phone": r"[0-9][\x20().-]*+[0-9]"}
#: Words before a candidate that speak for it. They label candidates for learning, so they are no feature.
CUE = {"email": r"mail|contact|write", "ip": r"\bip\b|server|host|addr|login", "card": r"card|visa|credit|pay|account", "phone": r"phone|tel|call|fax|mobile"}
FEATURES = ("kind", "digits", "marks", "bracket", "first", "before", "after")
CANDIDATE = "array<struct<start:int,end:int,rank:int,kind:string,base:boolean,cue:int," + ",".join(f"{f}:int" for f in FEATURES[1:]) + ">>"
FAR = 2**31 - 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(one, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    """What a base match must satisfy."""
    n = F.char_length(_digits(match))
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & luhn(F.when(n.between(13, 19), _digits(match)).otherwise("1"))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _candidates(text: Column, kind: str) -> Column:
    rank = KINDS.index(kind)

    def described(s: Column, base: Column) -> Column:
        m = s["match"]
        around = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)
        left = s["left"]
        first = F.regexp_extract(m, "[0-9]", 0)
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), base.alias("base"),
            F.lower(left).rlike(CUE[kind]).cast("int").alias("cue"),
            F.least(F.char_length(_digits(m)), F.lit(20)).alias("digits"),
            F.least(F.char_length(F.regexp_replace(m, r"[^\x20.-]", "")), F.lit(5)).alias("marks"),
            m.contains("(").cast("int").alias("bracket"),
            F.when(first == "", -1).otherwise(first.cast("int")).alias("first"),
            around(F.regexp_extract(left, r"(?s).$", 0)).alias("before"), around(s["after"]).alias("after"))

    strict = F.transform(find_spans(text, BASE[kind], NEAR), lambda s: described(s, _valid(kind, s["match"])))
    loose = F.transform(find_spans(text, LOOSE[kind], NEAR), lambda s: described(s, F.lit(False)))
    none = F.array().cast(CANDIDATE)
    # base matches of one or two digits and the like are no candidates unless they are valid
    worth = F.filter(strict.cast(CANDIDATE), lambda c: c["base"] | (c["digits"] >= 9))
    # what both generators propose is one candidate: sorted by place, it has an equal one just before it
    both = F.array_sort(F.concat(worth, loose.cast(CANDIDATE)), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], a["end"] - b["end"]).otherwise(b["base"].cast("int") - a["base"].cast("int")))
    # bound once: the lambda below looks at it for every candidate
    same = lambda all_, c, i: F.coalesce((F.get(all_, i - 1)["start"] == c["start"]) & (F.get(all_, i - 1)["end"] == c["end"]) & (i > 0), F.lit(False))
    return F.when(text.rlike(SIGN[kind]), let(both, lambda all_: F.filter(all_, lambda c, i: ~same(all_, c, i)))).otherwise(none)


def described(spans: Column) -> Column:
    """Candidates in order, each with ``own`` and ``any``: whether it overlaps a base span of its kind, or of any.

    A candidate overlaps one that begins before it if the furthest end so far lies beyond its start, and one that
    begins after it if the next start lies before its end: running values from both sides, no pairs.
    """
    def reach(c: Column, which) -> Column:
        ends = running(F.transform(c, lambda x: F.when(which(x), x["end"]).otherwise(0)), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(c, lambda x: F.when(which(x), FAR - x["start"]).otherwise(0))), F.greatest))
        return F.struct(ends.alias("ends"), starts.alias("starts"))

    def met(r: Column, x: Column, i: Column) -> Column:
        return F.coalesce(F.get(r["ends"], i - 1) > x["start"], F.lit(False)) | F.coalesce(F.get(r["starts"], i + 1) > FAR - x["end"], F.lit(False))

    def of(c: Column) -> Column:
        each = F.array(reach(c, lambda x: x["base"]), *[reach(c, lambda x, k=k: x["base"] & (x["rank"] == k)) for k in range(len(KINDS))])
        fields = ["start", "end", "rank", "kind", "base", "cue", *FEATURES[1:]]
        return let(each, lambda r: F.transform(c, lambda x, i: F.struct(*[x[f].alias(f) for f in fields], met(F.get(r, x["rank"] + 1), x, i).alias("own"), met(F.get(r, F.lit(0)), x, i).alias("any"))))

    return let(F.array_sort(spans), lambda c: F.when(F.size(c) > 0, of(c)))


def candidates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, candidates): all proposed spans of every row with their features; null texts count as empty, no candidates are null."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = F.concat(*[_candidates(body, k) for k in KINDS])
    # a bucket of the content, so that copies of a text fall on one side
    return docs.select(F.col(doc_id).alias("doc_id"), (F.crc32(body.cast("binary")) % 5 == 0).alias("held_out"), described(spans).alias("candidates"))


class Model:
    """Trees and one threshold for each kind, fitted on the counts of all candidates' feature vectors."""

    def __init__(self, trees: list, thresholds: dict[int, float]):
        self.trees, self.thresholds = trees, thresholds

    def selects(self, c: Column) -> Column:
        """Whether a candidate is personal data."""
        p = boosting.probability_of(self.trees, [c["rank"], *[c[f] for f in FEATURES[1:]]])
        least = F.coalesce(*[F.when(c["rank"] == k, F.lit(t)) for k, t in self.thresholds.items()], F.lit(2.0))
        return p >= least


def labelled(found: DataFrame) -> DataFrame:
    """(held_out, label, candidate's fields): 1 for personal data, 0 for something else, as far as can be told without the features.

    Valid base spans are personal data, and so are candidates with a cue word before them. Others are not, above all
    those on a valid base span of another kind. Candidates on a valid base span of their own kind say nothing.
    """
    label = F.when(F.col("base"), 1).when(F.col("own"), F.lit(None)).when(F.col("any"), 0).otherwise(F.col("cue"))
    return found.select("held_out", F.explode("candidates").alias("c")).select("held_out", "c.*").withColumn("label", label).where("label IS NOT NULL")


def fit(found: DataFrame) -> Model:
    """Learn which formats and surroundings personal data has, from the labels that ``labelled`` gives.

    What labels rest on (the check digit, the leading plus, cue words) is no feature, so a candidate that only lacks
    that scores like the valid ones. All candidates count: Spark sums them by feature vector, and only that histogram
    comes to the driver (every feature has at most 21 values; the vectors that occur are a few hundred). A kind's
    threshold is the lowest probability above which the held-out candidates have label 1 with the given precision;
    kinds without one add nothing.
    """
    counts = labelled(found).groupBy("held_out", "rank", *FEATURES[1:]).agg(F.sum("label").alias("yes"), F.count("*").alias("n")).collect()
    rows = np.array([[r["held_out"], r["yes"], r["n"] - r["yes"], r["rank"], *[r[f] for f in FEATURES[1:]]] for r in counts], dtype=np.int64).reshape(-1, 3 + len(FEATURES))
    # rows come in any order; sums of floats should not depend on it
    rows = rows[np.lexsort(rows.T[::-1])] if len(rows) else rows
    learn, test = rows[rows[:, 0] == 0], rows[rows[:, 0] == 1]
    trees = boosting.fit(learn[:, 3:], learn[:, 1].astype(float), learn[:, 2].astype(float))
    thresholds = {}
    for k in range(len(KINDS)):
        t = test[test[:, 3] == k]
        p = boosting.probability(trees, t[:, 3:])
        order = np.argsort(-p, kind="stable")
        yes, n = np.cumsum(t[order, 1]), np.cumsum(t[order, 1] + t[order, 2])
        good = np.flatnonzero((yes >= PRECISION * n) & (n >= LEAST) & np.r_[np.diff(p[order]) < 0, True][: len(n)])
        if len(good):
            thresholds[k] = float(p[order][good[-1]])
    return Model(trees, thresholds)


def detect(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans): array<struct<rank,start,end,kind,base>> for every row, by kind, then start.

    Base spans always stay. The model adds selected candidates that overlap no base span; of added ones that overlap
    in a chain, the first stays. Null texts have no spans, null ids and repeated rows are kept, other columns are not
    read, an empty table gives none. The candidates are written once and read for fitting and selecting. Time is in
    proportion to a text's matches (but for sorting them).
    """
    found = written(candidates(docs, text, doc_id), "candidates")
    model = fit(found)
    slim = "array<struct<rank:int,start:int,end:int,kind:string,base:boolean>>"
    cut = lambda a: F.transform(a, lambda c: F.struct(*[c[x].alias(x) for x in ("rank", "start", "end", "kind", "base")])).cast(slim)
    picked = F.filter("candidates", lambda c: ~c["base"] & ~c["any"] & model.selects(c))
    first = lambda c: let(running(F.transform(c, lambda x: x["end"]), F.greatest), lambda ends: F.filter(c, lambda x, i: F.coalesce(F.get(ends, i - 1) <= x["start"], F.lit(True))))
    both = F.concat(cut(F.filter("candidates", lambda c: c["base"])), cut(let(picked, first)))
    return found.select("doc_id", F.coalesce(F.array_sort(both), F.array().cast(slim)).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[_count(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind)))


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_pii that SQL can express."""
    return op1_pii(spark, sf_dir).drop("spans")


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT ELSE c::INT * 2 - CASE WHEN c::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
BASE_SQL = span_sql({
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(x, '.'), lambda part: len(ltrim(part, '0')) > 3 OR ('0' || right(part, 3))::INT > 255)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"len({_DIGITS}) BETWEEN 9 AND 15"),
}, by_kind=True)
