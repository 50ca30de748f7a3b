"""Secret scanning over an incremental ledger of content-addressed blobs, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwatch.llm.spans import find_spans, let, listed, running, span_sql
from pathwatch.session import written

#: Kinds in order: version, pattern, a pattern whose group 1 must have 8 characters in the match, and the cheap sign without which a text has none.
#: The first three are the base rules; the others are public token formats.
RULES: dict[str, tuple[int, str, str, str]] = {
    "assign": (1, r"""(?:[pP][aA][sS][sS](?:[wW][oO][rR][dD]|[wW][dD])|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
               r"""^[A-Za-z_]++["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)$""", "[pP][aA][sS][sS][wW]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"),
    "access": (1, r"AKIA[A-Z0-9]{12,}+", "", "AKIA"),
    "hex": (1, r"[0-9a-f]{32,}+", "", "[0-9a-f]{32}"),
    "key_block": (1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "", "-----BEGIN "),
    "forge": (1, r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+", "", "gh[pousr]_"),
    "jwt": (1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "", "eyJ"),
    "chat": (1, r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{20,}+", "", "xox[abprs]-"),
}
BASE = ("assign", "access", "hex")
FINDING = "array<struct<start:int,rank:int,kind:string,end:int,first:int,last:int>>"


def rule_versions(rules: dict = RULES) -> list[str]:
    return [f"{k}@{v[0]}" for k, v in rules.items()]


def blob_id(text: Column) -> Column:
    """The content address: SHA-256 of the UTF-8 text, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def findings(text: Column, pending: Column, rules: dict = RULES) -> Column:
    """The findings of the pending rules in a text, ordered by start, then rule. Null texts have none."""
    each = []
    for rank, (kind, (version, pattern, value, sign)) in enumerate(rules.items()):
        hits = find_spans(text, pattern)
        if value:
            hits = _long_enough(hits, value)
        due = F.array_contains(pending, f"{kind}@{version}") & text.rlike(sign)
        each.append(F.when(due, _named(hits, rank, kind)).otherwise(F.array().cast(FINDING)))
    return F.array_sort(F.flatten(F.array(*each)))


def _named(hits: Column, rank: int, kind: str) -> Column:
    return F.transform(hits, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["first"].alias("first"), s["last"].alias("last"))).cast(FINDING)


def _long_enough(hits: Column, value: str) -> Column:
    return F.filter(hits, lambda s: F.char_length(F.regexp_extract(s["match"], value, 1)) >= 8)


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: dict = RULES) -> DataFrame:
    """Ledger rows (blob, rules, findings) for every blob of ``docs`` that a current rule version has not seen yet.

    A blob is scanned once, however many rows hold it, and only by the rule versions that the ledger lacks for it.
    Only texts that show a rule's sign are shuffled; map-side aggregation sends one copy from each task.
    """
    all_rules = F.array(*map(F.lit, rule_versions(rules)))
    blobs = docs.select(blob_id(F.col(text)).alias("blob"), F.col(text).alias("body"))
    if ledger is None:
        due = blobs.withColumn("pending", all_rules)
    else:
        seen = ledger.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = blobs.join(seen, "blob", "left").withColumn("pending", F.array_except(all_rules, F.coalesce("seen", F.array().cast("array<string>")))).drop("seen").where(F.size("pending") > 0)
    signs = "|".join(r[3] for r in rules.values())
    once = due.select("blob", "pending", F.when(F.col("body").rlike(signs), F.col("body")).alias("body")).groupBy("blob").agg(F.first("pending").alias("pending"), F.first("body").alias("body"))
    return once.select("blob", F.col("pending").alias("rules"), F.coalesce(findings(F.col("body"), F.col("pending"), rules), F.array().cast(FINDING)).alias("findings"))


def report(docs: DataFrame, ledger: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: dict = RULES) -> DataFrame:
    """(doc_id, findings) for every row of ``docs``: the ledger's findings of current rule versions, joined back by content."""
    current = F.array(*map(F.lit, rule_versions(rules)))
    kinds = F.transform(F.array_intersect("rules", current), lambda r: F.substring_index(r, "@", 1))
    found = ledger.where(F.size("findings") > 0).select("blob", F.filter("findings", lambda f: F.array_contains(kinds, f["kind"])).alias("findings")).where(F.size("findings") > 0)
    # a blob can have rows of several increments
    found = found.select("blob", F.explode("findings").alias("f")).distinct().groupBy("blob").agg(F.array_sort(F.collect_list("f")).alias("findings"))
    paths = docs.select(F.col(doc_id).alias("doc_id"), blob_id(F.col(text)).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", F.coalesce("findings", F.array().cast(FINDING)).alias("findings"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", rules: dict = RULES) -> tuple[DataFrame, DataFrame]:
    """The findings of every row of ``docs`` and the grown ledger.

    Null texts are the empty blob; repeated rows and null ids are kept; other columns are not read; an empty table has
    no findings. The increment is written before it is joined back, so nothing is scanned twice.
    """
    new = written(scan_new(docs, ledger, text, rules), "ledger")
    grown = new if ledger is None else ledger.select("blob", "rules", "findings").unionByName(new)
    return report(docs, grown, text, doc_id, rules), grown


def redact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with each found secret's characters replaced by ``[secret]``; rows and columns stay as they are.

    Overlapping findings are replaced once. The ledger is joined by content, so ids may repeat or be null.
    """
    new = written(scan_new(docs, None, text), "ledger")
    # all of a row's columns in one, so that no name can clash
    packed = docs.select(F.struct(*docs.columns).alias("row"), blob_id(F.col(text)).alias("blob"))
    joined = packed.join(new.where(F.size("findings") > 0).select("blob", "findings"), "blob", "left")
    body = F.col("row")[text]
    # pieces are cut by their places in bytes, which takes no search; ``upto`` is how far the findings so far reach
    piece = lambda raw, at, end: F.decode(F.substring(raw, at + 1, end - at), "UTF-8")

    def cut(s: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(s["upto"], i - 1)).otherwise(0)
        parts = F.transform(s["found"], lambda f, i: F.when(f["first"] < before(i), "").otherwise(F.concat(piece(s["raw"], before(i), f["first"]), F.lit("[secret]"))))
        return F.concat(F.array_join(parts, ""), piece(s["raw"], F.element_at(s["upto"], -1), F.octet_length(s["raw"])))

    upto = running(F.transform("findings", lambda f: f["last"]), F.greatest)
    cut = let(F.struct(F.col("findings").alias("found"), upto.alias("upto"), F.encode(body, "UTF-8").alias("raw")), cut)
    clean = F.when(F.col("findings").isNull(), body).otherwise(cut)
    return joined.select(*[clean.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, through a ledger that starts empty."""
    found, _ = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("findings", lambda f: f["rank"] < len(BASE))
    return found.select(
        "doc_id", *[_count(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("findings")).alias("spans"))


def _count(kind: str) -> Column:
    return F.size(F.filter("findings", lambda f: f["kind"] == kind))


def base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op4_secret_scan that SQL can express."""
    return op4_secret_scan(spark, sf_dir).drop("spans")


_NAME = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = _NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE_SQL = span_sql({
    "assign": (_ASSIGN, "len(regexp_extract(x, '" + _ASSIGN.replace("'", "''") + "', 1)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "len(x) >= 16"),
    "hex": ("[0-9a-f]{32,}", "true"),
}, by_kind=False)
