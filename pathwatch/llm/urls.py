"""URL filters: pattern rules under their rarest literal token; a URL's tokens fetch the rules whose regular expressions run.

Built-in functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwatch.session import written

#: (action, host, path): the rules whose text is reported. A rule fits its host and all subdomains.
HOST_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: (action, pattern): what decides where no host rule fits; without a pattern a page is allowed. Patterns ignore the case of A-Z.
#: ``*`` is anything, ``^`` a separator or an end, a leading ``||`` the begin of a host or of one of its labels.
PATTERNS = [
    ("block", "^login^"), ("block", "^logout^"), ("block", "^signup^"), ("block", "^cart^"), ("block", "^checkout^"), ("block", "^wp-admin^"), ("block", "^cgi-bin^"),
    ("block", "^sessionid="), ("block", "^phpsessid="), ("block", "^utm_source="), ("block", "^calendar^*^page="), ("block", "||ads."), ("block", "||tracker."), ("allow", "||docs.*^login^"),
]
#: Index rows (a token and its rule) up to which they are broadcast, at most some 300 bytes each; beyond it Spark shuffles both sides.
BROADCAST = 100_000
RULES = "rule string, action string, host_rule boolean, length int, host_length int, regex string, tokens array<string>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HOST, _REST = r"://([^/?#]*)", r"(?s)://[^/?#]*(.*)"


def regex_of(pattern: str) -> str:
    """The regular expression of a pattern, to be searched for in an address (what follows ``://``)."""
    head, body = (r"^(?:[^/?#]*\.)?", pattern[2:]) if pattern.startswith("||") else ("", pattern)
    parts = {"*": r"(?s:.*)", "^": r"(?:[^A-Za-z0-9_.%-]|^|\z)"}
    return head + "".join(parts.get(c) or re.escape(c) for c in body)


def tokens_of(pattern: str) -> list[str]:
    """The literal tokens that every address holds in which the pattern matches; both of their ends must be fixed."""
    text = pattern.lower()
    body = text[2:] if text.startswith("||") else text
    fixed = lambda at: body[at] != "*" if 0 <= at < len(body) else at < 0 and text.startswith("||")
    return sorted({m[0] for m in re.finditer("[a-z0-9]+", body) if fixed(m.start() - 1) and fixed(m.end())})


def rule_table(spark: SparkSession, hosts: list = HOST_RULES, patterns: list = PATTERNS) -> DataFrame:
    """The rules as a table. A rule without a whole literal token is under the empty one, which every address has."""
    rows = [(f"{host}{path}", action, True, len(host) + len(path), len(host), regex_of(f"||{host}{path}"), tokens_of(f"||{host}{path}") or [""]) for action, host, path in hosts]
    rows += [(p, action, False, len(p), 0, regex_of(p), tokens_of(p) or [""]) for action, p in patterns]
    return spark.createDataFrame(rows, RULES)


def small(c: Column) -> Column:
    """A-Z in small letters, all else as it is."""
    return F.translate(c, _UPPER, _LOWER)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, in small letters, and what follows it. Null, or without ``://``: both empty."""
    u = F.coalesce(url, F.lit(""))
    return small(F.regexp_extract(u, _HOST, 1)), F.regexp_extract(u, _REST, 1)


def token_index(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Each rule under the one of its tokens that fewest addresses have (ties: the smaller one).

    ``hits``: a row for each address and token of it that some rule has. They are counted with partial aggregation.
    """
    seen = hits.groupBy("token").agg(F.count("*").alias("n"))
    each = rules.withColumn("token", F.explode_outer("tokens")).join(seen, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    columns = [c for c in rules.columns if c != "tokens"]
    return each.groupBy(*columns).agg(F.min(F.struct("n", "token")).alias("rarest")).select(*columns, F.col("rarest.token").alias("token"))


def decided(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(address, host_rule, pattern): the best rule of either kind, for the addresses in which one matches.

    The longest rule wins; ties go to the longer host, then to the greater text. An address meets only the rules under
    its own tokens. Addresses are distinct, so one that very many pages have is looked at once.
    """
    known = rules.count()
    near = (lambda df: F.broadcast(df)) if known <= BROADCAST else (lambda df: df)
    low = small(F.col("address"))
    # outer: an inferred filter would cut the address twice
    tokens = addresses.select("address", F.explode_outer(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))))).alias("token"))
    hits = written(tokens.join(near(rules.select(F.explode("tokens").alias("token")).distinct()), "token"), "url_tokens")
    index = written(token_index(hits, rules), "url_rules")
    text = F.when(F.col("host_rule"), F.col("address")).otherwise(low)
    fits = hits.join(near(index), "token").where(F.regexp_like(text, F.col("regex")))
    best = lambda which: F.max(F.when(which, F.struct("length", "host_length", "rule", "action")))
    return fits.groupBy("address").agg(best(F.col("host_rule")).alias("host_rule"), best(~F.col("host_rule")).alias("pattern"))


def judge(pages: DataFrame, rules: DataFrame | None = None, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern) for every row of ``pages``.

    rule: the longest host rule that fits, else null; it decides. Elsewhere the longest pattern decides (``pattern``),
    and without one the page is allowed. Null urls and those without ``://`` have an empty host and path, and fit no
    host rule. Null ids and repeated rows are kept; very long urls are looked at whole; other columns are not read; an
    empty table gives none. Without rules everything is allowed.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    host, rest = parts(F.col(url))
    own = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), rest.alias("rest")).withColumn("address", F.concat("host", "rest"))
    found = written(decided(own.select("address").distinct(), rules), "url_verdicts")
    out = own.join(found, "address", "left")
    verdict = F.coalesce(F.col("host_rule.action"), F.col("pattern.action"), F.lit("allow"))
    return out.select("page_id", "host", F.regexp_extract("rest", "^[^?#]*", 0).alias("path"), F.col("host_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("pattern.rule").alias("pattern"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql() -> str:
    """The same in SQL, each url against each rule."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = [f"({quote(h + p)}, {quote(a)}, true, {len(h) + len(p)}, {len(h)}, {quote(regex_of(f'||{h}{p}'))})" for a, h, p in HOST_RULES]
    rows += [f"({quote(p)}, {quote(a)}, false, {len(p)}, 0, {quote(regex_of(p))})" for a, p in PATTERNS]
    fit = lambda which: f"arg_max(rule, (length, host_length, rule)) FILTER (WHERE {which})"
    return f"""WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
    p AS (SELECT r, page_id, translate(regexp_extract(url, '{_HOST}', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(url, '{_REST}', 1) AS rest FROM u),
    rules(rule, action, host_rule, length, host_length, regex) AS (VALUES {', '.join(rows)}),
    d AS (SELECT DISTINCT host || rest AS address FROM p),
    m AS (SELECT address, rules.* FROM d JOIN rules ON regexp_matches(CASE WHEN host_rule THEN address ELSE translate(address, '{_UPPER}', '{_LOWER}') END, regex)),
    b AS (SELECT address, {fit('host_rule')} AS rule, {fit('NOT host_rule')} AS pattern, {fit('host_rule').replace('(rule', '(action', 1)} AS hard, {fit('NOT host_rule').replace('(rule', '(action', 1)} AS soft FROM m GROUP BY address)
    SELECT page_id, host, regexp_extract(rest, '^[^?#]*') AS path, rule, coalesce(hard, soft, 'allow') AS verdict, pattern FROM p LEFT JOIN b ON address = host || rest"""


OP13_SQL = _sql()
