"""URL verdicts against every rule on every url, and the index itself."""

import re

from pyspark.sql import functions as F

from pathwatch.llm import urls

SCHEMA = "page_id long, url string, address string, rule string, host string, token string"
URLS = [
    None, "", "no scheme", "http://", "://", "https://com/", "https://com", "https://com?x=/", "https://x.COM/Login/", "https://example.com/en/1", "https://www.example.com/en/1", "https://a.www.example.com/en/",
    "https://example.com/EN/1", "https://notexample.com/en/1", "https://a.net/es/1?q=/fr/", "https://a.net/fr", "https://net/fr/x#y", "https://xnet/es/", "http://a.org/login", "http://a.org/Login?x", "http://a.org/xlogin/",
    "http://docs.a.org/login", "http://a.org/?utm_source=feed", "http://a.org/?xutm_source=feed", "http://ads.a.org/", "http://x.ads.a.org/", "http://loads.a.org/", "http://a.org/calendar/2020?page=3", "ftp://a.b://c.net/es/",
    "http://é.net/es/ü?İ", "http://a.net/es/\nx", "http://a.org/" + "x/" * 40000 + "wp-admin/",
]


def plain(url):
    m = re.search(r"://([^/?#]*)(.*)", url or "", re.S)
    host, rest = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    path = re.match("[^?#]*", rest)[0]
    hard = [(len(h) + len(p), len(h), h + p, a) for a, h, p in urls.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    low = re.sub("[A-Z]", lambda x: x[0].lower(), host + rest)
    soft = [(len(p), 0, p, a) for a, p in urls.PATTERNS if re.search(urls.regex_of(p).replace(r"\z", r"\Z"), low)]
    best = max(hard or soft or [(0, 0, None, "allow")])
    return host, path, max(hard)[2] if hard else None, best[3], max(soft)[2] if soft else None


def test_against_every_rule(spark):
    rows = [(k, u, "a", "r", "h", "t") for k, u in enumerate(URLS)] + [(None, URLS[9], "a", "r", "h", "t"), (3, URLS[9], "a", "r", "h", "t"), (3, URLS[9], "a", "r", "h", "t")]
    got = sorted(map(tuple, urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(((i, *plain(u)) for i, u, *_ in rows), key=str)
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[9][3:5] == ("example.com/en/", "block") and by[10][3:5] == ("www.example.com/en/", "allow") and by[8][3:5] == ("com/", "allow")
    assert by[18][3:5] == (None, "block") and by[21][3:5] == (None, "allow") and by[31][4] == "block"


def test_empty_tables_and_no_rules(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert urls.judge(none).count() == 0
    free = urls.judge(spark.createDataFrame([(1, "http://a.net/es/", "", "", "", "")], SCHEMA), urls.rule_table(spark, [], [])).collect()
    assert [tuple(r)[2:] for r in free] == [("/es/", None, "allow", None)]


def test_rules_are_under_their_rarest_whole_token(spark):
    assert urls.tokens_of("^utm_source=") == ["source", "utm"] and urls.tokens_of("||net/es/") == ["es", "net"] and urls.tokens_of("ads*x") == [] and urls.tokens_of("^a*b^") == []
    hits = spark.createDataFrame([("a", "net")] * 3 + [("a", "es")] * 2 + [("a", "fr")] * 4, "address string, token string")
    index = {r.rule: r.token for r in urls.token_index(hits, urls.rule_table(spark)).collect()}
    assert index["net/es/"] == "es" and index["net/fr/"] == "net" and index["com/"] == "com"


def test_rules_without_tokens_and_large_rule_tables(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST", 0)
    rules = urls.rule_table(spark, [("block", "net", "/e")], [("block", "*bad*")])
    rows = [(1, "http://a.net/es", "", "", "", ""), (2, "http://a.org/notbadly", "", "", "", ""), (3, "http://a.org/", "", "", "", "")]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got == {1: ("net/e", "block"), 2: (None, "block"), 3: (None, "allow")}


def test_no_python_on_the_main_path(spark):
    df = urls.judge(spark.createDataFrame([(1, "http://a.net/es", "", "", "", "")], SCHEMA))
    assert "Python" not in df._jdf.queryExecution().toString() and df.where(F.col("rule") == "net/es/").count() == 0
