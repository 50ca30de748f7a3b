"""The pipeline's stages on odd tables: empty, nulls, very long texts, clashing names, text in no language."""

import random

import pytest

import corpus_pipeline as pipeline
from pathwatch.llm import pii, secrets

from tests.conftest import DATA

CLASHING = ["_row", "row", "all", "key", "found", "_gone", "_guess", "_stay_id", "fp", "blob", "findings", "id", "ids"]
STAGES = dict(pipeline.STAGES)


def with_clashes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return docs.selectExpr("*", *[f"'mine' AS `{c}`" for c in CLASHING])


@pytest.mark.parametrize("name", [k for k in STAGES if k != "bpe_encode"])
def test_clashing_columns_stay(spark, name):
    docs = with_clashes(spark)
    left = STAGES[name](spark, docs, DATA)
    assert left.columns == docs.columns and left.count() > 0
    assert left.select(CLASHING).distinct().count() == 1
    plain = STAGES[name](spark, docs.drop(*CLASHING), DATA)
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    assert rows(left) == rows(plain)


@pytest.mark.parametrize("name", STAGES)
def test_empty_nulls_and_long_texts(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert STAGES[name](spark, docs.limit(0), DATA).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (10**6, "the words of a very long text and others " * 20000, None, None, None), (10**6 + 3, " \t", None, "s", 3)], docs.schema)
    got = {r.doc_id for r in STAGES[name](spark, docs.limit(150).unionByName(odd), DATA).select("doc_id").collect()}
    assert 10**6 in got
    if name == "language_id":
        assert not {None, 10**6 + 1, 10**6 + 3} & got


def test_text_in_no_language_goes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    g = random.Random(8)
    noise = [(10**6 + k, "".join(chr(g.randrange(33, 0x250)) for _ in range(600)), None, "s", 600) for k in range(20)]
    real = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    left = {r.doc_id for r in STAGES["language_id"](spark, docs.unionByName(spark.createDataFrame(noise, docs.schema)), DATA).select("doc_id").collect()}
    assert not [i for i, *_ in noise if i in left]
    assert real.where(~real.doc_id.isin(*left)).count() <= 2


def test_many_matches_in_one_text(spark):
    """Time in proportion to the matches: with a step for each pair this takes hours."""
    n = 4000
    text = "card 4111 1111 1111 1111, tel +1 555 123 4567, token=abcdefgh12 é " * n
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = pii.detect(docs).first().spans
    assert sum(s.kind == "card" for s in spans if s.base) == n and sum(s.kind == "phone" for s in spans if s.base) == n
    assert text[spans[-1].start : spans[-1].end] == "+1 555 123 4567"
    assert secrets.redact(docs).first().text == text.replace("token=abcdefgh12", "[secret]")
