"""The pipeline's stages, one by one, on the smallest tables."""

import re

import corpus_pipeline as pipeline
from pathwatch.llm import decontaminate, simhash

from tests.conftest import DATA


def test_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "simhash_near_dedup", "decontamination", "secret_scan", "bpe_encode"]
    kept = {}
    for name, stage in pipeline.STAGES:
        before, docs = docs, pipeline.written(stage(spark, docs, DATA), name)
        kept[name] = (before, docs)
        if name != "bpe_encode":
            assert docs.columns == before.columns
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    before, after = kept["language_id"]
    assert len(ids(after)) >= 0.99 * len(ids(before))  # all of these have a language
    before, after = kept["simhash_near_dedup"]
    fp = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
    root = {i: i for i in fp}
    for _ in fp:
        new = {i: min(root[j] for j in fp if (fp[i] ^ fp[j]).bit_count() <= 3) for i in fp}
        if new == root:
            break
        root = new
    assert ids(after) == {i for i in fp if root[i] == i}
    before, after = kept["decontamination"]
    leaks = {r.doc_id for r in decontaminate.contaminated(before, spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert leaks and ids(after) == ids(before) - leaks
    before, after = kept["secret_scan"]
    text = {r.doc_id: r.text for r in after.collect()}
    token = re.compile(r"(?i:token)\s*=\s*\"?[A-Za-z0-9+/_.=-]{8,}|[0-9a-f]{32,}")
    for r in before.collect():
        assert not token.search(text[r.doc_id])
        if not token.search(r.text):
            assert "[secret]" in text[r.doc_id] or text[r.doc_id] == r.text
    before, after = kept["bpe_encode"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: list(r.ids) for r in after.collect()}
    assert all(got[r.doc_id] == t.encode(r.text, add_special_tokens=False).ids for r in before.collect())
