"""Base phone numbers whose digits lie far apart."""

from pathwatch.llm import pii


def test_base_phone_with_wide_separators(spark):
    texts = ["Call +4   1   2   3   4   5   6   7   8   9 now", "Call +4 (((1)))   2...3---4   5   6   7   8   9 now"]
    got = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert [(s.kind, s.base, t[s.start : s.end]) for s in got[k] if s.base] == [("phone", True, t[5:-4])]
