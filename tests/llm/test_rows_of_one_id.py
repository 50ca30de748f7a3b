"""The filtering stages decide by row: null ids, repeated rows, and one id with different texts."""

import numpy as np

from pathwatch.llm import decontaminate, simhash

SCHEMA = "doc_id long, text string, lang string"


def left(df):
    return sorted(((r.doc_id, r.text, r.lang) for r in df.collect()), key=str)


def test_keep_one_by_row(spark):
    a, b, c, d = "a b c d e", "q r s t u", "k l m n o", "v w x y z"
    rows = [(1, a, "en")] * 40 + [(2, a, "en"), (None, a, "en")]  # copies under one id, another id, none
    rows += [(2, b, "en")]  # unique, under the id of a copy
    rows += [(None, c, "en")] * 3 + [(None, c, "fr")]  # no id at all
    rows += [(5, d, "en"), (5, d, "fr"), (6, None, None), (6, None, None)]
    got = left(simhash.keep_one(spark.createDataFrame(rows, SCHEMA)))
    assert [(i, t) for i, t, _ in got] == sorted([(1, a), (2, b), (None, c), (5, d), (6, None)], key=str)
    assert set(got) <= set(rows) and got == left(simhash.keep_one(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)))


def test_without_benchmark_by_row(spark):
    item = " ".join(np.random.default_rng(14).choice([f"w{k}" for k in range(300)], 40))
    rows = [(1, item, "en"), (1, "clean text", "en"), (None, f"x {item}", "en"), (None, "clean too", "fr"), (3, None, "en"), (4, f"{item} y", "en"), (4, f"{item} y", "en")]
    items = spark.createDataFrame([(0, item)], "item_id long, text string")
    want = sorted([(1, "clean text", "en"), (None, "clean too", "fr"), (3, None, "en")], key=str)
    df = spark.createDataFrame(rows, SCHEMA)
    assert left(decontaminate.without_benchmark(df, items)) == want
    assert left(decontaminate.without_benchmark(df, items.limit(0))) == sorted(rows, key=str)
