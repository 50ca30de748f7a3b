"""The pipeline's recognizer: every text takes part, and its limit is the exact order statistic of all held-out texts."""

import numpy as np

import corpus_pipeline as pipeline
from pathwatch.llm import language

from tests.conftest import DATA


def test_every_text_takes_part(spark, monkeypatch):
    monkeypatch.setattr(language, "FIRST", 1 << 16)  # several blocks
    monkeypatch.setattr(language, "GROWTH", 2)
    monkeypatch.setattr(language, "EACH_TASK", 1 << 17)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r for r in docs.collect() if r.lang is not None and r.text is not None and any(c.isalpha() for c in r.text)]
    known = language.fit_recognizer(docs)
    learned = [r for r in rows if language.crc_fold(r.doc_id) != 0]
    assert len(language.blocks(sum(len(r.text.encode()) for r in learned))) > 1
    assert known.windows == sum(len(language.windows(r.text.encode())) for r in learned)
    held = [r for r in rows if language.crc_fold(r.doc_id) == 0]
    assert known.held_out == len(held) > 0
    noise = sorted(language.steps(known.net.means([r.text.encode() for r in held])[:, -1]))
    assert abs(known.most - max(language.GRID // 2, noise[len(held) - 1 - int(0.001 * len(held))])) <= 1
    guessed = known.net.means([r.text.encode() for r in held])[:, :-1].argmax(axis=1)
    assert np.mean([known.net.languages[k] == r.lang for k, r in zip(guessed, held)]) > 0.97
    left = pipeline.language_id(spark, docs, DATA)
    assert left.count() >= 0.99 * len(rows)


def test_blocks_are_all_places():
    for size in (1, 10**6, 2**22, 2**22 + 1, 10**9, 10**11):
        made = language.blocks(size)
        assert made[0][0] == 0 and made[-1][1] == language.PLACES and all(a[1] == b[0] for a, b in zip(made, made[1:]))
        assert all(a < b and (b - a) * size / language.PLACES / tasks < 2 * language.EACH_TASK + language.FIRST for a, b, tasks in made)


def test_limit_is_exact(spark):
    g = np.random.default_rng(1)
    for scores in ([], [7], [600_000] * 30, g.integers(0, 1_000_001, 3000).tolist(), [*range(900_000, 900_500)] * 2 + [3] * 2000):
        df = spark.createDataFrame([(int(x),) for x in scores], "score long")
        for lost in (0.0, 0.001, 0.01, 0.3):
            most, n = language.limit(df, lost)
            above = lambda t: sum(x > t for x in scores)
            assert n == len(scores) and above(most) <= lost * n
            assert most == 500_000 or above(most - 1) > int(lost * n)
