"""Which bins of fingerprints have to meet."""

import numpy as np

from pathwatch.llm import simhash


def test_near_bins_against_all_pairs(spark):
    g = np.random.default_rng(4)
    counts = np.unique(g.integers(0, 17, size=(300, 4)), axis=0)
    counts = np.concatenate([counts, g.integers(1, 60, size=(len(counts), 1))], axis=1)
    place, boxes, chunks = simhash.cut_tiles(counts, 40)
    assert [chunks[k] for k in range(len(boxes))] == [place[place[:, 0] == k, 1].max() for k in range(len(boxes))]
    got = {tuple(r) for r in simhash.near_bins(spark, boxes, chunks, 3).collect()}
    apart = lambda a, b: np.maximum(0, np.maximum(boxes[b, :4] - boxes[a, 4:8], boxes[a, :4] - boxes[b, 4:8])).sum()
    assert got == {(a, b, chunks[a], chunks[b]) for a in range(len(boxes)) for b in range(a, len(boxes)) if abs(boxes[a, 8] - boxes[b, 8]) <= 3 and apart(a, b) <= 3}
    assert simhash.near_bins(spark, *simhash.cut_tiles(np.empty((0, 5), np.int64), 40)[1:], 3).count() == 0
