"""Trained operators against plain forms of what they compute."""

import itertools

import numpy as np

from pathwatch.llm import language, toxicity


def loss(x, y, weight, w, cuts, l2):
    """The weighted likelihood of the grades, row by row."""
    sig = lambda z: 1 / (1 + np.exp(-z))
    total = 0.0
    for r in range(len(y)):
        ends = [0.0, *[sig(c - x[r] @ w) for c in cuts], 1.0]
        total -= weight[r] / weight.sum() * np.log(ends[y[r] + 1] - ends[y[r]])
    return total + l2 / 2 * (w**2).sum()


def test_ordinal_fit_is_a_maximum():
    g = np.random.default_rng(2)
    x = g.normal(size=(150, 2))
    z = x @ [1.0, -0.5] + g.logistic(size=150)
    y, weight = (z > 0).astype(int) + (z > 1), g.uniform(0.5, 2, 150)
    row, col = np.repeat(np.arange(150), 2), np.tile([0, 1], 150)
    w, cuts = toxicity.train(row, col, x.ravel(), y, weight, 2, steps=3000, rate=0.02, l2=1e-3)
    best = loss(x, y, weight, w, cuts, 1e-3)
    assert cuts[0] < cuts[1] and w[0] > 0 > w[1]
    for step in itertools.product((-0.03, 0, 0.03), repeat=4):
        if any(step):
            assert loss(x, y, weight, w + step[:2], cuts + step[2:], 1e-3) > best - 1e-6


def test_upper_grades_come_from_other_rows():
    g = np.random.default_rng(3)
    n = 300
    toxic = np.arange(n) % 3 == 0
    count = np.where(toxic, g.integers(1, 9, n), 0)  # of the word that toxic texts hold
    row, col = np.concatenate([np.arange(n)] * 2), np.repeat([0, 1], n)
    value = np.log1p(np.concatenate([count, g.integers(0, 9, n)])).astype(float)
    fold = np.arange(n) // 3 % toxicity.FOLDS
    upper = toxicity.upper_grade(row, col, value, toxic, np.ones(n), fold, 2)
    assert not upper[~toxic].any() and 0.3 < upper[toxic].mean() <= 0.5
    assert count[upper].min() >= np.median(count[toxic]) - 2
    # a fold whose others hold no toxic row has no upper grade
    assert not toxicity.upper_grade(row, col, value, toxic, np.ones(n), np.where(toxic, 0, 1), 2).any()


def test_pair_tables_are_the_convolution():
    g = np.random.default_rng(4)
    x = g.integers(0, 256, (5, 64)).astype(np.uint8)
    x[0], x[1, 10:] = 0, 0
    total, languages = language.FILTERS * len(language.WIDTHS), ["a", "b", "c"]
    net = language.Network(languages, [g.normal(size=(w, 256, language.FILTERS)).astype(np.float32) for w in language.WIDTHS], g.normal(size=total).astype(np.float32), g.normal(size=(total, 3)).astype(np.float32), g.normal(size=3).astype(np.float32))
    for row, got in zip(x, net.probabilities(x)):
        hot = np.eye(256)[row]
        h = [max((hot[at : at + len(w)] * w[:, :, k]).sum() for at in range(len(row) - len(w) + 1)) for w in net.filters for k in range(language.FILTERS)]
        z = np.maximum(np.array(h) + net.bias, 0) @ net.out + net.out_bias
        e = np.exp(z - z.max())
        assert np.allclose(got, e / e.sum(), atol=1e-4)
