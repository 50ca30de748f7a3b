"""Benchmark passages whose parts are in another order, against all windows by brute force."""

from collections import Counter

import numpy as np

from pathwatch.llm import decontaminate


def best(text, item):
    """The greatest similarity of all windows of the item's length."""
    t, i = text.lower().split(), item.lower().split()
    k = min(5, len(i))
    sh = lambda w: [tuple(w[x : x + k]) for x in range(len(w) - k + 1)]
    a, b, top = sh(t), Counter(sh(i)), 0.0
    m = len(i) - k + 1
    for s in range(max(1, len(a) - m + 1)):
        w = Counter(a[s : s + m])
        common = (w & b).total()
        top = max(top, common / (w.total() + m - common))
    return top


def test_all_windows(spark):
    rng = np.random.default_rng(13)
    words = [f"w{k}" for k in range(800)]
    some = lambda n: " ".join(rng.choice(words, n))
    swapped = lambda t, at: " ".join([*t.split()[at:], *t.split()[:at]])
    items = [some(60), some(100), some(200), some(3), "a b c d e f g h " * 8, some(100)]
    texts = []
    for t in items:
        half = len(t.split()) // 2
        texts += [t, f"{some(40)} {swapped(t, half)} {some(70)}", f"{swapped(t, half)} {some(9)}", f"{some(9)} {swapped(t, half)}", f"{some(7)} {swapped(t, half // 2)}"]
        texts += [" ".join(t.split()[:-4]), " ".join(t.split()[: half + 2]), f"{t} {some(3)} {swapped(t, half)}", t.replace(t.split()[1], "other")]
    texts += [some(300), items[0] + " " + items[0], "a b c d e f g h " * 20]
    got = decontaminate.contaminated(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = {(d, i): s for d, t in enumerate(texts) for i, x in enumerate(items) if (s := best(t, x)) >= 0.8}
    assert {(1, 0), (10, 1), (19, 2)} <= set(want)  # halves swapped
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got.collect()} == {k: round(s, 9) for k, s in want.items()}
