"""What the driver holds while it learns the partitions."""

import tracemalloc

import numpy as np

from pathwatch.llm import neighbours


def test_memory_is_not_quadratic_in_the_sample():
    x = np.random.default_rng(7).normal(size=(6000, 4))
    tracemalloc.start()
    try:
        near = neighbours.nearest_of(x, 12)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 120e6  # all distances at once: 288e6
    for i in (0, 17, 5999):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert set(near[i]) == set(np.argsort(d)[:12])


def test_partitions_and_router_do_not_depend_on_the_rows_at_once(monkeypatch):
    x = np.random.default_rng(8).normal(size=(700, 6))
    a = neighbours.learn(x, 10_000)
    monkeypatch.setattr(neighbours, "CELLS", 2000)
    b = neighbours.learn(x, 10_000)
    assert a.parts > 1 and a.probes == b.probes and all(np.allclose(p, q) for p, q in zip(a.layers, b.layers))
