"""Shapiro-Wilk on all samples of a link."""

import numpy as np
import pytest

from pathwatch.operators import references, statistics


def test_all_samples_count(spark):
    rng = np.random.default_rng(21)
    links = {
        "few": rng.normal(size=150), "skewed": rng.exponential(size=120), "steps": np.round(rng.normal(size=6000), 1),
        "large": rng.normal(size=7000) + 1000, "bent": np.round(rng.normal(size=5400) + 0.05 * rng.exponential(size=5400) ** 2, 2), "flat": np.ones(200), "short": rng.normal(size=96)}
    df = spark.createDataFrame([(k, "b", float(v)) for k, x in links.items() for v in x], "ip1 string, ip2 string, rtt_diff double")
    got = {r.ip1: r for r in references.normality(df).collect()}
    assert set(got) == set(links) - {"short"} and all(r.n == len(links[k]) for k, r in got.items())
    for k, r in got.items():
        p = float("nan") if r.p is None else r.p
        assert p == pytest.approx(statistics.shapiro_wilk(links[k]), rel=1e-6, abs=1e-12, nan_ok=True)


@pytest.mark.parametrize("n", [4, 5, 6, 11, 12, 50, 6000])
def test_sums_give_the_same(n):
    x = np.sort(np.random.default_rng(n).normal(size=n))
    m = [statistics.normal_scores(i, i + 1, n)[0] for i in range(n)]
    ss = statistics.normal_scores(0, n, n)[1]
    got = statistics.shapiro_of_sums(n, float(np.dot(m, x)), ss, float(((x - x.mean()) ** 2).sum()), x[0], x[1], x[-2], x[-1])
    assert got == pytest.approx(statistics.shapiro_wilk(x), rel=1e-6)
