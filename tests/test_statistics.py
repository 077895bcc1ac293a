import itertools
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlab.functions import pvalues as P
from skeinlab.operators import twosample as S
from skeinlab.operators.prefix import order_statistics, running_totals

KEYS = ["domain", "model", "metric"]


def test_exact_mann_whitney_by_enumeration():
    n, m = 4, 5
    us = Counter(sum(c) - n * (n - 1) / 2 for c in itertools.combinations(range(n + m), n))
    for u in range(n * m + 1):
        want = min(1.0, 2 * sum(v for k, v in us.items() if k >= max(u, n * m - u)) / sum(us.values()))
        assert P.mwu_exact(u, n, m) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n,m", [(5, 4), (3, 6), (4, 4)])
def test_exact_kolmogorov_by_enumeration(n, m):
    ds = []
    for c in itertools.combinations(range(n + m), n):
        i = j = d = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in c else (i, j + 1)
            d = max(d, abs(i / n - j / m))
        ds.append(d)
    for d in set(ds):
        assert P.ks_exact(d, n, m) == pytest.approx(sum(x >= d - 1e-12 for x in ds) / len(ds), abs=1e-9)


def test_p_value_edges():
    assert P.mwu_p(5, 0, 3, 0) != P.mwu_p(5, 0, 3, 0)
    assert P.mwu_p(8, 4, 4, 504.0) == 1.0
    assert P.ks_p(0.0, 5, 5) == 1.0
    assert P.ks_limit(0.9, 500, 500) < 1e-12
    assert abs(P.ks_limit(0.06, 1500, 1500) - P.ks_exact(0.06, 1500, 1500)) < 0.005


def brute(real, sim):
    u = sum((r > s) + 0.5 * (r == s) for r in real for s in sim)
    grid = sorted({*real, *sim})
    gap = [abs(np.mean(np.array(real) <= v) - np.mean(np.array(sim) <= v)) for v in grid]
    return u, max(gap), sum(g * (b - a) for g, a, b in zip(gap, grid, grid[1:]))


def table(spark, cells):
    rows = [("d", m, "x", float(v)) for m, vs in cells.items() for v in vs]
    return S.ordered(S.sides(spark.createDataFrame(rows, "domain string, model string, metric string, value double")), KEYS)


@pytest.mark.parametrize("seed", range(3))
def test_distances_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    cells = {"real": [rng.randrange(12) / 4 for _ in range(40)], "a": [rng.randrange(15) / 4 for _ in range(25)], "b": [rng.random() for _ in range(3)]}
    run = table(spark, cells).cache()
    for r in S.distances(run, KEYS).collect():
        u, ks, w = brute(cells["real"], cells[r.model])
        assert (r.u, r.ks, r.wasserstein) == pytest.approx((u, ks, w))
        assert r.cliffs_delta == pytest.approx(2 * u / (len(cells["real"]) * len(cells[r.model])) - 1)
    for r in S.quantile_error(run, KEYS, S.GRID_21).collect():
        g = np.array(S.GRID_21)
        assert r.quantile_error == pytest.approx(np.mean(np.abs(np.quantile(cells["real"], g) - np.quantile(cells[r.model], g))))
    dev = S.deviations(run, KEYS)
    med = np.median(cells["real"])
    for r in S.empirical_p(dev, KEYS).collect():
        want = (sum(abs(x - med) >= r.deviation - 1e-12 for x in cells["real"]) + 1) / (len(cells["real"]) + 1)
        assert r.p == pytest.approx(want)


def test_running_totals_over_partitions(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else "cold", float(i), rng.randrange(1, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, value double, n long")
    run = running_totals(df, ["k"], "value", ["n"], partitions=7)
    for k in ("hot", "cold"):
        mine = sorted((v, n) for x, v, n in rows if x == k)
        got = sorted((r.value, r.before_n, r.next, r.total_n) for r in run.collect() if r.k == k)
        before = np.cumsum([0] + [n for _, n in mine])
        assert got == [(v, before[i], mine[i + 1][0] if i + 1 < len(mine) else None, before[-1]) for i, (v, _) in enumerate(mine)]
        q = order_statistics(run.where(f"k = '{k}'"), ["k"], "value", "n", [0.0, 0.3, 1.0]).collect()
        flat = np.repeat([v for v, _ in mine], [n for _, n in mine])
        assert {r.prob: pytest.approx(r.q) for r in q} == {p: np.quantile(flat, p) for p in (0.0, 0.3, 1.0)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=9), st.lists(st.integers(0, 9), min_size=1, max_size=9))
def test_wasserstein_in_memory(a, b):
    assert S.wasserstein(np.array(a, float), np.array(b, float)) == pytest.approx(brute(a, b)[2])


def test_bad_values_and_one_sided_groups(spark):
    t = spark.createDataFrame([("t", "d", "real", "nan"), ("t", "d", "real", "1e400"), ("__summary_mean__", "d", "real", "3"), ("t", "d", "sim", ""), ("t", "d", "real", "-0.0")], "thread_id string, domain string, model string, self_bleu_4 string")
    rows = S.metric_values(t, ["domain", "model"]).collect()
    assert [(r.model, r.metric, str(r.value)) for r in rows] == [("real", "self_bleu_4", "0.0")]
    assert S.distances(table(spark, {"real": [1, 2]}), KEYS).isEmpty()


def test_bootstrap_of_every_domain(spark):
    from skeinlab.plans.metric_queries import bootstrap_interval
    from skeinlab.operators.twosample import bootstrap_reduction

    rng = np.random.default_rng(3)
    sides = {(d, s): np.round(rng.normal(m, 1, 40), 1) for d, at in (("x", (0, 3, 1)), ("y", (0, 1, 3))) for s, m in zip(("real", "before", "after"), at)}
    rows = [(d, "m", s, float(v)) for (d, s), vs in sides.items() for v in vs] + [("z", "m", "real", 1.0)]
    got = {r.domain: (r.low, r.high) for r in bootstrap_reduction(spark.createDataFrame(rows, "domain string, metric string, side string, value double"), ["m"]).collect()}
    assert got.pop("z") == (None, None)
    for d, (low, high) in got.items():
        real, before, after = (sides[d, s] for s in ("real", "before", "after"))
        draw = lambda v: rng.choice(v, len(v))
        want = np.percentile([S.wasserstein(r := draw(real), draw(before)) - S.wasserstein(r, draw(after)) for _ in range(4000)], [2.5, 97.5])
        assert np.allclose((low, high), want, atol=0.15)
    found = bootstrap_interval(spark, "/root/testdata/sf0.001")
    assert found.select("domain").distinct().count() > 1
