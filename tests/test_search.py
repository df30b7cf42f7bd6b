"""Budget curves and samples of large grids against brute force."""

import numpy as np
import pytest

from sigflow.operators import search

RNG = np.random.default_rng(9)


def test_budget_curve(spark):
    runs = [(int(s) if s < 6 else None, int(p), float(a)) for s, p, a in zip(RNG.integers(0, 7, 400), RNG.integers(0, 5000, 400), RNG.random(400).round(3))]
    runs += [(8, 100, 0.0), (8, 4000, None), (9, 10**12, 0.5), (8, None, 0.9)]
    budgets = sorted({0, 1, 4999, 10**12, 10**13, *map(int, RNG.integers(0, 6000, 300))})
    df = spark.createDataFrame(runs, "subject int, n_params long, accuracy double").repartition(5)
    got = {r.budget: r for r in search.budget_curve(df, spark.createDataFrame([(b,) for b in budgets] * 2, "budget long")).collect()}
    assert sorted(got) == budgets
    subjects = {s for s, _, _ in runs if s is not None}
    for b in budgets:
        best = [max([0.0, *(a for s, p, a in runs if s == k and p is not None and a is not None and p <= b)]) for k in subjects]
        assert abs(got[b].mean_best - np.mean(best)) < 1e-9 and abs(got[b].std_best - np.std(best)) < 1e-6


def test_curve_joins_no_budgets(spark):
    df = spark.createDataFrame([(1, 5, 0.5)], "subject int, n_params long, accuracy double")
    plan = search.budget_curve(df, spark.range(100).withColumnRenamed("id", "budget"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert search.budget_curve(df.limit(0), spark.range(3).withColumnRenamed("id", "budget")).count() == 3


@pytest.mark.parametrize("lengths", [(1,), (2, 3), (7, 5, 3), (64, 64), (1, 1, 9)])
def test_a_sample_is_a_permutation(lengths):
    g = search.GridSample(3, **{f"v{k}": list(range(n)) for k, n in enumerate(lengths)})
    s = g.settings(np.arange(g.size))
    assert sorted(s.tolist()) == list(range(g.size))
    d = g.digits(s)
    assert all(((0 <= x) & (x < n)).all() for x, n in zip(d, lengths)) and len(set(zip(*(x.tolist() for x in d)))) == g.size


def test_a_sample_of_a_huge_grid_is_even():
    g = search.GridSample(5, **{f"v{k}": list(range(1000)) for k in range(4)})
    s = g.settings(np.arange(200_000))
    assert len(np.unique(s)) == 200_000 and s.max() < 10**12
    for d in g.digits(s):
        count = np.bincount(d, minlength=1000)
        assert ((count - 200) ** 2 / 200).sum() < 1200  # chi-squared of 999 degrees of freedom
    other = search.GridSample(6, **{f"v{k}": list(range(1000)) for k in range(4)}).settings(np.arange(1000))
    assert (other != s[:1000]).mean() > 0.99


def test_sampled_runs(spark):
    got = search.sampled_runs(spark, 50, 2, h=[8, 16, 32], act=["relu", "logistic"], c=[0.1, 1.0]).collect()
    assert len(got) == 12 and len({(r.h, r.act, r.c) for r in got}) == 12 and got[0].run == 0
    few = search.sampled_runs(spark, 1000, 2, **{f"v{k}": [f"{i}" for i in range(100)] for k in range(9)})
    assert few.distinct().count() == 1000
    with pytest.raises(ValueError):
        search.GridSample(1, **{f"v{k}": list(range(1000)) for k in range(7)})
    with pytest.raises(Exception, match="beyond the grid"):
        search.GridSample(1, v=[1, 2]).of(spark.range(5), "id").collect()
