"""Nearest neighbours of all rows against brute force, and the share of blocks that meet."""

import numpy as np
import pytest

from sigflow.operators import neighbours
from sigflow.operators.neighbours import NearestOfAll

RNG = np.random.default_rng(41)


def brute(ids, x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d[ids[:, None] == ids[None, :]] = np.inf
    out = {}
    for i, row in zip(ids.tolist(), d):
        order = np.lexsort((ids, row))[:k]
        out[i] = [int(ids[j]) for j in order if np.isfinite(row[j])]
    return out


def found(n):
    out = {}
    for r in sorted(n.neighbours().collect(), key=lambda r: (r.key, r.rank)):
        out.setdefault(r.key, []).append(r.neighbour)
    return out


@pytest.mark.parametrize("kind", ["even", "clusters", "ties"])
@pytest.mark.parametrize("rows", [16, 100])
def test_neighbours_are_exact(spark, kind, rows):
    n = 400
    x = {"even": RNG.normal(size=(n, 8)), "clusters": RNG.normal(size=(n, 8)) * 0.05 + RNG.normal(size=(10, 8))[RNG.integers(0, 10, n)] * 5, "ties": RNG.integers(0, 3, (n, 3)).astype(float)}[kind]
    ids = RNG.permutation(10 * n)[:n]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)] + [(None, [0.0] * x.shape[1]), (10**6, None)], "key long, x array<double>").repartition(5)
    got = NearestOfAll(df, "key", "x", 5, pivots=8, rows=rows)
    assert found(got) == brute(ids, x, 5)
    if kind == "clusters" and rows == 16:
        assert got.share() < 0.3


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 0.0])], "key long, x array<double>")
    assert found(NearestOfAll(df, "key", "x", 5)) == {1: [2, 3], 2: [1, 3], 3: [2, 1]}
    assert NearestOfAll(df.limit(0), "key", "x", 5).neighbours().count() == 0
    assert found(NearestOfAll(df.limit(1), "key", "x", 2)) == {}


@pytest.mark.parametrize("kind", ["floats", "whole", "large"])
def test_panels_travel_not_blocks(spark, kind, monkeypatch):
    """Small blocks that all meet do not travel one by one; several panels a task, in each width of numbers, give the same rows."""
    n = 300
    x = {"floats": RNG.normal(size=(n, 6)), "whole": RNG.integers(-2, 3, (n, 6)).astype(float), "large": RNG.integers(-(10**6), 10**6, (n, 6)).astype(float)}[kind]
    ids = RNG.permutation(n) - 50
    ids[7] = ids[8]  # a key twice: neither row is the other's neighbour
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "key long, x array<double>").repartition(3)
    whole = NearestOfAll(df, "key", "x", 3, pivots=4, rows=8)
    assert whole.pairs.count() < 40
    monkeypatch.setattr(neighbours, "PANEL_BYTES", 40 * 6 * 8)
    monkeypatch.setattr(neighbours, "TILE", (20, 30))
    cut = NearestOfAll(df, "key", "x", 3, pivots=4, rows=8)
    assert cut.panels.count() > 7
    lone = np.setdiff1d(np.arange(n), [7, 8])
    want = brute(ids, x, 3)
    for got in (found(whole), found(cut)):
        assert {int(ids[k]): got[int(ids[k])] for k in lone} == {int(ids[k]): want[int(ids[k])] for k in lone}
        assert ids[7] not in got[int(ids[7])] and len(got[int(ids[7])]) == 6
