"""Means by key and generalised eigenvectors against NumPy and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.operators import means, spd

RNG = np.random.default_rng(12)


def spd_set(count, n):
    x = RNG.normal(size=(count, n, 2 * n))
    return x @ np.swapaxes(x, 1, 2) / n


def frame(spark, mats, keys, schema):
    return spark.createDataFrame([(*k, m.ravel().tolist()) for k, m in zip(keys, mats)], f"{schema}, m array<double>").repartition(5)


def test_means_of_several_keys(spark):
    """Two key columns, one with nulls; a key of one matrix, and one of very many."""
    mats = spd_set(300, 3)
    keys = [(k % 4 or None, "b" if k % 3 else None) if k < 290 else (9, "only" if k == 290 else "z") for k in range(300)]
    got = means.karcher_means(frame(spark, mats, keys, "g int, s string"), ["g", "s"], "m", 3).collect()
    assert {(r.g, r.s) for r in got} == set(keys) and len(got) == len(set(keys))
    for r in got:
        mine = mats[[k == (r.g, r.s) for k in keys]]
        mean = np.array(r["mean"]).reshape(3, 3)
        inv = spd.invsqrtm(mean)
        assert np.linalg.norm(spd.logm(inv @ mine @ inv).mean(0)) < 1e-7 and r.n == len(mine) and r.step < 1e-8
    for r in means.euclid_means(frame(spark, mats, keys, "g int, s string"), ["g", "s"], "m", 3).collect():
        assert np.allclose(np.array(r["mean"]).reshape(3, 3), mats[[k == (r.g, r.s) for k in keys]].mean(0))


def test_twenty_thousand_keys(spark, tmp_path):
    """Two or three random 2 x 2 matrices a key, made by Spark: the closed form of two, no tangent left of three, and keys leave the loop in different rounds."""
    u = lambda c: F.rand(c)
    df = spark.range(50_000, numPartitions=8).select((F.col("id") % 20_000).alias("key"), F.array(1 + u(1), u(2) - 0.5, u(2) - 0.5, 1 + u(3)).alias("m"))
    df.write.parquet(f"{tmp_path}/m")
    df = spark.read.parquet(f"{tmp_path}/m")
    out = means.karcher_means(df, ["key"], "m", 2, tol=1e-6)
    got = out.join(df.groupBy("key").agg(F.collect_list("m").alias("p")), "key").collect()
    assert len(got) == 20_000 and max(r.step for r in got) < 1e-6 and len({r.round for r in got}) > 1
    three = [r for r in got if r.n == 3]
    inv = spd.invsqrtm(np.array([r["mean"] for r in three]).reshape(-1, 1, 2, 2))
    assert np.abs(spd.logm(inv @ np.array([r.p for r in three]).reshape(-1, 3, 2, 2) @ inv).mean(1)).max() < 1e-6
    got = [r for r in got if r.n == 2]
    a, b = (np.array([r.p[k] for r in got]).reshape(-1, 2, 2) for k in (0, 1))
    da, db = np.sqrt(np.linalg.det(a)), np.sqrt(np.linalg.det(b))
    s = a / da[:, None, None] + b / db[:, None, None]
    want = np.sqrt(da * db / np.linalg.det(s))[:, None, None] * s
    assert np.abs(np.array([r["mean"] for r in got]).reshape(-1, 2, 2) - want).max() < 1e-5


def test_no_rows_and_no_keys(spark):
    df = frame(spark, spd_set(6, 2), [(1,)] * 6, "g int")
    assert means.karcher_means(df.limit(0), ["g"], "m", 2).count() == 0 and means.euclid_means(df.limit(0), [], "m", 2).count() == 0
    (r,) = means.karcher_means(df.withColumn("m", F.when(F.col("g") == 1, F.col("m"))), [], "m", 2).collect()
    assert r.n == 6
    short = means.karcher_means(df, ["g"], "m", 2, tol=0.0, rounds=2).collect()
    assert [s.round for s in short] == [2]


@pytest.mark.parametrize("n,pairs", [(2, 1), (6, 2)])
def test_pairs_of_classes(spark, n, pairs):
    mats = spd_set(8, n)
    keys = [(w, c) for w in (0, 1) for c in (1, 2, 5, 7)]
    df = spark.createDataFrame([(*k, m.ravel().tolist()) for k, m in zip(keys, mats)], "win int, label int, mean array<double>")
    rows = means.pair_filters(df, ["win"], "label", n, pairs).collect()
    of = dict(zip(keys, mats))
    assert len(rows) == 2 * 6 * 2 * pairs
    for r in rows:
        first, second, w = of[r.win, r.c1], of[r.win, r.c2], np.array(r.w)
        assert r.c1 < r.c2 and np.allclose(first @ w, r.value * (second @ w)) and np.isclose(w @ second @ w, 1) and w[np.abs(w).argmax()] > 0
    for win in (0, 1):
        value = np.sort(np.abs(np.linalg.eigvals(np.linalg.solve(of[win, 2], of[win, 1]))))
        got = [r.value for r in sorted(rows, key=lambda r: r.k) if (r.win, r.c1, r.c2) == (win, 1, 2)]
        assert np.allclose(got, [*value[:pairs], *value[n - pairs :]])
