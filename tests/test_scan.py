"""Blocked recurrences against one uninterrupted pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.operators import filters, scan
from sigflow.plans.signal import FLOAT_SOS

RNG = np.random.default_rng(8)


@pytest.mark.parametrize("length", [1, 7, 64, 1000])
@pytest.mark.parametrize("parts", [1, 6])
def test_blocks_give_the_whole_signal(spark, length, parts):
    signals = {k: RNG.normal(size=n) for k, n in enumerate((1, 63, 64, 65, 1500))}
    rows = [(k, b, x[b * length : (b + 1) * length].tolist()) for k, x in signals.items() for b in range(-(-len(x) // length))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "key long, block long, x array<double>").repartition(3)
        got = sorted(scan.filter_blocks(df, FLOAT_SOS, "key").collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k, x in signals.items():
        y = np.concatenate([r.y for r in got if r.key == k])
        assert np.allclose(y, filters.sos_float(x[None], FLOAT_SOS)[0], atol=1e-9)


def test_a_signal_over_many_tasks(spark):
    """Half a million samples of one signal: no task holds more than a few hundred blocks, and the registers pass through all parts."""
    n, length = 500_000, 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        wave = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda t: F.sin((F.col("id") * length + t) * 0.013) + F.cos((F.col("id") * length + t) * 1.7))
        df = spark.range(n // length).select(F.lit(1).cast("long").alias("key"), F.col("id").alias("block"), wave.alias("x"))
        out = scan.filter_blocks(df, FLOAT_SOS, "key")
        got = np.concatenate([r.y for r in out.orderBy("block").collect()])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    t = np.arange(n)
    x = np.sin(t * 0.013) + np.cos(t * 1.7)
    want = scan.filter_from(x[None], FLOAT_SOS, np.zeros((1, 4)))[0][0]
    assert np.allclose(got, want, atol=1e-8)


def test_ragged_empty_and_null_keys(spark):
    rows = [(None, 0, [1.0, 2.0]), (None, 5, [3.0]), (2, 0, []), (2, 1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "key long, block long, x array<double>")
    got = {(r.key, r.block): r.y for r in scan.filter_blocks(df, FLOAT_SOS, "key").collect()}
    joined = filters.sos_float(np.array([[1.0, 2.0, 3.0]]), FLOAT_SOS)[0]
    assert np.allclose(got[None, 0] + got[None, 5], joined) and got[2, 0] == []
    assert scan.filter_blocks(df.limit(0), FLOAT_SOS, "key").count() == 0


def test_rows_are_numbered_over_partitions(spark):
    rows = [(k % 3 if k % 7 else None, int(v)) for k, v in enumerate(RNG.permutation(2000))]
    df = spark.createDataFrame(rows, "key long, v long").repartition(5)
    got = scan.numbered(df, "key", ["v"]).collect()
    for key in (None, 0, 1, 2):
        mine = sorted(v for k, v in rows if k == key)
        assert sorted((r.v, r.k) for r in got if r.key == key) == [(v, i) for i, v in enumerate(mine)]
    blocks = scan.cut_signals(df, "key", ["v"], "v", 50).collect()
    assert all(len(r.x) <= 50 and r.x == sorted(r.x) for r in blocks) and sum(len(r.x) for r in blocks) == 2000
