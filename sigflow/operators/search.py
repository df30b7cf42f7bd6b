"""Hyper-parameter grids and the reports over search runs (subject, mode, run, accuracy, n_params)."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from sigflow.session import ship


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """Cross product of the listed values: small dimension tables."""
    tables = [spark.createDataFrame([(v,) for v in vs], [name]) for name, vs in values.items()]
    return reduce(lambda a, b: a.crossJoin(b), tables)


def grid_of(df: DataFrame, **columns: str) -> DataFrame:
    """Cross product of the distinct values that columns have: small dimension tables, each made by one combining aggregation."""
    tables = [df.select(F.col(c).alias(name)).distinct() for name, c in columns.items()]
    return reduce(lambda a, b: a.crossJoin(b), tables)


def random_runs(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def chosen_runs(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """(run, skipped, settings): the whole grid where ``n`` runs exhaust it, the surplus ones marked skipped; else ``n`` random settings."""
    size = df.count()
    picked = df if n >= size else random_runs(df, n, seed)
    runs = picked.withColumn("run", F.row_number().over(Window.orderBy(*df.columns)) - 1)  # a row a setting: few
    if n <= size:
        return runs.withColumn("skipped", F.lit(False))
    surplus = df.sparkSession.range(size, n).select(F.col("id").cast("int").alias("run"), F.lit(True).alias("skipped"))
    return runs.withColumn("skipped", F.lit(False)).unionByName(surplus, allowMissingColumns=True)


def search_report(results: DataFrame, runs: DataFrame) -> DataFrame:
    """(subject, run, c, accuracy, n_params, description) of every run and subject; a skipped run scores 0."""
    by = results.groupBy("subject", "run").agg((F.sum("right") / F.sum("n")).alias("accuracy"), F.max("n_params").alias("n_params"))
    each = results.select("subject").distinct().crossJoin(F.broadcast(runs))
    out = each.join(by, ["subject", "run"], "left")
    return out.select("subject", "run", "c", F.when(F.col("skipped"), 0.0).otherwise(F.col("accuracy")).alias("accuracy"), F.coalesce("n_params", F.lit(0)).alias("n_params"), F.when(F.col("skipped"), "skipped run").otherwise(F.format_string("C=%s", "c")).alias("description"))


def best_shared(runs: DataFrame) -> DataFrame:
    """The setting with the best mean accuracy over subjects; ties to the first by (mode, run)."""
    means = runs.groupBy("mode", "run").agg(F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy"))
    return means.orderBy(F.desc("mean_accuracy"), "mode", "run").limit(1)


def best_per_subject(runs: DataFrame) -> DataFrame:
    pick = F.struct(F.col("accuracy"), F.struct(-F.col("run"), F.col("mode")))
    return runs.groupBy("subject").agg(F.max("accuracy").alias("best"), F.max_by(F.struct("mode", "run"), pick).alias("s")).select("subject", "best", "s.mode", "s.run")


def records(runs: DataFrame) -> DataFrame:
    """(subject, n_params, accuracy, before): the runs that beat all of the subject's runs of their size or below, with the best before (0 if none).

    Sizes fall into ranges of a sixteenth of a doubling; the best of a subject's
    earlier ranges is carried into each, so a subject is as many groups as it has ranges.
    """
    size = F.floor(16 * F.log2(F.greatest(F.col("n_params").cast("double"), F.lit(1.0)))).alias("range_")
    best = runs.where("n_params is not null and accuracy is not null").groupBy("subject", size, "n_params").agg(F.max("accuracy").alias("accuracy"))
    ranges = best.groupBy("subject", "range_").agg(F.max("accuracy").alias("top"))
    earlier = Window.partitionBy("subject").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(F.col("subject").alias("s_"), F.col("range_").alias("r_"), F.coalesce(F.max("top").over(earlier), F.lit(0.0)).alias("carried"))
    inside = Window.partitionBy("subject", "range_").orderBy("n_params").rowsBetween(Window.unboundedPreceding, -1)
    before = F.greatest(F.coalesce(F.max("accuracy").over(inside), F.lit(0.0)), F.col("carried"), F.lit(0.0))
    met = best.join(carried, F.col("subject").eqNullSafe(F.col("s_")) & (F.col("range_") == F.col("r_")))
    return met.withColumn("before", before).where("accuracy > before").select("subject", "n_params", "accuracy", "before")


def budget_curve(runs: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each parameter budget the mean and deviation over subjects of the best affordable accuracy; 0 if none is.

    A subject's best is a staircase over sizes, so the sums over subjects are too: each
    record raises them at the first budget that affords it, by its gain. Tasks add up
    gains by budget; the totals, a row a budget, are then summed along. Neither runs nor
    subjects meet the budgets, whose list is a small dimension table.
    """
    spark = runs.sparkSession
    limits = np.array(sorted({r[0] for r in budgets.select(F.col("budget").cast("long")).where("budget is not null").collect()}), np.int64)
    subjects = runs.where("subject is not null").select("subject").distinct().count()
    kind = dict(budgets.dtypes)["budget"]

    def gains(batches):
        total = np.zeros((2, len(limits) + 1))
        for b in batches:
            size, acc, before = (c.to_numpy() for c in b.columns)
            at = np.searchsorted(limits, size)
            for k in (0, 1):
                np.add.at(total[k], at, acc ** (k + 1) - before ** (k + 1))
        at = np.flatnonzero(total[:, :-1].any(0))
        yield pa.record_batch([pa.array(limits[at]), pa.array(total[0, at]), pa.array(total[1, at])], names=["budget", "g1", "g2"])

    raised = records(runs.where("subject is not null")).select(F.col("n_params").cast("double"), F.col("accuracy").cast("double"), F.col("before").cast("double")).mapInArrow(gains, "budget long, g1 double, g2 double")
    steps = raised.unionByName(spark.createDataFrame([(int(v), 0.0, 0.0) for v in limits], "budget long, g1 double, g2 double")).groupBy("budget").agg(F.sum("g1").alias("g1"), F.sum("g2").alias("g2"))
    along = Window.orderBy("budget").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a budget: few
    sums = steps.select("budget", (F.sum("g1").over(along) / subjects).alias("m1"), (F.sum("g2").over(along) / subjects).alias("m2"))
    return sums.select(F.col("budget").cast(kind).alias("budget"), F.col("m1").alias("mean_best"), F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0))).alias("std_best"))


class GridSample:
    """Distinct settings drawn from a grid that is never built.

    A setting is a number below the grid's size, written in digits whose bases are the
    lengths of the value lists. A keyed permutation of the numbers (four rounds that
    mix one half of the bits into the other, repeated where the result is beyond the
    grid) sends 0, 1, 2, ... to distinct settings that look drawn at random. Nothing
    but the value lists is held, whatever the size of the grid, up to 2**62 settings.
    """

    def __init__(self, seed: int, **values: list):
        self.names, self.values = list(values), [list(v) for v in values.values()]
        self.size = math.prod(map(len, self.values))
        if not 0 < self.size <= 1 << 62:
            raise ValueError("a grid has 1 to 2**62 settings")
        self.half = max(1, ((self.size - 1).bit_length() + 1) // 2)
        self.keys = np.random.default_rng(seed).integers(0, 1 << 63, 4, dtype=np.uint64)

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        mask, h = np.uint64((1 << self.half) - 1), np.uint64(self.half)
        left, right = x >> h, x & mask
        for k in self.keys:
            v = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((v >> np.uint64(32)) & mask)
        return left << h | right

    def settings(self, index: np.ndarray) -> np.ndarray:
        """The setting number of each index, a permutation of all of them."""
        x = self._mixed(np.asarray(index).astype(np.uint64))
        while (far := x >= np.uint64(self.size)).any():
            x[far] = self._mixed(x[far])
        return x.astype(np.int64)

    def digits(self, setting: np.ndarray) -> list[np.ndarray]:
        """Place in each value list, the last list's running fastest."""
        out, rest = [], setting.copy()
        for v in reversed(self.values):
            out.append(rest % len(v))
            rest //= len(v)
        return out[::-1]

    def of(self, df: DataFrame, index: str) -> DataFrame:
        """``df`` with the setting of each row's index (below the grid's size) as columns of their own; narrow."""
        ship(df.sparkSession)
        at = df.columns.index(index)
        tables = [pa.array(v) for v in self.values]
        kinds = [from_arrow_type(t.type) for t in tables]

        def run(batches):
            for b in batches:
                i = b.column(at).to_numpy()
                if len(i) and (i.min() < 0 or i.max() >= self.size):
                    raise ValueError("an index lies beyond the grid")
                yield pa.record_batch([*b.columns, *(t.take(pa.array(d)) for t, d in zip(tables, self.digits(self.settings(i))))], names=[*b.schema.names, *self.names])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, *(T.StructField(n, k) for n, k in zip(self.names, kinds))]))


def sampled_runs(spark: SparkSession, n: int, seed: int = 1, **values: list) -> DataFrame:
    """(run, settings): ``n`` distinct settings of a grid of any size, or all of a smaller one."""
    g = GridSample(seed, **values)
    return g.of(spark.range(min(n, g.size)).withColumnRenamed("id", "run"), "run")


def top_runs(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("accuracy"), "subject", "mode", "run").limit(n)


def dedup_best(runs: DataFrame) -> DataFrame:
    """Best accuracy of each (mode, run) setting."""
    return runs.groupBy("mode", "run").agg(F.max("accuracy").alias("best"))


def class_pairs(classes: DataFrame, column: str) -> DataFrame:
    a, b = classes.select(F.col(column).alias("c1")), classes.select(F.col(column).alias("c2"))
    return a.join(F.broadcast(b), F.col("c1") < F.col("c2"))
