"""Means of symmetric positive-definite matrices by key, for any number of keys, and what is solved between pairs of means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.operators.spd import expm, invsqrtm, logm, nested, sqrtm, stacked
from sigflow.session import buckets, checkpoint, discard, ship

_MATRIX = T.ArrayType(T.DoubleType())


def _codes(columns: list[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the number of its key among those of the batch, and a row of each key."""
    if not columns:
        return np.zeros(rows, np.int64), np.zeros(min(rows, 1), np.int64)
    each = [c.dictionary_encode("encode") for c in columns]
    table = np.stack([c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in each], 1)
    _, first, code = np.unique(table, axis=0, return_index=True, return_inverse=True)
    return code.ravel(), first


def _group_sums(code: np.ndarray, x: np.ndarray, groups: int) -> np.ndarray:
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(groups))
    return np.add.reduceat(x[order], starts, axis=0) if len(x) else np.zeros((0, *x.shape[1:]))


def _joined_rows(t: pa.Table) -> list[pa.Array]:
    return [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns]


def _summed(rows: DataFrame, keys: list[str], n: int, finish, schema: T.StructType) -> DataFrame:
    """Partial sums (keys, bucket_, n_, s_, more arrays) added up; ``finish(keys' columns, counts, sums, first of each other array)`` makes the result of a bucket's keys together."""

    def run(t: pa.Table) -> pa.Table:
        cols = _joined_rows(t)
        ks = cols[: len(keys)]
        code, first = _codes(ks, t.num_rows)
        count = _group_sums(code, cols[len(keys) + 1].to_numpy(), len(first))
        sums = _group_sums(code, stacked(cols[len(keys) + 2], n), len(first))
        more = [stacked(c, n)[first] for c in cols[len(keys) + 3 :]]
        return pa.table(finish([c.take(pa.array(first)) for c in ks], count, sums, *more), names=schema.names)

    return rows.groupBy("bucket_").applyInArrow(run, schema)


def _bucket(keys: list[str], n: int):
    return (F.pmod(F.xxhash64(*keys), F.lit(n)) if keys else F.lit(0)).cast("int").alias("bucket_")


def euclid_means(df: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    """(keys, n, mean): arithmetic means of n x n matrices in array columns. A task sends one sum a key; rows without a matrix have no part."""
    spark = ship(df.sparkSession)
    given = df.where(F.col(column).isNotNull()).select(*keys, _bucket(keys, buckets(spark)), column)
    fields = [df.schema[k] for k in keys]

    def partial_sums(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            code, first = _codes(b.columns[: len(keys)], b.num_rows)
            if len(first):
                at = pa.array(first)
                yield pa.record_batch([*(c.take(at) for c in b.columns[: len(keys) + 1]), pa.array(np.bincount(code, minlength=len(first))), nested(_group_sums(code, stacked(b.column(len(keys) + 1), n), len(first)))], names=[*keys, "bucket_", "n_", "s_"])

    sent = given.mapInArrow(partial_sums, T.StructType([*fields, T.StructField("bucket_", T.IntegerType()), T.StructField("n_", T.LongType()), T.StructField("s_", _MATRIX)]))
    schema = T.StructType([*fields, T.StructField("n", T.LongType()), T.StructField("mean", _MATRIX)])
    return _summed(sent, keys, n, lambda ks, count, s: [*ks, pa.array(count), nested(s / count[:, None, None])], schema)


def karcher_means(df: DataFrame, keys: list[str], column: str, n: int, tol: float = 1e-8, rounds: int = 50) -> DataFrame:
    """(keys, n, mean, step, round): the affine-invariant mean of every key's matrices.

    The means are a table. A round joins the matrices to the means that still move,
    maps them to the tangent space there, adds up one array a key and task, and
    moves each mean by the sum's exponential; a key whose tangent mean is shorter
    than ``tol`` leaves the loop with the round that ended it. When half of the keys
    have left, the others' matrices are written once more, so that later rounds read
    only those. ``step`` of a key that is still moving after ``rounds`` is above ``tol``.
    The join is Spark's choice by size; a key with very many matrices is split by
    size where it is shuffled, and sends a sum a task in any case.
    """
    spark = ship(df.sparkSession)
    fields = [df.schema[k] for k in keys]
    many = buckets(spark)
    named = [f"k{i}_" for i in range(len(keys))]
    matrices = checkpoint(df.where(F.col(column).isNotNull()).select(*(F.col(k).alias(m) for k, m in zip(keys, named)), F.col(column).alias("x_")))
    inner = [T.StructField(m, f.dataType) for m, f in zip(named, fields)]
    state_schema = T.StructType([*inner, T.StructField("n", T.LongType()), T.StructField("mean", _MATRIX), T.StructField("step", T.DoubleType())])
    moving = checkpoint(euclid_means(matrices, named, "x_", n).withColumn("step", F.lit(np.inf)))
    still = held = moving.count()
    done: list[DataFrame] = []

    def tangent(batches: Iterator[pa.RecordBatch]):
        w = len(keys)
        for b in batches:
            code, first = _codes(b.columns[:w], b.num_rows)
            if not len(first):
                continue
            at = pa.array(first)
            mean = stacked(b.column(w + 2).take(at), n)
            inv = invsqrtm(mean)
            x = logm(inv[code] @ stacked(b.column(w + 1), n) @ inv[code])
            yield pa.record_batch([*(c.take(at) for c in b.columns[: w + 1]), pa.array(np.bincount(code, minlength=len(first))), nested(_group_sums(code, x, len(first))), nested(mean)], names=[*named, "bucket_", "n_", "s_", "mean_"])

    def moved(ks, count, s, mean):
        t = s / count[:, None, None]
        root = sqrtm(mean)
        return [*ks, pa.array(count), nested(root @ expm(t) @ root), pa.array(np.linalg.norm(t, axis=(1, 2)))]

    sums = T.StructType([*inner, T.StructField("bucket_", T.IntegerType()), T.StructField("n_", T.LongType()), T.StructField("s_", _MATRIX), T.StructField("mean_", _MATRIX)])
    for k in range(1, rounds + 1):
        if not still:
            break
        if 2 * still < held:
            fewer = checkpoint(_met(matrices, moving, named).select(*(matrices[m] for m in named), "x_"))
            discard(matrices)
            matrices, held = fewer, still
        met = _met(matrices, moving, named).select(*(matrices[m] for m in named), _bucket([matrices[m] for m in named], many), "x_", "mean")
        after = checkpoint(_summed(met.mapInArrow(tangent, sums), named, n, moved, state_schema))
        discard(moving)
        seen = after.agg(F.count(F.lit(1)).alias("all"), F.count(F.when(F.col("step") >= tol, 1)).alias("still")).first()
        still = 0 if k == rounds else seen["still"]
        if still < seen["all"]:
            done.append((after.where(F.col("step") < tol) if still else after).withColumn("round", F.lit(k)))
            moving = after.where(F.col("step") >= tol)
        else:
            moving = after
    discard(matrices)
    out = done[0] if done else moving.withColumn("round", F.lit(0))
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*(F.col(m).alias(k) for m, k in zip(named, keys)), "n", "mean", "step", "round")


def _met(matrices: DataFrame, moving: DataFrame, named: list[str]) -> DataFrame:
    if not named:
        return matrices.crossJoin(F.broadcast(moving))  # one mean of all
    theirs = moving.select(*(F.col(m).alias(f"m{m}") for m in named), "mean")
    same = [matrices[m].eqNullSafe(theirs[f"m{m}"]) for m in named]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return matrices.join(theirs, on)


def pair_filters(means: DataFrame, by: list[str], label: str, n: int, pairs: int = 1, column: str = "mean") -> DataFrame:
    """(by, c1, c2, k, value, w): generalised eigenvalues and vectors between every two classes' matrices under the same ``by``.

    Classes c1 < c2 meet in a join on ``by``; each batch of pairs is solved at once. k
    counts the ``pairs`` values of smallest magnitude, then those of largest; vectors w
    have w' C2 w = 1 and the sign of their largest component is positive.
    """
    ship(means.sparkSession)
    a = means.select(*by, F.col(label).alias("c1"), F.col(column).alias("m1"))
    b = means.select(*(F.col(k).alias(f"b_{k}") for k in by), F.col(label).alias("c2"), F.col(column).alias("m2"))
    on = F.col("c1") < F.col("c2")
    for k in by:
        on = on & a[k].eqNullSafe(b[f"b_{k}"])
    met = a.join(b, on).select(*by, "c1", "c2", "m1", "m2")
    w = len(by) + 2
    schema = T.StructType([*met.schema.fields[:w], T.StructField("k", T.IntegerType()), T.StructField("value", T.DoubleType()), T.StructField("w", _MATRIX)])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            first, second = stacked(b.column(w), n), stacked(b.column(w + 1), n)
            low = np.linalg.inv(np.linalg.cholesky(second))
            value, v = np.linalg.eigh(low @ first @ np.swapaxes(low, 1, 2))
            v = np.swapaxes(low, 1, 2) @ v
            order = np.argsort(np.abs(value), axis=1, kind="stable")
            pick = np.concatenate([order[:, :pairs], order[:, n - pairs :]], 1)
            vec = np.swapaxes(np.take_along_axis(v, pick[:, None, :], 2), 1, 2)
            sign = np.sign(np.take_along_axis(vec, np.abs(vec).argmax(2)[:, :, None], 2))
            each = pick.shape[1]
            at = pa.array(np.repeat(np.arange(b.num_rows), each))
            yield pa.record_batch([*(c.take(at) for c in b.columns[:w]), pa.array(np.tile(np.arange(each, dtype=np.int32), b.num_rows)), pa.array(np.take_along_axis(value, pick, 1).ravel()), nested((vec * sign).reshape(-1, n))], names=schema.names)

    return met.mapInArrow(run, schema)
