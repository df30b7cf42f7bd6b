"""Recursive filters over signals cut into blocks, by an associative scan, and the numbering of samples that cuts them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.session import checkpoint, ship


def numbered(df: DataFrame, key: str, order: list[str], out: str = "k") -> DataFrame:
    """Rows numbered from 0 within each key, by ``order``; no task sees a key as a whole.

    Rows are sorted over the partitions by range; a partition numbers its own rows of a
    key, to which the sizes of the key's earlier partitions are added.
    """
    placed = checkpoint(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("part_", F.spark_partition_id()))
    sizes = placed.groupBy(key, "part_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.partitionBy(key).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a key and partition
    own = placed.withColumn("row_", F.row_number().over(Window.partitionBy(key, "part_").orderBy(*order)) - 1)
    same = own[key].eqNullSafe(before[key]) & (own["part_"] == before["part_"])
    return own.join(before.select(key, "part_", "before_"), same).select(*(own[c] for c in df.columns), (F.col("before_") + F.col("row_")).cast("long").alias(out))


def cut_signals(df: DataFrame, key: str, order: list[str], value: str, length: int = 64) -> DataFrame:
    """(key, block, x): every ``length`` consecutive samples of a signal as one row."""
    n = numbered(df.select(*dict.fromkeys([key, *order, value])), key, order, "k_")
    packed = n.groupBy(key, F.floor(F.col("k_") / length).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("k_", F.col(value).cast("double").alias("v")))).alias("s"))
    return packed.select(key, "block", F.transform("s", lambda r: r.v).alias("x"))


def filter_from(x: np.ndarray, sos: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filter (signals, samples) from given registers (signals, 2 a section); the output and the registers at the end."""
    y = np.array(np.asarray(x, float).T, order="C")
    end = np.empty_like(state)
    for m, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        z1, z2 = state[:, 2 * m].copy(), state[:, 2 * m + 1].copy()
        for v in y:
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            v[:] = o
        end[:, 2 * m], end[:, 2 * m + 1] = z1, z2
    return np.ascontiguousarray(y.T), end


class _Powers:
    """What n samples of silence make of the registers: powers of one matrix."""

    def __init__(self, sos: np.ndarray):
        n = 2 * len(sos)
        self.one = filter_from(np.zeros((n, 1)), sos, np.eye(n))[1].T
        self.known: dict[int, np.ndarray] = {}

    def __call__(self, n: int) -> np.ndarray:
        if n not in self.known:
            if len(self.known) > 4096:
                self.known.clear()
            self.known[n] = np.linalg.matrix_power(self.one, n)
        return self.known[n]


def _each_length(x: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length at a time: their places and their samples."""
    size = np.diff(x.offsets.to_numpy())
    flat = x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.concatenate([[0], np.cumsum(size)])[:-1]
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        yield at, flat[start[at][:, None] + np.arange(n)[None, :]]


def _local(sos: np.ndarray, batches):
    """Each block's registers at its start and end, as if its key began in this task, and the samples before it here."""
    from pyspark import TaskContext

    part, power, width = TaskContext.get().partitionId(), _Powers(sos), 2 * len(sos)
    key, state, before = None, np.zeros(width), 0
    for b in batches:
        own = np.zeros((b.num_rows, width))
        for at, x in _each_length(b.column(2)):
            own[at] = filter_from(x, sos, np.zeros((len(at), width)))[1]
        size = np.diff(b.column(2).offsets.to_numpy()).tolist()
        start, end, seen = np.zeros((b.num_rows, width)), np.zeros((b.num_rows, width)), np.zeros(b.num_rows, np.int64)
        for r, k in enumerate(b.column(0).to_pylist()):
            if k != key:
                key, state, before = k, np.zeros(width), 0
            start[r], seen[r] = state, before
            state = power(size[r]) @ state + own[r]
            end[r] = state
            before += size[r]
        rows = [pa.array(list(v), pa.list_(pa.float64())) for v in (start, end)]
        yield pa.record_batch([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(seen), pa.array(seen + np.array(size, np.int64)), *rows], names=[*b.schema.names, "part", "before", "after", "start", "end"])


def _carried(sos: np.ndarray, key: str, t: pa.Table) -> pa.Table:
    """Registers at the start of each part of one key, from the parts before it."""
    t = t.sort_by("part")
    power, state, out = _Powers(sos), np.zeros(2 * len(sos)), []
    for n, end in zip(t.column("n").to_pylist(), t.column("end").to_pylist()):
        out.append(state.tolist())
        state = power(n) @ state + np.array(end)
    return pa.table([t.column(key), t.column("part"), pa.array(out, pa.list_(pa.float64()))], names=[key, "part", "carry"])


def _finished(sos: np.ndarray, batches):
    power = _Powers(sos)
    for b in batches:
        state = np.array(b.column(3).to_pylist(), float).reshape(b.num_rows, 2 * len(sos))
        for r, (n, carry) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist())):
            if carry is not None:
                state[r] += power(n) @ np.array(carry)
        y: list = [None] * b.num_rows
        for at, x in _each_length(b.column(2)):
            out, _ = filter_from(x, sos, state[at])
            for r, v in zip(at.tolist(), out):
                y[r] = v
        yield pa.record_batch([b.column(0), b.column(1), pa.array(y, pa.list_(pa.float64()))], names=[*b.schema.names[:2], "y"])


def filter_blocks(blocks: DataFrame, sos: np.ndarray, key: str, order: str = "block", column: str = "x") -> DataFrame:
    """(key, order, y): a cascade of second-order sections over signals whose samples lie in rows of any length, ordered within their key.

    The registers at a block's end are a linear map of those at its start plus what
    the block does from rest, and such maps compose. Blocks lie sorted over partitions
    by range; a task composes its blocks of a key, the compositions of a key's parts
    (a row each) are carried on in order, and every block is then filtered from its
    true registers. A key may lie in any number of tasks, each of which holds a batch
    of blocks. Rounding differs from one uninterrupted pass by the last bits. Rows
    without samples pass; a null row or sample is an error; rows with a null key are one
    signal.
    """
    ship(blocks.sparkSession)
    sos = np.asarray(sos, float)
    rows = blocks.select(key, F.col(order), F.col(column).alias("x")).repartitionByRange(key, order).sortWithinPartitions(key, order)
    kind = dict(blocks.dtypes)
    named = f"{key} {kind[key]}, {order} {kind[order]}, x {kind[column]}"
    placed = checkpoint(rows.mapInArrow(partial(_local, sos), f"{named}, part int, before long, after long, start array<double>, end array<double>"))
    ends = placed.groupBy(key, "part").agg(F.max("after").alias("n"), F.max_by("end", F.struct("after", order)).alias("end"))
    carry = ends.groupBy(key).applyInArrow(lambda t: _carried(sos, key, t), f"{key} {kind[key]}, part int, carry array<double>").select(F.col(key).alias("key_"), F.col("part").alias("part_"), "carry").where("exists(carry, v -> v <> 0)")
    met = placed.join(carry, placed[key].eqNullSafe(F.col("key_")) & (F.col("part") == F.col("part_")), "left").select(key, order, "x", "start", "before", "carry")
    return met.mapInArrow(partial(_finished, sos), f"{key} {kind[key]}, {order} {kind[order]}, y array<double>")
