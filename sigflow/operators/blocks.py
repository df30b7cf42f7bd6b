"""Labelled rows packed into blocks: one Spark row holds some hundred vectors as a matrix, so that iterations work on whole arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.operators.spd import stacked
from sigflow.session import checkpoint, ship

#: Bytes of a block's vectors at most.
BLOCK_BYTES = 1 << 20
SCHEMA = "grp long, ids binary, x binary, y binary, fold binary"


def as_binary(x: np.ndarray, dtype=float) -> bytes:
    return np.ascontiguousarray(x, dtype).tobytes()


@dataclass
class Block:
    group: int
    ids: np.ndarray  # int64
    x: np.ndarray  # (rows, d)
    y: np.ndarray  # class number; -1 without a label
    fold: np.ndarray

    def row(self) -> tuple:
        return self.group, as_binary(self.ids, np.int64), as_binary(self.x), as_binary(self.y, np.int32), as_binary(self.fold, np.int32)


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, dict]]:
    """Each packed row as a block, and the values of its other columns."""
    for b in batches:
        for r in b.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            x = np.frombuffer(r["x"]).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
            yield Block(r["grp"], ids, x, np.frombuffer(r["y"], np.int32), np.frombuffer(r["fold"], np.int32)), r


@dataclass
class Blocks:
    """Packed rows of a table, with what is small about them: width, classes and groups."""

    frame: DataFrame
    width: int
    classes: list
    groups: list[int]
    rows: int


def pack(df: DataFrame, key: str, column: str, label: str | None = None, group: str | None = None, fold: str | None = None, classes: list | None = None, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Rows with a key, a vector and a label (where one is asked for) in blocks of one group each, written once.

    A group's rows stay where they lie: as many blocks, and tasks, as the table has for
    it. Only the distinct labels and groups come to the driver.
    """
    spark = ship(df.sparkSession)
    given = df.where(F.col(key).isNotNull() & F.col(column).isNotNull() & (F.col(label).isNotNull() if label else F.lit(True)))
    if label and classes is None:
        classes = sorted(r[0] for r in given.select(label).distinct().collect())
    number = {c: k for k, c in enumerate(classes or [])}
    lone = F.lit(0).cast("int")
    rows = given.select(
        F.col(key).cast("long").alias("key"), F.col(column).alias("x"), (F.col(label) if label else lone).alias("label"), (F.col(group).cast("long") if group else F.lit(0).cast("long")).alias("grp"), (F.col(fold).cast("int") if fold else F.lit(-1).cast("int")).alias("fold"),
    ).where("grp is not null and fold is not null")

    def run(batches):
        held: dict[int, list] = {}

        def out(g, parts):
            ids, x, y, f = (np.concatenate(p) for p in zip(*parts))
            size = max(1, block_bytes // (8 * max(x.shape[1], 1)))
            for k in range(0, len(ids), size):
                s = slice(k, k + size)
                yield Block(g, ids[s], x[s], y[s], f[s]).row()

        def batch(rows):
            names = ("grp", "ids", "x", "y", "fold")
            types = (pa.int64(), *[pa.binary()] * 4)
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for b in batches:
            x = stacked(b.column(1), 1)[:, 0]
            ids, g, f = (b.column(k).to_numpy() for k in (0, 3, 4))
            y = np.array([number.get(v, -1) for v in b.column(2).to_pylist()] if label else np.full(len(ids), -1), np.int32)
            for v in np.unique(g).tolist():
                at = g == v
                held.setdefault(v, []).append((ids[at], x[at], y[at], f[at]))
            if sum(p[1].nbytes for parts in held.values() for p in parts) > 8 * block_bytes:
                for v, parts in held.items():
                    yield batch(list(out(v, parts)))
                held = {}
        for v, parts in held.items():
            yield batch(list(out(v, parts)))

    frame = checkpoint(rows.mapInArrow(run, SCHEMA))
    seen = frame.groupBy("grp").agg(F.sum(F.length("ids") / 8).cast("long").alias("n"), F.max(F.length("x") * 8 / F.length("ids") / 8).cast("long").alias("d")).collect()
    return Blocks(frame, max((r["d"] for r in seen), default=0), list(classes or []), sorted(r["grp"] for r in seen), sum(r["n"] for r in seen))
