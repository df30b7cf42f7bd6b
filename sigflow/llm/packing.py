"""Bounded-space best-fit packing of tokenised documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.llm.text import chunks
from sigflow.llm.wordids import WordBpe
from sigflow.session import ship

CAPACITY = 2048
#: Bins open at once in one task.
OPEN_BINS = 4096


class Tokenizer:
    """The vocabulary at a path, read where it is first used. As a broadcast's value it stays in a worker, with the words met so far, until the worker's next task does without it."""

    def __init__(self, path: str):
        self.path = path

    def __reduce__(self):
        return Tokenizer, (self.path,)

    @cached_property
    def words(self) -> WordBpe:
        return WordBpe(self.path)


class BestFit:
    """Online best fit with at most ``limit`` open bins.

    Open bins are stacked by their free space; bit f of ``bits`` says that some
    open bin has exactly f tokens free. The best bin for a piece of n tokens is the
    lowest set bit at n or above. When a new bin would exceed the limit, the
    fullest open bin (the lowest set bit) is closed. A bin left full is closed.
    """

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.count = 0, 0, 0
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.stacks[free]
        bin_ = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of n tokens."""
        above = self.bits >> n
        if above:
            free = n + (above & -above).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.count, self.capacity
            self.count += 1
        left = free - n
        if left:
            self.stacks[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = f"{_PIECES}, sequence_id long, offset long"


def _cut(shared, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = shared.value.words
        for c in chunks(batches):
            ids, lens = tok.ids([c.text(k) for k in range(len(c))])
            ids = ids.astype("<u4")
            end = np.array([end_id], "<u4").tobytes()
            out = [[], [], [], [], []]
            at = 0
            for doc, n in zip(c.ids.tolist(), lens.tolist()):
                raw = ids[at : at + n].tobytes() + end
                at += n
                for piece, start in enumerate(range(0, n + 1, capacity)):
                    part = raw[4 * start : 4 * (start + capacity)]
                    for col, v in zip(out, (doc, piece, start, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _fill(capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        fit = BestFit(capacity, limit)
        for b in batches:
            placed = [fit.place(n) for n in b.column("length").to_pylist()]
            yield pa.record_batch([*b.columns, pa.array([base + s for s, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], names=[*b.schema.names, "sequence_id", "offset"])

    return run


def best_fit_pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece with its sequence and its place there.

    Texts are tokenised where they lie; only the pieces' measures (some 40 bytes
    each) are dealt out by document id and sorted longest first within each task,
    so that the bounded-space best fit sees decreasing sizes. A rerun of a lost
    task sees the same rows in the same order.

    Null and empty texts give one piece that holds ``end_id`` alone. Rows with a
    null id are left out. Repeated rows are packed once each. An empty table
    gives an empty result. Other columns are not looked at.
    """
    spark = ship(docs.sparkSession)
    shared = spark.sparkContext.broadcast(Tokenizer(tokenizer_path))
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_cut(shared, capacity, end_id), _PIECES)
    dealt = pieces.repartition("doc_id").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(_fill(capacity, open_bins), PACKED_SCHEMA)
