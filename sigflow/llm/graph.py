"""Bounded-size id filters and distributed union-find."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigflow.session import checkpoint, discard

#: The filter's size is fixed: 2**26 bits, 8 MB, however many keys it holds. When full it lets more through, never less; what it lets through is joined exactly later.
FILTER_BITS = 26


def bit_of(key: Column) -> Column:
    """The filter bit of a long that is a good hash already: its top bits."""
    return F.shiftrightunsigned(key, 64 - FILTER_BITS)


def bits_of(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


class KeyFilter:
    """One bit per hashed key; built by Spark's bitmap aggregate, at most 8 MB on the driver."""

    def __init__(self, keys: DataFrame, column: str, hashed: bool = True):
        bit = bit_of(F.col(column) if hashed else F.xxhash64(column)) + 1
        rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()
        self.table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for r in rows:
            at = (r.b - 1) * 4096
            self.table[at : at + 4096] = np.frombuffer(r.m, np.uint8)

    def __contains__(self, keys) -> bool:
        raise TypeError("use has()")

    def has(self, keys: np.ndarray) -> np.ndarray:
        return self.has_bits(bits_of(keys))

    def has_bits(self, bits: np.ndarray) -> np.ndarray:
        return (self.table[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 > 0


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every vertex of (a, b) edges; comp is the smallest id of its component.

    Each round hangs every vertex under its smallest neighbour, shortens the chains,
    and goes on with the edges between the remaining roots, so that the graph at
    least halves. Rounds are cut by checkpoints. Sums by vertex combine before the
    shuffle; a vertex of very many edges is only ever joined with one row.
    """
    e = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if e.isEmpty():
        return e.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    comp = base = None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        for _ in range(2):
            up = up.join(up.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", F.col("q").alias("p"))
        up = checkpoint(up)
        rename = lambda c: up.select(F.col("a").alias(c), F.col("p").alias(f"{c}_up"))
        if comp is None:
            comp, base = up.select(F.col("a").alias("id"), F.col("p").alias("comp")), up
            comp._checkpoint_path = up._checkpoint_path
        else:
            comp = checkpoint(comp.join(up.select(F.col("a").alias("comp"), F.col("p").alias("_up")), "comp", "left").select("id", F.coalesce("_up", "comp").alias("comp")))
            discard(base)
            base = comp
        new = checkpoint(e.join(rename("a"), "a").join(rename("b"), "b").where("a_up <> b_up").select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        discard(e)
        if base is not up:
            discard(up)
        e = new
        if e.isEmpty():
            discard(e)
            return comp
