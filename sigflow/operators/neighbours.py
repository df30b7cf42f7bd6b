"""Exact nearest neighbours of every row, blocks that cannot hold any being left out before they meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.operators.blocks import as_binary
from sigflow.operators.spd import stacked
from sigflow.session import checkpoint, ship

#: Rows whose distances describe every block, and rows of a block.
PIVOTS, ROWS = 32, 512
#: Bytes of a panel's vectors as doubles at most, and of rows by columns the distances that are in memory at once.
PANEL_BYTES, TILE = 16 << 20, (512, 2048)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _without_self(d: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    return np.where(mine[:, None] == theirs[None, :], np.inf, d)


class NearestOfAll:
    """Blocks of rows that lie near each other, described by their distances to a few pivots.

    Rows are dealt by their nearest pivot and sorted by the distance to it, so that a
    block is a shell around a pivot. For each pivot a block knows the least and the
    greatest distance of its rows; by the triangle inequality two blocks are no nearer
    than the gap between those ranges, for any pivot. A row has ``k`` neighbours in its
    own block, which bounds how far others may be. Blocks meet only where the bound
    reaches across the widest gap.

    Blocks lie in panels, and panels travel, not blocks: each meets every other that
    it cannot be told apart from once, in one task for both directions, so a row
    travels as often as there are panels, and what comes back of two panels is at
    most ``k`` neighbours a row. Where nothing can be left out (even vectors of many
    dimensions) the time still grows with the square of the rows.
    """

    def __init__(self, df: DataFrame, key: str, column: str, k: int, pivots: int = PIVOTS, rows: int = ROWS):
        spark = ship(df.sparkSession)
        self.key, self.k = key, k
        given = df.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("x"))
        marks = np.array([r[0] for r in given.orderBy(F.xxhash64("id"), "id").select("x").limit(pivots).collect()], float)
        share = spark.sparkContext.broadcast(marks)

        def near(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                if b.num_rows:
                    d = squared(stacked(b.column(1), 1)[:, 0], share.value)
                    yield pa.record_batch([*b.columns, pa.array(d.argmin(1).astype(np.int32)), pa.array(np.sqrt(d.min(1)))], names=["id", "x", "cell", "r"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held = []
            for b in batches:
                x, ids, cell = stacked(b.column(1), 1)[:, 0], b.column(0).to_numpy(), b.column(2).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), b.num_rows]
                for lo, hi in zip(cut, cut[1:]):
                    for at in range(lo, hi, rows):
                        s = slice(at, min(at + rows, hi))
                        if held and (held[0] != cell[at] or len(held[1]) + s.stop - at > rows):
                            yield held[1], held[2]
                            held = []
                        held = [cell[at], np.concatenate([held[1], ids[s]]), np.concatenate([held[2], x[s]])] if held else [cell[at], ids[s], x[s]]
            if held:
                yield held[1], held[2]

        def packed(batches: Iterator[pa.RecordBatch]):
            from pyspark import TaskContext

            part, seq, panel = TaskContext.get().partitionId(), 0, []
            for ids, x in blocks(batches):
                if panel and sum(p[1].nbytes for p in panel) + x.nbytes > PANEL_BYTES:
                    yield _panel(part << 32 | seq, panel, share.value, k)
                    panel, seq = [], seq + 1
                panel.append((ids, x))
            if panel:
                yield _panel(part << 32 | seq, panel, share.value, k)

        dealt = given.mapInArrow(near, f"id long, x {dict(given.dtypes)['x']}, cell int, r double").repartitionByRange("cell", "r").sortWithinPartitions("cell", "r")
        self.panels = checkpoint(dealt.mapInArrow(packed, "panel long, width int, ids binary, x binary, cut binary, los binary, his binary, own binary, lo array<double>, hi array<double>, bound double"))
        names = sorted(r[0] for r in self.panels.select("panel").collect())
        n = len(names)
        numbers = spark.createDataFrame([(v, i) for i, v in enumerate(names)], "panel long, number long")
        ranges = self.panels.select("panel", "lo", "hi", "bound").join(F.broadcast(numbers), "panel")
        a, b = (ranges.select(*(F.col(c).alias(f"{c}_{side}") for c in ranges.columns)) for side in "ab")
        # every two panels once, each about as often on the one side as on the other
        step = F.pmod(F.col("number_b") - F.col("number_a"), F.lit(max(n, 1)))
        once = (2 * step < n) | ((2 * step == n) & (F.col("number_a") < F.col("number_b")))
        # distances are right to some parts in 10^8 of the vectors' size, so the bound is taken a little wider
        gap = F.expr("array_max(zip_with(arrays_zip(lo_a, hi_a), arrays_zip(lo_b, hi_b), (p, q) -> greatest(q.lo_b - p.hi_a, p.lo_a - q.hi_b)))")
        wide = 1e-6 * F.greatest(F.array_max("hi_a"), F.array_max("hi_b"))
        meet = a.join(b, once & (gap <= F.greatest("bound_a", "bound_b") + wide)).select(F.col("panel_a").alias("a"), F.col("panel_b").alias("b"))
        self.pairs = meet.repartition(8 * spark.sparkContext.defaultParallelism, "a", "b")

    def share(self) -> float:
        """Pairs of blocks of which the one may have neighbours in the other, as a share of all."""

        def count(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for r in b.to_pylist():
                    there, back = _meets(_Side(r, "a"), _Side(r, "b"))
                    yield pa.record_batch([pa.array([int(there.sum() + (back.sum() if r["a"] != r["b"] else 0))])], names=["n"])

        n = sum(len(r["cut"]) // 8 - 1 for r in self.panels.select("cut").toLocalIterator())
        return (self._met().mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0) / max(n * n, 1)

    def _met(self) -> DataFrame:
        one, two = (self.panels.select(F.col("panel").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("width", "ids", "x", "cut", "los", "his", "own"))) for side in "ab")
        return self.pairs.join(one, "a").join(two, "b")

    def neighbours(self) -> DataFrame:
        """(key, neighbour, rank, d): the ``k`` nearest other rows by squared distance, ties to the smaller id; fewer if there are no more."""
        k, key = self.k, self.key

        def meet(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for at in range(b.num_rows):
                    r = b.slice(at, 1).to_pylist()[0]
                    one, two = _Side(r, "a"), _Side(r, "b")
                    found = _search(one, two, k, r["a"] == r["b"])
                    for name, side, best in zip((r["a"], r["b"]), (one, two), found):
                        rows, rank = np.nonzero(np.isfinite(best.d))
                        if len(rows):
                            yield pa.record_batch([pa.array([name]), *(pa.array([as_binary(*v)], pa.binary()) for v in ((side.ids[rows], np.int64), (rows, np.int32), (best.d[rows, rank],), (best.who[rows, rank], np.int64)))], names=["a", "ids", "rows", "d", "who"])

        def best(t: pa.Table) -> pa.Table:
            ids, rows, d, who = (np.concatenate([np.frombuffer(v, dtype) for v in t.column(c).to_pylist()]) for c, dtype in (("ids", np.int64), ("rows", np.int32), ("d", float), ("who", np.int64)))
            order, rank = _ranked(rows, d, who, k)
            return pa.table({key: ids[order], "neighbour": who[order], "rank": (rank + 1).astype(np.int32), "d": d[order]})

        found = self._met().mapInArrow(meet, "a long, ids binary, rows binary, d binary, who binary")
        return found.groupBy("a").applyInArrow(best, f"{key} long, neighbour long, rank int, d double")


def _narrow(x: np.ndarray) -> bytes:
    """Vectors in the narrowest numbers that hold them as they are."""
    for dtype in (np.int8, np.float32):
        with np.errstate(invalid="ignore", over="ignore"):
            if np.array_equal(small := x.astype(dtype), x):
                return as_binary(small, dtype)
    return as_binary(x)


def _panel(name: int, blocks: list[tuple], marks: np.ndarray, k: int) -> pa.RecordBatch:
    lo, hi, own = [], [], []
    for ids, x in blocks:
        far = np.sqrt(squared(x, marks))
        lo.append(far.min(0))
        hi.append(far.max(0))
        near = np.sort(_without_self(squared(x, x), ids, ids), axis=1)
        own.append(near[:, k - 1] if near.shape[1] >= k else np.full(len(x), np.inf))
    ids, x = (np.concatenate(v) for v in zip(*blocks))
    cut = np.cumsum([0, *(len(b[0]) for b in blocks)])
    packed = [as_binary(ids, np.int64), _narrow(x), as_binary(cut, np.int64), as_binary(lo), as_binary(hi), as_binary(np.concatenate(own))]
    lists = [pa.array([v.tolist()], pa.list_(pa.float64())) for v in (np.min(lo, 0), np.max(hi, 0))]
    return pa.record_batch([pa.array([name]), pa.array([x.shape[1]], pa.int32()), *(pa.array([v], pa.binary()) for v in packed), *lists, pa.array([float(np.sqrt(np.max(np.concatenate(own))))])], names=["panel", "width", "ids", "x", "cut", "los", "his", "own", "lo", "hi", "bound"])


class _Side:
    """A panel as it comes to a task."""

    def __init__(self, r: dict, side: str):
        get = lambda c, dtype=float: np.frombuffer(r[f"{side}_{c}"], dtype)
        self.ids, self.cut, self.own = get("ids", np.int64), get("cut", np.int64), get("own")
        n, blocks = len(self.ids), len(self.cut) - 1
        self.lo, self.hi = get("los").reshape(blocks, -1), get("his").reshape(blocks, -1)
        self.bound = np.sqrt(np.maximum.reduceat(self.own, self.cut[:-1]))
        width = r[f"{side}_width"]
        self.x = get("x", {1: np.int8, 4: np.float32, 8: float}[len(r[f"{side}_x"]) // (n * width)] if width else float).astype(float).reshape(n, width)


def _meets(one: _Side, two: _Side) -> tuple[np.ndarray, np.ndarray]:
    """Which blocks of ``two`` those of ``one`` may have neighbours in, for all that the pivots tell, and the other way round."""
    gap = np.full((len(one.lo), len(two.lo)), -np.inf)
    for p in range(one.lo.shape[1]):
        np.maximum(gap, np.maximum(two.lo[None, :, p] - one.hi[:, None, p], one.lo[:, None, p] - two.hi[None, :, p]), out=gap)
    wide = 1e-6 * max(one.hi.max(), two.hi.max())
    return gap <= one.bound[:, None] + wide, gap <= two.bound[None, :] + wide


def _ranked(rows: np.ndarray, d: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k smallest of each row, ties to the smaller id, and their ranks from 0."""
    order = np.lexsort((who, d, rows))
    first = np.flatnonzero(np.append(True, np.diff(rows[order]) != 0)) if len(rows) else np.zeros(0, int)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
    return order[rank < k], rank[rank < k]


class _Best:
    """The nearest found so far of a panel's rows, and how far a nearer one may be."""

    def __init__(self, side: _Side, k: int, dtype):
        self.d, self.who = np.full((len(side.ids), k), np.inf), np.zeros((len(side.ids), k), np.int64)
        # the bound was worked out in other blocks of products: a little wider
        self.limit = np.nextafter((side.own + 1e-9 * (side.own + np.max((side.x * side.x).sum(1), initial=0))).astype(dtype), dtype(np.inf))

    def add(self, rows: np.ndarray, d: np.ndarray, who: np.ndarray) -> None:
        hit, k = np.unique(rows), self.d.shape[1]
        rows, d, who = (np.concatenate(v) for v in ((np.repeat(hit, k), rows), (self.d[hit].ravel(), d), (self.who[hit].ravel(), who)))
        order, rank = _ranked(rows, d, who, k)
        self.d[rows[order], rank], self.who[rows[order], rank] = d[order], who[order]
        self.limit[hit] = np.minimum(self.limit[hit], self.d[hit, -1])


def _search(one: _Side, two: _Side, k: int, same: bool) -> tuple[_Best, ...]:
    """The nearest rows of each panel to those of the other, or of one to its own.

    Whole numbers small enough are worked on in 32 bits, where every sum is exact.
    """
    square = [(s.x * s.x).sum(1) for s in (one, two)]
    whole = all(np.array_equal(np.rint(s.x), s.x) for s in (one, two)) and 4 * max(v.max() for v in square) < 1 << 24
    dtype = np.float32 if whole else np.float64
    best = (_Best(one, k, dtype),) if same else (_Best(one, k, dtype), _Best(two, k, dtype))
    left = np.concatenate([-2 * one.x, square[0][:, None], np.ones((len(one.x), 1))], 1).astype(dtype)
    right = np.concatenate([two.x, np.ones((len(two.x), 1)), square[1][:, None]], 1).astype(dtype)
    meets, size, at = np.logical_or(*_meets(one, two)), np.diff(two.cut), 0
    while at < len(meets):
        end = max(at + 1, int(np.searchsorted(one.cut, one.cut[at] + TILE[0], "right")) - 1)
        rows = np.arange(one.cut[at], one.cut[end])
        met = np.flatnonzero(np.repeat(meets[at:end].any(0), size))
        for lo in range(0, len(met), TILE[1]):
            columns = met[lo : lo + TILE[1]]
            d = np.maximum(left[rows] @ right[columns].T, 0)
            for b, near in zip(best, (best[0].limit[rows][:, None], best[-1].limit[columns][None, :])):
                i, j = np.divmod(np.flatnonzero(d <= near), len(columns))
                i, j, found = rows[i], columns[j], d[i, j].astype(float)
                other = one.ids[i] != two.ids[j]
                i, j, found = i[other], j[other], found[other]
                if len(i):
                    b.add(*((i, found, two.ids[j]) if b is best[0] else (j, found, one.ids[i])))
        at = end
    return best
