"""Linear one-vs-rest machines by cutting planes: many of them, one per group, C and left-out fold, in the same passes."""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.operators.blocks import Blocks, as_binary, blocks_of
from sigflow.session import ship

#: Bytes of cutting planes that the machines of one wave may have.
WAVE_BYTES = 256 << 20


def solve_simplex(a: np.ndarray, b: np.ndarray, beta: np.ndarray, tol: np.ndarray, steps: int) -> np.ndarray:
    """Minimum of beta A beta / 2 - b beta over the simplex for many small problems at once, by the pair of steepest exchange."""
    out, rest = beta.copy(), np.arange(len(a))
    beta = beta.copy()
    slope = np.einsum("pij,pj->pi", a, beta) - b
    diagonal = np.einsum("pii->pi", a)
    for step in range(steps):
        p = np.arange(len(rest))
        i = slope.argmin(1)
        j = np.where(beta > 0, slope, -np.inf).argmax(1)
        gap = slope[p, j] - slope[p, i]
        active = gap > tol
        if step % 8 == 0 and not active.all():  # go on with what is not yet solved
            out[rest[~active]] = beta[~active]
            rest, a, beta, slope, diagonal, tol, i, j, gap = rest[active], a[active], beta[active], slope[active], diagonal[active], tol[active], i[active], j[active], gap[active]
            p, active = np.arange(len(rest)), np.ones(len(rest), bool)
        if not len(rest):
            break
        curve = np.maximum(diagonal[p, i] + diagonal[p, j] - 2 * a[p, i, j], 1e-15)
        t = np.where(active, np.minimum(beta[p, j], gap / curve), 0.0)
        beta[p, i] += t
        beta[p, j] = np.where(active & (t >= beta[p, j]), 0.0, beta[p, j] - t)
        slope += t[:, None] * (a[p, i] - a[p, j])
    out[rest] = beta
    return out


@dataclass
class LinearMachines:
    classes: list
    settings: list[tuple[int | None, float]]  # (fold left out, C)
    weights: dict[int, np.ndarray]  # by group: (settings, classes, width + 1), the bias last
    ranges: dict[int, np.ndarray]  # by group: (folds left out, 2, width), subtracted and divided by; empty without scaling
    places: list[int]  # of each setting's fold in ``ranges``
    lower: dict[int, np.ndarray]  # by group: (settings, classes), what the minimum cannot fall below
    rounds: int

    def parameters(self) -> int:
        return next((w[0].size for w in self.weights.values()), 0)

    def predict(self, packed: DataFrame) -> DataFrame:
        """(grp, id, setting, fold, label, prediction): the class with the highest score, ties to the first."""
        share = ship(packed.sparkSession).sparkContext.broadcast(self)
        return packed.mapInArrow(partial(_predict, share), "grp long, id long, setting int, fold int, label double, prediction double")


def _predict(share, batches):
    model = share.value
    names = np.array([*map(float, model.classes), np.nan])
    for block, _ in blocks_of(batches):
        if block.group not in model.weights:
            continue
        for s, w in enumerate(model.weights[block.group]):
            best = (_extended(block.x, model.ranges, block.group, model.places[s]) @ w.T).argmax(1)
            n = len(block.ids)
            yield pa.record_batch([pa.array(np.full(n, block.group)), pa.array(block.ids), pa.array(np.full(n, s, np.int32)), pa.array(block.fold), pa.array(names[block.y], mask=block.y < 0), pa.array(names[best])], names=["grp", "id", "setting", "fold", "label", "prediction"])


def objective(model: LinearMachines, packed: DataFrame) -> DataFrame:
    """(grp, setting, cls, value): margin term plus mean hinge loss of each machine over the rows that teach it."""
    share = ship(packed.sparkSession).sparkContext.broadcast(model)

    def run(batches):
        model = share.value
        for block, _ in blocks_of(batches):
            for s, w in enumerate(model.weights.get(block.group, ())):
                fold, c = model.settings[s]
                at = block.y >= 0 if fold is None else (block.fold != fold) & (block.y >= 0)
                sign = np.where(block.y[at][:, None] == np.arange(len(w))[None, :], 1.0, -1.0)
                loss = np.maximum(1 - sign * (_extended(block.x[at], model.ranges, block.group, model.places[s]) @ w.T), 0).sum(0)
                k = len(w)
                yield pa.record_batch([pa.array(np.full(k, block.group)), pa.array(np.full(k, s, np.int32)), pa.array(np.arange(k, dtype=np.int32)), pa.array(loss), pa.array(np.full(k, int(at.sum()))), pa.array((w * w).sum(1) / (2 * c))], names=["grp", "setting", "cls", "loss", "n", "margin"])

    rows = packed.mapInArrow(run, "grp long, setting int, cls int, loss double, n long, margin double")
    return rows.groupBy("grp", "setting", "cls").agg(((F.sum("loss") + F.first("margin")) / F.sum("n")).alias("value"))


def _extended(x: np.ndarray, ranges: dict, group: int, place: int) -> np.ndarray:
    """Vectors with a one for the bias, scaled where there are ranges."""
    if ranges:
        low, span = ranges[group][place]
        x = (x - low) / span
    return np.concatenate([x, np.ones((len(x), 1))], 1)


def _task_ranges(left_out: tuple, batches):
    found: dict[tuple, list] = {}
    for block, _ in blocks_of(batches):
        for h, fold in enumerate(left_out):
            x = block.x if fold is None else block.x[block.fold != fold]
            if len(x):
                at = found.setdefault((block.group, h), [x.min(0), x.max(0)])
                at[0], at[1] = np.minimum(at[0], x.min(0)), np.maximum(at[1], x.max(0))
    for (g, h), (lo, hi) in found.items():
        yield pa.record_batch([pa.array([g], pa.int64()), pa.array([h], pa.int64()), pa.array([as_binary(lo)], pa.binary()), pa.array([as_binary(hi)], pa.binary())], names=["g", "h", "lo", "hi"])


def _merged_ranges(t: pa.Table) -> pa.Table:
    lo, hi = (f([np.frombuffer(v) for v in t.column(c).to_pylist()]) for f, c in ((partial(np.min, axis=0), "lo"), (partial(np.max, axis=0), "hi")))
    return pa.table([t.column("g").slice(0, 1).combine_chunks(), t.column("h").slice(0, 1).combine_chunks(), pa.array([as_binary(lo)], pa.binary()), pa.array([as_binary(hi)], pa.binary())], names=["g", "h", "lo", "hi"])


def training_ranges(packed: Blocks, left_out: tuple) -> dict[int, np.ndarray]:
    """Least value and span of every component over the rows that teach, by group and fold left out; a span of zero counts as one."""
    schema = "g long, h long, lo binary, hi binary"
    rows = packed.frame.mapInArrow(partial(_task_ranges, left_out), schema).groupBy("g", "h").applyInArrow(_merged_ranges, schema).collect()
    out = {g: np.stack([np.zeros((len(left_out), packed.width)), np.ones((len(left_out), packed.width))], 1) for g in packed.groups}
    for r in rows:
        lo, hi = np.frombuffer(r["lo"]), np.frombuffer(r["hi"])
        out[r["g"]][r["h"]] = lo, np.where(hi > lo, hi - lo, 1.0)
    return out


def _planes(share, left_out: tuple, batches):
    """One row a group, fold and task: rows seen, hinge losses and their slopes for every machine."""
    weights, ranges = share.value
    sums: dict[tuple, list] = {}
    for block, _ in blocks_of(batches):
        for h, fold in enumerate(left_out):
            w = weights.get((block.group, h))  # (C's, classes, width + 1)
            at = block.y >= 0 if fold is None else (block.fold != fold) & (block.y >= 0)
            if w is None or not at.any():
                continue
            z = _extended(block.x[at], ranges, block.group, h)
            sign = np.where(block.y[at][:, None] == np.arange(w.shape[1])[None, :], 1.0, -1.0)[:, None, :]
            slack = 1 - sign * np.tensordot(z, w, ([1], [2]))
            inside = np.where(slack > 0, sign, 0.0)
            s = sums.setdefault((block.group, h), [0, np.zeros(w.shape[:2]), np.zeros(w.shape)])
            s[0] += int(at.sum())
            s[1] += np.maximum(slack, 0).sum(0)
            s[2] -= np.tensordot(inside, z, ([0], [0]))
    for (g, h), (n, loss, slope) in sums.items():
        yield pa.record_batch([pa.array([v], pa.int64()) for v in (g, h, n)] + [pa.array([as_binary(loss)], pa.binary()), pa.array([as_binary(slope)], pa.binary())], names=["g", "h", "n", "loss", "slope"])


def _summed(t: pa.Table) -> pa.Table:
    add = lambda c: as_binary(sum(np.frombuffer(v) for v in t.column(c).to_pylist()))
    return pa.table([t.column("g").slice(0, 1).combine_chunks(), t.column("h").slice(0, 1).combine_chunks(), pa.array([sum(t.column("n").to_pylist())], pa.int64()), pa.array([add("loss")], pa.binary()), pa.array([add("slope")], pa.binary())], names=["g", "h", "n", "loss", "slope"])


class _Bundle:
    """The machines of some groups and folds: their planes and the best weights so far. Solved ones leave the arrays."""

    def __init__(self, keys: list[tuple[int, int]], cs: np.ndarray, classes: int, width: int):
        self.keys, self.shape = keys, (len(cs), classes, width)
        self.each = len(cs) * classes
        m = len(keys) * self.each
        self.c = np.tile(np.repeat(cs, classes), len(keys))
        self.now, self.best = np.zeros((m, width)), np.zeros((m, width))
        self.upper, self.lower = np.full(m, np.inf), np.full(m, -np.inf)
        self.open = np.arange(m)
        self.slopes, self.offsets, self.beta = np.zeros((m, 0, width)), np.zeros((m, 0)), np.zeros((m, 0))
        self.gram = np.zeros((m, 0, 0))

    def weights(self) -> dict[tuple[int, int], np.ndarray]:
        """Present weights of every group and fold that has a machine to solve."""
        return {self.keys[k]: self.now[k * self.each : (k + 1) * self.each].reshape(self.shape) for k in np.unique(self.open // self.each).tolist()}

    def add(self, found: dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]], tol: float) -> None:
        """A plane at the present weights of each open machine; then the minimum of all planes and the margin term."""
        n, risk, g = np.ones(len(self.open)), np.zeros(len(self.open)), np.zeros((len(self.open), self.shape[2]))
        for k in np.unique(self.open // self.each).tolist():
            at = np.flatnonzero(self.open // self.each == k)
            if self.keys[k] in found:  # a fold without other rows teaches nothing
                rows, loss, slope = found[self.keys[k]]
                inner = self.open[at] - k * self.each
                n[at], risk[at], g[at] = rows, loss.ravel()[inner] / rows, slope.reshape(self.each, -1)[inner] / rows
        shrink = 1 / (self.c[self.open] * n)
        now = self.now[self.open]
        value = shrink / 2 * (now**2).sum(1) + risk
        better = value < self.upper[self.open]
        self.upper[self.open[better]], self.best[self.open[better]] = value[better], now[better]
        row = np.einsum("pkd,pd->pk", self.slopes, g) / shrink[:, None]
        k = self.slopes.shape[1]
        gram = np.zeros((len(g), k + 1, k + 1))
        gram[:, :k, :k], gram[:, k, :k], gram[:, :k, k], gram[:, k, k] = self.gram, row, row, (g * g).sum(1) / shrink
        slopes = np.concatenate([self.slopes, g[:, None, :]], 1)
        offsets = np.concatenate([self.offsets, (risk - (g * now).sum(1))[:, None]], 1)
        beta = np.concatenate([self.beta, np.full((len(g), 1), float(k == 0))], 1)
        upper = self.upper[self.open]
        beta = solve_simplex(gram, offsets, beta, tol / 20 * np.maximum(upper, 1e-12), 30 * (k + 1))
        now = -np.einsum("pk,pkd->pd", beta, slopes) / shrink[:, None]
        lower = (offsets * beta).sum(1) - shrink / 2 * (now**2).sum(1)
        gap = np.where(upper > 0, (upper - lower) / np.maximum(upper, 1e-300), 0.0)
        self.now[self.open], self.lower[self.open] = now, np.maximum(self.lower[self.open], lower)
        on = gap > tol
        self.open, self.gram, self.slopes, self.offsets, self.beta = self.open[on], gram[on], slopes[on], offsets[on], beta[on]


class LinearSvm:
    """Hinge losses weighed by C against the margin, the bias under the margin term too.

    A round is one pass: tasks sum hinge losses and slopes of all machines at their
    present weights, one row a group, fold and task; the driver puts a plane under each
    loss and moves to the minimum. The planes bound the loss from below, so the share by
    which the best weights may miss the minimum is known. Rounds end when all
    are below ``tol``, or after ``max_rounds``. Machines go in waves whose planes fit
    ``WAVE_BYTES``; a group of any size is as many tasks as it has blocks.
    """

    def __init__(self, cs: tuple[float, ...] = (1.0,), scaled: bool = False, tol: float = 1e-2, max_rounds: int = 100):
        self.cs, self.scaled, self.tol, self.max_rounds = np.array(cs, float), scaled, tol, max_rounds

    def solve(self, packed: Blocks, leave_out: tuple[int | None, ...] = (None,)) -> LinearMachines:
        spark = ship(packed.frame.sparkSession)
        left, n, width = tuple(leave_out), len(packed.classes), packed.width + 1
        ranges = training_ranges(packed, left) if self.scaled else {}
        keys = [(g, h) for g in packed.groups for h in range(len(left))]
        each = len(self.cs) * n * self.max_rounds * width * 8
        size = max(1, WAVE_BYTES // max(each, 1))
        best: dict[tuple, np.ndarray] = {}
        bound: dict[tuple, np.ndarray] = {}
        rounds = 0
        schema = "g long, h long, n long, loss binary, slope binary"
        for lo in range(0, len(keys), size):
            wave = _Bundle(keys[lo : lo + size], self.cs, n, width)
            for _ in range(self.max_rounds):
                if not len(wave.open):
                    break
                rounds += 1
                share = spark.sparkContext.broadcast((wave.weights(), ranges))
                rows = packed.frame.mapInArrow(partial(_planes, share, left), schema).groupBy("g", "h").applyInArrow(_summed, schema).toArrow().to_pylist()
                share.unpersist()
                wave.add({(r["g"], r["h"]): (r["n"], np.frombuffer(r["loss"]), np.frombuffer(r["slope"])) for r in rows}, self.tol)
            for k, key in enumerate(wave.keys):
                at = slice(k * wave.each, (k + 1) * wave.each)
                best[key], bound[key] = wave.best[at].reshape(wave.shape), wave.lower[at].reshape(len(self.cs), n)
        settings = [(h, float(c)) for h in left for c in self.cs]
        weights = {g: np.concatenate([best[g, h] for h in range(len(left))]) for g in packed.groups}
        lower = {g: np.concatenate([bound[g, h] for h in range(len(left))]) for g in packed.groups}
        return LinearMachines(packed.classes, settings, weights, ranges, [h for h in range(len(left)) for _ in self.cs], lower, rounds)
