"""Covariances and symmetric positive-definite matrices in Arrow batches, and means over many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.session import checkpoint, discard, ship


def spectral(m: np.ndarray, f) -> np.ndarray:
    """f applied to the eigenvalues of (..., n, n) symmetric matrices."""
    w, q = np.linalg.eigh(m)
    return (q * f(w)[..., None, :]) @ np.swapaxes(q, -1, -2)


def logm(m: np.ndarray, floor: float = 0.0) -> np.ndarray:
    return spectral(m, lambda w: np.log(np.maximum(w, floor)))


def expm(m: np.ndarray) -> np.ndarray:
    return spectral(m, np.exp)


def sqrtm(m: np.ndarray) -> np.ndarray:
    return spectral(m, np.sqrt)


def invsqrtm(m: np.ndarray) -> np.ndarray:
    return spectral(m, lambda w: 1 / np.sqrt(w))


def half_vector(m: np.ndarray) -> np.ndarray:
    """Diagonal, then the strict upper triangle column by column times the root of two."""
    n = m.shape[-1]
    j, i = np.tril_indices(n, -1)  # (0,1), (0,2), (1,2), ...
    return np.concatenate([np.diagonal(m, axis1=-2, axis2=-1), np.sqrt(2) * m[..., i, j]], -1)


def _batched(m: np.ndarray) -> tuple[np.ndarray, bool]:
    m = np.array(m, float)
    return (m[None], True) if m.ndim == 2 else (m, False)


def reflect(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """H T H of the reflections H = I - 2 v v' of a batch (rows, n, n), as rank-two updates."""
    w = np.einsum("bij,bj->bi", t, v)
    w = w - np.einsum("bi,bi->b", v, w)[:, None] * v
    return t - 2 * v[:, :, None] * w[:, None, :] - 2 * w[:, :, None] * v[:, None, :]


def reflect_basis(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Q H of the same reflections."""
    return q - 2 * np.einsum("bij,bj->bi", q, v)[:, :, None] * v[:, None, :]


def tridiagonal(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(T, Q) with m = Q T Q' of one matrix or a batch: reflections clear one column after the other, in all matrices together."""
    t, one = _batched(m)
    n = t.shape[-1]
    q = np.broadcast_to(np.eye(n), t.shape).copy()
    for k in range(n - 2):
        v = t[:, :, k].copy()
        v[:, : k + 1] = 0
        r = np.linalg.norm(v, axis=1)
        v[:, k + 1] += np.copysign(r, v[:, k + 1])
        v /= np.where(r > 0, np.linalg.norm(v, axis=1), 1.0)[:, None]  # a column that is clear keeps v = 0
        t, q = reflect(t, v), reflect_basis(q, v)
    return (t[0], q[0]) if one else (t, q)


def rotation(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(c, s) with c a - s b = r and s a + c b = 0."""
    r = np.hypot(a, b)
    safe = np.where(r == 0, 1.0, r)
    return np.where(r == 0, 1.0, a / safe), np.where(r == 0, 0.0, -b / safe)


def _rotate(x: np.ndarray, at: np.ndarray, k: int, c: np.ndarray, s: np.ndarray) -> None:
    """Columns k and k + 1 of the chosen matrices."""
    left, right = x[at, :, k], x[at, :, k + 1]
    x[at, :, k], x[at, :, k + 1] = c[:, None] * left - s[:, None] * right, s[:, None] * left + c[:, None] * right


def tridiagonal_eigen(t: np.ndarray, q: np.ndarray, eps: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors) of symmetric tridiagonal matrices by shifted rotations, vectors starting from ``q``; one matrix or a batch.

    Each matrix works on its last block that is not yet diagonal. The shift is the
    eigenvalue of the block's trailing 2 x 2 part nearest its last entry; an
    off-diagonal entry at or below ``eps`` times its neighbours ends a block. The
    sweeps of all matrices go along together; those that are diagonal rest.
    """
    (t, one), (q, _) = _batched(t), _batched(q)
    n = t.shape[-1]
    below = np.arange(n - 1)
    for _ in range(60 * n):
        d = np.abs(np.diagonal(t, axis1=1, axis2=2))
        off = np.abs(t[:, below + 1, below])
        row, k = np.nonzero(off <= eps * (d[:, :-1] + d[:, 1:]))
        t[row, k + 1, k] = t[row, k, k + 1] = 0.0
        linked = t[:, below + 1, below] != 0
        busy = np.flatnonzero(linked.any(1))
        if not len(busy):
            break
        live = linked[busy]
        hi = n - 1 - live[:, ::-1].argmax(1)  # the block ends here
        upto = np.arange(n - 1)[None, :] < hi[:, None]
        gap = np.where(upto & ~live, np.arange(n - 1)[None, :], -1).max(1)
        lo = gap + 1
        corner, last, b = t[busy, hi - 1, hi - 1], t[busy, hi, hi], t[busy, hi, hi - 1]
        half = (corner - last) / 2
        shift = last - b * b / (half + np.copysign(np.hypot(half, b), np.where(half == 0, 1.0, half)))
        for k in range(n - 1):
            on = np.flatnonzero((lo <= k) & (k < hi))
            if not len(on):
                continue
            at, first = busy[on], lo[on] == k
            x = np.where(first, t[at, k, k] - shift[on], t[at, k, k - 1] if k else 0.0)
            z = np.where(first, t[at, k + 1, k], t[at, k + 1, k - 1] if k else 0.0)
            c, s = rotation(x, z)
            _rotate(t, at, k, c, s)
            _rotate(np.swapaxes(t, 1, 2), at, k, c, s)
            _rotate(q, at, k, c, s)
    w = np.diagonal(t, axis1=1, axis2=2).copy()
    return (w[0], q[0]) if one else (w, q)


def eigen(m: np.ndarray, eps: float = 1e-14) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, vectors) of symmetric matrices by reflections and rotations, ascending."""
    w, q = tridiagonal_eigen(*tridiagonal(m), eps)
    order = np.argsort(w, -1)
    return np.take_along_axis(w, order, -1), np.take_along_axis(q, order[..., None, :], -1)


def epsilon_for_accuracy(matrices: DataFrame, column: str, n: int, accuracy: float) -> float:
    """Largest power of ten at which every matrix is rebuilt, and its eigenvalues met, within ``accuracy``; one aggregation a try."""
    eps = 0.1

    def worst(e: float):
        def run(m: np.ndarray) -> np.ndarray:
            if not len(m):
                return np.zeros((0, 1))
            w, q = eigen(m, e)
            back = np.abs(q * w[:, None, :] @ np.swapaxes(q, 1, 2) - m).max((1, 2))
            return np.maximum(back, np.abs(w - np.linalg.eigvalsh(m)).max(1))[:, None]

        return run

    while eps > 1e-18:
        e = map_matrices(matrices.select(column), column, n, worst(eps), "e").agg(F.max(F.get("e", F.lit(0)))).first()[0]
        if e is None or e <= accuracy:
            return eps
        eps *= 0.1
    return eps


def stacked(column: pa.Array, rows: int) -> np.ndarray:
    """(signals, rows, columns) of an array column, from the Arrow buffer; a null or ragged signal is an error that says so."""
    if column.null_count or (len(column) and len(set(np.diff(column.offsets.to_numpy()).tolist())) > 1):
        raise ValueError("a signal is null, or signals differ in length: filter or pad them first")
    flat = column.flatten().cast(pa.float64())
    if flat.null_count or (len(column) and len(flat) % (len(column) * rows)):
        raise ValueError("a signal holds a null or does not divide into its channels")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), rows, -1) if len(column) else np.zeros((0, rows, 0))


def nested(x: np.ndarray) -> pa.Array:
    """An array column with one row for each of x, whatever its shape."""
    flat = np.ascontiguousarray(x, float).reshape(len(x), -1) if len(x) else np.zeros((0, 0))
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


def map_matrices(df: DataFrame, column: str, n: int, f, out: str = "m", out_type: str = "array<double>") -> DataFrame:
    """f on (rows, n, n) of an array column, batch by batch; nothing but the batch is held."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            x = stacked(b.column(at), n)
            y = np.asarray(f(x)).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 1))
            yield pa.record_batch([*b.columns, nested(y)], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(out_type))]))


def covariance(df: DataFrame, column: str, channels: int, rho: float = 1.0, out: str = "cov") -> DataFrame:
    """X X' / (T - 1) + rho / T I of channel-major signals in one array."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            x = stacked(b.column(at), channels)
            t = max(x.shape[2], 1)
            c = x @ np.swapaxes(x, 1, 2) / max(t - 1, 1) + rho / t * np.eye(channels)
            yield pa.record_batch([*b.columns, nested(c)], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def mean_euclid(df: DataFrame, keys: list[str], column: str, n: int) -> dict[tuple, np.ndarray]:
    """``means.euclid_means`` of the few keys of a model, on the driver."""
    from sigflow.operators.means import euclid_means

    return {tuple(r[k] for k in keys): np.array(r["mean"]).reshape(n, n) for r in euclid_means(df, keys, column, n).collect()}


def mean_riemann(df: DataFrame, keys: list[str], column: str, n: int, tol: float = 1e-8, rounds: int = 50) -> dict[tuple, np.ndarray]:
    """``means.karcher_means`` of the few keys of a model, on the driver."""
    from sigflow.operators.means import karcher_means

    return {tuple(r[k] for k in keys): np.array(r["mean"]).reshape(n, n) for r in karcher_means(df, keys, column, n, tol, rounds).collect()}


class RiemannFeatures:
    """Multiscale features: slice, filter, covariance, whiten, log, half-vector.

    ``option`` is Riemann, Riemann_Euclid, Whitened_Euclid (no logarithm) or
    No_Adaptation (no whitening). ``fit`` gives a new model and leaves this one as it
    was. Windows are sliced before they are filtered, so that each starts from rest.
    """

    OPTIONS = ("Riemann", "Riemann_Euclid", "Whitened_Euclid", "No_Adaptation")

    def __init__(self, channels: int, windows: list[tuple[int, int]], bank: list[np.ndarray], rho: float = 1.0, option: str = "Riemann", references: dict | None = None):
        if option not in self.OPTIONS:
            raise ValueError(f"unknown option {option}")
        self.channels, self.windows, self.bank, self.rho, self.option, self.references = channels, windows, bank, rho, option, references

    def whole_signal(self) -> RiemannFeatures:
        """The same references on a single window that is the whole signal, for trials cut to it already."""
        return RiemannFeatures(self.channels, [(0, None)], self.bank, self.rho, self.option, self.references)

    def covariances(self, trials: DataFrame, column: str = "x") -> DataFrame:
        """Rows of ``trials`` times (win, band, cov): one pass, no shuffle. ``column`` is channel-major."""
        from sigflow.operators.filters import sos_float

        ship(trials.sparkSession)
        at, c, windows, bank, rho = trials.columns.index(column), self.channels, self.windows, self.bank, self.rho
        kept = [f for f in trials.schema.fields if f.name != column]

        def run(batches):
            for b in batches:
                x = stacked(b.column(at), c)
                rest = [b.column(k) for k in range(b.num_columns) if k != at]
                for w, (lo, hi) in enumerate(windows):
                    part = x[:, :, lo:hi]
                    t = part.shape[2]
                    for f, sos in enumerate(bank):
                        y = sos_float(part.reshape(-1, t), sos).reshape(part.shape) if sos is not None else part
                        m = y @ np.swapaxes(y, 1, 2) / (t - 1) + rho / t * np.eye(c)
                        n = b.num_rows
                        yield pa.record_batch([*rest, pa.array(np.full(n, w, np.int32)), pa.array(np.full(n, f, np.int32)), nested(m)], names=[*(k.name for k in kept), "win", "band", "cov"])

        schema = T.StructType([*kept, T.StructField("win", T.IntegerType()), T.StructField("band", T.IntegerType()), T.StructField("cov", T.ArrayType(T.DoubleType()))])
        return trials.mapInArrow(run, schema)

    def fit(self, trials: DataFrame, column: str = "x") -> RiemannFeatures:
        if self.option == "No_Adaptation":
            return self._fit(None)
        cov = checkpoint(self.covariances(trials, column).select("band", "cov"))
        model = self._fit(cov)
        discard(cov)
        return model

    def _fit(self, cov: DataFrame | None) -> RiemannFeatures:
        if self.option == "No_Adaptation":
            refs = {f: np.eye(self.channels) for f in range(len(self.bank))}
        else:
            mean = mean_riemann if self.option == "Riemann" else mean_euclid
            refs = {k[0]: invsqrtm(m) for k, m in mean(cov, ["band"], "cov", self.channels).items()}
        return RiemannFeatures(self.channels, self.windows, self.bank, self.rho, self.option, refs)

    def fit_transform(self, trials: DataFrame, key: str, column: str = "x") -> tuple[RiemannFeatures, DataFrame]:
        """The fitted model and the features of its own trials; the signals are filtered once."""
        cov = checkpoint(self.covariances(trials.select(key, column), column))
        model = self._fit(cov.select("band", "cov"))
        return model, model._features(cov, key, False)

    def transform(self, trials: DataFrame, key: str, column: str = "x", trace: bool = False) -> DataFrame:
        """(key, f), f over windows, bands and components in this order; with ``trace`` one row a window and band, all stages. Narrow either way."""
        if not trace:
            return self.append(trials.select(key, column), column).select(key, "f")
        return self._features(self.covariances(trials.select(key, column), column), key, trace)

    def append(self, trials: DataFrame, column: str = "x", out: str = "f") -> DataFrame:
        """``trials`` with a column of features more: one narrow pass."""
        from sigflow.operators.filters import sos_float

        if self.references is None:
            raise ValueError("fit first")
        ship(trials.sparkSession)
        at, c, windows, bank, rho, refs, log = trials.columns.index(column), self.channels, self.windows, self.bank, self.rho, self.references, self.option != "Whitened_Euclid"

        def run(batches):
            for b in batches:
                x, parts = stacked(b.column(at), c), []
                for lo, hi in windows if len(x) else ():
                    part = x[:, :, lo:hi]
                    t = part.shape[2]
                    for f, sos in enumerate(bank):
                        y = sos_float(part.reshape(-1, t), sos).reshape(part.shape) if sos is not None else part
                        white = refs[f] @ (y @ np.swapaxes(y, 1, 2) / (t - 1) + rho / t * np.eye(c)) @ refs[f]
                        parts.append(half_vector(logm(white) if log else white))
                yield pa.record_batch([*b.columns, nested(np.concatenate(parts, 1) if parts else np.zeros((0, 0)))], names=[*b.schema.names, out])

        return trials.mapInArrow(run, T.StructType([*trials.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))

    def _features(self, covariances: DataFrame, key: str, trace: bool) -> DataFrame:
        if self.references is None:
            raise ValueError("fit first")
        refs, c, log = self.references, self.channels, self.option != "Whitened_Euclid"
        schema = T.StructType([covariances.schema[key], *(T.StructField(n, T.IntegerType()) for n in ("win", "band")), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("cov", "white", "kernel", "f"))])

        def run(batches):
            for b in batches:
                m = stacked(b.column(3), c)
                r = np.stack([refs[k] for k in b.column(2).to_pylist()]) if b.num_rows else np.zeros((0, c, c))
                white = r @ m @ r
                kernel = logm(white) if log else white
                yield pa.record_batch([*b.columns[:3], *map(nested, (m, white, kernel, half_vector(kernel)))], names=schema.names)

        rows = covariances.select(key, "win", "band", "cov").mapInArrow(run, schema)
        if trace:
            return rows
        parts = F.array_sort(F.collect_list(F.struct("win", "band", "f")))
        return rows.groupBy(key).agg(parts.alias("p")).select(key, F.flatten(F.transform("p", lambda s: s.f)).alias("f"))


def spatial_filters(first: np.ndarray, second: np.ndarray, pairs: int) -> np.ndarray:
    """Generalised eigenvectors of two class covariances: the ``pairs`` of smallest and of largest magnitude, as columns."""
    low = np.linalg.inv(np.linalg.cholesky(second))
    w, v = np.linalg.eigh(low @ first @ low.T)
    v = low.T @ v
    order = np.argsort(np.abs(w), kind="stable")
    return v[:, np.concatenate([order[:pairs], order[len(order) - pairs :]])]


def csp_filters(cov: DataFrame, label: str, column: str, n: int, pairs: int = 1) -> dict[tuple[int, int], np.ndarray]:
    """Spatial filters of each pair of classes, from class mean covariances summed where they lie."""
    from sigflow.operators.means import euclid_means, pair_filters

    out: dict[tuple[int, int], list] = {}
    for r in sorted(pair_filters(euclid_means(cov, [label], column, n), [], label, n, pairs).collect(), key=lambda r: (r["c1"], r["c2"], r["k"])):
        out.setdefault((r["c1"], r["c2"]), []).append(r["w"])
    return {k: np.array(v).T for k, v in out.items()}


def log_variance(df: DataFrame, column: str, channels: int, w: np.ndarray, sos: np.ndarray | None = None, out: str = "f") -> DataFrame:
    """log10 of the population variance of each spatially filtered (and band-passed) component."""
    return csp_features(df, column, channels, {(0, 0): w}, [(0, None)], [sos], out)


def csp_features(df: DataFrame, column: str, channels: int, w: dict[tuple[int, int], np.ndarray], windows: list[tuple[int, int | None]], bank: list, out: str = "f") -> DataFrame:
    """log10 variances over windows, bands and components in this order; ``w`` has the projection of each (window, band). One narrow pass."""
    from sigflow.operators.filters import sos_float

    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            x = stacked(b.column(at), channels)
            parts = []
            for i, (lo, hi) in enumerate(windows):
                for k, sos in enumerate(bank):
                    y = np.einsum("ck,nct->nkt", w[i, k], x[:, :, lo:hi])
                    if sos is not None:
                        y = sos_float(y.reshape(-1, y.shape[2]), sos).reshape(y.shape)
                    parts.append(np.log10(y.var(2)))
            yield pa.record_batch([*b.columns, nested(np.concatenate(parts, 1) if len(x) else np.zeros((0, 1)))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def csp_projections(trials: DataFrame, label: str, column: str, channels: int, windows: list[tuple[int, int]], bank: list, pairs: int = 1) -> dict[tuple[int, int], np.ndarray]:
    """For each (window, band) the spatial filters of all pairs of classes, side by side; class covariances are summed where they lie."""
    from sigflow.operators.means import euclid_means, pair_filters

    cov = RiemannFeatures(channels, windows, bank, 0.0).covariances(trials.select(label, column), column)
    rows = pair_filters(euclid_means(cov, ["win", "band", label], "cov", channels), ["win", "band"], label, channels, pairs).collect()
    out: dict[tuple[int, int], list] = {}
    for r in sorted(rows, key=lambda r: (r["win"], r["band"], r["c1"], r["c2"], r["k"])):
        out.setdefault((r["win"], r["band"]), []).append(r["w"])
    return {k: np.array(v).T for k, v in out.items()}


def identity_projections(channels: int, windows: int, bands: int) -> dict[tuple[int, int], np.ndarray]:
    return {(i, k): np.eye(channels) for i in range(windows) for k in range(bands)}
