"""The multiscale classifier in integers: calibration by aggregation, then one narrow pass from signals to class scores.

Every stage works on whole Arrow batches; a trial is one row, so nothing but
the calibration's maxima and sums is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.operators import spd
from sigflow.operators.filters import quantize_sos, sos_float, sos_int
from sigflow.session import checkpoint, ship

# Fixed values of the integer model.
BITS, FILTER_BITS, COV_BITS, REF_BITS, WIDE_BITS = 8, 12, 16, 11, 32
SQRT2, SQRT2_SCALE, LOG_FLOOR = 91, 2.0, 1e-3


def _top(bits: int) -> int:
    return 1 << (bits - 1)


def away(x: np.ndarray, scale: float, bits: int) -> np.ndarray:
    """R1 to integers."""
    y = np.asarray(x, float) / scale * _top(bits)
    return np.trunc(np.clip(y + np.sign(y) * 0.5, -_top(bits), _top(bits) - 1)).astype(np.int64)


def even(x: np.ndarray, scale: float, bits: int) -> np.ndarray:
    """R3 to integers."""
    return np.rint(np.clip(np.asarray(x, float) / scale * _top(bits), -_top(bits), _top(bits) - 1)).astype(np.int64)


def half_up(x: np.ndarray, k: int) -> np.ndarray:
    """R4; a shift to the left is an error."""
    if k < 0:
        raise ValueError("shift is to the left")
    return x if k == 0 else (x + (1 << (k - 1))) >> k


def whole(x: float) -> int:
    if abs(x - round(x)) > 1e-7:
        raise ValueError(f"shift {x} is not whole")
    return round(x)


def within(x: np.ndarray, bits: int) -> np.ndarray:
    if x.size and (x.max() >= _top(bits) or x.min() < -_top(bits)):
        raise OverflowError(f"value beyond {bits} bits")
    return x


def filtered(x: np.ndarray, q: dict) -> np.ndarray:
    """(rows, channels, samples) through the integer cascade and its output shift."""
    y = sos_int(x.reshape(-1, x.shape[2]), q).reshape(x.shape)
    return y << q["y_shift"] if q["y_shift"] >= 0 else y >> -q["y_shift"]


def covariance(x: np.ndarray, rho: int, shift: int, device: bool = False) -> np.ndarray:
    """X X' + rho I shifted down with rounding; the device also clips to 16 bits."""
    m = half_up(x @ np.swapaxes(x, 1, 2) + rho * np.eye(x.shape[1], dtype=np.int64), shift)
    return np.clip(m, -_top(COV_BITS), _top(COV_BITS) - 1) if device else m


def whitened(m: np.ndarray, ref: np.ndarray) -> np.ndarray:
    return within(ref @ m @ ref, WIDE_BITS)


def half_vector(m: np.ndarray, diagonal_shift: int, shift: int) -> np.ndarray:
    """Diagonal shifted down, then the triangle column by column times the root of two, both with rounding."""
    j, i = np.tril_indices(m.shape[-1], -1)
    return np.concatenate([half_up(np.diagonal(m, axis1=-2, axis2=-1), diagonal_shift), half_up(m[..., j, i] * SQRT2, shift)], -1)


@dataclass(frozen=True)
class FixedModel:
    """Parameters of the integer model for a time ``window`` (samples from, to) and maybe ``more_windows``; ``fit`` gives a new one with all of them.

    ``bank`` has the floating sections of each band. Scales are those of full range;
    where one stage's output is shifted into the next, they differ by powers of two.
    """

    channels: int
    bank: list
    rho: float = 1.0
    metric: str = "riemann"
    window: tuple = (0, None)
    input_scale: float = 1.0
    filters: list = field(default_factory=list)
    cov_scale: list = field(default_factory=list)
    ref_scale: list = field(default_factory=list)
    refs: list = field(default_factory=list)
    log_scale: float = 1.0
    feature_scale: float = 1.0
    weights: np.ndarray | None = None
    weight_scale: float = 1.0
    bias: np.ndarray | None = None
    rules: str = "golden"
    more_windows: tuple = ()

    def __post_init__(self):
        if self.rules not in ("golden", "trainer"):
            raise ValueError(f"unknown rules {self.rules}")

    def parts(self, column: pa.Array) -> list[np.ndarray]:
        """(rows, channels, samples) of an array column for each window."""
        x = spd.stacked(column, self.channels)
        return [x[:, :, slice(*w)] for w in (self.window, *self.more_windows)]

    @property
    def output_scale(self) -> float:
        """Scale of the 32-bit scores."""
        return self.weight_scale * self.feature_scale * _top(WIDE_BITS) / _top(BITS) ** 2

    def rho_units(self, band: int) -> int:
        """The weight of the identity, in products of two filter outputs."""
        return int((away if self.rules == "trainer" else even)(self.rho, self.wide_scale(band), WIDE_BITS))

    # ---- one band, a batch of trials ------------------------------------------------------------------------------

    def wide_scale(self, band: int) -> float:
        """Scale of 32-bit products of two filter outputs."""
        return self.filters[band]["y_scale"] ** 2 * _top(WIDE_BITS) / _top(BITS) ** 2

    def cov_shift(self, band: int) -> int:
        return whole(np.log2(_top(BITS) ** 2 * self.cov_scale[band] / (self.filters[band]["y_scale"] ** 2 * _top(COV_BITS))))

    def stages(self, x: np.ndarray, band: int) -> dict[str, np.ndarray]:
        """Every integer stage of (rows, channels, samples) eight-bit input.

        ``rules`` says how a stage's output becomes the next one's input: golden shifts
        it down with rounding, as a device does; trainer takes the real value and
        quantises it anew (R1), at the filter's output, covariance, logarithm and features.
        """
        if self.rules == "trainer":
            return self._trainer_stages(x, band)
        y = filtered(x, self.filters[band])
        m = covariance(y, self.rho_units(band), self.cov_shift(band))
        w = whitened(m, self.refs[band])
        real = w * (self.cov_scale[band] / _top(COV_BITS) * (self.ref_scale[band] / _top(REF_BITS)) ** 2)
        log = even(spd.logm(real, LOG_FLOOR), self.log_scale, BITS)
        ratio = whole(np.log2(self.feature_scale / self.log_scale))
        f = half_vector(log, ratio, whole(np.log2(_top(BITS) * self.feature_scale / (self.log_scale * SQRT2_SCALE))))
        return {"filtered": y, "cov": m, "white": w, "log": log, "features": f}

    def _trainer_stages(self, x: np.ndarray, band: int) -> dict[str, np.ndarray]:
        unit = self.filters[band]["y_scale"] / _top(BITS)
        y = np.clip(filtered(x, self.filters[band]), -_top(BITS), _top(BITS) - 1)
        m = away(covariance(y, self.rho_units(band), 0) * unit**2, self.cov_scale[band], COV_BITS)
        w = whitened(m, self.refs[band])
        real = w * (self.cov_scale[band] / _top(COV_BITS) * (self.ref_scale[band] / _top(REF_BITS)) ** 2)
        log = away(spd.logm(real, LOG_FLOOR), self.log_scale, BITS)
        j, i = np.tril_indices(self.channels, -1)
        root = SQRT2 / _top(BITS) * SQRT2_SCALE
        half = np.concatenate([np.diagonal(log, axis1=-2, axis2=-1), root * log[..., j, i]], -1) / _top(BITS) * self.log_scale
        return {"filtered": y, "cov": m, "white": w, "log": log, "features": away(half, self.feature_scale, BITS)}

    # ---- calibration ----------------------------------------------------------------------------------------------

    def _pass(self, trials: DataFrame, column: str, per_band) -> DataFrame:
        """(band, r0, r1, ..., m): what ``per_band(x, band)`` gives for each batch and band: its maxima and a sum of matrices."""
        ship(trials.sparkSession)
        n = len(self.bank)

        def run(batches):
            for b in batches:
                for x in self.parts(b.column(0)):
                    for k in range(n if len(x) else 0):
                        tops, mats = per_band(x, k)
                        yield pa.record_batch([pa.array([k] * len(mats), pa.int32()), *(pa.array([float(t)] * len(mats)) for t in tops), spd.nested(mats)], names=["band", *(f"r{i}" for i in range(3)), "m"])

        return trials.select(column).mapInArrow(run, "band int, r0 double, r1 double, r2 double, m array<double>")

    def _references(self, rows: DataFrame) -> dict[int, np.ndarray]:
        mean = spd.mean_riemann if self.metric == "riemann" else spd.mean_euclid
        return {k[0]: spd.invsqrtm(m) for k, m in mean(rows.select("band", "m"), ["band"], "m", self.channels).items()}

    def fit(self, trials: DataFrame, column: str = "x") -> FixedModel:
        """Ranges of input, filter output, covariance, logarithm and features over all trials, then the integer parameters.

        Two passes over the floating model (ranges up to the covariances; logarithm and
        features under their mean) and one over the integer filters, whose
        covariances give the reference matrices that are kept. A reference matrix whose
        products would leave 32 bits on these trials gets a larger scale.
        """
        model = self

        def floating(x, k):
            y = sos_float(x.reshape(-1, x.shape[2]), model.bank[k]).reshape(x.shape)
            m = y @ np.swapaxes(y, 1, 2) + model.rho * np.eye(model.channels)
            return (np.abs(x).max(), np.abs(y).max(), np.abs(m).max()), m

        rows = checkpoint(self._pass(trials, column, floating))
        tops = {r.band: r for r in rows.groupBy("band").agg(*(F.max(f"r{i}").alias(f"r{i}") for i in range(3))).collect()}
        refs = self._references(rows)
        x_scale = max(r.r0 for r in tops.values())
        logs = rows.mapInArrow(_log_ranges(refs, self.channels), "band int, white double, log double, feature double").groupBy("band").agg(*(F.max(c).alias(c) for c in ("white", "log", "feature"))).collect()
        white, log_scale, feature = {r.band: r.white for r in logs}, max(r.log for r in logs), max(r.feature for r in logs)
        power = lambda to, of: of * 2.0 ** np.ceil(np.log2(to / of))
        y_scale = {k: power(r.r1, x_scale) for k, r in tops.items()}
        model = replace(
            self, input_scale=x_scale, log_scale=log_scale, feature_scale=power(max(feature, log_scale), log_scale),
            filters=[quantize_sos(sos, x_scale, y_scale[k], FILTER_BITS) for k, sos in enumerate(self.bank)], cov_scale=[max(power(tops[k].r2, y_scale[k] ** 2), 2 * y_scale[k] ** 2) for k in range(len(self.bank))],
        )

        def fixed(x, k):
            y = within(np.clip(filtered(away(x, model.input_scale, BITS), model.filters[k]), -_top(BITS), _top(BITS) - 1), BITS)
            m = covariance(y, model.rho_units(k), 0)
            return (0.0, 0.0, 0.0), m * (model.filters[k]["y_scale"] / _top(BITS)) ** 2

        refs = self._references(checkpoint(self._pass(trials, column, fixed)))
        room = [np.sqrt(2.0 ** (REF_BITS + REF_BITS + COV_BITS - WIDE_BITS - 1) * white[k] / model.cov_scale[k]) for k in range(len(self.bank))]
        scale = [2.0 ** np.ceil(np.log2(max(np.abs(refs[k]).max(), room[k]))) for k in range(len(self.bank))]
        return replace(model, ref_scale=scale, refs=[away(refs[k], s, REF_BITS) for k, s in enumerate(scale)])

    # ---- use ------------------------------------------------------------------------------------------------------

    def transform(self, trials: DataFrame, key: str, column: str = "x", trace: bool = False) -> DataFrame:
        """(key, f): eight-bit features (those beyond stay at the limit), bands one after the other, window by window; with ``trace`` every stage as a map of arrays by name and band."""
        ship(trials.sparkSession)
        ints = T.ArrayType(T.LongType())
        extra = [T.StructField("stages", T.MapType(T.StringType(), ints))] if trace else []
        schema = T.StructType([trials.schema[key], T.StructField("f", ints), *extra])

        def run(batches):
            for b in batches:
                parts = [away(x, self.input_scale, BITS) for x in self.parts(b.column(1))] if b.num_rows else []
                got = [self.stages(x, k) for x in parts for k in range(len(self.bank))]
                f = np.clip(np.concatenate([s["features"] for s in got], 1), -_top(BITS), _top(BITS) - 1) if got else np.zeros((0, 0), np.int64)
                columns = [b.column(0), whole_arrays(f)]
                if trace:
                    named = [(f"input{'' if w == 0 else f'_w{w}'}", x) for w, x in enumerate(parts)] + [(f"{n}_{k}", v) for k, s in enumerate(got) for n, v in s.items()]
                    columns.append(pa.array([[(n, v[i].ravel().tolist()) for n, v in named] for i in range(b.num_rows)], pa.map_(pa.string(), pa.list_(pa.int64()))))
                yield pa.record_batch(columns, names=schema.names)

        return trials.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, schema)

    def append(self, trials: DataFrame, column: str = "x", out: str = "f") -> DataFrame:
        """``trials`` with a column of eight-bit features more; narrow. Rows without a signal are left out."""
        ship(trials.sparkSession)
        at = trials.columns.index(column)
        schema = T.StructType([*trials.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))])

        def run(batches):
            for b in batches:
                parts = [away(x, self.input_scale, BITS) for x in self.parts(b.column(at))] if b.num_rows else []
                f = [self.stages(x, k)["features"] for x in parts for k in range(len(self.bank))]
                yield pa.record_batch([*b.columns, whole_arrays(np.clip(np.concatenate(f, 1), -_top(BITS), _top(BITS) - 1) if f else np.zeros((0, 0), np.int64))], names=schema.names)

        return trials.where(F.col(column).isNotNull()).mapInArrow(run, schema)

    def real_features(self, features: DataFrame, column: str = "f") -> DataFrame:
        return features.withColumn(column, F.transform(column, lambda v: v.cast("double") / _top(BITS) * self.feature_scale))

    def with_classifier(self, weights: np.ndarray, bias: np.ndarray) -> FixedModel:
        """Eight-bit weights of (classes, features); the bias joins the 32-bit products."""
        scale = float(np.abs(weights).max()) or 1.0
        model = replace(self, weights=away(weights, scale, BITS), weight_scale=scale)
        return replace(model, bias=even(bias, model.output_scale, WIDE_BITS))

    def scores(self, features: DataFrame, column: str = "f") -> DataFrame:
        """``features`` with exact integer ``scores`` of all classes and the best ``prediction``, ties to the lowest; local to the row."""
        rows = ", ".join("array(" + ", ".join(f"{int(v)}L" for v in w) + ")" for w in self.weights)
        score = f"transform(array({rows}), (w, c) -> aggregate(zip_with({column}, w, (x, y) -> x * y), array({', '.join(f'{int(v)}L' for v in self.bias)})[c], (s, v) -> s + v))"
        wide = f"transform({score}, v -> if(abs(v) >= 2147483648L, cast(raise_error('score beyond 32 bits') as bigint), v))"
        return features.withColumn("scores", F.expr(wide)).withColumn("prediction", F.expr("cast(array_position(scores, array_max(scores)) - 1 as int)"))

    def real_scores(self, scored: DataFrame, column: str = "scores", out: str = "real") -> DataFrame:
        """``scored`` with its 32-bit scores as real numbers too."""
        return scored.withColumn(out, F.transform(column, lambda v: v.cast("double") / _top(WIDE_BITS) * self.output_scale))

    def apply(self, trials: DataFrame, key: str, column: str = "x") -> DataFrame:
        """(key, f, scores, prediction, real): from signals to real scores, every step in integers between."""
        return self.real_scores(self.scores(self.transform(trials, key, column)))

    def parameters(self, spark) -> DataFrame:
        """One row of all parameters."""
        q = [dict(a=f["a"].tolist(), b=f["b"].tolist(), a_shift=f["a_shift"].tolist(), b_shift=f["b_shift"].tolist(), y_shift=f["y_shift"], y_scale=float(f["y_scale"])) for f in self.filters]
        schema = "channels int, rho double, input_scale double, filters array<struct<a: array<array<bigint>>, b: array<array<bigint>>, a_shift: array<bigint>, b_shift: array<bigint>, y_shift: int, y_scale: double>>, cov_scale array<double>, ref_scale array<double>, refs array<array<bigint>>, log_scale double, feature_scale double, svm_weights array<array<bigint>>, weight_scale double, svm_bias array<bigint>, windows array<struct<start: int, stop: int>>, metric string, rules string"
        row = (self.channels, self.rho, float(self.input_scale), [tuple(f.values()) for f in q], list(map(float, self.cov_scale)), list(map(float, self.ref_scale)), [r.ravel().tolist() for r in self.refs], float(self.log_scale), float(self.feature_scale), None if self.weights is None else self.weights.tolist(), float(self.weight_scale), None if self.bias is None else self.bias.tolist(), [tuple(w) for w in (self.window, *self.more_windows)], self.metric, self.rules)
        return spark.createDataFrame([row], schema)

    @classmethod
    def from_row(cls, row, bank: list | None = None) -> FixedModel:
        """The model of a parameter row (see ``sources.reports.load_model``, which checks it)."""
        c = row.channels
        q = [{"a": np.array(f.a), "b": np.array(f.b), "a_shift": np.array(f.a_shift), "b_shift": np.array(f.b_shift), "y_shift": f.y_shift, "y_scale": f.y_scale} for f in row.filters]
        return cls(c, bank or [None] * len(q), row.rho, row.metric, tuple(row.windows[0]), row.input_scale, q, list(row.cov_scale), list(row.ref_scale), [np.array(r).reshape(c, c) for r in row.refs], row.log_scale, row.feature_scale, None if row.svm_weights is None else np.array(row.svm_weights), row.weight_scale, None if row.svm_bias is None else np.array(row.svm_bias), row.rules, tuple(tuple(w) for w in row.windows[1:]))


def whole_arrays(x: np.ndarray) -> pa.Array:
    """An array column of integers, one row for each of x."""
    flat = np.ascontiguousarray(x, np.int64).reshape(len(x), -1) if len(x) else np.zeros((0, 0), np.int64)
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * flat.shape[1], pa.array(flat.ravel()))


def apply_stage(df: DataFrame, column: str, rows: int, stage, out: str) -> DataFrame:
    """``stage`` on the (rows, rows of each, columns) integers of an array column, batch by batch."""
    ship(df.sparkSession)
    at = df.columns.index(column)

    def run(batches):
        for b in batches:
            x = spd.stacked(b.column(at), rows).astype(np.int64)
            yield pa.record_batch([*b.columns, whole_arrays(stage(x) if len(x) else np.zeros((0, 0)))], names=[*b.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.LongType()))]))


def _log_ranges(refs: dict[int, np.ndarray], c: int):
    """Largest whitened value, logarithm and feature of each batch and band."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                m, bands = spd.stacked(b.column(4), c), b.column(0).to_numpy()
                for k in np.unique(bands).tolist():
                    white = refs[k] @ m[bands == k] @ refs[k]
                    log = spd.logm(white, LOG_FLOOR)
                    yield pa.record_batch([pa.array([k], pa.int32()), *(pa.array([float(np.abs(v).max())]) for v in (white, log, spd.half_vector(log)))], names=["band", "white", "log", "feature"])

    return run
