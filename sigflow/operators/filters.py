"""Filter design on the driver (a few coefficients) and filtering of signals in Arrow batches."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.functions import quant as Q
from sigflow.session import ship

FIRST_HZ, FS = 4, 250


def bands(widths: list[int], fs: float = FS, top: int = 40) -> list[tuple[float, float]]:
    """Bands as fractions of the Nyquist frequency; the step is the width for 1 and 2 Hz, else 4 Hz."""
    out = []
    for w in widths:
        step = w if w < 3 else 4
        lo = FIRST_HZ
        while lo + w <= top:
            out.append((2 * lo / fs, 2 * (lo + w) / fs))
            lo += step
    return out


def bands_of(df: DataFrame, width: str, fs: float = FS, top: int = 40) -> DataFrame:
    """``df`` times the bands of each row's width: (band, lo, hi) more, numbered from 0, as fractions of the Nyquist frequency. Widths without a band have no row."""
    w = F.col(width).cast("int")
    step = F.when(w < 3, w).otherwise(4)
    starts = F.when((w > 0) & (w <= top - FIRST_HZ), F.sequence(F.lit(FIRST_HZ), F.lit(top) - w, step))
    cut = df.select("*", F.posexplode(starts).alias("band", "at"))
    return cut.select(*df.columns, "band", (2.0 * F.col("at") / fs).alias("lo"), (2.0 * (F.col("at") + w) / fs).alias("hi"))


def design(rows: DataFrame, order: int = 2, quantised: bool = False) -> DataFrame:
    """``rows`` with the sections of the band-pass from ``lo`` to ``hi`` of each: an array of arrays (b0, b1, b2, a0, a1, a2), and with ``quantised`` the integer form too. Each row by itself."""
    ship(rows.sparkSession)
    at = [rows.columns.index(c) for c in ("lo", "hi")]
    nest = T.ArrayType(T.ArrayType(T.DoubleType()))
    ints = T.ArrayType(T.ArrayType(T.LongType()))
    extra = [T.StructField("sos", nest)]
    if quantised:
        extra += [T.StructField("a", ints), T.StructField("b", ints), T.StructField("a_shift", ints.elementType), T.StructField("b_shift", ints.elementType), T.StructField("y_shift", T.IntegerType())]

    def run(batches):
        for b in batches:
            bank = [butter_band(order, lo, hi) for lo, hi in zip(*(b.column(k).to_pylist() for k in at))]
            columns = [pa.array([s.tolist() for s in bank], pa.list_(pa.list_(pa.float64())))]
            if quantised:
                q = [quantize_sos(s, 1.0, 1.0) for s in bank]
                columns += [pa.array([v[c].tolist() for v in q], pa.list_(pa.list_(pa.int64()))) for c in ("a", "b")]
                columns += [pa.array([v[c].tolist() for v in q], pa.list_(pa.int64())) for c in ("a_shift", "b_shift")]
                columns.append(pa.array([v["y_shift"] for v in q], pa.int32()))
            yield pa.record_batch([*b.columns, *columns], names=[*b.schema.names, *(f.name for f in extra)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *extra]))


def butter_band(order: int, lo: float, hi: float) -> np.ndarray:
    """(order, 6) second-order sections of a digital Butterworth band-pass; lo and hi as fractions of Nyquist.

    Poles of the analogue prototype go through the low-pass to band-pass map and
    the bilinear transform. Sections are made from the pole pair nearest the unit circle
    on, each with the two zeros (at 1 or -1) nearest to its pole; the first made is the
    last in the cascade. The gain sits in the first section.
    """
    k = np.arange(order)
    proto = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    wlo, whi = 4 * np.tan(np.pi * np.array([lo, hi]) / 2)
    width, centre = whi - wlo, wlo * whi
    half = proto * width / 2
    root = np.sqrt(half * half - centre)
    analog = np.concatenate([half + root, half - root])
    digital = (4 + analog) / (4 - analog)
    gain = np.real(width**order * 4.0**order / np.prod(4 - analog))
    up = [(p, np.conj(p)) for p in digital[digital.imag > 1e-12]]
    real = sorted(digital[np.abs(digital.imag) <= 1e-12].real, key=abs, reverse=True)
    zeros = [1.0] * order + [-1.0] * order
    sections = []
    for p, q in sorted(up + list(zip(real[::2], real[1::2])), key=lambda pair: abs(1 - abs(pair[0]))):
        near = [zeros.pop(min(range(len(zeros)), key=lambda i: abs(p - zeros[i]))) for _ in range(2)]
        sections.insert(0, [1.0, -sum(near), near[0] * near[1], 1.0, -np.real(p + q), np.real(p * q)])
    sos = np.array(sections)
    sos[0, :3] *= gain
    return sos


def band_pass_hz(low: float, high: float, fs: float, order: int = 5) -> np.ndarray:
    """Sections of a Butterworth band-pass between two frequencies in Hz."""
    return butter_band(order, 2 * low / fs, 2 * high / fs)


def fir_band(taps: int, lo: float, hi: float) -> np.ndarray:
    """Band-pass by the window method: difference of two ideal low-passes under a Hamming window, unit gain mid-band."""
    m = np.arange(taps) - (taps - 1) / 2
    h = (hi * np.sinc(hi * m) - lo * np.sinc(lo * m)) * np.hamming(taps)
    return h / np.sum(h * np.cos(np.pi * m * (lo + hi) / 2))


def filter_bank(widths: list[int], fs: float = FS, order: int = 4, top: int = 40, kind: str = "butter") -> np.ndarray:
    make = {"butter": butter_band, "fir": fir_band}[kind]
    return np.stack([make(order, *b) for b in bands(widths, fs, top)])


def quantize_sos(sos: np.ndarray, x_scale: float, y_scale: float, bits: int = 12, reserve: int = 0) -> dict:
    """Integer sections with their shifts: a and b are scaled by the next power of two of their largest magnitude; the output goes ``y_shift`` to the left."""
    a_exp = np.ceil(np.log2(np.abs(sos[:, 3:]).max(1))).astype(int)
    b_exp = np.ceil(np.log2(np.abs(sos[:, :3]).max(1))).astype(int)
    top = 1 << (bits - 1)

    def q(c: np.ndarray, e: np.ndarray) -> np.ndarray:
        y = c / np.exp2(e)[:, None] * top
        return np.clip(y + np.sign(y) * 0.5, -top, top - 1).astype(np.int64)

    return {
        "a": q(sos[:, 3:], a_exp), "b": q(sos[:, :3], b_exp), "a_shift": (bits - 1) - a_exp, "b_shift": np.full(len(sos), reserve + bits - 1),
        "a_scale": np.exp2(a_exp), "b_scale": np.exp2(b_exp), "y_shift": int(np.round(np.log2(x_scale / y_scale))) + int((b_exp + reserve).sum()), "y_scale": y_scale,
    }


def sos_float(x: np.ndarray, sos: np.ndarray) -> np.ndarray:
    """Causal filtering of (signals, samples) from rest; vectorised over signals, which lie side by side in memory."""
    y = np.ascontiguousarray(np.asarray(x, float).T)
    if np.shares_memory(y, x):
        y = y.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        z1, z2 = np.zeros(y.shape[1]), np.zeros(y.shape[1])
        for v in y:
            o = b0 * v + z1
            z1, z2 = b1 * v - a1 * o + z2, b2 * v - a2 * o
            v[:] = o
    return np.ascontiguousarray(y.T)


def _half_up(x: np.ndarray, k: int) -> np.ndarray:
    return x if k == 0 else (x + (1 << (k - 1))) >> k


def sos_int(x: np.ndarray, q: dict, bits: int = 16, device: bool = False) -> np.ndarray:
    """Integer direct form 1 of (signals, samples) from rest; int64 throughout.

    The device variant subtracts the first section's denominator shift from every
    numerator shift. A register beyond ``bits`` bits is an error.
    """
    y = np.array(np.asarray(x).T, np.int64, order="C")  # signals side by side in memory
    a, b = np.asarray(q["a"], np.int64), np.asarray(q["b"], np.int64)
    for m in range(len(a)):
        sa = int(q["a_shift"][m])
        sb = int(q["b_shift"][m]) - (int(q["a_shift"][0]) if device else sa)
        x1, x2, y1, y2 = np.zeros((4, y.shape[1]), np.int64)
        for v in y:
            acc = _half_up(b[m, 0] * v + b[m, 1] * x1 + b[m, 2] * x2, sb) - a[m, 1] * y1 - a[m, 2] * y2
            o = _half_up(acc, sa)
            x1, x2, y1, y2 = v.copy(), x1, o, y1
            v[:] = o
        if y.size and (y.max() >= 1 << (bits - 1) or y.min() < -(1 << (bits - 1))):
            raise OverflowError("filter register overflow")
    return np.ascontiguousarray(y.T)


def sos_int_floor(x: np.ndarray, q: dict, bits: int = 16, form: int = 1) -> np.ndarray:
    """Integer cascade whose numerator and denominator sums are shifted down apart, without rounding.

    Form 1 keeps inputs and outputs of each section, form 2 its inner state, on which
    the next stage applies the numerator. A sum that leaves ``bits`` bits upwards stays at
    2**(bits - 1); one that leaves them downwards is not limited.
    """
    v = np.array(x, np.int64)
    a, b, top = np.asarray(q["a"], np.int64), np.asarray(q["b"], np.int64), 1 << (bits - 1)
    state = np.zeros((len(a) + 1, 3, len(v)), np.int64)
    for t in range(v.shape[1]):
        if form == 1:
            state[0, 1:] = state[0, :-1]
        state[0, 0] = v[:, t]
        for m in range(1, len(a) + 1):
            state[m, 1:] = state[m, :-1]
            if form == 1:
                acc = np.tensordot(b[m - 1], state[m - 1], 1) >> int(q["b_shift"][m - 1])
            else:
                acc = state[0, 0] if m == 1 else np.tensordot(b[m - 2], state[m - 1], 1) >> int(q["b_shift"][m - 2])
            acc = acc - (np.tensordot(a[m - 1, 1:], state[m, 1:], 1) >> int(q["a_shift"][m - 1]))
            state[m, 0] = np.minimum(acc, top)
        v[:, t] = state[-1, 0] if form == 1 else np.tensordot(b[-1], state[-1], 1) >> int(q["b_shift"][-1])
    return v


def fir_same(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Centred convolution of (signals, samples), as long as the input."""
    n, k = x.shape[1], len(h)
    full = np.zeros((len(x), n + k - 1), np.result_type(x, h))
    for j, c in enumerate(h):
        full[:, j : j + n] += c * x
    at = (k - 1) // 2
    return full[:, at : at + n]


_RUN = {"sos_float": sos_float, "sos_int": sos_int, "sos_int_device": partial(sos_int, device=True), "sos_int_floor": sos_int_floor, "sos_int_form2": partial(sos_int_floor, form=2), "fir": fir_same}


def apply_filter(df: DataFrame, column: str, kind: str, coefficients, out: str = "y") -> DataFrame:
    """Filter the array column of every row; one signal a row, so no sort and no shuffle.

    Signals of one batch are filtered together; shorter ones are padded behind
    their end, which a causal filter does not see (FIR signals are grouped by length).
    A null signal gives null, an empty one an empty result.
    """
    ship(df.sparkSession)
    whole = kind.startswith("sos_int") or (kind == "fir" and np.asarray(coefficients).dtype.kind == "i")
    dtype, arrow, sql = (np.int64, pa.int64(), T.LongType()) if whole else (np.float64, pa.float64(), T.DoubleType())
    run, at = _RUN[kind], df.columns.index(column)

    def batchwise(batches):
        for b in batches:
            col = b.column(at)
            size = pc.fill_null(pc.list_value_length(col), 0).to_numpy().astype(np.int64)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype)
            ends = np.cumsum(size)
            y = np.empty(len(flat), dtype)
            group = size if kind == "fir" else -(-size // 64)
            for g in np.unique(group[size > 0]).tolist():
                rows = np.flatnonzero((group == g) & (size > 0))
                x = np.zeros((len(rows), int(size[rows].max())), dtype)
                inside = np.arange(x.shape[1])[None, :] < size[rows, None]
                place = (ends - size)[rows, None] + np.arange(x.shape[1])[None, :]
                x[inside] = flat[place[inside]]
                y[place[inside]] = run(x, coefficients)[inside]
            found = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(y, arrow))
            if col.null_count:
                found = pc.if_else(col.is_valid(), found, pa.scalar(None, found.type))
            yield pa.record_batch([*b.columns, found], names=[*b.schema.names, out])

    return df.mapInArrow(batchwise, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(sql))]))


#: What of the padded output each mode keeps, in sections cut from the front and from the back.
MODES = {"sosfilt": (0, 2), "same": (1, 1), "valid": (2, 2), "full": (0, 0)}


def quantised_filter(df: DataFrame, column: str, q: dict, scale: float, mode: str = "sosfilt", kind: str = "sos_int", out: str = "y") -> DataFrame:
    """Eight-bit input (truncated), integer cascade over the signal and two zeros a section behind it, output shift, floating output of scale y_scale."""
    m = len(q["a"])
    front, back = MODES[mode]
    padded = df.withColumn("_q", F.concat(F.transform(column, lambda v: Q.truncate(v, scale, 8)), F.array_repeat(F.lit(0).cast("bigint"), 2 * m)))
    rows = apply_filter(padded, "_q", kind, q, "_y").drop("_q")
    kept = F.slice("_y", F.lit(1 + front * m), F.greatest(F.size("_y") - (front + back) * m, F.lit(0)))
    return rows.withColumn(out, F.transform(kept, lambda v: output_shift(v, q["y_shift"]).cast("double") / 128.0 * q["y_scale"])).drop("_y")


def output_shift(y: Column, k: int) -> Column:
    """The last shift of a cascade: to the left, or down without rounding."""
    return F.shiftleft(y, k) if k >= 0 else Q.shift_floor(y, -k)


def with_pass_through(q: dict, bits: int = 12) -> dict:
    """The cascade as whole arrays with a section in front that changes nothing."""
    one, shift = np.full((1, 3), 1 << (bits - 1)), np.array([bits - 1])
    return {**q, **{k: np.concatenate([one, q[k]]) for k in ("a", "b")}, **{k: np.concatenate([shift, q[k]]) for k in ("a_shift", "b_shift")}}


def amplitudes(freqs: np.ndarray, sos: np.ndarray, bits: int = 12, reserve: int = 0, samples: int = 1000, tail: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Amplitudes of the filtered unit cosine: all in integers, in floating point, and with quantised coefficients. ``freqs`` in radians a sample."""
    x = np.cos(freqs[:, None] * np.arange(samples)[None, :])
    exact = sos_float(x, sos)
    y_scale = np.exp2(np.ceil(np.log2(np.maximum(np.abs(exact).max(1), 1e-300))))
    q = quantize_sos(sos, 1.0, 1.0, bits, reserve)
    top = 1 << (bits - 1)
    coarse = np.concatenate([q["b"] / top * q["b_scale"][:, None], q["a"] / top * q["a_scale"][:, None]], 1)
    y = sos_int(np.trunc(np.clip(x / 2 * 128, -128, 127)), q)
    shift = np.round(np.log2(2 / y_scale)).astype(int) + q["y_shift"]
    y = np.where(shift[:, None] >= 0, y << np.maximum(shift, 0)[:, None], y >> np.maximum(-shift, 0)[:, None]) / 128 * y_scale[:, None]
    return tuple(np.abs(v[:, -tail:]).max(1) for v in (y, exact, sos_float(x, coarse)))


def sweep(freqs: DataFrame, bank: list[np.ndarray], bits: int = 12) -> DataFrame:
    """(band, f, integer, float, quantised) amplitudes of every band at every frequency ``f`` (radians a sample)."""
    ship(freqs.sparkSession)

    def run(batches):
        for b in batches:
            f = b.column(0).to_numpy()
            for k, sos in enumerate(bank):
                yield pa.record_batch([pa.array(np.full(len(f), k, np.int32)), pa.array(f), *map(pa.array, amplitudes(f, sos, bits))], names=["band", "f", "integer", "float", "quantised"])

    return freqs.select(F.col("f").cast("double")).mapInArrow(run, "band int, f double, integer double, float double, quantised double")


def signal_errors(x: np.ndarray, sos: np.ndarray, bits: int, reserve: int) -> np.ndarray:
    """(l1, l2, log) of each of (signals, samples) within [-1, 1]: the all-integer filter's output against the exact one, and the difference of the logarithms of their root mean squares. NaN where registers overflow."""
    exact = sos_float(x, sos)
    y_scale = float(np.exp2(np.ceil(np.log2(max(np.abs(exact).max(initial=0), 1e-300)))))
    q = quantize_sos(sos, 1.0, y_scale, bits, reserve)
    try:
        y = sos_int(np.trunc(np.clip(x * 128, -128, 127)).astype(np.int64), q)
    except OverflowError:
        return np.full((len(x), 3), np.nan)
    y = (y << q["y_shift"] if q["y_shift"] >= 0 else y >> -q["y_shift"]) / 128 * y_scale
    power = lambda v: np.log(np.maximum(np.sqrt((v * v).mean(1)), 1e-6)) if v.shape[1] else np.zeros(len(v))
    return np.stack([np.abs(y - exact).sum(1), ((y - exact) ** 2).sum(1), np.abs(power(y) - power(exact))], 1)


#: Samples times settings that are worked on at once.
CELLS = 1 << 20


def errors_of_settings(x: np.ndarray, size: np.ndarray, sos: np.ndarray, settings: list[tuple[int, int]]) -> np.ndarray:
    """``signal_errors`` of every (bits, reserve) and signal, (settings, signals, 3): signals of ``size`` samples side by side, zeros behind their ends."""
    inside = np.arange(x.shape[1])[:, None] < size[None, :]
    exact = np.where(inside, sos_float(x, sos).T, 0)
    power = lambda v: np.where(size > 0, np.log(np.maximum(np.sqrt((v * v).sum(-2) / np.maximum(size, 1)), 1e-6)), 0)
    scale = np.exp2(np.ceil(np.log2(np.maximum(np.abs(exact).max(0, initial=0), 1e-300))))
    qs = [quantize_sos(sos, 1.0, 1.0, *s) for s in settings]
    at = lambda k, m: np.array([q[k][m] for q in qs], np.int64)
    half_up = lambda v, k: (v + ((1 << k) >> 1)) >> k
    y = np.repeat(np.trunc(np.clip(x.T * 128, -128, 127)).astype(np.int64)[:, None, :], len(qs), 1)  # samples, settings, signals
    over = np.zeros(y.shape[1:], bool)
    for m in range(len(sos)):
        (b0, b1, b2), (_, a1, a2) = (at(k, m).T[:, :, None] for k in "ba")
        sa, sb = at("a_shift", m)[:, None], (at("b_shift", m) - at("a_shift", m))[:, None]
        x1, x2, y1, y2 = np.zeros((4, *y.shape[1:]), np.int64)
        for v in y:
            o = half_up(half_up(b0 * v + b1 * x1 + b2 * x2, sb) - a1 * y1 - a2 * y2, sa)
            x1, x2, y1, y2 = v.copy(), x1, o, y1
            v[:] = o
        over |= (((y >= 1 << 15) | (y < -(1 << 15))) & inside[:, None, :]).any(0)
    out = np.empty((len(qs), len(size), 3))
    for k, q in enumerate(qs):
        shift = np.round(-np.log2(scale)).astype(np.int64) + q["y_shift"]
        got = np.where(shift >= 0, y[:, k] << np.maximum(shift, 0), y[:, k] >> np.maximum(-shift, 0)) / 128 * scale
        off = np.where(inside, got - exact, 0)
        out[k] = np.stack([np.abs(off).sum(0), (off * off).sum(0), np.abs(power(np.where(inside, got, 0)) - power(exact))], 1)
    out[over] = np.nan
    return out


def bits_search(signals: DataFrame, column: str, bank: list[np.ndarray], widths: list[int], reserves: list[int]) -> DataFrame:
    """(bits, reserve, l1, l2, log, rank_l1, rank_l2, rank_log, best) of integer filters with so many coefficient bits on real signals.

    A task runs all settings side by side over many signals of like length at once and
    sends one row of summed errors a setting. A setting that overflows on any signal is
    left out. Rankings are by error, then bits, then reserve; ``best`` marks the smallest
    l1. Null signals have no part; a null sample is an error.
    """
    ship(signals.sparkSession)
    settings = [(w, r) for w in widths for r in reserves]

    def run(batches):
        total = np.zeros((len(settings), 3))
        for b in batches:
            size = pc.list_value_length(b.column(0)).to_numpy().astype(np.int64)
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
            if np.isnan(flat).any():
                raise ValueError("a signal has a sample that is no number")
            starts, order, lo = np.cumsum(size) - size, np.argsort(size, kind="stable"), 0
            while lo < len(order):
                n = np.maximum(size[order[lo:]], 1) * np.arange(1, len(order) - lo + 1) * max(len(settings), 1)
                rows = order[lo : lo + max(1, int(np.searchsorted(n, CELLS, "right")))]
                x = np.zeros((len(rows), int(size[rows].max())))
                inside = np.arange(x.shape[1])[None, :] < size[rows, None]
                x[inside] = flat[(starts[rows, None] + np.arange(x.shape[1])[None, :])[inside]]
                for sos in bank:
                    total += errors_of_settings(x, size[rows], sos, settings).sum(1)
                lo += len(rows)
        yield pa.record_batch([pa.array([w for w, _ in settings], pa.int32()), pa.array([r for _, r in settings], pa.int32()), *(pa.array(total[:, c]) for c in range(3))], names=["bits", "reserve", "e1", "e2", "el"])

    errors = signals.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "bits int, reserve int, e1 double, e2 double, el double")
    total = errors.groupBy("bits", "reserve").agg(F.sum("e1").alias("l1"), F.sum("e2").alias("l2"), F.sum("el").alias("log")).where("not isnan(l1)")
    rank = lambda *c: F.row_number().over(Window.orderBy(*c))
    return total.select("*", *(rank(c, "bits", "reserve").alias(f"rank_{c}") for c in ("l1", "l2", "log"))).withColumn("best", F.col("rank_l1") == 1)  # a row a setting: few
