"""Queries on whole models: integer stages, quantised and floating classifiers, spatial patterns, search and cross-validation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sigflow.functions import quant as Q
from sigflow.operators import classify, filters, fixedpoint, kernel, linear, modes, network, search, spd
from sigflow.operators import matrices as M
from sigflow.operators.blocks import pack
from sigflow.plans import signal as S
from sigflow.plans.dialect import FIXED, SIGNAL, qtrials, quant, trials
from sigflow.session import checkpoint, ship, table
from sigflow.sources.tables import embeddings, signals

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- integer cascades in other forms ------------------------------------------------------------------------------

FIXED_Q = {**S.FIXED_SOS, "y_shift": -1, "y_scale": 4.0}
_B, _AC, _SB, _SA = (S.FIXED_SOS[k] for k in ("b", "a", "b_shift", "a_shift"))
_LIMIT = 1 << 15


def _sum(c, *v) -> str:
    return "(" + " + ".join(f"({k}) * {x}" for k, x in zip(c, v)) + ")"


def _back(m: int, o1: str, o2: str) -> str:
    return f"({_sum(_AC[m][1:], o1, o2)} >> {_SA[m]})"


def _floor_section(m: int, i: str, i1: str, i2: str, o1: str, o2: str) -> str:
    return f"least(({_sum(_B[m], i, i1, i2)} >> {_SB[m]}) - {_back(m, o1, o2)}, {_LIMIT})"


@query(S._iir_sql(S._QS, "0::bigint", _floor_section(0, "s.x", "f.xa", "f.xb", "f.ua", "f.ub"), _floor_section(1, "u", "ua", "ub", "va", "vb"), "va"))
def sos_int_floor(spark, d):
    """Direct form 1 whose sums are shifted down apart, limited upwards only."""
    return S._samples(filters.apply_filter(S._qsignals(spark, d), "x", "sos_int_floor", S.FIXED_SOS))


_FORM2 = f"least(({_sum(_B[0], 'u', 'ua', 'ub')} >> {_SB[0]}) - {_back(1, 'va', 'vb')}, {_LIMIT})"
_FORM2_OUT = f"({_sum(_B[1], 'va', 'vb', 'coalesce(lag(vb) over (partition by user_id order by k), 0)')} >> {_SB[1]})::bigint"


@query(S._iir_sql(S._QS, "0::bigint", f"least(s.x - {_back(0, 'f.ua', 'f.ub')}, {_LIMIT})", _FORM2, _FORM2_OUT))
def sos_int_form2(spark, d):
    """Direct form 2 on integers."""
    return S._samples(filters.apply_filter(S._qsignals(spark, d), "x", "sos_int_form2", S.FIXED_SOS))


@query(S._iir_sql(S._QS, "0::bigint", S._section(0, 2, "s.x", "f.xa", "f.xb", "f.ua", "f.ub"), S._section(1, 3, "u", "ua", "ub", "va", "vb"), "((((va >> 1) + 128) % 256 + 256) % 256 - 128)::bigint"))
def device_filter_store(spark, d):
    """The device's cascade with its last shift and store: eight bits, no clip."""
    y = S._samples(filters.apply_filter(S._qsignals(spark, d), "x", "sos_int_device", S.FIXED_SOS))
    return y.withColumn("y", Q.wrap(filters.output_shift(F.col("y"), -1), 8).cast("bigint"))


_EVEN = "round_even(greatest(least((value - 280.0::double) / 64 * 128, 127), -128), 0)"


@query(f"select event_id, round({_EVEN} / 128 * 64, 6) + 0.0::double v from events")
def fake_quantize_even(spark, d):
    return table(spark, d, "events").select("event_id", (F.round(Q.fake_half_even(F.col("value") - 280.0, 64.0, 8), 6) + 0.0).alias("v"))


@query(f"select vec_id, c row, t, case when t < 7 then x else 0 end::bigint v from ({qtrials(8)})")
def device_input(spark, d):
    """Eight-bit channels of seven samples, zeros behind them up to a multiple of four."""
    e = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda v: Q.round_away(v.cast("double"), 1.0, 8)).alias("x"))
    rows = e.selectExpr("vec_id", "posexplode(transform(sequence(0, 7), c -> slice(x, c * 8 + 1, 7))) as (row, v)")
    return rows.select("vec_id", "row", F.posexplode(F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.pmod(-F.size("v"), F.lit(4))))).alias("t", "v"))


_TRUNC = "trunc(greatest(least((value - 280.0::double) / 512 * 128, 127), -128))::bigint"
_PADDED = f"with q as (select user_id, k::bigint k, {_TRUNC} x from ({SIGNAL})) select user_id, k, x from q union all select user_id, n + i, 0 from (select user_id, count(*) n from q group by 1), range(4) r(i)"
_CASCADE = S._iir_sql(_PADDED, "0::bigint", S._section(0, 2, "s.x", "f.xa", "f.xb", "f.ua", "f.ub"), S._section(1, 2, "u", "ua", "ub", "va", "vb"), "(va >> 1) / 128.0::double * 4")


@query(f"with y as materialized ({_CASCADE}), n as (select user_id, max(k) + 1 n from y group by 1), m as (select * from (values ('sosfilt', 0, 4), ('same', 2, 2), ('valid', 4, 4), ('full', 0, 0)) v(mode, front, back)) select mode, user_id, (k - front)::bigint k, round(y, 6) y from y join n using (user_id), m where k >= front and k < n - back")
def quantised_filter_modes(spark, d):
    """Eight bits in, integers, output shift, floating out, in the four modes."""
    x = signals(spark, d).select("user_id", F.transform("x", lambda v: v - 280.0).alias("x"))
    out = None
    for mode in filters.MODES:
        y = S._samples(filters.quantised_filter(x, "x", FIXED_Q, 512.0, mode)).select(F.lit(mode).alias("mode"), "user_id", "k", F.round("y", 6).alias("y"))
        out = y if out is None else out.unionByName(y)
    return out


@query()
def band_pass_order4(spark, d):
    """Signals through the order-4 band-pass of 8 to 12 Hz."""
    x = signals(spark, d).select("user_id", F.transform("x", lambda v: v - 280.0).alias("x"))
    return S._samples(filters.apply_filter(x, "x", "sos_float", filters.band_pass_hz(8.0, 12.0, filters.FS, 4))).withColumn("y", F.round("y", 6) + 0.0)


@query(f"select event_id, value, ((value::float)::bit)::bigint & 4294967295 bits from events")
def float_bits(spark, d):
    """The 32 bits of each value as a single-precision number, and that number again from its bits."""
    ship(spark)

    def run(batches):
        for b in batches:
            bits = b.column(1).to_numpy(zero_copy_only=False).astype(np.float32).view(np.uint32)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(bits.astype(np.int64))], names=["event_id", "value", "bits"])

    return table(spark, d, "events").where("value is not null").select(F.col("event_id").cast("long"), "value").mapInArrow(run, "event_id long, value double, bits long")


_OPS = {
    "plus": "a + b", "minus": "a - b", "times": "a * b", "quotient": "a / (abs(b) + 1)", "fmadd": "a * b + c", "fmsub": "a * b - c", "fnmadd": "-(a * b) - c", "fnmsub": "-(a * b) + c",
    "root": "sqrt(abs(a))", "square": "a * a", "magnitude": "abs(a)", "low": "least(a, b)", "high": "greatest(a, b)",
    "sgnj": "abs(a) * case when b < 0 then -1 else 1 end", "sgnjn": "abs(a) * case when b < 0 then 1 else -1 end", "sgnjx": "a * case when b < 0 then -1 else 1 end",
}
_ABC = "cast(event_id % 17 - 8 as double) a, cast(event_id % 13 - 6 as double) b, cast(event_id % 7 - 3 as double) c"


@query(f"select event_id, {', '.join(f'round({e}, 6) + 0.0::double {n}' for n, e in _OPS.items())} from (select event_id, {_ABC} from events)")
def float_operations(spark, d):
    v = table(spark, d, "events").selectExpr("event_id", *(x.replace("double) ", "double) as ") for x in _ABC.split(", ")))
    return v.select("event_id", *((F.round(F.expr(e), 6) + 0.0).alias(n) for n, e in _OPS.items()))


# ---- integer stages at eight channels ----------------------------------------------------------------------------

_GF = S._iir_sql(f"select vec_id * 8 + c user_id, t::bigint k, x from ({qtrials(8)})", "0::bigint", S._section(0, 2, "s.x", "f.xa", "f.xb", "f.ua", "f.ub"), S._section(1, 2, "u", "ua", "ub", "va", "vb"), "(va >> 1)")
_GY = f"with y as materialized ({_GF}), s as (select a.user_id // 8 vec_id, (a.user_id % 8)::int i, (b.user_id % 8)::int j, (sum(a.y * b.y) + case when a.user_id = b.user_id then 50 else 0 end + 4)::bigint >> 3 v from y a join y b on a.user_id // 8 = b.user_id // 8 and a.k = b.k group by a.user_id, b.user_id)"
_R = "r as (select i::int i, j::int j, " + FIXED.format(i="least(i, j)", j="greatest(i, j)") + "::bigint v from range(8) a(i), range(8) b(j))"
REF = np.array([[(7 * min(i, j) + 3 * max(i, j)) % 11 - 5 for j in range(8)] for i in range(8)])
_POS = "case when i = j then i else 8 + j * (j - 1) // 2 + i end"


def _golden(spark, d):
    x = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda v: Q.round_away(v.cast("double"), 1.0, 8)).alias("x"))
    return fixedpoint.apply_stage(x, "x", 8, lambda v: fixedpoint.filtered(v, FIXED_Q), "y")


def _golden_cov(spark, d):
    return fixedpoint.apply_stage(_golden(spark, d), "y", 8, lambda v: fixedpoint.covariance(v, 50, 3), "m")


@query(f"select (user_id // 8)::bigint vec_id, (user_id % 8)::int i, k::int j, y v from ({_GF})")
def golden_filter_c8(spark, d):
    return M.cells(_golden(spark, d), "vec_id", "y", 8)


@query(_GY + " select vec_id, i, j, v from s")
def golden_cov_c8(spark, d):
    return M.cells(_golden_cov(spark, d), "vec_id", "m", 8)


@query(_GY + f", {_R}, p as (select vec_id, r.i, s.j, sum(r.v * s.v) v from r join s on r.j = s.i group by all) select vec_id, p.i, r.j, sum(p.v * r.v)::bigint v from p join r on p.j = r.i group by all")
def golden_whiten_c8(spark, d):
    white = fixedpoint.apply_stage(_golden_cov(spark, d), "m", 8, lambda v: fixedpoint.whitened(v, REF), "w")
    return M.cells(white, "vec_id", "w", 8)


def _golden_half(spark, d):
    return fixedpoint.apply_stage(_golden_cov(spark, d), "m", 8, lambda v: fixedpoint.half_vector(v, 1, 7), "h")


_GH = f", h as (select vec_id, ({_POS})::int i, case when i = j then (v + 1) >> 1 else (v * 91 + 64) >> 7 end v from s where i <= j)"


@query(_GY + _GH + " select vec_id, i, v from h")
def golden_half_c8(spark, d):
    return M.entries(_golden_half(spark, d), "vec_id", "h")


@query(_GY + _GH + " select vec_id, cls::int cls, (sum(v * ((7 * cls + 3 * i) % 11 - 5)) + 10 * cls)::bigint score from h, range(4) c(cls) group by vec_id, cls")
def golden_scores_c8(spark, d):
    return classify.integer_scores(_golden_half(spark, d), "vec_id", "h", "(7 * {c} + 3 * k) % 11 - 5", 4, "cast(c * 10 as bigint)")


@query(_GY + _GH + ", t as (select vec_id, cls, sum(v * ((7 * cls + 3 * i) % 11 - 5)) + 10 * cls score from h, range(4) c(cls) group by vec_id, cls) select vec_id, cls::int cls, round(score / 2147483648.0::double * (0.5 * 4 * 2147483648.0 / 16384), 9) score from t")
def golden_output_c8(spark, d):
    """The scores as real numbers, weights of scale 0.5 on features of scale 4."""
    model = fixedpoint.FixedModel(8, [None], feature_scale=4.0, weight_scale=0.5)
    scored = classify.score_arrays(_golden_half(spark, d), "h", "(7 * {c} + 3 * k) % 11 - 5", 4, "cast(c * 10 as bigint)")
    return model.real_scores(scored).select("vec_id", F.posexplode("real").alias("cls", "v")).select("vec_id", "cls", F.round("v", 9).alias("score"))


# R1 to 16 bits of real covariances of eight-bit signals at scale 8.
_TRAINER_COV = "trunc(greatest(least(v * (1 / 128.0::double) * (1 / 128.0::double) / 8 * 32768 + sign(v) * 0.5, 32767), -32768))::bigint"


@query(f"with x as (select vec_id, c, t, x from ({qtrials(8)})), s as (select a.vec_id, a.c i, b.c j, sum(a.x * b.x) + case when a.c = b.c then 16384 * 0.5 else 0 end v from x a join x b on a.vec_id = b.vec_id and a.t = b.t group by a.vec_id, a.c, b.c) select vec_id, i, j, {_TRAINER_COV} v from s")
def trainer_cov_c8(spark, d):
    """Covariances by the trainer's rules: real values quantised anew to 16 bits; the filter passes everything."""
    x = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    through = {"a": np.array([[1, 0, 0]]), "b": np.array([[1, 0, 0]]), "a_shift": np.array([0]), "b_shift": np.array([0]), "y_shift": 0, "y_scale": 1.0}
    model = fixedpoint.FixedModel(8, [None], 0.5, filters=[through], cov_scale=[8.0], ref_scale=[1.0], refs=[np.eye(8, dtype=np.int64)], rules="trainer")
    return M.cells(model.transform(x, "vec_id", trace=True).select("vec_id", F.col("stages")["cov_0"].alias("m")), "vec_id", "m", 8)


@query(f"with x as (select vec_id, c, t, x from ({qtrials(8)})) select a.vec_id, a.c i, b.c j, ((sum(a.x * b.x) + case when a.c = b.c then 429497 else 0 end)::bigint) v from x a join x b on a.vec_id = b.vec_id and a.t = b.t group by a.vec_id, a.c, b.c")
def covmat_quantised(spark, d):
    """Sum of products plus rho quantised to 32 bits at its own scale (0.0002 of full range)."""
    x = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda v: Q.round_away(v.cast("double"), 1.0, 8)).alias("x"))
    rho = int(fixedpoint.away(0.0002, 1.0, 32))
    return M.cells(fixedpoint.apply_stage(x, "x", 8, lambda v: fixedpoint.covariance(v, rho, 0), "m"), "vec_id", "m", 8)


@query(f"with x as (select vec_id, c, t, x from ({qtrials(8)})), s as (select a.vec_id, a.c i, b.c j, sum(a.x * b.x) * 65537 v from x a join x b on a.vec_id = b.vec_id and a.t = b.t group by all), p as (select a.vec_id, a.i, b.j, sum(a.v * b.v)::hugeint v from s a join s b on a.vec_id = b.vec_id and a.j = b.i group by all) select vec_id, i, j, ((((v + 2147483648) % 4294967296 + 4294967296) % 4294967296) - 2147483648)::bigint v from p")
def matmul_i32(spark, d):
    """Square of a matrix in 32-bit accumulators that wrap around."""
    x = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda v: Q.round_away(v.cast("double"), 1.0, 8)).alias("x"))

    def square(v):
        m = (v @ np.swapaxes(v, 1, 2) * 65537).astype(np.int32)
        return (m @ m).astype(np.int64)

    return M.cells(fixedpoint.apply_stage(x, "x", 8, square, "m"), "vec_id", "m", 8)


@query(f"with x as (select vec_id, c, t, x from ({qtrials(8)})) select a.vec_id, a.c i, b.c j, sum(a.x * b.x)::bigint v from x a join x b on a.vec_id = b.vec_id and a.t = b.t and a.c >= b.c group by all")
def cov_triangle(spark, d):
    """Products of channel pairs i >= j only: an equi-join on trial and sample with the triangle as its residual."""
    x = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda v: Q.round_away(v.cast("double"), 1.0, 8)).alias("x"))
    s = x.select("vec_id", F.posexplode("x").alias("p", "x")).selectExpr("vec_id", "cast(p div 8 as int) as c", "p % 8 as t", "x")
    b = s.select("vec_id", "t", F.col("c").alias("j"), F.col("x").alias("y"))
    return s.join(b, ["vec_id", "t"]).where("c >= j").groupBy("vec_id", F.col("c").alias("i"), "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


@query(f"with x as (select vec_id, c % 2 band, c, t, x from ({trials(8)})), e as (select vec_id, band, sum(x * x) e from x group by all), r as (select band, avg(e) m from e group by 1) select vec_id, band::int band, round(e / m, 6) v from e join r using (band)")
def band_reference_join(spark, d):
    """Each trial's energy in a band over the band's mean: an equi-join by band with a table of one row a band."""
    x = embeddings(spark, d).select("vec_id", F.posexplode("embedding").alias("p", "x")).selectExpr("vec_id", "cast((p div 8) % 2 as int) as band", "cast(x as double) as x")
    e = x.groupBy("vec_id", "band").agg(F.sum(F.col("x") * F.col("x")).alias("e"))
    ref = e.groupBy("band").agg(F.avg("e").alias("m"))
    return e.join(F.broadcast(ref), "band").select("vec_id", "band", F.round(F.col("e") / F.col("m"), 6).alias("v"))


_STORES = {"full": "true", "upper": "x.k <= y.k", "lower": "x.k >= y.k"}


@query("with k as (select vec_id, (row_number() over (partition by vec_id order by t) - 1)::int k, x u from (" + qtrials(8) + ") where c = 0) " + " union all ".join(f"select '{n}' store, x.vec_id, x.k i, y.k j, (case when {c} then x.u * y.u else 0 end)::bigint v from k x join k y on x.vec_id = y.vec_id" for n, c in _STORES.items()))
def vec_cov_stores(spark, d):
    """v v' of each trial's first channel, stored whole, as upper and as lower triangle."""
    u = embeddings(spark, d).select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda v: Q.round_away(v.cast("double"), 1.0, 8)).alias("u"))
    out = None
    for n in _STORES:
        cells = M.cells(u.selectExpr("vec_id", f"{M.vec_cov('u', 8, n)} as m"), "vec_id", "m", 8).withColumn("store", F.lit(n))
        out = cells if out is None else out.unionByName(cells)
    return out.withColumn("v", F.col("v").cast("bigint"))


# ---- models --------------------------------------------------------------------------------------------------------

#: Two short bands for trials of eight samples.
BANK = [np.array([[0.25, 0.0, -0.25, 1.0, -1.2, 0.5]]), np.array([[0.3, 0.6, 0.3, 1.0, -0.4, 0.2]])]


def _trials(spark, d):
    return embeddings(spark, d).where("embedding is not null").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _labelled(features, trials_):
    return features.join(trials_.select("vec_id", F.col("label").cast("double").alias("label")), "vec_id")


def _svm(train, c: float):
    """(weights, bias) by class of a one-vs-rest linear SVM on array features."""
    w = linear.LinearSvm((c,)).solve(pack(train, "vec_id", "f", "label")).weights[0][0]
    return w[:, :-1], w[:, -1]


_LEARNED: dict[str, tuple] = {}


def _once(spark, d, learn):
    """What ``learn`` gives for a table, learned once an application and anew if the table's files are others; one model a kind is kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{d}/embeddings.parquet").select("path", "modificationTime", "length").collect()
    key = (spark.sparkContext.applicationId, sorted(map(tuple, files)))
    if _LEARNED.get(learn.__name__, (None,))[0] != key:
        _LEARNED[learn.__name__] = (key, learn(spark, d))
    return _LEARNED[learn.__name__][1]


def quantised_model(spark, d):
    """The integer model learned from four fifths of the trials."""
    return _once(spark, d, _learn)


def _learn(spark, d):
    t = _trials(spark, d)
    train = t.where("vec_id % 5 <> 0")
    model = fixedpoint.FixedModel(8, BANK).fit(train)
    real = model.real_features(model.transform(train, "vec_id"))
    return model.with_classifier(*_svm(_labelled(real, train), 0.1))


@query()
def quantised_predict(spark, d):
    """Integer scores and class of every held-out trial."""
    test = _trials(spark, d).where("vec_id % 5 = 0")
    model = quantised_model(spark, d)
    return model.scores(model.transform(test, "vec_id")).select("vec_id", "f", "scores", "prediction")


@query()
def quantised_score(spark, d):
    test = _trials(spark, d).where("vec_id % 5 = 0")
    model = quantised_model(spark, d)
    return classify.accuracy(_labelled(model.scores(model.transform(test, "vec_id")), test))


@query()
def quantised_trace(spark, d):
    """Every integer stage of the held-out trials, with scores and class."""
    test = _trials(spark, d).where("vec_id % 5 = 0")
    model = quantised_model(spark, d)
    return model.scores(model.transform(test, "vec_id", trace=True))


@query()
def quantised_parameters(spark, d):
    return quantised_model(spark, d).parameters(spark)


def _learn_float(spark, d):
    train = _trials(spark, d).where("vec_id % 5 <> 0")
    model = spd.RiemannFeatures(8, [(0, 8)], BANK, 1.0, "Riemann").fit(train)
    return model, *_svm(_labelled(model.transform(train, "vec_id"), train), 0.1)


@query()
def float_predict(spark, d):
    """Features of the floating model, linear SVM, class of every held-out trial."""
    t = _trials(spark, d)
    model, w, b = _once(spark, d, _learn_float)
    f = _labelled(model.transform(t.where("vec_id % 5 = 0"), "vec_id"), t)
    rows = ", ".join("array(" + ", ".join(f"{v!r}D" for v in c) + ")" for c in w.tolist())
    scored = f.withColumn("scores", F.expr(f"transform(array({rows}), (w, c) -> aggregate(zip_with(f, w, (x, y) -> x * y), array({', '.join(f'{v!r}D' for v in b.tolist())})[c], (s, v) -> s + v))"))
    return scored.select("vec_id", "label", classify.argmax("scores").alias("prediction"))


@query()
def float_score(spark, d):
    return classify.accuracy(float_predict(spark, d))


KERNELS = {"rbf": (0.5, 2), "poly": (1.0, 10), "sigmoid": (0.5, 2)}


@query()
def kernel_svms(spark, d):
    """Held-out classes by machines with the three kernels, C = 1, gamma one over the width."""
    t = _trials(spark, d)
    test = t.where("vec_id % 5 = 0")
    out = None
    for name in KERNELS:
        got = kernel.KernelSvm(name).fit(t.where("vec_id % 5 <> 0"), "vec_id", "label", "x").predict(test, "vec_id", "x")
        got = got.join(test.select("vec_id", "label"), "vec_id").select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"), F.lit(name).alias("kernel"))
        out = got if out is None else out.unionByName(got)
    return out


@query("with c as (select distinct label from embeddings), n as (select label, count(*) n from embeddings group by 1) select c::double c, a.label c1, b.label c2, x.n + y.n n, true balanced, true optimal from c a join c b on a.label < b.label join n x on x.label = a.label join n y on y.label = b.label, (values (0.1), (1.0), (10.0)) v(c)")
def kernel_svm_optimality(spark, d):
    """Machines of all classes and three C's meet the conditions of the optimum, by decision values computed anew."""
    t = _trials(spark, d)
    model = kernel.KernelSvm("rbf", (0.1, 1.0, 10.0), 0.5).fit(t, "vec_id", "label", "x")
    of = spark.createDataFrame([(s, k, float(c), model.classes[a], model.classes[b]) for s, (_, c) in enumerate(model.settings) for k, (a, b) in enumerate(model.pairs)], "setting int, pair int, c double, c1 int, c2 int")
    return model.optimality(t, "vec_id", "label", "x").join(F.broadcast(of), ["setting", "pair"]).select("c", "c1", "c2", "n", (F.abs("balance") < 1e-6).alias("balanced"), (F.col("violation") < 2e-3).alias("optimal"))


_PAIR = {
    "rbf": "exp(-0.5 * list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "poly": "pow(1.0 * list_dot_product(a.x, b.x), 10)",
    "sigmoid": "tanh(0.5 * list_dot_product(a.x, b.x))",
}
_COEF = "(({k} % 11) - 5) / 10.0"


@query(
    f"with v as (select vec_id, list(x order by p) x from (select vec_id, unnest(embedding)::double x, unnest(range(64)) p from embeddings) group by 1), s as (select vec_id, x, {_COEF.format(k='vec_id')} w from v where vec_id % 50 = 0) "
    + " union all ".join(f"select a.vec_id, '{k}' kernel, round(sum(b.w * {f}), 6) + 0.0 score from v a, s b group by 1" for k, f in _PAIR.items())
)
def kernel_scores(spark, d):
    """Decision values of all trials under fixed support vectors, the three kernels."""
    t = _trials(spark, d)
    packed = pack(t, "vec_id", "x").frame
    chosen = pack(t.where("vec_id % 50 = 0"), "vec_id", "x").frame
    support = kernel.with_coefficients(chosen, lambda ids: ((ids % 11) - 5)[:, None] / 10)
    out = None
    for name, (gamma, degree) in KERNELS.items():
        got = kernel.kernel_scores(packed, support, name, gamma, 1, "vec_id", degree).select("vec_id", F.lit(name).alias("kernel"), (F.round(F.col("f")[0], 6) + 0.0).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def _fixed_layers(sizes: list[int]) -> list[np.ndarray]:
    """Small weights and biases that SQL can make too."""
    out = []
    for a, b in zip(sizes, sizes[1:]):
        i, j = np.arange(a)[:, None], np.arange(b)[None, :]
        out += [((7 * i + 3 * j) % 11 - 5) / 10.0, ((5 * np.arange(b)) % 7 - 3) / 10.0]
    return out


def _layer_sql(name: str, before: str, size: int, act: str) -> str:
    z = f"sum(v * (((7 * i + 3 * j) % 11 - 5) / 10.0)) + ((5 * j) % 7 - 3) / 10.0"
    return f"{name} as (select vec_id, j i, {act.format(z=z)} v from {before}, (select unnest(range({size})) j) group by vec_id, j)"


_RELU, _LOGISTIC, _NONE = "greatest({z}, 0)", "1 / (1 + exp(-({z})))", "{z}"
_IN = "e as materialized (select vec_id, unnest(embedding)::double v, unnest(range(64)) i from embeddings)"


@query(
    f"with {_IN}, {_layer_sql('r1', 'e', 8, _RELU)}, {_layer_sql('r2', 'r1', 4, _RELU)}, {_layer_sql('r3', 'r2', 10, _NONE)}, {_layer_sql('l1', 'e', 6, _LOGISTIC)}, {_layer_sql('l2', 'l1', 10, _NONE)} "
    "select 'relu' net, vec_id, i::int cls, round(v, 6) + 0.0 score from r3 union all select 'logistic', vec_id, i::int, round(v, 6) + 0.0 from l2"
)
def network_scores(spark, d):
    """Scores of two networks with fixed weights: two hidden layers of rectifiers, and one of sigmoids."""
    t = _trials(spark, d)
    out = None
    for name, sizes in (("relu", [64, 8, 4, 10]), ("logistic", [64, 6, 10])):
        got = network.scores(t, "vec_id", "x", _fixed_layers(sizes), name).select(F.lit(name).alias("net"), "vec_id", F.posexplode("scores").alias("cls", "v")).select("net", "vec_id", "cls", (F.round("v", 6) + 0.0).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


NETS = [network.Net((16,), rate=0.02), network.Net((16, 8), "logistic", rate=0.05), network.Net((16, 8, 8), "relu", "sgd", 0.2, True)]


@query()
def networks(spark, d):
    """Held-out classes by networks of one to three hidden layers, with both activations and both solvers."""
    t = _trials(spark, d).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    packed = pack(t, "vec_id", "x", "label", fold="fold")
    found = network.train(packed, NETS, (0,), epochs=15, batches=2).predict(packed.frame)
    return found.where("fold = 0").select("setting", F.col("id").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


WINDOWS = [(0, 8), (0, 5), (3, 8)]


def _learn_csp(spark, d):
    train = _trials(spark, d).where("vec_id % 5 <> 0")
    w = spd.csp_projections(train, "label", "x", 8, WINDOWS, BANK)
    return w, *_svm(spd.csp_features(train, "x", 8, w, WINDOWS, BANK).select("vec_id", F.col("label").cast("double").alias("label"), "f"), 0.1)


@query()
def csp_predict(spark, d):
    """Spatial patterns over windows and bands learned from four fifths of the trials, log variances, linear SVM."""
    t = _trials(spark, d)
    w, weights, bias = _once(spark, d, _learn_csp)
    f = spd.csp_features(t.where("vec_id % 5 = 0"), "x", 8, w, WINDOWS, BANK)
    shared = spark.sparkContext.broadcast((weights, bias))

    def run(batches):
        for b in batches:
            x = spd.stacked(b.column(2), 1)[:, 0] if b.num_rows else np.zeros((0, 1))
            best = (x @ shared.value[0].T + shared.value[1]).argmax(1) if len(x) else np.zeros(0, int)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(best.astype(np.int32))], names=["vec_id", "label", "prediction"])

    return f.select(F.col("vec_id").cast("long"), F.col("label").cast("double"), "f").mapInArrow(run, "vec_id long, label double, prediction int")


@query(
    f"with x as (select vec_id, c, t, x from ({trials(8)})), w as (select k, c, ((7 * c + 3 * k) % 11 - 5)::double v from range(3) a(k), range(8) b(c)), y as (select vec_id, k, t, sum(x * v) y from x join w using (c) group by all), "
    "win as (select * from (values (0, 0, 8), (1, 0, 5), (2, 3, 8)) v(win, lo, hi)), f as (select vec_id, 3 * win + k i, log10(var_pop(y)) v from y, win where t >= lo and t < hi group by vec_id, win, k) select vec_id, i::int i, round(v, 6) v from f"
)
def csp_fixed_features(spark, d):
    """Log variances of three given projections over the windows."""
    i, k = np.arange(8)[:, None], np.arange(3)[None, :]
    w = ((7 * i + 3 * k) % 11 - 5).astype(float)
    f = spd.csp_features(_trials(spark, d), "x", 8, {(n, 0): w for n in range(3)}, WINDOWS, [None])
    return M.entries(f, "vec_id", "f").select("vec_id", "i", F.round("v", 6).alias("v"))


@query()
def csp_score(spark, d):
    return classify.accuracy(csp_predict(spark, d))


@query(f"select vec_id, k::int i, round(log10(var_pop(x)), 5) v from (select vec_id, c k, x from ({trials(8)})) group by all")
def csp_identity(spark, d):
    """Log variances without projection."""
    f = spd.csp_features(_trials(spark, d), "x", 8, spd.identity_projections(8, 1, 1), [(0, 8)], [None])
    return M.entries(f, "vec_id", "f").select("vec_id", "i", F.round("v", 5).alias("v"))


def _subjects(spark, d):
    """Features of nine subjects in five contiguous folds each."""
    t = _trials(spark, d).withColumn("subject", (F.col("vec_id") % 9).cast("int"))
    return classify.contiguous_folds(t.select("vec_id", "subject", "label", F.col("x").alias("f")), 5, ["subject"], "vec_id")


@query()
def cross_validated_score(spark, d):
    """Mean accuracy over the five folds of each subject."""
    runs = spark.createDataFrame([(0, 0.1)], "run int, c double")
    r = modes.subject_runs(_subjects(spark, d), runs, key="vec_id")
    return r.groupBy("subject").agg(F.count(F.lit(1)).alias("folds"), F.avg(F.col("right") / F.col("n")).alias("accuracy"))


@query()
def search_runs(spark, d):
    """Eight runs over a grid of five settings and nine subjects: the surplus runs are skipped and score 0."""
    runs = search.chosen_runs(search.grid(spark, c=[0.001, 0.01, 0.1, 1.0, 10.0]), 8).withColumn("c", F.coalesce("c", F.lit(0.0)))
    results = modes.subject_runs(_subjects(spark, d), runs.where("not skipped"), key="vec_id")
    return search.search_report(results, runs.select("run", "c", "skipped"))


@query()
def search_modes(spark, d):
    """Two runs of every mode of classifier for nine subjects; the grids of one setting skip the second."""
    t = _trials(spark, d).withColumn("subject", F.col("vec_id") % 9).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    return modes.search(pack(t, "vec_id", "x", "label", "subject", "fold"), list(modes.MODES), 2, epochs=6)


@query("with c as (select distinct vec_id % 5 f from embeddings), k as (select distinct label from embeddings) select f::int fold, c::double c, label, true optimal from c, k, (values (0.01), (0.1), (1.0)) v(c)")
def linear_svm_certificates(spark, d):
    """Machines of every fold, C and class are within a hundredth of the minimum, as their cutting planes prove; values are computed anew."""
    t = _trials(spark, d).withColumn("fold", (F.col("vec_id") % 5).cast("int"))
    packed = pack(t, "vec_id", "x", "label", fold="fold")
    model = linear.LinearSvm((0.01, 0.1, 1.0)).solve(packed, (0, 1, 2, 3, 4))
    value = linear.objective(model, packed.frame)
    lower = spark.createDataFrame([(s, k, float(v)) for s, row in enumerate(model.lower[0]) for k, v in enumerate(row)], "setting int, cls int, lower double")
    of = spark.createDataFrame([(s, h, c) for s, (h, c) in enumerate(model.settings)], "setting int, fold int, c double")
    named = spark.createDataFrame(list(enumerate(model.classes)), "cls int, label int")
    return value.join(F.broadcast(lower), ["setting", "cls"]).join(F.broadcast(of), "setting").join(F.broadcast(named), "cls").select("fold", "c", "label", (F.col("value") - F.col("lower") <= 0.0101 * F.col("value")).alias("optimal"))


# ---- invariants of decompositions that SQL cannot make ------------------------------------------------------------

_C8 = f"with x as (select vec_id, c, t, x from ({trials(8)})), s as (select a.vec_id, a.c i, b.c j, sum(a.x * b.x) / 7 + case when a.c = b.c then 1.0::double / 8 else 0 end v from x a join x b on a.vec_id = b.vec_id and a.t = b.t group by a.vec_id, a.c, b.c) select vec_id, round(sum(v) filter (where i = j), 5) trace, round(sum(v * v), 5) squares from s group by 1"


def _cov(spark, d):
    return spd.covariance(S._trials8(spark, d), "x", 8)


@query(_C8)
def eigh_invariants_c8(spark, d):
    """Sum and sum of squares of the eigenvalues: trace and squared norm of the matrix."""
    w = M.entries(spd.map_matrices(_cov(spark, d), "cov", 8, lambda m: spd.eigen(m)[0]), "vec_id", "m")
    return w.groupBy("vec_id").agg(F.round(F.sum("v"), 5).alias("trace"), F.round(F.sum(F.col("v") * F.col("v")), 5).alias("squares"))


@query(_C8)
def tridiag_invariants_c8(spark, d):
    """Trace and squared norm of the tridiagonal form."""
    f = lambda x: spd.tridiagonal(x)[0]
    t = M.cells(spd.map_matrices(_cov(spark, d), "cov", 8, f), "vec_id", "m", 8)
    return t.groupBy("vec_id").agg(F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), 5).alias("trace"), F.round(F.sum(F.col("v") * F.col("v")), 5).alias("squares"))


@query(_C8)
def qr_invariants_c8(spark, d):
    """Shifted rotations on the tridiagonal form: the matrix rebuilt from eigenvalues and vectors."""

    def rebuilt(x):
        w, q = spd.eigen(x)
        return q * w[:, None, :] @ np.swapaxes(q, 1, 2)

    t = M.cells(spd.map_matrices(_cov(spark, d), "cov", 8, rebuilt), "vec_id", "m", 8)
    return t.groupBy("vec_id").agg(F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), 5).alias("trace"), F.round(F.sum(F.col("v") * F.col("v")), 5).alias("squares"))


@query(f"with x as (select vec_id, c, t, x from ({trials(8)})), s as (select a.vec_id, sum(a.x * b.x) + case when a.c = b.c then 1.0::double else 0 end v from x a join x b on a.vec_id = b.vec_id and a.t = b.t group by a.vec_id, a.c, b.c) select round((select max(abs(x)) from x), 6) input, round(max(abs(v)), 6) cov from s")
def range_monitor_c8(spark, d):
    """Ranges of input and covariance over all trials, as calibration takes them."""
    model = fixedpoint.FixedModel(8, [None])

    def ranges(x, _):
        m = x @ np.swapaxes(x, 1, 2) + np.eye(8)
        return (np.abs(x).max(), 0.0, np.abs(m).max()), m

    return model._pass(_trials(spark, d), "x", ranges).agg(F.round(F.max("r0"), 6).alias("input"), F.round(F.max("r2"), 6).alias("cov"))


@query(_C8)
def logm_round_trip_c8(spark, d):
    """The exponential of the logarithm: trace and squared norm of the matrix again."""
    t = M.cells(spd.map_matrices(_cov(spark, d), "cov", 8, lambda m: spd.expm(spd.logm(m))), "vec_id", "m", 8)
    return t.groupBy("vec_id").agg(F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("v"))), 5).alias("trace"), F.round(F.sum(F.col("v") * F.col("v")), 5).alias("squares"))
