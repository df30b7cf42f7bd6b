"""Queries on filters, covariances, features, classifiers and search reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigflow.functions import quant as Q
from sigflow.functions import sym2
from sigflow.operators import classify, filters, kernel, means, neighbours, scan, search, spd
from sigflow.operators import matrices as M
from sigflow.plans.dialect import SIGNAL, qtrials, quant, trials
from sigflow.plans.linear import base
from sigflow.session import checkpoint, table
from sigflow.sources.tables import embeddings, signals

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- filters -------------------------------------------------------------------------------------------------------

#: A fixed two-section integer filter; the sections' denominator shifts differ, so host and device variants do too.
FIXED_SOS = {"b": [[512, 0, -512], [900, 1800, 900]], "a": [[1024, -1500, 700], [2048, -1800, 1000]], "b_shift": [12, 13], "a_shift": [10, 11]}
FLOAT_SOS = np.array([[0.25312719, 0.0, -0.25312719, 1.0, -1.50317331, 0.70213717], [0.50317133, 1.00731917, 0.50317133, 1.0, -0.90713913, 0.40731711]])
TAPS = np.array([1, -3, 5, 8, 5, -3, 2])


def _qsignals(spark, d):
    return signals(spark, d).select("user_id", F.transform("x", lambda v: Q.round_away(v - 280.0, 512, 8)).alias("x"))


def _samples(df):
    return df.select("user_id", F.posexplode("y").alias("k", "y")).select("user_id", F.col("k").cast("bigint").alias("k"), "y")


_QS = f"select user_id, k, {quant('value - 280.0::double', 512)} x from ({SIGNAL})"


def _iir_sql(signal: str, zero: str, first: str, second: str, out: str) -> str:
    """Recursive filtering of every user's signal; ``first`` and ``second`` give a section's output from its input and registers."""
    return f"""
with recursive sig as materialized ({signal}),
f as (
  select distinct user_id, -1::bigint k, {zero} xa, {zero} xb, {zero} ua, {zero} ub, {zero} va, {zero} vb from sig
  union all
  select user_id, k, x, xa, u, ua, {second}, va from (
    select s.user_id, s.k, s.x, f.xa, f.xb, f.ua, f.ub, f.va, f.vb, {first} u from f join sig s on s.user_id = f.user_id and s.k = f.k + 1))
select user_id, k, {out} y from f where k >= 0"""


def _section(m: int, shift: int, i: str, i1: str, i2: str, o1: str, o2: str) -> str:
    (b0, b1, b2), (_, a1, a2), sa = FIXED_SOS["b"][m], FIXED_SOS["a"][m], FIXED_SOS["a_shift"][m]
    return f"(((({b0} * {i} + {b1} * {i1} + {b2} * {i2} + {1 << (shift - 1)}) >> {shift}) - ({a1}) * {o1} - ({a2}) * {o2} + {1 << (sa - 1)}) >> {sa})"


def _int_sql(shifts: tuple[int, int]) -> str:
    return _iir_sql(_QS, "0::bigint", _section(0, shifts[0], "s.x", "f.xa", "f.xb", "f.ua", "f.ub"), _section(1, shifts[1], "u", "ua", "ub", "va", "vb"), "va")


def _float_section(m: int, i: str, i1: str, i2: str, o1: str, o2: str) -> str:
    b0, b1, b2, _, a1, a2 = (f"({v!r}::double)" for v in FLOAT_SOS[m].tolist())
    return f"({b0} * {i} + {b1} * {i1} + {b2} * {i2} - {a1} * {o1} - {a2} * {o2})"


@query(_int_sql((2, 2)))
def sos_int_df1(spark, d):
    return _samples(filters.apply_filter(_qsignals(spark, d), "x", "sos_int", FIXED_SOS))


@query(_int_sql((2, 3)))
def sos_int_device(spark, d):
    return _samples(filters.apply_filter(_qsignals(spark, d), "x", "sos_int_device", FIXED_SOS))


@query(_iir_sql(f"select user_id, k, value - 280.0::double x from ({SIGNAL})", "0::double", _float_section(0, "s.x", "f.xa", "f.xb", "f.ua", "f.ub"), _float_section(1, "u", "ua", "ub", "va", "vb"), "round(va, 5) + 0.0"))
def sos_float(spark, d):
    s = signals(spark, d).select("user_id", F.transform("x", lambda v: v - 280.0).alias("x"))
    return _samples(filters.apply_filter(s, "x", "sos_float", FLOAT_SOS)).withColumn("y", F.round("y", 5) + 0.0)


@query(SQL["sos_float"])
def sos_float_blocks(spark, d):
    """The same filter over signals cut into rows of 64 samples, which no task sees as a whole."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", (F.col("value") - 280.0).alias("v"))
    y = scan.filter_blocks(scan.cut_signals(e, "user_id", ["ts", "event_id"], "v"), FLOAT_SOS, "user_id")
    return y.select("user_id", "block", F.posexplode("y").alias("at", "y")).select("user_id", (64 * F.col("block") + F.col("at")).alias("k"), (F.round("y", 5) + 0.0).alias("y"))


@query("select user_id, event_id, k from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) - 1 k from events)")
def sample_numbers(spark, d):
    """Every sample's place in its signal, numbered over the partitions."""
    return scan.numbered(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "k")


@query(f"select user_id, k, ({' + '.join(f'({c}) * coalesce(lead(x, {3 - j}) over w, 0)' if j <= 3 else f'({c}) * coalesce(lag(x, {j - 3}) over w, 0)' for j, c in enumerate(TAPS.tolist()))})::bigint y from ({_QS}) window w as (partition by user_id order by k)")
def fir_same(spark, d):
    return _samples(filters.apply_filter(_qsignals(spark, d), "x", "fir", TAPS))


def _bands(spark, d):
    """Bands of the widths that the table has as line numbers."""
    return filters.bands_of(table(spark, d, "lineitem").select(F.col("l_linenumber").cast("int").alias("width")).distinct(), "width")


_BANDS = "select width, (row_number() over (partition by width order by f) - 1)::int band, 2.0::double * f / 250 lo, 2.0::double * (f + width) / 250 hi from (select width, unnest(range(4, 41, case when width < 3 then width else 4 end)) f from (select distinct l_linenumber::int width from lineitem)) where f + width <= 40"


@query(f"select width, band, round(lo, 9) lo, round(hi, 9) hi from ({_BANDS})")
def load_bands(spark, d):
    return _bands(spark, d).select("width", "band", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))


@query(f"select width, count(*) bands, round(min(lo), 9) lo, round(max(lo), 9) hi from ({_BANDS}) group by width")
def band_counts(spark, d):
    return _bands(spark, d).groupBy("width").agg(F.count(F.lit(1)).alias("bands"), F.round(F.min("lo"), 9).alias("lo"), F.round(F.max("lo"), 9).alias("hi"))


#: Order-one band-pass in closed form: the bilinear transform of one pole pair.
_ORDER1 = "select width, band, w / (1 + w + c) b0, (2 * c - 2) / (1 + w + c) a1, (1 - w + c) / (1 + w + c) a2 from (select *, tan(pi() * hi / 2) - tan(pi() * lo / 2) w, tan(pi() * hi / 2) * tan(pi() * lo / 2) c from ({b}))"


@query(f"select width, band, round(b0, 8) b0, 0.0::double b1, round(-b0, 8) b2, 1.0::double a0, round(a1, 8) a1, round(a2, 8) a2 from ({_ORDER1.format(b=_BANDS)})")
def butter_design(spark, d):
    """Order-one band-pass of every band."""
    v = lambda k: (F.round(F.col("sos")[0][k], 8) + 0.0)
    return filters.design(_bands(spark, d), 1).select("width", "band", *(v(k).alias(c) for k, c in enumerate(("b0", "b1", "b2", "a0", "a1", "a2"))))


@query()
def quantized_bank(spark, d):
    """Order-two band-pass of every band, and its integer form."""
    return filters.design(_bands(spark, d), 2, True).select("width", "band", "a", "b", "a_shift", "b_shift", "y_shift")


@query()
def freq_sweep(spark, d):
    """Amplitudes of each band's filter at a frequency for every user, a row a pair: all in integers, floating, with quantised coefficients."""
    freqs = table(spark, d, "events").select("user_id").distinct().select((F.pmod(F.xxhash64("user_id"), F.lit(5000)) * np.pi / 15625.0 + 0.005).alias("f"))
    return filters.sweep(freqs, list(filters.filter_bank([4], order=2)))


@query()
def filter_bits_search(spark, d):
    """Coefficients of 8 to 14 bits on every user's signal: summed errors, three rankings, and the best by l1."""
    s = signals(spark, d).select(F.transform("x", lambda v: (v - 280.0) / 512.0).alias("x"))
    return filters.bits_search(s, "x", list(filters.filter_bank([16], order=2))[:2], [8, 10, 12, 14], [0])


# ---- covariances and means ----------------------------------------------------------------------------------------

_T8 = f"with x as (select vec_id, label, c, t, x from ({trials(8)})) "
_QC8 = f"with x as (select vec_id, label, c, t, x from ({qtrials(8)})), s as (select a.vec_id, any_value(a.label) label, a.c i, b.c j, sum(a.x * b.x)::bigint v from x a join x b on a.vec_id = b.vec_id and a.t = b.t group by all) "


def _cov8(spark, d):
    b = base(spark, d).selectExpr("vec_id", "label", f"{M.mul_t('a', 'a', 8, 8, 8)} as m")
    return b.selectExpr("vec_id", "label", "posexplode(m) as (p, v)").selectExpr("vec_id", "label", "cast(p div 8 as int) as i", "cast(p % 8 as int) as j", "v")


@query(_T8 + "select vec_id, i, j, round(v / 7 + case when i = j then 1.0::double / 8 else 0 end, 6) v from (select a.vec_id, a.c i, b.c j, sum(a.x * b.x) v from x a join x b on a.vec_id = b.vec_id and a.t = b.t group by all)")
def covmat_float(spark, d):
    e = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    return M.cells(spd.covariance(e, "x", 8), "vec_id", "cov", 8).withColumn("v", F.round("v", 6))


@query(_QC8 + "select label, i, j, sum(v)::bigint v from s group by all")
def class_cov_sum(spark, d):
    return _cov8(spark, d).groupBy("label", "i", "j").agg(F.sum("v").alias("v"))


@query(_QC8 + "select i, j, round(avg(v), 6) v from s group by all")
def mean_cov_euclid(spark, d):
    return _cov8(spark, d).groupBy("i", "j").agg(F.round(F.avg("v"), 6).alias("v"))


@query("select label, count(*) n from embeddings group by 1")
def class_counts(spark, d):
    return embeddings(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- two channels: everything in closed form ----------------------------------------------------------------------

RHO = 50.0


def _cov2(spark, d):
    """(vec_id, label, a, b, c): regularised second moments of two channels of 32 eight-bit samples; narrow."""
    e = embeddings(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: Q.round_away(x.cast("double"), 1.0, 8)).alias("q"))
    p, q = "slice(q, 1, 32)", "slice(q, 33, 32)"
    return e.selectExpr("vec_id", "label", f"{M.inner(p, p)} + {RHO}D as a", f"cast({M.inner(p, q)} as double) as b", f"{M.inner(q, q)} + {RHO}D as c")


_COV2 = f"cov as (select vec_id, any_value(label) label, sum(x0 * x0)::double + {RHO} a, sum(x0 * x1)::double b, sum(x1 * x1)::double + {RHO} c from (select vec_id, any_value(label) label, t, max(x) filter (where c = 0) x0, max(x) filter (where c = 1) x1 from ({qtrials(2)}) group by vec_id, t) group by vec_id)"


def _fn_sql(src: str, f: str, df: str, out: str, keep: str = "vec_id") -> str:
    """CTEs that add f of the matrix (a, b, c) of ``src`` as (fa, fb, fc)."""
    hi, lo = (f.replace("$", v) for v in ("hi", "lo"))
    return f"{out}_e as (select *, (a + c + sqrt((a - c) * (a - c) + 4 * b * b)) / 2 hi, (a + c - sqrt((a - c) * (a - c) + 4 * b * b)) / 2 lo from {src}), {out}_b as (select *, case when hi - lo > 1e-12 then ({hi} - {lo}) / (hi - lo) else {df.replace('$', 'hi')} end beta from {out}_e), {out} as (select *, {hi} - beta * hi + beta * a fa, beta * b fb, {hi} - beta * hi + beta * c fc from {out}_b)"


_LOG, _DLOG, _ISQ, _DISQ = "ln($)", "1 / $", "(1 / sqrt($))", "-0.5 / ($ * sqrt($))"
_MEAN = "mean as (select avg(a) a, avg(b) b, avg(c) c from cov), " + _fn_sql("mean", _ISQ, _DISQ, "ref")
_WHITE = "white as (select vec_id, label, (p * cov.a + q * cov.b) * p + (p * cov.b + q * cov.c) * q a, (p * cov.a + q * cov.b) * q + (p * cov.b + q * cov.c) * t b, (q * cov.a + t * cov.b) * q + (q * cov.b + t * cov.c) * t c from cov, (select fa p, fb q, fc t from ref) r)"
_HALF = "select vec_id, round({a}, 6) + 0.0 f0, round({c}, 6) + 0.0 f1, round(sqrt(2.0::double) * {b}, 6) + 0.0 f2 from {src}"


def _half(df, m):
    a, b, c = m
    return df.select("vec_id", (F.round(a, 6) + 0.0).alias("f0"), (F.round(c, 6) + 0.0).alias("f1"), (F.round(F.sqrt(F.lit(2.0)) * b, 6) + 0.0).alias("f2"))


def _abc(prefix=""):
    return F.col(f"{prefix}a"), F.col(f"{prefix}b"), F.col(f"{prefix}c")


def _whitened(spark, d):
    """One pass for the mean (three numbers), one that whitens with it; the model row is a broadcast of fixed size."""
    cov = _cov2(spark, d)
    mean = cov.agg(*(F.avg(k).alias(f"m{k}") for k in "abc"))
    ref = mean.select(*(x.alias(n) for x, n in zip(sym2.invsqrtm(*_abc("m")), ("ra", "rb", "rc"))))
    w = sym2.congruence(_abc("r"), _abc())
    return cov.crossJoin(F.broadcast(ref)).select("vec_id", "label", *(x.alias(n) for x, n in zip(w, "abc")))


@query(f"with {_COV2}, {_fn_sql('cov', _LOG, _DLOG, 'f')} " + _HALF.format(a="fa", b="fb", c="fc", src="f"))
def logm_2x2(spark, d):
    return _half(_cov2(spark, d), sym2.logm(*_abc()))


@query(f"with {_COV2}, {_fn_sql('cov', _ISQ, _DISQ, 'f')} " + _HALF.format(a="fa", b="fb", c="fc", src="f"))
def invsqrtm_2x2(spark, d):
    return _half(_cov2(spark, d), sym2.invsqrtm(*_abc()))


@query(f"with {_COV2}, {_MEAN}, {_WHITE}, {_fn_sql('white', _LOG, _DLOG, 'f')} " + _HALF.format(a="fa", b="fb", c="fc", src="f"))
def riemann_euclid_c2(spark, d):
    return _half(_whitened(spark, d), sym2.logm(*_abc()))


@query(f"with {_COV2}, {_MEAN}, {_WHITE} " + _HALF.format(a="a", b="b", c="c", src="white"))
def whitened_euclid_c2(spark, d):
    return _half(_whitened(spark, d), _abc())


@query(SQL["logm_2x2"])
def no_adaptation_c2(spark, d):
    """The reference matrix is the identity: whitened all the same, then the logarithm."""
    one, none = F.lit(1.0), F.lit(0.0)
    white = _cov2(spark, d).select("vec_id", *(x.alias(n) for x, n in zip(sym2.congruence((one, none, one), _abc()), "abc")))
    return _half(white, sym2.logm(*_abc()))


_CLS = "(values (0, 3, -2, 1, 40), (1, -1, 4, 2, 0), (2, 2, 2, -3, -25), (3, -2, -1, 5, 10)) w(cls, w0, w1, w2, bias)"
_QF = "round_even(greatest(least({x} * 32.0::double, 127), -128), 0)::bigint"


@query(f"with {_COV2}, {_MEAN}, {_WHITE}, {_fn_sql('white', _LOG, _DLOG, 'f')}, q as (select vec_id, {_QF.format(x='fa')} q0, {_QF.format(x='fc')} q1, (91 * {_QF.format(x='fb')} + 32) >> 6 q2 from f) select vec_id, (w0 * q0 + w1 * q1 + w2 * q2 + bias)::bigint score, cls::int cls from q, {_CLS} qualify row_number() over (partition by vec_id order by w0 * q0 + w1 * q1 + w2 * q2 + bias desc, cls) = 1")
def golden_inference(spark, d):
    """Integer features (eight bits, root of two as 91 / 64), integer scores of four classes, best class."""
    a, b, c = sym2.logm(*_abc())
    q = _whitened(spark, d).select("vec_id", Q.half_even(a, 4.0, 8).alias("q0"), Q.half_even(c, 4.0, 8).alias("q1"), Q.shift_round(91 * Q.half_even(b, 4.0, 8), 6).alias("q2"))
    q = q.select("vec_id", F.array("q0", "q1", "q2").alias("f"))
    w = "array(array(3, -2, 1), array(-1, 4, 2), array(2, 2, -3), array(-2, -1, 5))[{c}][k]"
    scored = classify.score_arrays(q, "f", w, 4, "cast(array(40, 0, -25, 10)[{c}] as bigint)")
    return scored.select("vec_id", F.array_max("scores").alias("score"), classify.argmax("scores").alias("cls"))


# ---- eight channels ------------------------------------------------------------------------------------------------


def _trials8(spark, d):
    return embeddings(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


def _rounded(df, m, cols=8):
    return M.cells(df, "vec_id", m, cols).withColumn("v", F.round("v", 6) + 0.0)


@query()
def logm_c8(spark, d):
    return _rounded(spd.map_matrices(spd.covariance(_trials8(spark, d), "x", 8), "cov", 8, spd.logm), "m")


@query()
def eigh_c8(spark, d):
    w = spd.map_matrices(spd.covariance(_trials8(spark, d), "x", 8), "cov", 8, np.linalg.eigvalsh)
    return M.entries(w, "vec_id", "m").select("vec_id", "i", F.round("v", 6).alias("v"))


@query()
def householder_tridiag(spark, d):
    f = lambda x: spd.tridiagonal(x)[0]
    t = _rounded(spd.map_matrices(spd.covariance(_trials8(spark, d), "x", 8), "cov", 8, f), "m")
    return t.withColumn("v", F.when(F.abs(F.col("i") - F.col("j")) == 1, F.abs("v")).otherwise(F.col("v")))


@query()
def karcher_mean(spark, d):
    cov = checkpoint(spd.covariance(_trials8(spark, d), "x", 8).select(F.lit(0).alias("band"), "cov"))
    m = spd.mean_riemann(cov, ["band"], "cov", 8)
    return spark.createDataFrame([(k[0], i, j, round(float(v[i, j]), 6)) for k, v in m.items() for i in range(8) for j in range(8)], "band int, i int, j int, v double")


_FLOAT_COV2 = f"select vec_id, any_value(label) label, sum(x0 * x0) / 31 + 1 / 32.0::double a, sum(x0 * x1) / 31 b, sum(x1 * x1) / 31 + 1 / 32.0::double c from (select vec_id, any_value(label) label, t, max(x) filter (where c = 0) x0, max(x) filter (where c = 1) x1 from ({trials(2)}) group by vec_id, t) group by vec_id"


def _float_cov2(spark, d):
    x = embeddings(spark, d).select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return spd.covariance(x, "x", 2).select("vec_id", "label", "cov")


@query(
    f"with s as (select vec_id // 2 pair, count(*) n, min_by([a, b, c], vec_id) p, max_by([a, b, c], vec_id) q from ({_FLOAT_COV2}) group by 1), d as (select *, sqrt(p[1] * p[3] - p[2] * p[2]) da, sqrt(q[1] * q[3] - q[2] * q[2]) db from s), "
    "m as (select *, list_transform([1, 2, 3], lambda k: p[k] / da + q[k] / db) g from d), r as (select *, sqrt(da * db / (g[1] * g[3] - g[2] * g[2])) f from m) "
    "select pair, n, round(f * g[1], 6) a, round(f * g[2], 6) + 0.0 b, round(f * g[3], 6) c from r"
)
def karcher_pairs_c2(spark, d):
    """The mean of every two trials' covariances, all pairs in one loop; of two matrices there is a closed form."""
    cov = _float_cov2(spark, d).withColumn("pair", F.expr("vec_id div 2"))
    m = means.karcher_means(cov, ["pair"], "cov", 2, tol=1e-9)
    at = lambda k: F.round(F.col("mean")[k], 6) + 0.0
    return m.select("pair", "n", at(0).alias("a"), at(1).alias("b"), at(3).alias("c"))


@query(
    f"with m as (select label, avg(a) a, avg(b) b, avg(c) c from ({_FLOAT_COV2}) group by 1), p as (select x.label c1, y.label c2, (x.a * y.c - 2 * x.b * y.b + x.c * y.a) / (y.a * y.c - y.b * y.b) t, (x.a * x.c - x.b * x.b) / (y.a * y.c - y.b * y.b) d from m x join m y on x.label < y.label) "
    "select c1, c2, k::int k, round((t + (2 * k - 1) * sqrt(greatest(t * t - 4 * d, 0))) / 2, 6) as value from p, (values (0), (1)) v(k)"
)
def generalised_eigen_c2(spark, d):
    """Generalised eigenvalues between the mean covariances of every two classes."""
    m = means.euclid_means(_float_cov2(spark, d), ["label"], "cov", 2)
    return means.pair_filters(m, [], "label", 2).select("c1", "c2", "k", F.round("value", 6).alias("value"))


def _model(spark, d, option="Riemann"):
    return spd.RiemannFeatures(8, [(0, 8)], [None, np.array([[0.25, 0.0, -0.25, 1.0, -1.2, 0.5]])], 1.0, option)


@query()
def riemann_features_c8(spark, d):
    t = _trials8(spark, d)
    f = _model(spark, d).fit(t).transform(t, "vec_id")
    return M.entries(f, "vec_id", "f").select("vec_id", "i", F.round("v", 5).alias("v"))


@query()
def pipeline_trace(spark, d):
    t = _trials8(spark, d)
    return _model(spark, d, "Riemann_Euclid").fit(t).transform(t, "vec_id", trace=True)


@query()
def csp_filters(spark, d):
    """For each pair of classes, w w' of every spatial filter: no choice of sign is left."""
    cov = checkpoint(spd.covariance(_trials8(spark, d), "x", 8, rho=0.1).select("label", "cov"))
    w = spd.csp_filters(cov, "label", "cov", 8)
    rows = [(a, b, k, i, j, round(float(m[i, k] * m[j, k]), 4)) for (a, b), m in w.items() for k in range(m.shape[1]) for i in range(8) for j in range(8)]
    return spark.createDataFrame(rows, "c1 int, c2 int, k int, i int, j int, v double")


_WSP = np.array([[((7 * i + 3 * k) % 11 - 5) for k in range(3)] for i in range(8)], float)


@query(f"with y as (select vec_id, k, t, sum(((7 * c + 3 * k) % 11 - 5) * x) y from ({trials(8)}), (select unnest(range(3))::int k) group by all) select vec_id, k i, round(log10(var_pop(y)), 5) v from y group by all")
def csp_logvar(spark, d):
    f = spd.log_variance(_trials8(spark, d), "x", 8, _WSP)
    return M.entries(f, "vec_id", "f").select("vec_id", "i", F.round("v", 5).alias("v"))


@query("select event_type, round(max(abs(value - 280.0::double)), 6) top, pow(2.0::double, ceil(log2(max(abs(value - 280.0::double))))) scale from events group by 1")
def calibrate_ranges(spark, d):
    top = F.max(F.abs(F.col("value") - 280.0))
    return table(spark, d, "events").groupBy("event_type").agg(F.round(top, 6).alias("top"), Q.power_of_two(top).alias("scale"))


# ---- classifiers ---------------------------------------------------------------------------------------------------

_SCORES = f"select vec_id, cls::int cls, (sum(x * ((7 * cls + 3 * p) % 11 - 5)) + cls * 10)::bigint score, any_value(label) label from (select vec_id, label, c * 8 + t p, x from ({qtrials(8)})), range(4) r(cls) group by vec_id, cls"


def _best(spark, d):
    scored = classify.score_arrays(base(spark, d), "a", "(7 * {c} + 3 * k) % 11 - 5", 4, "cast(c * 10 as bigint)")
    return scored.select("vec_id", classify.argmax("scores").alias("prediction"))


def _scores(spark, d):
    return classify.integer_scores(base(spark, d), "vec_id", "a", "(7 * {c} + 3 * k) % 11 - 5", 4, "cast(c * 10 as bigint)")


@query(f"select vec_id, cls, score from ({_SCORES})")
def svm_score_int(spark, d):
    return _scores(spark, d)


@query(f"select vec_id, cls prediction from ({_SCORES}) qualify row_number() over (partition by vec_id order by score desc, cls) = 1")
def argmax_class(spark, d):
    return _best(spark, d)


@query(f"select count(*) n, round(avg((cls = label % 4)::int), 6) accuracy from (select cls, label from ({_SCORES}) qualify row_number() over (partition by vec_id order by score desc, cls) = 1)")
def accuracy(spark, d):
    p = _best(spark, d).join(embeddings(spark, d).select("vec_id", (F.col("label") % 4).alias("label")), "vec_id")
    return classify.accuracy(p).withColumn("accuracy", F.round("accuracy", 6))


def _split(spark, d):
    df = classify.with_vector(_trials8(spark, d), "x").withColumn("label", F.col("label").cast("double"))
    return df.where("vec_id % 5 <> 0"), df.where("vec_id % 5 = 0")


@query()
def linear_svm_ovr(spark, d):
    train, test = _split(spark, d)
    return classify.fit_predict(classify.linear_svm(0.1, train.count()), train, test, "vec_id")[1]


@query()
def scaled_linear_svm(spark, d):
    train, test = _split(spark, d)
    return classify.fit_predict(classify.linear_svm(0.1, train.count(), scaled=True), train, test, "vec_id")[1]


@query()
def mlp(spark, d):
    train, test = _split(spark, d)
    classes = int(train.agg(F.max("label")).first()[0]) + 1
    return classify.fit_predict(classify.mlp([64, 16, classes]), train, test, "vec_id")[1]


@query()
def decision_tree(spark, d):
    train, test = _split(spark, d)
    return classify.fit_predict(classify.tree(), train, test, "vec_id")[1]


#: C's of the search over rbf machines.
RBF_C = (1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0, 100.0)


@query()
def rbf_svm(spark, d):
    """Held-out classes under every C of the grid, gamma by the variance of the training vectors."""
    t = _trials8(spark, d)
    train = t.where("vec_id % 5 <> 0")
    model = kernel.KernelSvm("rbf", RBF_C, kernel.scale_gamma(train, "x")).fit(train, "vec_id", "label", "x")
    of = spark.createDataFrame([(k, c) for k, (_, c) in enumerate(model.settings)], "setting int, c double")
    test = t.where("vec_id % 5 = 0")
    return model.predict(test, "vec_id", "x").join(F.broadcast(of), "setting").join(test.select("vec_id", "label"), "vec_id").select("vec_id", "label", "c", F.col("prediction").cast("int").alias("prediction"))


@query(f"with q as (select vec_id, label, list(x order by c, t) x from ({qtrials(8)}) group by 1, 2), n as (select a.vec_id, b.label, row_number() over (partition by a.vec_id order by list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vec_id) r from q a join q b on a.vec_id % 50 = 0 and b.vec_id % 50 <> 0), v as (select vec_id, label, count(*) n from n where r <= 5 group by all) select vec_id, label::int prediction from v qualify row_number() over (partition by vec_id order by n desc, label) = 1")
def knn_classify(spark, d):
    b = base(spark, d).select("vec_id", "label", "a")
    near = classify.knn(b.where("vec_id % 50 <> 0"), b.where("vec_id % 50 = 0"), "vec_id", "a", 5)
    votes = near.join(b.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy("vec_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("vec_id").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("prediction"))


@query(f"with q as (select vec_id, list(x order by c, t) x from ({qtrials(8)}) group by 1), n as (select a.vec_id, b.vec_id neighbour, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::double d from q a join q b on a.vec_id <> b.vec_id) select vec_id, neighbour, (row_number() over (partition by vec_id order by d, neighbour))::int as rank, d from n qualify row_number() over (partition by vec_id order by d, neighbour) <= 3")
def knn_of_all(spark, d):
    """The three nearest other trials of every trial."""
    return neighbours.NearestOfAll(base(spark, d).select("vec_id", "a"), "vec_id", "a", 3, rows=128).neighbours()


@query("with e as (select vec_id, unnest(range(64))::int i, unnest(embedding)::double x from embeddings), r as (select i, min(x) lo, max(x) hi from e group by 1) select vec_id, i, round((x - lo) / case when hi > lo then hi - lo else 1 end, 6) v from e join r using (i)")
def minmax_scale(spark, d):
    return M.entries(classify.min_max(_trials8(spark, d), "x", 64), "vec_id", "x").select("vec_id", "i", F.round("v", 6).alias("v"))


@query("select vec_id, label, ntile(5) over (partition by label order by vec_id)::int fold from embeddings")
def kfold_assign(spark, d):
    return classify.contiguous_folds(embeddings(spark, d).select("vec_id", "label"), 5, ["label"], "vec_id")


# ---- search reports ------------------------------------------------------------------------------------------------

_RUNS = "select (l_suppkey % 9)::int subject, l_returnflag as mode, l_linenumber::int run, round(avg(l_discount) * 10, 6) accuracy, sum(l_quantity)::bigint n_params from lineitem group by all"


def _runs(spark, d):
    x = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 9).cast("int").alias("subject"), F.col("l_returnflag").alias("mode"), F.col("l_linenumber").cast("int").alias("run"))
    return x.agg(F.round(F.avg("l_discount") * 10, 6).alias("accuracy"), F.sum("l_quantity").cast("bigint").alias("n_params"))


@query("select * from (select distinct l_linenumber run from lineitem), (select distinct l_returnflag mode from lineitem), (select distinct l_linestatus status from lineitem)")
def hparam_grid(spark, d):
    """Every combination of the values that three columns have."""
    x = table(spark, d, "lineitem")
    return search.grid_of(x, run="l_linenumber", mode="l_returnflag", status="l_linestatus")


@query(f"select mode, run, round(avg(accuracy), 6) mean_accuracy, round(stddev_pop(accuracy), 6) std_accuracy from ({_RUNS}) group by all order by avg(accuracy) desc, mode, run limit 1")
def best_shared_hparams(spark, d):
    return search.best_shared(_runs(spark, d)).select("mode", "run", F.round("mean_accuracy", 6).alias("mean_accuracy"), F.round("std_accuracy", 6).alias("std_accuracy"))


@query(f"select subject, accuracy best, mode, run from ({_RUNS}) qualify row_number() over (partition by subject order by accuracy desc, run, mode desc) = 1")
def best_per_subject(spark, d):
    return search.best_per_subject(_runs(spark, d))


_BUDGET = [1_000, 5_000, 10_000, 20_000, 50_000]


@query(f"with b as (select budget, subject, max(case when n_params <= budget then accuracy else 0 end) best from ({_RUNS}), (select unnest({_BUDGET})::bigint budget) group by all) select budget, round(avg(best), 6) mean_best, round(stddev_pop(best), 6) std_best from b group by 1")
def budget_curve(spark, d):
    c = search.budget_curve(_runs(spark, d), spark.createDataFrame([(b,) for b in _BUDGET], "budget long"))
    return c.select("budget", F.round("mean_best", 6).alias("mean_best"), F.round("std_best", 6).alias("std_best"))


@query(f"with r as materialized ({_RUNS}), b as (select budget, subject, max(case when n_params <= budget then accuracy else 0 end) best from r, (select 7 * unnest(range(10000))::bigint budget) group by all) select budget, round(avg(best), 6) mean_best, round(stddev_pop(best), 5) std_best from b group by 1")
def budget_curve_fine(spark, d):
    """The same curve at ten thousand budgets."""
    c = search.budget_curve(_runs(spark, d), spark.range(10_000).select((7 * F.col("id")).alias("budget")))
    return c.select("budget", F.round("mean_best", 6).alias("mean_best"), F.round("std_best", 5).alias("std_best"))


_WIDE_GRID = {f"h{k}": list(range(1000)) for k in range(4)}


@query("select count(*) n, count(*) n_distinct, true inside from orders")
def grid_assignments(spark, d):
    """Every order gets a setting of its own out of a grid of 10^12 that is not built."""
    g = search.GridSample(7, **_WIDE_GRID)
    given = g.of(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")
    h = F.struct(*_WIDE_GRID)
    return given.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(h).alias("n_distinct"), F.min(F.least(*(F.col(c).between(0, 999) for c in _WIDE_GRID))).alias("inside"))


@query(f"select subject, mode, run, accuracy, n_params from ({_RUNS}) order by accuracy desc, subject, mode, run limit 10")
def top10_runs(spark, d):
    return search.top_runs(_runs(spark, d)).select("subject", "mode", "run", "accuracy", "n_params")


@query(f"select mode, run, max(accuracy) best from ({_RUNS}) group by all")
def dedup_best(spark, d):
    return search.dedup_best(_runs(spark, d))


@query("with c as (select distinct label from embeddings) select a.label c1, b.label c2 from c a join c b on a.label < b.label")
def class_pairs(spark, d):
    return search.class_pairs(embeddings(spark, d).select("label").distinct(), "label")


@query("with r as (select event_type, event_id, round(abs(value - 280.0::double), 6) v, row_number() over (partition by event_type order by abs(value - 280.0::double), event_id) lo, row_number() over (partition by event_type order by abs(value - 280.0::double) desc, event_id) hi from events) select event_type, event_id, v, case when lo <= 3 then lo else -hi end::int rank from r where lo <= 3 or hi <= 3")
def bottom_top_k(spark, d):
    v = F.abs(F.col("value") - 280.0)
    e = table(spark, d, "events").select("event_type", "event_id", v.alias("a"))
    pick = lambda o, s: e.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy(o, "event_id"))).where("r <= 3").select("event_type", "event_id", F.round("a", 6).alias("v"), (s * F.col("r")).cast("int").alias("rank"))
    low = pick(F.col("a"), 1)
    high = pick(F.desc("a"), -1)
    return low.unionByName(high.join(low.select("event_type", "event_id"), ["event_type", "event_id"], "left_anti").select(*low.columns))
