"""Queries on dense matrices, rotations and integer blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigflow.functions import quant as Q
from sigflow.functions import sym2
from sigflow.operators import matrices as M
from sigflow.plans.dialect import FIXED, A, W, qtrials, quant
from sigflow.session import table
from sigflow.sources.tables import embeddings

QUERIES, SQL = {}, {}
N = 8
_W = M.build(N, N, f"cast({FIXED} as bigint)")
_D = f"transform(sequence(0, {N - 1}), k -> cast(3 * k - 7 as bigint))"
_V = f"transform(sequence(0, {N - 1}), k -> cast((5 * k) % 7 - 3 as bigint))"


def base(spark, d):
    """(vec_id, label, a, w, dg, u): quantised 8 x 8 matrix, fixed matrix, diagonal and vector of every row."""
    e = embeddings(spark, d).select("vec_id", "label", F.transform("embedding", lambda x: Q.round_away(x.cast("double"), 1.0, 8)).alias("a"))
    return e.selectExpr("*", f"{_W} as w", f"{_D} as dg", f"{_V} as u")


def _matrix(name: str, m: str, sql: str, cols: int = N):
    QUERIES[name] = lambda spark, d: M.cells(base(spark, d), "vec_id", m, cols)
    SQL[name] = sql


def _vector(name: str, m: str, sql: str):
    QUERIES[name] = lambda spark, d: M.entries(base(spark, d), "vec_id", m)
    SQL[name] = sql


_VD = "select k::int k, ((5 * k) % 7 - 3)::bigint u, (3 * k - 7)::bigint dg from range(8) r(k)"
_WITH = f"with a as ({A}), w as ({W}), k as ({_VD}) "
_matrix("mat_eye", M.eye(N), "select vec_id, i::int i, j::int j, (i = j)::bigint v from embeddings, range(8) a(i), range(8) b(j)")
_matrix("mat_add", M.add("a", "w"), _WITH + "select vec_id, i, j, a.v + w.v v from a join w using (i, j)")
_matrix("mat_sub", M.sub("a", "w"), _WITH + "select vec_id, i, j, a.v - w.v v from a join w using (i, j)")
_matrix("mat_mul", M.mul("a", "w", N, N, N), _WITH + "select vec_id, a.i, w.j, sum(a.v * w.v)::bigint v from a join w on a.j = w.i group by all")
_matrix("mat_mul_t", M.mul_t("a", "w", N, N, N), _WITH + "select vec_id, a.i, w.i j, sum(a.v * w.v)::bigint v from a join w on a.j = w.j group by all")
_matrix("mat_mul_sym", M.mul_sym("a", M.transpose("a", N, N), N), _WITH + "select x.vec_id, x.i, y.i j, sum(x.v * y.v)::bigint v from a x join a y on x.vec_id = y.vec_id and x.j = y.j group by all")
_matrix("mat_diag_mul", M.mul_diag("a", "dg", N, N), _WITH + "select vec_id, i, j, v * dg v from a join k on k.k = j")
_matrix("mat_transpose", M.transpose("a", N, N), _WITH + "select vec_id, j i, i j, v from a")
_matrix("mat_submul", M.mul(M.sub_matrix("a", N, 2, 1, 4, 5), M.sub_matrix("w", N, 1, 3, 5, 3), 4, 5, 3), _WITH + "select vec_id, a.i - 2 i, w.j - 3 j, sum(a.v * w.v)::bigint v from a join w on a.j = w.i where a.i between 2 and 5 and a.j between 1 and 5 and w.j between 3 and 5 group by all", 3)
_matrix("vec_cov", M.vec_cov("u", N, "upper"), "with k as (" + _VD + ") select vec_id, x.k i, y.k j, case when x.k <= y.k then x.u * y.u else 0 end::bigint v from embeddings, k x, k y")
_matrix("vec_outer", M.outer("u", "dg", N, N), "with k as (" + _VD + ") select vec_id, x.k i, y.k j, x.u * y.dg v from embeddings, k x, k y")
_matrix("vec_outer_trials", M.outer("slice(a, 1, 24)", "slice(a, 25, 40)", 24, 40), f"with a as ({A}), f as (select vec_id, 8 * i + j p, v from a) select x.vec_id, x.p i, y.p - 24 j, x.v * y.v v from f x join f y on x.vec_id = y.vec_id and x.p < 24 and y.p >= 24", 40)
_matrix("matmul_i16", M.mul(M.mul("w", "a", N, N, N), "w", N, N, N), _WITH + ", p as (select vec_id, w.i, a.j, sum(w.v * a.v) v from w join a on w.j = a.i group by all) select vec_id, p.i, w.j, sum(p.v * w.v)::bigint v from p join w on p.j = w.i group by all")
_vector("mat_vec", M.mat_vec("a", "u", N, N), _WITH + "select vec_id, i, sum(v * u)::bigint v from a join k on k.k = j group by all")
_vector("vec_mat", M.vec_mat("u", "a", N, N), _WITH + "select vec_id, j i, sum(v * u)::bigint v from a join k on k.k = i group by all")


def vec_inner(spark, d):
    return base(spark, d).selectExpr("vec_id", f"{M.inner('slice(a, 1, 8)', 'slice(a, 9, 8)')} as v")


def vec_norm(spark, d):
    return base(spark, d).selectExpr("vec_id", f"round({M.norm('a')}, 6) as v")


def mat_swap(spark, d):
    b = base(spark, d).selectExpr("vec_id", "w as a", "a as w")
    return M.cells(b, "vec_id", M.sub("a", "w"), N)


_COV = M.mul_t("a", "a", N, N, N)


def _add_rho(cov: str, rho: int) -> str:
    return M.add(cov, M.build(N, N, f"if({{i}} = {{j}}, {rho}L, 0L)"))


def covmat_int(spark, d):
    """X X' + rho I, then a rounding shift: exact bigint."""
    b = base(spark, d).selectExpr("vec_id", f"transform({_add_rho(_COV, 50)}, v -> shiftright(v + 4, 3)) as m")
    return M.cells(b, "vec_id", "m", N)


def covmat_int_clip(spark, d):
    """The device's rule: a rounding shift, then a clip to 16 bits. The input is scaled up so that the clip is met."""
    b = base(spark, d).selectExpr("vec_id", f"transform({_add_rho(f'transform({_COV}, v -> v * 16L)', 50)}, v -> least(greatest(shiftright(v + 4, 3), -32768L), 32767L)) as m")
    return M.cells(b, "vec_id", "m", N)


def whiten_int(spark, d):
    """R S R with the fixed symmetric R; a result beyond 32 bits is an error."""
    r = M.build(N, N, f"cast({FIXED.format(i='least({i}, {j})', j='greatest({i}, {j})')} as bigint)")
    white = base(spark, d).selectExpr("vec_id", f"{_COV} as s", f"{r} as r").selectExpr("vec_id", f"{M.mul(M.mul('r', 's', N, N, N), 'r', N, N, N)} as m")
    checked = white.selectExpr("vec_id", "transform(m, v -> if(abs(v) >= 2147483648L, cast(raise_error('32-bit overflow') as bigint), v)) as m")
    return M.cells(checked, "vec_id", "m", N)


def half_vec(spark, d):
    s = base(spark, d).selectExpr("vec_id", f"{_COV} as s")
    return M.entries(s, "vec_id", M.half_vector("s", N)).select("vec_id", "i", F.round(F.col("v").cast("double"), 6).alias("v"))


def half_diag_int(spark, d):
    """Diagonal shifted down by 1, off-diagonals times 91 shifted down by 7, both with rounding: features at twice the logarithm's scale."""
    s = base(spark, d).selectExpr("vec_id", f"{_COV} as s").selectExpr("vec_id", f"{M.half_vector('s', N, '91L')} as h")
    return M.entries(s, "vec_id", f"transform(h, (v, i) -> if(i < {N}, shiftright(v + 1, 1), shiftright(v + 64, 7)))")


def _pairs(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "cast(event_id % 17 - 8 as double) as a", "cast(event_id % 13 - 6 as double) as b", "cast(event_id % 7 - 3 as double) as c")


def givens_rotation(spark, d):
    cs, sn = sym2.givens(F.col("a"), F.col("b"))
    return _pairs(spark, d).select("event_id", F.round(cs + 0.0, 6).alias("cs"), F.round(sn + 0.0, 6).alias("sn"), F.round(F.abs(sn * F.col("a") + cs * F.col("b")), 6).alias("rest"))


def evd_2x2(spark, d):
    p, q, cs2, cssn = sym2.dominant(F.col("a"), F.col("b"), F.col("c"))
    return _pairs(spark, d).select("event_id", *(F.round(x, 6).__add__(0.0).alias(n) for x, n in ((p, "ev1"), (q, "ev2"), (cs2, "cs2"), (cssn, "cssn"))))


def givens_diag(spark, d):
    """The rotation that makes the matrix diagonal, applied: what is left off the diagonal, and the diagonal."""
    p, q, cs2, cssn = sym2.dominant(F.col("a"), F.col("b"), F.col("c"))
    sn2 = 1.0 - cs2
    d1 = cs2 * F.col("a") + 2.0 * cssn * F.col("b") + sn2 * F.col("c")
    d2 = sn2 * F.col("a") - 2.0 * cssn * F.col("b") + cs2 * F.col("c")
    return _pairs(spark, d).select("event_id", F.round(F.abs(d1 - p), 5).alias("off1"), F.round(F.abs(d2 - q), 5).alias("off2"), (F.round(d1 + d2, 5) + 0.0).alias("trace"))


def apply_givens(spark, d):
    """Columns 2 and 3 rotated by the angle whose cosine is 0.6."""
    b = base(spark, d)
    cell = lambda a: f"case {{j}} when 2 then 0.6D * {M.at(a, N, '{i}', '2')} - 0.8D * {M.at(a, N, '{i}', '3')} when 3 then 0.8D * {M.at(a, N, '{i}', '2')} + 0.6D * {M.at(a, N, '{i}', '3')} else cast({M.at(a, N, '{i}', '{j}')} as double) end"
    return M.cells(b, "vec_id", M.bound(lambda a: M.build(N, N, cell(a)), "a"), N).withColumn("v", F.round("v", 6) + 0.0)


for _f in (vec_inner, vec_norm, mat_swap, covmat_int, covmat_int_clip, whiten_int, half_vec, half_diag_int, givens_rotation, evd_2x2, givens_diag, apply_givens):
    QUERIES[_f.__name__] = _f

_C = f"{_WITH}, s as (select x.vec_id, x.i, y.i j, sum(x.v * y.v)::bigint v from a x join a y on x.vec_id = y.vec_id and x.j = y.j group by all) "
_POS = "case when i = j then i else 8 + (j * (j - 1)) // 2 + i end::int"
_P = "select event_id, (event_id % 17 - 8)::double a, (event_id % 13 - 6)::double b, (event_id % 7 - 3)::double c from events"
_E = f"with p as ({_P}), e as (select *, sqrt((a - c) * (a - c) + 4.0::double * b * b) d from p), x as (select *, case when a + c < 0 then (a + c - d) / 2 else (a + c + d) / 2 end l1, case when a + c < 0 then (a + c + d) / 2 else (a + c - d) / 2 end l2 from e), z as (select *, case when l1 = l2 then 1.0::double else (a - l2) / (l1 - l2) end cs2, case when l1 = l2 then 0.0::double else b / (l1 - l2) end cssn from x) "
SQL |= {
    "vec_inner": _WITH + "select x.vec_id, sum(x.v * y.v)::bigint v from a x join a y on x.vec_id = y.vec_id and x.j = y.j where x.i = 0 and y.i = 1 group by 1",
    "vec_norm": _WITH + "select vec_id, round(sqrt(sum(v * v)::double), 6) v from a group by 1",
    "mat_swap": _WITH + "select vec_id, i, j, w.v - a.v v from a join w using (i, j)",
    "covmat_int": _C + "select vec_id, i, j, (v + case when i = j then 50 else 0 end + 4) >> 3 v from s",
    "covmat_int_clip": _C + "select vec_id, i, j, least(greatest((v * 16 + case when i = j then 50 else 0 end + 4) >> 3, -32768), 32767)::bigint v from s",
    "whiten_int": _C + ", r as (select least(i, j) x, greatest(i, j) y, i, j, ((7 * least(i, j) + 3 * greatest(i, j)) % 11 - 5)::bigint v from w), q as (select vec_id, r.i, s.j, sum(r.v * s.v) v from r join s on r.j = s.i group by all) select vec_id, q.i, r.j, sum(q.v * r.v)::bigint v from q join r on q.j = r.i group by all",
    "half_vec": _C + f"select vec_id, {_POS} i, round(case when i = j then v::double else sqrt(2.0::double) * v end, 6) v from s where i <= j",
    "half_diag_int": _C + f"select vec_id, {_POS} i, case when i = j then (v + 1) >> 1 else (v * 91 + 64) >> 7 end::bigint v from s where i <= j",
    "givens_rotation": f"select event_id, round(cs + 0.0, 6) cs, round(sn + 0.0, 6) sn, round(abs(sn * a + cs * b), 6) rest from (select *, case when b = 0 then 1.0 when a = 0 then 0.0 else a / sqrt(a * a + b * b) end::double cs, case when b = 0 then 0.0 when a = 0 then sign(b) else -b / sqrt(a * a + b * b) end::double sn from ({_P}))",
    "evd_2x2": _E + "select event_id, round(l1, 6) + 0.0 ev1, round(l2, 6) + 0.0 ev2, round(cs2, 6) + 0.0 cs2, round(cssn, 6) + 0.0 cssn from z",
    "givens_diag": _E + "select event_id, round(abs(cs2 * a + 2 * cssn * b + (1 - cs2) * c - l1), 5) off1, round(abs((1 - cs2) * a - 2 * cssn * b + cs2 * c - l2), 5) off2, round(a + c, 5) + 0.0 trace from z",
    "apply_givens": _WITH + "select x.vec_id, x.i, x.j, round(case x.j when 2 then 0.6::double * x.v - 0.8::double * y.v when 3 then 0.8::double * y.v + 0.6::double * x.v else x.v::double end, 6) + 0.0 v from a x join a y on x.vec_id = y.vec_id and x.i = y.i and y.j = (case x.j when 2 then 3 when 3 then 2 else x.j end)",
}
