"""Queries on rounding rules, shifts, scales, bands and shapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigflow.functions import quant as Q
from sigflow.plans.dialect import SIGNAL, quant, trials
from sigflow.session import table
from sigflow.sources.tables import embeddings, signals, trial_samples

QUERIES, SQL = {}, {}


def _x(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") - 280.0).alias("x"))


def _rule(name: str, f, sql: str):
    QUERIES[name] = lambda spark, d: _x(spark, d).select("event_id", f(F.col("x")).alias("y"))
    SQL[name] = f"select event_id, {sql} y from (select event_id, value - 280.0 x from events)"


_N = "x / 512.0::double * 128.0::double"
_rule("quantize_round_away", lambda x: Q.round_away(x, 512, 8), quant("x", 512))
_rule("quantize_trunc", lambda x: Q.truncate(x, 512, 8), f"trunc(greatest(least({_N}, 127.0::double), -128.0::double))::bigint")
_rule("quantize_half_even", lambda x: Q.half_even(x, 512, 8), f"round_even(greatest(least({_N}, 127.0::double), -128.0::double), 0)::bigint")
_rule("fake_quantize", lambda x: F.round(Q.fake_quantize(x, 512, 8), 6), f"round({quant('x', 512)}::double / 128.0::double * 512.0::double, 6)")
_rule("dequantize", lambda x: F.round(Q.dequantize(Q.round_away(x, 1024, 12), 1024, 12), 6), f"round({quant('x', 1024, 12)}::double / 2048.0::double * 1024.0::double, 6)")
_rule("bitshift_round", lambda x: Q.shift_round(Q.round_away(x, 512, 16), 5), f"({quant('x', 512, 16)} + 16) >> 5")
_rule("bitshift_floor", lambda x: Q.shift_floor(Q.round_away(x, 512, 16), 5), f"{quant('x', 512, 16)} >> 5")
_R6 = "(x::float * 0.25::float)::double"
_rule("f32_to_i8", lambda x: Q.to_int8(x, 0.25), f"least(greatest(trunc(case when {_R6} > 0 then {_R6} + 0.5 else {_R6} - 0.5 end)::bigint, -128), 127)::bigint")
_rule("i32_to_float", lambda x: Q.int32_to_float(Q.round_away(x, 512, 16), 0.125), f"({quant('x', 512, 16)}::float * 0.125::float)::float")


def scale_solve(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    sa, sy = F.pow(F.lit(2.0), F.col("k") % 7), F.pow(F.lit(2.0), F.col("k") % 11)
    return n.select("k", F.round(Q.solve_scale(sy, sa), 9).alias("linear"), F.round(Q.solve_scale_square(sy, sa), 9).alias("square"), F.round(Q.power_of_two(F.col("k") + 1.5), 6).alias("power"))


def prepare_bitshift(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    two = lambda e: F.pow(F.lit(2.0), e.cast("double"))
    return n.select("k", Q.bit_shift(two(F.col("k") % 5), two(F.lit(7)), two(F.lit(15)), two(F.col("k") % 3), two(F.lit(1)), two(F.col("k"))).alias("shift"))


def window_index(spark, d):
    w = table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("win"))
    return w.select("win", ((F.col("win") * 0.1 + 2.5) * 250).cast("int").alias("t_start"), ((F.col("win") * 0.1 + 6.0) * 250).cast("int").alias("t_end"))


def time_window_slice(spark, d):
    windows = spark.createDataFrame([(0, 0, 3), (1, 2, 6), (2, 5, 8)], "win int, lo int, hi int")
    e = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x")).crossJoin(F.broadcast(windows))
    rows = e.selectExpr("vec_id", "win", "explode(sequence(0, 7)) as c", "lo", "hi", "x")
    return rows.selectExpr("vec_id", "win", "c", "posexplode(slice(x, c * 8 + lo + 1, hi - lo)) as (t, v)").withColumn("v", F.round("v", 6))


def align_pad(spark, d):
    """Each user's signal with zeros behind it up to a multiple of four samples."""
    x = signals(spark, d).withColumn("n", F.size("x"))
    pad = x.select("user_id", F.concat("x", F.array_repeat(F.lit(0.0), F.pmod(-F.col("n"), F.lit(4)))).alias("x"))
    return pad.select("user_id", F.posexplode("x").alias("k", "v")).select("user_id", F.col("k").cast("bigint").alias("k"), F.round("v", 6).alias("v"))


def vectorise_features(spark, d):
    """Windows x bands x components flattened in this order, from one nested array a row; narrow."""
    e = embeddings(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    cube = e.selectExpr("vec_id", "transform(sequence(0, 1), w -> transform(sequence(0, 3), b -> slice(x, w * 32 + b * 8 + 1, 8))) as f")
    return cube.select("vec_id", F.posexplode(F.flatten(F.flatten("f"))).alias("pos", "v")).select("vec_id", "pos", F.round("v", 6).alias("v"))


def artifact_filter(spark, d):
    """Rows whose artefact flag is unset; the predicate reaches the scan."""
    return table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def channel_project(spark, d):
    return trial_samples(spark, d, 8).where("c < 5").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("c").alias("channels"))


for _f in (scale_solve, prepare_bitshift, window_index, time_window_slice, align_pad, vectorise_features, artifact_filter, channel_project):
    QUERIES[_f.__name__] = _f

SQL |= {
    "scale_solve": "select k, round(y / a, 9) linear, round(sqrt(y / a), 9) square, round(pow(2.0::double, ceil(log2(k + 1.5))), 6) power from (select n_nationkey::int k, pow(2.0::double, n_nationkey % 7) a, pow(2.0::double, n_nationkey % 11) y from nation)",
    "prepare_bitshift": "select n_nationkey::int k, ((n_nationkey % 5) + 7 + n_nationkey - ((n_nationkey % 3) + 1 + 15))::bigint shift from nation",
    "window_index": "select n_nationkey::int win, trunc((n_nationkey * 0.1::double + 2.5::double) * 250)::int t_start, trunc((n_nationkey * 0.1::double + 6.0::double) * 250)::int t_end from nation",
    "time_window_slice": f"select vec_id, win, c, (t - lo)::int t, round(x, 6) v from ({trials(8)}), (values (0, 0, 3), (1, 2, 6), (2, 5, 8)) w(win, lo, hi) where t >= lo and t < hi",
    "align_pad": f"with s as ({SIGNAL}), n as (select user_id, count(*) n from s group by 1) select user_id, k::bigint k, round(value, 6) v from s union all select user_id, (n + i)::bigint, 0.0::double from n, range(3) r(i) where n + i < ceil(n / 4.0) * 4",
    "vectorise_features": f"select vec_id, ((c // 4) * 32 + (c % 4) * 8 + t)::int pos, round(x, 6) v from ({trials(8)})",
    "artifact_filter": "select user_id, count(*) n from events where event_type <> 'error' group by 1",
    "channel_project": f"select vec_id, count(*) n, count(distinct c) channels from ({trials(8)}) where c < 5 group by 1",
}
