"""Trials and signals from the columnar tables, and the recording source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigflow.session import table

RECORDING = T.StructType([
    T.StructField("subject", T.IntegerType()), T.StructField("split", T.StringType()),
    T.StructField("x", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("trial", T.ArrayType(T.IntegerType())),
    T.StructField("y", T.ArrayType(T.IntegerType())), T.StructField("artifacts", T.ArrayType(T.IntegerType())),
])
TRIAL_SAMPLES, CHANNELS = 1750, 22


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def trial_samples(spark: SparkSession, sf_dir: str, channels: int) -> DataFrame:
    """(vec_id, label, c, t, x): each vector as ``channels`` rows of 64 / channels samples."""
    width = 64 // channels
    e = embeddings(spark, sf_dir).select("vec_id", "label", F.posexplode("embedding").alias("p", "x"))
    return e.select("vec_id", "label", F.expr(f"cast(p div {width} as int)").alias("c"), (F.col("p") % width).cast("int").alias("t"), F.col("x").cast("double").alias("x"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, x): one signal a user, ordered by (ts, event_id). A stored trial table would need no such sort."""
    e = table(spark, sf_dir, "events")
    packed = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return packed.select("user_id", F.transform("s", lambda r: r.value).alias("x"))


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recording runs of the fixed schema; subject and split prune partitions."""
    return spark.read.schema(RECORDING).parquet(path)


def recording_trials(runs: DataFrame, samples: int = TRIAL_SAMPLES, channels: int = CHANNELS) -> DataFrame:
    """(subject, split, run_trial, label, channel, x): trials without an artefact, cut from their start, first channels only.

    ``x`` of a run is samples by channels, ``trial`` its start indices.
    """
    one = runs.select("subject", "split", "x", F.posexplode(F.arrays_zip("trial", "y", "artifacts")).alias("run_trial", "r")).where("r.artifacts = 0")
    cut = one.select("subject", "split", "run_trial", F.col("r.y").alias("label"), F.slice("x", F.col("r.trial") + 1, samples).alias("w"))
    return cut.select("subject", "split", "run_trial", "label", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("channel"), "w").select("subject", "split", "run_trial", "label", "channel", F.expr("transform(w, r -> r[channel])").alias("x"))
