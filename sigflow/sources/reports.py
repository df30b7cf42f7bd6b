"""Sinks and sources of results: features, models, sweeps, search runs, device reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").partitionBy("subject", "split").parquet(path)


def read_features(spark: SparkSession, path: str, subject: int | None = None) -> DataFrame:
    """All features, or one subject's: only its folder is read."""
    df = spark.read.parquet(path)
    return df if subject is None else df.where(F.col("subject") == subject)


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Model parameters, traces or search runs (parquet, json), a frequency sweep (csv, with header), or report lines (text)."""
    writer = df.write.mode("overwrite")
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.csv(p, header=True), "text": writer.text}[form](path)


def load_model(spark: SparkSession, path: str, classes: int = 4) -> DataFrame:
    """The one row of model parameters, checked as it is read: so many classes, each with its bias; filter sections of 3 + 3 coefficients; square references."""
    m = spark.read.parquet(path)
    sections = "forall(filters, f -> size(f.a) = size(f.b) and forall(f.a, c -> size(c) = 3) and forall(f.b, c -> size(c) = 3))"
    square = "forall(refs, r -> size(r) = channels * channels)"
    checks = ((f"size(svm_bias) = {classes} and size(svm_weights) = {classes}", f"{classes} classes expected"), (sections, "a filter section has not 3 + 3 coefficients"), (square, "a reference matrix is not square"))
    fault = "coalesce(" + ", ".join(f"if({ok}, null, '{say}')" for ok, say in checks) + ")"
    return m.where(F.expr(f"if({fault} is null, true, cast(raise_error({fault}) as boolean))"))  # a filter stays, whatever columns are read


def read_table(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """What ``write_table`` wrote, in the given schema."""
    reader = spark.read.schema(schema)
    return {"parquet": reader.parquet, "json": reader.json, "csv": lambda p: reader.csv(p, header=True), "text": reader.text}[form](path)


def report_lines(results: DataFrame, *columns: str) -> DataFrame:
    """One text line a row, ``name: value`` pairs in the given order."""
    return results.select(F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns)).alias("value"))


def parse_report(lines: DataFrame) -> DataFrame:
    """(case, key, value) of ``## case: key: value`` lines, with ``ipc`` = instructions / cycles added."""
    pattern = r"^##\s*([^:]+):\s*([^:]+):\s*(.*?)\s*$"
    kv = lines.where(F.col("value").startswith("##")).select(*(F.trim(F.regexp_extract("value", pattern, k + 1)).alias(n) for k, n in enumerate(("case", "key", "val")))).where("case <> ''")
    number = lambda k: F.max(F.when(F.col("key") == k, F.col("val").cast("double")))
    ipc = kv.groupBy("case").agg((number("instructions") / number("cycles")).alias("r")).where("r is not null").select("case", F.lit("ipc").alias("key"), F.col("r").cast("string").alias("val"))
    return kv.unionByName(ipc).withColumnRenamed("val", "value")
