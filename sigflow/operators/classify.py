"""Classifiers, integer scoring, folds and accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigflow.session import checkpoint, ship


def with_vector(df: DataFrame, column: str = "f", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def dense(column: str):
    """A vector column as an array."""
    return vector_to_array(column)


def linear_svm(c: float, n: int, scaled: bool = False, seed: int = 1, iterations: int = 20) -> Pipeline:
    """One-vs-rest linear SVM; ``c`` weighs the hinge losses of ``n`` rows against the margin."""
    feature = "scaled" if scaled else "features"
    svm = OneVsRest(classifier=LinearSVC(regParam=1.0 / (c * max(n, 1)), standardization=False, maxIter=iterations, tol=1e-5, featuresCol=feature), featuresCol=feature, parallelism=8)
    return Pipeline(stages=[*([MinMaxScaler(inputCol="features", outputCol="scaled")] if scaled else []), svm])


def mlp(layers: list[int], seed: int = 1, iterations: int = 30) -> Pipeline:
    return Pipeline(stages=[MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed)])


def tree(depth: int = 5, seed: int = 1) -> Pipeline:
    return Pipeline(stages=[DecisionTreeClassifier(impurity="entropy", maxDepth=depth, seed=seed)])


def fit_predict(pipeline: Pipeline, train: DataFrame, test: DataFrame, key: str) -> tuple[PipelineModel, DataFrame]:
    model = pipeline.fit(train)
    return model, model.transform(test).select(key, "label", F.col("prediction").cast("int").alias("prediction"))


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def parameter_count(model: PipelineModel) -> int:
    """Weights of a fitted pipeline: SVM coefficients or network weights; -1 for other kinds."""
    last = model.stages[-1]
    if hasattr(last, "models"):
        return sum(m.coefficients.size for m in last.models)
    return last.weights.size if hasattr(last, "weights") else -1


def integer_scores(df: DataFrame, key: str, column: str, weights: str, classes: int, bias: str = "0L") -> DataFrame:
    """(key, cls, score) of exact integer dot products: weight of (cls, k) and bias of cls as SQL texts in ``{c}`` and ``k``; local to the row."""
    score = f"aggregate(transform({column}, (x, k) -> x * ({weights})), {bias}, (s, v) -> s + v)".replace("{c}", "c")
    return df.selectExpr(key, f"posexplode(transform(sequence(0, {classes - 1}), c -> {score})) as (cls, score)")


def score_arrays(df: DataFrame, column: str, weights: str, classes: int, bias: str = "0L", out: str = "scores") -> DataFrame:
    """``integer_scores`` as one array a row."""
    score = f"aggregate(transform({column}, (x, k) -> x * ({weights})), {bias}, (s, v) -> s + v)".replace("{c}", "c")
    return df.withColumn(out, F.expr(f"transform(sequence(0, {classes - 1}), c -> {score})"))


def argmax(column: str):
    """Class of the highest score of an array, ties to the lowest; null for no scores. Local to the row."""
    return (F.array_position(column, F.array_max(column)) - 1).cast("int")


def contiguous_folds(df: DataFrame, k: int, group: list[str], order: str, out: str = "fold") -> DataFrame:
    """Unshuffled folds inside each group, larger ones first."""
    return df.withColumn(out, F.ntile(k).over(Window.partitionBy(*group).orderBy(order)))


def min_max(df: DataFrame, column: str, n: int) -> DataFrame:
    """Each component scaled to [0, 1] by its range over all rows: one aggregation of 2 n values, then a narrow pass."""
    r = df.agg(*(F.min(F.get(column, F.lit(i))).alias(f"lo{i}") for i in range(n)), *(F.max(F.get(column, F.lit(i))).alias(f"hi{i}") for i in range(n))).first()
    lo, hi = ([float(r[f"{s}{i}"]) if r[f"{s}{i}"] is not None else 0.0 for i in range(n)] for s in ("lo", "hi"))
    lows, spans = F.array(*map(F.lit, lo)), F.array(*(F.lit(h - a if h > a else 1.0) for a, h in zip(lo, hi)))
    return df.withColumn(column, F.transform(column, lambda x, i: (x.cast("double") - F.get(lows, i)) / F.get(spans, i)))


def knn(train: DataFrame, test: DataFrame, key: str, column: str, k: int, block: int = 256) -> DataFrame:
    """(key, neighbour, rank) of the k nearest training rows, ties to the smaller key.

    A stated query set against all rows: queries are packed into blocks of about
    ``block``, training rows into chunks; every block meets every chunk in a task, which
    keeps k rows a query. Nothing comes to the driver; the number of blocks grows with
    the queries, not with the training rows. Rows without a vector take no part.
    """
    spark = ship(train.sparkSession)

    def packs(df: DataFrame, size: int, name: str) -> DataFrame:
        def run(batches):
            for b in batches:
                for lo in range(0, b.num_rows, size):
                    c = b.slice(lo, size)
                    x = np.stack([v.values.to_numpy(zero_copy_only=False).astype(float) for v in c.column(1)])
                    yield pa.record_batch([pa.array([c.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=[f"{name}_id", f"{name}_x"])

        return df.where(F.col(column).isNotNull()).select(F.col(key).cast("long"), column).mapInArrow(run, f"{name}_id binary, {name}_x binary")

    def meet(batches):
        for b in batches:
            for r in range(b.num_rows):
                q, ids = (np.frombuffer(b.column(i)[r].as_buffer(), np.int64) for i in (0, 2))
                v, x = (np.frombuffer(b.column(i)[r].as_buffer(), float).reshape(n, -1) for i, n in ((1, len(q)), (3, len(ids))))
                d = (v * v).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * v @ x.T
                top = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
                yield pa.record_batch([pa.array(np.repeat(q, top.shape[1])), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(d, top, 1).ravel())], names=[key, "neighbour", "d"])

    queries = checkpoint(packs(test.repartition(max(1, test.count() // (4 * block))), block, "q"))
    pairs = packs(train, 4096, "t").crossJoin(queries).select("q_id", "q_x", "t_id", "t_x")  # blocks with blocks, not rows with rows
    found = pairs.mapInArrow(meet, f"{key} long, neighbour long, d double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("d", "neighbour"))).where(F.col("rank") <= k)
