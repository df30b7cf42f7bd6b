"""The multiscale features and the integer model as stages of Spark ML pipelines, saved and loaded with them."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigflow.operators.fixedpoint import FixedModel
from sigflow.operators.spd import RiemannFeatures


class _Settings(HasInputCol, HasOutputCol):
    """Parameters that both kinds of stage share; windows and sections are plain lists, so that they are saved with the others."""

    channels = Param(Params._dummy(), "channels", "channels of a signal", TypeConverters.toInt)
    windows = Param(Params._dummy(), "windows", "[from, to) in samples; to may be None", lambda v: [[None if e is None else int(e) for e in w] for w in v])
    bank = Param(Params._dummy(), "bank", "second-order sections of each band, or None", lambda v: [None if s is None else np.asarray(s, float).tolist() for s in v])
    rho = Param(Params._dummy(), "rho", "weight of the identity in covariances", TypeConverters.toFloat)
    option = Param(Params._dummy(), "option", "how features adapt to the training signals", TypeConverters.toString)

    def _sections(self) -> list:
        return [None if s is None else np.array(s) for s in self.getOrDefault("bank")]

    def _spans(self) -> list[tuple]:
        return [tuple(w) for w in self.getOrDefault("windows")]


class _FittedWriter(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.stage, path, spark.sparkContext)
        self.stage._table(spark).write.parquet(f"{path}/data")


class _FittedReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession.sparkContext)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(stage, metadata)
        stage._learn(self.sparkSession.read.parquet(f"{path}/data"))
        return stage


class _Fitted(Model, _Settings, MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return _FittedWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _FittedReader(cls)


class _Unfitted(Estimator, _Settings, MLWritable, MLReadable):
    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class RiemannEstimator(_Unfitted):
    """Learns the reference matrices of ``RiemannFeatures``; its model adds the features as a vector column and keeps all others."""

    @keyword_only
    def __init__(self, *, inputCol: str = "x", outputCol: str = "features", channels: int = 1, windows: list = ((0, None),), bank: list = (None,), rho: float = 1.0, option: str = "Riemann"):
        super().__init__()
        for k, v in {"inputCol": inputCol, "outputCol": outputCol, "channels": channels, "windows": windows, "bank": bank, "rho": rho, "option": option}.items():
            self._set(**{k: v})

    def _fit(self, dataset: DataFrame) -> RiemannModel:
        fitted = RiemannFeatures(self.getOrDefault("channels"), self._spans(), self._sections(), self.getOrDefault("rho"), self.getOrDefault("option")).fit(dataset, self.getInputCol())
        model = self._copyValues(RiemannModel())
        model.references = fitted.references
        return model


class RiemannModel(_Fitted):
    references: dict | None = None

    def _table(self, spark) -> DataFrame:
        return spark.createDataFrame([(int(b), m.ravel().tolist()) for b, m in self.references.items()], "band int, reference array<double>")

    def _learn(self, table: DataFrame) -> None:
        n = self.getOrDefault("channels")
        self.references = {r.band: np.array(r.reference).reshape(n, n) for r in table.collect()}

    def features(self) -> RiemannFeatures:
        return RiemannFeatures(self.getOrDefault("channels"), self._spans(), self._sections(), self.getOrDefault("rho"), self.getOrDefault("option"), self.references)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        return self.features().append(dataset, self.getInputCol(), out).withColumn(out, array_to_vector(out))


class FixedEstimator(_Unfitted):
    """Learns the integer model of one window; its model adds the integer features, as real numbers, in a vector column."""

    @keyword_only
    def __init__(self, *, inputCol: str = "x", outputCol: str = "features", channels: int = 1, windows: list = ((0, None),), bank: list = (None,), rho: float = 1.0, option: str = "riemann"):
        super().__init__()
        for k, v in {"inputCol": inputCol, "outputCol": outputCol, "channels": channels, "windows": windows, "bank": bank, "rho": rho, "option": option}.items():
            self._set(**{k: v})

    def _fit(self, dataset: DataFrame) -> FixedFeatures:
        (window,) = self._spans()
        model = self._copyValues(FixedFeatures())
        model.fixed = FixedModel(self.getOrDefault("channels"), self._sections(), self.getOrDefault("rho"), self.getOrDefault("option"), window).fit(dataset, self.getInputCol())
        return model


class FixedFeatures(_Fitted):
    fixed: FixedModel | None = None

    def _table(self, spark) -> DataFrame:
        return self.fixed.parameters(spark)

    def _learn(self, table: DataFrame) -> None:
        self.fixed = FixedModel.from_row(table.first(), self._sections())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out = self.getOutputCol()
        ints = self.fixed.append(dataset, self.getInputCol(), out)
        return self.fixed.real_features(ints, out).withColumn(out, array_to_vector(F.col(out)))
