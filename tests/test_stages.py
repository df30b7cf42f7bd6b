"""Features and integer model in Spark ML pipelines: fit, save, load, and the same rows again."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression

from sigflow.operators import filters, spd, stages
from sigflow.operators.fixedpoint import FixedModel

BANK = [filters.butter_band(2, 0.1, 0.5), None]


@pytest.fixture(scope="module")
def trials(spark):
    rng = np.random.default_rng(15)
    rows = []
    for k in range(60):
        mix = [[3.0, 0.0], [0.0, 1.0]] if k % 2 else [[1.0, 0.0], [2.5, 1.0]]
        rows.append((k, float(k % 2), "more", (np.array(mix) @ rng.normal(0, 1, (2, 120))).ravel().tolist()))
    return spark.createDataFrame(rows, "k long, label double, other string, x array<double>").repartition(3)


def test_riemann_stage(spark, trials, tmp_path):
    windows = [(0, 60), (30, None)]
    stage = stages.RiemannEstimator(channels=2, windows=windows, bank=BANK, option="Riemann_Euclid", rho=0.5)
    model = Pipeline(stages=[stage, LogisticRegression()]).fit(trials)
    got = model.transform(trials)
    assert set(trials.columns) < set(got.columns) and np.mean([r.prediction == r.label for r in got.collect()]) > 0.9
    plain = spd.RiemannFeatures(2, windows, BANK, 0.5, "Riemann_Euclid").fit(trials)
    want = {r.k: r.f for r in plain.transform(trials, "k").collect()}
    assert all(np.allclose(want[r.k], r.features.toArray()) for r in got.collect())
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    rows = lambda df: sorted((r.k, r.features.toArray().tolist(), r.prediction) for r in df.collect())
    assert rows(again.transform(trials)) == rows(got)
    assert again.stages[0].getOrDefault("windows") == [[0, 60], [30, None]] and again.stages[0].uid == model.stages[0].uid
    stage.save(str(tmp_path / "e"))
    assert stages.RiemannEstimator.load(str(tmp_path / "e")).getOrDefault("bank") == stage.getOrDefault("bank")


def test_features_by_trace_are_those_of_the_narrow_pass(trials):
    m = spd.RiemannFeatures(2, [(0, 50), (10, 120)], BANK, 1.0, "Riemann").fit(trials)
    by = {}
    for r in m.transform(trials, "k", trace=True).collect():
        by.setdefault(r.k, []).append((r.win, r.band, r.f))
    for r in m.transform(trials, "k").collect():
        assert np.allclose(r.f, np.concatenate([f for _, _, f in sorted(by[r.k])]))


@pytest.mark.parametrize("window", [(0, None), (20, 100)])
def test_integer_stage(spark, trials, tmp_path, window):
    stage = stages.FixedEstimator(channels=2, windows=[window], bank=BANK[:1], option="euclid")
    model = Pipeline(stages=[stage, LogisticRegression()]).fit(trials)
    got = model.transform(trials).collect()
    plain = FixedModel(2, BANK[:1], metric="euclid", window=window).fit(trials)
    want = {r.k: r.f for r in plain.real_features(plain.transform(trials, "k")).collect()}
    assert all(r.features.toArray().tolist() == want[r.k] for r in got)
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    rows = lambda rs: sorted((r.k, r.features.toArray().tolist(), r.prediction) for r in rs)
    assert rows(again.transform(trials).collect()) == rows(got)
    assert again.stages[0].fixed.window == window and again.stages[0].fixed.metric == "euclid"
