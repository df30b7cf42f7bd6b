"""Operators against NumPy, closed forms and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigflow.functions import quant as Q
from sigflow.functions import sym2
from sigflow.operators import classify, filters, linear, modes, search, spd
from sigflow.operators.blocks import pack
from sigflow.sources import reports
from sigflow.sources.tables import RECORDING, recording_trials
from sigflow.streaming.iir import stream_filter

RNG = np.random.default_rng(5)


def spd_set(n, count):
    x = RNG.normal(size=(count, n, 3 * n))
    return x @ np.swapaxes(x, 1, 2) / (3 * n)


def as_frame(spark, mats, **more):
    return spark.createDataFrame([(i, m.ravel().tolist(), *(v[i] for v in more.values())) for i, m in enumerate(mats)], ["id", "m", *more])


@pytest.mark.parametrize("x,r1,r2,r3", [(0.5, 1, 0, 0), (1.5, 2, 1, 2), (2.5, 3, 2, 2), (-0.5, -1, 0, 0), (-2.5, -3, -2, -2), (500.0, 127, 127, 127), (-500.0, -128, -128, -128)])
def test_rounding_rules(spark, x, r1, r2, r3):
    c = F.lit(x)
    got = spark.range(1).select(Q.round_away(c, 128, 8), Q.truncate(c, 128, 8), Q.half_even(c, 128, 8)).first()
    assert tuple(got) == (r1, r2, r3)


def test_shifts(spark):
    got = spark.createDataFrame([(-5,), (-4,), (5,), (6,)], "x long").select(Q.shift_round(F.col("x"), 2), Q.shift_floor(F.col("x"), 2)).collect()
    assert [tuple(r) for r in got] == [(-1, -2), (-1, -1), (1, 1), (2, 1)]


def test_width_is_checked(spark):
    with pytest.raises(Exception, match="outside its width"):
        spark.range(1).select(Q.dequantize(F.lit(200), 1.0, 8)).collect()


def test_band_counts():
    assert [len(filters.bands(w)) for w in ([2], [2, 4, 8, 16, 32], [1])] == [18, 43, 36]


@pytest.mark.parametrize("order", [2, 4])
def test_butterworth_response(order):
    lo, hi = 8 / 125, 12 / 125
    sos = filters.butter_band(order, lo, hi)
    assert sos.shape == (order, 6)

    def gain(f):
        z = np.exp(-1j * np.pi * f)
        return np.prod([abs((b0 + b1 * z + b2 * z * z) / (a0 + a1 * z + a2 * z * z)) for b0, b1, b2, a0, a1, a2 in sos])

    assert gain(lo) == pytest.approx(2**-0.5, abs=1e-9) and gain(hi) == pytest.approx(2**-0.5, abs=1e-9)
    centre = 2 / np.pi * np.arctan(np.sqrt(np.tan(np.pi * lo / 2) * np.tan(np.pi * hi / 2)))
    assert gain(centre) == pytest.approx(1, abs=1e-9) and gain(0.9) < 1e-2
    assert all(np.abs(np.roots(s[3:])).max() < 1 for s in sos)


def test_integer_filter_follows_float():
    sos = filters.butter_band(2, *filters.bands([4])[2])
    x = (40 * np.sin(np.arange(400) * 2 * np.pi * 14 / 250)).round().astype(np.int64)[None, :]
    q = filters.quantize_sos(sos, 1.0, 1.0)
    got = filters.sos_int(x, q) * np.exp2(float(q["y_shift"]))
    assert np.abs(got - filters.sos_float(x.astype(float), sos)).max() < 2


def test_fir_is_centred():
    x = RNG.normal(size=(3, 50))
    h = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    assert np.allclose(filters.fir_same(x, h), [np.convolve(r, h, "same") for r in x])


def test_filter_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [4, 5, 6])], "id long, x array<bigint>")
    q = {"b": [[1, 0, 0]], "a": [[1, 0, 0]], "a_shift": [0], "b_shift": [0]}
    assert {r.id: r.y for r in filters.apply_filter(df, "x", "sos_int", q).collect()} == {1: None, 2: [], 3: [4, 5, 6]}


def test_overflow_is_an_error():
    q = {"b": [[1000, 0, 0]], "a": [[1, 0, 0]], "a_shift": [0], "b_shift": [0]}
    with pytest.raises(OverflowError):
        filters.sos_int(np.array([[1000]]), q)


def test_logm_closed_form_equals_eigh(spark):
    m = spd_set(2, 20)
    df = spark.createDataFrame([(i, *map(float, (x[0, 0], x[0, 1], x[1, 1]))) for i, x in enumerate(m)], "id int, a double, b double, c double")
    got = {r[0]: r[1:] for r in df.select("id", *sym2.logm(F.col("a"), F.col("b"), F.col("c"))).collect()}
    want = spd.logm(m)
    assert all(np.allclose(got[i], (w[0, 0], w[0, 1], w[1, 1])) for i, w in enumerate(want))


def test_tridiagonal():
    m = spd_set(7, 1)[0]
    t, q = spd.tridiagonal(m)
    assert np.allclose(q @ t @ q.T, m) and np.allclose(q @ q.T, np.eye(7)) and np.allclose(np.triu(t, 2), 0)


def test_half_vector_order():
    m = np.arange(9.0).reshape(3, 3)
    m = m + m.T
    assert np.allclose(spd.half_vector(m), [0, 8, 16, 4 * 2**0.5, 8 * 2**0.5, 12 * 2**0.5])


def test_karcher_mean_invariants(spark):
    m = spd_set(4, 30)
    mean = spd.mean_riemann(as_frame(spark, m), [], "m", 4)[()]
    inv = spd.invsqrtm(mean)
    assert np.linalg.norm(spd.logm(inv @ m @ inv).mean(0)) < 1e-7
    g = RNG.normal(size=(4, 4))
    moved = spd.mean_riemann(as_frame(spark, g @ m @ g.T), [], "m", 4)[()]
    assert np.allclose(moved, g @ mean @ g.T)


def test_whitening_with_the_euclidean_mean_gives_identity(spark):
    m = spd_set(3, 40)
    r = spd.invsqrtm(spd.mean_euclid(as_frame(spark, m), [], "m", 3)[()])
    assert np.allclose((r @ m @ r).mean(0), np.eye(3))


def test_features_fit_leaves_the_estimator_alone(spark):
    x = RNG.normal(size=(12, 2 * 40))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    est = spd.RiemannFeatures(2, [(0, 20), (20, 40)], [None], 1.0)
    model = est.fit(df)
    assert est.references is None and sorted(model.references) == [0]
    got = model.transform(df, "id").collect()
    assert len(got) == 12 and all(len(r.f) == 6 for r in got)
    with pytest.raises(ValueError):
        spd.RiemannFeatures(2, [], [], option="other")


def test_csp_separates_classes():
    a, b = np.diag([9.0, 1.0, 1.0]), np.diag([1.0, 1.0, 9.0])
    w = spd.spatial_filters(a, b, 1)
    ratio = np.diag(w.T @ a @ w) / np.diag(w.T @ b @ w)
    assert ratio.min() == pytest.approx(1 / 9) and ratio.max() == pytest.approx(9)


def test_recordings(spark):
    run = (1, "train", [[float(10 * t + c) for c in range(25)] for t in range(40)], [0, 10, 20], [1, 2, 3], [0, 1, 0])
    got = recording_trials(spark.createDataFrame([run], RECORDING), samples=5).collect()
    assert len(got) == 2 * 22 and {r.label for r in got} == {1, 3}
    assert next(r.x for r in got if r.label == 3 and r.channel == 2) == [202.0, 212.0, 222.0, 232.0, 242.0]


def test_report_lines(spark):
    lines = [("## a: cycles: 200",), ("noise",), ("## a: instructions: 100",), ("## b: result: OK",)]
    got = {(r["case"], r["key"]): r["value"] for r in reports.parse_report(spark.createDataFrame(lines, "value string")).collect()}
    assert got == {("a", "cycles"): "200", ("a", "instructions"): "100", ("a", "ipc"): "0.5", ("b", "result"): "OK"}


def test_feature_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", [1.0]), (2, "test", [2.0])], "subject int, split string, f array<double>")
    reports.write_features(df, str(tmp_path / "f"))
    assert [r.f for r in reports.read_features(spark, str(tmp_path / "f"), 2).collect()] == [[2.0]]
    for form in ("json", "csv"):
        reports.write_table(df.select("subject"), str(tmp_path / form), form)


def test_search_reports(spark):
    runs = spark.createDataFrame([(1, "a", 1, 0.5, 10), (1, "a", 2, 0.7, 90), (2, "a", 1, 0.6, 10), (2, "a", 2, 0.5, 90)], "subject int, mode string, run int, accuracy double, n_params long")
    assert search.best_shared(runs).first().run == 2
    assert {r.subject: r.run for r in search.best_per_subject(runs).collect()} == {1: 2, 2: 1}
    curve = {r.budget: r.mean_best for r in search.budget_curve(runs, spark.createDataFrame([(5,), (50,), (100,)], "budget long")).collect()}
    assert curve == pytest.approx({5: 0.0, 50: 0.55, 100: 0.65})
    assert search.random_runs(runs, 2, 1).count() == 2


def test_classifiers_learn(spark):
    x = np.concatenate([RNG.normal(-2, 0.5, (40, 2)), RNG.normal(2, 0.5, (40, 2))])
    df = classify.with_vector(spark.createDataFrame([(i, float(i >= 40), r.tolist()) for i, r in enumerate(x)], "id long, label double, f array<double>"))
    for p in (classify.linear_svm(1.0, 80), classify.linear_svm(1.0, 80, scaled=True), classify.tree(), classify.mlp([2, 4, 2])):
        model, out = classify.fit_predict(p, df, df, "id")
        assert classify.accuracy(out).first().accuracy > 0.95
        assert classify.parameter_count(model) != 0


def test_stream_equals_batch(spark, tmp_path):
    q = {"b": [[512, 0, -512]], "a": [[1024, -1500, 700]], "b_shift": [12], "a_shift": [10]}
    x = RNG.integers(-100, 100, (3, 40))
    rows = [(u, k, int(x[u, k])) for k in range(40) for u in range(3)]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], "user_id long, k long, x long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, k long, x long").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    run = stream_filter(stream, q).writeStream.format("memory").queryName("iir").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.user_id, r.k): r.y for r in spark.table("iir").collect()}
    want = filters.sos_int(x, q)
    assert all(got[u, k] == want[u, k] for u in range(3) for k in range(40))


def _fixed_model():
    from sigflow.operators.fixedpoint import FixedModel

    q = {"a": np.array([[1024, -1200, 500]]), "b": np.array([[500, 0, -500]]), "a_shift": np.array([10]), "b_shift": np.array([11]), "y_shift": 1, "y_scale": 1.0}
    return FixedModel(2, [None], 0.5, input_scale=1.0, filters=[q], cov_scale=[8.0], ref_scale=[4.0], refs=[np.array([[70, 3], [3, 50]])], log_scale=4.0, feature_scale=8.0).with_classifier(np.array([[0.5, -1.0, 0.25], [1.0, 0.5, -0.75], [0.1, 0.2, 0.3], [-0.4, 0.0, 0.9]]), np.array([0.1, -0.2, 0.0, 0.3]))


def test_integer_stages_by_hand(spark):
    import math

    model = _fixed_model()
    x = np.random.default_rng(3).normal(0, 0.4, (5, 2, 12))
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "k long, x array<double>")
    got = {r.k: r for r in model.scores(model.transform(df, "k", trace=True)).collect()}
    clip = lambda v, n: max(-(1 << (n - 1)), min((1 << (n - 1)) - 1, v))
    for k, trial in enumerate(x):
        q = [[int(clip(v * 128 + math.copysign(0.5, v), 8)) if v else 0 for v in ch] for ch in trial]
        assert got[k].stages["input"] == sum(q, [])
        y = []
        for ch in q:
            past, out = [0, 0], [0, 0]
            for t, v in enumerate(ch):
                acc = ((500 * v - 500 * past[t] + 0) + 1 >> 1) + 1200 * out[-1] - 500 * out[-2]
                out.append(acc + 512 >> 10)
                past.append(v)
            y.append([v << 1 for v in out[2:]])
        assert got[k].stages["filtered_0"] == sum(y, [])
        rho = round(0.5 / (1.0 * (1 << 31) / 16384) * (1 << 31))
        m = [[sum(a * b for a, b in zip(y[i], y[j])) + rho * (i == j) for j in (0, 1)] for i in (0, 1)]
        m = [[v + 2 >> 2 for v in row] for row in m]
        assert got[k].stages["cov_0"] == sum(m, [])
        r = [[70, 3], [3, 50]]
        mul = lambda a, b: [[sum(a[i][z] * b[z][j] for z in (0, 1)) for j in (0, 1)] for i in (0, 1)]
        w = mul(mul(r, m), r)
        assert got[k].stages["white_0"] == sum(w, [])
        log = spd.logm(np.array(w) * (8.0 / 32768 * (4.0 / 1024) ** 2), 1e-3)
        log = [[round(clip(v / 4.0 * 128, 8)) for v in row] for row in log.tolist()]
        assert got[k].stages["log_0"] == sum(log, [])
        f = [log[0][0] + 1 >> 1, log[1][1] + 1 >> 1, 91 * log[1][0] + 64 >> 7]
        assert got[k].f == f
        weights = [[int(clip(v * 128 + math.copysign(0.5, v), 8)) if v else 0 for v in row] for row in ([0.5, -1.0, 0.25], [1.0, 0.5, -0.75], [0.1, 0.2, 0.3], [-0.4, 0.0, 0.9])]
        bias = [round(v / 8.0 * 16384) for v in (0.1, -0.2, 0.0, 0.3)]
        scores = [sum(a * b for a, b in zip(row, f)) + c for row, c in zip(weights, bias)]
        assert got[k].scores == scores and got[k].prediction == scores.index(max(scores))


def test_integer_model_survives_a_file(spark, tmp_path):
    from sigflow.operators.fixedpoint import FixedModel

    model = _fixed_model()
    reports.write_table(model.parameters(spark), str(tmp_path / "m"))
    again = FixedModel.from_row(reports.load_model(spark, str(tmp_path / "m")).first())
    df = spark.createDataFrame([(1, np.linspace(-0.5, 0.5, 24).tolist())], "k long, x array<double>")
    assert model.scores(model.transform(df, "k")).collect() == again.scores(again.transform(df, "k")).collect()
    model.parameters(spark).withColumn("svm_bias", F.slice("svm_bias", 1, 2)).write.parquet(str(tmp_path / "bad"))
    for read in (lambda df: df.collect(), lambda df: df.select("log_scale").collect(), lambda df: df.count()):
        with pytest.raises(Exception, match="4 classes expected"):
            read(reports.load_model(spark, str(tmp_path / "bad")))


@pytest.mark.parametrize("window,metric,more,rules", [((2, 8), "euclid", (), "golden"), ((3, None), "riemann", ((0, 6),), "trainer")])
def test_a_windowed_model_comes_back_whole(spark, tmp_path, window, metric, more, rules):
    from dataclasses import fields, replace

    from sigflow.operators.fixedpoint import FixedModel

    model = replace(_fixed_model(), window=window, metric=metric, more_windows=more, rules=rules)
    reports.write_table(model.parameters(spark), str(tmp_path / "m"))
    again = FixedModel.from_row(reports.load_model(spark, str(tmp_path / "m")).first(), model.bank)
    for f in fields(model):
        assert repr(getattr(model, f.name)) == repr(getattr(again, f.name)), f.name
    df = spark.createDataFrame([(k, np.random.default_rng(k).uniform(-0.5, 0.5, 24).tolist()) for k in range(10)], "k long, x array<double>")
    assert model.transform(df, "k").collect() == again.transform(df, "k").collect()


def _quantised(x, scale, bits):
    """R1 and back, as real numbers."""
    top = 2.0 ** (bits - 1)
    y = x / scale * top
    return np.trunc(np.clip(y + np.sign(y) * 0.5, -top, top - 1)) / top * scale


def test_trainer_rules_are_those_of_real_numbers(spark):
    """Stage by stage in floating point, quantised after each, over two windows; the model learns its scales first."""
    from sigflow.operators.fixedpoint import FixedModel

    rng = np.random.default_rng(21)
    x = rng.normal(0, 1, (30, 2, 60)).cumsum(2) * 0.1
    df = spark.createDataFrame([(k, v.ravel().tolist()) for k, v in enumerate(x)], "k long, x array<double>")
    bank = [filters.butter_band(2, 0.1, 0.5), filters.butter_band(2, 0.2, 0.4)]
    model = FixedModel(2, bank, 0.3, "euclid", (0, 40), rules="trainer", more_windows=((20, 60),)).fit(df)
    got = {r.k: np.array(r.f) for r in model.transform(df, "k").collect()}
    means = {}
    for b in range(2):
        unit = model.filters[b]["y_scale"] / 128
        rho = np.trunc(0.3 / unit**2 + 0.5) * unit**2
        covs = []
        for lo, hi in ((0, 40), (20, 60)):
            q = np.rint(_quantised(x[:, :, lo:hi], model.input_scale, 8) / model.input_scale * 128).astype(np.int64)
            y = filters.sos_int(q.reshape(-1, hi - lo), model.filters[b]).reshape(q.shape)
            y = y << model.filters[b]["y_shift"] if model.filters[b]["y_shift"] >= 0 else y >> -model.filters[b]["y_shift"]
            y = _quantised(y * unit, model.filters[b]["y_scale"], 8)
            covs.append(y @ np.swapaxes(y, 1, 2) + rho * np.eye(2))
        means[b] = np.concatenate(covs).mean(0)
        ref = _quantised(spd.invsqrtm(means[b]), model.ref_scale[b], 11)
        assert np.allclose(ref, model.refs[b] / 1024 * model.ref_scale[b], atol=1e-12)
        for w, cov in enumerate(covs):
            m = _quantised(cov, model.cov_scale[b], 16)
            log = _quantised(spd.logm(ref @ m @ ref, 1e-3), model.log_scale, 8)
            half = np.stack([log[:, 0, 0], log[:, 1, 1], 91 / 64 * log[:, 0, 1]], 1)
            want = np.rint(_quantised(half, model.feature_scale, 8) / model.feature_scale * 128)
            at = 3 * (2 * w + b)
            off = np.abs(np.array([got[k][at : at + 3] for k in range(30)]) - want)
            assert off.max() <= 1 and (off > 0).mean() < 0.01  # ties of R1 in the last bit
    with pytest.raises(ValueError, match="unknown rules"):
        FixedModel(2, bank, rules="other")


def test_scores_as_real_numbers(spark):
    model = _fixed_model()
    df = spark.createDataFrame([(k, np.random.default_rng(k).uniform(-0.5, 0.5, 24).tolist()) for k in range(8)], "k long, x array<double>")
    for r in model.apply(df, "k").collect():
        f = np.array(r.f) / 128 * model.feature_scale
        w, b = model.weights / 128 * model.weight_scale, model.bias / 2.0**31 * model.output_scale
        assert np.allclose(r.real, w @ f + b) and r.prediction == int(np.argmax(r.scores))


def test_integer_model_learns_classes(spark):
    from sigflow.operators.fixedpoint import FixedModel

    rng = np.random.default_rng(5)
    rows = []
    for k in range(80):
        mix = [[3.0, 0.0], [0.0, 1.0]] if k % 2 else [[1.0, 0.0], [2.5, 1.0]]
        rows.append((k, float(k % 2), (np.array(mix) @ rng.normal(0, 1, (2, 200))).ravel().tolist()))
    df = spark.createDataFrame(rows, "k long, label double, x array<double>")
    model = FixedModel(2, [filters.butter_band(2, 0.1, 0.5)], metric="euclid").fit(df)
    f = model.real_features(model.transform(df, "k")).join(df.select("k", "label"), "k")
    packed = pack(f, "k", "f", "label")
    learned = linear.LinearSvm().solve(packed).weights[0][0]
    w, b = learned[:, :-1], learned[:, -1]
    got = model.with_classifier(w, b).scores(model.transform(df, "k")).collect()
    assert np.mean([r.prediction == r.k % 2 for r in got]) > 0.95


@pytest.mark.parametrize("form", [1, 2])
def test_shifted_apart_cascade(form):
    q = {"a": [[1024, -1500, 700], [2048, -1800, 1000]], "b": [[512, 3, -512], [900, 1800, 900]], "b_shift": [12, 13], "a_shift": [10, 11]}
    x = np.random.default_rng(1).integers(-128, 128, (3, 60))
    got = filters.sos_int_floor(x, q, form=form)
    for r, v in enumerate(x.tolist()):
        for m in range(2):
            (b0, b1, b2), (_, a1, a2), sb, sa = q["b"][m], q["a"][m], q["b_shift"][m], q["a_shift"][m]
            if form == 1:
                out = [0, 0]
                past = [0, 0, *v]
                for t in range(len(v)):
                    out.append(min((b0 * past[t + 2] + b1 * past[t + 1] + b2 * past[t] >> sb) - (a1 * out[-1] + a2 * out[-2] >> sa), 1 << 15))
                v = out[2:]
            else:
                w = [0, 0]
                for s in v:
                    w.append(min(s - (a1 * w[-1] + a2 * w[-2] >> sa), 1 << 15))
                v = [b0 * w[t] + b1 * w[t - 1] + b2 * w[t - 2] >> sb for t in range(2, len(w))]
        assert got[r].tolist() == v


def test_eigenvalues_of_a_batch():
    """Matrices of very different kinds side by side: full, diagonal, zero, with blocks and with equal eigenvalues."""
    rng = np.random.default_rng(31)
    for n in (1, 2, 3, 5, 8, 22):
        a = rng.normal(size=(40, n, n))
        a = a @ np.swapaxes(a, 1, 2)
        a[1], a[2], a[3] = np.diag(np.arange(n)), 0, np.eye(n)
        half = n // 2
        a[4:9, :half, half:] = a[4:9, half:, :half] = 0
        a[9] = np.ones((n, n))
        a[10:20] *= np.exp(rng.normal(0, 8, 10))[:, None, None]
        t, q = spd.tridiagonal(a)
        scale = np.abs(a).max((1, 2), keepdims=True) + 1e-300
        assert np.abs((q @ t @ np.swapaxes(q, 1, 2) - a) / scale).max() < 1e-12
        i, j = np.indices((n, n))
        assert np.abs((t / scale)[:, abs(i - j) > 1]).max(initial=0) < 1e-12
        w, v = spd.eigen(a)
        assert np.abs((v * w[:, None, :] @ np.swapaxes(v, 1, 2) - a) / scale).max() < 1e-11
        assert np.abs(np.swapaxes(v, 1, 2) @ v - np.eye(n)).max() < 1e-11
        assert np.abs((w - np.linalg.eigvalsh(a)) / scale[:, :, 0]).max() < 1e-11
    assert spd.eigen(np.zeros((0, 4, 4)))[0].shape == (0, 4)


def test_bits_search_on_signals(spark):
    """Summed over tasks as one after the other; fewer bits are worse, and a setting that overflows is left out."""
    rng = np.random.default_rng(17)
    x = [np.sin(np.arange(n) * 0.4).cumsum() * 0.2 + rng.normal(0, 0.1, n) for n in (30, 80, 80, 55)]
    x = [v / np.abs(v).max() for v in x]
    bank = list(filters.filter_bank([16], order=2))[:2]
    df = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "x array<double>").repartition(3)
    got = {r.bits: r for r in filters.bits_search(df, "x", bank, [6, 10, 14], [0]).collect()}
    for bits, r in got.items():
        want = sum(filters.signal_errors(v[None], sos, bits, 0)[0] for v in x for sos in bank)
        assert np.allclose([r.l1, r.l2, r.log], want)
    order = sorted(got.values(), key=lambda r: r.l1)
    assert [r.rank_l1 for r in order] == list(range(1, len(order) + 1)) and [r.best for r in order] == [True] + [False] * (len(order) - 1)
    assert got[14].l1 < got[6].l1
    with pytest.MonkeyPatch.context() as m:
        m.setattr(filters, "sos_int", lambda *a: (_ for _ in ()).throw(OverflowError()))
        assert np.isnan(filters.signal_errors(x[0][None], bank[0], 10, 0)).all()


def test_bits_of_many_signals_at_once(spark, monkeypatch):
    """Signals of all lengths side by side, each by its own scale, some of them overflowing: as each by itself. Signals are not filtered one by one."""
    rng = np.random.default_rng(23)
    sizes = [0, 1, 2, 3, 40, 41, 64, 65, 200]
    bank = list(filters.filter_bank([16], order=2))[:2]
    settings = [(6, 0), (8, 0), (10, 1), (12, 0), (14, 0), (24, 0)]
    x = [rng.normal(0, 10.0 ** rng.integers(-3, 1), n).clip(-1, 1) for n in sizes]
    flat = np.zeros((len(x), max(sizes)))
    for row, v in zip(flat, x):
        row[: len(v)] = v
    loud = [np.array([[3.0, 0, 0, 1, -1.9, 0.99], [2.0, 1, 1, 1, -1.9, 0.99]])]
    for sos in [*bank, *loud]:
        got = filters.errors_of_settings(flat, np.array(sizes), sos, settings)
        want = np.stack([np.concatenate([filters.signal_errors(v[None], sos, *s) for v in x]) for s in settings])
        assert np.allclose(got, want, rtol=1e-12, atol=1e-12, equal_nan=True)
    assert np.isnan(want).any() and not np.isnan(want).all()
    df = spark.createDataFrame([(v.tolist(),) for v in x] * 2, "x array<double>").repartition(2)
    monkeypatch.setattr(filters, "CELLS", 500)
    monkeypatch.setattr(filters, "signal_errors", None)
    rows = {(r.bits, r.reserve): r for r in filters.bits_search(df, "x", bank, [8, 12], [0, 1]).collect()}
    for s, r in rows.items():
        want = 2 * sum(filters.errors_of_settings(flat, np.array(sizes), sos, [s])[0].sum(0) for sos in bank)
        assert np.allclose([r.l1, r.l2, r.log], want)
    with pytest.raises(Exception, match="no number"):
        filters.bits_search(spark.createDataFrame([([0.5, None],)], "x array<double>"), "x", bank, [8], [0]).collect()


def test_designs_of_a_table_are_those_of_the_driver(spark):
    df = filters.bands_of(spark.createDataFrame([(w,) for w in (0, 1, 2, 3, 8, 36, 37)], "w int"), "w")
    rows = filters.design(df, 2, True).collect()
    assert sorted((r.w, r.band, r.lo, r.hi) for r in rows) == sorted((w, k, lo, hi) for w in (1, 2, 3, 8, 36) for k, (lo, hi) in enumerate(filters.bands([w])))
    for r in rows:
        sos = filters.butter_band(2, r.lo, r.hi)
        q = filters.quantize_sos(sos, 1.0, 1.0)
        assert np.allclose(r.sos, sos) and r.a == q["a"].tolist() and r.b_shift == q["b_shift"].tolist() and r.y_shift == q["y_shift"]


def test_section_pairing_and_pass_through():
    sos = filters.butter_band(2, *filters.bands([4])[2])
    assert np.allclose(sos[0, 1:3] / sos[0, 0], [2, 1]) and np.allclose(sos[1, :3], [1, -2, 1]) or np.allclose(sos[0, 1:3] / sos[0, 0], [-2, 1]) and np.allclose(sos[1, :3], [1, 2, 1])
    assert abs(np.roots(sos[1, 3:])).max() >= abs(np.roots(sos[0, 3:])).max() - 1e-12
    q = filters.with_pass_through(filters.quantize_sos(sos, 1.0, 1.0))
    assert q["a"].shape == (3, 3) and q["b"][0].tolist() == [2048] * 3 and q["a_shift"][0] == 11


def test_eigenvalues_by_rotations(spark):
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 22):
        a = rng.normal(size=(n, n))
        a = a @ a.T
        w, q = spd.tridiagonal_eigen(*spd.tridiagonal(a))
        assert np.allclose(q * w @ q.T, a) and np.allclose(np.sort(w), np.linalg.eigvalsh(a))
    df = spark.createDataFrame([((m @ m.T).ravel().tolist(),) for m in rng.normal(size=(20, 6, 6))], "m array<double>")
    loose, tight = (spd.epsilon_for_accuracy(df, "m", 6, acc) for acc in (1e-2, 1e-9))
    assert tight < loose <= 0.1


def test_search_of_runs_and_its_report(spark, tmp_path):
    grid = search.grid(spark, c=[0.1, 1.0, 10.0])
    runs = search.chosen_runs(grid, 5)
    assert sorted((r.run, r.skipped) for r in runs.collect()) == [(0, False), (1, False), (2, False), (3, True), (4, True)]
    assert search.chosen_runs(grid, 2).count() == 2
    feats = spark.createDataFrame([(s, k % 3, k % 2, [float(k % 2), float(s)]) for s in (0, 1) for k in range(30)], "subject int, fold int, label int, f array<double>")
    report = search.search_report(modes.subject_runs(feats, runs.where("not skipped")), runs)
    got = {(r.subject, r.run): (r.accuracy, r.description) for r in report.collect()}
    assert len(got) == 10 and got[0, 1][0] == 1.0 and got[1, 4] == (0.0, "skipped run")
    reports.write_table(report, str(tmp_path / "r"), "json")
    assert reports.read_table(spark, str(tmp_path / "r"), "subject int, run int, accuracy double", "json").count() == 10
    line = reports.report_lines(report.where("subject = 0 and run = 4"), "run", "accuracy").first().value
    assert line == "run: 4, accuracy: 0.0"


def test_a_null_or_ragged_signal_says_so(spark):
    for x in (None, [1.0, 2.0]):
        df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0]), (2, x)], "k long, x array<double>").coalesce(1)
        with pytest.raises(Exception, match="signal"):
            spd.covariance(df, "x", 2).collect()
