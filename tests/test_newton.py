"""Newton fits against dense solvers on small sets."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from textaudit.operators import models as MD
from textaudit.operators import newton as NW


def dense_fit(x, y, c, loss, ridge):
    """Damped Newton on the whole matrix, plainly."""
    x1, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)

    def at(w):
        value, slope, curve = NW.LOSSES[loss](y, x1 @ w)
        return c @ value + ridge @ (w * w) / 2, x1.T @ (c * slope) + ridge * w, x1.T @ (x1 * (c * curve)[:, None]) + np.diag(ridge + 1e-12)

    for _ in range(200):
        v, g, h = at(w)
        d, t = np.linalg.solve(h, -g), 1.0
        while at(w + t * d)[0] > v + 1e-4 * t * (g @ d) and t > 1e-12:
            t /= 2
        w = w + t * d
    return w


def data(n, k, seed, sparse=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k))
    if sparse:
        x *= rng.random((n, k)) < 0.1
    y = np.where(x @ rng.normal(size=k) + rng.normal(size=n) > 0.3, 1.0, -1.0)
    return x, y, rng.random(n) + 0.5


def frame(spark, x, y, c, sparse=False):
    vec = lambda r: Vectors.sparse(len(r), {int(i): float(r[i]) for i in np.flatnonzero(r)}) if sparse else Vectors.dense(r)
    rows = [(i, int(t > 0), float(u), vec(r)) for i, (r, t, u) in enumerate(zip(x, y, c))]
    return spark.createDataFrame(rows, ["doc_id", "label", "weight", "features"]).repartition(3)


@pytest.mark.parametrize("loss,regularised", [("logistic", False), ("squared_hinge", True)])
@pytest.mark.parametrize("gram", [True, False])
def test_equals_a_dense_solver(spark, loss, regularised, gram):
    x, y, c = data(300, 6, 1)
    fit = NW.fit_linear(frame(spark, x, y, c), loss, weight="weight", key="doc_id", regularise_intercept=regularised, tol=1e-9, gram_most=256 if gram else 0)
    want = dense_fit(x, y, c, loss, np.r_[np.ones(6), float(regularised)])
    assert np.allclose(np.r_[fit.coefficients, fit.intercept], want, atol=1e-5) and fit.passes <= 25


def test_sparse_rows_and_a_sampled_curvature(spark, monkeypatch):
    monkeypatch.setattr(NW, "SAMPLE_ROWS", 250)
    x, y, c = data(900, 40, 2, sparse=True)
    x[5] = 0  # a row without any feature
    fit = NW.fit_linear(frame(spark, x, y, c, sparse=True), "logistic", weight="weight", key="doc_id", tol=1e-7, gram_most=0)
    assert np.allclose(np.r_[fit.coefficients, fit.intercept], dense_fit(x, y, c, "logistic", np.r_[np.ones(40), 0.0]), atol=1e-5)
    assert fit.passes <= 30


def test_mixed_rows_nulls_and_no_rows(spark):
    rows = [(0, 1, Vectors.dense([1.0, 0.0])), (1, 0, Vectors.sparse(2, {1: 2.0})), (2, None, Vectors.dense([9.0, 9.0])), (3, 1, None), (4, 0, Vectors.sparse(2, {}))]
    df = spark.createDataFrame(rows, ["doc_id", "label", "features"])
    fit = NW.fit_linear(df, "squared_hinge", regularise_intercept=True, tol=1e-10)
    want = dense_fit(np.array([[1.0, 0], [0, 2], [0, 0]]), np.array([1.0, -1, -1]), np.ones(3), "squared_hinge", np.ones(3))
    assert np.allclose(np.r_[fit.coefficients, fit.intercept], want, atol=1e-6)
    assert NW.fit_linear(df.where("doc_id > 9"), "logistic").passes == 0


def test_spark_models_of_fits(spark, tmp_path):
    x, y, c = data(200, 4, 3)
    model = MD.train_svm(frame(spark, x, y, c).drop("weight"))
    balanced = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())).round(6)
    want = dense_fit(x, y, balanced, "squared_hinge", np.ones(5))
    assert np.allclose(np.r_[model.coefficients.toArray(), model.intercept], want, atol=1e-4)
    MD.save_model(model, str(tmp_path / "svm"))
    from pyspark.ml.classification import LinearSVCModel

    again = LinearSVCModel.load(str(tmp_path / "svm"))
    got = MD.apply_classifier(again, frame(spark, x, y, c)).orderBy("doc_id").collect()
    assert np.allclose([r["proba"] for r in got], 1 / (1 + np.exp(-(x @ want[:-1] + want[-1]))), atol=1e-4)


def test_runs_fitted_together_equal_separate_fits(spark):
    from pyspark.sql import functions as F

    x, y, c = data(400, 5, 7)
    df = frame(spark, x, y, c).withColumn("held", F.col("doc_id") % 4 == 0)
    table, fits = NW.fit_runs(df, "held", [0.01, 1.0, 30.0], weight="weight", tol=1e-9, patience=99)
    own = np.arange(400) % 4 != 0
    rows = table.collect()
    for i, k in enumerate([0.01, 1.0, 30.0]):
        want = dense_fit(x[own], y[own], k * c[own], "squared_hinge", np.ones(6))
        assert np.allclose(np.r_[fits[k].coefficients, fits[k].intercept], want, atol=1e-5)
        last = max((r for r in rows if r["run"] == i), key=lambda r: r["epoch"])
        yes, true = x[~own] @ want[:-1] + want[-1] >= 0, y[~own] > 0
        assert last["f1"] == pytest.approx(2 * (yes & true).sum() / (yes.sum() + true.sum()))
        epochs = sorted(r["epoch"] for r in rows if r["run"] == i)
        assert epochs == list(range(len(epochs))) and len(epochs) <= 25
    stopped, _ = NW.fit_runs(df, "held", [1.0], weight="weight", tol=0.0, patience=1)
    f1 = [r["f1"] for r in stopped.orderBy("epoch").collect()]
    assert f1[-1] <= max(f1[:-1]) and all(b > max(f1[:i + 1]) for i, b in enumerate(f1[1:-1]))
