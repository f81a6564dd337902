import math

from pyspark.sql import functions as F

from textaudit.operators import compare as C
from textaudit.operators import metrics as M


def preds(spark, y, p, proba=None, model="m"):
    proba = proba or [None] * len(y)
    rows = [(i, model, y[i], p[i], proba[i]) for i in range(len(y))]
    return spark.createDataFrame(rows, "doc_id LONG, model STRING, y_true INT, y_pred INT, proba DOUBLE")


def test_binary_metrics_fixture(spark):
    df = preds(spark, [0, 1, 1, 0], [0, 1, 0, 0], [.1, .9, .4, .2])
    r = M.binary_metrics(df).first()
    assert r["accuracy"] == 0.75 and r["precision"] == 1.0 and r["recall"] == 0.5
    assert abs(r["f1"] - 2 / 3) < 1e-6
    assert M.roc_auc(df).first()["roc_auc"] == 1.0


def test_zero_division_and_undefined_auc(spark):
    df = preds(spark, [0, 1, 1, 0], [0, 0, 0, 0], [.5, .5, .5, .5])
    r = M.binary_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.0, 0.0, 0.0)
    assert M.roc_auc(df).first()["roc_auc"] == 0.5
    one = preds(spark, [1, 1, 1], [1, 0, 1], [.2, .4, .9])
    assert M.roc_auc(one).first()["roc_auc"] is None


def test_auc_complement_and_report_properties(spark):
    y = [0, 1, 1, 0, 1, 0, 1, 1, 0, 0]
    pr = [.1, .8, .35, .4, .9, .2, .55, .35, .6, .05]
    p = [int(x >= .5) for x in pr]
    df = preds(spark, y, p, pr)
    a = M.roc_auc(df).first()["roc_auc"]
    inv = df.withColumn("proba", 1 - F.col("proba"))
    b = M.roc_auc(inv).first()["roc_auc"]
    assert abs(a + b - 1.0) < 1e-6
    av = M.averaged_metrics(df).first()
    assert abs(av["weighted_recall"] - av["accuracy"]) < 1e-9
    rep = {r["label"]: r for r in M.classification_report(df).collect()}
    assert set(rep) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert rep["accuracy"]["value"] == 0.7


def test_confusion_has_all_cells(spark):
    df = preds(spark, [1, 1], [1, 1])
    cells = {(r["y_true"], r["y_pred"]): r["n"] for r in M.confusion_matrix(df, labels=(0, 1)).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_curve_points_end_at_one(spark):
    df = preds(spark, [0, 1, 1, 0], [0, 1, 0, 0], [.1, .9, .4, .2])
    pts = sorted(M.curve_points(df).collect(), key=lambda r: -r["threshold"])
    assert pts[-1]["tpr"] == 1.0 and pts[-1]["fpr"] == 1.0
    assert pts[0]["precision"] == 1.0


def test_margin_buckets(spark):
    rows = [("a", "f1", 0.9), ("b", "f1", 0.895), ("a", "acc", 0.9), ("b", "acc", 0.88),
            ("a", "auc", 0.9), ("b", "auc", 0.85)]
    long = spark.createDataFrame(rows, "model STRING, metric STRING, value DOUBLE")
    got = {r["metric"]: r["bucket"] for r in C.margin_vs_second(long).collect()}
    assert got == {"f1": "tiny", "acc": "moderate", "auc": "large"}


def test_best_run_first_wins_tie(spark):
    runs = spark.createDataFrame([("m", 1, 0.3, 0.5), ("m", 2, 0.4, 0.7), ("m", 3, 0.5, 0.7)],
                                 "model STRING, epoch INT, threshold DOUBLE, f1 DOUBLE")
    r = C.best_run(runs).first()
    assert r["best_epoch"] == 2 and math.isclose(r["best_f1"], 0.7)


def test_logit_probabilities(spark):
    import math as m

    from textaudit.functions import numeric as N
    df = spark.createDataFrame([([0.0],), ([2.0],), ([1.0, 3.0],), ([1000.0, 1001.0],), ([],)], "l ARRAY<DOUBLE>")
    got = [r["p"] for r in df.select(N.positive_proba(F.col("l")).alias("p")).collect()]
    assert got[0] == 0.5 and abs(got[1] - 1 / (1 + m.exp(-2))) < 1e-12
    assert abs(got[2] - m.exp(3) / (m.exp(1) + m.exp(3))) < 1e-12
    assert abs(got[3] - 1 / (1 + m.exp(-1))) < 1e-12 and got[4] is None
    txt = spark.range(1).select(N.fixed_decimals(F.lit(0.12345), 3).alias("t")).first()["t"]
    assert txt == "0.123"
