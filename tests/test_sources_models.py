from pyspark.sql import functions as F

from textaudit.operators import metrics as M
from textaudit.operators import models as MD
from textaudit.sources import files as FS
from textaudit.sources import sinks as SK


def test_split_sink_roundtrip(spark, tmp_path):
    tr = spark.createDataFrame([(1, "a", 0, "x")], "doc_id LONG, text STRING, label INT, extra STRING")
    va = spark.createDataFrame([(2, "b", 1, "y")], "doc_id LONG, text STRING, label INT, extra STRING")
    te = spark.createDataFrame([(3, "c", 1, "z")], "doc_id LONG, text STRING, label INT, extra STRING")
    path = str(tmp_path / "splits")
    SK.write_splits(tr, va, te, path)
    parts = FS.read_splits_partitioned(spark, path)
    assert parts["train"].select("text", "label").collect()[0]["text"] == "a"
    assert parts["test"].where(F.col("extra") == "z").count() == 1
    assert parts["train"].where(F.col("extra").isNotNull()).count() == 0


def test_read_splits_names_missing(spark, tmp_path):
    (tmp_path / "train.csv").write_text("text,label\na,1\n")
    try:
        FS.read_splits(spark, str(tmp_path))
        raise AssertionError("expected an error")
    except FileNotFoundError as e:
        assert "val.csv" in str(e) and "test.csv" in str(e)


def test_prediction_registry_skips_failures(spark):
    ok = lambda: spark.createDataFrame([(1, 1, 1, .9)], "doc_id LONG, y_true INT, y_pred INT, proba DOUBLE")
    bad = lambda: spark.read.parquet("/nonexistent/preds.parquet")
    seen = []
    reg = MD.prediction_registry({"good": ok, "broken": bad}, on_error=lambda n, e: seen.append(n))
    assert seen == ["broken"] and [r["model"] for r in reg.collect()] == ["good"]


def test_python_scorer_batches(spark):
    docs = spark.createDataFrame([(1, "a bb"), (2, "")], "doc_id LONG, text STRING")
    out = MD.python_scorer(docs, lambda texts: [len(t) / 10 for t in texts])
    assert {r["doc_id"]: r["proba"] for r in out.collect()} == {1: 0.4, 2: 0.0}


def test_pipeline_fit_save_load(spark, tmp_path):
    rows = [(i, ("good fine nice " if i % 2 else "bad awful poor ") * 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, label INT")
    model = MD.train_logreg(df, max_iter=20)
    path = str(tmp_path / "lr")
    MD.save_model(model, path)
    again = MD.load_pipeline(path)
    preds = MD.apply_classifier(again, df, model_name="lr")
    assert M.binary_metrics(preds).first()["accuracy"] == 1.0
