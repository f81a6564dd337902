from pyspark.sql import functions as F

from textaudit.operators import features as FE
from textaudit.operators import schema as SC
from textaudit.operators import splits as SP
from textaudit.sources import files as FS


def test_csv_loader(spark, tmp_path):
    p = tmp_path / "train.csv"
    p.write_text('text,label\nalice is an engineer,0\n"bob is\na nurse",1\n')
    df = FS.read_with_required(spark, str(p))
    rows = df.select("text", SC.coerce_label("label").alias("label")).collect()
    assert [(r["text"], r["label"]) for r in rows] == [("alice is an engineer", 0), ("bob is\na nurse", 1)]


def test_required_columns_named(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("sentence,y\na,1\n")
    try:
        FS.read_with_required(spark, str(p))
        raise AssertionError("expected an error")
    except ValueError as e:
        assert "text" in str(e) and "label" in str(e)


def test_prediction_scan(spark, tmp_path):
    p = tmp_path / "preds.csv"
    p.write_text("id,flag,score\n1,1,0.9\n2,0,0.2\n")
    df = FS.read_predictions(spark, str(p), key="id")
    rows = sorted(df.collect())
    assert [(r["y_pred"], r["proba"]) for r in rows] == [(1, 0.9), (0, 0.2)]
    q = tmp_path / "preds2.csv"
    q.write_text("text,predicted_label\na,1\n")
    r = FS.read_predictions(spark, str(q)).first()
    assert r["y_pred"] == 1 and r["proba"] is None


def test_label_coercion(spark):
    df = spark.createDataFrame([("1",), ("0",), ("x",), (None,), ("0.7",)], "raw STRING")
    assert [r[0] for r in df.select(SC.coerce_label("raw")).collect()] == [1, 0, 0, 0, 0]
    assert SC.label_missing_count(df, "raw").first()["n_missing"] == 2


def test_column_resolution_orders():
    from textaudit import lexicons as L
    cols = ["text", "label", "label_binary"]
    assert SC.first_match(cols, L.LABEL_CANDIDATES_PREP) == "label_binary"
    assert SC.first_match(cols, L.LABEL_CANDIDATES_EVAL) == "label"


def test_loose_resolution(spark):
    df = spark.createDataFrame([("a", 1.5, "x"), ("b", 2.5, "y")], "Sentence STRING, score DOUBLE, kind STRING")
    assert SC.loose_resolve(df) == ("Sentence", "score")


def _split_counts(df):
    return {r["label"]: r["n"] for r in df.where("held_out").groupBy("label").agg(F.count("*").alias("n")).collect()}


def test_stratified_split_quotas(spark):
    d = spark.createDataFrame([(i, 0 if i < 80 else 1) for i in range(100)], "doc_id LONG, label INT")
    s = SP.stratified_holdout(d, "doc_id", "label", 0.1, 42)
    assert _split_counts(s) == {0: 8, 1: 2} and s.count() == 100
    d2 = spark.createDataFrame([(i, 0 if i < 80 else 1) for i in range(101)], "doc_id LONG, label INT")
    assert _split_counts(SP.stratified_holdout(d2, "doc_id", "label", 0.1, 42)) == {0: 9, 1: 2}


def test_split_partition_and_reproducible(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(500)], "doc_id LONG, label INT")
    a = SP.train_val_test(d, "doc_id", "label", 0.1, 0.1, 7)
    b = SP.train_val_test(d.repartition(5), "doc_id", "label", 0.1, 0.1, 7)
    ra = {(r["doc_id"], r["split"]) for r in a.collect()}
    rb = {(r["doc_id"], r["split"]) for r in b.collect()}
    assert ra == rb and len(ra) == 500 and len({k for k, _ in ra}) == 500
    assert sum(1 for _, s in ra if s == "test") == 50


def test_split_single_class(spark):
    d = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id LONG, label INT")
    assert SP.stratified_holdout(d, "doc_id", "label", 0.1).where("held_out").count() == 3


def test_class_weights(spark):
    d = spark.createDataFrame([(0,), (0,), (0,), (1,)], "label INT")
    sc = {r["cls"]: r["weight"] for r in FE.class_weights(d, "label").collect()}
    bal = {r["cls"]: r["weight"] for r in FE.class_weights(d, "label", mode="balanced").collect()}
    assert sc == {0: 1.333333, 1: 4.0} and bal == {0: 0.666667, 1: 2.0}
    gap = spark.createDataFrame([(0,), (2,)], "label INT")
    assert {r["cls"]: r["count"] for r in FE.class_weights(gap, "label").collect()} == {0: 1, 1: 1, 2: 1}


def test_drop_incomplete_report(spark):
    d = spark.createDataFrame([("a", 1, "s1"), (None, 1, "s1"), ("b", None, "s2")], "text STRING, label INT, source STRING")
    kept, rep = SC.drop_incomplete(d)
    assert kept.count() == 1
    assert {r["source"]: r["n_dropped"] for r in rep.collect()} == {"s1": 1, "s2": 1}


def test_example_bank(spark, tmp_path):
    p = tmp_path / "bank.json"
    p.write_text('{"biased_examples": ["b1", "b2"], "neutral_examples": ["n1"], '
                 '"stereotype_categories": {"gender_role": ["b1"]}}')
    rows = FS.read_example_bank(spark, str(p)).collect()
    assert sorted((r["bank"], r["text"]) for r in rows) == [("biased", "b1"), ("biased", "b2"), ("category", "b1"),
                                                             ("neutral", "n1")]


def test_rank_segments_against_brute_force(spark, monkeypatch):
    """Few buckets, so quota boundaries fall inside buckets and the window path runs."""
    import hashlib
    import math
    monkeypatch.setattr(SP, "BUCKET_HEX", 1)
    rows = [(i, 0 if i % 7 else 1) for i in range(700)]
    d = spark.createDataFrame(rows, "doc_id LONG, label INT")
    got = {r["doc_id"]: r["split"] for r in SP.train_val_test(d, "doc_id", "label", 0.13, 0.21, 5).collect()}
    exp = {}
    counts = {0: sum(1 for _, l in rows if l == 0), 1: sum(1 for _, l in rows if l == 1)}
    q1 = SP.largest_remainder(counts, math.ceil(700 * 0.13 - 1e-12))
    pool = {c: counts[c] - q1[c] for c in counts}
    q2 = SP.largest_remainder(pool, math.ceil(sum(pool.values()) * 0.21 - 1e-12))
    for c in counts:
        ids = sorted((hashlib.md5(f"5:{i}".encode()).hexdigest(), i) for i, l in rows if l == c)
        for rank, (_, i) in enumerate(ids, start=1):
            exp[i] = "test" if rank <= q1[c] else ("val" if rank <= q1[c] + q2[c] else "train")
    assert got == exp


def test_exact_quantiles_match_numpy(spark):
    import numpy as np
    vals = [float(x) for x in np.random.default_rng(3).integers(0, 50, 997)] + [1000.0, -5.0, 7.5]
    df = spark.createDataFrame([(v,) for v in vals], "s DOUBLE")
    probs = [0.0, 0.2, 0.5, 0.8, 0.999, 1.0]
    got = SP.exact_quantiles(df, "s", probs, partitions=7)
    exp = np.quantile(np.array(vals), probs)
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, exp))
