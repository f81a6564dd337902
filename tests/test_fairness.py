from textaudit.operators import fairness as FA


def test_group_rates_and_gaps(spark):
    rows = [(1, "m", 1, 1, "a"), (2, "m", 0, 0, "a"), (3, "m", 1, 0, "b"), (4, "m", 0, 1, "b"), (5, "m", 1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id LONG, model STRING, y_true INT, y_pred INT, grp STRING")
    rates = {r["grp"]: r for r in FA.group_rates(df).collect()}
    assert set(rates) == {"a", "b"}
    a, b = rates["a"], rates["b"]
    assert (a["count"], a["positive_rate"], a["tpr"], a["fpr"], a["precision"]) == (2, 0.5, 1.0, 0.0, 1.0)
    assert (b["count"], b["positive_rate"], b["tpr"], b["fpr"], b["precision"]) == (2, 0.5, 0.0, 1.0, 0.0)
    gaps = {r["criterion"]: (r["gap"], r["ratio"]) for r in FA.parity_gaps(FA.group_rates(df)).collect()}
    assert gaps == {"demographic_parity": (0.0, 1.0), "equal_opportunity_tpr": (1.0, 0.0),
                    "fpr_parity": (1.0, 0.0), "predictive_parity_precision": (1.0, 0.0)}


def test_ratio_null_when_max_zero(spark):
    rows = [(1, "m", 0, 0, "a"), (2, "m", 0, 0, "b")]
    df = spark.createDataFrame(rows, "doc_id LONG, model STRING, y_true INT, y_pred INT, grp STRING")
    gaps = {r["criterion"]: r["ratio"] for r in FA.parity_gaps(FA.group_rates(df)).collect()}
    assert gaps["demographic_parity"] is None


def test_disparity_and_amplification(spark):
    rows = [(1, "m", 1, 1, .9, "a"), (2, "m", 0, 1, .7, "a"), (3, "m", 1, 0, .3, "b"), (4, "m", 0, 0, .1, "b")]
    df = spark.createDataFrame(rows, "doc_id LONG, model STRING, y_true INT, y_pred INT, proba DOUBLE, grp STRING")
    d = FA.disparity_gap(df, "a", "b").first()
    assert abs(d["disparity_gap"] - 0.6) < 1e-9
    amp = FA.bias_amplification(df, "a", "b").first()
    assert amp["true_gap"] == 0.0 and amp["amplification"] is None


def test_gender_group(spark):
    df = spark.createDataFrame([(1, "He said his piece"), (2, "She and her sister"), (3, "He and she"), (4, "none")],
                               "doc_id LONG, text STRING")
    got = {r["doc_id"]: r["grp"] for r in FA.gender_group(df).collect()}
    assert got == {1: "male", 2: "female", 3: None, 4: None}
