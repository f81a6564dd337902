import math

from textaudit.functions import dist as D
from textaudit.operators import significance as S


def long(spark, y, a, b, pa=None, pb=None):
    pa = pa or [None] * len(y)
    pb = pb or [None] * len(y)
    rows = [(i, "A", y[i], a[i], pa[i]) for i in range(len(y))] + [(i, "B", y[i], b[i], pb[i]) for i in range(len(y))]
    return spark.createDataFrame(rows, "doc_id LONG, model STRING, y_true INT, y_pred INT, proba DOUBLE")


def test_mcnemar_fixture(spark):
    df = long(spark, [0, 1, 0, 1], [0, 1, 1, 1], [1, 1, 0, 0])
    r = S.mcnemar_test(df, "B").first()
    assert (r["b"], r["c"], r["exact"]) == (2, 1, True)
    assert r["statistic"] == 1.0 and r["p_value"] == 1.0
    assert r["cohens_g"] == 0.25 and r["odds_ratio"] == 2.0


def test_mcnemar_closed_forms():
    assert math.isclose(D.mcnemar(2, 10)["p_value"], 0.03857421875, rel_tol=1e-12)
    assert D.mcnemar(2, 10)["statistic"] == 2
    assert math.isclose(D.mcnemar(3, 0)["p_value"], 0.25, rel_tol=1e-12)
    assert D.mcnemar(0, 0)["p_value"] == 1.0
    g = D.mcnemar(1059, 851)
    assert not g["exact"]
    assert math.isclose(g["statistic"], 22.434031413612566, rel_tol=1e-12)
    assert math.isclose(g["p_value"], 2.1748612396400857e-06, rel_tol=1e-9)
    assert D.mcnemar(12, 12)["exact"] and not D.mcnemar(12, 13)["exact"]


def test_published_rows_reproduce():
    # (b, c, statistic, p) from the published paired summary
    rows = [(1358, 3263, 784.5089807400996, 1.2592982437744624e-172),
            (1167, 2776, 655.7605883844789, 1.2482602564967922e-144),
            (1264, 6055, 3134.8681513868014, 0.0)]
    for b, c, stat, p in rows:
        r = D.mcnemar(b, c)
        assert math.isclose(r["statistic"], stat, rel_tol=1e-12)
        assert (p == 0.0 and r["p_value"] < 1e-300) or math.isclose(r["p_value"], p, rel_tol=1e-6)
    assert math.isclose(abs(1059 - 851) / 39619, 0.0052500063101037385, rel_tol=1e-12)
    assert math.isclose(1059 / 851, 1.2444183313748531, rel_tol=1e-12)


def test_odds_ratio_edges(spark):
    df = long(spark, [1, 1, 1], [1, 1, 1], [0, 0, 1])
    r = S.mcnemar_counts(df, "B").first()
    assert (r["b"], r["c"]) == (2, 0) and r["odds_ratio"] == float("inf")
    same = long(spark, [1, 0], [1, 0], [1, 0])
    assert S.mcnemar_counts(same, "B").first()["odds_ratio"] is None


def test_mcnemar_symmetry(spark):
    y = [0, 1, 0, 1, 1, 0, 1]
    a = [0, 1, 1, 1, 0, 0, 0]
    b = [1, 1, 0, 0, 1, 0, 1]
    r1 = S.mcnemar_counts(long(spark, y, a, b), "B").first()
    r2 = S.mcnemar_counts(long(spark, y, b, a), "B").first()
    assert (r1["b"], r1["c"]) == (r2["c"], r2["b"])
    assert math.isclose(r1["odds_ratio"], 1 / r2["odds_ratio"], rel_tol=1e-5)


def test_paired_t_fixtures(spark):
    df = long(spark, [1, 0, 1, 0], [1, 0, 1, 0], [1, 0, 1, 0], [.6, .2, .7, .1], [.7, .3, .8, .2])
    r = S.paired_t_test(df, "B").first()
    assert r["n"] == 4 and abs(r["mean_diff"]) < 1e-6 and abs(r["t_stat"]) < 1e-6
    assert abs(r["p_value"] - 1.0) < 1e-6 and abs(r["cohens_dz"]) < 1e-6
    assert abs(r["ci95_low"] + 0.183739) < 1e-6 and abs(r["ci95_high"] - 0.183739) < 1e-6
    df2 = long(spark, [1, 1, 1], [1, 1, 1], [1, 1, 1], [.5, .5, .5], [.6, .7, .8])
    r2 = S.paired_t_test(df2, "B").first()
    assert abs(r2["mean_diff"] - 0.2) < 1e-6 and abs(r2["cohens_dz"] - 2.0) < 1e-6
    assert abs(r2["t_stat"] - 3.464102) < 1e-6 and abs(r2["p_value"] - 0.074180) < 1e-6
    assert abs(r2["ci95_low"] + 0.048414) < 1e-6 and abs(r2["ci95_high"] - 0.448414) < 1e-6


def test_paired_t_degenerate(spark):
    df = long(spark, [1, 1], [1, 1], [1, 1], [.5, None], [.6, .9])
    r = S.paired_t_test(df, "B").first()
    assert r["n"] == 1 and r["ci95_low"] is None and r["cohens_dz"] is None
    same = long(spark, [1, 1, 1], [1, 1, 1], [1, 1, 1], [.5, .5, .5], [.6, .6, .6])
    assert S.paired_t_test(same, "B").first()["cohens_dz"] is None


def test_t_distribution():
    assert math.isclose(D.t_ppf(0.975, 2), 4.302652729749464, rel_tol=1e-9)
    assert math.isclose(D.t_two_sided_p(-6.135853010730779, 39618), 8.550413204078727e-10, rel_tol=1e-6)


def test_alignment_by_key(spark):
    rows = [(1, "A", 1, 1, .9), (2, "A", 0, 0, .1), (1, "B", 1, 1, .8), (3, "B", 0, 1, .7)]
    df = spark.createDataFrame(rows, "doc_id LONG, model STRING, y_true INT, y_pred INT, proba DOUBLE")
    r = S.alignment_check(df, "B").first()
    assert (r["only_baseline"], r["only_reference"], r["duplicate_keys"]) == (1, 1, 0)


def test_golden_row_through_spark(spark):
    """Published CDA-vs-main row: b = 1059, c = 851, n = 39,619."""
    from pyspark.sql import functions as F
    ids = spark.range(39619).withColumnRenamed("id", "doc_id")
    # ids < 1059: A right, B wrong; 1059..1909: A wrong, B right; the rest: both right
    a_ok = (F.col("doc_id") < 1059) | (F.col("doc_id") >= 1910)
    b_ok = F.col("doc_id") >= 1059
    base = ids.select("doc_id", F.lit(1).alias("y_true"))
    a = base.select("doc_id", F.lit("A").alias("model"), "y_true", F.when(a_ok, 1).otherwise(0).alias("y_pred"),
                    F.lit(None).cast("double").alias("proba"))
    b = base.select("doc_id", F.lit("B").alias("model"), "y_true", F.when(b_ok, 1).otherwise(0).alias("y_pred"),
                    F.lit(None).cast("double").alias("proba"))
    r = S.mcnemar_test(a.unionByName(b), "B").first()
    assert (r["b"], r["c"], r["n"], r["exact"]) == (1059, 851, 39619, False)
    assert abs(r["statistic"] - 22.434031) < 1e-6
    assert math.isclose(r["p_value"], 2.1748612396400857e-06, rel_tol=1e-9)
    assert abs(r["cohens_g"] - 0.00525) < 1e-6 and abs(r["odds_ratio"] - 1.244418) < 1e-6
