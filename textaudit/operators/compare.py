"""Model comparison tables: paired summary rows, rankings, leader margins, long metric
tables for charts, error bars, best run by F1, cross-dataset reports.

Inputs are per-model aggregates (one row per model), so the windows here sort a handful of
rows; the document-level work happens in the metric aggregates upstream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from . import metrics as M
from . import significance as S

METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def metrics_long(model_metrics: DataFrame, by=("model",), metrics=METRIC_NAMES) -> DataFrame:
    """Unpivot per-model metrics to ``(model, metric, value)``."""
    return model_metrics.unpivot(list(by), list(metrics), "metric", "value")


def top_models(model_metrics: DataFrame, metric: str = "f1", n: int = 5, by=("model",)) -> DataFrame:
    """The ``n`` best rows by a metric (ties by name): a preview, whose limit is the feature."""
    return model_metrics.orderBy(F.col(metric).desc(), *by).limit(n)


def composition(df: DataFrame, by=("source", "label")) -> DataFrame:
    """Rows of each combination of ``by``, with subtotals from the right (``level``: the grouping
    id, 0 for a full combination)."""
    return df.rollup(*by).agg(F.grouping_id(*by).cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def model_ranking(model_metrics: DataFrame, metric: str = "f1") -> DataFrame:
    """Rank of each model by a metric (descending; ties share a rank)."""
    w = Window.orderBy(F.col(metric).desc())
    return model_metrics.select("model", metric, F.rank().over(w).alias("rank"))


def margin_vs_second(long: DataFrame) -> DataFrame:
    """Per metric: leader, runner-up, margin and its bucket (tiny / moderate / large)."""
    w = Window.partitionBy("metric").orderBy(F.col("value").desc(), F.col("model"))
    r = long.where(F.col("value").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    g = r.groupBy("metric").agg(
        F.max(F.when(F.col("rn") == 1, F.col("model"))).alias("leader"),
        F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("leader_value"),
        F.max(F.when(F.col("rn") == 2, F.col("model"))).alias("second"),
        F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("second_value"))
    margin = F.round(F.col("leader_value") - F.col("second_value"), M.DIGITS)
    bucket = (F.when(margin.isNull(), F.lit(None)).when(margin < L.MARGIN_TINY, "tiny")
              .when(margin <= L.MARGIN_LARGE, "moderate").otherwise("large"))
    return g.select("metric", "leader", "leader_value", "second", "second_value",
                    margin.alias("margin"), bucket.alias("bucket"))


def paired_summary(preds: DataFrame, reference: str, key: str = "doc_id") -> DataFrame:
    """One row per baseline: its metrics, the reference's metrics, McNemar and paired-t. One
    metrics pass for all models (the reference's row is attached over the table of models) and
    one pairing pass for both tests."""
    whole = Window.partitionBy(F.lit(0))
    mm = M.model_metrics(preds)
    ref = [F.max(F.when(F.col("model") == reference, F.col(m))).over(whole).alias(f"reference_{m}") for m in METRIC_NAMES]
    base = mm.select("model", *[F.col(m).alias(f"baseline_{m}") for m in METRIC_NAMES], *ref).where(F.col("model") != reference)
    tests = S.paired_tests(preds, reference, key).select(
        F.col("baseline").alias("model"), F.col("b").alias("mcnemar_b"), F.col("c").alias("mcnemar_c"),
        F.col("m_exact").alias("mcnemar_exact"), F.col("m_statistic").alias("mcnemar_statistic"),
        F.col("m_mcnemar_p").alias("mcnemar_p_value"), F.col("m_cohens_g").alias("mcnemar_cohens_g"),
        F.col("m_odds_ratio").alias("mcnemar_odds_ratio"),
        F.col("t_stat").alias("paired_t_stat"), F.col("p_value").alias("paired_t_p_value"),
        F.col("cohens_dz").alias("paired_t_cohens_dz"), F.col("mean_diff").alias("paired_t_mean_diff"),
        F.col("ci95_low").alias("paired_t_ci95_low"), F.col("ci95_high").alias("paired_t_ci95_high"),
        F.col("n").alias("paired_t_n"))
    return base.join(tests, "model", "left").withColumnRenamed("model", "baseline")


def mean_diff_bars(paired: DataFrame) -> DataFrame:
    """Error-bar lengths around the mean difference (NULL interval -> 0) and its sign."""
    m = F.col("mean_diff")
    return paired.select(
        "baseline", m.alias("mean_diff"),
        F.round(F.coalesce(m - F.col("ci95_low"), F.lit(0.0)), M.DIGITS).alias("err_low"),
        F.round(F.coalesce(F.col("ci95_high") - m, F.lit(0.0)), M.DIGITS).alias("err_high"),
        F.when(m > 0, "positive").when(m < 0, "negative").otherwise("zero").alias("sign"))


def threshold_runs(preds: DataFrame, thresholds) -> DataFrame:
    """A stand-in for a training history, which no table here has: F1 of each model at each
    threshold as run ``epoch`` 1, 2, ... (the selection of the best run is the operator)."""
    runs = F.array(*[F.struct(F.lit(i + 1).alias("epoch"), F.lit(float(t)).alias("threshold"))
                     for i, t in enumerate(thresholds)])
    x = preds.select("model", "y_true", "proba", F.explode(runs).alias("r")).select(
        "model", "y_true", "r.epoch", "r.threshold",
        (F.col("proba") >= F.col("r.threshold")).cast("int").alias("y_pred"))
    return M.binary_metrics(x, by=("model", "epoch", "threshold")).select("model", "epoch", "threshold", "f1")


def best_run(runs: DataFrame, by=("model",)) -> DataFrame:
    """The run with the strictly greatest F1; the earliest epoch wins a tie."""
    best = F.max_by(F.struct("epoch", "threshold", "f1"), F.struct(F.col("f1"), -F.col("epoch")))
    return runs.groupBy(*by).agg(best.alias("b")).select(
        *by, F.col("b.epoch").alias("best_epoch"), F.col("b.threshold").alias("best_threshold"),
        F.col("b.f1").alias("best_f1"))
