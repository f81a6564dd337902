"""Model-comparison queries: summary rows, ranking, leader margins, chart tables, runs,
cross-dataset reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..operators import metrics as M
from ..operators import significance as S
from . import evaluation as EV
from . import setup as U
from .registry import query

_MM = EV._BINARY_SQL + EV._AUC_SQL + """
, mm AS (SELECT bm.model, accuracy, precision, recall, f1, roc_auc FROM bm LEFT JOIN auc ON bm.model = auc.model)"""

_LONG = _MM + """
, ml AS (SELECT model, 'accuracy' AS metric, accuracy AS value FROM mm
         UNION ALL SELECT model, 'precision', precision FROM mm
         UNION ALL SELECT model, 'recall', recall FROM mm
         UNION ALL SELECT model, 'f1', f1 FROM mm
         UNION ALL SELECT model, 'roc_auc', roc_auc FROM mm)"""


@query("metrics_long", EV._with(_LONG + "\nSELECT * FROM ml"))
def metrics_long(spark, sf):
    return C.metrics_long(M.model_metrics(U.predictions(spark, sf)))


@query("model_ranking", EV._with(_MM + "\nSELECT model, f1, CAST(rank() OVER (ORDER BY f1 DESC) AS INTEGER) AS rank FROM mm"))
def model_ranking(spark, sf):
    return C.model_ranking(M.model_metrics(U.predictions(spark, sf)))


@query("margin_vs_second", EV._with(_LONG + """
, r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rn FROM ml WHERE value IS NOT NULL)
, g AS (SELECT metric, max(CASE WHEN rn = 1 THEN model END) AS leader, max(CASE WHEN rn = 1 THEN value END) AS leader_value,
               max(CASE WHEN rn = 2 THEN model END) AS second, max(CASE WHEN rn = 2 THEN value END) AS second_value
        FROM r WHERE rn <= 2 GROUP BY metric)
SELECT metric, leader, leader_value, second, second_value, round(leader_value - second_value, 6) AS margin,
       CASE WHEN round(leader_value - second_value, 6) IS NULL THEN NULL
            WHEN round(leader_value - second_value, 6) < 0.01 THEN 'tiny'
            WHEN round(leader_value - second_value, 6) <= 0.03 THEN 'moderate' ELSE 'large' END AS bucket FROM g"""))
def margin_vs_second(spark, sf):
    return C.margin_vs_second(C.metrics_long(M.model_metrics(U.predictions(spark, sf))))


_SIDES = ", ".join(f"x.{m} AS baseline_{m}, r.{m} AS reference_{m}" for m in C.METRIC_NAMES)


@query("paired_summary", EV._with(_MM + EV._MCNEMAR_SQL + EV._MCNEMAR_P_SQL + EV._PAIRED_P_SQL.replace(EV._PAIRS_SQL, "") + f"""
SELECT x.model AS baseline, {_SIDES}, mcp.b AS mcnemar_b, mcp.c AS mcnemar_c, mcp.exact AS mcnemar_exact,
       mcp.statistic AS mcnemar_statistic, mcp.p_value AS mcnemar_p_value, mcp.cohens_g AS mcnemar_cohens_g,
       mcp.odds_ratio AS mcnemar_odds_ratio, t_stat AS paired_t_stat, ptp.p_value AS paired_t_p_value,
       cohens_dz AS paired_t_cohens_dz, mean_diff AS paired_t_mean_diff, ci95_low AS paired_t_ci95_low,
       ci95_high AS paired_t_ci95_high, ptp.n AS paired_t_n
FROM mm x JOIN mm r ON r.model = '{U.REFERENCE}' AND x.model <> '{U.REFERENCE}'
LEFT JOIN mcp ON mcp.baseline = x.model LEFT JOIN ptp ON ptp.baseline = x.model"""), headline=True)
def paired_summary(spark, sf):
    s = C.paired_summary(U.predictions(spark, sf), U.REFERENCE)
    return s.withColumns({c: F.round(c, EV.P_DIGITS) for c in ("mcnemar_p_value", "paired_t_p_value")})


@query("mean_diff_bars", EV._with(EV._PAIRED_P_SQL + """
SELECT baseline, mean_diff, round(coalesce(mean_diff - ci95_low, 0.0), 6) AS err_low, round(coalesce(ci95_high - mean_diff, 0.0), 6) AS err_high,
       CASE WHEN mean_diff > 0 THEN 'positive' WHEN mean_diff < 0 THEN 'negative' ELSE 'zero' END AS sign FROM ptp"""))
def mean_diff_bars(spark, sf):
    return C.mean_diff_bars(S.paired_t_test(U.predictions(spark, sf), U.REFERENCE))


RUN_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]


def _runs_sql() -> str:
    vals = ", ".join(f"({i + 1}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(RUN_THRESHOLDS))
    return f"""
, thr(epoch, threshold) AS (VALUES {vals})
, rc AS (SELECT model, epoch, threshold, count_if(y_true = 1 AND proba >= threshold) AS tp,
                count_if(y_true = 0 AND proba >= threshold) AS fp, count_if(y_true = 1 AND proba < threshold) AS fn
         FROM preds, thr GROUP BY model, epoch, threshold)
, runs AS (SELECT model, epoch, threshold, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM rc)"""


@query("threshold_runs", EV._with(_runs_sql() + "\nSELECT * FROM runs"))
def threshold_runs(spark, sf):
    return C.threshold_runs(U.predictions(spark, sf), RUN_THRESHOLDS)


@query("best_run", EV._with(_runs_sql() + """
, rr AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, epoch) AS rn FROM runs)
SELECT model, epoch AS best_epoch, threshold AS best_threshold, f1 AS best_f1 FROM rr WHERE rn = 1"""))
def best_run(spark, sf):
    return C.best_run(C.threshold_runs(U.predictions(spark, sf), RUN_THRESHOLDS))


@query("cross_dataset", EV._with(EV._PER_CLASS_SQL.replace("model", "dataset").replace(
    "FROM preds", f"FROM (SELECT dataset, y_true, y_pred FROM preds WHERE model = '{U.REFERENCE}')")
    + EV._BINARY_SQL.replace("model", "dataset").replace(
        "FROM preds", f"FROM (SELECT dataset, y_true, y_pred FROM preds WHERE model = '{U.REFERENCE}')")
    + EV._report_wide_sql("dataset")))
def cross_dataset(spark, sf):
    p = U.predictions(spark, sf).where(F.col("model") == U.REFERENCE)
    return M.report_wide(p, by=("dataset",))


@query("top_models", EV._with(_MM + "\nSELECT model, f1, accuracy FROM mm ORDER BY f1 DESC, model LIMIT 2"))
def top_models(spark, sf):
    """Preview of the two best models by F1 (a top-k report: the limit is the feature)."""
    return C.top_models(M.model_metrics(U.predictions(spark, sf)), "f1", 2).select("model", "f1", "accuracy")


@query("cross_dataset_all_models", EV._with(
    EV._PER_CLASS_SQL.replace("model, cls", "model, dataset, cls").replace("GROUP BY model)", "GROUP BY model, dataset)")
    .replace("SELECT model, y_true AS cls", "SELECT model, dataset, y_true AS cls")
    .replace("SELECT model, y_pred AS cls", "SELECT model, dataset, y_pred AS cls")
    .replace("av AS (SELECT model,", "av AS (SELECT model, dataset,")
    + """
, pw AS (SELECT model, dataset,
       max(CASE WHEN cls = 1 THEN round(pcm.f1, 6) END) AS f1_1,
       CAST(coalesce(max(CASE WHEN cls = 1 THEN support END), 0) AS BIGINT) AS support_1 FROM pcm GROUP BY model, dataset)
SELECT av.model, av.dataset, av.accuracy, pw.f1_1, pw.support_1, av.macro_f1, av.weighted_f1, av.total_support
FROM av JOIN pw ON av.model = pw.model AND av.dataset = pw.dataset"""))
def cross_dataset_all_models(spark, sf):
    """Every model on every dataset (models x datasets as one grouped table)."""
    p = U.predictions(spark, sf)
    w = M.report_wide(p, by=("model", "dataset"))
    return w.select("model", "dataset", "accuracy", "f1_1", "support_1", "macro_f1", "weighted_f1", "total_support")
