"""Evaluation queries over the predictions table: scoring, metrics, reports, curves,
paired tests, fairness and model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fairness as FA
from ..operators import metrics as M
from ..operators import significance as S
from ..operators.schema import threshold_class
from . import setup as U
from .registry import div0, divn, query

P = U.sql_predictions_ctes


def _with(body: str) -> str:
    return "WITH " + P() + body


@query("score_rules", _with("""
SELECT doc_id, grp, model, y_true, y_pred, round(proba, 6) AS proba,
       CASE WHEN proba > 0.5 THEN 'BIASED' ELSE 'NEUTRAL' END AS bias_class,
       round(greatest(proba, 1 - proba), 6) AS confidence
FROM preds"""), headline=True)
def score_rules(spark, sf):
    p = U.predictions(spark, sf)
    cls, conf = threshold_class("proba", U.THRESHOLD)
    return p.select("doc_id", "grp", "model", "y_true", "y_pred", F.round("proba", 6).alias("proba"), cls.alias("bias_class"),
                    F.round(conf, 6).alias("confidence"))


_COUNTS_SQL = """
, c AS (SELECT model, CAST(count(*) AS BIGINT) AS n,
        CAST(count_if(y_true = 1 AND y_pred = 1) AS BIGINT) AS tp,
        CAST(count_if(y_true = 0 AND y_pred = 1) AS BIGINT) AS fp,
        CAST(count_if(y_true = 1 AND y_pred = 0) AS BIGINT) AS fn,
        CAST(count_if(y_true = 0 AND y_pred = 0) AS BIGINT) AS tn FROM preds GROUP BY model)"""

_BINARY_SQL = _COUNTS_SQL + f"""
, bm AS (SELECT model, n, tp, fp, fn, tn,
       round({div0('tp + tn', 'n')}, 6) AS accuracy,
       round({div0('tp', 'tp + fp')}, 6) AS precision,
       round({div0('tp', 'tp + fn')}, 6) AS recall,
       round({div0('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c)"""


@query("binary_metrics", _with(_BINARY_SQL + "\nSELECT * FROM bm"), headline=True)
def binary_metrics(spark, sf):
    return M.binary_metrics(U.predictions(spark, sf))


@query("confusion", _with("""
, cells AS (SELECT m.model, a.y AS y_true, b.y AS y_pred
            FROM (SELECT DISTINCT model FROM preds) m, (VALUES (0), (1)) a(y), (VALUES (0), (1)) b(y))
SELECT cells.model, cells.y_true, cells.y_pred, CAST(coalesce(k.n, 0) AS BIGINT) AS n
FROM cells LEFT JOIN (SELECT model, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL) k
  ON cells.model = k.model AND cells.y_true = k.y_true AND cells.y_pred = k.y_pred"""))
def confusion(spark, sf):
    return M.confusion_matrix(U.predictions(spark, sf), labels=(0, 1))


@query("confusion_wide", _with("""
, k AS (SELECT model, y_true, y_pred, count(*) AS n FROM preds GROUP BY ALL)
SELECT m.model, a.y AS y_true,
       CAST(coalesce((SELECT n FROM k WHERE k.model = m.model AND k.y_true = a.y AND k.y_pred = 0), 0) AS BIGINT) AS pred_0,
       CAST(coalesce((SELECT n FROM k WHERE k.model = m.model AND k.y_true = a.y AND k.y_pred = 1), 0) AS BIGINT) AS pred_1
FROM (SELECT DISTINCT model FROM preds) m, (VALUES (0), (1)) a(y)"""))
def confusion_wide(spark, sf):
    return M.confusion_wide(U.predictions(spark, sf), labels=(0, 1))


_PER_CLASS_SQL = f"""
, roles AS (SELECT model, y_true AS cls, 1 AS t, 0 AS p, CAST(y_true = y_pred AS INTEGER) AS hit FROM preds
            UNION ALL SELECT model, y_pred AS cls, 0, 1, 0 FROM preds)
, pc AS (SELECT model, cls, CAST(sum(t) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
                CAST(sum(hit) AS BIGINT) AS tp FROM roles WHERE cls IS NOT NULL GROUP BY model, cls)
, pcm AS (SELECT *, {div0('tp', 'predicted')} AS precision, {div0('tp', 'support')} AS recall,
                 {div0('2 * tp', 'support + predicted')} AS f1 FROM pc)
, av AS (SELECT model, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall,
                round(avg(f1), 6) AS macro_f1,
                round(sum(precision * support) / nullif(sum(support), 0), 6) AS weighted_precision,
                round(sum(recall * support) / nullif(sum(support), 0), 6) AS weighted_recall,
                round(sum(f1 * support) / nullif(sum(support), 0), 6) AS weighted_f1,
                round(CAST(sum(tp) AS DOUBLE) / nullif(sum(support), 0), 6) AS accuracy,
                CAST(sum(support) AS BIGINT) AS total_support FROM pcm GROUP BY model)"""


@query("weighted_metrics", _with(_PER_CLASS_SQL + "\nSELECT * FROM av"))
def weighted_metrics(spark, sf):
    return M.averaged_metrics(U.predictions(spark, sf))


@query("class_report", _with(_PER_CLASS_SQL + """
SELECT model, CAST(cls AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1_score, support, CAST(NULL AS DOUBLE) AS value FROM pcm
UNION ALL SELECT model, 'accuracy', NULL, NULL, NULL, NULL, accuracy FROM av
UNION ALL SELECT model, 'macro avg', macro_precision, macro_recall, macro_f1, total_support, NULL FROM av
UNION ALL SELECT model, 'weighted avg', weighted_precision, weighted_recall, weighted_f1, total_support, NULL FROM av"""),
       headline=True)
def class_report(spark, sf):
    return M.classification_report(U.predictions(spark, sf))


_WIDE_COLS = """accuracy, f1 AS f1_score,
       max(CASE WHEN cls = 0 THEN round(precision, 6) END) AS precision_0,
       max(CASE WHEN cls = 0 THEN round(recall, 6) END) AS recall_0,
       max(CASE WHEN cls = 0 THEN round(pcm.f1, 6) END) AS f1_0,
       CAST(coalesce(max(CASE WHEN cls = 0 THEN support END), 0) AS BIGINT) AS support_0,
       max(CASE WHEN cls = 1 THEN round(precision, 6) END) AS precision_1,
       max(CASE WHEN cls = 1 THEN round(recall, 6) END) AS recall_1,
       max(CASE WHEN cls = 1 THEN round(pcm.f1, 6) END) AS f1_1,
       CAST(coalesce(max(CASE WHEN cls = 1 THEN support END), 0) AS BIGINT) AS support_1"""


def _report_wide_sql(key: str) -> str:
    return f"""
, pw AS (SELECT {key}, {_WIDE_COLS.replace('accuracy, f1 AS f1_score,', '')} FROM pcm GROUP BY {key})
SELECT av.{key}, av.accuracy, bm.f1 AS f1_score, precision_0, recall_0, f1_0, support_0,
       precision_1, recall_1, f1_1, support_1, macro_precision, macro_recall, macro_f1,
       weighted_precision, weighted_recall, weighted_f1, total_support
FROM av JOIN pw ON av.{key} = pw.{key} JOIN bm ON av.{key} = bm.{key}"""


@query("report_wide", _with(_PER_CLASS_SQL + _BINARY_SQL + _report_wide_sql("model")))
def report_wide(spark, sf):
    return M.report_wide(U.predictions(spark, sf))


_HIST_SQL = """
, h AS (SELECT model, proba AS score, CAST(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
               CAST(sum(CASE WHEN y_true <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg
        FROM preds WHERE proba IS NOT NULL AND y_true IS NOT NULL GROUP BY model, proba)"""

_AUC_SQL = _HIST_SQL + """
, ha AS (SELECT *, coalesce(sum(pos) OVER (PARTITION BY model ORDER BY score DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_above FROM h)
, auc AS (SELECT model, round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0
                   THEN sum(neg * (pos_above + pos / 2.0)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END, 6) AS roc_auc
          FROM ha GROUP BY model)"""


@query("roc_auc", _with(_AUC_SQL + "\nSELECT * FROM auc"), headline=True)
def roc_auc(spark, sf):
    return M.roc_auc(U.predictions(spark, sf))


@query("curve_points", _with(_HIST_SQL + f"""
, hc AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
                sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
                sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM h)
SELECT model, round(score, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round({divn('tp', 'P')}, 6) AS tpr, round({divn('fp', 'N')}, 6) AS fpr,
       round({divn('tp', 'tp + fp')}, 6) AS precision, round({divn('tp', 'P')}, 6) AS recall FROM hc"""))
def curve_points(spark, sf):
    return M.curve_points(U.predictions(spark, sf))


@query("model_metrics", _with(_BINARY_SQL + _AUC_SQL + """
SELECT bm.model, accuracy, precision, recall, f1, roc_auc FROM bm LEFT JOIN auc ON bm.model = auc.model"""))
def model_metrics(spark, sf):
    return M.model_metrics(U.predictions(spark, sf))


_PAIRS_SQL = f"""
, pa AS (SELECT a.model AS baseline, a.doc_id, a.y_true, a.y_pred AS a_pred, a.proba AS a_proba,
                b.y_pred AS b_pred, b.proba AS b_proba
         FROM preds a JOIN preds b ON a.doc_id = b.doc_id AND b.model = '{U.REFERENCE}' AND a.model <> '{U.REFERENCE}')"""

_MCNEMAR_SQL = _PAIRS_SQL + """
, mc AS (SELECT baseline, CAST(count_if(a_pred = y_true AND b_pred <> y_true) AS BIGINT) AS b,
                CAST(count_if(a_pred <> y_true AND b_pred = y_true) AS BIGINT) AS c,
                CAST(count(*) AS BIGINT) AS n FROM pa GROUP BY baseline)
, mcs AS (SELECT baseline, b, c, n, (b + c) < 25 AS exact,
       round(CASE WHEN (b + c) < 25 THEN CAST(least(b, c) AS DOUBLE)
                  ELSE power(abs(b - c) - 1.0, 2) / (b + c) END, 6) AS statistic,
       round(CAST(abs(b - c) AS DOUBLE) / nullif(n, 0), 6) AS cohens_g,
       round(CASE WHEN c > 0 THEN CAST(b AS DOUBLE) / c WHEN b > 0 THEN CAST('Infinity' AS DOUBLE) END, 6) AS odds_ratio
       FROM mc)"""


@query("mcnemar_counts", _with(_MCNEMAR_SQL + "\nSELECT * FROM mcs"), headline=True)
def mcnemar_counts(spark, sf):
    return S.mcnemar_counts(U.predictions(spark, sf), U.REFERENCE)


P_DIGITS = 9  # of p-values in query results, as the SQL statements integrate numerically


def _simpson(f: str, lo: str, hi: str, steps: int = 20_000) -> str:
    """SQL: the integral of ``f`` (of ``x``) from ``lo`` to ``hi``."""
    h = f"(({hi}) - ({lo})) / {steps}.0"
    weight = f"CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * {f.replace('$x', f'(({lo}) + i * {h})')})) * {h} / 3.0)"


_MCNEMAR_P_SQL = f"""
, mcp AS (SELECT *, round(CASE
    WHEN b + c = 0 THEN 1.0
    WHEN exact THEN least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1),
        lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))))
    ELSE 2 / sqrt(pi()) * {_simpson('exp(-$x * $x)', 'z', 'z + 8')} END, {P_DIGITS}) AS p_value
  FROM (SELECT *, sqrt(power(abs(b - c) - 1.0, 2) / nullif(b + c, 0) / 2) AS z FROM mcs))"""


@query("mcnemar_test", _with(_MCNEMAR_SQL + _MCNEMAR_P_SQL + """
SELECT baseline, b, c, n, exact, statistic, cohens_g, odds_ratio, p_value FROM mcp"""))
def mcnemar_test(spark, sf):
    return S.mcnemar_test(U.predictions(spark, sf), U.REFERENCE).withColumn("p_value", F.round("p_value", P_DIGITS))


_PAIRED_T_SQL = _PAIRS_SQL + """
, dd AS (SELECT baseline, (CASE WHEN y_true = 1 THEN b_proba ELSE 1 - b_proba END)
                        - (CASE WHEN y_true = 1 THEN a_proba ELSE 1 - a_proba END) AS d FROM pa)
, ts AS (SELECT baseline, avg(d) AS m, stddev_samp(d) AS sd, CAST(count(d) AS BIGINT) AS n FROM dd GROUP BY baseline)
, pt AS (SELECT baseline, round(m, 6) AS mean_diff, round(sd, 6) AS sd, n,
       round(CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END, 6) AS t_stat,
       round(CASE WHEN sd > 0 THEN m / sd END, 6) AS cohens_dz FROM ts)"""


@query("paired_t", _with(_PAIRED_T_SQL + "\nSELECT * FROM pt"))
def paired_t(spark, sf):
    return S.paired_t(U.predictions(spark, sf), U.REFERENCE)


_Z = "CAST(1.959963984540054 AS DOUBLE)"
# The 0.975 quantile of Student's t by its expansion in 1 / v around the normal one.
_T975 = f"""({_Z} + (power({_Z}, 3) + {_Z}) / (4 * v) + (5 * power({_Z}, 5) + 16 * power({_Z}, 3) + 3 * {_Z}) / (96 * v * v)
  + (3 * power({_Z}, 7) + 19 * power({_Z}, 5) + 17 * power({_Z}, 3) - 15 * {_Z}) / (384 * power(v, 3))
  + (79 * power({_Z}, 9) + 776 * power({_Z}, 7) + 1482 * power({_Z}, 5) - 1920 * power({_Z}, 3) - 945 * {_Z}) / (92160 * power(v, 4)))"""

_PAIRED_P_SQL = _PAIRED_T_SQL + f"""
, tv AS (SELECT *, n - 1.0 AS v, CASE WHEN sd > 0 THEN m / (sd / sqrt(n)) END AS t FROM ts)
, ptp AS (SELECT baseline, round(m, 6) AS mean_diff, round(sd, 6) AS sd, n, round(t, 6) AS t_stat,
    round(CASE WHEN sd > 0 THEN m / sd END, 6) AS cohens_dz,
    round(CASE WHEN n > 1 THEN greatest(0.0, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi())
      * {_simpson('power(1 + $x * $x / v, -(v + 1) / 2)', 'CAST(0 AS DOUBLE)', 'abs(t)')}) END, {P_DIGITS}) AS p_value,
    round(CASE WHEN n > 1 AND sd > 0 THEN m - {_T975} * sd / sqrt(n) END, 6) AS ci95_low,
    round(CASE WHEN n > 1 AND sd > 0 THEN m + {_T975} * sd / sqrt(n) END, 6) AS ci95_high FROM tv)"""


@query("paired_t_test", _with(_PAIRED_P_SQL + "\nSELECT * FROM ptp"))
def paired_t_test(spark, sf):
    return S.paired_t_test(U.predictions(spark, sf), U.REFERENCE).withColumn("p_value", F.round("p_value", P_DIGITS))


@query("alignment_check", _with(f"""
, a AS (SELECT model AS baseline, doc_id FROM preds WHERE model <> '{U.REFERENCE}')
, b AS (SELECT doc_id FROM preds WHERE model = '{U.REFERENCE}')
SELECT baseline, CAST(count_if(b.doc_id IS NULL) AS BIGINT) AS only_baseline,
       CAST((SELECT count(*) FROM b) - count(b.doc_id) AS BIGINT) AS only_reference,
       CAST(coalesce(max(dup.n), 0) AS BIGINT) AS duplicate_keys
FROM a LEFT JOIN b ON a.doc_id = b.doc_id
LEFT JOIN (SELECT model, count(*) AS n FROM (SELECT model, doc_id FROM preds GROUP BY ALL HAVING count(*) > 1) GROUP BY model) dup
  ON a.baseline = dup.model GROUP BY baseline"""))
def alignment_check(spark, sf):
    return S.alignment_check(U.predictions(spark, sf), U.REFERENCE)


_RATES_SQL = f"""
, gr AS (SELECT model, grp, CAST(count(*) AS BIGINT) AS count, count_if(y_pred = 1) AS pp,
                count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
                count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn
         FROM preds WHERE grp IS NOT NULL GROUP BY model, grp)
, rates AS (SELECT model, grp, count, round({div0('pp', 'count')}, 6) AS positive_rate,
                   round({div0('tp', 'tp + fn')}, 6) AS tpr, round({div0('fp', 'fp + tn')}, 6) AS fpr,
                   round({div0('tp', 'tp + fp')}, 6) AS precision FROM gr)"""


@query("group_fairness", _with(_RATES_SQL + "\nSELECT * FROM rates"), headline=True)
def group_fairness(spark, sf):
    return FA.group_rates(U.predictions(spark, sf))


@query("parity_gaps", _with(_RATES_SQL + """
, st AS (SELECT model, 'demographic_parity' AS criterion, positive_rate AS v FROM rates
         UNION ALL SELECT model, 'equal_opportunity_tpr', tpr FROM rates
         UNION ALL SELECT model, 'fpr_parity', fpr FROM rates
         UNION ALL SELECT model, 'predictive_parity_precision', precision FROM rates)
SELECT model, criterion, round(max(v) - min(v), 6) AS gap,
       round(CASE WHEN max(v) > 0 THEN min(v) / max(v) END, 6) AS ratio FROM st GROUP BY model, criterion"""))
def parity_gaps(spark, sf):
    return FA.parity_gaps(FA.group_rates(U.predictions(spark, sf)))


@query("disparity", _with(f"""
, g AS (SELECT model, avg(CASE WHEN grp = '{U.GROUP_A}' THEN proba END) AS m1,
               avg(CASE WHEN grp = '{U.GROUP_B}' THEN proba END) AS m2 FROM preds GROUP BY model)
SELECT model, round(m1, 6) AS mean_g1, round(m2, 6) AS mean_g2, round(abs(m1 - m2), 6) AS disparity_gap FROM g"""))
def disparity(spark, sf):
    return FA.disparity_gap(U.predictions(spark, sf), U.GROUP_A, U.GROUP_B)


@query("amplification", _with(f"""
, g AS (SELECT model, avg(CASE WHEN grp = '{U.GROUP_A}' THEN CAST(y_pred AS DOUBLE) END) AS pp1,
               avg(CASE WHEN grp = '{U.GROUP_B}' THEN CAST(y_pred AS DOUBLE) END) AS pp2,
               avg(CASE WHEN grp = '{U.GROUP_A}' THEN CAST(y_true AS DOUBLE) END) AS tp1,
               avg(CASE WHEN grp = '{U.GROUP_B}' THEN CAST(y_true AS DOUBLE) END) AS tp2 FROM preds GROUP BY model)
SELECT model, round(pp1 - pp2, 6) AS pred_gap, round(tp1 - tp2, 6) AS true_gap,
       round(CASE WHEN tp1 - tp2 <> 0 THEN (pp1 - pp2) / (tp1 - tp2) END, 6) AS amplification FROM g"""))
def amplification(spark, sf):
    return FA.bias_amplification(U.predictions(spark, sf), U.GROUP_A, U.GROUP_B)
