"""Paired comparisons of models: McNemar counts and test, paired t-test on true-class
probabilities, effect sizes and confidence intervals.

Pairs are formed by key (``doc_id``), never by position: one grouping of the predictions by
key brings a document's rows of all models together (one shuffle).
The statistics are aggregates; distribution functions run on the final one row per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dist as D
from .metrics import DIGITS


def _r(c):
    return F.round(c, DIGITS)


def pair_with_reference(preds: DataFrame, reference: str, key: str = "doc_id") -> DataFrame:
    """``(baseline, key, y_true, a_pred, a_proba, b_pred, b_proba)``: A = baseline, B = reference.

    One grouping by key gathers a document's rows of all models (as many as there are models)
    and pairs them inside the row: a single shuffle, no self-join."""
    row = F.struct("model", "y_true", "y_pred", "proba")
    by = preds.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_list(row).alias("rows"))
    sides = by.select(key, F.filter("rows", lambda r: r["model"] != reference).alias("a"),
                      F.filter("rows", lambda r: r["model"] == reference).alias("b"))
    pairs = sides.select(key, F.explode("a").alias("a"), "b").select(key, "a", F.explode("b").alias("b"))
    return pairs.select(F.col("a.model").alias("baseline"), key, F.col("a.y_true").alias("y_true"), F.col("a.y_pred").alias("a_pred"),
                        F.col("a.proba").alias("a_proba"), F.col("b.y_pred").alias("b_pred"), F.col("b.proba").alias("b_proba"))


def alignment_check(preds: DataFrame, reference: str, key: str = "doc_id") -> DataFrame:
    """Per baseline: rows whose key the reference lacks, reference rows whose key it lacks, and
    keys it has more than once. Pairing is valid when all three are 0. One grouping by key; what
    follows is one row per model."""
    by = preds.groupBy(key).agg(F.collect_list("model").alias("ms"))
    n_of = lambda m: F.size("ms") - F.size(F.array_remove("ms", m))
    each = by.select(n_of(F.lit(reference)).alias("in_ref"), "ms", F.explode(F.array_distinct("ms")).alias("baseline"))
    each = each.select("baseline", "in_ref", n_of(F.col("baseline")).alias("n"))
    per = each.groupBy("baseline").agg(
        F.sum(F.when(F.col("in_ref") == 0, F.col("n")).otherwise(0)).cast("long").alias("only_baseline"),
        F.sum(F.col("in_ref")).cast("long").alias("met"), F.count_if(F.col("n") > 1).cast("long").alias("duplicate_keys"))
    whole = Window.partitionBy(F.lit(0))  # one row per model
    per = per.withColumn("all_ref", F.max(F.when(F.col("baseline") == reference, F.col("met"))).over(whole))
    return per.where(F.col("baseline") != reference).select(
        "baseline", "only_baseline", (F.coalesce("all_ref", F.lit(0)) - F.col("met")).cast("long").alias("only_reference"), "duplicate_keys")


def pair_aggregates(preds: DataFrame, reference: str, key: str = "doc_id") -> DataFrame:
    """One pass over the pairs: McNemar counts and the moments of the true-class probability
    difference d = B - A (pairs with a NULL probability drop out of the moments)."""
    p = pair_with_reference(preds, reference, key)
    a_ok = F.col("a_pred") == F.col("y_true")
    b_ok = F.col("b_pred") == F.col("y_true")
    d = (true_class_proba(F.col("y_true"), F.col("b_proba"))
         - true_class_proba(F.col("y_true"), F.col("a_proba")))
    return p.groupBy("baseline").agg(
        F.count_if(a_ok & ~b_ok).cast("long").alias("b"), F.count_if(~a_ok & b_ok).cast("long").alias("c"),
        F.count(F.lit(1)).cast("long").alias("n"),
        F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count(d).cast("long").alias("n_d"))


def _mcnemar_columns() -> dict:
    b, c, n = F.col("b"), F.col("c"), F.col("n")
    exact = (b + c) < 25
    stat = F.when(exact, F.least(b, c).cast("double")).otherwise(
        F.pow(F.abs(b - c) - 1.0, 2) / (b + c))
    odds = (F.when(c > 0, b / c.cast("double"))
            .when(b > 0, F.lit(float("inf"))).otherwise(F.lit(None).cast("double")))
    return {"exact": exact, "statistic": _r(stat), "cohens_g": _r(F.try_divide(F.abs(b - c).cast("double"), n)), "odds_ratio": _r(odds)}


def _mcnemar_from(g: DataFrame) -> DataFrame:
    return g.select("baseline", "b", "c", "n", *[v.alias(k) for k, v in _mcnemar_columns().items()])


def mcnemar_counts(preds: DataFrame, reference: str, key: str = "doc_id") -> DataFrame:
    """b = A right and B wrong, c = A wrong and B right; exact below 25 discordant pairs;
    statistic, Cohen's g and odds ratio (infinite when c = 0 < b, NULL when both are 0)."""
    return _mcnemar_from(pair_aggregates(preds, reference, key))


def mcnemar_test(preds: DataFrame, reference: str, key: str = "doc_id") -> DataFrame:
    """McNemar counts with the p-value (binomial or chi-square, one row per pair)."""
    m = mcnemar_counts(preds, reference, key)
    return m.withColumn("p_value", D.mcnemar_p_udf(F.col("b"), F.col("c")))


def true_class_proba(y, p):
    return F.when(y == 1, p).otherwise(F.lit(1.0) - p)


def _t_from(g: DataFrame, keep=()) -> DataFrame:
    sd_ok = F.col("sd") > 0
    return g.select("baseline", *keep, "mean", "sd", F.col("n_d").alias("n"),
                    F.when(sd_ok, F.col("mean") / (F.col("sd") / F.sqrt(F.col("n_d")))).alias("t"),
                    F.when(sd_ok, F.col("mean") / F.col("sd")).alias("dz"))


def _paired_t_raw(preds: DataFrame, reference: str, key: str) -> DataFrame:
    """Unrounded ``(baseline, mean, sd, n, t, dz)`` of d = B - A on true-class probability."""
    return _t_from(pair_aggregates(preds, reference, key))


def paired_t(preds: DataFrame, reference: str, key: str = "doc_id") -> DataFrame:
    """Paired t on true-class probability, d = B - A, pairs with a NULL probability dropped:
    mean, sd (n-1), n, t = mean / (sd / sqrt n), Cohen's dz = mean / sd (NULL if sd = 0)."""
    r = _paired_t_raw(preds, reference, key)
    return r.select("baseline", _r(F.col("mean")).alias("mean_diff"), _r(F.col("sd")).alias("sd"), "n",
                    _r(F.col("t")).alias("t_stat"), _r(F.col("dz")).alias("cohens_dz"))


def _t_test_from(r: DataFrame, level: float, keep=()) -> DataFrame:
    df1 = (F.col("n") - 1).cast("double")
    ok = (F.col("n") > 1) & (F.col("sd") > 0)
    se = F.col("sd") / F.sqrt(F.col("n"))
    x = (r.withColumn("p_value", F.when(F.col("n") > 1, D.t_two_sided_p_udf(F.col("t"), df1)))
         .withColumn("q", F.when(ok, D.t_quantile_udf(F.lit((1.0 + level) / 2.0), df1))))
    return x.select(
        "baseline", *keep, _r(F.col("mean")).alias("mean_diff"), _r(F.col("sd")).alias("sd"), "n",
        _r(F.col("t")).alias("t_stat"), _r(F.col("dz")).alias("cohens_dz"), F.col("p_value"),
        _r(F.when(ok, F.col("mean") - F.col("q") * se)).alias("ci95_low"),
        _r(F.when(ok, F.col("mean") + F.col("q") * se)).alias("ci95_high"))


def paired_t_test(preds: DataFrame, reference: str, key: str = "doc_id", level: float = 0.95) -> DataFrame:
    """Paired t with two-sided p-value and the ``level`` confidence interval of the mean
    difference (NULL when n <= 1 or sd = 0)."""
    return _t_test_from(_paired_t_raw(preds, reference, key), level)


def paired_tests(preds: DataFrame, reference: str, key: str = "doc_id", level: float = 0.95) -> DataFrame:
    """McNemar and paired-t results of every baseline in one row, from a single pairing pass."""
    g = pair_aggregates(preds, reference, key)
    both = _mcnemar_columns() | {"mcnemar_p": D.mcnemar_p_udf(F.col("b"), F.col("c"))}
    g = g.select("baseline", "mean", "sd", "n_d", "b", "c", *[v.alias(f"m_{k}") for k, v in both.items()])
    extra = ["b", "c", *[f"m_{k}" for k in both]]
    return _t_test_from(_t_from(g, extra), level, extra)
