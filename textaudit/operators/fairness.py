"""Group fairness: per-group rates, parity gaps and ratios, disparity and amplification,
and group assignment from gendered words.

All are ``groupBy(model, group)`` conditional aggregates followed by a second aggregate over
the (small) per-group table. Rows with a NULL group are excluded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as TX
from .metrics import DIGITS

METRICS = [("positive_rate", "demographic_parity"), ("tpr", "equal_opportunity_tpr"),
           ("fpr", "fpr_parity"), ("precision", "predictive_parity_precision")]


def _r(c):
    return F.round(c, DIGITS)


def _div0(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def attach_group(preds: DataFrame, groups: DataFrame, key: str = "doc_id", group_col: str = "grp") -> DataFrame:
    """Equi-join of predictions with a sensitive attribute; NULL groups excluded."""
    return preds.join(groups.select(key, F.col(group_col).alias("grp")), key).where(F.col("grp").isNotNull())


def group_rates(df: DataFrame, by=("model",), group: str = "grp") -> DataFrame:
    """Per (model, group): count, positive rate, TPR, FPR, precision (undefined -> 0)."""
    y, p = F.col("y_true"), F.col("y_pred")
    g = df.where(F.col(group).isNotNull()).groupBy(*by, group).agg(
        F.count(F.lit(1)).cast("long").alias("count"),
        F.count_if(p == 1).alias("pp"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(*by, group, "count",
                    _r(_div0(F.col("pp"), F.col("count"))).alias("positive_rate"),
                    _r(_div0(tp, tp + fn)).alias("tpr"), _r(_div0(fp, fp + tn)).alias("fpr"),
                    _r(_div0(tp, tp + fp)).alias("precision"))


def parity_gaps(rates: DataFrame, by=("model",)) -> DataFrame:
    """Per model and criterion: gap = max - min across groups, ratio = min / max (NULL if
    max is 0)."""
    stacked = rates.select(*by, F.explode(F.array(*[
        F.struct(F.lit(name).alias("criterion"), F.col(m).alias("v")) for m, name in METRICS])).alias("s")
    ).select(*by, "s.*")
    g = stacked.groupBy(*by, "criterion").agg(F.max("v").alias("mx"), F.min("v").alias("mn"))
    return g.select(*by, "criterion", _r(F.col("mx") - F.col("mn")).alias("gap"),
                    _r(F.when(F.col("mx") > 0, F.col("mn") / F.col("mx"))).alias("ratio"))


def disparity_gap(df: DataFrame, g1: str, g2: str, by=("model",), group: str = "grp",
                  score: str = "proba") -> DataFrame:
    """|mean score in g1 - mean score in g2| per model."""
    s = F.col(score)
    g = df.groupBy(*by).agg(F.avg(F.when(F.col(group) == g1, s)).alias("m1"),
                            F.avg(F.when(F.col(group) == g2, s)).alias("m2"))
    return g.select(*by, _r(F.col("m1")).alias("mean_g1"), _r(F.col("m2")).alias("mean_g2"),
                    _r(F.abs(F.col("m1") - F.col("m2"))).alias("disparity_gap"))


def bias_amplification(df: DataFrame, g1: str, g2: str, by=("model",), group: str = "grp") -> DataFrame:
    """Own definition (no formula is published): the predicted positive-rate gap between g1
    and g2 divided by the true positive-rate gap; NULL when the true gap is 0."""
    g = df.groupBy(*by).agg(
        F.avg(F.when(F.col(group) == g1, F.col("y_pred").cast("double"))).alias("pp1"),
        F.avg(F.when(F.col(group) == g2, F.col("y_pred").cast("double"))).alias("pp2"),
        F.avg(F.when(F.col(group) == g1, F.col("y_true").cast("double"))).alias("tp1"),
        F.avg(F.when(F.col(group) == g2, F.col("y_true").cast("double"))).alias("tp2"))
    pred_gap = F.col("pp1") - F.col("pp2")
    true_gap = F.col("tp1") - F.col("tp2")
    return g.select(*by, _r(pred_gap).alias("pred_gap"), _r(true_gap).alias("true_gap"),
                    _r(F.when(true_gap != 0, pred_gap / true_gap)).alias("amplification"))


def gender_group(docs: DataFrame, text: str = "text", key: str = "doc_id", pairs=L.GENDER_PAIRS) -> DataFrame:
    """``male`` / ``female`` by the majority of gendered words of each side; NULL on a tie
    (including no gendered word). Row-local array work, no shuffle."""
    male, female = L.gender_sides(pairs)
    toks = TX.word_tokens(text)
    mw, fw = TX.literal_array(male), TX.literal_array(female)
    m = F.size(F.filter(toks, lambda t: F.array_contains(mw, t)))
    f = F.size(F.filter(toks, lambda t: F.array_contains(fw, t)))
    return docs.select(key, m.alias("male_words"), f.alias("female_words")).select(
        key, "male_words", "female_words",
        F.when(F.col("male_words") > F.col("female_words"), "male")
        .when(F.col("female_words") > F.col("male_words"), "female").alias("grp"))
