"""Classification metrics as one-pass conditional aggregates over a long predictions table
``(doc_id, model, y_true INT, y_pred INT, proba DOUBLE NULL)``.

Every metric is a ``groupBy(by)`` with map-side partial aggregation: the shuffle carries one
small row per (partition, group), whatever the number of documents. Undefined precision,
recall and F1 are 0 (zero-division rule); undefined AUC is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import RANGE_ROWS, range_prefix

DIGITS = 6
#: Labels of a confusion matrix, whose grid is their square.
MAX_LABELS = 1_000


def _r(c):
    return F.round(c, DIGITS)


def _div0(num, den):
    """num/den, 0 when den is 0 (zero-division rule for P/R/F1)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _cnt(cond):
    return F.count_if(cond).cast("long")


def value_counts(df: DataFrame, by=("label",)) -> DataFrame:
    """Rows per value (label distribution)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(df: DataFrame, by=("model",)) -> DataFrame:
    """tp/fp/fn/tn and n per group (binary, positive class 1)."""
    y, p = F.col("y_true"), F.col("y_pred")
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        _cnt((y == 1) & (p == 1)).alias("tp"),
        _cnt((y == 0) & (p == 1)).alias("fp"),
        _cnt((y == 1) & (p == 0)).alias("fn"),
        _cnt((y == 0) & (p == 0)).alias("tn"),
    )


def confusion_matrix(df: DataFrame, by=("model",), labels=None) -> DataFrame:
    """Long confusion matrix ``(by..., y_true, y_pred, n)`` with every label pair present
    (missing cells are 0). Labels default to those seen in truth or prediction."""
    counts = df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    if labels is None:
        # one value per class; a column of ids is refused
        seen = (df.select(F.col("y_true").alias("c")).union(df.select(F.col("y_pred").alias("c")))
                .where(F.col("c").isNotNull()).distinct().limit(MAX_LABELS + 1).collect())
        if len(seen) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels: not a class column")
        labels = sorted(int(r["c"]) for r in seen)
    each = lambda name: F.explode(F.array(*[F.lit(int(a)) for a in labels]).cast("array<int>")).alias(name)
    grid = df.select(*by).distinct().select(*by, each("y_true")).select("*", each("y_pred"))
    return (grid.join(counts, [*by, "y_true", "y_pred"], "left")
            .select(*by, "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_wide(df: DataFrame, by=("model",), labels=(0, 1)) -> DataFrame:
    """Heat-map form: one row per (group, true label), one column per predicted label."""
    long = confusion_matrix(df, by, labels)
    return (long.groupBy(*by, "y_true").pivot("y_pred", list(labels)).agg(F.first("n"))
            .select(*by, "y_true", *[F.col(str(l)).alias(f"pred_{l}") for l in labels]))


def binary_metrics(df: DataFrame, by=("model",)) -> DataFrame:
    """Accuracy, precision, recall, F1 of class 1, with the confusion counts."""
    c = confusion_counts(df, by)
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    return c.select(
        *by, "n", "tp", "fp", "fn", "tn",
        _r(_div0(tp + tn, n)).alias("accuracy"),
        _r(_div0(tp, tp + fp)).alias("precision"),
        _r(_div0(tp, tp + fn)).alias("recall"),
        _r(_div0(2 * tp, 2 * tp + fp + fn)).alias("f1"),
    )


def per_class(df: DataFrame, by=("model",)) -> DataFrame:
    """Per class (union of labels in truth and prediction): support, predicted, tp, P/R/F1.

    Each row contributes to its true class and to its predicted class; the aggregate is
    partial per partition, so the shuffle carries one row per (partition, group, class)."""
    roles = F.explode(F.array(
        F.struct(F.col("y_true").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"),
                 (F.col("y_true") == F.col("y_pred")).cast("int").alias("hit")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")),
    )).alias("r")
    g = (df.select(*by, roles).select(*by, "r.*").where(F.col("cls").isNotNull())
         .groupBy(*by, "cls").agg(F.sum("t").cast("long").alias("support"),
                                  F.sum("p").cast("long").alias("predicted"),
                                  F.sum("hit").cast("long").alias("tp")))
    tp, sup, pred = F.col("tp"), F.col("support"), F.col("predicted")
    return g.select(*by, "cls", "support", "predicted", "tp",
                    _div0(tp, pred).alias("precision"), _div0(tp, sup).alias("recall"),
                    _div0(2 * tp, sup + pred).alias("f1"))


def averaged_metrics(df: DataFrame, by=("model",), pc: DataFrame | None = None) -> DataFrame:
    """Macro and support-weighted P/R/F1 per group, plus accuracy (from the per-class table,
    which is computed once and can be passed in)."""
    pc = per_class(df, by) if pc is None else pc
    s = F.col("support")
    return pc.groupBy(*by).agg(
        _r(F.avg("precision")).alias("macro_precision"),
        _r(F.avg("recall")).alias("macro_recall"),
        _r(F.avg("f1")).alias("macro_f1"),
        _r(F.try_divide(F.sum(F.col("precision") * s), F.sum(s))).alias("weighted_precision"),
        _r(F.try_divide(F.sum(F.col("recall") * s), F.sum(s))).alias("weighted_recall"),
        _r(F.try_divide(F.sum(F.col("f1") * s), F.sum(s))).alias("weighted_f1"),
        _r(F.try_divide(F.sum("tp"), F.sum(s))).alias("accuracy"),
        F.sum(s).cast("long").alias("total_support"),
    )


def classification_report(df: DataFrame, by=("model",)) -> DataFrame:
    """Tidy report rows: one per class, then ``accuracy`` (in ``value``), ``macro avg``,
    ``weighted avg``. Columns: by..., label, precision, recall, f1_score, support, value."""
    pc = per_class(df, by)
    av = averaged_metrics(df, by, pc)
    cls_rows = pc.select(*by, F.col("cls").cast("string").alias("label"), _r(F.col("precision")).alias("precision"),
                         _r(F.col("recall")).alias("recall"), _r(F.col("f1")).alias("f1_score"),
                         F.col("support").cast("long").alias("support"), F.lit(None).cast("double").alias("value"))
    nul = F.lit(None).cast("double")

    def row(label, p, r, f, sup, val):
        return F.struct(F.lit(label).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"),
                        sup.cast("long").alias("support"), val.alias("value"))

    # the three summary rows of a group come from one pass over the averages
    summary = av.select(*by, F.explode(F.array(
        row("accuracy", nul, nul, nul, F.lit(None), F.col("accuracy")),
        row("macro avg", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1"),
            F.col("total_support"), nul),
        row("weighted avg", F.col("weighted_precision"), F.col("weighted_recall"), F.col("weighted_f1"),
            F.col("total_support"), nul))).alias("r")).select(*by, "r.*")
    return cls_rows.unionByName(summary)


def report_wide(df: DataFrame, by=("model",), classes=(0, 1)) -> DataFrame:
    """One row per group: accuracy, F1 of class 1, per-class P/R/F1/support, macro and
    weighted averages, total support. An absent class has NULL metrics and support 0.
    Everything derives from one per-class aggregate."""
    pc = per_class(df, by)
    av = averaged_metrics(df, by, pc)
    aggs = []
    for k in classes:
        hit = F.col("cls") == k
        aggs += [F.max(F.when(hit, _r(F.col("precision")))).alias(f"precision_{k}"),
                 F.max(F.when(hit, _r(F.col("recall")))).alias(f"recall_{k}"),
                 F.max(F.when(hit, _r(F.col("f1")))).alias(f"f1_{k}"),
                 F.coalesce(F.max(F.when(hit, F.col("support"))), F.lit(0)).cast("long").alias(f"support_{k}")]
    # binary F1 of class 1 (0 when class 1 is absent from truth and prediction)
    aggs.append(F.coalesce(F.max(F.when(F.col("cls") == 1, _r(F.col("f1")))), F.lit(0.0)).alias("f1_score"))
    wide = pc.groupBy(*by).agg(*aggs)
    cols = [*by, "accuracy", "f1_score"]
    for k in classes:
        cols += [f"precision_{k}", f"recall_{k}", f"f1_{k}", f"support_{k}"]
    cols += ["macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall",
             "weighted_f1", "total_support"]
    return av.join(wide, list(by)).select(*cols)


def score_histogram(df: DataFrame, by=("model",), score: str = "proba") -> DataFrame:
    """(group, score, pos, neg): counts per distinct score, exactly as scored."""
    return (df.where(F.col(score).isNotNull() & F.col("y_true").isNotNull())
            .groupBy(*by, F.col(score).alias("score"))
            .agg(F.sum((F.col("y_true") == 1).cast("long")).alias("pos"),
                 F.sum((F.col("y_true") != 1).cast("long")).alias("neg")))


def ranked_scores(df: DataFrame, by=("model",), score: str = "proba", ranges: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The histogram with ``pos_above`` and ``neg_above``, the counts at strictly higher scores.

    A group can have as many distinct scores as rows, so the sums are taken by ranges of the
    counted scores, of about ``range_rows`` scores at any size and for any shape of scores."""
    return range_prefix(score_histogram(df, by, score), by, [F.col("score").desc()], {"pos_above": F.col("pos"), "neg_above": F.col("neg")},
                        range_rows, ranges)


def roc_auc(df: DataFrame, by=("model",), score: str = "proba") -> DataFrame:
    """Rank-statistic AUC (ties get half credit); NULL when a class is absent.

    AUC = sum(neg_i * (pos strictly above_i + pos_i / 2)) / (P * N) over the histogram."""
    agg = ranked_scores(df, by, score).groupBy(*by).agg(
        F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)).alias("u"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return agg.select(*by, _r(F.when((F.col("P") > 0) & (F.col("N") > 0),
                                     F.col("u") / (F.col("P") * F.col("N"))))
                      .alias("roc_auc"))


def curve_points(df: DataFrame, by=("model",), score: str = "proba") -> DataFrame:
    """ROC and precision-recall points, one per distinct threshold (predict 1 if score >= t)."""
    h = ranked_scores(df, by, score).withColumns({"tp": F.col("pos_above") + F.col("pos"), "fp": F.col("neg_above") + F.col("neg")})
    # the group's totals are those of its lowest threshold: no second pass over the scores
    total = h.groupBy(*by).agg(F.max("tp").alias("P"), F.max("fp").alias("N"))
    h = h.join(total, list(by))
    return h.select(
        *by, _r(F.col("score")).alias("threshold"), F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        _r(F.try_divide(F.col("tp").cast("double"), F.col("P"))).alias("tpr"),
        _r(F.try_divide(F.col("fp").cast("double"), F.col("N"))).alias("fpr"),
        _r(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))).alias("precision"),
        _r(F.try_divide(F.col("tp").cast("double"), F.col("P"))).alias("recall"),
    )


def model_metrics(df: DataFrame, by=("model",)) -> DataFrame:
    """Accuracy, precision, recall, F1 and ROC-AUC per group (the per-model summary row)."""
    bm = binary_metrics(df, by).select(*by, "accuracy", "precision", "recall", "f1")
    return bm.join(roc_auc(df, by), list(by), "left")
