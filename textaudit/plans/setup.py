"""Shared inputs of the registered queries: the rule scorers, the predictions table built
from ``documents`` + ``labels``, and the matching SQL fragments for the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import RuleModel, build_predictions
from ..session import ensure_checkpoint_dir
from ..sources.tables import Tables

# Scorers of the audit queries: each is a column expression over the word tokens.
MODELS = [
    RuleModel("rule_a", ("the", "of", "and", "to", "in", "he"), -2.0, 10.0),
    RuleModel("rule_b", ("is", "was", "are", "that", "it", "be", "de", "la", "der"), -1.5, 12.0),
    RuleModel("rule_c", ("for", "on", "with", "as", "by", "en", "et", "und", "he"), -1.0, 9.0),
]
REFERENCE = "rule_a"
THRESHOLD = 0.5
GROUP_COL = "lang"
GROUP_A, GROUP_B = "en", "fr"
SEED = 42


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return Tables(spark, sf_dir)


_PREDICTIONS: dict[tuple[str, str], str] = {}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, grp, dataset, model, y_true, y_pred, proba)``; truth = ``labels.toxic``,
    group = ``documents.lang``, dataset = ``documents.source``.

    Every evaluation query reads this one table: it is scored once a session and corpus, and
    written to the shared checkpoint folder, where no lost executor can take it along."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PREDICTIONS:
        t = tables(spark, sf_dir)
        docs = t.documents.select("doc_id", "text", F.col(GROUP_COL).alias("grp"), F.col("source").alias("dataset"))
        preds = build_predictions(docs, t.labels, MODELS, truth_col="toxic", keep=("grp", "dataset"), threshold=THRESHOLD)
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/textaudit-scored-{uuid.uuid4().hex}"
        preds.write.parquet(path)
        _PREDICTIONS[key] = path
    return spark.read.parquet(_PREDICTIONS[key])


def release_predictions(spark: SparkSession, sf_dir: str) -> None:
    """Forget the scored table of ``sf_dir``: the next query scores again."""
    _PREDICTIONS.pop((spark.sparkContext.applicationId, sf_dir), None)


# --- SQL fragments ----------------------------------------------------------------------

WORD_SQL = r"'[\p{L}\p{N}_]+'"


def sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def sql_proba(m: RuleModel, toks: str = "t") -> str:
    hits = f"len(list_filter({toks}, lambda w: w IN {sql_list(m.words)}))"
    x = f"(CAST({m.intercept!r} AS DOUBLE) + CAST({m.slope!r} AS DOUBLE) * {hits} / greatest(len({toks}), 1))"
    return f"(1.0 / (1.0 + exp(-{x})))"


def sql_predictions_ctes() -> str:
    """CTEs ``tok``, ``wide``, ``preds`` mirroring :func:`predictions`."""
    wide_cols = ", ".join(f"{sql_proba(m)} AS {m.name}" for m in MODELS)
    longs = " UNION ALL ".join(
        f"SELECT doc_id, grp, dataset, '{m.name}' AS model, {m.name} AS proba FROM wide" for m in MODELS)
    return f"""
tok AS (SELECT doc_id, {GROUP_COL} AS grp, source AS dataset, regexp_extract_all(lower(coalesce(text, '')), {WORD_SQL}) AS t FROM documents),
wide AS (SELECT doc_id, grp, dataset, {wide_cols} FROM tok),
longp AS ({longs}),
preds AS (SELECT p.doc_id, p.grp, p.dataset, p.model, CAST(l.toxic AS INTEGER) AS y_true,
                 CAST(p.proba >= {THRESHOLD} AS INTEGER) AS y_pred, p.proba
          FROM longp p JOIN labels l ON p.doc_id = l.doc_id)"""
