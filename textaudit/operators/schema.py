"""Projections, filters and schema resolution (column names are decided on the driver from
``df.columns``; data-dependent checks are single aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as TX


def first_match(columns, candidates) -> str | None:
    """First candidate (in candidate order) present among ``columns``."""
    present = set(columns)
    for c in candidates:
        if c in present:
            return c
    return None


def require_columns(df: DataFrame, required) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}; available: {df.columns}")


def is_binary_value(c):
    """Whether a non-null value reads as 0 or 1: numbers, booleans, and their text forms (as a
    file without a schema has them). NULL for NULL."""
    text = F.lower(F.trim(c.cast("string")))
    return text.isin("true", "false") | F.coalesce(text.try_cast("double").isin(0.0, 1.0), F.lit(False))


def _all_binary(c: str):
    return F.coalesce(F.bool_and(is_binary_value(F.col(f"`{c}`"))), F.lit(True))


def column_profile(df: DataFrame, columns=None) -> DataFrame:
    """Per column: exact number of distinct values, and whether all non-null values are 0/1.
    One grouped pass; every column is counted, whatever its cardinality."""
    columns = list(columns or df.columns)
    row = df.agg(*[F.countDistinct(F.col(f"`{c}`")).cast("long").alias(f"d_{i}") for i, c in enumerate(columns)],
                 *[_all_binary(c).alias(f"b_{i}") for i, c in enumerate(columns)])
    parts = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"d_{i}").alias("n_distinct"),
                      F.col(f"b_{i}").alias("is_binary")) for i, c in enumerate(columns)]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")


def few_valued(df: DataFrame, columns, most: int) -> dict[str, int | None]:
    """Distinct non-null values of each column, or None where there are ``most`` or more.

    A task keeps a set of at most ``most`` values a column and stops there, so that at most that
    many a column and task are shuffled (values as text, long ones by a digest), not all values."""
    columns = list(columns)
    own = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])

    def run(batches):
        import hashlib

        import pyarrow as pa
        seen = [set() for _ in columns]
        for batch in batches:
            for i, s in enumerate(seen):
                if len(s) < most:
                    for v in batch.column(i).unique().to_pylist():
                        if v is not None and len(s) < most:
                            s.add(v if len(v) <= 64 else hashlib.sha256(v.encode()).hexdigest() + str(len(v)))
        pairs = [(i, v) for i, s in enumerate(seen) for v in s]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()), pa.array([v for _, v in pairs], pa.string())], names=["i", "v"])

    counts = {r["i"]: r["n"] for r in own.mapInArrow(run, "i int, v string").groupBy("i").agg(F.countDistinct("v").alias("n")).collect()}
    return {c: n if (n := counts.get(i, 0)) < most else None for i, c in enumerate(columns)}


def binary_columns(df: DataFrame) -> list[str]:
    """Columns whose non-null values are all 0/1 (one aggregate; the probe of
    :func:`column_profile`)."""
    row = df.agg(*[_all_binary(c).alias(f"b_{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[i]]


def loose_resolve(df: DataFrame) -> tuple[str, str]:
    """Case-insensitive name match in table order, then the last-resort name as spelled; else
    the first non-text column with fewer than 50 distinct values."""
    text = next((c for c in df.columns if c.lower() in L.LOOSE_TEXT_NAMES), None)
    label = next((c for c in df.columns if c.lower() in L.LOOSE_LABEL_NAMES), None)
    if text is None:
        raise ValueError(f"no text column among {df.columns}")
    if label is None and L.LOOSE_LABEL_LAST in df.columns:
        label = L.LOOSE_LABEL_LAST
    if label is None:
        few = few_valued(df, [c for c in df.columns if c != text], L.LOOSE_MAX_DISTINCT)
        label = next((c for c, n in few.items() if n is not None), None)
    if label is None:
        raise ValueError(f"no label column among {df.columns}")
    return text, label


def canonical_rename(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    out = df
    if text_col != "text":
        out = out.drop("text") if "text" in out.columns else out
        out = out.withColumnRenamed(text_col, "text")
    if label_col != "label":
        out = out.drop("label") if "label" in out.columns else out
        out = out.withColumnRenamed(label_col, "label")
    return out


def coerce_label(c, fill: int | None = 0):
    """To number, bad values -> NULL, NULL -> ``fill`` (unless None), truncated to int."""
    num = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")
    if fill is not None:
        num = F.coalesce(num, F.lit(float(fill)))
    return num.cast("int")


def label_missing_count(df: DataFrame, c: str) -> DataFrame:
    """Number of labels that coercion turns into NULL."""
    return df.agg(F.count_if(F.expr(f"try_cast({c} as double)").isNull()).cast("long").alias("n_missing"))


def coerce_text(c, missing: str = "empty"):
    """NULL text -> '' (``missing='empty'``) or kept NULL for a later drop; always stripped."""
    t = F.col(c) if isinstance(c, str) else c
    if missing == "empty":
        t = F.coalesce(t, F.lit(""))
    return TX.strip_space(t)


def pad_columns(df: DataFrame, columns, types: dict | None = None) -> DataFrame:
    """Add absent columns as typed NULLs."""
    types = types or {}
    out = df
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(types.get(c, "string")))
    return out


def tag_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))


def fill_from(df: DataFrame, target: str, fallback: str) -> DataFrame:
    """``target := coalesce(target, fallback)`` as int."""
    return df.withColumn(target, F.coalesce(F.col(target).cast("double"), F.col(fallback).cast("double")).cast("int"))


def drop_incomplete(df: DataFrame, required=("text", "label"), by: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows with all required fields, and the per-source count of the rejected rows."""
    bad = None
    for c in required:
        cond = F.col(c).isNull()
        bad = cond if bad is None else (bad | cond)
    kept = df.where(~bad)
    report = df.where(bad).groupBy(by).agg(F.count(F.lit(1)).alias("n_dropped"))
    return kept, report


def minimal_projection(df: DataFrame, key: str | None = "doc_id") -> DataFrame:
    cols = ([F.col(key)] if key and key in df.columns else []) + [
        F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label")]
    return df.select(*cols)


def threshold_class(proba, threshold: float = 0.5, positive: str = "BIASED", negative: str = "NEUTRAL"):
    """Strict ``>`` for the class name; confidence = max(p, 1-p)."""
    p = F.col(proba) if isinstance(proba, str) else proba
    return (F.when(p > threshold, F.lit(positive)).otherwise(F.lit(negative)),
            F.greatest(p, F.lit(1.0) - p))


def decide(proba, threshold: float = 0.5):
    """``y_pred = (p >= threshold)`` as int."""
    p = F.col(proba) if isinstance(proba, str) else proba
    return (p >= F.lit(threshold)).cast("int")


def gendered_flag(tokens, words) -> F.Column:
    """True when the token array contains any lexicon word."""
    return F.arrays_overlap(tokens, TX.literal_array(sorted(set(words))))


def select_metrics(df: DataFrame, cols) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])
