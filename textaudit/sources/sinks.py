"""Sinks: splits, predictions, metrics, reports, comparison tables, label maps.

All writes are distributed (``df.write``); nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Options of CSV files here: what these sinks write, ``read_csv`` reads back unchanged (quotes
#: doubled, line breaks inside quotes, NULL an empty field, empty text a quoted one).
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CSV_WRITE = CSV_OPTIONS | {"nullValue": "", "emptyValue": '""'}
#: A reader turns empty fields into its ``nullValue``, and that into NULL; no text equals this one.
CSV_READ = CSV_OPTIONS | {"multiLine": "true", "nullValue": "\u0000", "emptyValue": ""}


def _writer(df: DataFrame, fmt: str):
    w = df.write.mode("overwrite").format(fmt)
    return w.options(**CSV_WRITE) if fmt == "csv" else w


def write_splits(train: DataFrame, val: DataFrame, test: DataFrame, path: str,
                 fmt: str = "parquet", minimal_cols=("text", "label")) -> None:
    """Held-out keeps every column; train/val keep the minimal projection. Parquet: one table
    partitioned by ``split``, so readers prune to the split they need. CSV: a file set for each
    split (``train.csv``, ``val.csv``, ``test.csv``, with headers), as :func:`read_splits` reads."""
    cols = list(minimal_cols)
    if fmt == "csv":
        for name, df in (("train", train.select(*cols)), ("val", val.select(*cols)), ("test", test)):
            _writer(df, fmt).save(f"{path.rstrip('/')}/{name}.csv")
        return
    parts = (train.select(*cols).withColumn("split", F.lit("train"))
             .unionByName(val.select(*cols).withColumn("split", F.lit("val")))
             .unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True))
    parts.write.mode("overwrite").partitionBy("split").format(fmt).save(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    _writer(df, fmt).save(path)


def write_predictions(preds: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Per-row predictions, partitioned by model so each model's file set is prunable."""
    preds.write.mode("overwrite").partitionBy("model").format(fmt).save(path)


def write_metrics_json(metrics: DataFrame, path: str) -> None:
    """One JSON object per model / dataset row."""
    metrics.write.mode("overwrite").json(path)


def write_label_map(labels: list[str], spark, path: str) -> None:
    """Index -> class-name table (small by construction: one row per class)."""
    spark.createDataFrame(list(enumerate(labels)), "index INT, label STRING") \
        .write.mode("overwrite").parquet(path)


def write_example_lines(rows: DataFrame, path: str, order, per_line: int = 1000) -> None:
    """Examples ``(bank, category, text)`` as JSON lines: each holds up to ``per_line`` consecutive
    texts of a list and the number of the first. Texts stand by ``order`` (then by text), ranked
    by ranges, so neither a list nor the bank is gathered anywhere."""
    from ..operators.ranks import range_rank
    told = rows.withColumn("_row", F.monotonically_increasing_id())
    ranked = range_rank(told, ["bank", "category"], [*[F.col(c) for c in order], F.col("text"), F.col("_row")], "ord")
    lines = ranked.groupBy("bank", "category", F.expr(f"ord div {per_line}").alias("line")).agg(
        F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("own"))
    lines.select("bank", "category", F.col("own")[0]["ord"].alias("first"), F.transform("own", lambda x: x["text"]).alias("texts")).write.mode("overwrite").json(path)
