"""File scans: headered CSV, split triples, prediction files, the example bank, embeddings.

Schemas are declared (or resolved once by name) at the source; no type inference on the
data path. Column checks look only at ``df.columns`` (no action).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import lexicons as L
from ..operators import schema as S
from .sinks import CSV_READ


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Headered CSV with quoted multi-line fields. Without a schema every column is a string
    (cast later with the coercion operators) instead of an inference pass over the data. A
    multi-line file is one task, so a table comes as many files; convert it to Parquet once."""
    r = spark.read.options(**CSV_READ)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that its scheme names (not only a local one)."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)


def read_splits(spark: SparkSession, base: str, names=("train", "val", "test"),
                pattern: str = "{base}/{name}.csv", reader=None) -> dict[str, DataFrame]:
    """Three-split scan; fails naming every missing split before any read."""
    paths = {n: pattern.format(base=base.rstrip("/"), name=n) for n in names}
    missing = [p for p in paths.values() if not exists(spark, p)]
    if missing:
        raise FileNotFoundError(f"missing split files: {missing}")
    reader = reader or (lambda p: read_csv(spark, p))
    return {n: reader(p) for n, p in paths.items()}


def read_splits_partitioned(spark: SparkSession, path: str, split_col: str = "split") -> dict[str, DataFrame]:
    """One table written with ``partitionBy(split)``: each split is a pruned partition read."""
    df = spark.read.parquet(path)
    names = ["train", "val", "test"]
    return {n: df.where(F.col(split_col) == n).drop(split_col) for n in names}


def read_with_required(spark: SparkSession, path: str, text_col: str = "text",
                       label_col: str = "label") -> DataFrame:
    """CSV scan that names the missing required columns."""
    df = read_csv(spark, path)
    S.require_columns(df, [text_col, label_col])
    return df


def read_predictions(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Prediction file -> ``(y_pred INT, proba DOUBLE NULL[, key])``.

    The prediction column is the first candidate name present; else the only column whose
    non-null values are all 0/1 (one aggregate over the file). The probability column is
    optional. A prediction that is no number is an error when the rows are read, as it would
    silently leave the confusion counts; a probability that is none is NULL."""
    df = read_csv(spark, path)
    pred = S.first_match(df.columns, L.PREDICTION_CANDIDATES)
    if pred is None:
        binary = S.binary_columns(df)
        if len(binary) != 1:
            raise ValueError(f"cannot identify the prediction column; binary columns: {binary}")
        pred = binary[0]
    proba = S.first_match(df.columns, L.PROBA_CANDIDATES)
    value = F.expr(f"try_cast(`{pred}` as double)")
    told = F.when(F.lower(F.col(f"`{pred}`")) == "true", 1.0).when(F.lower(F.col(f"`{pred}`")) == "false", 0.0)
    wrong = F.raise_error(F.concat(F.lit("not a prediction: "), F.coalesce(F.col(f"`{pred}`"), F.lit("empty")))).cast("double")
    cols = [F.coalesce(value, told, wrong).cast("int").alias("y_pred"),
            (F.expr(f"try_cast(`{proba}` as double)") if proba else F.lit(None).cast("double")).alias("proba")]
    if key:
        cols = [F.col(key)] + cols
    return df.select(*cols)


EXAMPLE_BANK_SCHEMA = T.StructType([
    T.StructField("biased_examples", T.ArrayType(T.StringType())),
    T.StructField("neutral_examples", T.ArrayType(T.StringType())),
    T.StructField("stereotype_categories", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
])


def read_example_bank(spark: SparkSession, path: str) -> DataFrame:
    """JSON example bank -> ``(bank, category, ord, text)`` rows.

    ``bank`` is ``biased`` / ``neutral`` for the flat lists and ``category`` for the map."""
    raw = spark.read.schema(EXAMPLE_BANK_SCHEMA).option("multiLine", True).json(path)
    flat = (raw.select(F.posexplode("biased_examples").alias("ord", "text"))
            .select(F.lit("biased").alias("bank"), F.lit(None).cast("string").alias("category"), "ord", "text")
            .unionByName(raw.select(F.posexplode("neutral_examples").alias("ord", "text"))
                         .select(F.lit("neutral").alias("bank"), F.lit(None).cast("string").alias("category"), "ord", "text")))
    cats = (raw.select(F.explode("stereotype_categories").alias("category", "texts"))
            .select(F.lit("category").alias("bank"), "category", F.posexplode("texts").alias("ord", "text")))
    return flat.unionByName(cats)


def read_example_lines(spark: SparkSession, path: str) -> DataFrame:
    """An example bank in lines (``write_example_lines``) -> ``(bank, category, ord, text)`` rows.
    Each line holds some consecutive texts of a list, so any number of tasks read it."""
    lines = spark.read.schema("bank STRING, category STRING, first BIGINT, texts ARRAY<STRING>").json(path)
    each = lines.select("bank", "category", "first", F.posexplode("texts").alias("i", "text"))
    return each.select("bank", "category", (F.col("first") + F.col("i")).cast("int").alias("ord"), "text")


def read_embeddings(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """First available embedding table ``(word STRING, vec ARRAY<FLOAT>)`` among candidates."""
    for p in candidates:
        if exists(spark, p):
            return spark.read.parquet(p)
    raise FileNotFoundError(f"no embedding table among {candidates}")
