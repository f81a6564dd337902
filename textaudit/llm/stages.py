"""Stages of the corpus pipeline: ``(spark, docs, sf_dir) -> documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, mixing, pii
from .decontaminate import decontaminate, without_spans
from .frames import documents, pick, save
from .simhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Lift of a text's best language over equal shares. A text that no language tells apart, as
#: in an unlearned script, has none; short texts of a known language pass.
LEAST_LIFT = 1.1


def _own(docs: DataFrame) -> DataFrame:
    """The columns of documents, of whatever columns there are."""
    return pick(docs, **{c: c for c in COLUMNS})


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose best language stands out from equal shares; where the
    table has no language, the told one."""
    docs = _own(docs)
    model = language.learn(docs.where(F.col("doc_id").isNotNull() & ~language.fold(F.col("doc_id"))))
    told = language.predict(docs, model, keep=COLUMNS)
    least = min(1.0, LEAST_LIFT / max(1, len(model.langs)))
    kept = told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= least))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component one row: the smallest id's (a row without an id comes
    last), of rows that share it the first by a hash of their texts. Rows are told apart by
    numbers of their own, so different texts under one id are judged each by itself."""
    rows = save(_own(docs).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.withColumn("_hash", F.xxhash64("text")), keep=["_row", "_hash"])
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")
    stays = found.groupBy("root").agg(F.min(place).alias("first")).select(F.col("first._row").alias("_row"))
    return rows.join(stays, "_row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the passages that stand in the benchmark cut out of its text."""
    found = decontaminate(_own(docs), documents(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return _rewritten(found.withColumn("_text", without_spans(F.col("text"), F.col("spans"))))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each span of personal data replaced by its kind."""
    found = pii.find(_own(docs), keep=COLUMNS)
    return _rewritten(found.withColumn("_text", pii.redacted(F.col("text"), F.col("spans"))))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents such that every source has the same share, in shuffled order."""
    return mixing.mix(_own(docs))


def _rewritten(found: DataFrame) -> DataFrame:
    changed = F.size("spans") > 0
    return found.select("doc_id", F.col("_text").alias("text"), "lang", "source",
                        F.when(changed, F.length("_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing sources to target weights", mixing_sources),
]
