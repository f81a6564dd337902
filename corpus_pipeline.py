"""Corpus pipeline: stages over ``documents``, each a row-keeping or row-dropping step that
calls one operator of ``textaudit.llm``; every stage's result is written as Parquet and reread
as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textaudit.llm.frames import documents, lasting, release, save, scratch
from textaudit.llm.stages import STAGES

#: The stages fit models and cut texts in ways that SQL cannot state; tests compare with brute force.
ORACLE_SQL = None

__all__ = ["STAGES", "ORACLE_SQL", "run"]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table. A stage's own tables and its input go when its result is written."""
    docs, last = documents(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        with scratch():
            docs = lasting(save(stage(spark, docs, sf_dir), f"stage{i + 1}"))
        if last is not None:
            release(last)
        last = docs
    return docs
