"""Parquet tables of a corpus directory (one ``<name>.parquet`` per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
# Tables whose rows carry whole texts: per-row CPU work (tokenising, rewriting) is large
# compared to their bytes, so a scan with fewer splits than cores is spread out.
TEXT_TABLES = {"documents", "conversations", "benchmark", "pages"}


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """In a local session, round-robin a scan over the cores when it has fewer input splits
    (a test file is one row group, hence one task). On a cluster nothing is shuffled: there the
    split size of the scan (``spark.sql.files.maxPartitionBytes``) sets the parallelism."""
    try:
        sc = df.sparkSession.sparkContext
        if not sc.master.startswith("local["):
            return df
        cores, splits = sc.defaultParallelism, df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the plan as is
        return df
    return df if splits >= cores else df.repartition(cores)


class Tables:
    """Lazy accessor: ``Tables(spark, dir).documents``."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self.spark = spark
        self.base_dir = base_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = read_table(self.spark, self.base_dir, name)
            return spread(df) if name in TEXT_TABLES else df
        raise AttributeError(name)
