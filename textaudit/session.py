"""Session helpers: a tuned builder for local runs, shared checkpoint folder, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "textaudit") -> SparkSession:
    """Session for tests and benchmarks. On a cluster, use the cluster's session instead."""
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.default.parallelism", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TEXTAUDIT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    share_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the cluster's configuration and must be shared storage:
    there, an unset folder is an error. Only a session whose executors run inside the driver
    (``local[*]``, as in tests) gets a scratch folder of its own.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote session: the server side owns the folder
        return cur
    cur = cur or sc.getCheckpointDir()
    if not cur:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cur = tempfile.mkdtemp(prefix="textaudit-local-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(cur)
    return cur


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did (a local session, or a
    cluster that mounts the folder; elsewhere the package is installed or sent with the job)."""
    try:
        env = spark.sparkContext.environment
    except Exception:  # noqa: BLE001 - remote session
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def saved_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared checkpoint folder, and read back from there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/textaudit-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss).

    The frame is persisted while the checkpoint is written, so the write reads the computed
    partitions instead of recomputing the whole plan a second time."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out
