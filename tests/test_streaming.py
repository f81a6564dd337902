import shutil

from textaudit.plans import monitoring as PM
from textaudit.streaming import monitor as MO

from locations import SF_SMALL


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(f"{SF_SMALL}/events.parquet", src / "part-0.parquet")
    batch = spark.read.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    q = (MO.stream_shadow_divergence(stream, PM.PRIMARY, PM.SHADOW, PM.SAMPLE_PERCENT)
         .writeStream.outputMode("complete").format("memory").queryName("shadow_test")
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r["day"], r["n_sampled"], r["n_disagree"]) for r in spark.table("shadow_test").collect()}
    exp = {(r["day"], r["n_sampled"], r["n_disagree"])
           for r in MO.shadow_divergence(batch, PM.PRIMARY, PM.SHADOW, PM.SAMPLE_PERCENT).collect()}
    assert got == exp and len(got) > 0


def test_stream_threshold_audit_and_bins(spark, tmp_path):
    from pyspark.sql import functions as F
    src = tmp_path / "events"
    src.mkdir()
    shutil.copy(f"{SF_SMALL}/events.parquet", src / "part-0.parquet")
    batch = spark.read.parquet(str(src))
    stream = spark.readStream.schema(batch.schema).parquet(str(src))
    truth = F.col("event_type") == "purchase"
    q = (MO.stream_threshold_audit(stream, PM.PRIMARY, truth, PM.AUDIT_THRESHOLDS)
         .writeStream.outputMode("complete").format("memory").queryName("audit_test")
         .option("checkpointLocation", str(tmp_path / "ck1")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("audit_test").collect()}
    exp = {tuple(r) for r in MO.threshold_audit(batch, PM.PRIMARY, truth, PM.AUDIT_THRESHOLDS).collect()}
    assert got == exp and got
    q2 = (MO.stream_score_bins(stream, PM.PRIMARY, PM.N_BINS)
          .writeStream.outputMode("append").format("memory").queryName("bins_test")
          .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q2.awaitTermination()
    streamed = {(r["day"], r["bin"]): r["c"] for r in spark.table("bins_test").collect()}
    x = batch.select(F.date_trunc("day", "ts").alias("day"),
                     MO.score_bins(PM.PRIMARY.proba(F.col("value")), PM.N_BINS).alias("bin"))
    full = {(r["day"], r["bin"]): r["count"] for r in x.groupBy("day", "bin").count().collect()}
    # append mode emits the days the watermark has closed; each emitted day is complete
    assert streamed and all(full[k] == v for k, v in streamed.items())
    # drift from the streamed counts equals the batch monitor on the closed days
    kl_stream = {r["day"]: r["kl"] for r in MO.kl_from_bins(spark.table("bins_test"), PM.REF_START, PM.REF_END,
                                                            PM.N_BINS).collect()}
    kl_batch = {r["day"]: r["kl"] for r in MO.drift_kl(batch, PM.PRIMARY, PM.REF_START, PM.REF_END, PM.N_BINS).collect()}
    assert kl_stream and all(kl_batch[d] == v for d, v in kl_stream.items())
    grp = F.when(F.get_json_object("props", "$.k").cast("int") < 50, "low").otherwise("high")
    q3 = (MO.stream_subgroup_monthly(stream, PM.PRIMARY, truth, grp)
          .writeStream.outputMode("complete").format("memory").queryName("sub_test")
          .option("checkpointLocation", str(tmp_path / "ck3")).trigger(availableNow=True).start())
    q3.awaitTermination()
    got3 = {tuple(r) for r in spark.table("sub_test").collect()}
    exp3 = {tuple(r) for r in MO.subgroup_monthly(batch, PM.PRIMARY, truth, grp).collect()}
    assert got3 == exp3 and got3
