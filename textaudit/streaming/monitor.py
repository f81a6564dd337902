"""Monitoring of deployed scorers over an event stream ``(event_id, ts, ...)``:

- shadow divergence: a second scorer on a hash-sampled share of traffic, daily
  disagreement rate;
- threshold audit: precision / recall per month and decision threshold;
- drift: KL divergence of the daily score-bin distribution from a reference period;
- subgroup spot checks: group rates per month.

Every monitor is a ``groupBy`` over time buckets. The streaming forms use event-time
windows with a watermark, so state for closed days is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import fairness as FA
from ..operators.metrics import DIGITS
from ..session import saved_table


@dataclass(frozen=True)
class ValueScorer:
    """proba = sigmoid((value - center) / scale), unrounded."""
    name: str
    center: float
    scale: float

    def proba(self, value: Column) -> Column:
        return TX.sigmoid((value - F.lit(self.center)) / F.lit(self.scale))


def hash_sample(key, percent: int) -> Column:
    """Deterministic traffic sample: md5 bucket of the key below ``percent`` of 100."""
    k = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100)) < percent


def shadow_divergence(events: DataFrame, primary: ValueScorer, shadow: ValueScorer, percent: int = 10,
                      key: str = "event_id", ts: str = "ts", threshold: float = 0.5) -> DataFrame:
    """Per day: sampled events, disagreements between the two decisions, divergence rate."""
    s = events.where(hash_sample(key, percent)).select(
        F.date_trunc("day", F.col(ts)).alias("day"),
        (primary.proba(F.col("value")) >= threshold).cast("int").alias("a"),
        (shadow.proba(F.col("value")) >= threshold).cast("int").alias("b"))
    g = s.groupBy("day").agg(F.count(F.lit(1)).alias("n_sampled"),
                             F.count_if(F.col("a") != F.col("b")).cast("long").alias("n_disagree"))
    return g.select("day", "n_sampled", "n_disagree",
                    F.round(F.col("n_disagree") / F.col("n_sampled"), DIGITS).alias("divergence_rate"))


def threshold_audit(events: DataFrame, scorer: ValueScorer, truth: Column, thresholds,
                    ts: str = "ts") -> DataFrame:
    """Per month and threshold: tp/fp/fn, precision and recall (undefined -> 0)."""
    thr = F.array(*[F.lit(float(t)) for t in thresholds])
    x = events.select(F.date_trunc("month", F.col(ts)).alias("month"), truth.cast("int").alias("y"),
                      scorer.proba(F.col("value")).alias("p"), F.explode(thr).alias("threshold"))
    g = x.groupBy("month", "threshold").agg(
        F.count_if((F.col("y") == 1) & (F.col("p") >= F.col("threshold"))).cast("long").alias("tp"),
        F.count_if((F.col("y") == 0) & (F.col("p") >= F.col("threshold"))).cast("long").alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("p") < F.col("threshold"))).cast("long").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = F.lit(0.0)
    return g.select("month", "threshold", "tp", "fp", "fn",
                    F.round(F.coalesce(F.try_divide(tp.cast("double"), tp + fp), zero), DIGITS).alias("precision"),
                    F.round(F.coalesce(F.try_divide(tp.cast("double"), tp + fn), zero), DIGITS).alias("recall"))


def score_bins(p: Column, n_bins: int) -> Column:
    return F.least(F.floor(p * n_bins), F.lit(n_bins - 1)).cast("int")


def daily_score_bins(events: DataFrame, scorer: ValueScorer, n_bins: int = 10, ts: str = "ts") -> DataFrame:
    """``(day, bin, c)``: events per day and score bin (a partial aggregate)."""
    x = events.select(F.date_trunc("day", F.col(ts)).alias("day"),
                      score_bins(scorer.proba(F.col("value")), n_bins).alias("bin"))
    return x.groupBy("day", "bin").agg(F.count(F.lit(1)).alias("c"))


def kl_from_bins(bins: DataFrame, ref_start: str, ref_end: str, n_bins: int = 10) -> DataFrame:
    """Per day: KL(day || reference) of score-bin shares with add-one smoothing, from
    ``(day, bin, c)`` counts; the reference is the days in [ref_start, ref_end). Works on
    batch counts and on the output table of :func:`stream_score_bins`."""
    in_ref = (F.col("day") >= F.lit(ref_start).cast("timestamp_ntz")) & (F.col("day") < F.lit(ref_end).cast("timestamp_ntz"))
    # One row a day with its counts by bin; the reference is the sum of its days' rows, over the
    # table of days (one row a day, whatever the events).
    days = bins.groupBy("day").agg(*[F.sum(F.when(F.col("bin") == i, F.col("c")).otherwise(0)).alias(f"c{i}") for i in range(n_bins)])
    whole = Window.partitionBy(F.lit(0))
    days = days.select("day", F.array(*[F.col(f"c{i}") for i in range(n_bins)]).alias("c"),
                       F.array(*[F.coalesce(F.sum(F.when(in_ref, F.col(f"c{i}"))).over(whole), F.lit(0)) for i in range(n_bins)]).alias("rc"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    days = days.withColumns({"n": total("c"), "rn": total("rc")})
    p = F.transform("c", lambda c: (c + 1.0) / (F.col("n") + n_bins))
    q = F.transform("rc", lambda c: (c + 1.0) / (F.col("rn") + n_bins))
    kl = F.aggregate(F.zip_with(p, q, lambda x, y: x * F.log(x / y)), F.lit(0.0), lambda acc, x: acc + x)
    return days.select("day", F.round(kl, DIGITS).alias("kl"), F.col("n").cast("long").alias("n_events"))


def drift_kl(events: DataFrame, scorer: ValueScorer, ref_start: str, ref_end: str, n_bins: int = 10,
             ts: str = "ts") -> DataFrame:
    """Per day: KL(day || reference) of score-bin shares with add-one smoothing; the
    reference period is the whole days in [ref_start, ref_end). Bins are a fixed grid."""
    return kl_from_bins(daily_score_bins(events, scorer, n_bins, ts), ref_start, ref_end, n_bins)


def token_drift(docs: DataFrame, reference, group: str = "source", text: str = "text", tokens=TX.word_tokens) -> DataFrame:
    """``(group, kl, n_tokens, n_distinct)``: KL(group || reference) of token shares with add-one
    smoothing over the tokens of all groups; ``reference`` is the value of ``group`` to compare with.

    Tokens are counted exactly, in two partial aggregates (by text, then by token and group). A
    group's sum runs over the tokens it has; all others have the same smoothed share, so their
    part follows from sums of the reference's logarithms, and no grid of groups and tokens is made."""
    counted = TX.with_counts(docs.select(F.col(group).alias("grp"), text), tokens(text))
    each = counted.select("grp", TX.explode_rows(F.col("counts")).alias("t")).where(F.col("t").isNotNull())
    c = saved_table(each.groupBy("grp", F.col("t.word").alias("token")).agg(F.sum("t.c").alias("c")), "tokens")
    is_ref = F.col("grp").eqNullSafe(F.lit(reference))
    by_token = c.groupBy("token").agg(F.coalesce(F.sum(F.when(is_ref, F.col("c"))), F.lit(0)).alias("rc"))
    v, rn = by_token.agg(F.count("*"), F.coalesce(F.sum("rc"), F.lit(0))).first()
    q = (F.col("rc") + 1.0) / F.lit(float(rn + v))
    all_log_q = by_token.agg(F.coalesce(F.sum(F.log(q)), F.lit(0.0))).first()[0]
    totals = c.groupBy("grp").agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    rows = c.join(by_token, "token").groupBy("grp").agg(
        F.sum((F.col("c") + 1.0) * F.log(F.col("c") + 1.0)).alias("cl"), F.sum((F.col("c") + 1.0) * F.log(q)).alias("cq"), F.sum(F.log(q)).alias("lq"))
    same = rows.withColumnRenamed("grp", "g")
    g = totals.join(same, F.col("grp").eqNullSafe(F.col("g")))
    whole = F.col("n") + F.lit(float(v))
    # sum of (c + 1) / whole * (ln(c + 1) - ln whole - ln q) over the group's tokens, then over the others
    own = (F.col("cl") - F.log(whole) * (F.col("n") + F.col("k")) - F.col("cq")) / whole
    others = (-F.log(whole) * (F.lit(v) - F.col("k")) - (F.lit(all_log_q) - F.col("lq"))) / whole
    return g.select(F.col("grp").alias(group), F.round(own + others, DIGITS).alias("kl"), F.col("n").alias("n_tokens"), F.col("k").alias("n_distinct"))


def subgroup_monthly(events: DataFrame, scorer: ValueScorer, truth: Column, group: Column,
                     ts: str = "ts", threshold: float = 0.5) -> DataFrame:
    """Group rates (count, positive rate, TPR, FPR, precision) per month."""
    x = events.select(F.date_trunc("month", F.col(ts)).alias("month"), truth.cast("int").alias("y_true"),
                      (scorer.proba(F.col("value")) >= threshold).cast("int").alias("y_pred"), group.alias("grp"))
    return FA.group_rates(x, by=("month",))


# --- Structured Streaming -----------------------------------------------------------------

def stream_shadow_divergence(stream: DataFrame, primary: ValueScorer, shadow: ValueScorer, percent: int = 10,
                             key: str = "event_id", ts: str = "ts", threshold: float = 0.5,
                             watermark: str = "1 day") -> DataFrame:
    """Streaming form: daily event-time windows, watermark for late events; emits a day's
    row once the watermark passes the end of the day (append mode)."""
    # watermarks need an instant-typed event time; wall-clock (NTZ) times are read in the
    # session time zone and the window start is turned back into wall-clock time
    ev = stream.withColumn("_et", F.col(ts).cast("timestamp"))
    s = ev.withWatermark("_et", watermark).where(hash_sample(key, percent)).select(
        F.col("_et"), (primary.proba(F.col("value")) >= threshold).cast("int").alias("a"),
        (shadow.proba(F.col("value")) >= threshold).cast("int").alias("b"))
    g = s.groupBy(F.window(F.col("_et"), "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("n_sampled"), F.count_if(F.col("a") != F.col("b")).cast("long").alias("n_disagree"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n_sampled", "n_disagree",
                    F.round(F.col("n_disagree") / F.col("n_sampled"), DIGITS).alias("divergence_rate"))


def stream_scored_rows(stream: DataFrame, model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Row-level scoring is stateless, so the batch operators run on a stream unchanged."""
    return stream.select(key, model.proba(TX.word_tokens(text)).alias("proba"))


def stream_threshold_audit(stream: DataFrame, scorer: ValueScorer, truth: Column, thresholds,
                           ts: str = "ts") -> DataFrame:
    """Streaming form of the monthly threshold audit: a running aggregate per (month,
    threshold), emitted in update or complete mode. The state is one row per month and
    threshold."""
    return threshold_audit(stream, scorer, truth, thresholds, ts)


def stream_score_bins(stream: DataFrame, scorer: ValueScorer, n_bins: int = 10, ts: str = "ts",
                      watermark: str = "1 day") -> DataFrame:
    """Streaming daily score-bin counts (event-time windows with a watermark, append mode):
    the input of the drift monitor, whose KL step compares closed days with a reference."""
    ev = stream.withColumn("_et", F.col(ts).cast("timestamp")).withWatermark("_et", watermark)
    g = ev.groupBy(F.window(F.col("_et"), "1 day").alias("w"),
                   score_bins(scorer.proba(F.col("value")), n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "bin", "c")


def stream_subgroup_monthly(stream: DataFrame, scorer: ValueScorer, truth: Column, group: Column,
                            ts: str = "ts", threshold: float = 0.5) -> DataFrame:
    """Streaming form of the monthly subgroup checks (update or complete mode; one row of
    state per month and group)."""
    return subgroup_monthly(stream, scorer, truth, group, ts, threshold)


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available, then end; its result as a table. ``append`` adds the
    rows that are final; ``complete`` replaces the table by the whole state after each batch. The
    stream's progress and state are kept beside the table, so a later call goes on from there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
    if mode == "append":
        running = writer.format("parquet").start(path)
    else:
        running = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
