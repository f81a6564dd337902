"""Monitoring queries over ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..streaming import monitor as MO
from . import setup as U
from .registry import ORACLE, query

PRIMARY = MO.ValueScorer("primary", 40.0, 20.0)
SHADOW = MO.ValueScorer("shadow", 50.0, 15.0)
SAMPLE_PERCENT = 10
AUDIT_THRESHOLDS = [0.3, 0.5, 0.7]
N_BINS = 10
REF_START, REF_END = "2024-01-01", "2024-01-08"


def _events(spark, sf):
    return U.tables(spark, sf).events


def _p(s: MO.ValueScorer, v: str = "value") -> str:
    return f"(1.0 / (1.0 + exp(-(({v} - CAST({s.center!r} AS DOUBLE)) / CAST({s.scale!r} AS DOUBLE)))))"


_SAMPLE = f"(CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100) < {SAMPLE_PERCENT}"


@query("shadow_divergence", f"""
WITH s AS (SELECT date_trunc('day', ts) AS day, CAST({_p(PRIMARY)} >= 0.5 AS INTEGER) AS a,
                  CAST({_p(SHADOW)} >= 0.5 AS INTEGER) AS b FROM events WHERE {_SAMPLE}),
g AS (SELECT day, count(*) AS n_sampled, CAST(count_if(a <> b) AS BIGINT) AS n_disagree FROM s GROUP BY day)
SELECT day, n_sampled, n_disagree, round(CAST(n_disagree AS DOUBLE) / n_sampled, 6) AS divergence_rate FROM g""",
       headline=True)
def shadow_divergence(spark, sf):
    return MO.shadow_divergence(_events(spark, sf), PRIMARY, SHADOW, SAMPLE_PERCENT)


@query("threshold_audit", f"""
WITH x AS (SELECT date_trunc('month', ts) AS month, CAST(event_type = 'purchase' AS INTEGER) AS y, {_p(PRIMARY)} AS p,
                  unnest([{', '.join(f'CAST({t!r} AS DOUBLE)' for t in AUDIT_THRESHOLDS)}]) AS threshold FROM events),
g AS (SELECT month, threshold, CAST(count_if(y = 1 AND p >= threshold) AS BIGINT) AS tp,
             CAST(count_if(y = 0 AND p >= threshold) AS BIGINT) AS fp,
             CAST(count_if(y = 1 AND p < threshold) AS BIGINT) AS fn FROM x GROUP BY month, threshold)
SELECT month, threshold, tp, fp, fn, round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) AS precision,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6) AS recall FROM g""")
def threshold_audit(spark, sf):
    return MO.threshold_audit(_events(spark, sf), PRIMARY, F.col("event_type") == "purchase", AUDIT_THRESHOLDS)


@query("drift_kl", f"""
WITH x AS (SELECT date_trunc('day', ts) AS day, ts, CAST(least(floor({_p(PRIMARY)} * {N_BINS}), {N_BINS - 1}) AS INTEGER) AS bin
           FROM events),
ref AS (SELECT bin, count(*) AS rc FROM x WHERE ts >= TIMESTAMP '{REF_START}' AND ts < TIMESTAMP '{REF_END}' GROUP BY bin),
daily AS (SELECT day, bin, count(*) AS c FROM x GROUP BY day, bin),
grid AS (SELECT day, unnest(range(0, {N_BINS})) AS bin FROM (SELECT DISTINCT day FROM x)),
full_ AS (SELECT grid.day, grid.bin, coalesce(daily.c, 0) AS c, coalesce(ref.rc, 0) AS rc
          FROM grid LEFT JOIN daily ON grid.day = daily.day AND grid.bin = daily.bin LEFT JOIN ref ON grid.bin = ref.bin),
tot AS (SELECT day, sum(c) AS n, sum(rc) AS rn FROM full_ GROUP BY day),
j AS (SELECT full_.day, (c + 1.0) / (n + {N_BINS}) AS p, (rc + 1.0) / (rn + {N_BINS}) AS q, n FROM full_ JOIN tot ON full_.day = tot.day)
SELECT day, round(sum(p * ln(p / q)), 6) AS kl, CAST(max(n) AS BIGINT) AS n_events FROM j GROUP BY day""")
def drift_kl(spark, sf):
    return MO.drift_kl(_events(spark, sf), PRIMARY, REF_START, REF_END, N_BINS)


_GROUP_SQL = "CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'low' ELSE 'high' END"


@query("subgroup_monthly", f"""
WITH x AS (SELECT date_trunc('month', ts) AS month, CAST(event_type = 'purchase' AS INTEGER) AS y_true,
                  CAST({_p(PRIMARY)} >= 0.5 AS INTEGER) AS y_pred, {_GROUP_SQL} AS grp FROM events),
gr AS (SELECT month, grp, CAST(count(*) AS BIGINT) AS count, count_if(y_pred = 1) AS pp,
              count_if(y_true = 1 AND y_pred = 1) AS tp, count_if(y_true = 0 AND y_pred = 1) AS fp,
              count_if(y_true = 1 AND y_pred = 0) AS fn, count_if(y_true = 0 AND y_pred = 0) AS tn
       FROM x WHERE grp IS NOT NULL GROUP BY month, grp)
SELECT month, grp, count, round(coalesce(CAST(pp AS DOUBLE) / nullif(count, 0), 0.0), 6) AS positive_rate,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0.0), 6) AS tpr,
       round(coalesce(CAST(fp AS DOUBLE) / nullif(fp + tn, 0), 0.0), 6) AS fpr,
       round(coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0.0), 6) AS precision FROM gr""")
def subgroup_monthly(spark, sf):
    grp = F.when(F.get_json_object("props", "$.k").cast("int") < 50, "low").otherwise("high")
    return MO.subgroup_monthly(_events(spark, sf), PRIMARY, F.col("event_type") == "purchase", grp)


REFERENCE_SOURCE = "src0"


@query("token_drift", rf"""
WITH t AS (SELECT source, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS token FROM documents),
c AS (SELECT source, token, count(*) AS c FROM t GROUP BY ALL),
tot AS (SELECT source, sum(c) AS n, count(*) AS k FROM c GROUP BY 1),
r AS (SELECT token, coalesce(sum(c) FILTER (source = '{REFERENCE_SOURCE}'), 0) AS rc FROM c GROUP BY 1),
s AS (SELECT count(*) AS v, sum(rc) AS rn FROM r),
grid AS (SELECT tot.source, n, k, v, coalesce(c.c, 0) AS c, rc, rn FROM tot CROSS JOIN r CROSS JOIN s
         LEFT JOIN c ON c.source IS NOT DISTINCT FROM tot.source AND c.token = r.token),
p AS (SELECT source, n, k, (c + 1.0::DOUBLE) / (n + v) AS p, (rc + 1.0::DOUBLE) / (rn + v) AS q FROM grid)
SELECT source, round(sum(p * ln(p / q)), 6) AS kl, CAST(any_value(n) AS BIGINT) AS n_tokens, CAST(any_value(k) AS BIGINT) AS n_distinct FROM p GROUP BY 1""")
def token_drift(spark, sf):
    """Drift of the tokens of every source from a reference source."""
    return MO.token_drift(U.tables(spark, sf).documents, REFERENCE_SOURCE)


# --- the monitors as streams: all available events, into a table ------------------------------

def _stream(spark, sf):
    # a pattern, as a stream's plain path must be a folder and the table may be one file
    return spark.readStream.schema(_events(spark, sf).schema).parquet(f"{sf.rstrip('/')}/events.parque[t]")


def _drained(stream, name: str, mode: str = "append"):
    return MO.drain(stream, f"{ensure_checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}", mode)


_CLOSED = "day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM {})"


@query("stream_shadow_divergence", f"""
WITH x AS (SELECT * FROM events WHERE {_SAMPLE}),
s AS (SELECT date_trunc('day', ts) AS day, CAST({_p(PRIMARY)} >= 0.5 AS INTEGER) AS a, CAST({_p(SHADOW)} >= 0.5 AS INTEGER) AS b FROM x),
g AS (SELECT day, count(*) AS n_sampled, CAST(count_if(a <> b) AS BIGINT) AS n_disagree FROM s GROUP BY day)
SELECT day, n_sampled, n_disagree, round(CAST(n_disagree AS DOUBLE) / n_sampled, 6) AS divergence_rate FROM g WHERE {_CLOSED.format("x")}""")
def stream_shadow_divergence(spark, sf):
    """Shadow validation as a stream: the days that the watermark has closed."""
    return _drained(MO.stream_shadow_divergence(_stream(spark, sf), PRIMARY, SHADOW, SAMPLE_PERCENT), "divergence")


@query("stream_threshold_audit", ORACLE["threshold_audit"])
def stream_threshold_audit(spark, sf):
    """The monthly threshold audit as a stream with a running state."""
    return _drained(MO.stream_threshold_audit(_stream(spark, sf), PRIMARY, F.col("event_type") == "purchase", AUDIT_THRESHOLDS), "audit", "complete")


@query("stream_drift", f"""
WITH all_ AS (SELECT date_trunc('day', ts) AS day, ts, CAST(least(floor({_p(PRIMARY)} * {N_BINS}), {N_BINS - 1}) AS INTEGER) AS bin FROM events),
x AS (SELECT * FROM all_ WHERE {_CLOSED.format("events")}),
ref AS (SELECT bin, count(*) AS rc FROM x WHERE ts >= TIMESTAMP '{REF_START}' AND ts < TIMESTAMP '{REF_END}' GROUP BY bin),
daily AS (SELECT day, bin, count(*) AS c FROM x GROUP BY day, bin),
grid AS (SELECT day, unnest(range(0, {N_BINS})) AS bin FROM (SELECT DISTINCT day FROM x)),
full_ AS (SELECT grid.day, grid.bin, coalesce(daily.c, 0) AS c, coalesce(ref.rc, 0) AS rc
          FROM grid LEFT JOIN daily ON grid.day = daily.day AND grid.bin = daily.bin LEFT JOIN ref ON grid.bin = ref.bin),
tot AS (SELECT day, sum(c) AS n, sum(rc) AS rn FROM full_ GROUP BY day),
j AS (SELECT full_.day, (c + 1.0) / (n + {N_BINS}) AS p, (rc + 1.0) / (rn + {N_BINS}) AS q, n FROM full_ JOIN tot ON full_.day = tot.day)
SELECT day, round(sum(p * ln(p / q)), 6) AS kl, CAST(max(n) AS BIGINT) AS n_events FROM j GROUP BY day""")
def stream_drift(spark, sf):
    """Drift as a stream: score bins of the days that the watermark has closed, then their KL."""
    return MO.kl_from_bins(_drained(MO.stream_score_bins(_stream(spark, sf), PRIMARY, N_BINS), "bins"), REF_START, REF_END, N_BINS)


@query("stream_subgroup_monthly", ORACLE["subgroup_monthly"])
def stream_subgroup_monthly(spark, sf):
    """The monthly subgroup checks as a stream with a running state."""
    grp = F.when(F.get_json_object("props", "$.k").cast("int") < 50, "low").otherwise("high")
    return _drained(MO.stream_subgroup_monthly(_stream(spark, sf), PRIMARY, F.col("event_type") == "purchase", grp), "subgroups", "complete")
