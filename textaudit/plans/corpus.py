"""Corpus preparation queries: canonical corpus, label distributions, splits, quantile
labels, column probes, class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import compare as CO
from ..operators import features as FE
from ..operators import schema as SC
from ..operators import splits as SP
from . import setup as U
from .registry import query

STRIP_SQL = r"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def corpus(spark, sf):
    """Canonical corpus ``(source, doc_id, text, label, label_missing)``: labelled documents
    plus benchmark items (no labels), text stripped, labels coerced (missing -> 0)."""
    t = U.tables(spark, sf)
    docs = t.documents.select("doc_id", "text").join(
        t.labels.select("doc_id", F.col("toxic").cast("string").alias("raw_label")), "doc_id", "left")
    bench = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    u = SP.union_sources({"documents": docs, "benchmark": bench})
    lab = SC.coerce_label("raw_label", fill=None)
    return u.select("source", "doc_id", SC.coerce_text("text").alias("text"),
                    F.coalesce(lab, F.lit(0)).alias("label"), lab.isNull().alias("label_missing"))


_CORPUS_SQL = f"""
WITH u AS (SELECT 'documents' AS source, d.doc_id, d.text, CAST(l.toxic AS VARCHAR) AS raw_label
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
           UNION ALL SELECT 'benchmark', item_id, text, CAST(NULL AS VARCHAR) FROM benchmark),
corpus AS (SELECT source, doc_id, {STRIP_SQL.format(c="coalesce(text, '')")} AS text,
                  CAST(coalesce(TRY_CAST(raw_label AS DOUBLE), 0) AS INTEGER) AS label,
                  TRY_CAST(raw_label AS DOUBLE) IS NULL AS label_missing FROM u)"""


@query("corpus_prepare", _CORPUS_SQL + "\nSELECT * FROM corpus")
def corpus_prepare(spark, sf):
    return corpus(spark, sf)


@query("label_distribution", _CORPUS_SQL + """
SELECT source, label, CAST(count(*) AS BIGINT) AS n, CAST(count_if(label_missing) AS BIGINT) AS n_filled
FROM corpus GROUP BY source, label""")
def label_distribution(spark, sf):
    return corpus(spark, sf).groupBy("source", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label_missing").cast("long").alias("n_filled"))


@query("composition_rollup", _CORPUS_SQL + """
SELECT source, label, CAST(grouping(source, label) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n
FROM corpus GROUP BY ROLLUP (source, label)""")
def composition_rollup(spark, sf):
    return CO.composition(corpus(spark, sf))


@query("drop_incomplete", """
WITH u AS (SELECT 'documents' AS source, d.doc_id, d.text, l.toxic AS label
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT source, CAST(count(*) AS BIGINT) AS n_dropped FROM u WHERE text IS NULL OR label IS NULL GROUP BY source""")
def drop_incomplete(spark, sf):
    t = U.tables(spark, sf)
    u = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.col("toxic").alias("label")),
                                                  "doc_id", "left").withColumn("source", F.lit("documents"))
    _, report = SC.drop_incomplete(u)
    return report


def _split_sql(src: str, frac: float, seed: int, key: str = "doc_id", label: str = "label", sfx: str = "") -> str:
    return f"""
s0{sfx} AS ({src}),
cc{sfx} AS (SELECT {label} AS cls, count(*) AS n_c FROM s0{sfx} GROUP BY {label}),
tot{sfx} AS (SELECT sum(n_c) AS n, CAST(ceil(sum(n_c) * {frac!r} - 1e-12) AS BIGINT) AS k FROM cc{sfx}),
q0{sfx} AS (SELECT cls, CAST(n_c AS DOUBLE) * k / n AS ex, floor(CAST(n_c AS DOUBLE) * k / n) AS base, k
            FROM cc{sfx}, tot{sfx}),
q{sfx} AS (SELECT cls, base + CASE WHEN row_number() OVER (ORDER BY ex - base DESC, cls)
                               <= k - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM q0{sfx}),
r{sfx} AS (SELECT s0{sfx}.*, row_number() OVER (PARTITION BY {label} ORDER BY md5('{seed}:' || CAST({key} AS VARCHAR)), {key}) AS rk
      FROM s0{sfx})"""


def _tvt_sql() -> str:
    first = _split_sql("SELECT doc_id, CAST(toxic AS INTEGER) AS label FROM labels", 0.1, U.SEED)
    second = _split_sql("SELECT doc_id, label FROM t1 WHERE NOT is_test", 0.1, U.SEED, sfx="2")
    return ("WITH " + first + """,
t1 AS (SELECT r.doc_id, r.label, r.rk <= q.quota AS is_test FROM r JOIN q ON r.label = q.cls),""" + second + """,
tvt AS (SELECT doc_id, label, 'test' AS split FROM t1 WHERE is_test
        UNION ALL SELECT r2.doc_id, r2.label, CASE WHEN r2.rk <= q2.quota THEN 'val' ELSE 'train' END
        FROM r2 JOIN q2 ON r2.label = q2.cls)""")


@query("stratified_split", "WITH " + _split_sql("SELECT doc_id, CAST(toxic AS INTEGER) AS label FROM labels", 0.1, U.SEED)
       + """
SELECT r.doc_id, r.label, r.rk <= q.quota AS held_out FROM r JOIN q ON r.label = q.cls""", headline=True)
def stratified_split(spark, sf):
    lab = U.tables(spark, sf).labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    return SP.stratified_holdout(lab, "doc_id", "label", 0.1, U.SEED)


@query("train_val_test", _tvt_sql() + "\nSELECT doc_id, label, split FROM tvt")
def train_val_test(spark, sf):
    lab = U.tables(spark, sf).labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    return SP.train_val_test(lab, "doc_id", "label", 0.1, 0.1, U.SEED)


@query("seeded_shuffle", f"""
SELECT doc_id, md5('{U.SEED}:' || CAST(doc_id AS VARCHAR)) AS order_key FROM documents""")
def seeded_shuffle(spark, sf):
    d = U.tables(spark, sf).documents.select("doc_id")
    return SP.seeded_shuffle(d.withColumn("order_key", SP.seeded_hash("doc_id", U.SEED)), "doc_id")


@query("quantile_binarize", """
WITH q AS (SELECT quantile_cont(n_chars, 0.2) AS lo, quantile_cont(n_chars, 0.8) AS hi FROM documents)
SELECT doc_id, n_chars, q.lo AS q_low, q.hi AS q_high,
       CAST(CASE WHEN n_chars >= q.hi THEN 2 WHEN n_chars <= q.lo THEN 0 ELSE 1 END AS INTEGER) AS label_multiclass,
       CAST(CASE WHEN n_chars >= q.hi THEN 1 WHEN n_chars <= q.lo THEN 0 END AS INTEGER) AS label_binary
FROM documents, q""")
def quantile_binarize(spark, sf):
    d = U.tables(spark, sf).documents.select("doc_id", "n_chars")
    return SP.quantile_binarize(d, "n_chars")


def _profile_sql(table: str, cols) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""SELECT {i} AS ordinal, '{c}' AS column_name,
       CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct,
       coalesce(bool_and(coalesce(TRY_CAST({c} AS DOUBLE) IN (0, 1), {c} IS NULL)), true) AS is_binary FROM {table}""")
    return "\nUNION ALL ".join(parts)


@query("column_profile", _profile_sql("labels", ["doc_id", "quality", "toxic"]))
def column_profile(spark, sf):
    return SC.column_profile(U.tables(spark, sf).labels)


@query("class_weights", """
WITH c AS (SELECT CAST(toxic AS INTEGER) AS cls, count(*) AS c FROM labels GROUP BY 1),
ids AS (SELECT unnest(generate_series(0, greatest((SELECT max(cls) FROM c), 0))) AS cls),
f AS (SELECT ids.cls, CAST(coalesce(c.c, 1) AS BIGINT) AS count FROM ids LEFT JOIN c ON ids.cls = c.cls)
SELECT cls, count, round(CAST(sum(count) OVER () AS DOUBLE) / count, 6) AS weight FROM f""")
def class_weights(spark, sf):
    lab = U.tables(spark, sf).labels.select(F.col("toxic").alias("label"))
    return FE.class_weights(lab, "label", mode="sum_count")


@query("class_weights_balanced", """
WITH c AS (SELECT CAST(toxic AS INTEGER) AS cls, count(*) AS c FROM labels GROUP BY 1),
ids AS (SELECT unnest(generate_series(0, greatest((SELECT max(cls) FROM c), 0))) AS cls),
f AS (SELECT ids.cls, CAST(coalesce(c.c, 1) AS BIGINT) AS count FROM ids LEFT JOIN c ON ids.cls = c.cls)
SELECT cls, count, round(CAST(sum(count) OVER () AS DOUBLE) / (count(*) OVER () * count), 6) AS weight FROM f""")
def class_weights_balanced(spark, sf):
    lab = U.tables(spark, sf).labels.select(F.col("toxic").alias("label"))
    return FE.class_weights(lab, "label", mode="balanced")


@query("display_names", """
SELECT DISTINCT source, lower(replace(source, ' ', '_')) AS sanitized,
       upper(left(replace(trim(source), '_', ' '), 1)) || lower(substr(replace(trim(source), '_', ' '), 2)) AS display
FROM documents""")
def display_names(spark, sf):
    d = U.tables(spark, sf).documents.select("source").distinct()
    return d.select("source", TX.sanitize_name("source").alias("sanitized"), TX.display_name("source").alias("display"))


@query("padded_corpus", f"""
WITH u AS (SELECT 'documents' AS source, d.doc_id, d.text, CAST(l.toxic AS DOUBLE) AS label_binary,
                  CAST(l.quality AS DOUBLE) AS label
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
           UNION ALL SELECT 'benchmark', item_id, text, NULL, NULL FROM benchmark)
SELECT source, doc_id, CAST(NULL AS VARCHAR) AS hard_text, CAST(NULL AS VARCHAR) AS profession,
       CAST(NULL AS VARCHAR) AS gender, CAST(NULL AS VARCHAR) AS profession_name,
       {STRIP_SQL.format(c="coalesce(text, '')")} AS text, CAST(NULL AS DOUBLE) AS bias_score,
       CAST(coalesce(label_binary, label) AS INTEGER) AS label_binary, CAST(NULL AS INTEGER) AS label_multiclass,
       CAST(coalesce(label, 0) AS INTEGER) AS label FROM u""")
def padded_corpus(spark, sf):
    """Canonical corpus with every metadata column (absent ones as typed NULLs), the binary
    label filled from the canonical one where missing, and the minimal typed projection."""
    from .. import lexicons as L
    t = U.tables(spark, sf)
    docs = t.documents.select("doc_id", "text").join(
        t.labels.select("doc_id", F.col("toxic").cast("double").alias("label_binary"),
                                     F.col("quality").cast("double").alias("label")), "doc_id", "left")
    bench = t.benchmark.select(F.col("item_id").alias("doc_id"), "text")
    u = SP.union_sources({"documents": docs, "benchmark": bench})
    types = {"bias_score": "double", "label_binary": "double", "label_multiclass": "int"}
    u = SC.pad_columns(u, L.CORPUS_METADATA, types)
    u = SC.fill_from(u, "label_binary", "label")
    u = u.withColumn("label", SC.coerce_label(F.col("label")))
    return u.select("source", "doc_id", *[F.col(c) if c != "text" else SC.coerce_text("text").alias("text")
                                          for c in L.CORPUS_METADATA], "label")


@query("minimal_splits", _tvt_sql() + """
SELECT d.doc_id, d.text, tvt.label, CAST(NULL AS VARCHAR) AS split, CAST(NULL AS VARCHAR) AS lang,
       CAST(NULL AS VARCHAR) AS source, CAST(NULL AS BIGINT) AS n_chars
FROM documents d JOIN tvt ON d.doc_id = tvt.doc_id WHERE tvt.split <> 'test'
UNION ALL
SELECT d.doc_id, d.text, tvt.label, tvt.split, d.lang, d.source, d.n_chars
FROM documents d JOIN tvt ON d.doc_id = tvt.doc_id WHERE tvt.split = 'test'""")
def minimal_splits(spark, sf):
    """Train / validation rows in the minimal ``(doc_id, text, label)`` projection; the test
    split keeps every column (the split sink layout)."""
    t = U.tables(spark, sf)
    keys = t.labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    s = SP.train_val_test(keys, "doc_id", "label", 0.1, 0.1, U.SEED)
    d = t.documents.join(s, "doc_id")
    minimal = SC.minimal_projection(d.where(F.col("split") != "test")).withColumn(
        "split", F.lit(None).cast("string"))
    return minimal.unionByName(d.where(F.col("split") == "test"), allowMissingColumns=True)
