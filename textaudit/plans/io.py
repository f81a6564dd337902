"""Queries over scans, sinks and small projections: a table of the corpus goes out through a
sink into the shared checkpoint folder and comes back through the matching scan."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import numeric as NU
from ..functions import text as TX
from ..operators import fairness as FA
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import schema as SC
from ..operators import splits as SP
from ..session import ensure_checkpoint_dir
from ..sources import files as FS
from ..sources import sinks as SK
from . import corpus as CO
from . import evaluation as EV
from . import setup as U
from . import textsql as Q
from .registry import query


def scratch(spark, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/textaudit-{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT doc_id, text, lang FROM documents")
def csv_round_trip(spark, sf):
    """Texts with quotes, line breaks and separators through the CSV sink and scan."""
    path = scratch(spark, "csv")
    SK.write_table(U.tables(spark, sf).documents.select("doc_id", "text", "lang"), path, "csv")
    return FS.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING")


def _split_frames(spark, sf):
    t = U.tables(spark, sf)
    keys = t.labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    s = SP.train_val_test(keys, "doc_id", "label", 0.1, 0.1, U.SEED)
    d = t.documents.select("doc_id", "text", "lang").join(s, "doc_id")
    return [d.where(F.col("split") == n).drop("split") for n in ("train", "val", "test")]


_SPLIT_ROWS = CO._tvt_sql() + """
SELECT tvt.split, d.text, tvt.label, CASE WHEN tvt.split = 'test' THEN d.lang END AS lang
FROM documents d JOIN tvt ON d.doc_id = tvt.doc_id"""


def _tagged(parts: dict):
    out = None
    for name, df in parts.items():
        lang = F.col("lang") if "lang" in df.columns else F.lit(None).cast("string")
        rows = df.select(F.lit(name).alias("split"), "text", F.col("label").cast("int").alias("label"), lang.alias("lang"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("split_files", _SPLIT_ROWS)
def split_files(spark, sf):
    """Split sink and three-split scan as CSV files: the held-out split keeps every column."""
    path = scratch(spark, "split-files")
    SK.write_splits(*_split_frames(spark, sf), path, fmt="csv")
    return _tagged(FS.read_splits(spark, path))


@query("split_table", _SPLIT_ROWS)
def split_table(spark, sf):
    """The same splits as one Parquet table partitioned by split."""
    path = scratch(spark, "split-table")
    SK.write_splits(*_split_frames(spark, sf), path)
    return _tagged(FS.read_splits_partitioned(spark, path))


@query("required_columns", """
SELECT CAST(l.toxic AS INTEGER) AS label, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(d.text)) AS BIGINT) AS chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def required_columns(spark, sf):
    """A scan that names the columns it cannot do without."""
    t = U.tables(spark, sf)
    path = scratch(spark, "required")
    SK.write_table(t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.col("toxic").alias("label")), "doc_id"), path, "csv")
    df = FS.read_with_required(spark, path, "text", "label")
    return df.groupBy(SC.coerce_label("label").alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


_REFERENCE_ROWS = EV._with(f"""
SELECT doc_id, y_pred, round(proba, 6) AS proba FROM preds WHERE model = '{U.REFERENCE}'""")


def _prediction_file(spark, sf, pred: str, proba: str):
    path = scratch(spark, "predictions")
    p = U.predictions(spark, sf).where(F.col("model") == U.REFERENCE)
    SK.write_table(p.select("doc_id", F.col("y_pred").alias(pred), F.col("proba").alias(proba)), path, "csv")
    r = FS.read_predictions(spark, path, key="doc_id")
    return r.select(F.col("doc_id").cast("long").alias("doc_id"), "y_pred", F.round("proba", 6).alias("proba"))


@query("prediction_file", _REFERENCE_ROWS)
def prediction_file(spark, sf):
    """A prediction file whose columns are found by name."""
    return _prediction_file(spark, sf, "predicted_label", "prob_pos")


@query("prediction_file_probed", EV._with(f"SELECT doc_id, y_pred, CAST(NULL AS DOUBLE) AS proba FROM preds WHERE model = '{U.REFERENCE}'"))
def prediction_file_probed(spark, sf):
    """A prediction file without known names: the only binary column is the prediction."""
    return _prediction_file(spark, sf, "flag", "raw")


_BANK_SQL = """
SELECT 'biased' AS bank, CAST(NULL AS VARCHAR) AS category, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS ord, text
FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT 'neutral', NULL, CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER), text FROM benchmark WHERE item_id % 2 = 1
UNION ALL SELECT 'category', 'c' || (item_id % 3), CAST(row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id) - 1 AS INTEGER), text FROM benchmark"""


def _bank(spark, sf):
    """The benchmark items as an example bank in lines, written and read back."""
    b = U.tables(spark, sf).benchmark
    flat = b.select(F.when(F.col("item_id") % 2 == 0, "biased").otherwise("neutral").alias("bank"), F.lit(None).cast("string").alias("category"), "item_id", "text")
    cats = b.select(F.lit("category").alias("bank"), F.concat(F.lit("c"), F.col("item_id") % 3).alias("category"), "item_id", "text")
    path = scratch(spark, "bank")
    SK.write_example_lines(flat.unionByName(cats), path, order=["item_id"])
    return FS.read_example_lines(spark, path)


@query("example_bank", _BANK_SQL)
def example_bank(spark, sf):
    return _bank(spark, sf)


@query("example_bank_inputs", f"SELECT bank, text FROM ({_BANK_SQL}) WHERE bank <> 'category'")
def example_bank_inputs(spark, sf):
    """Biased and neutral examples as one tagged input."""
    return _bank(spark, sf).where(F.col("bank") != "category").select("bank", "text")


@query("prediction_sink", EV._with("SELECT doc_id, model, y_true, y_pred, round(proba, 6) AS proba FROM preds"))
def prediction_sink(spark, sf):
    """Per-row predictions through the sink partitioned by model."""
    path = scratch(spark, "prediction-sink")
    SK.write_predictions(U.predictions(spark, sf).select("doc_id", "model", "y_true", "y_pred", "proba"), path)
    return spark.read.parquet(path).select("doc_id", "model", "y_true", "y_pred", F.round("proba", 6).alias("proba"))


@query("metrics_json", EV._with(EV._BINARY_SQL + EV._AUC_SQL + """
SELECT bm.model, accuracy, precision, recall, f1, roc_auc FROM bm LEFT JOIN auc ON bm.model = auc.model"""))
def metrics_json(spark, sf):
    path = scratch(spark, "metrics")
    SK.write_metrics_json(M.model_metrics(U.predictions(spark, sf)), path)
    return spark.read.schema("model STRING, accuracy DOUBLE, precision DOUBLE, recall DOUBLE, f1 DOUBLE, roc_auc DOUBLE").json(path)


@query("comparison_table", EV._with(EV._BINARY_SQL + "\nSELECT model, n, accuracy, f1 FROM bm"))
def comparison_table(spark, sf):
    """The comparison table through the CSV sink and back."""
    path = scratch(spark, "comparison")
    SK.write_table(M.binary_metrics(U.predictions(spark, sf)).select("model", "n", "accuracy", "f1"), path, "csv")
    return FS.read_csv(spark, path, "model STRING, n BIGINT, accuracy DOUBLE, f1 DOUBLE")


@query("label_map", "SELECT CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS index, lang AS label FROM (SELECT DISTINCT lang FROM documents)")
def label_map(spark, sf):
    from ..operators import features as FE
    path = scratch(spark, "labels")
    SK.write_label_map(list(FE.label_index(U.tables(spark, sf).documents, "lang").labels), spark, path)
    return spark.read.parquet(path)


@query("embedding_source", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings")
def embedding_source(spark, sf):
    """The first of several named tables that exists."""
    df = FS.read_embeddings(spark, [f"{sf}/no-such-vectors.parquet", f"{sf}/embeddings.parquet"])
    return df.select("vec_id", F.size("embedding").alias("dims"))


@query("saved_pipeline", "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_idx FROM documents")
def saved_pipeline(spark, sf):
    """A fitted pipeline saved, loaded and applied."""
    from pyspark.ml import PipelineModel
    from ..operators import features as FE
    d = U.tables(spark, sf).documents.select("doc_id", "lang")
    path = scratch(spark, "pipeline")
    MD.save_model(PipelineModel([FE.label_index(d, "lang")]), path)
    return MD.load_pipeline(path).transform(d).select("doc_id", "lang", F.col("lang_idx").cast("int").alias("lang_idx"))


@query("prediction_registry", EV._with(f"""
SELECT model, CAST(count(*) AS BIGINT) AS n, CAST(sum(y_pred) AS BIGINT) AS positive, 'stored' AS skipped FROM preds
WHERE model <> '{U.REFERENCE}' GROUP BY model"""))
def prediction_registry(spark, sf):
    """Prediction sets that can be produced; the one that cannot is named in the result."""
    p = U.predictions(spark, sf).select("doc_id", "model", "y_true", "y_pred", "proba")
    providers = {m.name: (lambda n=m.name: p.where(F.col("model") == n).drop("model")) for m in U.MODELS if m.name != U.REFERENCE}
    skipped: list[str] = []
    reg = MD.prediction_registry(providers | {"stored": lambda: spark.read.parquet(f"{sf}/no-such-predictions.parquet")},
                                 on_error=lambda name, _: skipped.append(name))
    return reg.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("y_pred").cast("long").alias("positive"),
                                    F.lit(",".join(skipped)).alias("skipped"))


@query("canonical_columns", """
SELECT d.doc_id, d.text, CAST(l.toxic AS INTEGER) AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def canonical_columns(spark, sf):
    """Columns found in candidate order and renamed to ``text`` and ``label``."""
    t = U.tables(spark, sf)
    df = t.documents.select("doc_id", F.col("text").alias("excerpt")).join(t.labels.select("doc_id", F.col("toxic").alias("target")), "doc_id")
    text, label = SC.first_match(df.columns, ["sentence", "excerpt", "text"]), SC.first_match(df.columns, ["label", "target"])
    return SC.canonical_rename(df, text, label).select("doc_id", "text", F.col("label").cast("int").alias("label"))


MAX_TOKENS = 128


@query("truncated_tokens", f"""
SELECT doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD})[1:{MAX_TOKENS}], ' ') AS kept FROM documents""")
def truncated_tokens(spark, sf):
    d = U.tables(spark, sf).documents
    return d.select("doc_id", F.array_join(TX.truncate_tokens(TX.word_tokens("text"), MAX_TOKENS), " ").alias("kept"))


@query("metric_selection", EV._with(EV._BINARY_SQL + "\nSELECT model, f1, accuracy FROM bm"))
def metric_selection(spark, sf):
    """The wanted summary columns that there are."""
    return SC.select_metrics(M.binary_metrics(U.predictions(spark, sf)), ["model", "f1", "accuracy", "loss"])


@query("stratify_guard", f"""
WITH s AS (SELECT doc_id, CAST(toxic AS INTEGER) AS label, row_number() OVER (ORDER BY md5('{U.SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk,
                  count(*) OVER () AS n FROM labels WHERE toxic = 0)
SELECT doc_id, label, rk <= ceil(n * 0.1 - 1e-12) AS held_out FROM s""")
def stratify_guard(spark, sf):
    """A hold-out of a set with a single class is not stratified."""
    lab = U.tables(spark, sf).labels.where("toxic = 0").select("doc_id", F.col("toxic").cast("int").alias("label"))
    return SP.stratified_holdout(lab, "doc_id", "label", 0.1, U.SEED)


@query("boolean_stratified_split", "WITH " + CO._split_sql("SELECT doc_id, toxic = 1 AS label FROM labels", 0.1, U.SEED) + """
SELECT r.doc_id, r.label, r.rk <= q.quota AS held_out FROM r JOIN q ON r.label = q.cls""")
def boolean_stratified_split(spark, sf):
    """The stratified hold-out with a boolean label."""
    lab = U.tables(spark, sf).labels.select("doc_id", (F.col("toxic") == 1).alias("label"))
    return SP.stratified_holdout(lab, "doc_id", "label", 0.1, U.SEED)


@query("sensitive_attribute", EV._with(f"""
, tk AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}) AS toks FROM documents)
, side AS (SELECT doc_id, len(list_filter(toks, lambda w: w IN {Q.in_list(L.gender_sides()[0])})) AS m,
                  len(list_filter(toks, lambda w: w IN {Q.in_list(L.gender_sides()[1])})) AS f FROM tk)
, pg AS (SELECT p.model, p.y_true, p.y_pred, CASE WHEN m > f THEN 'male' WHEN f > m THEN 'female' END AS grp
         FROM preds p JOIN side ON p.doc_id = side.doc_id)""" + EV._RATES_SQL.replace("FROM preds", "FROM pg") + "\nSELECT * FROM rates"))
def sensitive_attribute(spark, sf):
    """Group rates by a sensitive attribute that is joined to the predictions by key."""
    groups = FA.gender_group(U.tables(spark, sf).documents)
    return FA.group_rates(FA.attach_group(U.predictions(spark, sf).drop("grp"), groups))


@query("softmax_scores", """
WITH z AS (SELECT doc_id, CAST(n_chars % 7 AS DOUBLE) / 2 AS a, CAST(n_chars % 5 AS DOUBLE) / 2 AS b, CAST(n_chars % 3 AS DOUBLE) AS c FROM documents)
SELECT doc_id, round(exp(a) / (exp(a) + exp(b) + exp(c)), 6) AS p0, round(exp(b) / (exp(a) + exp(b) + exp(c)), 6) AS p1,
       round(exp(c) / (exp(a) + exp(b) + exp(c)), 6) AS p2, round(exp(b) / (exp(a) + exp(b)), 6) AS positive,
       round(1 / (1 + exp(-a)), 6) AS single FROM z""")
def softmax_scores(spark, sf):
    """Probabilities from logit arrays (stand-in logits from the text length)."""
    n = F.col("n_chars")
    a, b, c = (n % 7).cast("double") / 2, (n % 5).cast("double") / 2, (n % 3).cast("double")
    d = U.tables(spark, sf).documents.select("doc_id", NU.softmax(F.array(a, b, c)).alias("p"), NU.positive_proba(F.array(a, b)).alias("q"),
                                             NU.positive_proba(F.array(a)).alias("s"))
    return d.select("doc_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)], F.round("q", 6).alias("positive"),
                    F.round("s", 6).alias("single"))


@query("python_scorer", "SELECT doc_id, (length(coalesce(text, '')) % 100) / 100.0 AS proba FROM documents")
def python_scorer(spark, sf):
    """The scorer extension point: an arbitrary batch function of texts."""
    return MD.python_scorer(U.tables(spark, sf).documents.select("doc_id", "text"), lambda texts: [len(t) % 100 / 100.0 for t in texts])


@query("lexicon_hits", f"""
WITH lex AS (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD})) AS w FROM benchmark),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD})) AS w FROM documents),
h AS (SELECT doc_id, count(*) AS hits FROM t JOIN lex ON t.w = lex.w GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(h.hits, 0) AS BIGINT) AS hits FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id""")
def lexicon_hits(spark, sf):
    """Hits of a lexicon that is a table: the words of the benchmark."""
    t = U.tables(spark, sf)
    lexicon = t.benchmark.select(F.explode(TX.word_tokens("text")).alias("word"))
    return MD.lexicon_hits(t.documents.select("doc_id", "text"), lexicon)


@query("decisions", EV._with("""
SELECT model, CAST(proba >= 0.4 AS INTEGER) AS decision, CAST(count(*) AS BIGINT) AS n, printf('%.3f', 0.4) AS threshold FROM preds
GROUP BY 1, 2"""))
def decisions(spark, sf):
    """Decisions at another threshold, counted by value."""
    p = U.predictions(spark, sf).select("model", SC.decide("proba", 0.4).alias("decision"))
    return M.value_counts(p, ("model", "decision")).withColumn("threshold", NU.fixed_decimals(F.lit(0.4), 3))


@query("gendered_flag", f"""
SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}),
                               lambda w: w IN {Q.in_list(sorted(L.gender_swap_map()))})) > 0 AS gendered FROM documents""")
def gendered_flag(spark, sf):
    words = L.gender_swap_map()
    return U.tables(spark, sf).documents.select("doc_id", SC.gendered_flag(TX.word_tokens("text"), words).alias("gendered"))
