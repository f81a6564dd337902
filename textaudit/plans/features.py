"""Feature and model queries: TF-IDF terms and weights, mean-pooled word vectors, label
encoding, logistic regression and linear SVM reports, linear attributions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import attribution as AT
from ..operators import compare as C
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import newton as NW
from ..operators import splits as SP
from ..operators import significance as SG
from ..operators import wordvectors as WV
from ..session import ensure_checkpoint_dir, saved_table
from ..sources import files as FS
from . import setup as U
from . import textsql as Q
from .registry import query

# Stop words of the TF-IDF queries (an argument of the operator).
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "be",
              "by", "this", "at", "an", "from", "are", "was", "or", "de", "la", "le", "les", "et", "der",
              "die", "und", "el", "en", "que"]
MIN_DF = 2
MAX_TERMS = 10000
WORD2 = r"'[\p{L}\p{N}_]{2,}'"


def _tfidf(spark, sf):
    d = U.tables(spark, sf).documents.select("doc_id", "text")
    return FE.tfidf_terms(d, stop_words=STOP_WORDS, min_df=MIN_DF, max_terms=MAX_TERMS)


_TFIDF_SQL = f"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), {WORD2}),
                                      lambda w: w NOT IN {Q.in_list(sorted(set(STOP_WORDS)))}) AS toks FROM documents),
g AS (SELECT doc_id, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL),
st AS (SELECT term, count(*) AS df, sum(tf) AS tf_total FROM tf GROUP BY term),
nd AS (SELECT count(*) AS n FROM documents),
vocab AS (SELECT term, df, tf_total, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM st, nd WHERE df >= {MIN_DF}
          ORDER BY tf_total DESC, term LIMIT {MAX_TERMS}),
raw AS (SELECT tf.doc_id, tf.term, tf.tf * v.idf AS w FROM tf JOIN vocab v ON tf.term = v.term),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM raw GROUP BY doc_id)"""


@query("tfidf_terms", _TFIDF_SQL + """
SELECT term, CAST(df AS BIGINT) AS df, CAST(tf_total AS BIGINT) AS tf_total, round(idf, 6) AS idf FROM vocab""")
def tfidf_terms(spark, sf):
    return _tfidf(spark, sf)[0]


@query("tfidf_weights", _TFIDF_SQL + """
SELECT raw.doc_id, term, round(w / nrm, 6) AS weight FROM raw JOIN nrm ON raw.doc_id = nrm.doc_id""", headline=True)
def tfidf_weights(spark, sf):
    return _tfidf(spark, sf)[1]


# Stand-in for a word-keyed vector table: words hash to the table's ids and a tenth more, so
# that every vector can be met and some words have none.
_IDS_SQL = "(SELECT CAST(floor(max(vec_id) * 1.1) AS BIGINT) + 1 FROM embeddings)"


def _word_id(embeddings):
    n = embeddings.agg(F.max("vec_id")).first()[0]
    ids = int((n or 0) * 1.1) + 1
    return lambda w: FE.word_vector_id(w, ids)


@query("mean_pool", rf"""
WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\p{{Z}}]+'), lambda x: x <> '')) AS w FROM documents),
c AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {_IDS_SQL} AS vec_id, count(*) AS c FROM t GROUP BY ALL),
k AS (SELECT c.doc_id, c.c, unnest(list_transform(e.embedding, lambda v, i: {{'d': i - 1, 'v': v}})) AS x
      FROM c JOIN embeddings e ON c.vec_id = e.vec_id),
pd AS (SELECT doc_id, x.d AS dim, sum(c * CAST(x.v AS DOUBLE)) / sum(c) AS value FROM k GROUP BY doc_id, x.d),
grid AS (SELECT doc_id, unnest(range(0, (SELECT max(len(embedding)) FROM embeddings))) AS dim FROM documents)
SELECT grid.doc_id, CAST(grid.dim AS INTEGER) AS dim, round(coalesce(pd.value, 0.0), 6) AS value
FROM grid LEFT JOIN pd ON grid.doc_id = pd.doc_id AND grid.dim = pd.dim""", headline=True)
def mean_pool(spark, sf):
    t = U.tables(spark, sf)
    return FE.mean_pool(t.documents.select("doc_id", "text"), t.embeddings, word_id=_word_id(t.embeddings)).select(
        "doc_id", F.col("dim").cast("int").alias("dim"), "value")


_VECTORS: dict[tuple, str] = {}


def word_vectors(spark, sf):
    """Vectors of the corpus's words, made once a session and corpus, as a saved table."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _VECTORS:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/word-vectors-{uuid.uuid4().hex}"
        WV.word_vectors(U.tables(spark, sf).documents.select("text"), dim=32).write.parquet(path)
        _VECTORS[key] = path
    return FS.read_embeddings(spark, [_VECTORS[key]])


@query("word_vector_table")
def word_vector_table(spark, sf):
    """Word vectors by positive PMI and a randomised SVD, keyed by word."""
    return word_vectors(spark, sf).select("word", F.posexplode("vec").alias("dim", "value"))


@query("word_vector_pool")
def word_vector_pool(spark, sf):
    """Mean word vector of every document, words looked up by themselves."""
    docs = U.tables(spark, sf).documents.select("doc_id", F.lower("text").alias("text"))
    return FE.mean_pool(docs, word_vectors(spark, sf), vec_key="word", vec_col="vec", tokens=TX.word_tokens)


@query("label_encoding", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_idx FROM documents""")
def label_encoding(spark, sf):
    d = U.tables(spark, sf).documents.select("doc_id", "lang")
    model = FE.label_index(d, "lang")
    return model.transform(d).select("doc_id", "lang", F.col("lang_idx").cast("int").alias("lang_idx"))


def _labelled(spark, sf):
    """Labelled documents with a stratified ``split``, which is computed on the small
    (doc_id, label) table and then joined to the texts."""
    t = U.tables(spark, sf)
    keys = t.labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    return t.documents.select("doc_id", "text").join(SP.train_val_test(keys, "doc_id", "label", 0.1, 0.1, U.SEED), "doc_id")


_FITTED: dict[tuple, str] = {}


def fitted(spark, sf, name: str, fit):
    """The model ``fit()`` makes, fitted once a session and corpus: saved in the shared
    checkpoint folder, and loaded from there by every query that uses it."""
    from pyspark.ml import PipelineModel
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _FITTED:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{name}-{uuid.uuid4().hex}"
        MD.save_model(fit(), path)
        _FITTED[key] = path
    return PipelineModel.load(_FITTED[key])


def logreg(spark, sf):
    """Balanced logistic regression on the TF-IDF features of the train split."""
    return fitted(spark, sf, "logreg", lambda: MD.train_logreg(
        _labelled(spark, sf).where(F.col("split") == "train"), stop_words=STOP_WORDS))


def _pooled(spark, sf, s):
    """``s`` with ``features``, the documents' mean word vectors."""
    from pyspark.ml.functions import array_to_vector
    e = U.tables(spark, sf).embeddings
    vec = saved_table(FE.mean_pool_vectors(s.select("doc_id", "text"), e, word_id=_word_id(e)), "pooled")  # read for the weights and for the fit
    return s.drop("text").join(vec, "doc_id").withColumn("features", array_to_vector("vec")).drop("vec")


def svm(spark, sf):
    """Balanced linear SVM on the mean word vectors of the train split."""
    from pyspark.ml import PipelineModel
    return fitted(spark, sf, "svm", lambda: PipelineModel([MD.train_svm(
        _pooled(spark, sf, _labelled(spark, sf).where(F.col("split") == "train")))]))


_SCORED: dict[tuple, str] = {}


def trained_predictions(spark, sf):
    """Long predictions of the fitted models on the test split (as of the rules': one row per
    document and model), scored once a session and corpus and saved, since metrics read them many
    times and ask for columns that would each compute the features again."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SCORED:
        test = saved_table(_labelled(spark, sf).where(F.col("split") == "test"), "test")
        a = MD.apply_classifier(logreg(spark, sf), test, model_name="logreg")
        b = MD.apply_classifier(svm(spark, sf), _pooled(spark, sf, test), model_name="svm")
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/trained-scored-{uuid.uuid4().hex}"
        a.unionByName(b).write.parquet(path)
        _SCORED[key] = path
    return spark.read.parquet(_SCORED[key])


@query("logreg_report")
def logreg_report(spark, sf):
    """Balanced logistic regression on TF-IDF features: report on the held-out split."""
    test = _labelled(spark, sf).where(F.col("split") == "test")
    return M.classification_report(MD.apply_classifier(logreg(spark, sf), test, model_name="logreg"))


@query("svm_report")
def svm_report(spark, sf):
    """Balanced linear SVM on mean-pooled word vectors; probability = sigmoid(margin)."""
    test = _pooled(spark, sf, _labelled(spark, sf).where(F.col("split") == "test"))
    return M.classification_report(MD.apply_classifier(svm(spark, sf), test, model_name="svm"))


RUN_CS = [0.01, 0.1, 1.0, 10.0]


def _runs(spark, sf):
    """History of the SVM for several regularisations, fitted together on the train split and
    measured on the validation split."""
    both = _labelled(spark, sf).where(F.col("split") != "test").withColumn("held", F.col("split") == "val")
    rows = MD.with_balanced_weights(_pooled(spark, sf, both).select("label", "features", "held"))
    return NW.fit_runs(rows, "held", RUN_CS, weight="weight")[0]


@query("run_history")
def run_history(spark, sf):
    """A row for each step of each run: loss on the fitted rows, precision, recall and F1 beside."""
    return _runs(spark, sf).select("run", "c", "epoch", *[F.round(x, 6).alias(x) for x in ("loss", "precision", "recall", "f1")])


@query("best_fitted_run")
def best_fitted_run(spark, sf):
    """The step with the strictly greatest F1 of each run's history."""
    return C.best_run(_runs(spark, sf).select(F.concat(F.lit("svm C="), "c").alias("model"), "epoch", F.col("c").alias("threshold"), F.round("f1", 6).alias("f1")))


@query("linear_attribution")
def linear_attribution(spark, sf):
    """Per word of a held-out document: coefficient * (tf-idf weight - mean weight), top 10."""
    test = _labelled(spark, sf).where(F.col("split") == "test")
    return AT.linear_attribution(test, logreg(spark, sf), stop_words=STOP_WORDS)


@query("trained_model_metrics")
def trained_model_metrics(spark, sf):
    """Summary rows of the rule scorers and of both fitted models on the same held-out split."""
    test = _labelled(spark, sf).where(F.col("split") == "test").select("doc_id")
    rules = U.predictions(spark, sf).select("doc_id", "model", "y_true", "y_pred", "proba").join(test, "doc_id", "left_semi")
    return M.model_metrics(rules.unionByName(trained_predictions(spark, sf)))


@query("trained_paired_tests")
def trained_paired_tests(spark, sf):
    """McNemar counts of the SVM against the logistic regression on the held-out split."""
    return SG.mcnemar_counts(trained_predictions(spark, sf), "logreg")


@query("trained_cross_dataset")
def trained_cross_dataset(spark, sf):
    """The fitted logistic regression on its own held-out split and on a second labelled set:
    the page texts (tags stripped), labelled by page id."""
    t = U.tables(spark, sf)
    own = _labelled(spark, sf).where(F.col("split") == "test").select("doc_id", "text", "label")
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), "<[^>]*>", " ")
    pages = t.pages.select(F.col("page_id").alias("doc_id"), text.alias("text")).join(
        t.labels.select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id")
    model = logreg(spark, sf)
    scored = [MD.apply_classifier(model, d, model_name="logreg").withColumn("dataset", F.lit(n)) for n, d in (("documents", own), ("pages", pages))]
    return M.report_wide(scored[0].unionByName(scored[1]), by=("dataset",))
