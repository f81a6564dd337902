"""Scoring: the scorer extension point, rule scorers as column expressions, Spark ML
pipelines (logistic regression, linear SVM) and their persistence.

A scorer is any ``DataFrame(key, text) -> DataFrame(key, proba)``. Rule scorers stay
JVM-side; an arbitrary Python scorer runs batch-wise through ``mapInPandas`` (Arrow).
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as TX
from . import newton as NW


@dataclass(frozen=True)
class RuleModel:
    """proba = sigmoid(intercept + slope * hits / max(n_tokens, 1)), unrounded;
    hits = tokens found in ``words``."""
    name: str
    words: tuple
    intercept: float
    slope: float
    meta: dict = field(default_factory=dict, compare=False, hash=False)

    def hits(self, tokens: Column) -> Column:
        # a membership test, which the optimizer turns into a hash set: any lexicon size
        return F.size(F.filter(tokens, lambda t: t.isin(*self.words)))

    def proba(self, tokens: Column) -> Column:
        x = F.lit(self.intercept) + F.lit(self.slope) * self.hits(tokens) / F.greatest(F.size(tokens), F.lit(1))
        return TX.sigmoid(x)


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Hits per document for a lexicon that is a table: words are counted inside the row, then
    joined to the lexicon (broadcast if the planner measures it below its threshold, else
    shuffled, with a hot word's partition split by AQE) and summed on the map side first."""
    counts = TX.with_counts(docs.select(key, text), TX.word_tokens(text)).select(key, TX.explode_rows(F.col("counts")).alias("t"))
    hits = (counts.where(F.col("t").isNotNull()).select(key, F.col("t.word").alias("word"), F.col("t.c").alias("c"))
            .join(lexicon.select("word").distinct(), "word").groupBy(key).agg(F.sum("c").cast("long").alias("hits")))
    return docs.select(key).join(hits, key, "left").fillna(0, ["hits"])


def score_rules_wide(docs: DataFrame, models, key: str = "doc_id", text: str = "text", keep=()) -> DataFrame:
    """One pass over the corpus: tokens once, one probability column per model."""
    tok = docs.select(key, *keep, TX.word_tokens(text).alias("_tok"))
    return tok.select(key, *keep, *[m.proba(F.col("_tok")).alias(m.name) for m in models])


def to_long(wide: DataFrame, model_names, key: str = "doc_id", keep=()) -> DataFrame:
    """Wide per-model probabilities -> long ``(key, keep..., model, proba)``."""
    arr = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("proba")) for m in model_names])
    return wide.select(key, *keep, F.explode(arr).alias("s")).select(key, *keep, "s.model", "s.proba")


def build_predictions(docs: DataFrame, truth: DataFrame, models, key: str = "doc_id", text: str = "text",
                      truth_col: str = "y_true", keep=(), threshold: float = 0.5) -> DataFrame:
    """Long predictions ``(key, keep..., model, y_true, y_pred, proba)``.

    Scores are computed on the corpus side before the join, so the join shuffles only keys,
    group columns and probabilities, never texts."""
    wide = score_rules_wide(docs, models, key, text, keep)
    joined = wide.join(truth.select(key, F.col(truth_col).cast("int").alias("y_true")), key)
    long = to_long(joined, [m.name for m in models], key, keep=(*keep, "y_true"))
    return long.select(key, *keep, "model", "y_true", (F.col("proba") >= threshold).cast("int").alias("y_pred"),
                       "proba")


def python_scorer(docs: DataFrame, fn, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Run an arbitrary batch scorer ``fn(list[str]) -> list[float]`` over Arrow batches."""
    def run(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "proba": list(fn(pdf[text].fillna("").tolist()))})
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, schema=f"`{key}` {kind}, proba double")


@dataclass(frozen=True)
class LinearText:
    """A linear model over term weights as a plain batch function, so that it can be sent to
    tasks: ``terms`` -> (idf, coefficient); uni- and bigrams of lower-cased runs of 2+ word
    characters without ``stop_words``, counts times idf, length 1 a text, then the sigmoid."""
    terms: dict
    intercept: float = 0.0
    stop_words: tuple = ()

    def __call__(self, texts) -> list[float]:
        import math

        import regex
        word, stops, out = regex.compile(TX.WORD2_RE), set(self.stop_words), []
        for text in texts:
            tokens = [t for t in word.findall((text or "").lower()) if t not in stops]
            counts = Counter(t for t in (*tokens, *map(" ".join, zip(tokens, tokens[1:]))) if t in self.terms)
            weights = {t: n * self.terms[t][0] for t, n in counts.items()}
            norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
            z = self.intercept + sum(w * self.terms[t][1] for t, w in weights.items()) / norm
            out.append(1 / (1 + math.exp(-z)) if z > -700 else 0.0)
        return out


def linear_text(pipeline_model, stop_words=()) -> LinearText:
    """The scorer of a fitted (TF-IDF -> linear model) pipeline; its vocabulary is capped by the fit."""
    stages = pipeline_model.stages
    vocabulary = next(st for st in stages if hasattr(st, "vocabulary")).vocabulary
    idf = next(st for st in stages if hasattr(st, "getScalingVec")).getScalingVec().toArray().tolist()
    coef = stages[-1].coefficients.toArray().tolist()
    return LinearText(dict(zip(vocabulary, zip(idf, coef))), float(stages[-1].intercept), tuple(sorted(set(stop_words))))


def batch_scorer(docs: DataFrame, load, batch_size: int = 32, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, proba)`` by a model that every worker process loads once: ``load()`` returns
    ``score(list of texts) -> numbers``, which is given ``batch_size`` texts at a time (null: empty).

    What ``load`` reads must be reachable for every executor: values it carries, a broadcast
    (``docs.sparkSession.sparkContext.broadcast``), or an installed package."""
    from pyspark.ml.functions import predict_batch_udf

    def make():
        import numpy as np
        score = load()
        return lambda texts: np.asarray(score([str(t) for t in texts]), dtype=np.float64)

    predict = predict_batch_udf(make, return_type=T.DoubleType(), batch_size=batch_size)
    return docs.select(key, predict(F.coalesce(F.col(text), F.lit(""))).alias("proba"))


def sigmoid_of_margin(margin: Column) -> Column:
    """Probability from a decision value."""
    return TX.sigmoid(margin)


# --- Spark ML pipelines ----------------------------------------------------------------

def text_features(train: DataFrame, vocab_size: int = 10000, min_df: int = 2, stop_words=(), key: str = "doc_id") -> list:
    """Fitted stages ``text`` -> ``features``: uni- and bigram counts of the training set's
    vocabulary, times ln((1 + n) / (1 + df)) + 1, L2-normalised - the weights of
    :func:`features.tfidf_terms`, as vectors. The vocabulary (at most ``vocab_size`` terms) comes
    from the same operator, so both break ties alike."""
    from pyspark.ml.feature import (CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer,
                                    StopWordsRemover)
    from pyspark.ml.linalg import Vectors
    from . import features as FE
    vocab = FE.tfidf_vocabulary(FE.term_tokens(train, key, "text", stop_words), train.count(), min_df, vocab_size).collect()
    vocab = sorted(vocab, key=lambda r: (-r["tf_total"], r["term"]))
    filled = SQLTransformer(statement="SELECT *, coalesce(text, '') AS text_filled FROM __THIS__")
    words = RegexTokenizer(inputCol="text_filled", outputCol="words", gaps=False, pattern=TX.WORD2_RE, toLowercase=True)
    kept = StopWordsRemover(inputCol="words", outputCol="kept", stopWords=sorted(set(stop_words)) or [""], caseSensitive=True)
    pairs = NGram(inputCol="kept", outputCol="pairs", n=2)
    grams = SQLTransformer(statement="SELECT *, concat(kept, pairs) AS grams FROM __THIS__")
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in vocab] or [" "], inputCol="grams", outputCol="tf")
    idf = ElementwiseProduct(inputCol="tf", outputCol="tfidf", scalingVec=Vectors.dense([r["idf"] for r in vocab] or [1.0]))
    return [filled, words, kept, pairs, grams, counts, idf, Normalizer(inputCol="tfidf", outputCol="features", p=2.0)]


def with_balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Per-row weight n / (k * count(class)) (scikit-learn's ``balanced``)."""
    from .features import class_weights
    columns = df.columns
    w = class_weights(df, label, mode="balanced")
    joined = df.join(F.broadcast(w.select(F.col("cls").alias(label), F.col("weight").alias("weight"))), label)
    # every optimiser step is a job over these rows: partitions of the advisory size, few or many
    return joined.select(*columns, "weight").hint("rebalance")


def as_spark_model(kind: str, fit):
    """A Spark ML model (``logistic`` or ``squared_hinge``) of fitted coefficients, for pipelines,
    saving and loading."""
    from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import SparkSession
    sc = SparkSession.active().sparkContext
    wrapper, name = (LogisticRegressionModel, "LogisticRegressionModel") if kind == "logistic" else (LinearSVCModel, "LinearSVCModel")
    made = getattr(sc._jvm.org.apache.spark.ml.classification, name)
    return wrapper(made(f"{kind}_{uuid.uuid4().hex[:12]}", _py2java(sc, Vectors.dense(fit.coefficients)), float(fit.intercept)))


def train_logreg(train: DataFrame, max_iter: int = NW.MOST_PASSES, label: str = "label", stop_words=(), tol: float = 1e-5,
                 key: str = "doc_id"):
    """Balanced logistic regression on TF-IDF features, C = 1, intercept not regularised, by
    Newton steps (at most ``max_iter`` passes). Features are computed once; the fit keeps them
    and reads no text. The sample of its curvature goes by a hash of ``key``."""
    from pyspark.ml import PipelineModel
    feats = PipelineModel(text_features(train, stop_words=stop_words, key=key))
    data = with_balanced_weights(feats.transform(train).select(key, label, "features"), label)
    fit = NW.fit_linear(data, "logistic", label, weight="weight", key=key, tol=tol, most=max_iter)
    return PipelineModel([*feats.stages, as_spark_model("logistic", fit)])


def train_svm(train: DataFrame, max_iter: int = NW.MOST_PASSES, label: str = "label", features: str = "features",
              tol: float = 1e-6):
    """Balanced linear SVM on given feature vectors: squared hinge loss, C = 1, the intercept
    regularised as the weight of a constant feature; by Newton steps."""
    data = with_balanced_weights(train.select(label, features), label)
    return as_spark_model("squared_hinge", NW.fit_linear(data, "squared_hinge", label, features, "weight", regularise_intercept=True, tol=tol, most=max_iter))


def apply_classifier(model, df: DataFrame, key: str = "doc_id", label: str = "label",
                     model_name: str = "model", threshold: float = 0.5) -> DataFrame:
    """Long predictions from a fitted Spark ML model: probability of class 1 when the model
    has one, else the sigmoid of the margin."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    if "probability" in out.columns:
        proba = vector_to_array("probability")[1]
    else:
        proba = sigmoid_of_margin(vector_to_array("rawPrediction")[1])
    return out.select(key, F.lit(model_name).alias("model"), F.col(label).cast("int").alias("y_true"),
                      (proba >= threshold).cast("int").alias("y_pred"), proba.alias("proba"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def prediction_registry(providers: dict, on_error=None) -> DataFrame | None:
    """Union of the prediction sets that can be produced, each tagged with its ``model``.

    ``providers`` maps a model name to a callable returning its predictions (scoring a
    model, or reading stored predictions as a fallback). A provider that fails is skipped
    with a notice through ``on_error(name, exc)``; nothing is collected."""
    import warnings
    out = None
    for name, make in providers.items():
        try:
            df = make().withColumn("model", F.lit(name))
            df.schema  # resolve now, so a missing input fails here rather than later
        except Exception as exc:  # noqa: BLE001 - a failing provider is skipped by design
            (on_error or (lambda n, e: warnings.warn(f"skipping predictions of {n}: {e}")))(name, exc)
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
