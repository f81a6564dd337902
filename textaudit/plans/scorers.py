"""Queries through the scorer extension point: batch scoring with a loaded model, and Shapley
attributions of scorers that are plain functions of a text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import models as MD
from ..operators import shapley as SH
from . import features as FQ
from . import setup as U
from .registry import query

# A linear scorer over the words of the rule scorers: term -> (idf, coefficient).
TERMS = {w: (1.0 + 0.25 * (i % 3), 1.5 - 0.5 * (i % 7)) for i, w in enumerate(sorted({w for m in U.MODELS for w in m.words if len(w) > 1}))}
INTERCEPT = -0.75
_TERM_ROWS = ", ".join(f"('{w}', CAST({i!r} AS DOUBLE), CAST({c!r} AS DOUBLE))" for w, (i, c) in TERMS.items())


@query("batch_scores", rf"""
WITH v(term, idf, coef) AS (VALUES {_TERM_ROWS}),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents),
c AS (SELECT doc_id, term, count(*) AS n FROM t WHERE term IN (SELECT term FROM v) GROUP BY ALL),
z AS (SELECT doc_id, sum(n * idf * coef) / sqrt(sum((n * idf) * (n * idf))) AS z FROM c JOIN v USING (term) GROUP BY 1)
SELECT doc_id, round(1.0 / (1.0 + exp(-({INTERCEPT} + coalesce(z, 0.0)))), 6) AS proba FROM documents LEFT JOIN z USING (doc_id)""")
def batch_scores(spark, sf):
    """All documents by a linear scorer that each worker loads once, 32 texts at a time."""
    model = spark.sparkContext.broadcast(MD.LinearText(TERMS, INTERCEPT))
    scored = MD.batch_scorer(U.tables(spark, sf).documents.select("doc_id", "text"), lambda: model.value, 32)
    return scored.select("doc_id", F.round("proba", 6).alias("proba"))


@query("batch_scores_fitted")
def batch_scores_fitted(spark, sf):
    """All documents by the fitted logistic regression's weights, loaded once a worker."""
    model = spark.sparkContext.broadcast(MD.linear_text(FQ.logreg(spark, sf), FQ.STOP_WORDS))
    scored = MD.batch_scorer(U.tables(spark, sf).documents.select("doc_id", "text"), lambda: model.value, 32)
    return scored.select("doc_id", F.round("proba", 6).alias("proba"))


# Weights of an additive scorer: the sum over a text's word occurrences.
ADDITIVE = {w: (1 + i % 5) * (-1) ** i / 64 for i, w in enumerate(["the", "of", "and", "to", "in", "that", "is", "was", "with", "for", "he", "are"])}


def _words_of():
    """Words of a text as in :func:`TX.word_tokens`: plain ASCII by a byte table, else by the pattern."""
    import regex
    word = regex.compile(TX.WORD_RE)
    plain = str.maketrans({c: " " for c in map(chr, range(128)) if not (c.isalnum() or c == "_")})

    def words(text: str) -> list[str]:
        return text.lower().translate(plain).split() if text.isascii() else word.findall(text.lower())
    return words


def _additive():
    words, given = _words_of(), ADDITIVE.get
    return lambda texts: [sum([given(w, 0.0) for w in words(t)]) for t in texts]


@query("shapley_additive", rf"""
WITH v(word, weight) AS (VALUES {", ".join(f"('{w}', CAST({x!r} AS DOUBLE))" for w, x in ADDITIVE.items())}),
t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+')) AS word FROM conversations),
c AS (SELECT conv_id, turn, word, count(*) * coalesce(any_value(weight), 0.0) AS score FROM t LEFT JOIN v USING (word) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY abs(score) DESC, word) AS rank FROM c)
SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, word, round(score, 6) AS score FROM r WHERE rank <= 10""")
def shapley_additive(spark, sf):
    """Shapley values of the words of every turn for an additive scorer: each word's own sum."""
    turns = U.tables(spark, sf).conversations.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    got = SH.shapley_attribution(turns, _additive, "id")
    part = F.split("id", ":")
    return got.select(part[0].cast("bigint").alias("conv_id"), part[1].cast("bigint").alias("turn"), "rank", "word", "score")


class RuleScorer(SH.SumScorer):
    """A rule scorer as a function of texts: of how many lexicon words and other words they have."""

    def __init__(self, rule: MD.RuleModel):
        self.rule, self.words, self.known = rule, _words_of(), frozenset(rule.words)

    def features(self, texts):
        found = [self.words(t) for t in texts]
        hits = np.array([sum(map(self.known.__contains__, ws)) for ws in found], np.float64)
        return np.array([hits, [len(ws) for ws in found] - hits])

    def value(self, sums):
        return 1 / (1 + np.exp(-(self.rule.intercept + self.rule.slope * sums[0] / np.maximum(sums[0] + sums[1], 1))))


@query("shapley_rule_scorer")
def shapley_rule_scorer(spark, sf):
    """Shapley values for a rule scorer (a sigmoid of the share of lexicon words): not additive,
    but of sums alone, so that the values over all orders are exact."""
    rule = U.MODELS[0]
    turns = U.tables(spark, sf).conversations.select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return SH.shapley_attribution(turns, lambda: RuleScorer(rule), "id").drop("error", "evaluations")
