"""Risk-controlled quality rules.

Each rule rejects a text whose measure is above a cutoff. On the labelled holdout, every cutoff
of a fixed grid gets an exact binomial (Clopper-Pearson) upper bound on the share of good
documents that it would reject, in every stratum; the confidence is shared between all tested
cutoffs of all rules and strata (Bonferroni). Of each rule and stratum, the lowest cutoff holds
from which the bound stays within the rule's share of ``risk``, so that with probability
``1 - delta`` no stratum rejects more than ``risk`` of its good documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_text, pick, save
from .words import SOLID, Words, mixed, ranges, run_bounds, span_hash, weights

# --- fixed values of the base rules ---------------------------------------------------------
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
# --------------------------------------------------------------------------------------------

RISK, DELTA, GRID = 0.05, 0.05, 64
#: rule -> measure of a row of counts, 0 to 1; higher is worse
RULES = {
    "symbols": lambda: F.least(F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(1.0)),
    "dup_lines": lambda: F.least(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.lit(1.0)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "long_words": lambda: 1 - F.lit(10.0) / F.greatest(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)), F.lit(10.0)),
    "short": lambda: F.lit(20.0) / F.greatest(F.col("n_words"), F.lit(20)),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def _later(key: np.ndarray) -> np.ndarray:
    """Which entries equal an earlier one."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def _by_row(values: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (at ascending byte positions ``at``) by text."""
    whole = np.concatenate([[0], np.cumsum(values)])
    edge = np.searchsorted(at, offsets)
    return whole[edge[1:]] - whole[edge[:-1]]


def counting():
    flags = np.zeros(256, bool)
    flags[list(SYMBOLS)] = True

    def make(column: pa.Array) -> list:
        words = Words(column, SOLID, lower=False)
        data, offsets, n = words.data, words.offsets, len(words.counts)
        salt = weights(n + 1, 17)
        begins = (data & 0xC0) != 0x80
        chars = _by_row((SOLID[data] & begins).astype(np.int64), np.arange(len(data)), offsets)
        symbols = _by_row(flags[data].astype(np.int64), np.arange(len(data)), offsets)
        # lines with a word, by the first and last byte of the line
        start, end = run_bounds(data != 10, offsets)
        solid = np.concatenate([[0], np.cumsum(SOLID[data])])
        some = solid[end] > solid[start]
        start, end = start[some], end[some]
        row = np.searchsorted(offsets, start, side="right") - 1
        twin = _later(mixed(span_hash(data, start, end) + salt[row]))
        dup, lines = np.bincount(row[twin], minlength=n), np.bincount(row, minlength=n)
        # windows of words
        made = np.maximum(words.counts - WINDOW + 1, 0)
        at = ranges(words.first[:-1], made)
        h, w = words.hashes(), weights(WINDOW, 19)
        key = salt[words.doc[at]].copy()
        for j in range(WINDOW):
            key += mixed(h[at + j] * w[j])
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        change = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(change, at[twice], 1)
        np.add.at(change, at[twice] + WINDOW, -1)
        inside = np.cumsum(change[:-1]) > 0
        repeated = np.bincount(words.doc[inside], minlength=n)
        return [words.counts, chars, symbols, dup, repeated, lines]

    return make


def counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and the counts of each text (null: all zero)."""
    return map_text(docs, text, keep, [T.StructField(c, T.LongType()) for c in COUNTS], counting)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest rate at which ``k`` or fewer of ``n`` still have probability ``delta``."""
    if k >= n:
        return 1.0
    first = max(0, k - 12 * math.isqrt(k) - 60)  # what lies further below adds nothing that a float shows
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(first, k + 1)]

    def below(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return sum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(log_choose, first))

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and below(mid) > delta else (low, mid)
    return high


def cutoffs(good: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA, grid: int = GRID) -> list[tuple]:
    """``(stratum, rule, cutoff)`` from the counts of good holdout documents: measures fall into
    ``grid`` steps, so what comes to the driver is rules x strata x steps numbers."""
    rows = good.select(F.col(stratum).alias("s"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.least(F.floor(m() * grid), F.lit(grid - 1)).cast("int").alias("step")) for r, m in RULES.items()])).alias("m"))
    seen = rows.groupBy("s", "m.rule", "m.step").agg(F.count("*").alias("n")).collect()
    strata = sorted({r["s"] for r in seen}, key=lambda s: (s is None, s))
    tests = max(1, len(strata) * len(RULES) * grid)
    out = []
    for s in strata:
        for rule in RULES:
            hist = [0] * grid
            for r in seen:
                if r["s"] == s and r["rule"] == rule:
                    hist[r["step"]] += r["n"]
            n, above, chosen = sum(hist), 0, grid
            for step in reversed(range(1, grid)):
                above += hist[step]
                if binomial_upper(above, n, delta / tests) > risk / len(RULES):
                    break
                chosen = step
            out.append((s, rule, chosen / grid))
    return out


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id", text: str = "text",
          quality: str = "quality", risk: float = RISK, delta: float = DELTA, grid: int = GRID) -> DataFrame:
    """``doc_id``, the counts, ``base_failed``, ``failed`` (rules whose cutoff is passed) and
    ``kept`` of every row. The holdout is every document with a label; those of quality 1 are
    good (repeated labels count once for each row and label). Strata without good documents, too
    few for the bound, or with a null name among none labelled, have no cutoff: only the base
    rules judge them. Null texts have no words and fail the base rules."""
    rows = save(counts(pick(docs, doc_id=doc_id, text=text, stratum=stratum), ["doc_id", "stratum"]), "counts")
    good = pick(labels, doc_id=doc_id, quality=quality).where("quality = 1").select("doc_id")
    # The base rules come first: only what they leave can be rejected by a cutoff.
    known = rows.where(~base_failed()).join(good, "doc_id")
    found = cutoffs(known, "stratum", risk, delta, grid)
    by_rule = {r: {s: c for s, rule, c in found if rule == r and c < 1 and s is not None} for r in RULES}
    none = {r: next((c for s, rule, c in found if rule == r and s is None), 1.0) for r in RULES}

    def passed(rule: str) -> Column:
        table = by_rule[rule]
        cut = F.when(F.col("stratum").isNull(), F.lit(none[rule]))
        for s, c in table.items():
            cut = cut.when(F.col("stratum") == F.lit(s), F.lit(c))
        return RULES[rule]() >= cut.otherwise(F.lit(2.0)) if none[rule] < 1 or table else F.lit(False)

    failed = F.array_compact(F.array(*[F.when(passed(r), F.lit(r)) for r in RULES]))
    return (rows.withColumn("base_failed", base_failed()).withColumn("failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("stratum"))
