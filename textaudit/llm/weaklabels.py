"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every document: good, bad or no opinion. The counts of
all vote combinations over the whole table (at most ``3 ** labellers`` rows) go through
expectation-maximisation, which estimates the labellers' accuracies and each combination's
posterior. The posteriors label a bounded sample of documents, on whose hashed words and counts
a linear scorer is trained, which then scores every document."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_text, pick
from .quality import COUNTS, RULES, counting
from .words import ALNUM, Words, mixed, span_hash, utf8

# --- fixed values: frequent function words of the languages looked for ----------------------
FUNCTION_WORDS = """the of and to in a is that for it with as was on be by this are or from
de la le les des et en un une du que est pour dans qui sur pas au par
der die das und in den von zu mit sich auf ist im dem nicht ein eine als
el los las del y que se por con para una su al lo como es no""".split()
# --------------------------------------------------------------------------------------------

#: Documents of the training sample (expected; chosen by hash), the features that all of them may
#: have together (12 bytes each on the driver), and hashed features.
SAMPLE, MOST_FEATURES, BUCKETS, THRESHOLD = 6_000, 8 << 20, 1 << 13, 0.5
ABSTAIN, FIRST = 2, 0.3
SHARES = ["function", "finished", "letters", "capitals"]


def _shares():
    """Share of function words among the words, of lines with a word that end a sentence, of
    ASCII letters and non-ASCII bytes among the solid ones, and of capitals among ASCII letters."""
    joined = [w.encode() for w in sorted(set(FUNCTION_WORDS))]
    ends = np.cumsum([len(w) for w in joined])
    known = np.sort(span_hash(np.frombuffer(b"".join(joined), np.uint8), np.r_[0, ends[:-1]], ends))
    count = counting()
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    stop = np.zeros(256, bool)
    stop[list(b".!?:;\"')")] = True

    def make(column: pa.Array) -> list:
        counts = count(column)
        words = Words(column, ALNUM, lower=True)
        h = words.hashes()
        hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
        n = len(words.counts)
        function = np.bincount(words.doc[hit], minlength=n) / np.maximum(words.counts, 1)
        data, offsets = words.data, words.offsets
        solid = (data != 10) & (data != 32) & (data != 9) & (data != 13)
        whole = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
        # The last solid byte of a line: the next one starts another line or text.
        at = np.flatnonzero(solid)
        line = np.cumsum(np.r_[False, data[:-1] == 10])[at] if len(data) else at
        row = np.searchsorted(offsets, at, side="right") - 1
        last = np.r_[(line[1:] != line[:-1]) | (row[1:] != row[:-1]), True] if len(at) else np.zeros(0, bool)
        lines = np.bincount(row[last], minlength=n)
        finished = np.bincount(row[last & stop[data[at]]], minlength=n) / np.maximum(lines, 1)
        letters = whole(letter[data]) / np.maximum(whole(solid), 1)
        raw, _ = utf8(column)
        capital = (raw >= 65) & (raw <= 90)
        capitals = whole(capital) / np.maximum(whole((data >= 97) & (data <= 122)), 1)
        return [*counts, function, finished, letters, capitals]

    return make


def _band(measure: F.Column, bad: float, good: float) -> F.Column:
    """1 up to ``good``, 0 above ``bad``, no opinion between."""
    return F.when(measure <= good, 1).when(measure > bad, 0).otherwise(ABSTAIN)


def _worded(vote: F.Column) -> F.Column:
    """``vote``, but no opinion of a text without words."""
    return F.when(F.col("n_words") == 0, ABSTAIN).otherwise(vote)


#: The labellers, over the counts and shares of a document.
LABELLERS = {
    "symbols": lambda: _worded(_band(RULES["symbols"](), 0.2, 0.03)),
    "repeats": lambda: _worded(_band(RULES["repeats"](), 0.3, 0.1)),
    "dup_lines": lambda: F.when(F.col("n_lines") < 3, ABSTAIN).otherwise(_band(RULES["dup_lines"](), 0.3, 0.1)),
    "length": lambda: F.when(F.col("n_words") >= 40, 1).when(F.col("n_words") < 10, 0).otherwise(ABSTAIN),
    "function": lambda: F.when(F.col("n_words") < 10, ABSTAIN).otherwise(_band(1 - F.col("function"), 0.97, 0.85)),
    "finished": lambda: _band(1 - F.col("finished"), 0.8, 0.4),
    "letters": lambda: _band(1 - F.col("letters"), 0.3, 0.15),
    "capitals": lambda: _worded(_band(F.col("capitals"), 0.3, 0.15)),
}


FIELDS = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in SHARES]


def votes() -> F.Column:
    """A digit for each labeller, from a row's counts and shares."""
    return F.concat_ws("", *[v().cast("string") for v in LABELLERS.values()])


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, counts, shares and ``votes`` of each row."""
    return map_text(docs, text, [k for k in keep if k.lower() != "votes"], FIELDS, _shares).withColumn("votes", votes())


@dataclass
class Accuracies:
    """Documents, share of good ones, each labeller's accuracy on good and on bad ones, and
    the probability of good by vote combination."""

    documents: int
    prior: float
    right: list[tuple[float, float]]
    posterior: dict[str, float]


def accuracies(rows: DataFrame, rounds: int = 100) -> Accuracies:
    """Expectation-maximisation on the counts of vote combinations, from the belief that every
    vote against a document speaks (``FIRST``). A labeller that sees one fault finds few of the
    bad documents, so its accuracy on them may be low, but never below what it says of good
    ones. A few imagined votes keep labellers that never speak at a guess."""
    seen = sorted((r["votes"], r["n"]) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect())
    prior, right = 0.8, []

    def good(votes: str) -> float:
        yes, no = math.log(prior), math.log(1 - prior)
        for v, (hit, miss) in zip(votes, right):
            if int(v) != ABSTAIN:
                yes += math.log(hit if v == "1" else 1 - hit)
                no += math.log(1 - miss if v == "1" else miss)
        return 1 / (1 + math.exp(min(700.0, no - yes)))

    for _ in range(rounds):
        belief = [(good(v) if right else FIRST ** v.count("0") * 0.95, v, n) for v, n in seen]
        total = sum(n for *_, n in belief)
        prior = (sum(p * n for p, _, n in belief) + 8) / (total + 10)
        right = []
        for j in range(len(LABELLERS)):
            own = [(p, v[j] == "1", n) for p, v, n in belief if int(v[j]) != ABSTAIN]
            hit = (sum(p * n for p, v, n in own if v) + 8) / (sum(p * n for p, _, n in own) + 10)
            miss = (sum((1 - p) * n for p, v, n in own if not v) + 7) / (sum((1 - p) * n for p, _, n in own) + 10)
            right.append((hit, max(miss, 1 - hit)))
    return Accuracies(sum(n for _, n in seen), prior, right, {v: good(v) for v, _ in seen})


def _buckets(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bag of words by text: row, bucket and log count, scaled to length 1 a row."""
    shape = words.hashes()
    pair = np.unique(words.doc.astype(np.uint64) * np.uint64(BUCKETS) + mixed(shape) % np.uint64(BUCKETS), return_counts=True)
    row, bucket = (pair[0] // BUCKETS).astype(np.int64), (pair[0] % BUCKETS).astype(np.int64)
    value = np.log1p(pair[1])
    norm = np.sqrt(np.bincount(row, value * value, len(words.counts)))
    return row, bucket, value / norm[row]


def _dense(counts: list[np.ndarray]) -> np.ndarray:
    """Counts and shares as features of a few units."""
    c = dict(zip([*COUNTS, *SHARES], [np.asarray(x, np.float64) for x in counts]))
    n = np.maximum(c["n_words"], 1)
    return np.stack([np.minimum(c["n_symbols"] / n, 2), c["n_repeat_words"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
                     np.log1p(c["n_words"]) / 5, np.minimum(c["word_chars"] / n, 30) / 10, c["function"], c["finished"], c["letters"], c["capitals"]], axis=1)


def sampled(docs: DataFrame, n: int, sample: int) -> DataFrame:
    """About ``sample`` of ``n`` rows (all of a smaller table) by a hash of their texts, each text
    once, with the hash as ``place``."""
    share = min(1.0, sample / max(1, n))
    near = docs.withColumn("place", F.xxhash64("text"))
    near = near if share == 1 else near.where(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)))
    return near.groupBy("place").agg(F.first("text").alias("text"))


def train(rows: DataFrame, text: str, model: Accuracies, epochs: int = 30, rate: float = 0.3, ridge: float = 1e-5,
          most: int = MOST_FEATURES) -> np.ndarray:
    """Weights of the hashed linear scorer, by stochastic gradient steps on a sample (``text``,
    ``votes`` and ``place``); targets are the posteriors of the votes. In the order of ``place``,
    rows are taken while they have at most ``most`` features together, so the driver holds no more."""
    fields = [T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.DoubleType()))]

    def start():
        shares = _shares()

        def make(column: pa.Array) -> list:
            words = Words(column, ALNUM, lower=True)
            row, bucket, value = _buckets(words)
            dense = _dense(shares(column))
            edge = np.searchsorted(row, np.arange(len(words.counts) + 1))
            extra = np.arange(BUCKETS, BUCKETS + dense.shape[1])
            return [[np.r_[bucket[a:b], extra].tolist() for a, b in zip(edge, edge[1:])],
                    [np.r_[value[a:b], d].tolist() for a, b, d in zip(edge, edge[1:], dense)]]

        return make

    told = map_text(rows, text, ["place", "votes"], fields, start)
    so_far = F.sum(F.size("buckets")).over(Window.orderBy("place", "votes"))
    got = told.withColumn("_m", so_far).where(F.col("_m") <= most).drop("_m", "place").toArrow().combine_chunks()
    weights = np.zeros(BUCKETS + len(_dense([np.zeros(1)] * (len(COUNTS) + len(SHARES)))[0]) + 1)
    if not got.num_rows:
        return weights
    lists, numbers = (got[c].combine_chunks() for c in ("buckets", "values"))
    cuts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
    where, value = np.split(lists.flatten().to_numpy(), cuts), np.split(numbers.flatten().to_numpy(), cuts)
    target = [model.posterior[v] for v in got["votes"].to_pylist()]
    order = sorted(range(len(target)), key=lambda i: (hash_of(i), i))
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in order:
            z = weights[where[i]] @ value[i] + weights[-1]
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target[i]
            weights[where[i]] -= step * (error * value[i] + ridge * weights[where[i]])
            weights[-1] -= step * error
    return weights


def hash_of(i: int) -> int:
    return (i * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)


def score(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, counts, shares and ``score``, the probability of good quality."""

    def start():
        shares = _shares()

        def make(column: pa.Array) -> list:
            words = Words(column, ALNUM, lower=True)
            row, bucket, value = _buckets(words)
            counts = shares(column)
            z = np.bincount(row, weights[bucket] * value, len(words.counts)) + _dense(counts) @ weights[BUCKETS:-1] + weights[-1]
            return [*counts, 1 / (1 + np.exp(-np.clip(z, -30, 30)))]

        return make

    return map_text(docs, text, keep, [*FIELDS, T.StructField("score", T.DoubleType())], start)


def classify(docs: DataFrame, keep: list[str], text: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The ``keep`` columns, ``n_words``, ``votes``, ``posterior`` (of the votes), ``score`` (of
    the scorer) and ``kept`` (``score`` at least ``threshold``) of every row. Null and empty
    texts have no words: the length, line and letter labellers speak against them, no other has an
    opinion. An empty table gives no rows; equal texts get equal scores. All texts are read twice, once for the vote
    counts and once for the scores; only the sample is read in between."""
    made = ["votes", "posterior", "score", "kept", *COUNTS, *SHARES]
    keep = [k for k in keep if k.lower() not in made]
    own = [f"k{i}" for i in range(len(keep))]
    whole = pick(docs, **dict(zip(own, keep)), text=text)
    model = accuracies(measured(whole, []))
    weights = train(measured(sampled(whole, model.documents, sample), ["text", "place"]), "text", model)
    scored = score(whole, weights, own).withColumn("votes", votes())
    table = F.create_map(*[F.lit(x) for v, p in sorted(model.posterior.items()) for x in (v, float(p))]) if model.posterior else None
    posterior = F.try_element_at(table, F.col("votes")) if table is not None else F.lit(0.0)
    return scored.select(*[F.col(o).alias(k) for o, k in zip(own, keep)], "n_words", "votes", posterior.alias("posterior"),
                         "score", (F.col("score") >= threshold).alias("kept"))
