"""Language identification by word-first backoff.

A known word scores its log frequency in each language; a word that no language knows falls
back to its character n-grams, the longest order of which any is known (boundaries count as
characters). A text's score in a language is the mean over its words.

The model is fitted on a bounded sample of the labelled texts, the same number of bytes in each
language, and broadcast: at every size a prediction is one pass over the texts, whole, without a
shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_text, pick, text_slices
from .words import code_points, mixed, ranges, run_bounds, utf8, weights

ORDER, EVIDENCE = 4, 32
#: Bytes of labelled text that the model is fitted on, shared alike by the languages, whatever the
#: corpus; and how many languages there may be (a word has a score in each).
SAMPLE_BYTES, MOST_LANGS = 32 << 20, 200
EDGE, UNKNOWN = 32, "und"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = 0x110000
    return np.fromiter((chr(c).isalpha() for c in range(n)), bool, n), np.fromiter((ord(chr(c).lower()[0]) for c in range(n)), np.uint32, n)


class LetterWords:
    """Lower-cased runs of letters of a slice of texts, and their distinct words."""

    def __init__(self, column: pa.Array, group: np.ndarray | None = None):
        data, offsets = utf8(column)
        letter, lower = _tables()
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        at = code_points(data)[offsets]
        self.start, end = run_bounds(letter[points], at)
        self.size = end - self.start
        self.points = lower[points].astype(np.uint64)
        self.first = np.searchsorted(self.start, at)
        self.counts = np.diff(self.first)
        if len(self.start):
            w = weights(int(self.size.max()) + 1, 11)
            first = np.cumsum(self.size) - self.size
            place = ranges(self.start, self.size)
            terms = w[place - np.repeat(self.start, self.size) + 1] * (self.points[place] + np.uint64(1))
            self.hash = mixed(np.add.reduceat(terms, first) + self.size.astype(np.uint64) * w[0])
        else:
            self.hash = np.zeros(0, np.uint64)
        self.group = np.zeros(len(self.start), np.int64) if group is None else np.repeat(group, self.counts)
        key = mixed(self.hash + self.group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, self.sample, self.word, self.times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)

    def grams(self, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the ``n``-grams of the distinct words ``of`` (edges as one character each,
        but for single characters) and the word, as an index into ``of``, of each."""
        edge = int(n > 1)
        start, size = self.start[self.sample[of]], self.size[self.sample[of]]
        padded = size + 2 * edge
        at = np.cumsum(padded) - padded
        text = np.full(int(padded.sum()), EDGE, np.uint64)
        text[ranges(at + edge, size)] = self.points[ranges(start, size)]
        made = np.maximum(padded - n + 1, 0)
        begin, owner = ranges(at, made), np.repeat(np.arange(len(of)), made)
        w = weights(n + 1, 13)
        h = np.full(len(begin), n, np.uint64) * w[0]
        for j in range(n):
            h += w[j + 1] * (text[begin + j] + np.uint64(1))
        return mixed(h), owner


def _counting(order: int):
    schema = "lang string, kind int, h bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 1):
                names = part.column(0).dictionary_encode()
                words = LetterWords(part.column(1), names.indices.to_numpy(zero_copy_only=False))
                langs, made = words.group[words.sample], []
                made.append((langs, 0, words.hash[words.sample], words.times))
                for n in range(1, order + 1):
                    h, owner = words.grams(np.arange(len(words.sample)), n)
                    lang = langs[owner]
                    _, first, inverse = np.unique(mixed(h + lang.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
                    made.append((lang[first], n, h[first], np.bincount(inverse, words.times[owner], len(first)).astype(np.int64)))
                for lang, kind, h, n in made:
                    yield pa.RecordBatch.from_arrays([
                        pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), names.dictionary).cast(pa.string()),
                        pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "kind", "h", "n"])

    return run, schema


@dataclass
class Model:
    """Languages, sorted; by kind (0: words, n: n-grams) the sorted hashes and their log
    frequencies by language; and the score of what a language does not know."""

    langs: list[str]
    hashes: list[np.ndarray]
    scores: list[np.ndarray]
    floor: list[float]


def sampled(rows: DataFrame, langs: int, total: dict[str, int], sample_bytes: int) -> DataFrame:
    """Of ``rows(lang, text)`` distinct texts in the order of their hash, of each language up to the
    one with which they reach its share of ``sample_bytes``. Only texts whose hash is below twice
    the share wanted are looked at, so no task orders more than about that."""
    share = sample_bytes / max(1, langs)
    below = F.create_map(*[x for a, n in total.items() for x in (F.lit(a), F.lit(min(1.0, 2 * share / max(1, n))))])
    place = F.shiftrightunsigned(F.xxhash64("text"), 11).cast("double") / float(1 << 53)
    near = rows.withColumn("_at", place).where(F.col("_at") <= F.element_at(below, F.col("lang")))
    once = near.groupBy("lang", "_at").agg(F.first("text").alias("text"))
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    return once.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < share).select("lang", "text")


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Model of a sample of the rows with a language and a text, ``sample_bytes`` in all (all rows
    where there are fewer). More than ``MOST_LANGS`` languages are refused."""
    rows = pick(docs, lang=lang, text=text).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    langs = sorted(r["lang"] for r in sizes)
    model = Model(langs, [np.zeros(0, np.uint64)] * (order + 1), [np.zeros((0, len(langs)), np.float32)] * (order + 1), [0.0] * (order + 1))
    if not langs:
        return model
    run, schema = _counting(order)
    chosen = sampled(rows, len(langs), {r["lang"]: r["n"] for r in sizes}, sample_bytes)
    table = chosen.mapInArrow(run, schema).groupBy("lang", "kind", "h").agg(F.sum("n").alias("n")).toArrow()
    place = {a: i for i, a in enumerate(langs)}
    who = np.array([place[a] for a in table["lang"].to_pylist()], np.int64)
    kind, h, n = table["kind"].to_numpy(), table["h"].to_numpy().view(np.uint64), table["n"].to_numpy().astype(np.float64)
    for k in range(order + 1):
        own = kind == k
        whole = np.maximum(np.bincount(who[own], n[own], len(langs)), 1.0)
        share = n[own] / whole[who[own]]
        model.floor[k] = float(np.log(share.min() / 2)) if len(share) else 0.0
        keys, inverse = np.unique(h[own], return_inverse=True)
        scores = np.full((len(keys), len(langs)), model.floor[k], np.float32)
        scores[inverse, who[own]] = np.log(share)
        model.hashes[k], model.scores[k] = keys, scores
    return model


def _found(table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return at, table[at] == h


def word_scores(model: Model, words: LetterWords) -> np.ndarray:
    """Scores by language of each distinct word: its own, else by n-grams, longest first."""
    h = words.hash[words.sample]
    out = np.full((len(h), len(model.langs)), min(model.floor), np.float32)
    at, known = _found(model.hashes[0], h)
    out[known] = model.scores[0][at[known]]
    left = np.flatnonzero(~known)
    for n in range(len(model.hashes) - 1, 0, -1):
        if not len(left):
            break
        grams, owner = words.grams(left, n)
        at, known = _found(model.hashes[n], grams)
        at, owner = at[known], owner[known]
        if not len(owner):
            continue
        some, first, times = np.unique(owner, return_index=True, return_counts=True)
        out[left[some]] = np.add.reduceat(model.scores[n][at], first, axis=0) / times[:, None]
        left = np.delete(left, some)
    return out


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns, ``lang_pred`` (one of the model's languages; ``und`` if the text
    is null or has no letter, or the model has no language) and ``score`` (0 to 1: share of the
    best language in the scores of as many words as are counted as evidence)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        m: Model = shared.value

        def make(column: pa.Array) -> list:
            words = LetterWords(column)
            n, some = len(words.counts), words.counts > 0
            best, share = np.full(n, -1), np.zeros(n)
            if some.any() and m.langs:
                by_word = word_scores(m, words)
                sums = np.empty((int(some.sum()), len(m.langs)))
                for j in range(len(m.langs)):
                    sums[:, j] = np.add.reduceat(by_word[words.word, j].astype(np.float64), words.first[:-1][some])
                counts = words.counts[some]
                sums *= (np.minimum(counts, EVIDENCE) / counts)[:, None]
                best[some] = sums.argmax(1)
                share[some] = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
            names = [*m.langs, UNKNOWN]
            return [[names[i] for i in best.tolist()], share]

        return make

    return map_text(docs, text, keep, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start)


def fold(doc_id: Column) -> Column:
    """True for the held-out third: crc32 of the id as text, modulo 3, is 1 (null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
