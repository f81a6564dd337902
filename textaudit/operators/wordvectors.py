"""Word vectors from a corpus: windowed co-occurrence, positive PMI, randomised SVD.

Pairs of words at most ``window`` apart are counted inside the tasks and added up by pair. The
matrix of positive pointwise mutual information is a table of its entries by row. Its leading
eigenvectors come from products of that table with thin matrices (vocabulary by ``dim``, which the
driver holds and sends): random directions, some power steps with orthonormalisation, and a small
eigenproblem at the end. The vocabulary's size is a parameter, so what is sent is bounded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import saved_table

DIM, WINDOW, MOST_WORDS, MIN_COUNT, EXTRA, POWER, SEED = 50, 4, 10_000, 5, 10, 3, 17
#: Distinct pairs that a task collects before it sends them on, and words that it reads at a time.
HELD, READ = 1 << 20, 1 << 17


def vocabulary(docs: DataFrame, text: str = "text", most: int = MOST_WORDS, least: int = MIN_COUNT, tokens=TX.word_tokens) -> list[str]:
    """The ``most`` most frequent words that occur ``least`` times or more (ties by word)."""
    counted = TX.with_counts(docs.select(text), tokens(text))
    each = counted.select(TX.explode_rows(F.col("counts")).alias("t")).where(F.col("t").isNotNull())
    total = each.groupBy(F.col("t.word").alias("word")).agg(F.sum("t.c").alias("n")).where(F.col("n") >= least)
    return [r["word"] for r in total.orderBy(F.col("n").desc(), "word").limit(most).collect()]


def cooccurrence(docs: DataFrame, words: list[str], text: str = "text", window: int = WINDOW, tokens=TX.word_tokens) -> DataFrame:
    """``(i, j, n)``: how often the words ``i`` and ``j`` (places in ``words``) stand at most
    ``window`` words apart, in both directions; other words keep their place in the text."""
    place = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc
        known = place.value
        wide = len(known)

        def told(keys, counts):
            return pa.RecordBatch.from_arrays([pa.array(keys // wide), pa.array(keys % wide), pa.array(counts)], names=["i", "j", "n"])

        listed = pa.array(known, pa.string())
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(0)
            ends = np.cumsum(pc.list_value_length(texts).to_numpy())
            words, row = texts.flatten(), np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
            for a in range(0, len(words), READ):
                # a part, and the words in front of it that its first words see
                before = min(a, window)
                ids = pc.fill_null(pc.index_in(words[a - before:a + READ], value_set=listed), -1).to_numpy().astype(np.int64)
                text, found = row[a - before:a + READ], [keys]
                for d in range(1, min(window, len(ids) - 1) + 1):
                    own = slice(max(before - d, 0), len(ids) - d)
                    x, y = ids[own], ids[own.start + d:]
                    both = (x >= 0) & (y >= 0) & (text[own] == text[own.start + d:])
                    found += [x[both] * wide + y[both], y[both] * wide + x[both]]
                whole = np.concatenate(found)
                keys, inverse = np.unique(whole, return_inverse=True)
                counts = np.bincount(inverse, np.r_[counts, np.ones(len(whole) - len(counts))], len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield told(keys, counts)
                    keys, counts = keys[:0], counts[:0]
        if len(keys):
            yield told(keys, counts)

    pairs = docs.select(tokens(text).alias("t")).mapInArrow(run, "i long, j long, n long")
    return pairs.groupBy("i", "j").agg(F.sum("n").alias("n"))


def positive_pmi(pairs: DataFrame) -> DataFrame:
    """``(i, j, v)``: ``ln(n_ij * n / (n_i * n_j))`` where positive."""
    pairs = saved_table(pairs, "pairs")
    total = pairs.agg(F.sum("n")).first()[0] or 0
    sums = pairs.groupBy("i").agg(F.sum("n").alias("ni"))
    other = sums.select(F.col("i").alias("j"), F.col("ni").alias("nj"))
    v = F.log(F.col("n") * F.lit(float(total)) / (F.col("ni").cast("double") * F.col("nj")))
    return pairs.join(sums, "i").join(other, "j").select("i", "j", v.alias("v")).where("v > 0")


def _times(entries: DataFrame, x: np.ndarray) -> np.ndarray:
    """The matrix of ``entries(i, j, v)`` times ``x``: row sums inside the tasks, then by row."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    sent = entries.sparkSession.sparkContext.broadcast(x)

    def run(batches) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            i, j, v = (batch.column(c).to_numpy() for c in range(3))
            rows, inverse = np.unique(i, return_inverse=True)
            sums = np.zeros((len(rows), sent.value.shape[1]))
            step = 1 << 14
            for a in range(0, len(i), step):
                np.add.at(sums, inverse[a:a + step], v[a:a + step, None] * sent.value[j[a:a + step]])
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(list(sums), pa.list_(pa.float64()))], names=["i", "y"])

    parts = entries.select("i", "j", "v").mapInArrow(run, "i long, y array<double>")
    got = parts.groupBy("i").agg(vector_to_array(Summarizer.sum(array_to_vector("y"))).alias("y")).toArrow().combine_chunks()
    out = np.zeros_like(x)
    if got.num_rows:
        out[got["i"].to_numpy()] = got["y"].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    sent.unpersist()
    return out


def leading(entries: DataFrame, n: int, dim: int, extra: int = EXTRA, power: int = POWER, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The ``dim`` eigenvalues of largest size, and their eigenvectors (columns; the entry of largest
    size positive), of the symmetric ``n`` by ``n`` matrix of ``entries``."""
    wide = min(n, dim + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, wide)))[0]
    for _ in range(power):
        q = np.linalg.qr(_times(entries, q))[0]
    small = q.T @ _times(entries, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:dim]
    u = q @ vectors[:, order]
    return values[order], u * np.sign(u[np.argmax(np.abs(u), axis=0), np.arange(u.shape[1])])


def word_vectors(docs: DataFrame, text: str = "text", dim: int = DIM, window: int = WINDOW, most: int = MOST_WORDS, least: int = MIN_COUNT,
                 tokens=TX.word_tokens, **how) -> DataFrame:
    """``(word, vec ARRAY<FLOAT>)`` of the vocabulary: eigenvectors times the root of the size of
    their eigenvalues. Fewer words than ``dim`` give shorter vectors; no words, no rows."""
    spark = docs.sparkSession
    words = vocabulary(docs, text, most, least, tokens)
    schema = "word string, vec array<float>"
    if not words:
        return spark.createDataFrame([], schema)
    entries = saved_table(positive_pmi(cooccurrence(docs, words, text, window, tokens)).repartition("i").sortWithinPartitions("i"), "pmi")
    values, u = leading(entries, len(words), dim, **how)
    vectors = u * np.sqrt(np.abs(values))
    return spark.createDataFrame([(w, [float(x) for x in v]) for w, v in zip(words, vectors)], schema)
