"""Subword pieces and word vectors."""

import random
from collections import Counter

import numpy as np
import public_tokenizers as P

from locations import SF_SMALL
from textaudit.operators import attribution as AT
from textaudit.operators import features as FE
from textaudit.operators import pieces as PC
from textaudit.operators import wordvectors as WV
from textaudit.functions import text as TX
from textaudit.sources.tables import read_table
from pyspark.sql import functions as F


def longest(word, first, inner):
    """Longest match by trying every end."""
    out, at = [], 0
    while at < len(word):
        known = inner if at else first
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), at + 1)
        out.append(("##" if at else "") + word[at:end])
        at = end
    return out


def test_trie_equals_trying_every_end():
    r = random.Random(1)
    for _ in range(200):
        first, inner = ({"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(8)} for _ in range(2))
        trie = PC.Trie(first, inner)
        for _ in range(20):
            word = "".join(r.choice("abcdé") for _ in range(r.randint(0, 9)))
            assert trie.pieces(word) == longest(word, first, inner) == trie.pieces(word)


def test_pieces_of_a_public_vocabulary_merge_to_the_words(spark):
    path = P.path("word_bpe_49k.json")
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "中文 unbelievableness Éa_1 " + "x" * 5000)], "doc_id long, text string"))
    cut = PC.segmented(docs, lambda: PC.byte_level_vocabulary(path))
    merged = AT.merge_subwords_arrays(cut.withColumn("scores", F.transform("pieces", lambda p: F.lit(0.5))))
    got = {r["doc_id"]: [w["word"] for w in r["words"]] for r in merged.collect()}
    want = {r["doc_id"]: r["t"] for r in docs.select("doc_id", TX.word_tokens("text").alias("t")).collect()}
    assert got == want
    pieces = {r["doc_id"]: r["pieces"] for r in cut.collect()}
    assert any(p.startswith("##") for p in pieces[-3]) and pieces[-1] == [] and len(pieces[1]) > len(want[1]) * 0.9
    short = cut.select("doc_id", F.size(TX.truncate_tokens(F.col("pieces"), 16)).alias("n"))
    assert short.agg(F.max("n")).first()[0] == 16


TEXTS = ["the cat sat on the mat", "the dog sat on the cat mat", None, "", "a cat and a dog", "mat the the the dog sat"] * 4


def dense_pmi(texts, words, window):
    place = {w: i for i, w in enumerate(words)}
    n = np.zeros((len(words), len(words)))
    for t in texts:
        ws = (t or "").split()
        for a in range(len(ws)):
            for b in range(max(0, a - window), min(len(ws), a + window + 1)):
                if a != b and ws[a] in place and ws[b] in place:
                    n[place[ws[a]], place[ws[b]]] += 1
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.log(n * n.sum() / (n.sum(1)[:, None] * n.sum(0)[None]))
    return n, np.where(np.isfinite(v) & (v > 0), v, 0)


def test_counts_pmi_and_eigenvectors_equal_dense_ones(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    words = WV.vocabulary(docs, least=5)
    tally = Counter(w for t in TEXTS for w in (t or "").split())
    assert words == sorted((w for w, c in tally.items() if c >= 5), key=lambda w: (-tally[w], w))
    n, v = dense_pmi(TEXTS, words, 2)
    pairs = WV.cooccurrence(docs, words, window=2)
    assert {(r["i"], r["j"]): r["n"] for r in pairs.collect()} == {(i, j): int(n[i, j]) for i, j in zip(*np.nonzero(n))}
    entries = WV.positive_pmi(pairs)
    got = np.zeros_like(v)
    for r in entries.collect():
        got[r["i"], r["j"]] = r["v"]
    assert np.allclose(got, v)
    values, u = WV.leading(entries, len(words), 3, power=12)
    want = np.linalg.eigvalsh(v)
    assert np.allclose(np.abs(values), sorted(np.abs(want), reverse=True)[:3], atol=1e-6)
    assert np.allclose(v @ u, u * values, atol=1e-5)


def test_vectors_pool_by_word(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS[:6])) + [(9, "unknown words")], "doc_id long, text string")
    table = WV.word_vectors(docs, dim=2, window=2, least=2)
    vec = {r["word"]: np.array(r["vec"]) for r in table.collect()}
    got = {r["doc_id"]: r["vec"] for r in FE.mean_pool_vectors(docs, table, vec_key="word", vec_col="vec").collect()}
    for i, t in [*enumerate(TEXTS[:6]), (9, "unknown words")]:
        own = [vec[w] for w in (t or "").split() if w in vec]
        assert np.allclose(got[i], np.mean(own, axis=0) if own else [0, 0], atol=1e-6)
    assert WV.word_vectors(docs.where("doc_id < 0")).count() == 0
