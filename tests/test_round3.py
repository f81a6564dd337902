"""Counting, merging, pooling and variants that grow with the input, against plain Python."""

import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from textaudit.functions import text as TX
from textaudit.operators import attribution as AT
from textaudit.operators import features as FE
from textaudit.operators import pieces as PC
from textaudit.operators import shapley as SH
from textaudit.operators import wordvectors as WV
from textaudit.plans import scorers as SC


def test_words_and_pairs_are_counted_in_the_row(spark):
    rows = [(1, ["b", "a", None, "b", "é"]), (2, None), (3, []), (4, ["a"])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    got = {r["k"]: r["counts"] and [tuple(c) for c in r["counts"]] for r in TX.with_counts(df, F.col("t")).collect()}
    assert got == {1: [("a", 1), ("b", 2), ("é", 1)], 2: None, 3: [], 4: [("a", 1)]}
    docs = spark.createDataFrame([(1, "The cat sat. the cat, de cat"), (2, None), (3, "x")], "doc_id long, text string")
    got = {r["doc_id"]: {c["word"]: c["c"] for c in r["counts"]} for r in FE.counted_terms(docs, stop_words=["de"]).collect()}
    ws = "the cat sat the cat cat".split()
    assert got == {1: dict(Counter(ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])), 2: {}, 3: {}}


def test_a_vector_is_sent_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(FE, "BLOCK_DOCS", 2)
    docs = spark.createDataFrame([(1, "a b b"), (1, "c"), (2, "zz"), (None, "a"), (3, None), (4, "c a"), (5, "a"), (6, "d")], "doc_id long, text string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 3.0]), ("c", [2.0, 2.0]), ("d", [1.0, 1.0]), ("d", [3.0, 5.0]), (None, [9.0, 9.0])], "w string, v array<float>")
    got = sorted(((r["doc_id"] or 0, r["vec"]) for r in FE.mean_pool_vectors(docs, vectors, vec_key="w", vec_col="v").collect()))
    assert got == [(0, [0, 0]), (1, [0.75, 2]), (1, [0.75, 2]), (2, [0, 0]), (3, [0, 0]), (4, [1.5, 1]), (5, [1, 0]), (6, [2, 3])]


def test_pairs_of_words_across_parts_of_a_batch(spark, monkeypatch):
    texts = ["a b c a x b " * 3, "c a", "", None, "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = Counter()
    for t in texts:
        ws = (t or "").split()
        for i, w in enumerate(ws):
            for j in range(max(0, i - 2), min(len(ws), i + 3)):
                if i != j and "x" not in (w, ws[j]):
                    want["abc".index(w), "abc".index(ws[j])] += 1
    for read in (1, 3, 1 << 17):
        monkeypatch.setattr(WV, "READ", read)
        assert {(r["i"], r["j"]): r["n"] for r in WV.cooccurrence(docs, ["a", "b", "c"], window=2).collect()} == want


def test_merging_a_long_text_is_linear(spark):
    n = 60_000
    long = spark.createDataFrame([(1, ["un", "##do", "x"] * n)], "doc_id long, pieces array<string>")
    begun = time.time()
    w = AT.merge_subwords_arrays(long.withColumn("scores", F.transform(PC.word_sizes(F.col("pieces")), lambda s: s / 100.0))).select(
        F.size("words").alias("n"), F.element_at("words", -2).alias("w")).first()
    assert w["n"] == 2 * n and tuple(w["w"]) == (2 * n - 2, "undo", 0.04)
    assert time.time() - begun < 60  # word by word over the whole array took minutes
    rows = [(1, ["##a", None, "b", "##", "##c"], [0.1, 0.2, None, 0.5, 0.5]), (2, None, None), (3, [], []), (4, ["x", "##y"], [0.5]), (5, ["##"], [1.0]), (6, ["x"], None)]
    df = spark.createDataFrame(rows, "k long, pieces array<string>, scores array<double>")
    got = {r["k"]: r["words"] and [tuple(x) for x in r["words"]] for r in AT.merge_subwords_arrays(df).collect()}
    assert got == {1: [(0, "a", 0.1), (2, "bc", None)], 2: None, 3: [], 4: [(0, "xy", 0.25)], 5: [], 6: [(0, "x", None)]}


def test_growing_variants_and_words():
    p = SH.Players("Éa, the cat the _x1 cat!")
    kept, want = np.zeros(len(p.words), bool), []
    order = [2, 0, 3, 1]
    want.append(p.variant(kept))
    for i in order:
        kept[i] = True
        want.append(p.variant(kept))
    assert list(p.growing(order)) == want and want[-1] == "Éa, the cat the _x1 cat!"
    import regex
    every = "".join(map(chr, range(128))) + " a_b,C9\x00d-e"
    for t in (every, "İstanbul é ٣x ½ 中文", ""):
        assert SC._words_of()(t) == regex.findall(TX.WORD_RE, t.lower())
