"""Batches read a bounded part at a time, workers that are not needed, and values over all orders."""

import random
import tracemalloc
from itertools import permutations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textaudit.functions import text as TX
from textaudit.operators import attribution as AT
from textaudit.operators import features as FE
from textaudit.operators import pieces as PC
from textaudit.operators import shapley as SH
from textaudit.operators.models import RuleModel
from textaudit.plans import scorers as SC
from textaudit.plans import text as PT


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def held(batches) -> float:
    """MB that Python holds at most while ``batches`` are read."""
    tracemalloc.start()
    for _ in batches:
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


def test_lists_are_given_a_bounded_part_at_a_time(spark):
    def told(lists):
        import pyarrow as pa
        return pa.array([[len(lists.flatten())] if x.is_valid else None for x in lists], pa.list_(pa.int64()))

    rows = [(k, None if k == 3 else ["w"] * n) for k, n in enumerate([30_000, 30_000, 0, 0, 200_000, 30_000, 1])]
    df = spark.createDataFrame(rows, "k LONG, t ARRAY<STRING>").coalesce(1)
    got = {r["k"]: r["n"] for r in TX.sliced_rows(df, ["k"], [F.col("t")], lambda x: told(x), "n", "array<bigint>").collect()}
    assert got.keys() == set(range(7)) and got[3] is None
    assert got[0] == [60_000] and got[4] == [200_000] and got[6][0] < 65_536 + 30_000
    empty = pa.RecordBatch.from_arrays([pa.array([], pa.list_(pa.string()))], names=["t"])
    assert [x.num_rows for x in TX.item_slices(iter([empty]), 0)] == []


def test_pieces_and_their_merge_send_small_batches(spark, tmp_path):
    texts = ["Unbelievable ünïcode 中文 don't " * 3000, None, "", "!!", "a_1 İstanbul"] * 2
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id LONG, text STRING").coalesce(1)
    path = P.path("word_bpe_49k.json")
    cut = PC.segmented(docs, lambda: PC.byte_level_vocabulary(path))
    trie = PC.Trie(*PC.byte_level_vocabulary(path))
    words = {r["doc_id"]: r["w"] for r in docs.select("doc_id", TX.word_tokens("text").alias("w")).collect()}
    assert {r["doc_id"]: r["pieces"] for r in cut.collect()} == {k: [p for w in ws for p in trie.pieces(w)] for k, ws in words.items()}
    merged = AT.merge_subwords_arrays(cut.withColumn("scores", F.transform(PC.word_sizes(F.col("pieces")), lambda n: n / 100.0)), keep=["doc_id"])
    assert merged.columns == ["doc_id", "words"] and "ArrowEvalPython" not in plan_of(merged)  # whole batches are its results
    assert {r["doc_id"]: [(w["word"], w["score"]) for w in r["words"]] for r in merged.collect()} == {
        k: [(w, round(len(w) / 100, 6)) for w in ws] for k, ws in words.items()}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for query in (PT.piece_merge, PT.subword_merge):
        assert "ArrowEvalPython" not in plan_of(query(spark, str(tmp_path)))


def test_word_sizes_need_no_worker(spark):
    rows = [(1, ["##ab", None, "c", "##de", "##", "f"]), (2, []), (3, None), (4, ["##", "##x"]), (5, [None]), (6, ["é中", "##文"])]
    sizes = spark.createDataFrame(rows, "k LONG, p ARRAY<STRING>").select("k", PC.word_sizes(F.col("p")).alias("n"))
    assert "Python" not in plan_of(sizes)
    assert {r["k"]: r["n"] for r in sizes.collect()} == {1: [2, 0, 3, 3, 3, 1], 2: [], 3: None, 4: [1, 1], 5: [0], 6: [3, 3]}


def test_gathered_pieces_are_merged_a_bounded_part_at_a_time():
    kind = pa.struct([("pos", pa.int32()), ("piece", pa.string()), ("score", pa.float64())])
    own = pa.array([{"pos": i, "piece": "##b" if i % 2 else "a", "score": 0.5} for i in range(20_000)], kind)
    rows = pa.ListArray.from_arrays(pa.array(np.arange(41, dtype=np.int32) * 20_000), pa.concat_arrays([own] * 40))
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), rows], names=["doc_id", "rows"])
    run = AT._merged_rows("doc_id")
    assert held(run(iter([batch]))) < 25  # 7; a batch at once took 61
    got = pa.Table.from_batches(run(iter([batch])))
    assert got.num_rows == 400_000 and got["raw"].unique().to_pylist() == ["ab"] and got["word_pos"].to_pylist()[:10_000] == list(range(1, 10_001))


def test_terms_of_a_vocabulary_are_counted_where_they_are_added_up(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("aa bb cc dd ee the".split()) for _ in range(r.randint(0, 40))) for _ in range(30)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)
    by_tokens = FE.tfidf_vocabulary(FE.term_tokens(docs, stop_words=["the"]), docs.count(), max_terms=20)
    by_counts = FE.tfidf_vocabulary(FE.counted_terms(docs, stop_words=["the"]), docs.count(), max_terms=20)
    assert by_tokens.collect() == by_counts.collect() != []
    vocabulary = FE.tfidf_terms(docs, stop_words=["the"])[0]
    assert plan_of(vocabulary).count("MapInArrow") == 1 and "ArrowEvalPython" not in plan_of(vocabulary)


def test_weights_count_a_bounded_part_at_a_time(spark):
    docs = spark.createDataFrame([(1, "xx yy xx"), (2, "yy zz"), (2, "xx yy"), (None, "zz yy"), (3, None)], "doc_id LONG, text STRING")
    counted = FE.counted_terms(docs)
    assert "ArrowEvalPython" not in plan_of(counted)
    got = sorted((r["doc_id"] or 0, [tuple(c) for c in r["counts"]]) for r in counted.collect())
    assert got == [(0, [("yy", 1), ("zz", 1), ("zz yy", 1)]), (1, [("xx", 2), ("xx yy", 1), ("yy", 1), ("yy xx", 1)]),
                   (2, [("xx", 1), ("xx yy", 1), ("yy", 1)]), (2, [("yy", 1), ("yy zz", 1), ("zz", 1)]), (3, [])]
    weights = FE.tfidf_terms(docs)[1].collect()
    assert sum(r["weight"] ** 2 for r in weights if r["doc_id"] == 1) == pytest.approx(1, abs=1e-5)


RULE = RuleModel("r", ("the", "he"), -1.0, 6.0)
ODD = "The İstanbul of ΑΣ.Β and the ŉ x_1 he, to the Éa"


def test_values_of_sums_are_those_over_all_subsets_and_orders():
    score = SC.RuleScorer(RULE)
    for text in (ODD, "the the of x y", "the", "x y, x", "he the HE b c c c"):
        p = SH.Players(text)
        value, _ = SH.summed_values(p, score)
        assert np.allclose(value, SH.exact_values(p, score, 512)[0], rtol=0, atol=1e-12)
    p = SH.Players("the a he a b")
    total = np.zeros(4)
    for order in permutations(range(4)):
        total[list(order)] += np.diff(SH.scored(p.growing(order), score, 32))
    assert np.allclose(SH.summed_values(p, score)[0], total / 24, atol=1e-12)
    long = SH.Players(" ".join(f"w{i % 150}" for i in range(400)) + " the he" * 20)
    value, _ = SH.summed_values(long, score)
    ends = score([long.variant([True] * 152), long.variant([False] * 152)])
    assert value.sum() == pytest.approx(ends[0] - ends[1], abs=1e-10)
    assert SH.summed_values(SH.Players("İthe a b"), score) is None  # one word with sums of both kinds: drawn


def test_three_sums_and_large_tables(monkeypatch):
    class Three(SH.SumScorer):
        def features(self, texts):
            return np.array([[t.count(c) for t in texts] for c in "abc"], float)

        def value(self, sums):
            return np.sin(sums[0] + 0.1) * (1 + sums[1]) ** 0.5 + 0.3 * sums[2] * sums[0]

    p = SH.Players("a aa b b bbb c cc zz a c")
    want = SH.exact_values(p, Three(), 64)[0]
    assert np.allclose(SH.summed_values(p, Three())[0], want, atol=1e-12)
    monkeypatch.setattr(SH, "LARGEST_TABLE", 10)
    assert SH.summed_values(p, Three()) is None


def test_orders_are_drawn_until_the_error_is_small(spark):
    text = " ".join("abcdefghij")

    def load():
        return lambda texts: [float("a" in t and "b" in t) + 0.5 * ("c" in t) for t in texts]

    df = spark.createDataFrame([(1, text)], "doc_id LONG, text STRING")
    rows = SH.shapley_attribution(df, load, k=99, tolerance=0.02).collect()
    assert len(rows) == 10 and all(r["error"] <= 0.02 for r in rows) and rows[0]["evaluations"] > 2 * 16 * 11
    few = SH.shapley_attribution(df, load, k=99, tolerance=0.02, most_pairs=4).collect()
    assert few[0]["evaluations"] == 2 * 4 * 11
    with pytest.raises(ValueError):
        SH.shapley_attribution(df, load, tolerance=0)
    broken = SH.shapley_attribution(df, lambda: (lambda texts: [float("nan")] * len(texts)), tolerance=0.02).collect()
    assert broken[0]["evaluations"] == 2 * 11


def test_the_rule_scorer_query_gives_the_whole_values(spark, tmp_path):
    text = "the cat and the dog, of a house in that old town to which he was"
    spark.createDataFrame([(7, 0, "user", text), (7, 1, "user", None), (8, 0, "user", "!")], "conv_id LONG, turn INT, role STRING, text STRING").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["word"]: (r["id"], r["score"]) for r in SC.shapley_rule_scorer(spark, str(tmp_path)).collect()}
    p = SH.Players(text)
    value = dict(zip(p.words, SH.exact_values(p, SC.RuleScorer(SC.U.MODELS[0]), 1 << 16)[0]))
    assert len(got) == 10 and all(i == "7:0" and s == pytest.approx(value[w], abs=1.1e-6) for w, (i, s) in got.items())
