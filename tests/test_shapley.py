"""Shapley sampling and batch scoring."""

from itertools import permutations

import numpy as np
import pytest

from textaudit.operators import attribution as AT
from textaudit.operators import models as MD
from textaudit.operators import shapley as SH

TEXTS = ["the cat saw the dog, the end", "a b c d e f g h", "one", "", None, "!!! ...", "Éa éa x", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 the"]


def _made():
    def load():
        """Not additive: words count by their pairs."""
        def score(texts):
            out = []
            for t in texts:
                ws = SH.Players(t).words
                out.append(0.01 * len(ws) ** 2 + 0.3 * ("the" in ws and "cat" in ws) + 0.2 * ("a" in ws) * ("h" in ws))
            return out
        return score
    return load


product_scorer = _made()  # a closure, which is sent to workers by value


def by_all_orders(text, score):
    p = SH.Players(text)
    m, total, n = len(p.words), np.zeros(len(p.words)), 0
    for order in permutations(range(m)):
        kept, before = np.zeros(m, bool), score([p.variant(np.zeros(m, bool))])[0]
        for i in order:
            kept[i] = True
            now = score([p.variant(kept)])[0]
            total[i] += now - before
            before = now
        n += 1
    return dict(zip(p.words, total / n))


def run(spark, texts, load, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["word"]): r for r in SH.shapley_attribution(df, load, k=99, **how).collect()}


def test_exact_up_to_eight_words(spark):
    got = run(spark, TEXTS[:7], product_scorer)
    assert {d for d, _ in got} == {0, 1, 2, 6}
    for i in (0, 2, 6):
        want = by_all_orders(TEXTS[i], product_scorer())
        assert {w: got[i, w]["score"] for w in want} == pytest.approx(want, abs=1e-5) and all(got[i, w]["error"] == 0 for w in want)
    # eight words: values add up to the whole
    assert sum(got[1, w]["score"] for w in "abcdefgh") == pytest.approx(0.64 + 0.2, abs=1e-5)


def test_sampling_comes_near_the_exact_values(spark):
    text = TEXTS[1]
    exact = run(spark, [text], product_scorer)
    near = run(spark, [text], product_scorer, exact=0, most_pairs=200, tolerance=1e-2)
    for k, r in near.items():
        assert abs(r["score"] - exact[k]["score"]) <= 5 * r["error"] + 1e-6 and r["error"] <= 1e-2
    again = run(spark, [text], product_scorer, exact=0, most_pairs=200, tolerance=1e-2)
    assert [tuple(r) for r in near.values()] == [tuple(r) for r in again.values()]


def test_additive_scores_need_one_pair_and_equal_occlusion(spark):
    weights = {"the": 0.5, "w1": -0.25, "dog": 1.0}

    def load():
        return lambda texts: [sum(weights.get(t.lower(), 0.0) for t in SH._tokens()[1].findall(x)) for x in texts]

    got = run(spark, TEXTS, load, exact=0)
    p = SH.Players(TEXTS[7])
    assert got[7, "the"]["score"] == 0.5 and got[7, "w1"]["score"] == -0.25 and got[7, "w2"]["score"] == 0
    assert got[7, "the"]["evaluations"] == 2 * (len(p.words) + 1) and got[0, "the"]["score"] == 1.5


def test_one_word_rule_scorer_equals_occlusion(spark):
    rule = MD.RuleModel("r", ("the",), -1.0, 3.0)

    def load():
        import math
        return lambda texts: [1 / (1 + math.exp(-(-1.0 + 3.0 * sum(w.lower() == "the" for w in ws) / max(len(ws), 1)))) for ws in (SH._tokens()[1].findall(t) for t in texts)]

    df = spark.createDataFrame([(1, "the the"), (2, "other")], "doc_id long, text string")
    want = {(r["doc_id"], r["word"]): r["delta"] for r in AT.occlusion_attribution(df, rule).collect()}
    got = {(r["doc_id"], r["word"]): r["score"] for r in SH.shapley_attribution(df, load).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_ties_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(300)) + " " + "z " * 20_000
    got = SH.shapley_attribution(spark.createDataFrame([(1, long)], "doc_id long, text string"), lambda: (lambda ts: [0.0 for _ in ts]), k=3).collect()
    assert [(r["rank"], r["word"], r["score"]) for r in got] == [(1, "w0", 0.0), (2, "w1", 0.0), (3, "w10", 0.0)]


def test_batch_scorer_loads_once_and_keeps_to_the_batch_size(spark):
    def load():
        return lambda texts: [len(texts) + 0.5 * (t == "") for t in texts]

    df = spark.createDataFrame([(i, None if i == 3 else f"t{i}") for i in range(10)], "doc_id long, text string").repartition(1)
    got = {r["doc_id"]: r["proba"] for r in MD.batch_scorer(df, load, batch_size=4).collect()}
    assert got[3] in (4.5, 2.5) and sorted(set(got.values()) - {got[3]}) in ([2.0, 4.0], [4.0]) and len(got) == 10


def test_loaded_weights_equal_the_pipeline(spark):
    rows = [(i, ("good fine nice day " if i % 2 else "bad awful poor day ") * (1 + i % 3), i % 2) for i in range(40)] + [(99, None, 0), (98, "unknown", 1)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, label INT")
    model = MD.train_logreg(df, stop_words=("day",))
    want = {r["doc_id"]: r["proba"] for r in MD.apply_classifier(model, df).collect()}
    plain = MD.linear_text(model, ("day",))
    got = {r["doc_id"]: r["proba"] for r in MD.batch_scorer(df, lambda: plain).collect()}
    assert got == pytest.approx(want, abs=1e-9)
