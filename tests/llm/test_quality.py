"""Counts against brute force, exact bounds, cutoffs; the weak-label classifier."""

import random
import re
from collections import Counter

import pytest

from textaudit.llm import quality, weaklabels
from textaudit.llm.frames import documents
from textaudit.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_counts_match_brute_force(table):
    r = random.Random(2)
    texts = [None, "", "\n\n", " \n ", "a\na\n a\na \na", "é é\u00a0é", "x" * 30_000, "a b c d e f g h " * 3, "#*$%&|<> <\r\n<\r\n"]
    texts += [" ".join(r.choice(["a", "b", "\n", "c#", "é"]) for _ in range(r.randint(0, 120))) for _ in range(150)]
    texts += texts[-5:]
    got = quality.counts(table(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert len(got) == len(texts)
    for row in got:
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == brute(texts[row["doc_id"]])


@pytest.mark.parametrize("k,n,delta", [(0, 100, 0.05), (3, 50, 0.01), (40, 1000, 1e-5), (7, 7, 0.1)])
def test_binomial_bound_is_exact(k, n, delta):
    from fractions import Fraction
    from math import comb

    upper = quality.binomial_upper(k, n, delta)
    below = lambda p: float(sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1)))
    assert upper == 1.0 if k == n else below(upper) == pytest.approx(delta, rel=1e-6)


def test_cutoffs_reject_the_tail_and_guard_the_stratum(table):
    rows = [(i, "en" if i % 2 else "de", " ".join(f"v{i}x{j}" + "#" * (i % 2000 == 1) for j in range(100))) for i in range(4000)]
    bad = [(10_000 + i, "en", " ".join(f"u{j}##" for j in range(100))) for i in range(20)]
    lone = [(20_000, "xx", bad[0][2]), (20_001, None, None)]
    docs = table(rows + bad + lone, "doc_id long, lang string, text string")
    got = {r["doc_id"]: r for r in quality.judge(docs, table([(i, 1) for i in range(4000)] + [(10_000, 0), (5, None)], "doc_id long, quality int")).collect()}
    assert len(got) == len(rows + bad + lone)
    assert not any(got[10_000 + i]["kept"] for i in range(20)) and "symbols" in got[10_000]["failed"]
    for lang in ("en", "de"):
        own = [got[i]["kept"] for i, s, _ in rows if s == lang]
        assert 1 - sum(own) / len(own) <= quality.RISK
    assert got[20_000]["kept"] and got[20_001]["base_failed"] and not got[20_001]["kept"]


def test_few_labels_reject_nothing_beyond_the_base_rules(spark):
    rows = QUERIES["op7_quality_rules"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r["kept"] == (not r["base_failed"]) for r in rows)


def test_empty_tables(table):
    docs, labels = table([], "doc_id long, lang string, text string"), table([], "doc_id long, quality int")
    assert quality.judge(docs, labels).collect() == []
    assert weaklabels.classify(docs, ["doc_id"]).collect() == []


def test_classifier_against_labels(spark):
    got = QUERIES["op5_quality_classifier"](spark, SF).join(documents(spark, SF, "labels"), "doc_id").collect()
    good, bad = [r for r in got if r["quality"] == 1], [r for r in got if r["quality"] == 0]
    assert sum(r["kept"] for r in good) >= 0.98 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.3 * len(bad)
    assert QUERIES["op5_quality_classifier"](spark, SF).count() == documents(spark, SF).count()


def test_classifier_edges(table):
    say = lambda i: f"The house {i} of the man was in the town, and it is by the sea.\nThis is number {i} of the list, which was long.\nThe end of it is in the other part {i}."
    rows = [(i, say(i)) for i in range(60)] + [(100, None), (101, ""), (102, "$$$ ### " * 40), (103, "\n".join(say(i) for i in range(3000))), (104, say(1)), (104, say(1))]
    got = {}
    for r in weaklabels.classify(table(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id"), ["doc_id"]).collect():
        assert 0 <= r["score"] <= 1
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got[104]) == 2 and got[104][0] == got[104][1] and got[102][0] < 0.5 < got[5][0]


def plain_em(votes, rounds=100):
    """Expectation-maximisation document by document: prior, accuracies, each one's posterior."""
    import math

    m, prior, right = len(weaklabels.LABELLERS), 0.8, []

    def good(v):
        yes, no = math.log(prior), math.log(1 - prior)
        for x, (hit, miss) in zip(v, right):
            if x != "2":
                yes += math.log(hit if x == "1" else 1 - hit)
                no += math.log(1 - miss if x == "1" else miss)
        return 1 / (1 + math.exp(min(700.0, no - yes)))

    for _ in range(rounds):
        p = [good(v) if right else weaklabels.FIRST ** v.count("0") * 0.95 for v in votes]
        prior = (sum(p) + 8) / (len(votes) + 10)
        right = []
        for j in range(m):
            own = [(q, v[j]) for q, v in zip(p, votes) if v[j] != "2"]
            hit = (sum(q for q, x in own if x == "1") + 8) / (sum(q for q, _ in own) + 10)
            miss = (sum(1 - q for q, x in own if x == "0") + 7) / (sum(1 - q for q, _ in own) + 10)
            right.append((hit, max(miss, 1 - hit)))
    return prior, right, [good(v) for v in votes]


def test_accuracies_equal_plain_em_and_scores_the_plain_sum(spark, table):
    import math

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from textaudit.llm.words import ALNUM, Words, mixed

    docs = documents(spark, "/root/testdata/sf0.001")
    rows = weaklabels.measured(docs, ["doc_id", "text"]).collect()
    prior, right, posterior = plain_em([r["votes"] for r in rows])
    model = weaklabels.accuracies(weaklabels.measured(docs, []))
    assert model.prior == pytest.approx(prior, rel=1e-9)
    assert [x for pair in model.right for x in pair] == pytest.approx([x for pair in right for x in pair], rel=1e-9)
    assert [model.posterior[r["votes"]] for r in rows] == pytest.approx(posterior, rel=1e-9)
    rng = np.random.default_rng(3)
    weights = rng.normal(size=weaklabels.BUCKETS + 10)
    got = {r["doc_id"]: r["score"] for r in weaklabels.score(docs, weights, ["doc_id"]).collect()}
    for r in rows[:60]:
        text, n = r["text"], max(r["n_words"], 1)
        bags = Counter()
        for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text)):
            bags[int(mixed(Words(pa.array([w]), ALNUM, lower=True).hashes())[0] % np.uint64(weaklabels.BUCKETS))] += 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in bags.values())) or 1
        dense = [min(r["n_symbols"] / n, 2), r["n_repeat_words"] / n, r["n_dup_lines"] / max(r["n_lines"], 1), math.log1p(r["n_words"]) / 5,
                 min(r["word_chars"] / n, 30) / 10, r["function"], r["finished"], r["letters"], r["capitals"]]
        z = sum(weights[b] * math.log1p(c) / norm for b, c in bags.items()) + sum(weights[weaklabels.BUCKETS + i] * x for i, x in enumerate(dense)) + weights[-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-6)


def test_texts_without_words_are_not_called_good(table):
    say = lambda i: f"The house {i} of the man was in the town, and it is by the sea.\nThis is number {i} of the list, which was long.\nThe end of it is in the other part {i}."
    rows = [(i, say(i)) for i in range(80)] + [(100, None), (101, ""), (102, " \n ")]
    got = {r["doc_id"]: r for r in weaklabels.classify(table(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    for i in (100, 101, 102):
        assert got[i]["votes"][0] == got[i]["votes"][1] == got[i]["votes"][7] == "2" and "1" not in got[i]["votes"]
        assert not got[i]["kept"] and got[i]["posterior"] < 0.5
    assert got[5]["kept"]


def test_sample_is_bounded_in_features_and_of_distinct_texts(table):
    docs = table([(i, "one two three four five six") for i in range(500)] + [(1000 + i, f"w{i} x{i} y{i}") for i in range(100)], "doc_id long, text string")
    assert weaklabels.sampled(docs, 600, 10_000).count() == 101
    rows = weaklabels.measured(weaklabels.sampled(docs, 600, 10_000), ["text", "place"])
    model = weaklabels.accuracies(weaklabels.measured(docs, []))
    few, none = (weaklabels.train(rows, "text", model, most=m) for m in (200, 0))
    assert few.any() and not none.any()
    clash = table([(1, "a b c", "x", 2)], "doc_id long, text string, VOTES string, Kept int")
    got = weaklabels.classify(clash, ["doc_id", "VOTES", "Kept"])
    assert got.columns == ["doc_id", "n_words", "votes", "posterior", "score", "kept"] and got.count() == 1
