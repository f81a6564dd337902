"""Word-first backoff: held-out accuracy, counts and edge cases."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textaudit.llm import language
from textaudit.llm.frames import documents
from textaudit.llm.queries import QUERIES

MID = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = QUERIES["op8_language"](spark, MID).join(documents(spark, MID).select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, least = got.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score")).first()
    assert n > 200 and right >= 0.98 and 0 <= least


def test_fold_is_the_crc(spark):
    import zlib

    got = QUERIES["op8_language"](spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


ROWS = [("aa", "Der Hund, der HUND 12 lief"), ("aa", "der wald"), ("bb", "the dog the cat"), ("bb", "The DOG é"), (None, "xx"), ("bb", None)]


def test_model_holds_exact_log_frequencies(table):
    model = language.learn(table(ROWS, "lang string, text string"))
    assert model.langs == ["aa", "bb"] and [len(h) for h in model.hashes][:2] == [8, len(set("derhunlifwa") | set("thedogcaé"))]
    words = {"aa": Counter("der hund der hund lief der wald".split()), "bb": Counter("the dog the cat the dog é".split())}
    import numpy as np

    top = sorted(np.exp(model.scores[0].max(1)).tolist())
    assert top == pytest.approx(sorted(n / sum(c.values()) for c in words.values() for n in c.values()), rel=1e-5)


def test_backoff_and_edges(table):
    model = language.learn(table(ROWS * 3, "lang string, text string"))
    texts = ["der", "hunde", "dogs cats", None, "", "12 !?", "жук", "der " * 30_000, "x" * 50_000, "THE"]
    got = language.predict(table(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).collect()
    told = {texts[r["doc_id"]]: r["lang_pred"] for r in got}
    assert told["der"] == told["hunde"] == told["der " * 30_000] == "aa" and told["dogs cats"] == told["THE"] == "bb"
    assert told[None] == told[""] == told["12 !?"] == "und" and told["жук"] in model.langs
    assert all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in got)
    none = language.learn(table([], "lang string, text string"))
    assert [tuple(r) for r in language.predict(table([(1, "der")], "doc_id long, text string"), none, ["doc_id"]).collect()] == [(1, "und", 0.0)]


def plain(train, texts, order=4):
    """Word-first backoff by dictionaries: the best language (ties: the first) and its share."""
    def words(text):
        out = [""]
        for c in text or "":
            out = out[:-1] + [out[-1] + c.lower()[0]] if c.isalpha() else out + [""]
        return [w for w in out if w]

    def grams(w, n):
        w = f" {w} " if n > 1 else w
        return [w[i:i + n] for i in range(len(w) - n + 1)]

    langs = sorted({a for a, _ in train})
    counts = [{a: Counter() for a in langs} for _ in range(order + 1)]
    for a, text in set(train):
        for w in words(text):
            counts[0][a][w] += 1
            for n in range(1, order + 1):
                counts[n][a].update(grams(w, n))
    share = [{a: {x: m / sum(c.values()) for x, m in c.items()} for a, c in kind.items()} for kind in counts]
    floor = [math.log(min(x for c in kind.values() for x in c.values()) / 2) for kind in share]

    def score(w, kind, a):
        got = share[kind][a].get(w)
        return math.log(got) if got else floor[kind]

    def known(x, kind):
        return any(x in share[kind][a] for a in langs)

    def word(w, a):
        if known(w, 0):
            return score(w, 0, a)
        for n in range(order, 0, -1):
            found = [g for g in grams(w, n) if known(g, n)]
            if found:
                return sum(score(g, n, a) for g in found) / len(found)
        return min(floor)

    out = []
    for text in texts:
        ws = words(text)
        if not ws:
            out.append(("und", 0.0))
            continue
        sums = [sum(word(w, a) for w in ws) * min(len(ws), language.EVIDENCE) / len(ws) for a in langs]
        best = max(range(len(langs)), key=lambda i: (sums[i], -i))
        out.append((langs[best], 1 / sum(math.exp(s - sums[best]) for s in sums)))
    return out


def test_equals_plain_dictionaries(spark, table):
    rows = [(r["lang"], r["text"]) for r in documents(spark, "/root/testdata/sf0.001").where("length(text) < 2000").limit(120).collect()]
    train, texts = rows[:70], [t for _, t in rows[70:]] + ["xqzzt vrkk", "жук", "der жук", "", None, "12", "a", "é " * 40]
    model = language.learn(table(train, "lang string, text string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(table(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).collect()}
    for i, (lang, score) in enumerate(plain(train, texts)):
        assert got[i][1] == pytest.approx(score, rel=1e-4), (texts[i], got[i], lang)
        assert got[i][0] == lang or score < 0.5 + 1e-4


def test_tied_languages_give_the_first(table):
    model = language.learn(table([("bb", "one two"), ("aa", "one two"), ("cc", "one two")], "lang string, text string"))
    got = language.predict(table([(1, "one"), (2, "one two"), (3, "zzz")], "doc_id long, text string"), model, ["doc_id"]).collect()
    assert [(r["lang_pred"], round(r["score"], 6)) for r in got] == [("aa", round(1 / 3, 6))] * 3


def test_sample_is_bounded_and_of_distinct_texts(spark, table):
    spell = lambda i: "".join(chr(97 + int(c)) for c in str(i))
    texts = [("aa", f"{spell(i)} text of some length") for i in range(3000)] + [("aa", "the same copy")] * 3000 + [("bb", "lone text")]
    rows = table(texts, "lang string, text string")
    got = language.sampled(rows, 2, {"aa": sum(len(t) for a, t in texts if a == "aa"), "bb": 9}, 20_000).collect()
    size = sum(len(r["text"]) for r in got if r["lang"] == "aa")
    assert 8_000 < size <= 10_000 + 40 and len({r["text"] for r in got}) == len(got)
    assert [r["text"] for r in got if r["lang"] == "bb"] == ["lone text"]
    long = table([("aa", "word " * 5000), ("bb", "x")], "lang string, text string")
    assert language.learn(long, sample_bytes=10).langs == ["aa", "bb"]
    with pytest.raises(ValueError):
        language.learn(table([(f"l{i}", "x") for i in range(language.MOST_LANGS + 1)], "lang string, text string"))


def test_clashing_columns_and_repeated_rows(table):
    model = language.learn(table(ROWS, "lang string, text string"))
    df = table([(1, "der hund", "x", 5), (1, "der hund", "x", 5), (None, "the dog", "y", 6)], "doc_id long, text string, TEXT string, Score int")
    got = language.predict(df, model, ["doc_id", "TEXT", "Score"])
    assert got.columns == ["doc_id", "TEXT", "lang_pred", "score"]
    assert sorted((str(r["doc_id"]), r["lang_pred"]) for r in got.collect()) == [("1", "aa"), ("1", "aa"), ("None", "bb")]
