from pyspark.sql import functions as F

from textaudit import lexicons as L
from textaudit.functions import text as TX
from textaudit.operators import attribution as AT
from textaudit.operators import augment as AU
from textaudit.operators import counterfactual as CF
from textaudit.operators import features as FE


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")


def test_gender_swap_fixtures(spark):
    cases = {
        "He said HE met Mr Smith.": "She said SHE met Ms Smith.",
        "Her book is on the table. I saw her.": "His book is on the table. I saw him.",
        "He gave his wife a gift": "She gave hers husband a gift",
        "The theme is the chemistry.": "The theme is the chemistry.",
    }
    out = AU.gender_swap(docs(spark, list(cases))).collect()
    for r in out:
        assert r["swapped"] == cases[r["text"]]


def test_lossless_tokens_rebuild_text(spark):
    texts = ["  Élan vital,\tnaïve café!\n\nDone ", "a", "", "x—y  z?"]
    d = docs(spark, texts).select("text", F.array_join(TX.lossless_tokens("text"), "").alias("back"))
    for r in d.collect():
        assert r["text"] == r["back"]


def test_swap_keeps_other_tokens(spark):
    text = "Her brother, the actor, met Mr. Jones; HE left."
    r = AU.gender_swap(docs(spark, [text])).first()
    assert r["swapped"] == "His sister, the actress, met Ms. Jones; SHE left."


def test_cda_augment_only_if_present(spark):
    d = docs(spark, [" He is here ", "Nothing to swap"]).withColumn("label", F.lit(1))
    rows = AU.cda_augment(d).collect()
    assert len(rows) == 3
    sw = [r for r in rows if r["variant"] == "swapped"]
    assert sw[0]["text"] == "She is here" and sw[0]["label"] == 1
    assert len(AU.cda_augment(d, only_if_present=False).collect()) == 4


def test_keyword_attribution_fixtures(spark):
    texts = ["Women should be nurses because they are compassionate.",
             "The female secretary was very emotional today.",
             "Critical thinking is valuable across all professional domains."]
    rows = AT.keyword_attribution(docs(spark, texts)).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["rank"])):
        got.setdefault(r["doc_id"], []).append((r["word"], r["score"]))
    assert got[0] == [("women", .8), ("should", .8), ("compassionate", .6)]
    assert got[1] == [("emotional", .6), ("female", .4), ("secretary", .4)]
    assert 2 not in got


def test_keyword_rows_equal_array_form(spark):
    texts = ["he he the she his emotional should", "nothing", "Men too better"]
    w = spark.createDataFrame(list(L.KEYWORD_WEIGHTS.items()), "word STRING, weight DOUBLE")
    a = {(r["doc_id"], r["rank"], r["word"]) for r in AT.keyword_attribution(docs(spark, texts), k=3).collect()}
    b = {(r["doc_id"], r["rank"], r["word"]) for r in AT.keyword_attribution_rows(docs(spark, texts), w, k=3).collect()}
    assert a == b


def test_subword_merge_fixture(spark):
    rows = [(1, 0, "un", .3), (1, 1, "##bias", .6), (1, 2, "##ed", .0), (1, 3, "text", .2),
            (2, 0, "##x", .5), (2, 1, "[cls]", .9), (2, 2, "a", .9), (2, 3, "ok", -.7)]
    p = spark.createDataFrame(rows, "doc_id LONG, pos INT, piece STRING, score DOUBLE")
    merged = {(r["doc_id"], r["word"]): r["score"] for r in AT.merge_subwords(p).collect()}
    assert abs(merged[(1, "unbiased")] - .3) < 1e-9 and merged[(1, "text")] == .2
    top = [(r["word"], r["score"]) for r in sorted(AT.filter_attributions(AT.merge_subwords(p)).where("doc_id = 2").collect(),
                                                   key=lambda r: r["rank"])]
    assert top == [("ok", -.7)]


def test_neutral_replace_fixtures(spark):
    texts = ["The female secretary was very emotional today.", "very male", "Talk to women.",
             "He needs to be decisive"]
    out = {r["doc_id"]: r["r"] for r in docs(spark, texts).select("doc_id", CF.neutral_replace("text").alias("r")).collect()}
    assert out[0] == "The administrative demonstrated emotional intelligence today."
    assert out[1] == ""
    assert out[2] == "Talk to people"
    assert out[3] == "They can benefit from being strategic decision-making"


def test_counterfactual_fixture(spark):
    texts = ["The female secretary was very emotional today.", "The meeting was during lunch.",
             "He needs to be more aggressive in meetings"]
    rows = CF.counterfactuals(docs(spark, texts)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["rank"])):
        by.setdefault(r["doc_id"], []).append(r["suggestion"])
    assert by[0] == ["The administrative professional demonstrated emotional intelligence during the workday.",
                     "During the workday, the administrative professional showed emotional intelligence.",
                     "Developing emotional intelligence is valuable for professional growth."]
    for sugg in by.values():
        assert 1 <= len(sugg) <= 3 and len(set(sugg)) == len(sugg)
        assert all(s[-1] in ".!?" for s in sugg)
    # one routed category (behavior_description): the neutral replacement comes third
    assert by[1][2] == "The meeting demonstrated during lunch."


def test_gender_neutralize_whole_words(spark):
    out = docs(spark, ["He and SHE met the mentor, women too"]).select(
        TX.clean_sentence(CF.neutralize_gender_words("text")).alias("n")).first()["n"]
    assert out == "People and people met the mentor, people too."


def test_mean_pool_fixture(spark):
    vecs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word STRING, vec ARRAY<FLOAT>")
    d = docs(spark, ["a b zzz", "a a b", "zzz", ""])
    rows = FE.mean_pool(d, vecs, vec_key="word", vec_col="vec").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], {})[r["dim"]] = r["value"]
    assert got[0] == {0: 0.5, 1: 0.5}
    assert got[1] == {0: 0.666667, 1: 0.333333}
    assert got[2] == {0: 0.0, 1: 0.0} and got[3] == {0: 0.0, 1: 0.0}


def test_occlusion_matches_rescoring(spark):
    from textaudit.operators.models import RuleModel
    m = RuleModel("r", ("the", "a"), -1.0, 5.0)
    text = "the cat saw a dog and the bird"
    d = docs(spark, [text])
    occ = {r["word"]: r["delta"] for r in AT.occlusion_attribution(d, m).collect()}
    base = d.select(m.proba(TX.word_tokens("text")).alias("p")).first()["p"]
    for w, delta in occ.items():
        rest = " ".join(t for t in text.split() if t != w)
        p1 = docs(spark, [rest]).select(m.proba(TX.word_tokens("text")).alias("p")).first()["p"]
        assert abs((base - p1) - delta) < 1e-6


def test_tfidf_small(spark):
    d = docs(spark, ["apple banana apple", "banana cherry", "apple cherry cherry"])
    vocab, w = FE.tfidf_terms(d, min_df=2, max_terms=100)
    terms = {r["term"]: r["df"] for r in vocab.collect()}
    assert terms == {"apple": 2, "banana": 2, "cherry": 2}
    norms = w.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()
    assert all(abs(r["s"] - 1.0) < 1e-5 for r in norms)


def test_subword_array_form_equals_rows(spark):
    from textaudit.plans import text as PT
    d = docs(spark, ["Unbiased text, xx yyyyyyy zzzzz a bb", "", "##", "internationalisation of words"])
    rows = {(r["doc_id"], r["rank"], r["word"], r["score"])
            for r in AT.filter_attributions(AT.merge_subwords(PT.pieces(d))).collect()}
    a = AT.merge_subwords_arrays(PT.piece_arrays(d))
    top = AT.top_attributions_array(F.col("words"))
    arr = {(r["doc_id"], i + 1, w["word"], w["score"]) for r in a.select("doc_id", top.alias("t")).collect()
           for i, w in enumerate(r["t"])}
    assert rows == arr and len(rows) > 0


def test_subword_array_fixture(spark):
    df = spark.createDataFrame([(1, ["un", "##bias", "##ed", "text"], [.3, .6, .0, .2]),
                                (2, ["##x", "##y", "ok"], [.5, .1, .4])],
                               "doc_id LONG, pieces ARRAY<STRING>, scores ARRAY<DOUBLE>")
    got = {r["doc_id"]: [(w["word"], w["score"]) for w in r["m"]]
           for r in AT.merge_subwords_arrays(df).select("doc_id", F.col("words").alias("m")).collect()}
    assert got[1] == [("unbiased", 0.3), ("text", 0.2)]
    assert got[2] == [("xy", 0.3), ("ok", 0.4)]
