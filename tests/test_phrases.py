import random

from pyspark.sql import functions as F

from textaudit.functions import text as TX
from textaudit.operators import phrases as PH


def test_equals_the_chain_of_contains(spark):
    r = random.Random(3)
    phrases = ["".join(r.choice("ab é") for _ in range(r.randint(1, 5))) for _ in range(60)] + ["", "AB", "É"]
    texts = ["".join(r.choice("abAB éÉc") for _ in range(r.randint(0, 40))) for _ in range(120)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (1 << 20, 40):  # one block, several
        got = {tuple(x) for x in PH.contained(docs, phrases, most=most).collect()}
        want = {(i, p.lower()) for i, t in enumerate(texts) for p in phrases if p and p.lower() in (t or "").lower()}
        assert got == want
    chain = {x["doc_id"] for x in docs.where(TX.contains_any(F.lower("text"), [p.lower() for p in phrases if p])).collect()}
    assert chain == {d for d, _ in want}


def test_leftmost_longest_and_positions(spark):
    docs = spark.createDataFrame([(1, "New York City and new york"), (2, "xx")], "doc_id long, text string")
    got = PH.phrase_hits(docs, ["york", "new york", "new york city", "city and"], all_hits=False).collect()
    assert sorted((x["start"], x["phrase"]) for x in got) == [(0, "new york city"), (18, "new york")]
    assert PH.phrase_hits(docs, []).count() == 0


def test_ten_thousand_phrases_in_one_pass(spark):
    phrases = [f"phrase number {i} of" for i in range(10_000)]
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("a phrase number "), F.col("id") * 31, F.lit(" of the list")).alias("text"))
    plan = PH.phrase_hits(docs, phrases)
    assert plan.count() == 300 and len(list(PH.blocks(phrases))) == 1
