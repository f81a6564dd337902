import random

import public_tokenizers as P
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from locations import SF_SMALL
from textaudit.llm.frames import documents
from textaudit.llm.tokencount import Counting, Merger, count_tokens

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda text: len(tok.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def mine():
    counting = Counting(PATH)
    return lambda text: counting.texts([text])[0]


def brute(merges, word):
    """The lowest-ranked adjacent pair, leftmost first, again and again."""
    ranks, parts = {m: i for i, m in enumerate(merges)}, list(word)
    while True:
        best = min(((ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks), default=None)
        if best is None:
            return len(parts)
        i = best[1]
        parts[i:i + 2] = ["".join(parts[i:i + 2])]


def test_heap_equals_rescanning():
    rnd = random.Random(3)
    for _ in range(300):
        symbols, merges = list("abc"), []
        for _ in range(12):
            pair = (rnd.choice(symbols), rnd.choice(symbols))
            if pair not in merges:
                merges.append(pair)
                symbols.append("".join(pair))
        merger = Merger(merges)
        for _ in range(10):
            word = "".join(rnd.choice("abcd") for _ in range(rnd.randint(0, 20)))
            assert merger.count(word) == brute(merges, word), (merges, word)


def test_random_texts_equal_the_library(mine, library):
    rnd = random.Random(1)
    pool = "aAbBzZ09 \t\n\x1c\x85'sté́ßΣςİ中文한글😀‍٣½ǅﬁ\x00\x7f,.!"
    bits = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "'re", " ", " ", "the", "ing", "<|endoftext|><|endoftext|>"]
    for _ in range(4000):
        s = "".join(rnd.choice(bits) if rnd.random() < .3 else rnd.choice(pool) for _ in range(rnd.randint(0, 30)))
        assert mine(s) == library(s), s


def test_every_code_point_equals_the_library(mine, library):
    for low in range(0, 0x110000, 64):
        s = " ".join(f"a{chr(c)}b {chr(c)}" for c in range(low, low + 64) if not 0xD800 <= c < 0xE000)
        assert mine(s) == library(s), hex(low)


def test_whole_table_equals_the_library(spark, library):
    docs = documents(spark, SF_SMALL)
    got = {r["doc_id"]: r for r in count_tokens(docs, ["doc_id"], PATH, limit=100).collect()}
    for r in docs.collect():
        n = library(r["text"] or "")
        assert (got[r["doc_id"]]["n_bytes"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["over_limit"]) == (len((r["text"] or "").encode()), n, n > 100)


def test_nulls_long_words_repeats_and_clashing_columns(spark, table, library):
    long = "ab" * 200_000
    rows = [(1, None, 5), (2, "", 5), (None, "the cat", 5), (3, "the cat", 5), (3, "the cat", 5), (4, long, 5), (5, " \n\t ", 5)]
    df = table(rows, "doc_id bigint, text string, N_TOKENS int")
    got = sorted(map(tuple, count_tokens(df, ["doc_id", "N_TOKENS"], PATH).collect()), key=str)
    want = sorted(((d, len((t or "").encode()), n := library(t or ""), n > 2048) for d, t, _ in rows), key=str)
    assert got == want
    empty = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert count_tokens(empty, ["doc_id"], PATH).count() == 0
