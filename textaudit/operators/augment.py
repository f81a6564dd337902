"""Gender swap and counterfactual augmentation.

The swap works on loss-free tokens (word runs, whitespace runs, single other characters),
so joining the tokens rebuilds the text exactly; only lexicon words change. It is a
higher-order ``transform`` over the token array: row-local, no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as TX


def gender_swap_tokens(toks: Column, lexicon: dict | None = None) -> Column:
    """Swap lexicon words in a token array; ``her`` becomes ``his`` when the next
    non-space token is a word and ``him`` otherwise; Title / UPPER case is carried over."""
    lex = TX.literal_map(lexicon or L.gender_swap_map())
    space = "^" + TX.SPACE_CLASS + "+$"

    def swap(t, i):
        low = F.lower(t)
        nxt1 = F.try_element_at(toks, i + 2)
        nxt2 = F.try_element_at(toks, i + 3)
        nxt = F.when(nxt1.rlike(space), nxt2).otherwise(nxt1)
        her = F.when(nxt.isNotNull() & TX.is_word(nxt), F.lit("his")).otherwise(F.lit("him"))
        repl = F.when(low == "her", her).otherwise(F.try_element_at(lex, low))
        return F.when(TX.is_word(t) & repl.isNotNull(), TX.case_like(t, repl)).otherwise(t)

    return F.transform(toks, swap)


def gender_swap(df: DataFrame, text: str = "text", out: str = "swapped", lexicon: dict | None = None) -> DataFrame:
    """Adds the swapped text and the number of swapped tokens."""
    tok = df.withColumn("_tok", TX.lossless_tokens(text))
    sw = tok.withColumn("_sw", gender_swap_tokens(F.col("_tok"), lexicon))
    n = F.size(F.filter(F.arrays_zip(F.col("_tok").alias("a"), F.col("_sw").alias("b")), lambda z: z["a"] != z["b"]))
    return sw.withColumn(out, F.array_join("_sw", "")).withColumn("n_swapped", n).drop("_tok", "_sw")


def cda_augment(df: DataFrame, text: str = "text", only_if_present: bool = True,
                lexicon: dict | None = None) -> DataFrame:
    """Each row becomes [original] or [original, swapped] (same label and key), the text
    stripped first; with ``only_if_present`` the copy is added only when a word changed.
    Adds ``variant`` in {original, swapped}."""
    stripped = df.withColumn(text, TX.strip_space(F.coalesce(F.col(text), F.lit(""))))
    sw = gender_swap(stripped, text, "_swapped", lexicon)
    other = [c for c in df.columns if c != text]
    orig = F.struct(F.lit("original").alias("variant"), F.col(text).alias("t"))
    copy = F.struct(F.lit("swapped").alias("variant"), F.col("_swapped").alias("t"))
    keep_copy = (F.col("_swapped") != F.col(text)) if only_if_present else F.lit(True)
    arr = F.when(keep_copy, F.array(orig, copy)).otherwise(F.array(orig))
    return sw.select(*other, TX.explode_rows(arr).alias("_v")).select(
        *other, F.col("_v.variant").alias("variant"), F.col("_v.t").alias(text))


def gendered_filter(df: DataFrame, text: str = "text", words=None) -> DataFrame:
    """Adds ``n_gendered`` (lexicon words among the word tokens) and ``has_gendered``."""
    words = sorted(set(words or L.gender_swap_map().keys()))
    toks = TX.word_tokens(text)
    lex = TX.literal_array(words)
    n = F.size(F.filter(toks, lambda t: F.array_contains(lex, t)))
    return df.withColumn("n_gendered", n).withColumn("has_gendered", F.col("n_gendered") > 0)
