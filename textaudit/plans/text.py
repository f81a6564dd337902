"""Text-audit queries over ``documents``: gender swap and augmentation, attributions,
subword merging, neutral rewrites, counterfactual suggestions, stability, occlusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as TX
from ..operators import attribution as AT
from ..operators import augment as AU
from ..operators import counterfactual as CF
from ..operators import fairness as FA
from ..operators import phrases as PH
from ..operators import pieces as PC
from . import setup as U
from . import textsql as Q
from .registry import query

# Keyword weights of the attribution queries: the fixed keyword set plus frequent words of
# the corpus, so that every document language produces attributions.
QUERY_WEIGHTS = {**L.KEYWORD_WEIGHTS, "the": 0.4, "that": 0.6, "with": 0.8, "de": 0.6, "der": 0.4, "la": 0.8}
SWAP = L.gender_swap_map()
PIECE_LEN = 3


def _docs(spark, sf):
    return U.tables(spark, sf).documents


_SWAP_CTE = f"""
sw0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {Q.LOSSLESS}) AS toks FROM documents),
sw1 AS (SELECT doc_id, toks, {Q.swap_tokens('toks', SWAP)} AS st FROM sw0),
sw AS (SELECT doc_id, array_to_string(st, '') AS swapped,
              CAST(len(list_filter(list_zip(toks, st), lambda z: z[1] <> z[2])) AS INTEGER) AS n_swapped FROM sw1)"""


@query("gender_swap", "WITH " + _SWAP_CTE + "\nSELECT doc_id, swapped, n_swapped FROM sw", headline=True)
def gender_swap(spark, sf):
    return AU.gender_swap(_docs(spark, sf).select("doc_id", "text")).select("doc_id", "swapped", "n_swapped")


@query("cda_augment", f"""
WITH d AS (SELECT d.doc_id, CAST(coalesce(l.toxic, 0) AS INTEGER) AS label, {Q.strip("coalesce(d.text, '')")} AS text
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
t AS (SELECT doc_id, label, text, regexp_extract_all(text, {Q.LOSSLESS}) AS toks FROM d),
s AS (SELECT doc_id, label, text, array_to_string({Q.swap_tokens('toks', SWAP)}, '') AS swapped FROM t)
SELECT doc_id, label, 'original' AS variant, text FROM s
UNION ALL SELECT doc_id, label, 'swapped', swapped FROM s WHERE swapped <> text""")
def cda_augment(spark, sf):
    t = U.tables(spark, sf)
    d = t.documents.select("doc_id", "text").join(
        t.labels.select("doc_id", F.col("toxic").cast("int").alias("label")), "doc_id",
        "left").fillna(0, ["label"])
    return AU.cda_augment(d).select("doc_id", "label", "variant", "text")


@query("gendered_filter", f"""
SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}),
                    lambda w: w IN {Q.in_list(sorted(SWAP))})) AS INTEGER) AS n_gendered,
       len(list_filter(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}),
                    lambda w: w IN {Q.in_list(sorted(SWAP))})) > 0 AS has_gendered FROM documents""")
def gendered_filter(spark, sf):
    return AU.gendered_filter(_docs(spark, sf).select("doc_id", "text")).select("doc_id", "n_gendered", "has_gendered")


def _kw_sql(text_expr: str, weights: dict, k: int, src: str = "documents") -> str:
    return f"""
SELECT doc_id, rank, word, score FROM (
  SELECT doc_id, x.w AS word, {Q.case_map('x.w', weights)} AS score,
         row_number() OVER (PARTITION BY doc_id ORDER BY {Q.case_map('x.w', weights)} DESC, x.p) AS rank
  FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(lower(coalesce({text_expr}, '')), {Q.WORD}),
                                             lambda w, i: {{'w': w, 'p': i}})) AS x FROM {src})
  WHERE x.w IN {Q.in_list(weights)}) WHERE rank <= {k}"""


@query("keyword_attribution", _kw_sql("text", QUERY_WEIGHTS, L.KEYWORD_TOP_K), headline=True)
def keyword_attribution(spark, sf):
    return AT.keyword_attribution(_docs(spark, sf), weights=QUERY_WEIGHTS)


@query("attribution_topk", _kw_sql("text", QUERY_WEIGHTS, L.ATTRIBUTION_WORDS_FOR_COMPONENTS))
def attribution_topk(spark, sf):
    import pyarrow as pa
    # as an Arrow table it becomes a local relation, whose size the planner knows
    w = spark.createDataFrame(pa.table({"word": list(QUERY_WEIGHTS), "weight": [float(v) for v in QUERY_WEIGHTS.values()]}))
    return AT.keyword_attribution_rows(_docs(spark, sf), w, k=L.ATTRIBUTION_WORDS_FOR_COMPONENTS)


def _cut(lists):
    """Batch function of :func:`_piece_structs`: a piece begins at every ``PIECE_LEN``-th character
    of a word, found among the bytes of the words of all rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().cast(pa.string())
    n = len(words)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + n + 1] if n else np.zeros(1, np.int32)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]] if n else np.zeros(0, np.uint8)
    begins = (data & 0xC0) != 0x80  # bytes that begin a character
    chars = np.r_[0, np.cumsum(begins)][ends - ends[0]]
    word = np.repeat(np.arange(n), np.diff(chars))
    place = np.arange(len(word)) - chars[word]
    cut = place % PIECE_LEN == 0
    at, word, j = np.flatnonzero(begins)[cut].astype(np.int32), word[cut], place[cut] // PIECE_LEN
    first = np.cumsum(sizes) - sizes
    p = (np.arange(n) - np.repeat(first, sizes))[word]
    piece = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, np.int32(len(data))].astype(np.int32)), pa.py_buffer(data.tobytes()))
    piece = pc.if_else(pa.array(j > 0), pc.binary_join_element_wise("##", piece, ""), piece)
    told = pa.StructArray.from_arrays([piece, pa.array(((p * 31 + j * 17) % 19 - 9) / 10.0)], names=["piece", "score"])
    rows = np.searchsorted(word, np.r_[first, n]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(rows), told, mask=lists.is_null())


_PIECES = "array<struct<piece: string, score: double>>"


def _piece_structs():
    """Stand-in subword pieces of each document: every word token is cut into chunks of
    three characters; continuation chunks carry ``##``. Piece score:
    ((31 p + 17 j) mod 19 - 9) / 10 for the j-th chunk of the p-th word."""
    def cut(lists):
        return _cut(lists)
    return F.arrow_udf(cut, _PIECES)(TX.word_tokens("text"))


def _piece_rows(docs):
    """``(doc_id, p)``: the pieces of :func:`_piece_structs`, a bounded number of words at a time."""
    return TX.sliced_rows(docs, ["doc_id"], [TX.word_tokens("text")], _cut, "p", _PIECES)


def pieces(docs):
    """The pieces as a ``(doc_id, pos, piece, score)`` table."""
    return _piece_rows(docs).select("doc_id", TX.explode_rows(F.col("p"), pos=True).alias("pos", "s")).where(
        F.col("s").isNotNull()).select("doc_id", "pos", F.col("s.piece").alias("piece"), F.col("s.score").alias("score"))


def piece_arrays(docs):
    """The pieces as per-document arrays ``(doc_id, pieces, scores)``."""
    return _piece_rows(docs).select("doc_id", F.col("p.piece").alias("pieces"), F.col("p.score").alias("scores"))


_SUBWORD_SQL = f"""
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}),
                                                lambda w, i: {{'w': w, 'p': i - 1}})) AS x FROM documents),
s AS (SELECT doc_id, x.w AS word, x.p AS p,
             round((SELECT avg(((x.p * 31 + j * 17) % 19 - 9) / 10.0)
                    FROM range(0, CAST(ceil(len(x.w) / {PIECE_LEN}) AS BIGINT)) r(j)), 6) AS score FROM t),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(score) DESC, p) AS rank FROM s
      WHERE length(word) > 1 AND word NOT IN {Q.in_list(L.SPECIAL_TOKENS)})
SELECT doc_id, rank, word, score FROM f WHERE rank <= {L.ATTRIBUTION_TOP_K}"""


@query("subword_merge", _SUBWORD_SQL)
def subword_merge(spark, sf):
    """Pieces arrive per document, so merging and the top-10 run inside each row."""
    a = AT.merge_subwords_arrays(piece_arrays(_docs(spark, sf)), keep=["doc_id"])
    top = AT.top_attributions_array(F.col("words"))
    return a.select("doc_id", TX.explode_rows(top, pos=True).alias("i", "w")).where(F.col("w").isNotNull()).select(
        "doc_id", (F.col("i") + 1).alias("rank"), F.col("w.word").alias("word"), F.col("w.score").alias("score"))


@query("subword_merge_rows", _SUBWORD_SQL)
def subword_merge_rows(spark, sf):
    """Row form of the same merge for a pieces table (window over each document)."""
    return AT.filter_attributions(AT.merge_subwords(pieces(_docs(spark, sf))))


@query("neutral_replace", f"SELECT doc_id, {Q.neutral_replace('text', L.NEUTRAL_REPLACEMENTS)} AS replaced FROM documents")
def neutral_replace(spark, sf):
    return _docs(spark, sf).select("doc_id", CF.neutral_replace("text").alias("replaced"))


@query("gender_neutralize", f"""
SELECT doc_id, {Q.clean_sentence(Q.neutralize('text', L.NEUTRALIZE_WORDS, L.NEUTRALIZE_TARGET))} AS neutral
FROM documents""")
def gender_neutralize(spark, sf):
    return _docs(spark, sf).select("doc_id", TX.clean_sentence(CF.neutralize_gender_words("text")).alias("neutral"))


def _cf_sql(k: int = 3) -> str:
    tmpl, extra = Q.suggestions("d.text", "coalesce(w.words, CAST([] AS VARCHAR[]))", k, L)
    kw = _kw_sql("text", QUERY_WEIGHTS, L.ATTRIBUTION_WORDS_FOR_COMPONENTS)
    return f"""
WITH kw AS ({kw}),
w AS (SELECT doc_id, list(word ORDER BY rank) AS words FROM kw GROUP BY doc_id),
c0 AS (SELECT d.doc_id, {tmpl} AS tmpl, {extra} AS extra FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
c1 AS (SELECT doc_id, list_concat(tmpl, extra) AS allc FROM c0),
c2 AS (SELECT doc_id, {Q.ordered_distinct('allc')}[1:{k}] AS base FROM c1),
c3 AS (SELECT doc_id, list_transform(base, lambda s: {Q.clean_sentence(Q.polish('s', L))}) AS pol FROM c2),
c4 AS (SELECT doc_id, {Q.ordered_distinct('pol')}[1:{k}] AS sugg FROM c3)
SELECT doc_id, CAST(x.i AS INTEGER) AS rank, x.s AS suggestion
FROM (SELECT doc_id, unnest(list_transform(sugg, lambda s, i: {{'i': i, 's': s}})) AS x FROM c4)"""


@query("counterfactuals", _cf_sql())
def counterfactuals(spark, sf):
    return CF.counterfactuals(_docs(spark, sf), weights=QUERY_WEIGHTS)


def _rescored_sql() -> str:
    m = U.MODELS[0]
    cf = _cf_sql()
    toks = lambda t: f"regexp_extract_all(lower(coalesce({t}, '')), {Q.WORD})"
    return f"""
WITH cf AS ({cf}),
p0 AS (SELECT doc_id, {U.sql_proba(m, toks('text'))} AS p0 FROM documents),
r AS (SELECT cf.doc_id, cf.rank, cf.suggestion, p0.p0 AS a,
             {U.sql_proba(m, toks('cf.suggestion'))} AS b FROM cf JOIN p0 ON cf.doc_id = p0.doc_id)
SELECT doc_id, rank, suggestion, round(a, 6) AS proba_original, round(b, 6) AS proba_rewrite,
       round(b - a, 6) AS delta, round(b - a, 6) < 0 AS lower FROM r"""


@query("rescored_rewrites", _rescored_sql())
def rescored_rewrites(spark, sf):
    return CF.rescore_rewrites(_docs(spark, sf), U.MODELS[0], weights=QUERY_WEIGHTS)


@query("full_audit", f"""
WITH kw AS ({_kw_sql('text', QUERY_WEIGHTS, L.KEYWORD_TOP_K)}),
cf AS ({_cf_sql()}),
p AS (SELECT doc_id, {U.sql_proba(U.MODELS[0], f"regexp_extract_all(lower(coalesce(text, '')), {Q.WORD})")} AS p FROM documents),
parts AS (SELECT doc_id, 'word' AS part, CAST(rank AS INTEGER) AS rank, word AS item, score FROM kw
          UNION ALL SELECT doc_id, 'suggestion', rank, suggestion, NULL FROM cf)
SELECT p.doc_id, round(p.p, 6) AS proba, CASE WHEN p.p > 0.5 THEN 'BIASED' ELSE 'NEUTRAL' END AS bias_class,
       round(greatest(p.p, 1 - p.p), 6) AS confidence, part, rank, item, score FROM p JOIN parts ON p.doc_id = parts.doc_id""")
def full_audit(spark, sf):
    """The audit record of every document, a row for each of its words and suggestions."""
    a = CF.full_audit(_docs(spark, sf), U.MODELS[0], weights=QUERY_WEIGHTS)
    nothing = F.lit(None).cast("double")
    words = F.transform("top_words", lambda w, i: F.struct(
        F.lit("word").alias("part"), (i + 1).alias("rank"), w["word"].alias("item"), w["score"].alias("score")))
    texts = F.transform("suggestions", lambda s, i: F.struct(
        F.lit("suggestion").alias("part"), (i + 1).alias("rank"), s.alias("item"), nothing.alias("score")))
    return a.select("doc_id", "proba", "bias_class", "confidence", F.explode(F.concat(words, texts)).alias("x")).select(
        "doc_id", "proba", "bias_class", "confidence", "x.*")


@query("explanation_stability", "WITH " + _SWAP_CTE + f"""
, a AS ({_kw_sql('text', QUERY_WEIGHTS, L.KEYWORD_TOP_K)}),
b AS ({_kw_sql('swapped', QUERY_WEIGHTS, L.KEYWORD_TOP_K, src='sw')}),
va AS (SELECT doc_id, word, sum(score) AS sa FROM a GROUP BY ALL),
vb AS (SELECT doc_id, word, sum(score) AS sb FROM b GROUP BY ALL),
j AS (SELECT coalesce(va.doc_id, vb.doc_id) AS doc_id, coalesce(sa, 0.0) AS sa, coalesce(sb, 0.0) AS sb
      FROM va FULL OUTER JOIN vb ON va.doc_id = vb.doc_id AND va.word = vb.word),
g AS (SELECT doc_id, sum(sa * sb) AS dot, sqrt(sum(sa * sa)) AS na, sqrt(sum(sb * sb)) AS nb FROM j GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN na > 0 AND nb > 0 THEN dot / (na * nb) END, 6) AS cosine FROM g""")
def explanation_stability(spark, sf):
    d = _docs(spark, sf).select("doc_id", "text")
    s = AU.gender_swap(d)
    top = lambda c: AT.keyword_scores_array(TX.word_tokens(c), QUERY_WEIGHTS, L.KEYWORD_TOP_K)
    return AT.attribution_cosine(s, top("text"), top("swapped"))


def _p_sql(m, h: str, n: str) -> str:
    return (f"round(1.0 / (1.0 + exp(-(CAST({m.intercept!r} AS DOUBLE) + CAST({m.slope!r} AS DOUBLE) * ({h}) "
            f"/ greatest({n}, 1)))), 6)")


_M0 = U.MODELS[0]


@query("occlusion_attribution", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}) AS toks FROM documents),
b AS (SELECT doc_id, len(toks) AS n, len(list_filter(toks, lambda w: w IN {Q.in_list(_M0.words)})) AS hits,
             unnest(toks) AS word FROM t),
c AS (SELECT doc_id, n, hits, word, count(*) AS c FROM b GROUP BY ALL),
d AS (SELECT doc_id, word, c, round({_p_sql(_M0, 'hits', 'n')}
        - {_p_sql(_M0, f"hits - c * CAST(word IN {Q.in_list(_M0.words)} AS INTEGER)", 'n - c')}, 6) AS delta FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(delta) DESC, word) AS rank FROM d)
SELECT doc_id, rank, word, CAST(c AS BIGINT) AS count, delta FROM r WHERE rank <= {L.ATTRIBUTION_TOP_K}""")
def occlusion_attribution(spark, sf):
    return AT.occlusion_attribution(_docs(spark, sf), _M0)


@query("gender_group", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}) AS toks FROM documents),
c AS (SELECT doc_id, CAST(len(list_filter(toks, lambda w: w IN {Q.in_list(L.gender_sides()[0])})) AS INTEGER) AS male_words,
             CAST(len(list_filter(toks, lambda w: w IN {Q.in_list(L.gender_sides()[1])})) AS INTEGER) AS female_words FROM t)
SELECT doc_id, male_words, female_words,
       CASE WHEN male_words > female_words THEN 'male' WHEN female_words > male_words THEN 'female' END AS grp FROM c""")
def gender_group(spark, sf):
    return FA.gender_group(_docs(spark, sf))


@query("conversation_gendered_turns", f"""
WITH t AS (SELECT role, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), {Q.WORD}),
                                        lambda w: w IN {Q.in_list(sorted(SWAP))})) AS n FROM conversations)
SELECT role, CAST(count(*) AS BIGINT) AS turns, CAST(count_if(n > 0) AS BIGINT) AS gendered_turns,
       CAST(sum(n) AS BIGINT) AS gendered_words FROM t GROUP BY role""")
def conversation_gendered_turns(spark, sf):
    """Second corpus: gendered words per conversation role."""
    c = AU.gendered_filter(U.tables(spark, sf).conversations.select("role", "text"))
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"),
                                 F.count_if("has_gendered").cast("long").alias("gendered_turns"),
                                 F.sum("n_gendered").cast("long").alias("gendered_words"))


@query("conversation_cda", f"""
WITH d AS (SELECT conv_id, turn, role, {Q.strip("coalesce(text, '')")} AS text FROM conversations),
t AS (SELECT *, regexp_extract_all(text, {Q.LOSSLESS}) AS toks FROM d),
s AS (SELECT conv_id, turn, role, text, array_to_string({Q.swap_tokens('toks', SWAP)}, '') AS swapped FROM t)
SELECT conv_id, turn, role, 'original' AS variant, text FROM s
UNION ALL SELECT conv_id, turn, role, 'swapped', swapped FROM s WHERE swapped <> text""")
def conversation_cda(spark, sf):
    """Counterfactual augmentation of conversation turns (key: conv_id, turn)."""
    c = U.tables(spark, sf).conversations.select("conv_id", "turn", "role", "text")
    return AU.cda_augment(c).select("conv_id", "turn", "role", "variant", "text")


@query("benchmark_attribution", _kw_sql("text", QUERY_WEIGHTS, L.KEYWORD_TOP_K, src="(SELECT item_id AS doc_id, text FROM benchmark)"))
def benchmark_attribution(spark, sf):
    """Keyword attribution of the benchmark items (a second corpus)."""
    b = U.tables(spark, sf).benchmark.select(F.col("item_id").alias("doc_id"), "text")
    return AT.keyword_attribution(b, weights=QUERY_WEIGHTS)


@query("piece_merge", r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_transform(w, lambda v, i: {'p': i - 1, 'w': v})) AS s FROM t)
SELECT doc_id, CAST(s.p AS INTEGER) AS word_pos, s.w AS word, round(length(s.w) / 100.0, 6) AS score FROM x""")
def piece_merge(spark, sf):
    """Words cut into the pieces of a public vocabulary, each piece scored by its word's length,
    and merged again: the words with their scores."""
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    cut = PC.segmented(_docs(spark, sf), lambda: PC.byte_level_vocabulary(path))
    scores = F.transform(PC.word_sizes(F.col("pieces")), lambda n: n / 100.0)
    words = AT.merge_subwords_arrays(cut.select("doc_id", "pieces", scores.alias("scores")), keep=["doc_id"])
    return words.select("doc_id", TX.explode_rows(F.col("words")).alias("w")).where(F.col("w").isNotNull()).select(
        "doc_id", F.col("w.word_pos").cast("int").alias("word_pos"), "w.word", "w.score")


_TRIGGERS_SQL = r"""
WITH w AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
p AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w))
SELECT doc_id, count(*) AS n_phrases, min(phrase) AS first_phrase FROM documents, p WHERE contains(lower(coalesce(text, '')), phrase) GROUP BY 1"""


@query("contained_phrases", _TRIGGERS_SQL)
def contained_phrases(spark, sf):
    """How many of the benchmark's word pairs every document contains."""
    w = U.tables(spark, sf).benchmark.select(TX.word_tokens("text").alias("w"))
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    listed = w.select(F.explode(pairs).alias("p")).distinct()
    found = PH.contained(_docs(spark, sf), (r["p"] for r in listed.toLocalIterator()))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_phrases"), F.min("phrase").alias("first_phrase"))
