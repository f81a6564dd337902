"""Word attributions: keyword weights, subword merging, filtering and top-k, occlusion of a
count-based scorer, linear-model attribution, and stability between two attributions.

Per-document top-k is done in two equivalent ways: the array form (``array_sort`` +
``slice`` on the row, no shuffle) and the row form (``row_number`` over the document,
which Spark turns into a partial top-k before the shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as TX
from . import ranks as RK
from .metrics import DIGITS


def keyword_scores_array(words: Column, weights: dict, k: int = L.KEYWORD_TOP_K) -> Column:
    """Array of ``struct(neg_score, pos, word)`` for the top-k keyword occurrences: weight
    descending, then text order; repeats stay."""
    wmap = TX.literal_map({w: float(v) for w, v in weights.items()})
    # a hash test of every word, so that the map is searched for the few hits alone
    tagged = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: x["word"].isin(*weights))
    hits = F.transform(tagged, lambda x: F.struct((-F.try_element_at(wmap, x["word"])).alias("neg"), x["pos"], x["word"]))
    return F.slice(F.array_sort(F.filter(hits, lambda x: x["neg"].isNotNull())), 1, k)


def keyword_attribution(df: DataFrame, key: str = "doc_id", text: str = "text",
                        weights: dict | None = None, k: int = L.KEYWORD_TOP_K) -> DataFrame:
    """``(key, rank, word, score)`` rows (array form: row-local)."""
    weights = weights or L.KEYWORD_WEIGHTS
    top = keyword_scores_array(TX.word_tokens(text), weights, k)
    return df.select(key, TX.explode_rows(top, pos=True).alias("i", "s")).where(F.col("s").isNotNull()).select(
        key, (F.col("i") + 1).alias("rank"), F.col("s.word").alias("word"), (-F.col("s.neg")).alias("score"))


def keyword_attribution_rows(df: DataFrame, weights: DataFrame, key: str = "doc_id", text: str = "text",
                             k: int = 3) -> DataFrame:
    """Row form: explode word positions, join a weight table, ``row_number`` top-k, limited in
    batches before the sort. Whether the weight table is broadcast is left to the planner, which
    must know its size for that (a file, a local relation): a table of unknown size, as a list makes
    it, costs a shuffle of all words by word, where a hot word is one partition."""
    pos = df.select(key, TX.explode_rows(TX.word_tokens(text), pos=True).alias("pos", "word")).where(
        F.col("word").isNotNull())
    j = pos.join(weights.select("word", F.col("weight").alias("score")), "word")
    return RK.first_rows(j.select(key, "pos", "word", "score"), key, [("score", True), ("pos", False)], k).select(key, "rank", "word", "score")


def top_words(df: DataFrame, key: str = "doc_id", text: str = "text", weights: dict | None = None,
              n: int = L.ATTRIBUTION_WORDS_FOR_COMPONENTS) -> Column:
    """The first ``n`` attribution words as an array column (input of rewrite components)."""
    weights = weights or L.KEYWORD_WEIGHTS
    return F.transform(keyword_scores_array(TX.word_tokens(text), weights, n), lambda s: s["word"])


#: Words that the batch function below gives at a time.
BATCH_WORDS = 1 << 16


def _merged_rows(key: str):
    """Batch function of :func:`merge_subwords`: the words of the pieces of whole documents."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in TX.item_slices(batches, 1):
            told = batch.column("rows").flatten()
            row = np.repeat(np.arange(batch.num_rows), batch.column("rows").value_lengths().to_numpy(zero_copy_only=False))
            pos, piece, score = (told.field(k) for k in ("pos", "piece", "score"))
            place = np.where(pos.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min,
                             pc.fill_null(pos.cast("int64"), 0).to_numpy(zero_copy_only=False))
            same = row[1:] == row[:-1]
            if np.any(same & (place[1:] <= place[:-1])):
                texts = pc.rank(piece, tiebreaker="dense").to_numpy()
                order = np.lexsort((texts, place, row))
                row, piece, score = row[order], piece.take(pa.array(order)), score.take(pa.array(order))
            none = piece.is_null().to_numpy(zero_copy_only=False)
            goes_on = pc.fill_null(pc.starts_with(piece, "##"), True)
            starts = ~goes_on.to_numpy(zero_copy_only=False)
            # the first piece of a document that is not null begins a word, whatever it is
            some = np.flatnonzero(~none)
            first = some[np.flatnonzero(np.r_[True, row[some][1:] != row[some][:-1]][:len(some)])]
            begins = starts.copy()
            begins[first] = True
            begins[np.flatnonzero(np.r_[True, ~same][:len(row)])] = True
            start, word = np.flatnonzero(begins), np.cumsum(begins) - 1
            # words are numbered by the pieces that are no continuation, up to and with their own
            upto, of = np.cumsum(starts), row[start]
            before = (upto - starts)[np.searchsorted(row, of)]
            number = upto[start] - before
            m = len(start)
            has = ~score.is_null().to_numpy(zero_copy_only=False)
            given = np.bincount(word, has, m)
            mean = np.bincount(word, np.where(has, pc.fill_null(score.cast("float64"), 0.0).to_numpy(zero_copy_only=False), 0.0), m) / np.maximum(given, 1)
            body = pc.fill_null(pc.if_else(pc.starts_with(piece, "##"), pc.utf8_slice_codeunits(piece, 2), piece), "")
            raw = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[start, len(row)].astype(np.int32)), body), "")
            whole = pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(of)), pa.array(number.astype(np.int64)), raw, pa.array(mean, mask=given == 0)],
                                               names=[key, "word_pos", "raw", "mean"])
            for a in range(0, m, BATCH_WORDS):
                yield whole.slice(a, BATCH_WORDS)
    return run


def merge_subwords(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, pos, piece, score)`` -> ``(key, word_pos, word, score)``: pieces starting with
    ``##`` continue the previous word; the word score is the mean of its pieces; a leading
    ``##`` piece starts a word of its own; empty words are dropped.

    A document's pieces are gathered by one grouping, on the side of the map first, so that an array
    a document and task is shuffled; its words are then ranges of the array in order, found a bounded
    number of pieces at a time."""
    kind = pieces.schema[key].dataType.simpleString()
    row = F.struct("pos", F.col("piece").cast("string").alias("piece"), F.col("score").cast("double").alias("score"))
    whole = pieces.groupBy(key).agg(F.collect_list(row).alias("rows"))
    words = whole.mapInArrow(_merged_rows(key), f"`{key}` {kind}, word_pos bigint, raw string, mean double")
    return words.where(F.col("raw") != "").select(
        key, "word_pos", F.trim(F.replace(F.col("raw"), F.lit("##"), F.lit(""))).alias("word"), F.round("mean", DIGITS).alias("score"))


def filter_attributions(words: DataFrame, key: str = "doc_id", k: int = L.ATTRIBUTION_TOP_K) -> DataFrame:
    """Drop blanks, special tokens and one-character words; top-k by |score|, text order on
    ties."""
    keep = ((F.trim(F.col("word")) != "") & (~F.col("word").isin(*L.SPECIAL_TOKENS))
            & (F.length("word") > 1))
    w = Window.partitionBy(key).orderBy(F.abs(F.col("score")).desc(), F.col("word_pos"))
    return (words.where(keep).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(key, "rank", "word", F.round("score", DIGITS).alias("score")))


def _least_words(lexicon, k: int):
    """Batch function of :func:`occlusion_attribution`: of a row's words with one count, inside or
    outside of ``lexicon``, the first ``k`` of the sorted counts."""
    def least(counts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        sizes = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, row = counts.flatten(), np.repeat(np.arange(len(counts)), sizes)
        known = pc.is_in(flat.field("word"), value_set=pa.array(lexicon, pa.string())).to_numpy(zero_copy_only=False)
        c = flat.field("c").to_numpy(zero_copy_only=False)
        order = np.lexsort((known, c, row))  # stable: words stay in order
        own = [x[order] for x in (row, c, known)]
        new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in own])][:len(row)]
        place = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        kept = np.sort(order[place < k])
        ends = np.searchsorted(row[kept], np.arange(len(counts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), flat.take(pa.array(kept)), mask=counts.is_null())
    return least


def occlusion_attribution(df: DataFrame, model, key: str = "doc_id", text: str = "text",
                          k: int = L.ATTRIBUTION_TOP_K) -> DataFrame:
    """Occlusion for a count-based rule scorer: remove every occurrence of one distinct word,
    rescore, report ``delta = proba - proba_without_word``; top-k per document by |delta|
    (ties by word).

    The scorer depends on (hits, n_tokens) only, so removing word w gives
    (hits - c_w * [w in lexicon], n - c_w) exactly, from the word counts of the row: no
    rescoring pass per variant text, and no shuffle but the top-k's, limited per partition. Words of
    a document that have the same count and are alike in or out of the lexicon have the same delta,
    so of each such class only the first ``k`` words can be in the top-k: the others are not scored."""
    toks = TX.word_tokens(text)
    least = _least_words(list(model.words), k)

    def near(counts):
        return least(counts)

    per_doc = df.select(key, toks.alias("_t"))
    per_doc = TX.with_counts(per_doc.select(key, "_t", F.size("_t").alias("n"), model.hits(F.col("_t")).alias("hits")), F.col("_t"))
    few = F.arrow_udf(near, "array<struct<word: string, c: bigint>>")(F.col("counts"))
    counts = per_doc.select(key, "n", "hits", TX.explode_rows(few).alias("t")).where(F.col("t").isNotNull()).select(
        key, "n", "hits", F.col("t.word").alias("word"), F.col("t.c").alias("c"))

    def prob(h, n):
        x = F.lit(model.intercept) + F.lit(model.slope) * h / F.greatest(n, F.lit(1))
        return F.round(TX.sigmoid(x), DIGITS)

    inlex = F.col("word").isin(*model.words).cast("int")
    p0 = prob(F.col("hits"), F.col("n"))
    p1 = prob(F.col("hits") - F.col("c") * inlex, F.col("n") - F.col("c"))
    d = counts.select(key, "word", "c", F.round(p0 - p1, DIGITS).alias("delta"))
    w = Window.partitionBy(key).orderBy(F.abs(F.col("delta")).desc(), F.col("word"))
    return (d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(key, "rank", "word", F.col("c").cast("long").alias("count"), "delta"))


def linear_attribution(docs: DataFrame, pipeline_model, key: str = "doc_id", text: str = "text",
                       stop_words=(), k: int = L.ATTRIBUTION_TOP_K) -> DataFrame:
    """Word contributions of a fitted (TF-IDF -> linear model) pipeline: coefficient * (weight -
    mean weight over ``docs``), exact for the logit; top-k per document by |contribution| (ties
    by term), of the terms that the document has.

    Computed from the row's term counts and the vocabulary table (bounded by its size, hence
    broadcast) instead of dense feature vectors."""
    from . import features as FE
    stages = pipeline_model.stages
    vocabulary = next(st for st in stages if hasattr(st, "vocabulary")).vocabulary
    idf = next(st for st in stages if hasattr(st, "getScalingVec")).getScalingVec().toArray().tolist()
    coef = stages[-1].coefficients.toArray().tolist()
    terms = docs.sparkSession.createDataFrame([(w, float(coef[i]), float(idf[i])) for i, w in enumerate(vocabulary)],
                                              "term STRING, coef DOUBLE, idf DOUBLE")
    n = docs.count()
    weights = FE.tfidf_apply(FE.counted_terms(docs, key, text, stop_words), terms, key, keep=("coef",))
    means = weights.groupBy("term").agg((F.sum("weight") / F.lit(float(max(n, 1)))).alias("mean"))
    score = F.round(F.col("coef") * (F.col("weight") - F.col("mean")), DIGITS)
    c = weights.join(F.broadcast(means), "term").select(key, "term", score.alias("score"))
    w = Window.partitionBy(key).orderBy(F.abs(F.col("score")).desc(), F.col("term"))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        key, "rank", F.col("term").alias("word"), "score")


def _as_sums(top: Column, words: Column) -> Column:
    """Summed scores of a top-k array for each of ``words``."""
    return F.transform(words, lambda w: F.aggregate(F.filter(top, lambda s: s["word"] == w), F.lit(0.0), lambda acc, s: acc - s["neg"]))


def attribution_cosine(df: DataFrame, a: Column, b: Column, key: str = "doc_id") -> DataFrame:
    """``(key, cosine)`` of two keyword attributions of the same row (arrays of
    :func:`keyword_scores_array`), as word -> summed score vectors; NULL when either is zero.
    Rows where neither has a word are left out. The arrays hold top-k words, so all of it is
    computed inside the row."""
    both = df.select(key, a.alias("_a"), b.alias("_b"))
    words = both.select(key, "_a", "_b", F.array_distinct(F.concat(F.transform("_a", lambda s: s["word"]), F.transform("_b", lambda s: s["word"]))).alias("_w"))
    sums = words.select(key, F.size("_w").alias("n"), _as_sums(F.col("_a"), F.col("_w")).alias("_a"), _as_sums(F.col("_b"), F.col("_w")).alias("_b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    sums = sums.select(key, "n", dot("_a", "_b").alias("dot"), F.sqrt(dot("_a", "_a")).alias("na"), F.sqrt(dot("_b", "_b")).alias("nb"))
    cosine = F.round(F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / (F.col("na") * F.col("nb"))), DIGITS)
    # a filter on the words would be pushed down and evaluate both attributions once more
    kept = sums.select(key, F.when(F.col("n") > 0, F.array(F.struct(cosine.alias("cosine")))).alias("_x"))
    return kept.select(key, TX.explode_rows(F.col("_x")).alias("s")).where(F.col("s").isNotNull()).select(key, "s.cosine")


def _merged(pieces, scores):
    """Batch function of :func:`merge_subwords_arrays`: the pieces of all rows in one run, of which
    each word is a range; means are not yet rounded."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    n = len(pieces)
    sizes = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, first = pieces.flatten(), np.cumsum(sizes) - sizes
    goes_on = pc.fill_null(pc.starts_with(flat, "##"), False)
    begins = ~goes_on.to_numpy(zero_copy_only=False)
    begins[first[sizes > 0]] = True
    start, word = np.flatnonzero(begins), np.cumsum(begins) - 1
    row = np.repeat(np.arange(n), sizes)
    place = np.arange(len(row)) - first[row]
    # a piece without a score leaves its word without one; scores beyond the pieces are not read
    given = pc.fill_null(pc.list_value_length(scores), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values, at = scores.flatten(), np.cumsum(np.maximum(given, 0)) - np.maximum(given, 0)
    has = place < given[row]
    own = np.zeros(len(row))
    own[has] = pc.fill_null(values, np.nan).to_numpy(zero_copy_only=False)[(at[row] + place)[has]]
    missing = np.zeros(len(row), bool)
    missing[has] = values.is_null().to_numpy(zero_copy_only=False)[(at[row] + place)[has]]
    missing |= given[row] < 0
    m = len(start)
    own = np.where(missing, 0.0, own)
    mean = np.bincount(word, own, m) / np.maximum(np.bincount(word, minlength=m), 1)
    lost = np.bincount(word, missing, m) > 0
    body = pc.fill_null(pc.if_else(goes_on, pc.utf8_slice_codeunits(flat, 2), flat), "")
    ends = pa.array(np.r_[start, len(row)].astype(np.int32))
    raw = pc.binary_join(pa.ListArray.from_arrays(ends, body), "")
    kept = pc.not_equal(raw, "").to_numpy(zero_copy_only=False)
    of = row[start]
    pos = np.arange(m) - np.searchsorted(of, of)
    told = pa.StructArray.from_arrays([pa.array(pos[kept].astype(np.int32)), raw.filter(pa.array(kept)), pa.array(mean[kept], mask=lost[kept])],
                                      names=["word_pos", "raw", "mean"])
    offsets = pa.array(np.searchsorted(of[kept], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, told, mask=pieces.is_null())


def merge_subwords_arrays(df: DataFrame, pieces: str = "pieces", scores: str = "scores",
                          out: str = "words", keep=None) -> DataFrame:
    """Array form of :func:`merge_subwords` for per-document piece arrays: adds ``out`` as
    ``array<struct<word_pos, word, score>>`` computed inside the row (no shuffle). ``keep`` names the
    columns that stay beside it, all by default; those left out are not sent back by the workers.

    Word starts are the positions of pieces without ``##`` (plus position 0 when the array
    starts with a continuation piece); each word is the range up to the next start. Ranges are
    merged in Arrow, a bounded number of pieces at a time: linear in the pieces."""
    stays = [c for c in df.columns if c != out] if keep is None else list(keep)
    made = TX.sliced_rows(df, stays, [F.col(pieces), F.col(scores).cast("array<double>")], _merged, out, "array<struct<word_pos: int, raw: string, mean: double>>")
    return made.withColumn(out, F.transform(out, lambda w: F.struct(
        w["word_pos"].alias("word_pos"), F.trim(F.replace(w["raw"], F.lit("##"), F.lit(""))).alias("word"),
        F.round(w["mean"], DIGITS).alias("score"))))


def top_attributions_array(words: Column, k: int = L.ATTRIBUTION_TOP_K) -> Column:
    """Array form of :func:`filter_attributions`: drop blanks, special tokens and
    one-character words, keep the k largest |score| (text order on ties)."""
    specials = TX.literal_array(L.SPECIAL_TOKENS)
    kept = F.filter(words, lambda w: (F.trim(w["word"]) != "") & ~F.array_contains(specials, w["word"])
                    & (F.length(w["word"]) > 1))
    keyed = F.transform(kept, lambda w: F.struct((-F.abs(w["score"])).alias("k"), w["word_pos"].alias("pos"),
                                                 w["word"].alias("word"), w["score"].alias("score")))
    return F.slice(F.array_sort(keyed), 1, k)
