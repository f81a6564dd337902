"""Text features: TF-IDF term weights (SQL form), class weights, label encoding,
mean-pooled word vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX
from ..session import saved_table
from .metrics import DIGITS


MAX_CLASS = 100_000


def class_weights(df: DataFrame, label: str = "label", mode: str = "sum_count") -> DataFrame:
    """``(cls, count, weight)`` for classes 0..max label; an absent class counts as 1. A
    largest label beyond ``MAX_CLASS`` is an error: such a column holds ids, not classes.

    ``sum_count``: total / count; ``balanced``: total / (k * count)."""
    counts = df.groupBy(F.col(label).cast("int").alias("cls")).agg(F.count(F.lit(1)).alias("c"))
    # class ids 0..max label: one row per class
    mx = counts.agg(F.max("cls").alias("m")).select(
        F.when(F.col("m") > MAX_CLASS, F.raise_error(F.lit(f"label above {MAX_CLASS}: not a class column")).cast("int"))
        .otherwise(F.col("m")).alias("m"))
    ids = mx.select(F.explode(F.sequence(F.lit(0), F.greatest(F.col("m"), F.lit(0)))).alias("cls"))
    full = ids.join(counts, "cls", "left").select("cls", F.coalesce(F.col("c"), F.lit(1)).cast("long").alias("count"))
    w = Window.partitionBy(F.lit(0))  # over the class table only (one row per class)
    total = F.sum("count").over(w)
    k = F.count(F.lit(1)).over(w)
    weight = total / F.col("count") if mode == "sum_count" else total / (k * F.col("count"))
    return full.select("cls", "count", F.round(weight, DIGITS).alias("weight"))


def label_index(df: DataFrame, label: str):
    """String classes sorted alphabetically -> 0..k-1 (unseen classes are an error)."""
    from pyspark.ml.feature import StringIndexer
    return StringIndexer(inputCol=label, outputCol=label + "_idx", stringOrderType="alphabetAsc",
                         handleInvalid="error").fit(df)


def term_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words=()) -> DataFrame:
    """``(key, tokens)``: lower-cased runs of 2+ word characters, stop words removed."""
    toks = TX.word_tokens(text, lower=True, min_len=2)
    if stop_words:
        toks = F.filter(toks, lambda t: ~t.isin(*sorted(set(stop_words))))
    return docs.select(key, toks.alias("tokens"))


def counted_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words=()) -> DataFrame:
    """``(key, counts array<struct<word, c>>)``: uni- and bigrams of :func:`term_tokens`; counted
    inside the row."""
    return TX.counted_rows(term_tokens(docs, key, text, stop_words), [key], F.col("tokens"), pairs=True)


#: Distinct terms of batches that a task holds before it adds them up.
HELD_TERMS = 1 << 17


def _batch_terms(batches):
    """Batch function of :func:`tfidf_vocabulary`: ``(term, df, tf)`` of many documents at a time, read a
    bounded number of terms at a time."""
    import pyarrow as pa

    def summed(parts):
        whole = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("df", "sum"), ("tf", "sum")])
        return pa.table([whole["term"], whole["df_sum"], whole["tf_sum"]], names=["term", "df", "tf"])

    held, n = [], 0
    for part in TX.item_slices(batches, 0):
        flat = part.column("counts").flatten()
        each = pa.table([flat.field("word"), flat.field("c")], names=["term", "c"]).group_by("term", use_threads=False).aggregate([("c", "count"), ("c", "sum")])
        held.append(pa.table([each["term"], each["c_count"], each["c_sum"]], names=["term", "df", "tf"]))
        n += each.num_rows
        if n > HELD_TERMS:
            whole = summed(held)
            # terms that hardly repeat are sent on; others are kept for the batches to come
            if whole.num_rows * 2 > HELD_TERMS:
                yield from whole.to_batches(max_chunksize=1 << 16)
                held, n = [], 0
            else:
                held, n = [whole], whole.num_rows
    if held:
        yield from summed(held).to_batches(max_chunksize=1 << 16)


def _token_terms(batches):
    """Batch function of :func:`tfidf_vocabulary`: :func:`_batch_terms` of documents given as tokens,
    counted in the same worker."""
    import pyarrow as pa
    counts = TX._counted(True)
    yield from _batch_terms(pa.RecordBatch.from_arrays([counts(x.column(0))], names=["counts"]) for x in TX.item_slices(batches, 0))


def tfidf_vocabulary(counted: DataFrame, n_docs: int, min_df: int = 2, max_terms: int = 10000) -> DataFrame:
    """``(term, df, tf_total, idf)``: terms in >= ``min_df`` documents, the ``max_terms`` most
    frequent (ties by term); idf = ln((1 + n) / (1 + df)) + 1. Terms are added up over many documents
    in each task first. One shuffle, by term. ``counted`` has the terms of each document as
    ``counts`` or, so that they need not be sent, its ``tokens`` (:func:`term_tokens`)."""
    told = [c for c in ("counts", "tokens") if c in counted.columns][0]
    each = counted.select(told).mapInArrow(_batch_terms if told == "counts" else _token_terms, "term string, df bigint, tf bigint")
    stats = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf_total"))
    return (stats.where(F.col("df") >= min_df).orderBy(F.col("tf_total").desc(), F.col("term")).limit(max_terms)
            .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0))


def tfidf_apply(counted: DataFrame, vocab: DataFrame, key: str = "doc_id", keep=()) -> DataFrame:
    """``(key, term, keep..., weight)``: tf * idf by a vocabulary of at most ``max_terms`` rows
    (hence broadcast), L2-normalised per document (the only shuffle, by key)."""
    each = counted.select(key, TX.explode_rows(F.col("counts")).alias("t")).where(F.col("t").isNotNull())
    raw = each.select(key, F.col("t.word").alias("term"), F.col("t.c").alias("tf")).join(
        F.broadcast(vocab.select("term", "idf", *keep)), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", *keep, (F.col("w") / norm).alias("weight"))


def tfidf_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", stop_words=(),
                min_df: int = 2, max_terms: int = 10000) -> tuple[DataFrame, DataFrame]:
    """Uni- and bigram TF-IDF: (vocabulary ``(term, df, tf_total, idf)``, weights ``(key, term,
    weight)``), rounded for output."""
    counted = counted_terms(docs, key, text, stop_words)
    vocab = tfidf_vocabulary(term_tokens(docs, key, text, stop_words), docs.count(), min_df, max_terms)
    weights = tfidf_apply(counted, vocab, key).withColumn("weight", F.round("weight", DIGITS))
    vocab_out = vocab.select("term", F.col("df").cast("long").alias("df"), F.col("tf_total").cast("long").alias("tf_total"),
                             F.round("idf", DIGITS).alias("idf"))
    return vocab_out, weights


def word_vector_id(word, n_ids: int):
    """Stand-in vocabulary: a word's vector id from its md5 (same in every engine)."""
    w = F.col(word) if isinstance(word, str) else word
    return F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(n_ids))


#: Documents whose words meet their vectors in one task's group.
BLOCK_DOCS = 1024


def _weighted_sums(dim: int):
    """Sums of a block: ``(key, vec, n)``, the sum of the vectors of each document's known words,
    and how many occurrences they are."""
    def sums(docs, vectors):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        flat = lambda table, name: pa.chunked_array([x.flatten() for x in table[name].chunks], table.schema.field(name).type.value_type)
        known = pc.unique(vectors["_id"])
        place = pc.fill_null(pc.index_in(vectors["_id"], value_set=known), 0).to_numpy()
        table = np.zeros((len(known), dim))  # an id with several rows counts with each of them
        if len(known):
            np.add.at(table, place, flat(vectors, "_v").to_numpy().astype(np.float64).reshape(-1, dim))
        times = np.bincount(place, minlength=len(known)).astype(np.float64)
        col = pc.fill_null(pc.index_in(flat(docs, "_ids"), value_set=known), -1).to_numpy()
        row = np.repeat(np.arange(docs.num_rows), pc.list_value_length(docs["_ids"]).to_numpy())
        met = col >= 0
        row, col, c = row[met], col[met], flat(docs, "_cs").to_numpy()[met]
        n = np.bincount(row, c * times[col], docs.num_rows).astype(np.float64)  # of no rows, bincount counts in integers
        out, step = np.zeros((docs.num_rows, dim)), 1 << 14
        for a in range(0, len(row), step):
            own = row[a:a + step]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[first]] += np.add.reduceat(c[a:a + step, None] * table[col[a:a + step]], first, axis=0)
        some = np.flatnonzero(n)
        keys = docs["_key"].take(pa.array(some)).combine_chunks()
        keys = pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(out[some].ravel()))
        return pa.Table.from_arrays([keys, rows, pa.array(n[some])], names=["_key", "_v", "_n"])
    return sums


def mean_pool_vectors(docs: DataFrame, vectors: DataFrame, key: str = "doc_id", text: str = "text",
                      word_id=None, vec_key: str = "vec_id", vec_col: str = "embedding", dim: int | None = None,
                      tokens=TX.whitespace_split) -> DataFrame:
    """``(key, vec ARRAY<DOUBLE>)``: mean of the vectors of a document's known words (each
    occurrence counts, other words drop out); zeros for a document without a known word.

    ``tokens`` makes words of a text; by default whitespace-separated pieces, case and
    punctuation kept. Words are counted inside the row, and documents dealt in blocks of
    ``BLOCK_DOCS``: a vector is joined once to each block that needs it, not to each document, and
    a block's sums are made where its documents and vectors meet. What is shuffled is the counts, a
    vector a block and word, and a vector a document; neither table is broadcast."""
    wid = word_id if word_id is not None else (lambda c: c)
    size = (vectors.where(F.col(vec_col).isNotNull()).select(F.size(vec_col).alias("d")).first() or {"d": 0})["d"]
    zeros = F.array_repeat(F.lit(0.0), size if dim is None else dim)
    if not size:
        return docs.select(key, zeros.alias("vec"))
    counted = TX.with_counts(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")), tokens("_text"))
    counted = saved_table(counted.select(
        "_key", F.transform("counts", lambda t: wid(t["word"])).alias("_ids"), F.transform("counts", lambda t: t["c"].cast("double")).alias("_cs"),
        F.floor(F.monotonically_increasing_id() / BLOCK_DOCS).alias("_block")), "counted")
    ids = counted.select(F.col("_block").alias("_near"), TX.explode_rows(F.col("_ids")).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    vec = vectors.where(F.col(vec_col).isNotNull()).select(F.col(vec_key).alias("_id"), F.col(vec_col).alias("_v"))
    kind = docs.schema[key].dataType.simpleString()
    sums = counted.groupBy("_block").cogroup(ids.join(vec, "_id").groupBy("_near")).applyInArrow(
        _weighted_sums(size), f"_key {kind}, _v array<double>, _n double")
    whole = sums.groupBy("_key").agg(F.sum("_n").alias("_n"), *[F.sum(F.col("_v")[i]).alias(f"_{i}") for i in range(size)])
    pooled = whole.select(F.col("_key").alias(key), F.array(*[F.col(f"_{i}") / F.col("_n") for i in range(size)]).alias("_m"))
    return docs.select(key).join(pooled, key, "left").select(key, F.coalesce(F.col("_m"), zeros).alias("vec"))


def mean_pool(docs: DataFrame, vectors: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """Mean-pooled document vectors as ``(key, dim, value)`` rows (see ``mean_pool_vectors``)."""
    v = mean_pool_vectors(docs, vectors, key, **how)
    return v.select(key, F.posexplode("vec").alias("dim", "value")).select(
        key, "dim", F.round(F.col("value"), DIGITS).alias("value"))
