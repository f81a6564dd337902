"""Text column expressions.

Word identity follows Unicode rules: a word character is a letter, a digit or ``_``
(``[\\p{L}\\p{N}_]``), so accented words tokenise the same on the JVM as in Unicode-aware
regex engines. Whitespace is ``[\\s\\p{Z}]`` (ASCII controls plus Unicode separators).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_CLASS = r"[\p{L}\p{N}_]"
NON_WORD_CLASS = r"[^\p{L}\p{N}_]"
SPACE_CLASS = r"[\s\p{Z}]"
WORD_RE = WORD_CLASS + "+"
WORD2_RE = WORD_CLASS + "{2,}"
# word runs | whitespace runs | single other characters: concatenating the tokens gives the text
LOSSLESS_RE = r"[\p{L}\p{N}_]+|[\s\p{Z}]+|[^\p{L}\p{N}_\s\p{Z}]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text, lower: bool = True, min_len: int = 1) -> Column:
    """Array of maximal word runs (optionally lower-cased, optionally at least ``min_len``)."""
    t = col_(text)
    if lower:
        t = F.lower(t)
    pattern = WORD_RE if min_len <= 1 else WORD_CLASS + "{%d,}" % min_len
    return F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(pattern), 0)


def lossless_tokens(text) -> Column:
    """Word, whitespace and punctuation tokens whose concatenation is the text."""
    return F.regexp_extract_all(F.coalesce(col_(text), F.lit("")), F.lit(LOSSLESS_RE), 0)


def is_word(tok: Column) -> Column:
    return tok.rlike("^" + WORD_RE + "$")


def strip_space(text) -> Column:
    """Trim Unicode whitespace at both ends (``trim`` only removes ASCII spaces)."""
    return F.regexp_replace(col_(text), "^" + SPACE_CLASS + "+|" + SPACE_CLASS + "+$", "")


def collapse_space(text) -> Column:
    return strip_space(F.regexp_replace(col_(text), SPACE_CLASS + "+", " "))


def whitespace_split(text) -> Column:
    """Split on whitespace runs, ignoring leading and trailing whitespace."""
    s = strip_space(text)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(
        F.split(s, SPACE_CLASS + "+"))


def strip_non_word(text) -> Column:
    return F.regexp_replace(col_(text), NON_WORD_CLASS, "")


def first_char(text) -> Column:
    return F.substring(col_(text), 1, 1)


def starts_upper(text) -> Column:
    c = first_char(text)
    return (c == F.upper(c)) & (c != F.lower(c))


def starts_lower(text) -> Column:
    c = first_char(text)
    return (c == F.lower(c)) & (c != F.upper(c))


def capitalize(text) -> Column:
    """First character upper-cased, the rest lower-cased."""
    t = col_(text)
    return F.concat(F.upper(first_char(t)), F.lower(F.substring(t, 2, 1 << 30)))


def upper_first(text) -> Column:
    """First character upper-cased, the rest untouched."""
    t = col_(text)
    return F.concat(F.upper(first_char(t)), F.substring(t, 2, 1 << 30))


def is_title_word(tok: Column) -> Column:
    """A single word in title case: first letter upper, following letters lower."""
    return (tok == F.initcap(F.lower(tok))) & (tok != F.lower(tok))


def is_upper_word(tok: Column) -> Column:
    return (tok == F.upper(tok)) & (tok != F.lower(tok))


def case_like(tok: Column, repl: Column) -> Column:
    """Carry the case pattern of ``tok`` over to ``repl``: Title, UPPER, else as given."""
    return (F.when(is_title_word(tok), F.initcap(repl))
            .when(is_upper_word(tok), F.upper(repl))
            .otherwise(repl))


def clean_sentence(text) -> Column:
    """Collapse whitespace, end with a sentence mark, upper-case a lower first letter."""
    s = collapse_space(text)
    s = F.when(s.rlike(r"[.!?]$"), s).otherwise(F.concat(s, F.lit(".")))
    return F.when(starts_lower(s), upper_first(s)).otherwise(s)


def literal_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def literal_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text_lower: Column, needles) -> Column:
    """Substring test (not a word test): 'nursery' contains 'nurse'."""
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(text_lower, F.lit(n))
    return cond


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def display_name(name) -> Column:
    """Trim, underscores to spaces, title case."""
    return F.initcap(F.translate(F.trim(col_(name)), "_", " "))


def sanitize_name(name) -> Column:
    """Spaces to underscores, lower case."""
    return F.lower(F.translate(col_(name), " ", "_"))


def fill_template(template: Column, fields: dict) -> Column:
    """Replace ``{name}`` holes with column values."""
    out = template
    for k, v in fields.items():
        out = F.replace(out, F.lit("{" + k + "}"), v)
    return out


def truncate_tokens(tokens: Column, max_len: int) -> Column:
    """Keep the first ``max_len`` tokens."""
    return F.slice(tokens, 1, max_len)


def explode_rows(arr: Column, pos: bool = False):
    """Explode an array computed from the row without the optimizer's inferred
    ``size(arr) > 0`` pre-filter, which would evaluate the whole array expression a second
    time below the generator. Empty arrays yield one NULL row; drop it with
    ``where(<element>.isNotNull())``."""
    return F.posexplode_outer(arr) if pos else F.explode_outer(arr)


#: Items of lists that a step of a batch function holds at once; a longer list is a step of its own.
SLICE_ITEMS = 1 << 16


def item_slices(batches, column: int, most: int = SLICE_ITEMS):
    """Zero-copy row slices of Arrow batches whose lists in ``column`` have about ``most`` items
    together; a batch is let go before the next is read."""
    import numpy as np
    import pyarrow.compute as pc
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch


def sliced_rows(df: DataFrame, keep, lists, made, out: str, kind: str) -> DataFrame:
    """``(keep..., out)``: ``made(*lists)`` of a row's list columns, as Arrow arrays of a bounded number
    of items at a time, sent on as such. The memory of a worker then depends on the batch that it is
    sent, not on what is made of it; the result of a column function is a whole batch."""
    own, n = df.select(*keep, *[c.alias(f"_list{i}") for i, c in enumerate(lists)]), len(keep)

    def run(batches):
        import pyarrow as pa
        for part in item_slices(batches, n):
            yield pa.RecordBatch.from_arrays([*part.columns[:n], made(*part.columns[n:])], names=[*keep, out])
            del part

    told = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:n]] + [f"`{out}` {kind}"])
    return own.mapInArrow(run, told)


def _counted(pairs: bool):
    """Batch function of :func:`with_counts`: words become numbers by a batch's dictionary, and the
    runs of the sorted ``(row, number)`` pairs are the counts."""
    def counts(lists):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        n = len(lists)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        words, codes = coded.dictionary, pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(n), sizes)
        row, codes = row[codes >= 0], codes[codes >= 0]
        if pairs and len(row):
            near, wide = row[1:] == row[:-1], len(words)
            both, own = np.unique((codes[:-1] * wide + codes[1:])[near], return_inverse=True)
            joined = pc.binary_join_element_wise(words.take(pa.array(both // wide)), words.take(pa.array(both % wide)), " ")
            words = pa.concat_arrays([words, joined.cast(words.type)])
            row, codes = np.r_[row, row[1:][near]], np.r_[codes, own + wide]
        order = pc.sort_indices(words).to_numpy(zero_copy_only=False).astype(np.int64)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        wide = max(len(order), 1)
        found, c = np.unique(row * wide + rank[codes], return_counts=True)
        starts = np.searchsorted(found, np.arange(n + 1) * wide).astype(np.int32)
        told = pa.StructArray.from_arrays([words.take(pa.array(order[found % wide])), pa.array(c.astype(np.int64))], names=["word", "c"])
        return pa.ListArray.from_arrays(pa.array(starts), told, mask=lists.is_null())
    return counts


_COUNTS = "array<struct<word: string, c: bigint>>"


def counted_rows(df: DataFrame, keep, tokens: Column, out: str = "counts", pairs: bool = False) -> DataFrame:
    """``(keep..., out)``, ``out`` as by :func:`with_counts`, a bounded number of tokens at a time."""
    return sliced_rows(df, keep, [tokens], _counted(pairs), out, _COUNTS)


def with_counts(df: DataFrame, tokens: Column, out: str = "counts", pairs: bool = False) -> DataFrame:
    """Adds ``out``: ``array<struct<word, c>>``, the distinct tokens of the row, sorted, with
    their counts; ``pairs`` counts neighbours joined by a space too. Computed inside the row (in
    Arrow batches), so counting the words of documents shuffles nothing."""
    return df.withColumn(out, F.arrow_udf(_counted(pairs), _COUNTS)(tokens))
