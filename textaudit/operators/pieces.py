"""Subword pieces of words by longest match over a given vocabulary.

The longest piece that begins a word is taken, then the longest that continues it (written
``##piece``), and so on, over a trie of the vocabulary; a character that no piece covers is a piece
by itself, so the pieces of a word always join to it. Vocabularies are read, never learned."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX

#: Words that a worker remembers with their pieces, and the length up to which it does.
REMEMBERED, SHORT = 1 << 17, 64
_END = ""


class Trie:
    """Longest-match segmentation; ``first`` may begin a word, ``inner`` may continue one."""

    def __init__(self, first: Iterable[str], inner: Iterable[str]):
        self.roots = [self._grown(first), self._grown(inner)]
        self.known: dict[str, list[str]] = {}

    @staticmethod
    def _grown(pieces: Iterable[str]) -> dict:
        root: dict = {}
        for piece in pieces:
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            if piece:
                node[_END] = True
        return root

    def _longest(self, word: str, at: int) -> int:
        node, best, i = self.roots[at > 0], at + 1, at
        while i < len(word) and (node := node.get(word[i])) is not None:
            i += 1
            if _END in node:
                best = i
        return best

    def pieces(self, word: str) -> list[str]:
        out = self.known.get(word)
        if out is None:
            out, at = [], 0
            while at < len(word):
                end = self._longest(word, at)
                out.append(("##" if at else "") + word[at:end])
                at = end
            if len(word) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = out
        return out


def byte_level_vocabulary(path: str, suffix: str = "</w>") -> tuple[list[str], list[str]]:
    """Pieces of a byte-level vocabulary file (``tokenizers`` format) that are whole UTF-8: those
    that may begin a word and those that may continue one (both alike, as the file tells only the
    end of a word apart)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    byte = {chr(b if b in plain else next(others)): b for b in range(256)}
    with open(path, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    pieces = set()
    for p in vocab:
        try:
            pieces.add(bytes(byte[c] for c in p.removesuffix(suffix)).decode())
        except UnicodeDecodeError:
            continue
    kept = sorted(p for p in pieces if p)
    return kept, kept


def segmented(docs: DataFrame, vocabulary: Callable[[], tuple[Iterable[str], Iterable[str]]], key: str = "doc_id", text: str = "text",
              out: str = "pieces") -> DataFrame:
    """``(key, out)``: the pieces of the lower-cased words of each text, in order (null: none).
    ``vocabulary()`` is called once a task; what it reads must be on every executor. A bounded number
    of words is cut and sent on at a time, each distinct one once."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        trie = Trie(*vocabulary())
        for batch in TX.item_slices(batches, 1):
            words = batch.column(1).flatten().dictionary_encode()
            each = pa.array([trie.pieces(w) for w in words.dictionary.to_pylist()], pa.list_(pa.string())).take(words.indices)
            rows = np.r_[0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))]
            ends = np.r_[0, np.cumsum(pc.list_value_length(each).to_numpy(zero_copy_only=False))][rows].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), each.flatten())], names=["k", "p"])
            del batch

    own = docs.select(F.col(key).alias("k"), TX.word_tokens(text).alias("t"))
    return own.mapInArrow(run, f"k {kind}, p array<string>").select(F.col("k").alias(key), F.col("p").alias(out))


def word_sizes(pieces: Column) -> Column:
    """For each piece of an array, the characters of the word that it belongs to. Inside the row and
    linear in the pieces, without a worker of its own."""
    goes_on = lambda i: F.startswith(F.coalesce(pieces[i], F.lit("")), F.lit("##"))
    starts = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda i: (i == 0) | ~goes_on(i))

    def word(a, b):
        marked = b - a - F.when((a == 0) & ~goes_on(a) | (a > 0), 1).otherwise(0)
        return F.array_repeat(F.aggregate(F.sequence(a, b - 1), -2 * marked, lambda n, i: n + F.coalesce(F.length(pieces[i]), F.lit(0))), b - a)

    # an array of one, so that its element is computed once
    sizes = F.transform(F.array(starts), lambda s: F.flatten(F.zip_with(s, F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(pieces))), word)))[0]
    return F.when(F.size(pieces) > 0, sizes).when(pieces.isNotNull(), F.array().cast("array<int>"))
