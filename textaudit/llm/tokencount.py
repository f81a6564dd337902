"""Token counts by byte-pair merging over a heap and a linked list.

A word begins as one symbol a byte. All adjacent pairs with a rank stand in a heap by rank, then
place; the lowest is popped again and again: its two symbols become one, the list of neighbours is
relinked, and the two pairs that the new symbol forms are pushed. A popped pair one of whose
symbols has since been merged is passed over. Every merge removes one symbol, so a word's count is
its bytes less its merges; no identifier is looked up. The work is n log n in the word's bytes.

Which bytes a word has, and what a word is, is read from the vocabulary file (the format of the
``tokenizers`` library): its normaliser and its splitter cut words, its added tokens are cut out
first and count one each, its merge list gives the ranks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_text

#: Counts of words that a worker remembers (they are forgotten together when there are more), and
#: the length up to which a word is remembered.
REMEMBERED, SHORT = 1 << 19, 256
LIMIT = 2048


class Merger:
    """Ranks of symbol pairs. Symbols are numbers: the distinct strings of the merge list."""

    def __init__(self, merges: list[tuple[str, str]], suffix: str = ""):
        number: dict[str, int] = {}
        numbered = [tuple(number.setdefault(x, len(number)) for x in (a, b, a + b)) for a, b in merges]
        self.wide = len(number) + 1
        #: left symbol * wide + right symbol -> rank, and the symbol that a rank makes
        self.ranks = {a * self.wide + b: rank for rank, (a, b, _) in enumerate(numbered)}
        self.made = [m for _, _, m in numbered]
        # a character that no merge names is a symbol that merges with nothing
        self.inner = {x: i for x, i in number.items() if len(x) == 1}
        self.last = {x[0]: i for x, i in number.items() if x[1:] == suffix and x}

    def count(self, word: str) -> int:
        """Symbols of ``word`` (one a character at first) when no pair of them has a rank any more."""
        n, wide, ranks, none = len(word), self.wide, self.ranks, self.wide - 1
        if n < 2:
            return n
        symbols = [self.inner.get(c, none) for c in word]
        symbols[-1] = self.last.get(word[-1], none)
        # the rank of the pair that begins at each place (-1: none), and its neighbours
        here = [ranks.get(a * wide + b, -1) for a, b in zip(symbols, symbols[1:])]
        here.append(-1)
        heap = [r * n + i for i, r in enumerate(here) if r >= 0]
        heapify(heap)
        left, right, total = list(range(-1, n - 1)), list(range(1, n + 1)), n
        while heap:
            rank, i = divmod(heappop(heap), n)
            if here[i] != rank:
                continue  # one of the two has been merged since
            j = right[i]
            symbols[i] = made = self.made[rank]
            here[j] = here[i] = -1
            right[i] = k = right[j]
            total -= 1
            if k < n:
                left[k] = i
                if (r := ranks.get(made * wide + symbols[k], -1)) >= 0:
                    here[i] = r
                    heappush(heap, r * n + i)
            if (h := left[i]) >= 0:
                here[h] = r = ranks.get(symbols[h] * wide + made, -1)
                if r >= 0:
                    heappush(heap, r * n + h)
        return total


class Counting:
    """Counts of texts under one vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError(f"{path}: only plain byte-pair merges are counted")
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = Merger(pairs, model.get("end_of_word_suffix") or "")
        added = sorted((t["content"] for t in told["added_tokens"]), key=len, reverse=True)
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in told["added_tokens"]):
            raise ValueError(f"{path}: added tokens must stand as written")
        if any(c.isspace() for a in added for c in a):
            raise ValueError(f"{path}: added tokens must have no white space")
        self.cut = re.compile("|".join(map(re.escape, added)) if added else r"(?!)")
        whole = Tokenizer.from_file(path)
        self.normal, self.split = whole.normalizer, whole.pre_tokenizer
        #: Tokens of chunks (stretches without ASCII white space) and of words.
        self.chunks: dict[bytes, int] = {}
        self.words: dict[str, int] = {}

    def _cut(self, text: str) -> tuple[str, list[tuple[str, tuple[int, int]]]]:
        text = self.normal.normalize_str(text) if self.normal is not None else text
        return text, self.split.pre_tokenize_str(text)

    def _word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.merger.count(word)
            if len(word) <= SHORT:
                self.words[word] = n
        return n

    def chunk(self, text: str) -> int:
        """Tokens of any text: the leftmost added tokens (the longest of those that begin
        together) count one each, what is between them by merging."""
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self._word(w) for p in parts if p for w, _ in self._cut(p)[1])

    def _learn(self, chunks: list[bytes]) -> None:
        """Put the tokens of ``chunks`` in ``self.chunks``. Most chunks are plain; they are cut in
        words together, as words never go beyond white space."""
        plain, told = [], self.chunks
        for raw in chunks:
            text = raw.decode()
            if len(text.split()) == 1 and not self.cut.search(text):
                plain.append((raw, text))
            else:
                told[raw] = self.chunk(text)
        whole, words = self._cut(" ".join(t for _, t in plain)) if plain else ("", [])
        if whole.count(" ") != len(plain) - 1:  # a normaliser that makes or drops spaces
            told.update((raw, self.chunk(text)) for raw, text in plain)
            return
        at, sums = 0, [0] * len(plain)
        ends = [m.start() for m in re.finditer(" ", whole)] + [len(whole)]
        for word, (_, end) in words:
            while end > ends[at]:
                at += 1
            sums[at] += self._word(word)
        told.update(zip((raw for raw, _ in plain), sums))

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a chunk that comes again is not cut again."""
        cut = [t.encode().split() for t in texts]
        new = {raw for chunks in cut for raw in chunks if raw not in self.chunks}
        self._learn(sorted(new))
        out = [sum(map(self.chunks.__getitem__, chunks)) for chunks in cut]
        for raw in new:
            if len(raw) > SHORT:
                del self.chunks[raw]
        for held in (self.chunks, self.words):
            if len(held) > REMEMBERED:
                held.clear()
        return out


@cache
def _counting(path: str) -> Counting:
    return Counting(path)


def _mapper(path: str) -> Callable:
    def start():
        counting = _counting(path)

        def make(column: pa.Array) -> list:
            sizes = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            return [sizes, counting.texts([x or "" for x in column.to_pylist()])]

        return make

    return start


def count_tokens(docs: DataFrame, keep: list[str], path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """The ``keep`` columns, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than
    ``limit`` tokens) of every row. ``path``: the vocabulary file, on every executor. A null or
    empty text has none; repeated rows are counted alike; a very long text or word is counted
    whole; result columns replace kept ones of the same name, case ignored; no rows, no counts."""
    own = [k for k in keep if k.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_text(docs, text, own, fields, _mapper(path)).withColumn("over_limit", F.col("n_tokens") > limit)
