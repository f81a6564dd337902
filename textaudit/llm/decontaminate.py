"""Benchmark decontamination with an FM-index per training shard.

Benchmark items become windows of ``width`` consecutive words (a shorter item is one window).
A shard is a slice of documents: its words become symbols of the benchmark's vocabulary, any
other word separates, and stretches shorter than the shortest window are left out, which can
hold no window. All windows are searched backward through the wavelet ranks of the shard's
index, their occurrences located by sampled suffix positions, and the spans merged.

The benchmark goes to the executors in blocks of at most ``block_words`` words (broadcast in
turn, a proven bound); every further block is one more row-wise pass that adds to the spans of
the pass before, so there is no shuffle and no join at any size of either side."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import replaced
from .fmindex import FMIndex
from .frames import map_text, pick
from .words import ALNUM, Words, code_points, ranges, span_hash

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WIDTH = 10
#: Words of one broadcast block of benchmark items (about 100 bytes each as windows).
BLOCK_WORDS = 400_000
#: Text bytes of a shard (a longer document is a shard of its own): its index takes a few times that.
SHARD_BYTES = 2 << 20
SPANS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("first", "last", "start", "end")]))


@dataclass
class Block:
    """Windows of some items: sorted hashes of their words (symbol = place + 1), the distinct
    windows as rows of symbols, and the items of each window (``items[first[w]:first[w+1]]``)."""

    vocabulary: np.ndarray
    patterns: np.ndarray
    sizes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str]


NOTHING = Block(np.zeros(0, np.uint64), np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64),
                np.zeros(0, np.int64), [])


def block(items: list[tuple[str, list[bytes]]], width: int) -> Block:
    words = sorted({w for _, ws in items for w in ws})
    joined, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    hashes = span_hash(joined, ends - sizes, ends)
    order = np.argsort(hashes)
    symbol = {words[k]: i + 1 for i, k in enumerate(order)}
    names = sorted({name for name, _ in items})
    place, windows = {n: i for i, n in enumerate(names)}, {}
    for name, ws in items:
        coded = [symbol[w] for w in ws]
        for i in range(max(1, len(coded) - width + 1)):
            windows.setdefault(tuple(coded[i:i + width]), set()).add(place[name])
    patterns = np.zeros((len(windows), width), np.int64)
    for row, w in enumerate(windows):
        patterns[row, :len(w)] = w
    counts = [len(s) for s in windows.values()]
    return Block(hashes[order], patterns, np.array([len(w) for w in windows], np.int64),
                 np.concatenate([[0], np.cumsum(counts)]).astype(np.int64),
                 np.array([i for s in windows.values() for i in sorted(s)], np.int64), names)


def blocks(benchmark: DataFrame, item: str, text: str, width: int, most: int) -> Iterator[Block]:
    """Items with words in blocks of at most ``most`` words (one longer item is a block)."""
    held, n = [], 0
    for row in pick(benchmark, item=item, text=text).where("item IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        words = WORD.findall(row["text"].encode().lower())
        if not words:
            continue
        if held and n + len(words) > most:
            yield block(held, width)
            held, n = [], 0
        held.append((str(row["item"]), words))
        n += len(words)
    if held:
        yield block(held, width)


def occurrences(words: Words, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word index and window number of every occurrence of a window in the slice."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words.start) or not len(b.sizes):
        return none
    hashes = words.hashes()
    at = np.minimum(np.searchsorted(b.vocabulary, hashes), len(b.vocabulary) - 1)
    symbol = np.where(b.vocabulary[at] == hashes, at + 1, 0)
    known = symbol > 0
    head = known & np.r_[True, ~known[:-1] | (words.doc[1:] != words.doc[:-1])]
    starts = np.flatnonzero(head)
    run = np.cumsum(head) - 1
    sizes = np.bincount(run[known], minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    keep = sizes >= b.sizes.min()
    starts, sizes = starts[keep], sizes[keep]
    if not len(starts):
        return none
    word = ranges(starts, sizes)  # the kept words; in the text a separator follows each stretch
    place = np.arange(len(word)) + np.repeat(np.arange(len(starts)), sizes)
    text = np.zeros(len(word) + len(starts), np.int64)
    text[place] = symbol[word]
    origin = np.full(len(text), -1, np.int64)
    origin[place] = word
    # Symbols that this shard holds, renumbered in order: fewer wavelet levels.
    held = np.unique(text)
    small = np.searchsorted(held, text)
    index = FMIndex(small, len(held))
    coded = np.minimum(np.searchsorted(held, b.patterns), len(held) - 1)
    there = np.flatnonzero(((held[coded] == b.patterns) | (b.patterns == 0)).all(axis=1))
    lo, hi = index.search(coded[there], b.sizes[there])
    found = index.locate(ranges(lo, hi - lo))
    return origin[found], np.repeat(there, hi - lo)


def _pass(b: Block):
    """Per slice: words, hit words, items, and spans of hit words."""

    def start():
        def make(column: pa.Array) -> list:
            words = Words(column, ALNUM, lower=True)
            at, window = occurrences(words, b)
            change = np.zeros(len(words.start) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + b.sizes[window], -1)
            hit = np.cumsum(change[:-1]) > 0
            n = len(words.counts)
            n_hit = np.bincount(words.doc[hit], minlength=n)
            edge = np.r_[True, ~hit[:-1] | (words.doc[1:] != words.doc[:-1])] if len(hit) else hit
            first = np.flatnonzero(hit & edge)
            last = np.flatnonzero(hit & np.r_[edge[1:] | ~hit[1:], True]) if len(hit) else first
            points = code_points(words.data)
            items: list[list[str]] = [[] for _ in range(n)]
            spans: list[list[dict]] = [[] for _ in range(n)]
            if len(at):
                size = np.diff(b.first)[window]
                pairs = np.unique(np.stack([np.repeat(words.doc[at], size), b.items[ranges(b.first[window], size)]], 1), axis=0)
                for d, i in pairs.tolist():
                    items[d].append(b.names[i])
                base = points[words.offsets]
                for i, j in zip(first.tolist(), last.tolist()):
                    d = int(words.doc[i])
                    spans[d].append({"first": i - int(words.first[d]), "last": j + 1 - int(words.first[d]),
                                     "start": int(points[words.start[i]] - base[d]), "end": int(points[words.end[j]] - base[d])})
            return [words.counts, n_hit, items, spans]

        return make

    return start


def _merged(spans: F.Column) -> F.Column:
    """Union of overlapping or touching spans of several passes."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    joined = lambda acc, x: F.struct(
        last(acc)["first"].alias("first"), F.greatest(last(acc)["last"], x["last"]).alias("last"),
        last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), lambda acc, x: F.when(
        (F.size(acc) > 0) & (last(acc)["last"] >= x["first"]),
        F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined(acc, x))),
    ).otherwise(F.concat(acc, F.array(x))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text",
                  item: str = "item_id", item_text: str = "text", width: int = WIDTH,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: its ``keep`` columns and

    - ``n_words``, ``n_hit``: words, and words inside an occurrence of a benchmark window;
    - ``items``: distinct ids (as strings, sorted) of items with an occurring window;
    - ``spans``: merged removal spans ``(first, last)`` in words and ``(start, end)`` in code
      points of the text, ends exclusive.

    Null texts have no words. Null or wordless benchmark texts and null item ids are no items;
    repeated item ids are one item with all windows. Repeated documents are judged row by row.
    Input columns named like a result are replaced."""
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
             T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)]
    results = [f.name for f in added]
    keep = [k for k in keep if k.lower() not in results]
    made = blocks(benchmark, item, item_text, width, block_words)
    b, frame, before = next(made, NOTHING), docs, []
    while b is not None:
        following = next(made, None)
        carry = keep if following is None else dict.fromkeys([*keep, text])
        frame = map_text(frame, text, [*carry, *before], added, _pass(b), SHARD_BYTES)
        if following is not None or before:
            i = len(before)
            frame = frame.withColumnsRenamed({"items": f"_items{i}", "spans": f"_spans{i}"})
            before += [f"_items{i}", f"_spans{i}"]
        b = following
    if before:
        frame = frame.withColumns({"items": F.array_sort(F.array_distinct(F.concat(*before[::2]))),
                                   "spans": _merged(F.concat(*before[1::2]))})
        frame = frame.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["last"] - s["first"]))
    return frame.select(*[F.col(f"`{k}`") for k in [*keep, *results]])


def without_spans(text: F.Column, spans: F.Column) -> F.Column:
    """``text`` with the code points of ``spans`` cut out."""
    return replaced(text, spans, lambda _: F.lit(""))
