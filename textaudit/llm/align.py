"""Alignment of the tokens that two tokenizers give the same text.

The tokens of a text against its bytes are a 0/1 matrix, in compressed sparse rows built by hand.
With ``A`` and ``B`` of the two tokenizers, ``A @ B.T`` by Gustavson's row products has an entry
for each pair of tokens that share bytes (and how many): the overlap links. Byte offsets where
tokens of both end cut the text into groups; the products of the group-incidence matrices have an
entry for each pair whose tokens share a group: the shared-group links. Those are multiplied per
token id, with the number of its occurrences in the group, so that a group of many repeated tokens
costs its distinct ids, never its pairs of occurrences.

Both tokenizers end a token in front of a space that follows a solid character, and what they do
next does not depend on what came before. So a text is cut in chunks there, each distinct chunk is
aligned once, and a document's links are the product of two more sparse matrices: its chunks with
their numbers, and the chunks' links.

Corpus-wide, an id pair counts the documents that hold it linked. Each document's distinct pairs
are looked up by block: a block is some MB of consecutive texts, its distinct pairs are asked for
once, and the answers meet the block's documents again. So a frequent pair costs a row a block."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import pick, save, text_slices
from .words import ranges, utf8

#: Bytes of text in a block, about (a longer text is a block of its own), and in a slice that is
#: aligned at once.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
#: Bytes of chunks that a worker remembers (they are forgotten together when there are more).
REMEMBERED = 4 << 20
#: Entries that a product expands at once, about.
EXPANDED = 4 << 20


# --- compressed sparse rows -------------------------------------------------------------------
@dataclass
class Rows:
    """A sparse matrix: row ``i`` has ``data[k]`` in column ``index[k]`` for ``start[i] <= k < start[i + 1]``,
    columns ascending."""

    start: np.ndarray
    index: np.ndarray
    data: np.ndarray
    columns: int

    def __len__(self) -> int:
        return len(self.start) - 1

    def of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.start))

    def transposed(self) -> Rows:
        order = np.argsort(self.index, kind="stable")
        return Rows(_starts(np.bincount(self.index, minlength=self.columns)), self.of()[order], self.data[order], len(self))


def _starts(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def gathered(row: np.ndarray, column: np.ndarray, rows: int, columns: int, data: np.ndarray | None = None) -> Rows:
    """Rows of entries in any order; entries of the same place are added up."""
    data = np.ones(len(row), np.int64) if data is None else data
    key = row * columns + column
    if len(key) and (np.diff(key) < 0).any():
        order = np.argsort(key, kind="stable")
        key, data = key[order], data[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    key, data = key[first], np.add.reduceat(data, first) if len(first) else data
    return Rows(_starts(np.bincount(key // columns, minlength=rows) if columns else np.zeros(rows, np.int64)), key % max(columns, 1), data, columns)


def product(a: Rows, b: Rows) -> Iterator[tuple[int, Rows]]:
    """Row products of Gustavson: row ``i`` of ``a @ b`` adds up the rows ``k`` of ``b`` for the
    entries ``k`` of row ``i`` of ``a``. The result comes in strips ``(first row, rows)``, so that
    what is expanded at once stays bounded (but for one row, which is never cut)."""
    sizes = np.diff(b.start)[a.index]
    work = np.add.reduceat(np.append(sizes, 0), a.start[:-1]) if len(a) else np.zeros(0, np.int64)
    work[np.diff(a.start) == 0] = 0
    strip = (np.cumsum(work) - 1) // EXPANDED
    cuts = [0, *(np.flatnonzero(np.diff(strip)) + 1).tolist(), len(a)]
    for i, j in zip(cuts, cuts[1:]):
        own = slice(a.start[i], a.start[j])
        row = np.repeat(np.repeat(np.arange(j - i), np.diff(a.start[i:j + 1])), sizes[own])
        at = ranges(b.start[a.index[own]], sizes[own])
        yield i, gathered(row, b.index[at], j - i, b.columns, np.repeat(a.data[own], sizes[own]) * b.data[at])


# --- tokenizers -------------------------------------------------------------------------------
class Vocabulary:
    """A tokenizer file as ids of texts and bytes of ids. ``.json``: byte-level pairs of the
    ``tokenizers`` library; ``.model``: ``sentencepiece``, which puts a space in front itself."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            import json

            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            whole.no_padding()
            whole.no_truncation()
            self._encode = lambda texts: [e.ids for e in whole.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
            byte = {c: i for i, c in enumerate(_byte_letters())}
            with open(path, encoding="utf-8") as file:
                told = json.load(file)
            pieces = {i: bytes(byte[c] for c in p) for p, i in told["model"]["vocab"].items()}
            pieces |= {t["id"]: t["content"].encode() for t in told["added_tokens"] if t["id"] not in pieces}
            table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            raw = re.compile(r"<0x([0-9A-Fa-f]{2})>")
            named = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            table = [bytes([int(m[1], 16)]) if (m := raw.fullmatch(p)) else p.replace("▁", " ").encode() for p in named]
        self.crosses = any(re.search(r"\S ", b.decode(errors="replace")) for b in table if b" " in b)
        self.size = np.array([len(b) for b in table], np.int64)
        self.data = np.frombuffer(b"".join(table), np.uint8)
        self.start = np.cumsum(self.size) - self.size

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin (with the total at the end)."""
        made = self._encode(texts) if texts else []
        return np.fromiter(chain.from_iterable(made), np.int64), _starts(np.array([len(x) for x in made], np.int64))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The tokens' bytes, joined."""
        return self.data[ranges(self.start[ids], self.size[ids])]


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


@cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


# --- one slice of texts -----------------------------------------------------------------------
class Aligned:
    """Tokens of some texts by two vocabularies, on one axis of bytes: all texts joined, a space in
    front of each. Texts that are empty or that one of the two does not spell back have no tokens."""

    def __init__(self, texts: Sequence[str | None], a: Vocabulary, b: Vocabulary):
        self.n, self.a, self.b = len(texts), a, b
        used = np.array([i for i, t in enumerate(texts) if t], np.int64)
        plain = [texts[i] for i in used.tolist()]
        data, offsets = utf8(pa.array([" " + t for t in plain], pa.string()))
        sides = [(*v.encode(plain), v) for v in (a, b)]
        fine = np.ones(len(plain), bool)
        for ids, first, v in sides:
            ends = _starts(v.size[ids])[first]
            spelled = v.spelled(ids)
            same = np.diff(ends) == np.diff(offsets)
            ok = np.flatnonzero(same)
            mine, whole = (x[ranges(s[ok], np.diff(offsets)[ok])] for x, s in ((spelled, ends[:-1]), (data, offsets[:-1])))
            if len(ok):
                at = np.cumsum(np.diff(offsets)[ok]) - np.diff(offsets)[ok]
                same[ok] = ~np.logical_or.reduceat(mine != whole, at)
            fine &= same
        kept = np.flatnonzero(fine)
        self.rows = used[kept]
        self.ids, self.doc, self.ends = [], [], []
        for ids, first, v in sides:
            count = np.diff(first)[kept]
            ids = ids[ranges(first[kept], count)]
            self.ids.append(ids)
            self.doc.append(np.repeat(np.arange(len(kept)), count))
            self.ends.append(np.cumsum(v.size[ids]))
        self.bytes = int(np.diff(offsets)[kept].sum())
        # both sides end at a group's end; a text's end is one
        self.cuts = np.intersect1d(self.ends[0], self.ends[1], assume_unique=True)
        self.group = [np.searchsorted(self.cuts, e) for e in self.ends]
        self.group_doc = np.zeros(len(self.cuts), np.int64)
        self.group_doc[self.group[0]] = self.doc[0]

    def per_row(self, counts: np.ndarray) -> np.ndarray:
        """Counts of the texts that have tokens, as counts of all texts."""
        out = np.zeros(self.n, np.int64)
        out[self.rows] = counts
        return out

    def of_docs(self, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return self.per_row(np.bincount(doc, weights, len(self.rows)).astype(np.int64))

    def incidence(self, side: int) -> Rows:
        """Tokens against bytes."""
        size = np.diff(self.ends[side], prepend=0)
        return Rows(_starts(size), np.arange(self.bytes), np.ones(self.bytes, np.int64), self.bytes)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Overlap links: strips of ``(A token, B token, bytes shared)``."""
        for first, strip in product(self.incidence(0), self.incidence(1).transposed()):
            yield strip.of() + first, strip.index, strip.data

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Shared-group links: strips of ``(text, A id, B id, occurrence pairs)``, each text's
        distinct id pairs in order."""
        wide, groups = len(self.b.size), len(self.cuts)
        key = self.doc[0] * len(self.a.size) + self.ids[0]
        pairs, inverse = np.unique(key, return_inverse=True)
        left = gathered(inverse, self.group[0], len(pairs), groups)
        right = gathered(self.group[1], self.ids[1], groups, wide)
        for first, strip in product(left, right):
            own = pairs[strip.of() + first]
            yield own // len(self.a.size), own % len(self.a.size), strip.index, strip.data

    def token_links(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Shared-group links by occurrence: strips of ``(A token, B token)``."""
        sides = [Rows(np.arange(len(g) + 1), g, np.ones(len(g), np.int64), len(self.cuts)) for g in self.group]
        for first, strip in product(sides[0], sides[1].transposed()):
            yield strip.of() + first, strip.index

    def written(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text (empty without tokens)."""
        names, sizes, starts = _decimals(max(len(self.a.size), len(self.b.size)))
        group = np.concatenate([2 * self.group[0], 2 * self.group[1] + 1])
        order = np.argsort(group, kind="stable")
        ids, group = np.concatenate(self.ids)[order], group[order]
        doc = np.concatenate(self.doc)[order]
        size = sizes[ids] + 1
        at = np.cumsum(size) - size
        text = np.empty(int(size.sum()), np.uint8)
        text[ranges(at, size - 1)] = names[ranges(starts[ids], size - 1)]
        after = np.append(group[1:], -2) if len(group) else group
        text[at + size - 1] = np.where(after == group, ord(","), np.where(group % 2 == 0, ord("|"), ord(";")))
        out = [b""] * self.n
        first = np.searchsorted(doc, np.arange(len(self.rows) + 1))
        ends = np.append(at, len(text))[first]
        raw = text.tobytes()
        for row, i, j in zip(self.rows.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            out[row] = raw[i:j - 1]
        return out


@cache
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = [str(i).encode() for i in range(n)]
    sizes = np.array([len(x) for x in names], np.int64)
    return np.frombuffer(b"".join(names), np.uint8), sizes, np.cumsum(sizes) - sizes


# --- chunks -----------------------------------------------------------------------------------
def chunks(text: str) -> list[str]:
    """``text``, a space in front of it, cut before each space that follows a solid character and
    that something follows; each chunk without its first space. Joined by spaces they are ``text``."""
    out, held = [], None
    for part in text.split(" "):
        held = part if held is None else f"{held} {part}"
        if part and not part[-1].isspace():
            out.append(held)
            held = None
    if held is not None:  # the text ends in white space, or in a space alone
        out.append(held)
        if not held and len(out) > 1:
            out[-2:] = [out[-2] + " "]
    return out


class Grown:
    """An array that is appended to, with room to spare."""

    def __init__(self, kind):
        self.room, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.room):
            more = np.zeros(2 * (self.n + len(values)), self.room.dtype)
            more[:self.n] = self.room[:self.n]
            self.room = more
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)

    @property
    def all(self) -> np.ndarray:
        return self.room[:self.n]


class Chunks:
    """Distinct chunks with what their alignment gives; texts by their chunks."""

    COUNTS = ("n_a", "n_b", "n_groups", "n_overlaps")

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        # if a piece held a space after a solid character, chunks were not independent
        self.whole = any(v.crosses for v in (a, b))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.bytes, self.text = 0, []
        self.fine, self.size, self.pair, self.times = Grown(bool), Grown(np.int64), Grown(np.int64), Grown(np.int64)
        self.counts = [Grown(np.int64) for _ in self.COUNTS]

    def _learn(self, new: list[str]) -> None:
        """Align chunks that are not known yet."""
        one = Aligned(new, self.a, self.b)
        strips = [*one.links()]
        doc, left, right, times = (np.concatenate([s[i] for s in strips]) if strips else np.zeros(0, np.int64) for i in range(4))
        overlaps = sum((one.of_docs(one.doc[0][x]) for x, _, _ in one.overlaps()), np.zeros(one.n, np.int64))
        fine = np.zeros(one.n, bool)
        fine[one.rows] = True
        self.fine.add(fine)
        self.size.add(one.of_docs(doc))
        self.pair.add(left << 32 | right)
        self.times.add(times)
        for kept, made in zip(self.counts, (one.of_docs(one.doc[0]), one.of_docs(one.doc[1]), one.of_docs(one.group_doc), overlaps)):
            kept.add(made)
        self.text += one.written()
        known = len(self.place)
        self.place.update((c, known + i) for i, c in enumerate(new))
        self.bytes += sum(map(len, new))

    def aligned(self, texts: Sequence[str | None]) -> dict[str, object]:
        """Of each text its counts, the digest of its groups, and its distinct linked id pairs with
        how often each is linked (``first``, ``pairs``, ``times``)."""
        n, cut = len(texts), [([t] if self.whole else chunks(t)) if t else [] for t in texts]
        if self.bytes > REMEMBERED:
            self.forget()
        new, size = [], 0
        for c in dict.fromkeys(c for cs in cut for c in cs if c not in self.place):
            new.append(c)
            size += len(c)
            if size >= SLICE_BYTES:
                self._learn(new)
                new, size = [], 0
        if new:
            self._learn(new)
        doc = np.repeat(np.arange(n), [len(cs) for cs in cut])
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64, len(doc))
        bad = np.bincount(doc[~self.fine.all[at]], minlength=n) > 0
        own = ~bad[doc]
        doc, at = doc[own], at[own]
        out: dict[str, object] = {c: np.bincount(doc, kept.all[at], n).astype(np.int64) for c, kept in zip(self.COUNTS, self.counts)}
        text = self.text
        out["groups_sha256"] = [hashlib.sha256(b";".join([text[self.place[c]] for c in cs])).hexdigest() if cs and not b else "" for cs, b in zip(cut, bad)]
        known, local = np.unique(at, return_inverse=True)
        sizes, start = self.size.all, _starts(self.size.all)[:-1]
        where = ranges(start[known], sizes[known])
        pairs, column = np.unique(self.pair.all[where], return_inverse=True)
        by_chunk = Rows(_starts(sizes[known]), column, self.times.all[where], len(pairs))
        strips = [*product(gathered(doc, local, n, len(known)), by_chunk)] if len(doc) else []
        out["first"] = _starts(np.concatenate([np.diff(r.start) for _, r in strips]) if strips else np.zeros(n, np.int64))
        out["pairs"] = pairs[np.concatenate([r.index for _, r in strips])] if strips else np.zeros(0, np.int64)
        out["times"] = np.concatenate([r.data for _, r in strips]) if strips else np.zeros(0, np.int64)
        whole = np.append(out["times"], 0)
        linked = np.add.reduceat(whole, out["first"][:-1]) if n else whole[:0]
        linked[np.diff(out["first"]) == 0] = 0
        out["n_links"] = linked
        return out


@cache
def _chunks(path_a: str, path_b: str) -> Chunks:
    return Chunks(_vocabulary(path_a), _vocabulary(path_b))


# --- whole tables -----------------------------------------------------------------------------
_FOUND = ("block long, n_a long, n_b long, n_groups long, n_overlaps long, n_links long, groups_sha256 string, "
          "pairs array<long>, times array<long>")


def _lists(first: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(values, pa.int64()))


def aligned(docs: DataFrame, keep: list[str], path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns and, of each text: ``n_a``, ``n_b`` (tokens), ``n_groups``,
    ``n_overlaps`` (overlap links), ``n_links`` (shared-group links), ``groups_sha256``, and its
    distinct linked id pairs as ``pairs`` (``A id << 32 | B id``, ascending) with the ``times`` each
    is linked; ``block`` numbers stretches of consecutive rows."""
    from pyspark.sql import types as T

    taken = {*(c.split()[0] for c in _FOUND.split(", "))}
    keep = [k for k in keep if k.lower() not in taken]
    frame = pick(docs, **{f"k{i}": k for i, k in enumerate(keep)}, text=text)
    kept = frame.schema.fields[:len(keep)]
    schema = T.StructType([T.StructField(k, f.dataType) for k, f in zip(keep, kept)] + T._parse_datatype_string(_FOUND).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        known, target = _chunks(path_a, path_b), to_arrow_schema(schema)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in text_slices(batch, len(keep), SLICE_BYTES):
                column = part.column(len(keep))
                one = known.aligned(column.to_pylist())
                made = [np.full(part.num_rows, block), *(one[c] for c in ("n_a", "n_b", "n_groups", "n_overlaps", "n_links", "groups_sha256")),
                        _lists(one["first"], one["pairs"]), _lists(one["first"], one["times"])]
                arrays = [*(part.column(i) for i in range(len(keep))), *(pa.array(x) if not isinstance(x, pa.Array) else x for x in made)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, target)], schema=target)
                held += column.nbytes
                if held >= BLOCK_BYTES:
                    block, held = block + 1, 0

    return frame.mapInArrow(run, schema)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct pairs of each block, with the number of its documents that hold them."""
    def told(block: int, seen: list[np.ndarray]) -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(n)], names=["block", "pair", "n"])

    now, seen = None, []
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for i, j in zip(cuts, cuts[1:]):
            if j == i:
                continue
            if blocks[i] != now:
                if seen:
                    yield told(now, seen)
                now, seen = blocks[i], []
            seen.append(batch.column("pairs").slice(i, j - i).flatten().to_numpy())
    if seen:
        yield told(now, seen)


def pair_counts(asked: DataFrame) -> DataFrame:
    """``(a, pair, docs, best)``: how many documents hold a pair linked, and the highest such
    count of its A id."""
    counts = asked.groupBy("pair").agg(F.sum("n").alias("docs")).withColumn("a", F.expr("shiftright(pair, 32)"))
    return counts.join(counts.groupBy("a").agg(F.max("docs").alias("best")), "a")


def _answered(names: list[str]):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        pairs = answers.column("pair").to_numpy()
        order = np.argsort(pairs)
        pairs, n = pairs[order], answers.column("docs").to_numpy()[order]
        top = n == answers.column("best").to_numpy()[order]
        best, total = [], []
        for chunk in docs.select(["pairs", "times"]).to_batches(max_chunksize=1024):
            lists, times = (chunk.column(c) for c in ("pairs", "times"))
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            times, at = times.flatten().to_numpy(), np.searchsorted(pairs, lists.flatten().to_numpy())
            owner = np.repeat(np.arange(len(size)), size)
            for out, counted in ((best, times * top[at]), (total, times * n[at])):
                sums = np.zeros(len(size), np.int64)
                np.add.at(sums, owner, counted)
                out.append(sums)
        whole = docs.select(names)
        for name, parts in (("n_best", best), ("count_sum", total)):
            whole = whole.append_column(name, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))
        return whole

    return run


def align(docs: DataFrame, keep: list[str], path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``aligned`` without the pairs, and over all documents: ``n_best`` (links whose id pair is held
    linked by as many documents as any pair of its A id) and ``count_sum`` (documents that hold the
    id pair, summed over links). Texts that are null, empty or not spelled back by both tokenizers
    have no tokens, hence zeros; repeated rows are documents each; result columns replace kept ones
    of the same name, case ignored; no rows, no result."""
    from pyspark.sql import types as T

    found = save(aligned(docs, keep, path_a, path_b, text), "aligned")
    asked = save(found.select("block", "pairs").where("n_a > 0").mapInArrow(_asked, "block long, pair long, n long"), "aligned-pairs")
    answers = asked.select("block", "pair").join(pair_counts(asked).select("pair", "docs", "best"), "pair")
    names = [c for c in found.columns if c not in ("block", "pairs", "times")]
    own = [f"c{i}" for i in range(len(names))]  # kept names may hold any character
    plain = found.select("block", "pairs", "times", *[F.col(f"`{c}`").alias(o) for o, c in zip(own, names)])
    schema = T.StructType([T.StructField(o, found.schema[c].dataType) for o, c in zip(own, names)]
                          + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    done = plain.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered(own), schema)
    return done.select(*[F.col(o).alias(c) for o, c in zip(own, names)], "n_best", "count_sum")
