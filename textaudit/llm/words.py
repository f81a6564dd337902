"""Words of many texts at once as numpy arrays over their UTF-8 bytes.

A word class is a table of 256 flags; both classes used here are unions of ASCII ranges and
all of non-ASCII, so bytes decide. Word identity is a 64-bit multilinear hash (independent
random weights by position; two different words agree with probability below 2**-55)."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Words `[^\x20\x09-\x0D]+`.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

_BLOCK = 4096


@cache
def _weights(blocks: int, seed: int) -> np.ndarray:
    made = [np.random.Generator(np.random.PCG64([seed, i])).integers(0, 1 << 64, _BLOCK, dtype=np.uint64) for i in range(blocks)]
    return np.concatenate(made) | np.uint64(1)


def weights(n: int, seed: int) -> np.ndarray:
    """At least ``n`` fixed random odd weights; a longer table begins with the shorter one."""
    blocks = 1
    while blocks * _BLOCK < n:
        blocks *= 2
    return _weights(blocks, seed)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser, so that all bits of a hash depend on all its input bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def run_bounds(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of ``mask`` that do not cross the given text offsets."""
    n = len(mask)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 7) -> np.ndarray:
    """Hash of each byte span ``data[start:end]`` (none empty)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    first = np.cumsum(size) - size
    at = np.arange(int(first[-1] + size[-1])) - np.repeat(first, size)
    w = weights(int(size.max()) + 1, seed)
    terms = w[at + 1]
    terms *= data[at + np.repeat(start, size)].astype(np.uint64) + np.uint64(1)
    return mixed(np.add.reduceat(terms, first) + size.astype(np.uint64) * w[0])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ``starts[i] .. starts[i] + sizes[i]``."""
    first = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)


class Words:
    """Words of a slice of texts: byte bounds ``start``/``end``, the row ``doc`` of each word
    and ``first``, the index of each row's first word (with the total at the end)."""

    def __init__(self, column: pa.Array, table: np.ndarray, lower: bool):
        raw, self.offsets = utf8(column)
        self.data = LOWER[raw] if lower else raw
        self.start, self.end = run_bounds(table[self.data], self.offsets)
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.start, self.end)


def code_points(data: np.ndarray) -> np.ndarray:
    """``out[i]``: code points that begin before byte ``i`` (length: bytes + 1)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
