"""FM-index over one shard's symbols, in numpy: suffix array by prefix doubling, Burrows-Wheeler
transform in a wavelet matrix with rank, backward search of many patterns at once, and locating
by walking to sampled suffix positions.

Symbols are small integers; 0 separates segments. Every separator sorts by its place in the
text, so no comparison runs past the end of a segment and a backward walk ends at the segment's
start, which is always sampled."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, bits: int) -> np.ndarray:
    """Order of all suffixes of ``text`` (symbols below ``2**bits``; the last one is 0)."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # symbols before the separator
    pack = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(pack):
        shifted = np.zeros(n, np.int64)
        shifted[:max(0, n - j)] = text[j:]
        shifted[left < j] = 0
        key = (key << bits) | shifted
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sizes = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    rank[order] = np.repeat(sizes, np.diff(np.r_[sizes, n]))
    h = pack
    todo = order[np.isin(rank[order], sizes[np.diff(np.r_[sizes, n]) > 1])]
    while len(todo):
        # suffixes that reached their separator within h symbols are told apart by its place
        ahead = np.where(left[todo] < h, todo, n + rank[np.minimum(todo + h, n - 1)])
        todo = todo[np.lexsort((ahead, rank[todo]))]
        ahead = np.where(left[todo] < h, todo, n + rank[np.minimum(todo + h, n - 1)])
        group = rank[todo]
        head = np.r_[True, group[1:] != group[:-1]]
        new = head | np.r_[True, ahead[1:] != ahead[:-1]]
        at = np.arange(len(todo))
        base = np.maximum.accumulate(np.where(head, at, 0))
        first = np.maximum.accumulate(np.where(new, at, 0))
        rank[todo] = group + first - base
        size = np.diff(np.r_[np.flatnonzero(new), len(todo)])
        todo = todo[np.repeat(size > 1, size)]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


class Bits:
    """Bit vector with constant-time rank over 64-bit words."""

    def __init__(self, flags: np.ndarray):
        pad = np.zeros((len(flags) // 64 + 1) * 64, bool)
        pad[:len(flags)] = flags
        self.words = np.packbits(pad, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.total = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position ``i``."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, rest = [], [], symbols
        for b in reversed(range(bits)):
            flags = (rest >> b) & 1 == 1
            self.levels.append((b, Bits(flags)))
            self.zeros.append(int(len(flags) - flags.sum()))
            rest = np.concatenate([rest[~flags], rest[flags]])

    def step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` lands when ``symbol`` is followed down all levels: ``rank`` of
        the symbol before ``i``, counted from the start of its block on the last level."""
        for (b, bits), zeros in zip(self.levels, self.zeros):
            ones = bits.rank(i)
            i = np.where((symbol >> b) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.step(symbol, i) - self.step(symbol, np.zeros_like(i))

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), np.int64)
        for (b, bits), zeros in zip(self.levels, self.zeros):
            one, ones = bits[i], bits.rank(i)
            symbol |= one.astype(np.int64) << b
            i = np.where(one, zeros + ones, i - ones)
        return symbol


class FMIndex:
    """Index of ``text`` (0 separates segments and ends the text); every ``sample``-th suffix
    position and every start of a segment is kept for locating."""

    def __init__(self, text: np.ndarray, sigma: int, sample: int = 8):
        bits = max(1, int(sigma - 1).bit_length())
        sa = suffix_array(text, bits)
        bwt = text[sa - 1]  # the text ends with 0, so the first suffix is preceded by 0
        self.n, self.sigma = len(text), sigma
        self.wavelet = WaveletMatrix(bwt, bits)
        self.c = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        kept = (sa % sample == 0) | (bwt == 0)
        self.marked = Bits(kept)
        self.positions = sa[kept]

    def search(self, patterns: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges ``[lo, hi)`` of all patterns (rows, 0-padded) by backward search."""
        lo, hi = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        live = np.arange(len(sizes))
        for j in range(patterns.shape[1]):
            live = live[(hi[live] > lo[live]) & (sizes[live] > j)]
            if not len(live):
                break
            symbol = patterns[live, sizes[live] - 1 - j]
            both = self.wavelet.rank(np.r_[symbol, symbol], np.r_[lo[live], hi[live]])
            lo[live] = self.c[symbol] + both[:len(live)]
            hi[live] = self.c[symbol] + both[len(live):]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out, walked = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows
        while len(left):
            done = self.marked[at]
            out[left[done]] = self.positions[self.marked.rank(at[done])] + walked
            left, at = left[~done], at[~done]
            symbol = self.wavelet.access(at)
            at = self.c[symbol] + self.wavelet.rank(symbol, at)
            walked += 1
        return out
