"""Word attributions of any text scorer by Shapley sampling.

The players are a text's distinct words (lower-cased); a variant of the text keeps the occurrences
of some of them and everything between words. A word's value is its mean effect on the score when
it joins the words in front of it, over all orders. Up to ``exact`` words, all subsets are scored
and the value is exact. Beyond, orders are drawn in antithetic pairs (an order and its reverse)
until the standard error of every word's mean is at most ``tolerance``, however many that takes.
For a score that adds up over words, the two orders of the first pair agree, and it ends there.

A scorer that depends on sums over a text alone (:class:`SumScorer`) needs no drawing: its values
over all orders are an integral over the sums that variants can have, which is computed exactly.

Variants are made and scored inside the task that holds the text, in batches, through the scorer
extension point; nothing is shuffled. An order depends on the seed and the key alone."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import compress
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as TX
from .metrics import DIGITS

EXACT_WORDS, TOLERANCE, BATCH, SEED = 8, 1e-3, 32, "shapley-1"
#: Numbers that a table of :func:`summed_values` may have; orders are drawn for larger texts.
LARGEST_TABLE = 1 << 21


@cache
def _tokens():
    import regex
    return regex.compile(TX.LOSSLESS_RE), regex.compile(TX.WORD_RE)


class Players:
    """A text as loss-free tokens, with the player of each (-1: not a word)."""

    def __init__(self, text: str):
        lossless, word = _tokens()
        self.tokens = lossless.findall(text)
        found: dict[str, int] = {}
        self.of = [found.setdefault(t.lower(), len(found)) if word.fullmatch(t) else -1 for t in self.tokens]
        self.words = list(found)
        self.places: list[list[int]] = [[] for _ in found]
        for i, p in enumerate(self.of):
            if p >= 0:
                self.places[p].append(i)

    def variant(self, kept) -> str:
        """The text with the words of which ``kept`` (by player) is true."""
        return "".join(compress(self.tokens, [p < 0 or kept[p] for p in self.of]))

    def growing(self, order) -> Iterator[str]:
        """The text without words, then with those of ``order`` added one by one."""
        mask = bytearray(p < 0 for p in self.of)
        yield "".join(compress(self.tokens, mask))
        for i in order:
            for at in self.places[i]:
                mask[at] = 1
            yield "".join(compress(self.tokens, mask))


def scored(texts: Iterator[str], score: Callable, batch: int) -> np.ndarray:
    """Scores of ``texts``, of which only ``batch`` are held at once."""
    out, held = [], []
    for text in texts:
        held.append(text)
        if len(held) == batch:
            out.extend(score(held))
            held = []
    if held:
        out.extend(score(held))
    return np.array(out, np.float64)


def exact_values(p: Players, score: Callable, batch: int) -> tuple[np.ndarray, int]:
    """Shapley values over all ``2 ** m`` subsets."""
    m = len(p.words)
    subsets = np.arange(1 << m)
    bits = (subsets[:, None] >> np.arange(m)) & 1
    value = scored((p.variant(b) for b in bits), score, batch)
    size = bits.sum(1)
    out = np.zeros(m)
    for i in range(m):
        without = subsets[bits[:, i] == 0]
        weight = np.array([1 / (m * comb(m - 1, s)) for s in size[without]])
        out[i] = weight @ (value[without | (1 << i)] - value[without])
    return out, len(subsets)


def sampled_values(p: Players, score: Callable, batch: int, rng, most_pairs: int | None, tolerance: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Means and standard errors over antithetic orders, and the texts scored."""
    m, n, asked = len(p.words), 0, 0
    total, square, first = np.zeros(m), np.zeros(m), None

    def walk(order) -> np.ndarray:
        gains = np.empty(m)
        gains[order] = np.diff(scored(p.growing(order.tolist()), score, batch))
        return gains

    while True:
        order = rng.permutation(m)
        for own in (order, order[::-1]):
            gains = walk(own)
            first = gains if first is None else first
            total, square = total + (gains - first), square + (gains - first) ** 2
        n, asked = n + 2, asked + 2 * (m + 1)
        error = np.sqrt(np.maximum(square - total * total / n, 0) / (n - 1) / n)
        worst = error.max()
        # scores that are no numbers have no error to wait for
        if worst <= tolerance or not np.isfinite(worst) or most_pairs is not None and n >= 2 * most_pairs:
            return first + total / n, error, asked


class SumScorer:
    """A scorer of texts that depends on sums over the text alone. ``features(texts)`` are the sums of
    texts, a row a sum; those of a variant must be those of the text without words and of the words
    that it keeps. ``value(sums)`` are the scores, for arrays of any shape."""

    def features(self, texts: list[str]) -> np.ndarray:
        raise NotImplementedError

    def value(self, sums: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def __call__(self, texts: list[str]) -> list[float]:
        return self.value(self.features(texts)).tolist()


@cache
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights on [0, 1] that integrate polynomials up to degree ``2 n - 1`` exactly."""
    x, w = np.polynomial.legendre.leggauss(n)
    return (x + 1) / 2, w / 2


def _power(x: np.ndarray, k: int) -> np.ndarray:
    out = np.ones_like(x)
    while k:
        out, x, k = out * x if k & 1 else out, x * x, k >> 1
    return out


def _chances(x: np.ndarray, steps: np.ndarray, times: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Chances of the sums ``0 ... size - 1`` when each of ``times`` words of each of ``steps`` is kept
    with chance ``x``: of all words, and without one word of each step."""
    turn = np.exp(-2j * np.pi / size * (np.outer(steps, np.arange(size // 2 + 1)) % size))
    back = lambda f: np.fft.irfft(f, size, axis=1)
    one = [1 - x[:, None] + x[:, None] * t for t in turn]
    less = [_power(o, k - 1) for o, k in zip(one, times.tolist())]
    full = [o * f for o, f in zip(one, less)]
    whole = np.ones((len(x), size // 2 + 1), complex)
    before = [whole := whole * f for f in full]
    rest, without = np.ones_like(whole), []
    for i in reversed(range(len(full))):
        without.append(back((before[i - 1] if i else 1.0) * less[i] * rest))
        rest = rest * full[i]
    return back(whole), without[::-1]


def summed_values(p: Players, score: SumScorer) -> tuple[np.ndarray, int] | None:
    """Shapley values over all orders, and the sums scored. Nothing if the words' sums are not counts,
    each word's in one of the sums alone, or are too many for a table.

    A word that joins at a moment ``x`` of an order finds each other word with chance ``x``, all
    independent: its value is the integral over ``x`` of its expected effect on the score, a polynomial
    of a degree below the number of words, and so the finite sum of its values at a few nodes. At a
    node, the chances of every sum come from those of the words (by a Fourier transform)."""
    each = np.asarray(score.features(p.words), np.float64) * [len(x) for x in p.places]
    none = np.asarray(score.features([p.variant([False] * len(p.words))]), np.float64)
    steps = each.astype(np.int64)
    if not (np.isfinite(each).all() and np.isfinite(none).all() and (steps == each).all() and (steps >= 0).all() and ((steps > 0).sum(axis=0) <= 1).all()):
        return None
    out, nodes = np.zeros(each.shape[1]), max(1, (int((steps > 0).sum()) + 1) // 2)
    shape = steps.sum(axis=1) + 1
    if np.prod(shape, dtype=np.float64) > LARGEST_TABLE or nodes * float(shape.max()) > LARGEST_TABLE:
        return None
    x, weight = _nodes(nodes)
    table = score.value(np.indices(shape) + none.reshape(-1, *[1] * len(shape)))
    kinds = [np.unique(own[own > 0], return_counts=True) for own in steps]
    chances = [_chances(x, *kind, size) for kind, size in zip(kinds, shape.tolist())]
    for axis, (sizes, _) in enumerate(kinds):
        # expected scores by this sum, at each node
        others = np.moveaxis(table, axis, -1)[None]
        for whole, _ in (chances[i] for i in range(len(kinds)) if i != axis):
            others = (others * whole.reshape(*whole.shape, *[1] * (others.ndim - 2))).sum(axis=1) if len(others) > 1 else np.tensordot(whole, others[0], 1)
        others = np.broadcast_to(others, (len(x), shape[axis]))
        for size, without in zip(sizes.tolist(), chances[axis][1]):
            gains = others[:, size:] - others[:, :-size]
            out[steps[axis] == size] = weight @ (without[:, :-size] * gains).sum(axis=1)
    return out, table.size


def shapley_attribution(df: DataFrame, load: Callable[[], Callable], key: str = "doc_id", text: str = "text", k: int = L.ATTRIBUTION_TOP_K,
                        exact: int = EXACT_WORDS, most_pairs: int | None = None, tolerance: float = TOLERANCE, batch: int = BATCH,
                        seed: str = SEED) -> DataFrame:
    """``(key, rank, word, score, error, evaluations)``: the ``k`` words of largest absolute value of
    each text (ties by word). ``load()`` runs once a task and gives ``score(list of texts) -> numbers``.
    ``error`` is the standard error (0 where exact), ``evaluations`` the texts (or sums) scored for the
    row. All errors are at most ``tolerance``, unless a caller limits the pairs by ``most_pairs``. Texts without a word give no rows; a null text is empty."""
    if most_pairs is None and not tolerance > 0:
        raise ValueError("a tolerance of 0 is never reached: set most_pairs")
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        import pandas as pd
        score = load()
        for pdf in batches:
            rows = []
            for name, told in zip(pdf["key"], pdf["text"]):
                p = Players(told)
                if not p.words:
                    continue
                if isinstance(score, SumScorer) and (known := summed_values(p, score)):
                    (value, asked), error = known, np.zeros(len(p.words))
                elif len(p.words) <= exact:
                    (value, asked), error = exact_values(p, score, batch), np.zeros(len(p.words))
                else:
                    rng = np.random.default_rng(int(hashlib.md5(f"{seed}:{name}".encode()).hexdigest(), 16))
                    value, error, asked = sampled_values(p, score, batch, rng, most_pairs, tolerance)
                value = np.round(value, DIGITS) + 0.0
                best = sorted(range(len(value)), key=lambda i: (-abs(value[i]), p.words[i]))[:k]
                rows += [(name, r + 1, p.words[i], float(value[i]), float(error[i]), asked) for r, i in enumerate(best)]
            yield pd.DataFrame(rows, columns=["key", "rank", "word", "score", "error", "evaluations"])

    own = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = own.mapInPandas(run, f"key {kind}, rank int, word string, score double, error double, evaluations long")
    return out.withColumnRenamed("key", key)
