"""FM-index against brute force, and the decontamination operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textaudit.llm.decontaminate import decontaminate, without_spans
from textaudit.llm.fmindex import FMIndex, suffix_array

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz".split()


@pytest.mark.parametrize("seed", range(40))
def test_search_and_locate(seed):
    r = random.Random(seed)
    sigma, n = r.choice([2, 3, 5, 20]), r.randint(1, 120)
    text = np.array([r.randrange(0 if r.random() < 0.3 else 1, sigma) for _ in range(n)] + [0])
    index = FMIndex(text, sigma, r.choice([1, 3, 8]))
    found = [[r.randrange(1, sigma) for _ in range(r.randint(1, 5))] for _ in range(30)]
    rows = np.zeros((30, 6), np.int64)
    for i, p in enumerate(found):
        rows[i, :len(p)] = p
    lo, hi = index.search(rows, np.array([len(p) for p in found]))
    for p, a, b in zip(found, lo, hi):
        want = [i for i in range(len(text) - len(p) + 1) if text[i:i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_suffix_array_of_repeats():
    text = np.array(([1, 2, 1, 2] * 30 + [0]) * 3)
    ends = np.flatnonzero(text == 0)
    key = lambda i: [*text[i:ends[np.searchsorted(ends, i)]].tolist(), 0, ends[np.searchsorted(ends, i)]]
    assert suffix_array(text, 2).tolist() == sorted(range(len(text)), key=lambda i: (key(i), i))


def brute(docs, items, width=10):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w and i is not None else 0):
            windows.setdefault(tuple(w[k:k + width]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k:k + size]) in windows:
                    hit.update(range(k, k + size))
                    got |= windows[tuple(w[k:k + size])]
        out.append((d, len(w), len(hit), sorted(got)))
    return sorted(out, key=str)


@pytest.fixture()
def corpus():
    r = random.Random(3)
    say = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, say(r.choice([3, 8, 10, 14, 30]))) for i in range(12)] + [(3, say(12)), (90, None), (91, ""), (92, "... !"), (None, say(11)), (93, "Éa ß9 été")]
    docs = [(i, say(40) + ",\n" + (items[i % 12][1] or "").upper() + " ; " + say(r.randint(0, 60))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "ab"), (53, "x éA ß9 été y"), (53, "x éA ß9 été y"), (None, items[2][1]), (54, "qq " * 30_000 + items[4][1])]
    return docs, items


@pytest.mark.parametrize("block_words", [400_000, 40])
def test_decontaminate_matches_brute_force(table, corpus, block_words):
    docs, items = corpus
    d, b = table(docs, "doc_id long, text string"), table(items, "item_id long, text string")
    got = decontaminate(d, b, ["doc_id"], block_words=block_words).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in got], key=str) == brute(docs, items)
    assert all(sum(s["last"] - s["first"] for s in r["spans"]) == r["n_hit"] for r in got)


def test_spans_are_cut_and_clashing_columns_replaced(table):
    item = "ab cd ef gh ij kl mn op qr st"
    d = table([(1, f"één {item.upper()}, two", "old"), (2, "clean é", "old")], "doc_id long, text string, N_HIT string")
    out = decontaminate(d, table([(7, item)], "item_id long, text string"), ["doc_id", "text", "N_HIT"])
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    cut = {r["doc_id"]: r["t"] for r in out.select("doc_id", without_spans(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert cut == {1: "één , two", 2: "clean é"}


def test_empty_tables(table):
    none = table([], "doc_id long, text string")
    items = table([], "item_id long, text string")
    assert decontaminate(none, items, ["doc_id"]).collect() == []
    some = decontaminate(table([(1, "ab cd")], "doc_id long, text string"), items, ["doc_id"]).collect()
    assert [(r["n_words"], r["n_hit"], r["items"], r["spans"]) for r in some] == [(2, 0, [], [])]
