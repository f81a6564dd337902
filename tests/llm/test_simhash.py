"""Fingerprints, pigeonring links and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from textaudit.llm import simhash
from textaudit.llm.components import components
from textaudit.llm.simhash import links, near_duplicates, ring


def reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def grouped(values, distance):
    """Smallest member reachable over pairs at the distance, by value."""
    root = {v: v for v in values}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    order = sorted(root)
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= distance:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {v: top(v) for v in root}


TEXTS = [(4, "One  two\tthree\nfour five"), (2, "one two three four FIVE"), (9, "ÉÉ éé"), (3, None), (8, ""), (7, " \n"), (5, "a"), (5, "a"),
         (6, "word " * 5000), (10, "x" * 20_000 + " y"), (None, "only without id"), (None, "a")]


def test_fingerprints_and_components(table):
    got = near_duplicates(table(TEXTS, "doc_id long, text string")).collect()
    want = {t: reference(t) for _, t in TEXTS}
    assert sorted((r["doc_id"] or -1, r["fp"] & (1 << 64) - 1) for r in got) == sorted((i or -1, want[t]) for i, t in TEXTS)
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    assert by[4, signed(want[TEXTS[0][1]])] == by[2, signed(want[TEXTS[0][1]])] == 2
    assert by[3, 0] == by[8, 0] == by[7, 0] == 3  # empty texts are linked like any other
    assert by[None, signed(want["a"])] == 5 and by[None, signed(want["only without id"])] is None


@pytest.mark.parametrize("distance,segments,bucket", [(2, 7, 256), (2, 7, 24), (1, 5, 8), (0, 4, 2)])
def test_links_lose_nothing_and_add_nothing(table, distance, segments, bucket):
    r = random.Random(distance * 100 + segments)
    center, values = r.getrandbits(64), set()
    for _ in range(150):  # a dense group: few bits vary, so buckets are crowded
        values.add(center ^ sum(1 << b for b in r.sample(range(0, 64, 7), r.randint(0, 4))))
    for _ in range(100):
        v = r.getrandbits(64)
        values |= {v, v ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = components(links(table([(v,) for v in signed], "fp long"), distance, segments, bucket)).collect()
    root = {r["node"]: r["root"] for r in found}
    assert {v: root.get(v, v) for v in signed} == grouped(signed, distance)


def test_ring_has_a_viable_rotation_for_every_link():
    r, (exact, chains, budgets) = random.Random(5), ring(2, 7)
    assert budgets == [1, 1, 1, 2]
    for _ in range(2000):
        diff = sum(1 << b for b in r.sample(range(64), r.randint(0, 2)))
        assert any(not diff & exact[t] and all(bin(diff & int(m)).count("1") <= b for m, b in zip(chains[t], budgets)) for t in range(7))


def test_components_of_long_chains_and_stars(table):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in components(table(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {i: 7 for i in range(8, 40)}


def test_no_rows(table):
    assert near_duplicates(table([], "doc_id long, text string")).collect() == []
    assert components(table([], "a long, b long")).collect() == []


def test_forest_is_smaller_than_its_pairs():
    values = np.array(sorted((1 << i) | 1 << 40 for i in range(30)), np.int64)
    _, chains, budgets = ring(2, 7)
    a, b = simhash._forest(values, np.zeros(30, np.int64), np.full(30, 6), 2, np.full_like(chains, 0), budgets)
    assert len(a) == 29
