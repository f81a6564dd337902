import hashlib
import zlib

from pyspark.sql import functions as F
import pytest

from textaudit.llm import merkle
from textaudit.llm.queries import seventh

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """All levels of a tree, plainly."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h(*now[i:i + 2]) for i in range(0, len(now), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return out


def brute(rows):
    def leaf(r, more=0):
        d, t, la, s, n = r
        return h(*[enc(x) for x in (d, s, la, None if n is None else n + more, t)])

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {la: sorted((r for r in rows if r[2] == la), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for la in langs}
    trees = {la: tree([leaf(r) for r in g]) for la, g in groups.items()}
    top = tree([trees[la][-1][0] for la in langs])
    out = []
    for k, la in enumerate(langs):
        for i, r in enumerate(groups[la]):
            steps = siblings(trees[la], i) + siblings(top, k)
            at = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for odd, sib in steps:
                at = h(at) if sib is None else h(sib, at) if odd else h(at, sib)
            out.append((r[0], leaf(r), trees[la][-1][0], top[-1][0], h(*[s for _, s in steps if s]), at, at == top[-1][0]))
    return sorted(out, key=str)


def run(df, levels=merkle.LEVELS):
    done = merkle.prove(df, seventh(F.col("doc_id")), levels)
    cols = ["doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256), "folded_root", "verified"]
    return sorted(map(tuple, done.select(*cols).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_log_is_a_postorder_and_places_are_closed_form(n):
    leaves = [bytes([i]) * 32 for i in range(n)]
    levels = merkle.height(n)
    log = merkle.append_log(leaves, levels)
    whole = tree([x.hex() for x in leaves])
    assert len(log) == sum(map(len, whole)) and log[-1].hex() == whole[-1][0]
    for level, nodes in enumerate(whole):
        for j, node in enumerate(nodes):
            assert log[merkle.place(min((j + 1) << level, n) - 1, level)].hex() == node
    for i in range(n):
        assert [x and x.hex() for _, x in merkle.path(log, n, levels, i)] == [s for _, s in siblings(whole, i)]


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_equals_plain_trees_at_any_builder_size(table, levels):
    rows = [(i * 7 % 61, f"text {i} é\n", ["en", "de", None, "fr"][i % 7 % 4], "web" if i % 3 else None, None if i % 11 == 0 else i) for i in range(61)]
    rows += [(None, None, None, None, None), (None, "", "en", "", 0), (5, "b", "en", "x", 1), (5, "a", "en", "x", 1), (5, "a", "en", "x", 1), (10**12, "lone", "zz", "s", 3)]
    assert run(table(rows, SCHEMA), levels) == brute(rows)


def test_identical_rows_fill_several_builders_and_ranges(table, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    rows = [(7, "same", "en", "web", 4)] * 90 + [(1, "first", "en", "web", 5)]
    got = run(table(rows, SCHEMA), 3)
    assert got == brute(rows) and len(got) == 91


def test_tampered_rows_alone_fail(table):
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(40)] + [(i, f"t{i}", "en", "s", None) for i in range(40, 60)]
    for d, *_, verified in run(table(rows, SCHEMA)):
        assert verified == (d >= 40 or zlib.crc32(str(d).encode()) % 7 != 0)


def test_empty_and_long_and_clashing_columns(spark, table):
    assert run(table([], SCHEMA)) == []
    rows = [(1, "x" * 2_000_000, "en", "s", 1), (2, "", "en", "s", 1)]
    assert run(table(rows, SCHEMA)) == brute(rows)
    extra = table([(*r, "no", 9) for r in rows], SCHEMA + ", TEXT string, Node int")
    assert run(extra) == brute(rows)
