"""Licence scan and url filter against brute force."""

import random
import re

import pytest

from textaudit.llm import licences, urls
from textaudit.llm.queries import QUERIES, URL_RULES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def test_base_phrases(table):
    r = random.Random(4)
    bits = ["under the MIT License", "apache license, version 2.0", "CC BY-NC", "cc", "by", "é", "license", "\n", "under the", "mit"]
    texts = [None, "", "cc by nc cc by nc", "x " * 20_000 + "CC-BY-NC"] + [" ".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(200)]
    for row in licences.scan(table(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect():
        w = words(texts[row["doc_id"]])
        want = sorted(i for p, _ in licences.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        labels = sorted({n for p, n in licences.BASE for i in range(len(w)) if w[i:i + len(p.split())] == p.split()})
        assert (row["n_words"], row["base_starts"], row["base_labels"]) == (len(w), want, labels)
        assert 0 <= row["score"] <= 1


def test_templates_with_gaps_and_without_key_phrases(table):
    filler = " ".join(f"word{i}" for i in range(50))
    texts = {t: f"{filler} {text.upper()} {filler}" for t, (_, text, _) in enumerate(licences.TEMPLATES)}
    texts[100] = filler + " This work is generously licensed under the GNU General Public License , version 3. " + filler
    texts[101] = filler + " general public gnu licensed work version 3 this the under is license " + filler
    texts[102] = filler
    got = {r["doc_id"]: r for r in licences.scan(table(list(texts.items()), "doc_id long, text string"), ["doc_id"]).collect()}
    for t, (label, _, _) in enumerate(licences.TEMPLATES):
        assert label in got[t]["found_labels"] and got[t]["score"] == 1.0
    assert got[100]["found_labels"] == ["gpl"] and got[101]["found_labels"] == [] and got[102]["score"] == 0
    assert licences.scan(table([], "doc_id long, text string"), ["doc_id"]).collect() == []


URLS = ["http://a.example.net/en/5", "https://B.EXAMPLE.com/de/1?x", "https://x.org/fr/2", "https://x.org#/fr/", "net/x", None, "", "://", "ftp://net/", "x://net", "http://u.net?/a",
        "http://example.net/en", "http://EXAMPLE.net/en/", "http://notexample.com/de/", "http://h/é/" + "a/" * 5000, "http://h//a//1.html", "a://b://c/d"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    host, path = "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", tail).group()
    best = None
    for verdict, text in URL_RULES:
        own, rest = text.split("/", 1)
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = verdict, text
    return host, path, best


def test_rules_and_parts(table):
    pages = table([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, PURITY string")
    got = urls.judge(pages, table([], "doc_id long, quality int, toxic int"), URL_RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, best = brute(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == (best[0] if best else "allow")


def test_real_pages(spark):
    import duckdb

    pages = dict(duckdb.sql("select page_id, url from '/root/testdata/sf0.01/pages.parquet'").fetchall())
    got = QUERIES["op3_urls"](spark, "/root/testdata/sf0.01").collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    assert all((r["host"], r["path"], r["rule"]) == (*brute(pages[r["page_id"]])[:2], (brute(pages[r["page_id"]])[2] or (0, None))[1]) for r in got)


@pytest.fixture()
def site(table):
    rows, labels = [], []
    for i in range(900):  # variable names take a wildcard, sections stay
        section = ("news", "spam", "about")[i % 3]
        rows.append((i, f"http://site.org/{section}/title-of-{i}-x/{i}.html"))
        if i % 2 == 0:
            labels.append((i, int(section != "spam" or i % 30 == 1), 0))
    rows += [(2000 + i, "http://other.org/2024-01-02/deadbeef99/7") for i in range(3)]
    return table(rows, "page_id long, url string"), table(labels + [(0, None, None), (0, 1, 0)], "doc_id long, quality int, toxic int")


def test_templates_generalise_merge_and_reject(site):
    got = urls.judge(*site, []).collect()
    assert {r["template"] for r in got if r["host"] == "site.org"} == {"/news/*/<n>.html", "/spam/*/<n>.html", "/about/*/<n>.html"}
    assert {r["template"] for r in got if r["host"] == "other.org"} == {"/<date>/<hash>/<n>"}
    assert {r["verdict"] for r in got if "/spam/" in r["path"]} == {"block"}
    assert {r["verdict"] for r in got if "/spam/" not in r["path"]} == {"allow"}


def test_similar_siblings_share_a_branch(table):
    leaves = table([("h", "/p", f"/p/{i}", good, 100) for i, good in enumerate([90, 91, 89, 20, 22])], "host string, parent string, template string, good long, labelled long")
    got = {r["template"]: (r["branch"], r["purity"]) for r in urls.purities(leaves, 0.8).collect()}
    assert got["/p/0"] == got["/p/1"] == got["/p/2"] and got["/p/3"] == got["/p/4"] and got["/p/0"][1] > 0.85 > 0.3 > got["/p/3"][1]


def test_no_pages(table):
    none = table([], "page_id long, url string")
    assert urls.judge(none, table([(1, 1, 0)], "doc_id long, quality int, toxic int"), URL_RULES).collect() == []


def test_frequent_sections_of_a_wide_node_stay(table):
    pages = [(i, f"http://wide.org/s{chr(97 + i % 25)}x/page-{i}-y.html") for i in range(2500)]  # 25 sections
    pages += [(5000 + i, f"http://wide.org/once-{i}-z/page.html") for i in range(300)]
    deep = "/".join("abcdefgh")
    pages += [(6000 + i, f"http://deep.org/{deep}/{('good', 'spam')[i % 2]}/page-{i}-y.html") for i in range(200)]
    labels = [(i, int(i % 25 != 3), 0) for i in range(2500)] + [(6000 + i, 1 - i % 2, 0) for i in range(200)]
    got = urls.judge(table(pages, "page_id long, url string"), table(labels, "doc_id long, quality int, toxic int"), []).collect()
    assert len({r["template"] for r in got if r["path"].startswith("/s")}) == 25
    assert {r["template"] for r in got if "/once-" in r["path"]} == {"/*/page.html"}
    for r in got:
        assert r["verdict"] == ("block" if "/sdx/" in r["path"] or "/spam/" in r["path"] else "allow")


def test_small_steps_do_not_chain(table):
    leaves = table([("h", "", f"/{i}", 4 * i, 40) for i in range(10)], "host string, parent string, template string, good long, labelled long")
    got = {r["template"]: (r["branch"], r["purity"]) for r in urls.purities(leaves, 0.45).collect()}
    assert got["/0"][1] < 0.2 and got["/9"][1] > 0.6 and 2 < len(set(got.values())) < 10
    assert [got[f"/{i}"][0] for i in range(10)] == sorted(got[f"/{i}"][0] for i in range(10))


def test_similar_inner_siblings_share_a_branch(table):
    shapes = [("h", [s, f"p{j}"], 12, good, 12) for s, good in (("a", 12), ("b", 12), ("c", 0)) for j in range(3)]
    got = urls.templates(table(shapes, "host string, segments array<string>, n long, good long, labelled long")).collect()
    parent = {r["template"]: r["parent"] for r in got}
    assert parent["/a/p0"] == parent["/b/p1"] != parent["/c/p0"] and len(set(parent.values())) == 2


def plain_tree(shapes, smoothing=10.0, variable=0.5):
    """Templates by walking one node after the other: ``{segments: template}`` of a host."""
    from math import log

    out = {}

    def walk(rows, template):  # rows: (segments, rest, n, labelled)
        rows = [r for r in rows if r[1] or out.update({r[0]: template})]
        if not rows:
            return
        k = 0
        while all(len(r[1]) > k and r[1][k] == rows[0][1][k] for r in rows):
            k += 1
        template += "".join("/" + x for x in rows[0][1][:k])
        rests = {r[1] for r in rows}
        if len(rests) == 1 or not sum(r[3] for r in rows):
            out.update({r[0]: template + ("" if len(rests) == 1 else "/**") for r in rows})
            return
        groups = {}
        for s, rest, n, lab in rows:
            if len(rest) == k:
                out[s] = template
            else:
                groups.setdefault(rest[k], []).append((s, rest[k + 1:], n, lab))
        thin = {c for c, g in groups.items() if sum(r[3] for r in g) < smoothing}
        sizes = [sum(r[2] for r in groups[c]) for c in thin]
        total = sum(sizes)
        wide = total > 1 and log(total) - sum(n * log(n) for n in sizes) / total >= variable * log(total) - 1e-9
        merged = {}
        for c, g in groups.items():
            merged.setdefault("*" if c in thin and wide else c, []).extend(g)
        for c, g in merged.items():
            walk(g, f"{template}/{c}")

    walk([(s, s, n, lab) for s, n, lab in shapes], "")
    return out


def test_tree_equals_a_plain_walk(table):
    import random

    r = random.Random(4)
    hosts = {}
    for h in range(12):
        words = [[f"{chr(97 + i)}{d}" for i in range(r.choice([1, 2, 3, 9]))] for d in range(6)]
        for _ in range(r.choice([1, 5, 40, 120])):
            segments = tuple(r.choice(words[d]) if r.random() < .8 else f"v{r.randint(0, 10**6)}" for d in range(r.randint(0, 6)))
            n = r.randint(1, 30)
            hosts.setdefault(f"h{h}", {}).setdefault(segments, (n, r.choice([0, 0, r.randint(0, n)]) if h % 3 else 0))
    rows = [(h, list(s), n, lab, lab) for h, shapes in hosts.items() for s, (n, lab) in shapes.items()]
    got = {(x["host"], tuple(x["segments"])): x["template"] for x in urls.templates(table(rows, "host string, segments array<string>, n long, good long, labelled long")).collect()}
    assert len(got) == len(rows)
    for h, shapes in hosts.items():
        want = plain_tree([(s, n, lab) for s, (n, lab) in shapes.items()])
        assert {s: got[h, s] for s in shapes} == want, h


def test_an_even_growth_keeps_the_tree_and_deep_paths_take_few_rounds(table, monkeypatch):
    schema = "host string, segments array<string>, n long, good long, labelled long"
    deep = [f"d{i}" for i in range(300)]
    rows = [("h", ["news", f"x{i}q"], 1, 0, 0) for i in range(40)] + [("h", [f"s{i}e", "p"], 50, 5, 5) for i in range(30)] + [("d", deep + [x], 5, 2, 4) for x in "ab"]
    rounds = []
    monkeypatch.setattr(urls, "save", lambda df, name, save=urls.save: rounds.append(name) or save(df, name))
    tree = lambda rows: {(x["host"], *x["segments"]): x["template"] for x in urls.templates(table(rows, schema)).collect()}
    one = tree(rows)
    assert rounds.count("templates") <= 4
    assert one == tree([(h, s, 7 * n, g, lab) for h, s, n, g, lab in rows if s[0] != "news"] + [r for r in rows if r[1][0] == "news"])
    assert one["h", "s3e", "p"] == "/s3e/p" and one[("d", *deep, "a")].endswith("/d299/a") or one[("d", *deep, "a")].endswith("/*")
