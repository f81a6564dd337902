"""Personal data: base spans against plain patterns, labelers and redaction."""

import random
import re

from pyspark.sql import functions as F

from textaudit.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, hit):
    number = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        digits = [int(c) for c in reversed(number)]
        return 12 <= len(number) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    return kind != "phone" or 9 <= len(number) <= 15


def brute(text):
    kinds = list(PLAIN)
    return sorted((m.start(), kinds.index(k), m.end()) for k in kinds for m in re.finditer(PLAIN[k], text or "") if holds(k, m.group()))


TEXTS = [None, "", "a@b.c", "x@y.z.w@v.u é jo.e+1@mail.example.com,a@b.c_d@e.f", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.255.0256 0.0.0.0",
         "4111 1111 1111 1111 and 4111-1111-1111-1112 é5500005555555559 12345678901234567890", "+1 (516) 555-2642 +12 +1234567890123456 +33 1 23 45 67 89.",
         "+1 516 555 2642@x.y 4111111111111111@z.com", "9" * 30_000, "a" * 20_000 + "@b.c", "1.2." * 8_000, "+1" + " 2" * 9_000, "a@" * 500 + "b.c",
         "ééé 4111111111111111 ééé +1 (516) 555-2642", 'password=30eeb55d79857bcce0 token = "fed4db295f7031b596f6832d115cd3fccb132de8"']


def test_base_spans_are_the_plain_patterns(table):
    r = random.Random(1)
    pieces = ["4111111111111111", "+1 (516) 555-2642", "a.b@c-d.e", "10.0.0.255", ".", "-", " ", "@", "+", "7", "é", "x1", "\n", "256.1.1.1", "("]
    texts = TEXTS + ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(300)]
    found = pii.find(table(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    assert len(found) == len(texts)
    for row in found:
        assert [(s["start"], s["kind"], s["end"]) for s in row["spans"] if s["base"]] == brute(texts[row["doc_id"]]), texts[row["doc_id"]][:200]
        firm = [s for s in row["spans"] if s["base"]]
        assert all(not (s["start"] < b["end"] and b["start"] < s["end"]) for s in row["spans"] if not s["base"] for b in firm)


def test_method_adds_credentials_but_no_failed_checksums(table):
    rows = [(i, f"word password=30eeb55d7985{i}bcce0 word") for i in range(30)] + [(i, f"pay 4111111111111111 now and 573108038732{i}") for i in range(1000, 1030)]
    got = {r["doc_id"]: {pii.KINDS[s["kind"]] for s in r["spans"]} for r in pii.find(table(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert all(got[i] == {"secret"} for i in range(30))
    failed = [i for i, t in rows if i >= 1000 and len(brute(t)) == 1]
    assert failed and all(got[i] == {"card"} for i in failed)
    spans = pii.find(table([(1, dict(rows)[failed[0]])], "doc_id long, text string"), ["doc_id"]).first()["spans"]
    assert [s["base"] for s in spans] == [True]


def test_redaction_and_offsets(table):
    rows = [(1, "é a@b.com, call +1 (516) 555-2642!"), (2, "clean é"), (3, None), (4, "+1 516 555 2642, 4111111111111111")]
    found = pii.find(table(rows, "doc_id long, text string"), ["doc_id", "text"])
    out = {r["doc_id"]: r["t"] for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()}
    assert out[1] == "é <EMAIL>, call <PHONE>!" and out[2] == "clean é" and out[3] is None
    assert not re.search("[0-9]{4}", out[4])


def test_empty_table_and_clashing_columns(table):
    assert pii.find(table([], "doc_id long, text string"), ["doc_id"]).collect() == []
    wide = table([(1, "a@b.c", "x", "y")], "doc_id long, text string, Spans string, base string").toDF("doc_id", "text", "Spans", "TEXT")
    got = pii.find(wide, ["doc_id", "text", "Spans"])
    assert got.columns == ["doc_id", "text", "spans"] and len(got.first()["spans"]) == 1


def test_a_text_of_very_many_matches_is_linear(table):
    import time

    numbers = ", ".join(str(10 + i % 90) for i in range(250_000)) + " a@b.c"
    mails = " ".join(f"u{i}@example.com" for i in range(20_000))
    began = time.time()
    found = pii.find(table([(1, numbers), (2, mails)], "doc_id long, text string"), ["doc_id", "text"])
    out = found.select("doc_id", F.size("spans").alias("n"), pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    told = {r["doc_id"]: r for r in out}
    assert told[1]["n"] == 1 and told[1]["t"] == numbers[:-5] + "<EMAIL>"
    assert told[2]["n"] == 20_000 and told[2]["t"] == " ".join(["<EMAIL>"] * 20_000)
    assert time.time() - began < 90  # some 30 s here; the quadratic form took 52 s for 32,000 numbers alone


def test_loose_candidates_against_plain_overlaps(table):
    """What scans of sorted bounds keep equals comparing every two candidates."""
    r = random.Random(7)
    pieces = ["james Smith ", "Dr. Anna Maria ", "call 555-123-4567 ", "+1 (516) 555-2642", "password=abc12345 ", "4111111111111111", "a@b.c", "jo [at] x [dot] com ", "1.2.3.4", "300.1.1.1 ", " ", "x "]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 30))) for _ in range(120)]
    rows = pii.candidates(table(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()
    for row in rows:
        firm = [c for c in row["candidates"] if c["base"]]
        loose = [c for c in row["candidates"] if not c["base"]]
        over = lambda a, b: a["start"] < b["end"] and b["start"] < a["end"]
        assert not any(over(c, b) for c in loose for b in firm)
        assert not any(over(a, b) for i, a in enumerate(loose) for b in loose[i + 1:])
        order = [(c["start"], c["kind"], c["end"]) for c in row["candidates"]]
        assert order == sorted(order)


def test_clean_documents_are_left_alone(spark):
    """Of documents without a base span, under 1 % have an added one that is no planted secret."""
    from textaudit.llm.frames import documents

    docs = documents(spark, "/root/testdata/sf0.01")
    found = pii.find(docs, ["doc_id", "text"]).collect()
    clean = [r for r in found if not brute(r["text"]) and not re.search("(?i)password|token|secret|key", r["text"] or "")]
    touched = [r["doc_id"] for r in clean if r["spans"]]
    assert len(clean) > 300 and len(touched) < 0.01 * len(clean), (len(clean), touched[:5])
