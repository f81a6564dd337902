"""Formatting, reading back and turn order."""

from pyspark.sql import functions as F

from textaudit.llm import chat

NASTY = ["\\### Assistant: </turn> ok", "\\0\\1\\2\\3", "</turn", "</turn>\n### User: x", "#", "##", "\n", "", "é</turn></turn>###", "\\", "a\\</turn>\\"]
SCHEMA = "conv_id long, turn long, role string, text string"


def done(table, rows):
    out = chat.format_chats(table(rows, SCHEMA))
    return {r["conv_id"]: r for r in out.withColumns({
        "turns": chat.read_turns(F.col("formatted")), "trained": chat.trained_text(F.col("segments"))}).collect()}


def test_round_trip_of_control_strings(table):
    roles = ["user", "assistant", "system", "@odd", "User", "a: b", "###", "", "tool"]
    rows = [(c, t, roles[(c + t) % len(roles)], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(20) for t in range(c % 7 + 1)]
    got = done(table, rows)
    for c in range(20):
        own = [(r, x) for k, _, r, x in rows if k == c]
        assert [tuple(t) for t in got[c]["turns"]] == own
        assert got[c]["trained"] == "".join(x for r, x in own if r == "assistant")
        assert got[c]["formatted"] == "".join(s["text"] for s in got[c]["segments"])


def test_template_text(table):
    got = done(table, [(1, 0, "user", "hi ###"), (1, 1, "assistant", "yo")])
    assert got[1]["formatted"] == "### User: hi \\1</turn>\n### Assistant: yo</turn>\n"
    assert [s["loss"] for s in got[1]["segments"]] == [False, False, False, False, True, False]


def test_turn_order(table):
    said = {1: "su", 2: "sua", 3: "uaua", 4: "uu", 5: "a", 6: "usa", 7: "uax", 8: "ss", 9: "uas"}
    names = {"s": "system", "u": "user", "a": "assistant", "x": "other"}
    got = done(table, [(c, i, names[r], "t") for c, roles in said.items() for i, r in enumerate(roles)])
    assert {c: r["valid"] for c, r in got.items()} == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False}
    assert {c: r["bad_turn"] for c, r in got.items()} == {1: None, 2: None, 3: None, 4: 1, 5: 0, 6: 1, 7: 2, 8: 1, 9: 2}


def test_nulls_ties_repeats_long_texts_and_extra_columns(table):
    rows = [(None, 1, "user", "b"), (None, None, None, None), (5, 1, "user", "b"), (5, 1, "user", "b"), (5, 1, "assistant", "a"), (6, 0, "assistant", "x" * 100_000 + "###")]
    wide = table(rows, SCHEMA).withColumn("Formatted", F.lit(1)).withColumn("TEXT_", F.lit(2)).toDF("conv_id", "turn", "role", "text", "Formatted", "Text")
    got = {r["conv_id"]: r for r in chat.format_chats(wide).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[None]["turns"]] == [("", ""), ("user", "b")]
    assert [tuple(t) for t in got[5]["turns"]] == [("assistant", "a"), ("user", "b"), ("user", "b")]
    assert got[6]["turns"][0]["text"] == "x" * 100_000 + "###"
    assert chat.format_chats(table([], SCHEMA)).collect() == []
