"""Chat formatting, in DataFrame functions only.

A declarative template gives each role its label and whether its text is trained on, and the
marks around a turn. A finite-state machine over the roles checks the turn order. The output is
one text per conversation and its segments, each with a loss flag. Control strings inside texts
are escaped, so the output can be read back exactly:

    backslash -> \\0,  ``###`` -> \\1,  ``</turn>`` -> \\2   (in labels also ``:`` -> \\3)

An escaped text holds no mark: every backslash in it begins one of these pairs, neither mark
occurs in it, and the end mark overlaps nothing but itself."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import pick


@dataclass(frozen=True)
class Template:
    """``labels``: role -> label; another role is labelled ``@`` and itself. ``trained``: roles
    whose texts carry loss. ``moves``: state -> role -> state of the turn-order machine."""

    labels: Mapping[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: tuple[str, ...] = ("assistant",)
    begin: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    start: str = "start"
    moves: Mapping[str, Mapping[str, str]] = field(default_factory=lambda: {
        "start": {"system": "opened", "user": "asked"},
        "opened": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("answered",)


TEMPLATE = Template()
BAD = "rejected"
PAIRS = [("\\", "\\0"), ("###", "\\1"), ("</turn>", "\\2")]


def escaped(text: Column, label: bool = False) -> Column:
    for plain, pair in PAIRS + [(":", "\\3")] * label:
        text = F.replace(text, F.lit(plain), F.lit(pair))
    return text


def unescaped(text: Column, label: bool = False) -> Column:
    for plain, pair in reversed(PAIRS + [(":", "\\3")] * label):
        text = F.replace(text, F.lit(pair), F.lit(plain))
    return text


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in pairs.items() for x in (k, v)]), key) if pairs else F.lit(None).cast("string")


def label_of(role: Column, template: Template) -> Column:
    return F.coalesce(_lookup(template.labels, role), F.concat(F.lit("@"), escaped(role, label=True)))


def role_of(label: Column, template: Template) -> Column:
    return F.coalesce(_lookup({v: k for k, v in template.labels.items()}, label), unescaped(label.substr(F.lit(2), F.length(label)), label=True))


def machine(roles: Column, template: Template) -> Column:
    """``(state, bad_turn)`` after all roles: the first turn out of order, from 0, else null."""
    moves = {f"{state} {role}": to for state, by in template.moves.items() for role, to in by.items()}
    return F.aggregate(roles, F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("turn"), F.lit(None).cast("int").alias("bad")),
                       lambda acc, role: F.struct(
                           F.coalesce(_lookup(moves, F.concat_ws(" ", acc["state"], role)), F.lit(BAD)).alias("state"),
                           (acc["turn"] + 1).alias("turn"),
                           F.coalesce(acc["bad"], F.when(_lookup(moves, F.concat_ws(" ", acc["state"], role)).isNull(), acc["turn"])).alias("bad")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 template: Template = TEMPLATE) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, its ``segments`` (``text``, ``loss``)
    in order, ``valid`` (the machine ends in a final state) and ``bad_turn``.

    Rows go by turn, then role, then text (a null turn first; repeated rows are turns of their
    own). Null roles and texts are empty; rows without a ``conv_id`` are one conversation. A
    conversation is one record of training text, hence one row, whatever its length. Input
    columns other than the four are not read; no rows give no conversations."""
    rows = pick(turns, conv_id=conv_id, turn=turn, role=role, text=text)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", blank("role").alias("role"), blank("text").alias("text")))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.begin), label_of(t["role"], template), F.lit(template.colon)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t["text"]).alias("text"), t["role"].isin(*template.trained).alias("loss")),
        F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")))))
    state = machine(F.col("turns.role"), template)
    return (by.select("conv_id", segments.alias("segments"), state.alias("state"))
            .select("conv_id", F.concat_ws("", "segments.text").alias("formatted"), "segments",
                    F.col("state.state").isin(*template.final).alias("valid"), F.col("state.bad").alias("bad_turn")))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """``(role, text)`` of each turn, from a formatted text alone."""
    ends = F.split(formatted, "(?:" + template.end.replace("/", "\\/") + ")", -1)
    bodies = F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))
    begin, colon = F.lit(len(template.begin) + 1), F.lit(template.colon)

    def turn(body: Column) -> Column:
        inner = body.substr(begin, F.length(body))
        at = F.instr(inner, template.colon)
        return F.struct(role_of(inner.substr(F.lit(1), at - 1), template).alias("role"),
                        unescaped(inner.substr(at + F.length(colon), F.length(inner))).alias("text"))

    return F.transform(bodies, turn)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])))
