"""Array columns of any length in linear time, as expressions.

A fold that appends to an array copies it at every step. ``scanned`` appends within chunks and
joins the chunks once. A substring is found by counting code points from the beginning, so
``between`` takes it from pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK, PIECE = 256, 1024


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scanned(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """Fold of ``items`` that emits: ``step(state, item)`` gives the next state and an array of what
    is emitted; the result is all that is emitted, elements of the type ``kind``. Null or no items: none."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        after, emitted = step(acc["s"], x)
        return F.struct(after.alias("s"), F.concat(acc["out"], emitted).alias("out"))

    def chunk(acc: Column, c: Column) -> Column:
        begun = F.struct(acc["s"].alias("s"), none.alias("out"))
        return bound(F.aggregate(c, begun, one), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["outs"], F.array(r["out"])).alias("outs")))

    def whole(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int")), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)))
        begun = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("outs"))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(chunks, begun, chunk)["outs"])).otherwise(none)

    return bound(items, whole)


def pieces(text: Column) -> Column:
    """``text`` in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end`` (exclusive) of a text in ``pieces``."""
    first, last = (F.floor(x / PIECE).cast("int") for x in (start, end - 1))
    own = F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return own.substr((start - first * PIECE + 1).cast("int"), (end - start).cast("int"))


def replaced(text: Column, spans: Column, put: Callable[[Column], Column]) -> Column:
    """``text`` with each of ``spans`` (by ``start``; ``end`` exclusive) replaced by ``put(span)``; a
    span that begins inside an earlier one is part of it."""
    gap = "struct<a:bigint,b:bigint,put:string>"

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        start, end = s["start"].cast("bigint"), s["end"].cast("bigint")
        made = F.array(F.struct(at.alias("a"), start.alias("b"), put(s).alias("put")))
        return F.greatest(at, end), F.when(start >= at, made).otherwise(F.array().cast(f"array<{gap}>"))

    def filled(parts: Column) -> Column:
        kept = F.transform(scanned(spans, F.lit(0).cast("bigint"), step, gap), lambda g: F.concat(between(parts, g["a"], g["b"]), g["put"]))
        ends = F.array_max(F.transform(spans, lambda s: s["end"].cast("bigint")))
        return F.concat(F.array_join(kept, ""), between(parts, ends, F.length(text).cast("bigint")))

    return F.when(F.size(spans) > 0, bound(pieces(text), filled)).otherwise(text)
