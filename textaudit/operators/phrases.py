"""Phrase lookup in texts with an automaton: one pass a text, however long the list.

The list is read in blocks of at most ``BLOCK_BYTES`` of phrases; a block's automaton is built once a
task from a broadcast list, so what is sent and held stays bounded, and a list of several blocks
takes a pass each. Phrases are matched as substrings, case ignored."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 16 << 20


def blocks(phrases: Iterable[str], most: int = BLOCK_BYTES) -> Iterator[list[str]]:
    """Distinct non-empty phrases in lower case, in lists of at most ``most`` bytes (a longer
    phrase is a list of its own)."""
    held, size, seen = [], 0, set()
    for p in phrases:
        p = (p or "").lower()
        if not p or p in seen:
            continue
        seen.add(p)
        n = len(p.encode())
        if held and size + n > most:
            yield held
            held, size, seen = [], 0, {p}
        held.append(p)
        size += n
    if held:
        yield held


def automaton(phrases: list[str]):
    import ahocorasick
    out = ahocorasick.Automaton()
    for p in phrases:
        out.add_word(p, p)
    out.make_automaton()
    return out


def leftmost_longest(hits: Iterable[tuple[int, str]]) -> list[tuple[int, str]]:
    """Of ``(start, phrase)`` hits the leftmost, of those the longest, then on from its end."""
    longest: dict[int, str] = {}
    for start, p in hits:
        if len(p) > len(longest.get(start, "")):
            longest[start] = p
    out, at = [], 0
    for start in sorted(longest):
        if start >= at:
            out.append((start, longest[start]))
            at = start + len(longest[start])
    return out


def _found(docs: DataFrame, phrases: list[str], key: str, text: str, all_hits: bool) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        import pyarrow as pa
        known = automaton(sent.value)
        for batch in batches:
            keys, starts, found = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = ((end - len(p) + 1, p) for end, p in known.iter(t))
                for start, p in (sorted(hits) if all_hits else leftmost_longest(hits)):
                    keys.append(k)
                    starts.append(start)
                    found.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(starts, pa.int32()), pa.array(found, pa.string())], names=["k", "start", "phrase"])

    own = docs.select(F.col(key).alias("k"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return own.mapInArrow(run, f"k {kind}, start int, phrase string").withColumnRenamed("k", key)


def phrase_hits(docs: DataFrame, phrases: Iterable[str], key: str = "doc_id", text: str = "text", all_hits: bool = True,
                most: int = BLOCK_BYTES) -> DataFrame:
    """``(key, start, phrase)``: occurrences of ``phrases`` in the lower-cased texts, all of them or
    (``all_hits=False``, for lists of one block) the leftmost longest. No phrases, no rows."""
    lists = list(blocks(phrases, most))
    if not all_hits and len(lists) > 1:
        raise ValueError("leftmost-longest matching needs the phrases in one block")
    out = None
    for own in lists or [[]]:
        part = _found(docs, own, key, text, all_hits) if own else docs.limit(0).select(key, F.lit(0).alias("start"), F.lit("").alias("phrase"))
        out = part if out is None else out.unionByName(part)
    return out


def contained(docs: DataFrame, phrases: Iterable[str], key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``(key, phrase)``: which phrases each text contains, once each."""
    return phrase_hits(docs, phrases, key, text, **how).select(key, "phrase").distinct()
