"""Personal data by weak supervision, in DataFrame functions only.

Spans of the base patterns are always personal data. They and looser candidates (written-out
addresses, numbers without a country code, failed checksums, credentials, names) get the votes
of labelers: pattern, checksum, gazetteer, context and shape. How often each combination of
votes and features occurs is counted over all rows; expectation-maximisation on those counts
(at most one row a combination, however large the corpus) estimates each labeler's reliability
by kind, and its posteriors train a logistic span classifier on the same counts, which then
judges every candidate. Two base spans of different kinds may overlap; added ones overlap none."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import between, bound, pieces, replaced, scanned
from .frames import dropping, pick, save

# --- fixed values: patterns and word lists -------------------------------------------------
KINDS = ["email", "ip", "card", "phone", "secret", "name"]
# Possessive and anchored forms of the plain patterns: the same matches, without backtracking.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]++(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_+/-]{8,}+\"?",
    "name": r"(?<!\p{L})(?:Mr|Mrs|Ms|Dr|Prof|James|Mary|John|Anna|Robert|Maria|Michael|Laura|David|Julia|Thomas|Sarah|Peter|Marie|Pierre|Hans|Carlos|Elena)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
# What a text must contain for a pattern to match at all; spares most texts the pattern.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][ -]?[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
LOOSE_NEEDS = {
    "email": lambda t: t.rlike(r"[\[(] ?at ?[\])]"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[ .-][0-9]{4}"),
    "secret": lambda t: t.rlike(r"[=:]\s{0,3}\"?[A-Za-z0-9_+/-]{8}"),
    "name": lambda t: t.rlike(r"(?:Mr|Mrs|Ms|Dr|Prof|James|Mary|John|Anna|Robert|Maria|Michael|Laura|David|Julia|Thomas|Sarah|Peter|Marie|Pierre|Hans|Carlos|Elena)\.? \p{Lu}"),
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
DOMAINS = r"(?i)[. )\]](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch|it|nl)$"
GIVEN = r"^(?:James|Mary|John|Anna|Robert|Maria|Michael|Laura|David|Julia|Thomas|Sarah|Peter|Marie|Pierre|Hans|Carlos|Elena) "
CUES = {
    "email": r"mail|contact|write|reach", "ip": r"\bip\b|address|server|host", "card": r"card|visa|credit|pay|karte|tarjeta|carte",
    "phone": r"phone|tel|call|mobile|fax|anruf|llam", "secret": r"password|token|secret|key|login", "name": r"dear|by|from|author|contact|herr|frau|monsieur",
}
AGAINST = r"version|isbn|chapter|page|figure|section|order|item|example"
# --------------------------------------------------------------------------------------------

LABELERS, ABSTAIN, BEFORE, THRESHOLD = 5, 2, 24, 0.5
CANDIDATE = "struct<start:int,kind:int,end:int,base:boolean,votes:array<int>,active:array<int>>"


def pairs(text: Column, pattern: str, needs: Column) -> Column:
    """Leftmost non-overlapping matches, each with the length of the piece in front of it and its
    own, as patterns themselves report no positions."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    made = F.zip_with(F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), hits,
                      lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("n"), h.alias("h")))
    return F.when(needs, made).otherwise(F.array().cast("array<struct<g:int,n:int,h:string>>"))


def placed(found: Column) -> Column:
    """``pairs`` with code point bounds."""
    return scanned(found, F.lit(0), lambda at, x: (at + x["g"] + x["n"], F.array(F.struct(
        (at + x["g"]).alias("start"), (at + x["g"] + x["n"]).alias("end"), x["h"].alias("hit")))), "struct<start:int,end:int,hit:string>")


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of a string of digits."""
    n = F.length(number)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(
        (n - i) % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), number.substr(i, F.lit(1)).cast("int"))
    ).otherwise(number.substr(i, F.lit(1)).cast("int")))
    return F.when(n > 0, total % 10 == 0).otherwise(False)


def valid(kind: str, hit: Column) -> Column:
    """Whether a match of the base pattern is personal data of that kind."""
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(hit))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(hit))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _votes(kind: str, hit: Column, base: Column, before: Column) -> list[Column]:
    """1 for personal data, 0 against, 2 for no opinion: pattern, checksum, gazetteer, context, shape."""
    yes = lambda c: F.when(c, 1).otherwise(0)
    maybe = lambda c: F.when(c, 1).otherwise(ABSTAIN)
    n = F.length(digits(hit))
    checksum = {"email": maybe(base), "ip": yes(base), "card": yes(base), "phone": F.when(n.between(9, 15), 1).when(n < 7, 0).otherwise(ABSTAIN),
                "secret": yes(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]{2}")), "name": F.lit(ABSTAIN)}[kind]
    gazetteer = {"email": yes(hit.rlike(DOMAINS)), "ip": yes(~hit.rlike(r"^0*(?:0|24[0-9]|25[0-5])\.")), "card": yes(hit.rlike("^[3-6]")),
                 "phone": maybe(hit.startswith("+")), "secret": maybe(hit.rlike("(?i)^(?:pass|token|secret|api)")), "name": maybe(hit.rlike(GIVEN))}[kind]
    context = F.when(before.rlike(AGAINST), 0).when(before.rlike(CUES[kind]), 1).otherwise(ABSTAIN)
    shape = {"name": maybe(hit.rlike(r" \S+ \S+"))}.get(kind, yes(~digits(hit).rlike(r"^([0-9])\1{6,}+$") & ~hit.rlike("(?i)x{4}|example only")))
    pattern = yes(base) if kind in ("ip", "card") else maybe(base)
    return [pattern, checksum, gazetteer, context, shape]


def _judged(kind: str, span: Column, parts: Column, base: Column) -> Column:
    """A candidate: its span, its votes and the numbers of its active features."""
    return bound(F.lower(between(parts, F.greatest(span["start"] - BEFORE, F.lit(0)), span["start"])), lambda before: _seen(kind, span, before, base))


def _seen(kind: str, span: Column, before: Column, base: Column) -> Column:
    votes = _votes(kind, span["hit"], base, before)
    size, k = span["end"] - span["start"], KINDS.index(kind)
    own = [F.lit(k), len(KINDS) + F.least(F.floor(size / 8), F.lit(3)).cast("int"),
           len(KINDS) + 4 + F.when(before.rlike(r"[=:]\s*\"?$"), 1).otherwise(0) + 2 * F.when(before.rlike(r"(?:^|\n)$"), 1).otherwise(0)]
    own += [F.lit(len(KINDS) + 8 + 3 * j) + v for j, v in enumerate(votes)]
    return F.struct(span["start"].alias("start"), F.lit(k).alias("kind"), span["end"].alias("end"), base.alias("base"),
                    F.array(*votes).alias("votes"), F.array(*own).alias("active"))


FEATURES = len(KINDS) + 8 + 3 * LABELERS


def _apart(loose: Column, firm: Column) -> Column:
    """Of ``loose`` (by start) the candidates that overlap none of ``firm``: in the order of all
    starts, the firm span in front ends by then, and the next one begins later."""
    events = F.array_sort(F.concat(
        F.transform(firm, lambda b: F.struct(b["start"].alias("at"), F.lit(False).alias("loose"), F.lit(0).alias("i"), b["end"].alias("end"))),
        F.transform(loose, lambda c, i: F.struct(c["start"].alias("at"), F.lit(True).alias("loose"), i.alias("i"), c["end"].alias("end")))))
    none, far = F.array().cast("array<int>"), 2**31 - 1

    def reach(at: Column, e: Column) -> tuple[Column, Column]:
        return F.when(e["loose"], at).otherwise(F.greatest(at, e["end"])), F.when(e["loose"], F.array(at)).otherwise(none)

    def following(at: Column, e: Column) -> tuple[Column, Column]:
        return F.when(e["loose"], at).otherwise(e["at"]), F.when(e["loose"], F.array(at)).otherwise(none)

    def alone(es: Column) -> Column:
        ends, starts = scanned(es, F.lit(0), reach, "int"), F.reverse(scanned(F.reverse(es), F.lit(far), following, "int"))
        told = F.arrays_zip(loose.alias("c"), ends.alias("end"), starts.alias("start"))
        free = F.filter(told, lambda x: (x["end"] <= x["c"]["start"]) & (x["start"] >= x["c"]["end"]))
        return F.transform(free, lambda x: x["c"])

    return F.when((F.size(loose) > 0) & (F.size(firm) > 0), bound(events, alone)).otherwise(loose)


def candidates(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``candidates``: base spans, and looser ones that overlap none
    of them (of those that overlap each other the leftmost, then the longest). The work is linear
    in the text and n log n in its matches."""
    keep = [k for k in keep if k.lower() != "candidates"]
    frame = pick(docs, **{f"k{i}": k for i, k in enumerate(keep)}, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    frame = frame.withColumns({f"b_{k}": pairs(t, p, NEEDS[k](t)) for k, p in BASE.items()}
                              | {f"l_{k}": pairs(t, p, LOOSE_NEEDS[k](t)) for k, p in LOOSE.items()})
    found = [c for c in frame.columns if c[:2] in ("b_", "l_")]
    some = F.lit(False)
    for c in found:
        some = some | (F.size(c) > 0)
    frame = frame.withColumns({c: placed(F.col(c)) for c in found} | {"parts": F.when(some, pieces(t)).otherwise(F.array().cast("array<string>"))})

    def judged(column: str, kind: str, base: bool, which=lambda hit: F.length(hit) > 0) -> Column:
        return F.transform(F.filter(column, lambda s: which(s["hit"])), lambda s: _judged(kind, s, F.col("parts"), F.lit(base)))

    firm = F.concat(*[judged(f"b_{k}", k, True, partial(valid, k)) for k in BASE])
    doubtful = [judged(f"l_{k}", k, False) for k in LOOSE]
    doubtful.append(judged("b_ip", "ip", False, lambda h: ~valid("ip", h)))
    doubtful.append(judged("b_card", "card", False, lambda h: F.length(digits(h)).between(12, 19) & ~valid("card", h)))
    frame = frame.withColumn("firm", firm).withColumn("loose", F.concat(*doubtful))
    longest = F.array_sort(F.transform("loose", lambda c: F.struct(c["start"].alias("start"), (-c["end"]).alias("end"), c["kind"].alias("kind"), c.alias("c"))))
    frame = frame.withColumn("loose", F.when(F.size("loose") > 0, F.transform(longest, lambda x: x["c"])).otherwise(F.col("loose")))
    frame = frame.withColumn("loose", _apart(F.col("loose"), F.col("firm")))
    none = F.array().cast(f"array<{CANDIDATE}>")
    leftmost = scanned(F.col("loose"), F.lit(0), lambda at, c: (F.when(c["start"] >= at, c["end"]).otherwise(at),
                                                               F.when(c["start"] >= at, F.array(c)).otherwise(none)), CANDIDATE)
    both = F.array_sort(F.concat("firm", leftmost))
    return frame.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], both.alias("candidates"))


@dataclass
class Model:
    """Prior and labeler reliabilities by kind, and the span classifier's weights by feature."""

    prior: dict[int, float]
    right: dict[int, list[tuple[float, float]]]
    weights: list[float]
    bias: float


def _posterior(votes: list[int], prior: float, right: list[tuple[float, float]]) -> float:
    yes, no = math.log(prior), math.log(1 - prior)
    for v, (hit, miss) in zip(votes, right):
        if v != ABSTAIN:
            yes += math.log(hit if v else 1 - hit)
            no += math.log(1 - miss if v else miss)
    return 1 / (1 + math.exp(min(700.0, no - yes)))


def fit(found: DataFrame, rounds: int = 50, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Reliabilities by expectation-maximisation and the classifier by gradient descent, both
    on the counts of vote and feature combinations over all rows (bounded by the labelers and
    features, not by the corpus). Base spans are certain; smoothing stands in for kinds unseen."""
    c = F.explode("candidates").alias("c")
    rows = found.select(c).groupBy("c.kind", "c.base", "c.votes", "c.active").agg(F.count("*").alias("n")).collect()
    rows = sorted((r["kind"], r["base"], tuple(r["votes"]), tuple(r["active"]), r["n"]) for r in rows)
    prior, right = {}, {}
    for kind in range(len(KINDS)):
        own = [(v, base, n) for k, base, v, _, n in rows if k == kind]
        at, reliable = 0.5, [(0.8, 0.7)] * LABELERS
        for _ in range(rounds):
            belief = [1.0 if base else _posterior(v, at, reliable) for v, base, _ in own]
            yes = sum(p * n for p, (_, _, n) in zip(belief, own))
            total = sum(n for *_, n in own)
            at = (yes + 1) / (total + 2)
            reliable = []
            for j in range(LABELERS):
                seen = [(p, v[j], n) for p, (v, _, n) in zip(belief, own) if v[j] != ABSTAIN]
                hit = (sum(p * n for p, v, n in seen if v) + 4) / (sum(p * n for p, _, n in seen) + 5)
                miss = (sum((1 - p) * n for p, v, n in seen if not v) + 3.5) / (sum((1 - p) * n for p, _, n in seen) + 5)
                reliable.append((hit, miss))
        prior[kind], right[kind] = at, reliable
    weights, bias = [0.0] * FEATURES, 0.0
    labelled = [(active, 1.0 if base else _posterior(v, prior[k], right[k]), math.sqrt(n)) for k, base, v, active, n in rows]
    mass = sum(n for *_, n in labelled) or 1.0
    for _ in range(steps):
        slope, off = [ridge * w for w in weights], 0.0
        for active, p, n in labelled:
            z = bias + sum(weights[i] for i in active)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - p) * n / mass
            off += error
            for i in active:
                slope[i] += error
        weights = [w - rate * g for w, g in zip(weights, slope)]
        bias -= rate * off
    return Model(prior, right, weights, bias)


def spans(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``candidates`` replaced by ``spans``: base spans and those the classifier accepts, as
    ``(start, end, kind, base, score)`` by start, then kind as listed."""
    table = F.array(*[F.lit(float(w)) for w in model.weights])
    logit = lambda c: F.aggregate(c["active"], F.lit(float(model.bias)), lambda acc, i: acc + F.get(table, i))
    scored = F.transform("candidates", lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["base"].alias("base"),
        (1 / (1 + F.exp(-logit(c)))).alias("score")))
    kept = F.filter(scored, lambda s: s["base"] | (s["score"] >= threshold))
    return found.select(*[F.col(f"`{c}`") for c in dropping(found, ["candidates", "spans"])], kept.alias("spans"))


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``spans`` of every row. Null texts are empty; offsets are code
    points, ends exclusive; repeated rows are judged alike; no rows, no spans. Candidates are
    written once, so the patterns run once although the model needs all rows first."""
    found = save(candidates(docs, keep, text), "pii")
    return spans(found, fit(found))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in capitals; overlapping spans count as one
    of the first one's kind."""
    tags = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    return replaced(text, spans, lambda s: F.get(tags, s["kind"]))
