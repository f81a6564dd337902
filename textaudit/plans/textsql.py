"""SQL expression builders for the text oracles (DuckDB dialect).

They restate the text operators from their definitions: tokens by regular expression,
lexicon lookups as CASE expressions, list lambdas for per-token rules.
"""

from __future__ import annotations

WORD = r"'[\p{L}\p{N}_]+'"
WORD_FULL = r"'^[\p{L}\p{N}_]+$'"
SPACE_FULL = r"'^[\s\p{Z}]+$'"
LOSSLESS = r"'[\p{L}\p{N}_]+|[\s\p{Z}]+|[^\p{L}\p{N}_\s\p{Z}]'"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def case_map(expr: str, mapping: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else f'CAST({float(v)!r} AS DOUBLE)'}"
                     for k, v in mapping.items())
    return f"(CASE {expr} {whens} ELSE {default} END)"


def strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def collapse(expr: str) -> str:
    return strip(rf"regexp_replace({expr}, '[\s\p{{Z}}]+', ' ', 'g')")


def is_word(x: str) -> str:
    return f"regexp_matches({x}, {WORD_FULL})"


def first_upper(x: str) -> str:
    return f"(left({x}, 1) = upper(left({x}, 1)) AND left({x}, 1) <> lower(left({x}, 1)))"


def first_lower(x: str) -> str:
    return f"(left({x}, 1) = lower(left({x}, 1)) AND left({x}, 1) <> upper(left({x}, 1)))"


def capitalize(x: str) -> str:
    return f"(upper(left({x}, 1)) || lower(substr({x}, 2)))"


def case_like(t: str, r: str) -> str:
    title = f"({t} = upper(left({t}, 1)) || lower(substr({t}, 2)) AND {t} <> lower({t}))"
    upper = f"({t} = upper({t}) AND {t} <> lower({t}))"
    return f"(CASE WHEN {title} THEN {capitalize(r)} WHEN {upper} THEN upper({r}) ELSE {r} END)"


def clean_sentence(x: str) -> str:
    s = collapse(x)
    s2 = f"(CASE WHEN regexp_matches({s}, '[.!?]$') THEN {s} ELSE {s} || '.' END)"
    return f"(CASE WHEN {first_lower(s2)} THEN upper(left({s2}, 1)) || substr({s2}, 2) ELSE {s2} END)"


def swap_tokens(toks: str, lexicon: dict) -> str:
    """list_transform over loss-free tokens applying the gender swap."""
    nxt = (f"(CASE WHEN regexp_matches({toks}[i + 1], {SPACE_FULL}) THEN {toks}[i + 2] ELSE {toks}[i + 1] END)")
    her = f"(CASE WHEN {nxt} IS NOT NULL AND {is_word(nxt)} THEN 'his' ELSE 'him' END)"
    repl = f"(CASE WHEN lower(tk) = 'her' THEN {her} ELSE {case_map('lower(tk)', lexicon)} END)"
    keys = sorted(set(lexicon) | {"her"})
    return (f"list_transform({toks}, lambda tk, i: CASE WHEN {is_word('tk')} AND lower(tk) IN {in_list(keys)} "
            f"THEN {case_like('tk', repl)} ELSE tk END)")


def neutral_replace(text: str, mapping: dict) -> str:
    words = f"(CASE WHEN {strip(text)} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split_regex({strip(text)}, '[\\s\\p{{Z}}]+') END)"
    key = r"regexp_replace(lower(x), '[^\p{L}\p{N}_]', '', 'g')"
    m = case_map(key, mapping)
    one = f"(CASE WHEN {m} IS NULL THEN x WHEN {m} = '' THEN NULL WHEN {first_upper('x')} THEN {capitalize(m)} ELSE {m} END)"
    out = f"array_to_string(list_filter(list_transform({words}, lambda x: {one}), lambda y: y IS NOT NULL), ' ')"
    out = f"regexp_replace({out}, '(?i)\\bthey needs\\b', 'they need', 'g')"
    out = f"regexp_replace({out}, '\\bcan benefit from to be\\b', 'can benefit from being', 'g')"
    changed = f"len(list_filter({words}, lambda x: coalesce({m} <> '', false))) > 0"
    return f"(CASE WHEN {changed} THEN {collapse(out)} ELSE '' END)"


def neutralize(text: str, words, target: str) -> str:
    toks = f"regexp_extract_all(coalesce({text}, ''), {LOSSLESS})"
    return (f"array_to_string(list_transform({toks}, lambda t: CASE WHEN {is_word('t')} AND lower(t) IN "
            f"{in_list(sorted(set(words)))} THEN {q(target)} ELSE t END), '')")


def ordered_distinct(lst: str) -> str:
    """Distinct list elements in first-occurrence order."""
    return f"list_filter({lst}, lambda x, i: NOT list_contains({lst}[1:i - 1], x))"


def contains_any(tl: str, needles) -> str:
    return "(" + " OR ".join(f"contains({tl}, {q(n)})" for n in needles) + ")"


def suggestions(text: str, words: str, k: int, L) -> str:
    """SQL list of up to k rewrites (templates, neutral replacement, neutralised text,
    fallbacks; polished), mirroring the rewrite operator from its definition."""
    tl = f"lower(coalesce({text}, ''))"
    d = L.COMPONENT_DEFAULTS
    field = "(CASE " + " ".join(f"WHEN contains({tl}, {q(w)}) THEN {q(L.NEUTRAL_REPLACEMENTS.get(w, w))}"
                                for w in L.FIELD_WORDS) + f" ELSE {q(d['field'])} END)"
    role = "(CASE " + " ".join(f"WHEN contains({tl}, {q(w)}) THEN {q(r)}" for w, r in L.ROLE_WORDS) + \
        f" ELSE {q(d['role'])} END)"
    context = "(CASE " + " ".join(f"WHEN contains({tl}, {q(w)}) THEN {q(c)}" for w, c in L.CONTEXT_WORDS) + \
        f" ELSE {q(d['context'])} END)"
    clean_w = r"regexp_replace(lower(w), '[^\p{L}\p{N}_]', '', 'g')"
    found = f"list_filter(list_transform({words}, lambda w: {case_map(clean_w, L.TRAIT_WORDS)}), lambda x: x IS NOT NULL)[1]"
    first = f"{words}[1]"
    from_first = f"coalesce({case_map(f'lower({first})', L.NEUTRAL_REPLACEMENTS)}, {first})"
    skill = f"coalesce({found}, {from_first}, {q(d['skill'])})"
    trait = f"coalesce({found}, {from_first}, {q(d['trait'])})"
    routed = "[" + ", ".join(f"CASE WHEN {contains_any(tl, trig)} THEN {q(cat)} END" for cat, trig in L.ROUTING_TRIGGERS) + "]"
    cats = f"list_filter({routed}, lambda x: x IS NOT NULL)"
    default = "[" + ", ".join(q(c) for c in L.DEFAULT_CATEGORIES) + "]"
    cats = f"(CASE WHEN len({cats}) = 0 THEN {default} ELSE {cats} END)"
    tmap = "(CASE c " + " ".join(
        f"WHEN {q(cat)} THEN [" + ", ".join(q(t) for t in ts[:L.TEMPLATES_PER_CATEGORY]) + "]"
        for cat, ts in L.TEMPLATES.items()) + " END)"
    fill = "t"
    for name, val in (("field", field), ("skill", skill), ("trait", trait), ("role", role), ("context", context)):
        fill = f"replace({fill}, '{{{name}}}', {val})"
    tmpl = f"list_transform(flatten(list_transform({cats}, lambda c: {tmap})), lambda t: {clean_sentence(fill)})"
    rep = neutral_replace(text, L.NEUTRAL_REPLACEMENTS)
    gr = clean_sentence(neutralize(text, L.NEUTRALIZE_WORDS, L.NEUTRALIZE_TARGET))
    none = "CAST([] AS VARCHAR[])"
    fallbacks = "[" + ", ".join(q(f) for f in L.GENERIC_FALLBACKS) + "]"
    extra = (f"list_concat(CASE WHEN {rep} <> '' THEN [{rep}] ELSE {none} END, "
             f"CASE WHEN {gr} <> coalesce({text}, '') THEN [{gr}] ELSE {none} END, {fallbacks})")
    return tmpl, extra


def polish(x: str, L) -> str:
    out = x
    for pat, rep in L.POLISH_REPAIRS:
        out = f"regexp_replace({out}, {q('(?i)' + pat)}, {q(rep)}, 'g')"
    return out
