"""Neutral rewrites of a text: component extraction, category routing, template rendering,
neutral word replacement, gender-word neutralisation, generic fallbacks and polishing.

Everything is a column expression over the row's own text and attribution words, so a
corpus of any size is rewritten in one narrow stage (no shuffle, no Python). The list
is bounded by construction: ``slice(array_distinct(...), 1, k)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as L
from ..functions import text as TX
from . import attribution as AT


def _lower(text) -> Column:
    return F.lower(F.coalesce(TX.col_(text), F.lit("")))


def components(text, words: Column) -> dict[str, Column]:
    """field / skill / trait / role / context for the templates."""
    tl = _lower(text)
    d = L.COMPONENT_DEFAULTS
    field = F.lit(d["field"])
    for w in reversed(L.FIELD_WORDS):
        field = F.when(F.contains(tl, F.lit(w)), F.lit(L.NEUTRAL_REPLACEMENTS.get(w, w))).otherwise(field)
    role = F.lit(d["role"])
    for w, r in reversed(L.ROLE_WORDS):
        role = F.when(F.contains(tl, F.lit(w)), F.lit(r)).otherwise(role)
    context = F.lit(d["context"])
    for w, c in reversed(L.CONTEXT_WORDS):
        context = F.when(F.contains(tl, F.lit(w)), F.lit(c)).otherwise(context)
    traits = TX.literal_map(L.TRAIT_WORDS)
    found = F.try_element_at(
        F.filter(F.transform(words, lambda w: F.try_element_at(traits, TX.strip_non_word(F.lower(w)))),
                 lambda x: x.isNotNull()), F.lit(1))
    repl = TX.literal_map(L.NEUTRAL_REPLACEMENTS)
    first = F.try_element_at(words, F.lit(1))
    from_first = F.coalesce(F.try_element_at(repl, F.lower(first)), first)
    skill = F.coalesce(found, from_first, F.lit(d["skill"]))
    trait = F.coalesce(found, from_first, F.lit(d["trait"]))
    return {"field": field, "skill": skill, "trait": trait, "role": role, "context": context}


def route_categories(text) -> Column:
    """Template categories triggered by substrings, in fixed order; a default list when
    none triggers."""
    tl = _lower(text)
    hits = F.array(*[F.when(TX.contains_any(tl, trig), F.lit(cat)) for cat, trig in L.ROUTING_TRIGGERS])
    got = F.filter(hits, lambda x: x.isNotNull())
    return F.when(F.size(got) == 0, TX.literal_array(L.DEFAULT_CATEGORIES)).otherwise(got)


def render_templates(categories: Column, comp: dict[str, Column]) -> Column:
    """First templates of each routed category, filled and cleaned, in category order."""
    tmap = F.create_map(*[z for cat, ts in L.TEMPLATES.items()
                          for z in (F.lit(cat), TX.literal_array(ts[:L.TEMPLATES_PER_CATEGORY]))])
    flat = F.flatten(F.transform(categories, lambda c: F.try_element_at(tmap, c)))
    return F.transform(flat, lambda t: TX.clean_sentence(TX.fill_template(t, comp)))


def neutral_replace(text, replacements: dict | None = None) -> Column:
    """Whitespace words whose letters (lower-cased, non-word characters removed) are in the
    map are replaced (capitalised when the word starts upper-case) or deleted ("").
    Attached punctuation of a replaced word is lost. The result is "" unless at least one
    non-empty replacement happened. Two phrase repairs follow, then whitespace cleanup."""
    rmap = TX.literal_map(replacements or L.NEUTRAL_REPLACEMENTS)
    words = TX.whitespace_split(F.coalesce(TX.col_(text), F.lit("")))

    def key(w):
        return TX.strip_non_word(F.lower(w))

    def one(w):
        r = F.try_element_at(rmap, key(w))
        return (F.when(r.isNull(), w).when(r == "", F.lit(None))
                .when(TX.starts_upper(w), TX.capitalize(r)).otherwise(r))

    changed = F.exists(words, lambda w: F.coalesce(F.try_element_at(rmap, key(w)) != "", F.lit(False)))
    out = F.array_join(F.filter(F.transform(words, one), lambda x: x.isNotNull()), " ")
    for pat, rep, ci in L.REPLACEMENT_REPAIRS:
        out = F.regexp_replace(out, ("(?iU)" if ci else "(?U)") + pat, rep)
    out = TX.collapse_space(out)
    return F.when(changed, out).otherwise(F.lit(""))


def neutralize_gender_words(text, words=None, target: str = L.NEUTRALIZE_TARGET) -> Column:
    """Whole words in the list (any case) become ``target``; word identity by token, so
    accented neighbours do not create false word boundaries."""
    lex = TX.literal_array(sorted(set(words or L.NEUTRALIZE_WORDS)))
    toks = TX.lossless_tokens(text)
    return F.array_join(F.transform(toks, lambda t: F.when(TX.is_word(t) & F.array_contains(lex, F.lower(t)),
                                                           F.lit(target)).otherwise(t)), "")


def polish(s: Column) -> Column:
    out = s
    for pat, rep in L.POLISH_REPAIRS:
        out = F.regexp_replace(out, "(?iU)" + pat, rep.replace("\\1", "$1"))
    return out


def add_suggestions(df: DataFrame, text: str, words: str, k: int = 3, out: str = "suggestions") -> DataFrame:
    """Adds up to ``k`` distinct rewrites: templates, then the neutral replacement, then the
    neutralised text (if it differs from the input), then generic fallbacks; polished.

    Intermediate results are materialised as columns in successive projections and kept
    until the end, so the optimizer does not inline a whole-text expression into the
    per-element lambdas that consume it. The whole-text rewrites are computed only for rows
    whose earlier candidates do not already fill the ``k`` places (``CASE`` branches are
    evaluated lazily), which leaves the result unchanged."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    s1 = df.select("*", route_categories(text).alias("_cf_cats"))
    comp = components(text, F.col(words))
    s2 = s1.select("*", *[c.alias("_cf_" + n) for n, c in comp.items()])
    comp_cols = {n: F.col("_cf_" + n) for n in comp}
    s3 = s2.select("*", render_templates(F.col("_cf_cats"), comp_cols).alias("_cf_tmpl"))
    need_rep = F.size(F.array_distinct("_cf_tmpl")) < k
    s4 = s3.select("*", F.when(need_rep, neutral_replace(text)).otherwise(F.lit("")).alias("_cf_rep"))
    so_far = F.concat(F.col("_cf_tmpl"), F.when(F.col("_cf_rep") != "", F.array("_cf_rep")).otherwise(none))
    need_gr = F.size(F.array_distinct(so_far)) < k
    s5 = s4.select("*", F.when(need_gr, TX.clean_sentence(neutralize_gender_words(text))).alias("_cf_gr"))
    extra = F.concat(F.when(F.col("_cf_rep") != "", F.array("_cf_rep")).otherwise(none),
                     F.when(F.col("_cf_gr").isNotNull() & (F.col("_cf_gr") != t), F.array("_cf_gr")).otherwise(none),
                     TX.literal_array(L.GENERIC_FALLBACKS))
    s6 = s5.select("*", F.slice(F.array_distinct(F.concat(F.col("_cf_tmpl"), extra)), 1, k).alias("_cf_base"))
    s7 = s6.select("*", F.slice(F.array_distinct(F.transform(F.col("_cf_base"), lambda x: TX.clean_sentence(polish(x)))),
                                1, k).alias(out))
    return s7.select(*[c for c in s7.columns if not c.startswith("_cf_")])


def _with_words(df: DataFrame, text: str, weights: dict | None) -> DataFrame:
    return df.select("*", AT.top_words(df, text=text, weights=weights).alias("_words"))


def counterfactuals(df: DataFrame, key: str = "doc_id", text: str = "text", weights: dict | None = None,
                    k: int = 3) -> DataFrame:
    """``(key, rank, suggestion)``; attribution words are the top keyword attributions."""
    s = add_suggestions(_with_words(df.select(key, text), text, weights), text, "_words", k)
    return s.select(key, TX.explode_rows(F.col("suggestions"), pos=True).alias("i", "suggestion")).where(
        F.col("suggestion").isNotNull()).select(key, (F.col("i") + 1).alias("rank"), "suggestion")


def rescore_rewrites(df: DataFrame, model, key: str = "doc_id", text: str = "text",
                     weights: dict | None = None, k: int = 3) -> DataFrame:
    """Score every rewrite with the same scorer; ``delta`` = rewrite score - original score,
    ``lower`` marks rewrites that reduce it."""
    base = df.select(key, text, model.proba(TX.word_tokens(text)).alias("p0"))
    s = add_suggestions(_with_words(base, text, weights), text, "_words", k)
    ex = s.select(key, "p0", TX.explode_rows(F.col("suggestions"), pos=True).alias("i", "suggestion")).where(
        F.col("suggestion").isNotNull())
    p1 = model.proba(TX.word_tokens("suggestion"))
    scored = ex.select(key, (F.col("i") + 1).alias("rank"), "suggestion", "p0", p1.alias("p1"))
    delta = F.round(F.col("p1") - F.col("p0"), 6)
    return scored.select(key, "rank", "suggestion", F.round("p0", 6).alias("proba_original"), F.round("p1", 6).alias("proba_rewrite"),
                         delta.alias("delta"), (delta < 0).alias("lower"))


def full_audit(df: DataFrame, model, key: str = "doc_id", text: str = "text", weights: dict | None = None,
               k: int = 3, threshold: float = 0.5) -> DataFrame:
    """One record per document: probability, class, confidence, top words with scores and
    rewrites. All parts are functions of the row, so this is a single narrow stage."""
    weights = weights or L.KEYWORD_WEIGHTS
    toks = TX.word_tokens(text)
    a = df.select(key, text, toks.alias("_tok"))
    b = a.select(key, text, model.proba(F.col("_tok")).alias("proba"),
                 AT.keyword_scores_array(F.col("_tok"), weights, L.KEYWORD_TOP_K).alias("_top"), "_tok")
    c = b.select(key, text, "proba", "_top",
                 F.transform(F.slice("_top", 1, L.ATTRIBUTION_WORDS_FOR_COMPONENTS), lambda s: s["word"]).alias("_words"))
    d = add_suggestions(c, text, "_words", k)
    p = F.col("proba")
    return d.select(
        key, F.round("proba", 6).alias("proba"), F.when(p > threshold, "BIASED").otherwise("NEUTRAL").alias("bias_class"),
        F.round(F.greatest(p, 1 - p), 6).alias("confidence"),
        F.transform("_top", lambda s: F.struct(s["word"].alias("word"), (-s["neg"]).alias("score"))).alias("top_words"),
        "suggestions")
