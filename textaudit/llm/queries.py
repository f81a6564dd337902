"""Registered queries of the operators (contract columns derived from the operators' own
results) and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, licences, merkle, mixing, pii, quality, urls, weaklabels
from .align import align
from .decontaminate import decontaminate
from .frames import documents
from .language import fold, learn, predict
from .simhash import near_duplicates
from .tokencount import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination of all documents."""
    found = decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE["op1_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w
      FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a model of those outside the held-out third."""
    docs = documents(spark, sf_dir)
    model = learn(docs.where(F.col("doc_id").isNotNull() & ~fold(F.col("doc_id"))))
    return predict(docs, model, keep=["doc_id"]).select("doc_id", fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: base spans counted and digested, all spans listed."""
    found = pii.find(documents(spark, sf_dir), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    of = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(pii.BASE)]
    return found.select("doc_id", *of, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed so that every source has the same share."""
    return mixing.mix(documents(spark, sf_dir))


ORACLE["op10_mixing"] = f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
rates AS (SELECT source, CAST(sum(n) OVER () AS DOUBLE) * 1.0 / CAST(count(*) OVER () AS DOUBLE) / n AS r FROM counts),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c
        FROM (SELECT source, k, exp(-r + k * ln(r) - lgamma(k + 1)) AS p
              FROM (SELECT source, r, unnest(range(0, CAST(ceil(r + 12 * sqrt(r) + 30) AS BIGINT) + 1)) AS k FROM rates))),
drawn AS (SELECT *, (CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5)
                    / 4503599627370496.0 AS u FROM documents),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND c < d.u) AS reps FROM drawn d)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, reps + 1)) AS INTEGER) AS copy FROM counted
"""


#: Rules of the url query: longest first fits, subdomains included.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: by rule, else by its host's path templates."""
    return urls.judge(documents(spark, sf_dir, "pages"), documents(spark, sf_dir, "labels"), URL_RULES)


#: The conversation that the chat query adds: control strings inside its texts.
PLANTED_CHAT = "\\### Assistant: </turn> ok"


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, formatted and read back."""
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED_CHAT).alias("text"))
    done = chat.format_chats(turns.unionByName(extra))
    back = done.withColumns({"turns": chat.read_turns(F.col("formatted")), "trained": chat.trained_text(F.col("segments"))})
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"), F.sha2(F.col("trained"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", F.coalesce("bad_turn", F.lit(-1)).alias("bad_turn"))


def _escaped(text: str) -> str:
    for plain, pair in chat.PAIRS:
        text = f"replace({text}, '{plain}', '{pair}')"
    return text


ORACLE["op6_chat"] = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PLANTED_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED_CHAT}'),
p AS (SELECT *, row_number() OVER w - 1 AS i, lag(role) OVER w AS before, count(*) OVER (PARTITION BY conv_id) AS n
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
q AS (SELECT *, NOT CASE role WHEN 'system' THEN i = 0 WHEN 'user' THEN i = 0 OR before = 'assistant' OR (before = 'system' AND i = 1)
                          WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END AS bad FROM p)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || upper(role[1]) || role[2:] || ': </turn>') + 1 + length({_escaped('text')})) AS BIGINT) AS formatted_chars,
       NOT bool_or(bad) AND max_by(role, i) = 'assistant' AS valid, CAST(coalesce(min(i) FILTER (bad), -1) AS INTEGER) AS bad_turn
FROM q GROUP BY conv_id
"""


@query
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and risk-controlled cutoffs by language over all documents."""
    judged = quality.judge(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.concat_ws(",", "failed").alias("failed"))


@query
def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and templates in all documents."""
    found = licences.scan(documents(spark, sf_dir), keep=["doc_id"])
    both = F.array_sort(F.array_union("base_labels", "found_labels"))
    return found.select(
        "doc_id", "n_words", F.size("base_starts").cast("bigint").alias("n_base"), F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"), F.concat_ws(",", "base_labels").alias("base_labels"),
        F.concat_ws(",", both).alias("labels"), "score")


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak-label quality classifier, fitted on and applied to all documents."""
    return weaklabels.classify(documents(spark, sf_dir), keep=["doc_id"]).select("doc_id", "n_words", "votes", "posterior", "score", "kept")


def seventh(doc_id):
    """Ids whose claims are tampered with: the crc32 of the decimal id is a multiple of 7."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0, F.lit(False))


@query
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by language, and the check of a claim about each."""
    proved = merkle.prove(documents(spark, sf_dir), seventh(F.col("doc_id")))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                         "folded_root", "verified")


def _encoded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _levels(name: str, start: str) -> str:
    """Nodes of all levels of trees: ``m`` is the number of nodes of the level."""
    return f"""{name} AS ({start} UNION ALL
SELECT tree, lvl + 1, idx // 2, sha256(string_agg(node, '' ORDER BY idx)), (any_value(m) + 1) // 2 FROM {name} WHERE m > 1 GROUP BY tree, lvl, idx // 2)"""


def _steps(leaves: str, nodes: str, ends: str) -> str:
    return f"""SELECT r.rid, {ends} AS step, (r.idx >> v.lvl) & 1 AS odd, s.node AS sib FROM {leaves} r
JOIN (SELECT DISTINCT tree, lvl FROM {nodes} WHERE m > 1) v ON v.tree = r.tree
LEFT JOIN {nodes} s ON s.tree = r.tree AND s.lvl = v.lvl AND s.idx = xor(r.idx >> v.lvl, 1)"""


ORACLE["op13_merkle"] = f"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '') AS tree, coalesce(xor(4294967295, list_reduce(
    flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384), 4294967295::BIGINT)) % 7 = 0, false) AS tampered FROM documents),
l AS (SELECT *, {" || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))} AS plain,
             {" || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "(n_chars + CASE WHEN tampered THEN 1 ELSE 0 END)", "text"))} AS said FROM d),
r AS MATERIALIZED (SELECT doc_id, tree, sha256(plain) AS leaf, sha256(said) AS claim, count(*) OVER (PARTITION BY tree) AS n,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS idx, row_number() OVER () AS rid FROM l),
{_levels("t", "SELECT tree, 0 AS lvl, idx, leaf AS node, n AS m FROM r")},
g AS MATERIALIZED (SELECT '' AS tree, tree AS name, node AS leaf, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, row_number() OVER () AS rid
      FROM t WHERE m = 1),
{_levels("u", "SELECT tree, 0 AS lvl, idx, leaf AS node, n AS m FROM g")},
up AS ({_steps("g", "u", "v.lvl")}),
high AS (SELECT tree, max(lvl) AS h FROM t GROUP BY 1),
p AS MATERIALIZED ({_steps("r", "t", "v.lvl")} UNION ALL
      SELECT r.rid, high.h + up.step, up.odd, up.sib FROM r JOIN high USING (tree) JOIN g ON g.name = r.tree JOIN up ON up.rid = g.rid),
f(rid, step, here) AS (SELECT rid, 0, claim FROM r UNION ALL
      SELECT f.rid, f.step + 1, sha256(CASE WHEN p.sib IS NULL THEN f.here WHEN p.odd = 1 THEN p.sib || f.here ELSE f.here || p.sib END)
      FROM f JOIN p ON p.rid = f.rid AND p.step = f.step),
e AS (SELECT rid, arg_max(here, step) AS folded_root FROM f GROUP BY 1),
q AS (SELECT rid, string_agg(sib, '' ORDER BY step) AS sibs FROM p WHERE sib IS NOT NULL GROUP BY 1)
SELECT r.doc_id, r.leaf, g.leaf AS subroot, (SELECT node FROM u WHERE m = 1) AS root, sha256(coalesce(q.sibs, '')) AS proof_sha256,
       e.folded_root, e.folded_root = (SELECT node FROM u WHERE m = 1) AS verified
FROM r JOIN g ON g.name = r.tree JOIN e ON e.rid = r.rid LEFT JOIN q ON q.rid = r.rid
"""


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the word-end vocabulary."""
    return count_tokens(documents(spark, sf_dir), ["doc_id"], public_tokenizers.path("word_bpe_49k.json"))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, aligned by the groups they share."""
    return align(documents(spark, sf_dir), ["doc_id"], public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
