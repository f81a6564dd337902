"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of weight ``w`` and ``n`` documents has the rate ``total * w / sum(w) / n``. Each
document inverts the Poisson distribution of that mean at a number in (0, 1) that its hash
gives, is repeated that often, and all copies are shuffled by a hash of document and copy.
Documents without an id, which are different documents, are told apart by their other columns,
identical ones by a running number."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import dropping, position, save

#: Sources whose rates and distributions (at most 200 numbers each) are broadcast; more are joined.
BROADCAST_SOURCES = 20_000
#: Up to this rate a source has its whole distribution; beyond, each document searches from the mode.
LARGE = 64.0
#: Ids of more than ``rows / FREQUENT`` rows (and more than ``BLOCK``) are spread like missing ids;
#: identical rows are numbered ``BLOCK`` at a time.
FREQUENT, BLOCK = 10_000, 1_000
SEED = "mix-1"


def unit(*parts: Column) -> Column:
    """Number in (0, 1) from the first 52 bits of the md5 of the parts (null: empty)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / F.lit(float(1 << 52))


def distribution(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, ... far into the tail, by logarithms (no
    underflow for large rates)."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    log = F.log(F.greatest(rate, F.lit(1e-300)))
    begun = F.struct((-rate).alias("p"), F.array(F.exp(-rate)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), last), begun, lambda acc, k: F.struct(
        (acc["p"] + log - F.log(k.cast("double"))).alias("p"),
        F.concat(acc["out"], F.array(F.element_at(acc["out"], -1) + F.exp(acc["p"] + log - F.log(k.cast("double"))))).alias("out")))["out"]


def reach(rate: Column) -> Column:
    """Steps from the mode that hold all of a Poisson distribution but a negligible tail."""
    return F.ceil(12 * F.sqrt(rate) + 30).cast("int")


def at_mode(rate: Column) -> Column:
    """``(mode, p, c)``: the mode of a Poisson distribution of a rate above ``LARGE``, its
    probability (saddle point and Stirling's series) and the cumulative probability up to it."""
    mode = F.floor(rate).cast("double")
    x = (rate - mode) / mode
    series = 1 / (12 * mode) - 1 / (360 * F.pow(mode, F.lit(3))) + 1 / (1260 * F.pow(mode, F.lit(5)))
    p = F.exp(-series - mode * (x - F.log1p(x))) / F.sqrt(2 * F.pi() * mode)
    summed = F.aggregate(F.sequence(F.lit(0), reach(rate)), F.struct(p.alias("p"), F.lit(0.0).alias("c")), lambda acc, j: F.struct(
        (acc["p"] * F.greatest(mode - j, F.lit(0.0)) / rate).alias("p"), (acc["c"] + acc["p"]).alias("c")))["c"]
    return F.struct(mode.alias("mode"), p.alias("p"), summed.alias("c"))


def searched(u: Column, rate: Column, top: Column) -> Column:
    """The Poisson count at ``u``, found step by step from the mode (``top`` of ``at_mode``): no
    table, and fewer steps than copies are made."""
    begun = F.struct(top["mode"].alias("k"), top["p"].alias("p"), top["c"].alias("c"), u.alias("u"))
    steps = F.sequence(F.lit(0), reach(rate))
    kept = lambda acc: F.struct(acc["k"].alias("k"), acc["p"].alias("p"), acc["c"].alias("c"), acc["u"].alias("u"))

    def up(acc: Column, _: Column) -> Column:
        p = acc["p"] * rate / (acc["k"] + 1)
        return F.when(acc["c"] < acc["u"], F.struct((acc["k"] + 1).alias("k"), p.alias("p"), (acc["c"] + p).alias("c"), acc["u"].alias("u"))).otherwise(kept(acc))

    def down(acc: Column, _: Column) -> Column:
        left = F.struct((acc["k"] - 1).alias("k"), (acc["p"] * acc["k"] / rate).alias("p"), (acc["c"] - acc["p"]).alias("c"), acc["u"].alias("u"))
        return F.when((acc["k"] > 0) & (acc["c"] - acc["p"] >= acc["u"]), left).otherwise(kept(acc))

    return F.when(u > top["c"], F.aggregate(steps, begun, up)["k"]).otherwise(F.aggregate(steps, begun, down)["k"]).cast("int")


def rates(docs: DataFrame, weights: Mapping[str, float] | None, source: str, default: float, total: float | None) -> tuple[DataFrame, int, int, float]:
    """``(_source, _rate, _cdf, _top)`` of each source (``_cdf`` for rates up to ``LARGE``, else
    ``_top``), how many there are, the number of rows, and the highest rate."""
    counts = docs.groupBy(source).agg(F.count("*").alias("n"))
    weight = F.lit(float(default))
    if weights:
        weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]),
                                             F.coalesce(F.col(source).cast("string"), F.lit(""))), weight)
    counts = save(counts.select(F.col(source).alias("_source"), "n", weight.alias("w")), "sources")
    n, rows, mass, steep = counts.agg(F.count("*"), F.sum("n"), F.sum("w"), F.max(F.col("w") / F.col("n"))).first()
    wanted = float(rows or 0 if total is None else total)
    rate = F.lit(wanted) * F.col("w") / F.lit(float(mass or 1)) / F.col("n")
    table = counts.select("_source", rate.alias("_rate"))
    return table.withColumns({"_cdf": F.when(F.col("_rate") <= LARGE, distribution(F.least("_rate", F.lit(LARGE)))),
                              "_top": F.when(F.col("_rate") > LARGE, at_mode(F.col("_rate")))}), n, rows or 0, wanted * (steep or 0) / float(mass or 1)


def repeated(drawn: DataFrame, most: float) -> DataFrame:
    """``drawn`` with ``copy``, from 1 to ``_k``, a row each. Where a source's rate (at most
    ``most``) can give a document more than ``BLOCK`` copies, its documents are dealt out in blocks
    of that many copies first, so that no task makes all copies of one document."""
    numbers = lambda first, last: F.explode(F.sequence(first, last)).alias("copy")
    rest = [c for c in drawn.columns if c not in ("_k", "_rate")]
    many = F.col("_rate") + reach(F.col("_rate")) > BLOCK
    if most + 12 * most ** 0.5 + 31 <= BLOCK:
        return drawn.select(*rest, numbers(F.lit(1), F.col("_k")))
    blocks = drawn.where(many).select(*rest, "_k", F.explode(F.sequence(F.lit(0), F.expr(f"(_k - 1) div {BLOCK}").cast("int"))).alias("_block"))
    # a number of its own: the rows are few and small until they are repeated, and would be put together
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.repartition(parts, "_h", "_same", "_block")
    begin = F.col("_block") * BLOCK
    return drawn.where(~many).select(*rest, numbers(F.lit(1), F.col("_k"))).unionByName(
        dealt.select(*rest, numbers(begin + 1, F.least("_k", begin + BLOCK))))


def numbered(rows: DataFrame, doc_id: str, columns: list[str], total: int) -> DataFrame:
    """``columns``, ``_h`` (hash of the row) and ``_same``: 0, but for rows without an id or with
    a very frequent one a number from 1 that tells identical rows apart. Those are counted first
    and repeated block by block, so that no task holds all of them."""
    ids = rows.groupBy(F.col(doc_id).alias("_id")).agg(F.count("*").alias("_n"))
    ids = save(ids.where(F.col("_id").isNull() | (F.col("_n") > max(BLOCK, total / FREQUENT))).select("_id"), "frequent-ids")
    rows = rows.select(*columns, F.xxhash64(*[c for c in columns if "map<" not in rows.schema[c].dataType.simpleString()]).alias("_h"))
    if ids.isEmpty():
        return rows.withColumn("_same", F.lit(0).cast("bigint"))
    fits = F.col(doc_id).eqNullSafe(F.col("_id"))
    named = rows.join(F.broadcast(ids), fits, "left_anti").withColumn("_same", F.lit(0).cast("bigint"))
    counts = rows.join(F.broadcast(ids), fits, "left_semi").groupBy(*columns, "_h").agg(F.count("*").alias("_n"))
    blocks = counts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_n - 1) div {BLOCK}"))))
    numbers = F.sequence(F.col("_block") * BLOCK + 1, F.least("_n", (F.col("_block") + 1) * BLOCK))
    return named.unionByName(blocks.repartition("_h", "_block").withColumn("_same", F.explode(numbers)).drop("_n", "_block"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, doc_id: str = "doc_id", source: str = "source",
        default: float = 1.0, total: float | None = None, seed: str = SEED) -> DataFrame:
    """The columns of ``docs`` and ``copy`` (from 1), a row for each copy, in shuffled order.

    ``weights`` by source; one that is not listed has ``default`` (so by default every source
    gets the same share); ``total`` is the size aimed at (default: the rows there are). A null
    source is a source (listed under the empty string). Rows with the same id get the same
    number; rows without an id get one each, by their columns and, if those are equal, by a
    running number; an empty table stays empty. A column named ``copy`` is replaced."""
    columns = dropping(docs, ["copy"])
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    where = {c: f"_c{position(docs, c)}" for c in {*columns, doc_id, source}}
    table, n, rows, most = rates(plain, weights, where[source], default, total)
    table = F.broadcast(table) if n <= BROADCAST_SOURCES else table
    told = numbered(plain, where[doc_id], sorted(set(where.values())), rows)
    drawn = told.join(table, F.col(where[source]).eqNullSafe(F.col("_source")))
    own = F.col(where[doc_id])
    u = F.when(own.isNull(), unit(F.lit(seed), own, F.col("_h"), F.col("_same"))).otherwise(unit(F.lit(seed), own))
    often = F.when(F.col("_rate") <= LARGE, F.size(F.filter("_cdf", lambda p: p < u))).otherwise(searched(u, F.col("_rate"), F.col("_top")))
    drawn = drawn.withColumn("_k", often).where("_k > 0")
    place = unit(F.lit(seed), F.lit("order"), F.col("_id"), F.col("_h"), F.col("_same"), F.col("copy"))
    drawn = drawn.select(*[F.col(where[c]).alias(f"_o{i}") for i, c in enumerate(columns)], own.alias("_id"), "_h", "_same", "_k", "_rate")
    copies = repeated(drawn, most)
    mixed = copies.withColumn("_at", place).drop("_id", "_h", "_same")
    return mixed.repartition("_at").sortWithinPartitions("_at").select(*[F.col(f"_o{i}").alias(c) for i, c in enumerate(columns)], F.col("copy"))
