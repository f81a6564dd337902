"""Connected components of a link table by alternating large-star and small-star steps: every
step is a grouped minimum and a join on the node, so the work follows the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import release, save


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` -> ``(node, root)`` for every node that is not its component's smallest;
    ``root`` is that smallest node. Links of a node with itself or with null say nothing."""
    at = save(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while (now := _signature(at)) != before:
        before, last = now, at
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        at = save(small.select("e.*").where("u != v").distinct(), "links")
        release(last)
    return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
