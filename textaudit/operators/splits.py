"""Unions, seeded order, stratified hold-out and validation splits, quantile binarisation.

The stratified split is exact and reproducible: each row's rank inside its class is given by
``md5('<seed>:' || key)``, and the first ``quota`` rows of each class are held out. Quotas
are the largest-remainder apportionment of ``ceil(n * frac)``.

To avoid sorting a whole class in one task (a class can hold a third of all rows), ranks
are found in two levels: rows are counted per (class, hash bucket) (65,536 buckets from the
first 4 hex digits); bucket prefix sums give each bucket's rank range; only the rows of the
bucket where a quota ends are ranked with a window (see ``rank_segments``).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 4


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Union by column name (bag semantics) with a ``source`` tag; absent columns -> NULL."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def seeded_hash(key, seed: int = 42):
    """Reproducible per-row order key (independent of partitioning, unlike ``rand(seed)``)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Seeded permutation: a global sort by the hash (range-partitioned, no single task)."""
    return df.orderBy(seeded_hash(key, seed), F.col(key))


def largest_remainder(counts: dict, total: int) -> dict:
    """Apportion ``total`` over classes proportionally; remainders go to the largest
    fractional parts, ties to the class that comes first in ``counts``."""
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    exact = {c: v * total / n for c, v in counts.items()}
    base = {c: math.floor(x) for c, x in exact.items()}
    left = total - sum(base.values())
    place = {c: i for i, c in enumerate(counts)}
    order = sorted(counts, key=lambda c: (-(exact[c] - base[c]), place[c]))
    for c in order[:left]:
        base[c] += 1
    return base


_NULL_CLASS = "\u0000null"


def _stratum(label: str):
    """A class as a string; the same expression keys rows and thresholds, whatever its type."""
    return F.coalesce(F.col(label).cast("string"), F.lit(_NULL_CLASS))


def rank_segments(df: DataFrame, key: str, stratum, thresholds: dict, seed: int = 42,
                  out: str = "segment") -> DataFrame:
    """Adds ``out`` = number of class thresholds below each row's rank, where the rank of a
    row inside its stratum follows ``md5('<seed>:' || key)``. With cumulative thresholds
    (t1 < t2 < ...) per stratum, segment 0 holds ranks 1..t1, segment 1 ranks t1+1..t2, ...

    Exact without a stratum-wide sort: rows are counted per (stratum, hash bucket); bucket
    prefix sums give every bucket's rank range; only the rows of buckets that straddle a
    threshold (at most one per threshold and stratum) are ranked, by a window over that
    single bucket. The bucket table (at most 65,536 rows per stratum) joins back; its measured
    size lets AQE broadcast it, and beyond the threshold hash buckets spread the join evenly."""
    x = (df.withColumn("_h", seeded_hash(key, seed)).withColumn("_s", stratum)
         .withColumn("_b", F.substring("_h", 1, BUCKET_HEX)))
    w = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    tmap = F.create_map(*[z for k, ts in thresholds.items()
                          for z in (F.lit(k), F.array(*[F.lit(int(t)) for t in ts]).cast("array<long>"))])
    bt = (x.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
          .withColumn("_cum", F.sum("_c").over(w))
          .withColumn("_before", F.col("_cum") - F.col("_c"))
          .withColumn("_t", F.coalesce(F.try_element_at(tmap, F.col("_s")),
                                       F.raise_error(F.concat(F.lit("class without a quota: "), F.col("_s"))).cast("array<long>")))
          .withColumn("_exact", F.exists("_t", lambda t: (F.col("_before") < t) & (t < F.col("_cum")))))
    y = x.join(bt.select("_s", "_b", "_before", "_cum", "_t", "_exact"), ["_s", "_b"])
    rk = Window.partitionBy("_s", "_b").orderBy("_h", key)
    exact = y.where("_exact").withColumn("_rank", F.col("_before") + F.row_number().over(rk))
    rest = y.where(~F.col("_exact")).withColumn("_rank", F.col("_cum"))
    seg = F.size(F.filter("_t", lambda t: F.col("_rank") > t))
    cols = df.columns
    return exact.unionByName(rest).select(*cols, seg.alias(out))


MAX_CLASSES = 100_000


def _class_counts(df: DataFrame, label: str) -> dict:
    """Rows by class (as :func:`_stratum` names it). Apportioning happens on the driver, so a
    column of more than ``MAX_CLASSES`` values is refused: it holds ids, not classes."""
    rows = df.groupBy(_stratum(label).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.first(label).alias("value")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} distinct values; not a class column")
    order = sorted(rows, key=lambda r: (r["value"] is None, r["value"] if r["value"] is not None else 0))
    return {r["c"]: r["n"] for r in order}


def stratified_holdout(df: DataFrame, key: str, label: str, frac: float, seed: int = 42,
                       stratify: bool = True) -> DataFrame:
    """Adds ``held_out BOOLEAN``: ``ceil(n * frac)`` rows, classes proportional (largest
    remainder), each class's first rows in seeded-hash order.

    Stratification is skipped when there is a single class (or ``stratify`` is False)."""
    counts = _class_counts(df, label)
    strat = stratify and len([c for c in counts if c != _NULL_CLASS]) > 1
    by_class = counts if strat else {"0": sum(counts.values())}
    n = sum(by_class.values())
    quotas = largest_remainder(by_class, math.ceil(n * frac - 1e-12))
    stratum = _stratum(label) if strat else F.lit("0")
    thresholds = {c: [q] for c, q in quotas.items()}
    r = rank_segments(df, key, stratum, thresholds, seed, "_seg")
    return r.withColumn("held_out", F.col("_seg") == 0).drop("_seg")


def train_val_test(df: DataFrame, key: str, label: str, test_frac: float = 0.10, val_frac: float = 0.10,
                   seed: int = 42) -> DataFrame:
    """Adds ``split``: a stratified test hold-out, then a stratified validation split of the
    remaining pool (same seed).

    Both splits rank rows by the same seeded hash inside a class, so the pool's order is the
    class order without its first rows: the two splits are one pass with two cumulative
    thresholds per class. When the pool would no longer be stratified (one class left),
    the second split runs on the pool itself."""
    counts = _class_counts(df, label)
    strat = len([c for c in counts if c != _NULL_CLASS]) > 1
    by_class = counts if strat else {"0": sum(counts.values())}
    n = sum(by_class.values())
    q1 = largest_remainder(by_class, math.ceil(n * test_frac - 1e-12))
    pool = {c: by_class[c] - q1[c] for c in by_class}
    pool_classes = [c for c, v in pool.items() if v > 0 and c != _NULL_CLASS]
    if strat and len(pool_classes) <= 1:
        t = stratified_holdout(df, key, label, test_frac, seed)
        test = t.where("held_out").drop("held_out").withColumn("split", F.lit("test"))
        rest = stratified_holdout(t.where(~F.col("held_out")).drop("held_out"), key, label, val_frac, seed)
        rest = rest.withColumn("split", F.when(F.col("held_out"), "val").otherwise("train")).drop("held_out")
        return test.unionByName(rest)
    p_n = sum(pool.values())
    q2 = largest_remainder({c: v for c, v in pool.items() if v > 0}, math.ceil(p_n * val_frac - 1e-12))
    thresholds = {c: [q1[c], q1[c] + q2.get(c, 0)] for c in by_class}
    stratum = _stratum(label) if strat else F.lit("0")
    r = rank_segments(df, key, stratum, thresholds, seed, "_seg")
    split = F.when(F.col("_seg") == 0, "test").when(F.col("_seg") == 1, "val").otherwise("train")
    return r.withColumn("split", split).drop("_seg")


def exact_quantiles(df: DataFrame, score: str, probs, partitions: int | None = None) -> list[float]:
    """Exact interpolated quantiles (the ``quantile_cont`` / ``percentile`` definition)
    without holding all values in one task.

    The value histogram (one row per distinct value, map-side combined) is range-partitioned
    and checkpointed, so partition ids are stable; per-partition totals (one row per
    partition) give each partition's rank offset; a running sum inside each partition gives
    every value's rank range; only the rows holding the wanted ranks reach the driver."""
    from ..session import cut_lineage
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hist = (df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v"))
            .agg(F.count(F.lit(1)).alias("c")))
    ranged = cut_lineage(hist.repartitionByRange(parts, "v").withColumn("pid", F.spark_partition_id()))
    totals = sorted((r["pid"], r["n"]) for r in ranged.groupBy("pid").agg(F.sum("c").alias("n")).collect())
    n = sum(t for _, t in totals)
    if n == 0:
        return [None for _ in probs]
    offsets, acc = {}, 0
    for pid, t in totals:
        offsets[pid] = acc
        acc += t
    omap = F.create_map(*[z for pid, o in offsets.items() for z in (F.lit(pid), F.lit(int(o)))])
    w = Window.partitionBy("pid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    cum = ranged.withColumn("_end", F.try_element_at(omap, F.col("pid")) + F.sum("c").over(w))
    cum = cum.withColumn("_start", F.col("_end") - F.col("c"))
    wanted = sorted({math.floor((n - 1) * p) for p in probs} | {math.ceil((n - 1) * p) for p in probs})
    hit = F.lit(False)
    for r in wanted:
        hit = hit | ((F.col("_start") <= r) & (F.lit(r) < F.col("_end")))
    rows = [(x["v"], x["_start"], x["_end"]) for x in cum.where(hit).select("v", "_start", "_end").collect()]

    def at(rank: int) -> float:
        return next(v for v, a, b in rows if a <= rank < b)

    out = []
    for p in probs:
        h = (n - 1) * p
        lo, hi = math.floor(h), math.ceil(h)
        out.append(at(lo) + (h - lo) * (at(hi) - at(lo)))
    return out


def quantile_cuts(df: DataFrame, score: str, lo: float = 0.2, hi: float = 0.8) -> tuple[float, float]:
    """The two cut points of :func:`quantile_binarize` (exact, distributed)."""
    q_lo, q_hi = exact_quantiles(df, score, [lo, hi])
    return float(q_lo), float(q_hi)


def quantile_binarize(df: DataFrame, score: str, lo: float = 0.2, hi: float = 0.8) -> DataFrame:
    """Top share -> class 2 / binary 1, bottom share -> class 0 / binary 0, middle -> class 1 /
    binary NULL. The two cut points are scalars, inlined as literals (no join)."""
    q_lo, q_hi = quantile_cuts(df, score, lo, hi)
    s = F.col(score)
    multi = F.when(s >= q_hi, 2).when(s <= q_lo, 0).otherwise(1)
    binary = F.when(s >= q_hi, 1).when(s <= q_lo, 0)
    return df.withColumn("q_low", F.lit(q_lo)).withColumn("q_high", F.lit(q_hi)) \
             .withColumn("label_multiclass", multi.cast("int")).withColumn("label_binary", binary.cast("int"))
