"""Ranks and prefix sums of a whole table or of large groups, without a task that holds a group.

Rows are dealt in ranges of their order, each of about ``range_rows`` rows however many there are;
a small table has the sums of whole ranges, and only inside a range are single rows ordered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import saved_table

RANGE_ROWS = 200_000


def range_prefix(df: DataFrame, by, order, sums: dict[str, Column], range_rows: int = RANGE_ROWS, ranges: int | None = None) -> DataFrame:
    """``df`` with ``sums``: each a sum of its expression over the rows of the same ``by`` that come
    earlier in ``order``, 0 for the first. ``by`` and ``order`` together must tell rows apart; null
    is a group of its own. ``ranges`` fixes their number (default: rows / ``range_rows``)."""
    by = list(by)
    rows = saved_table(df.withColumns({f"_x{i}": x for i, x in enumerate(sums.values())}), "rows")
    if ranges is None:
        ranges = max(1, -(-rows.count() // range_rows))
    if ranges > 1:
        rows = saved_table(rows.repartitionByRange(ranges, *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        rows = rows.withColumn("_range", F.lit(0))
    own = [f"_x{i}" for i in range(len(sums))]
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*by, "_range").agg(*[F.sum(x).alias(x) for x in own])
    whole = whole.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate([*by, "_range"])],
                         *[F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_before") for x in own])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = rows.withColumns({f"{x}_in": F.coalesce(F.sum(x).over(inside), F.lit(0)) for x in own})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate([*by, "_range"])])
    return within.join(whole, same).select(*df.columns, *[(F.col(f"{x}_before") + F.col(f"{x}_in")).alias(n) for n, x in zip(sums, own)])


def range_rank(df: DataFrame, by, order, name: str = "rank", **how) -> DataFrame:
    """``df`` with ``name``: the rows of the same ``by`` that come earlier in ``order``."""
    return range_prefix(df, by, order, {name: F.lit(1).cast("long")}, **how)


def _first_in_batches(key: str, orders: list[tuple[str, bool]], k: int):
    """Batch function of :func:`first_rows`: the first ``k`` rows of each key of a batch."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        for batch in batches:
            held = [batch.column(name) for name, _ in orders]
            # a NaN is Spark's largest number but not Arrow's: such a batch goes on whole
            if any(pa.types.is_floating(x.type) and pc.any(pc.is_nan(x)).as_py() for x in held):
                yield batch
                continue
            code = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices
            by, sorts = {"key": code}, [("key", "ascending")]
            for i, ((_, down), x) in enumerate(zip(orders, held)):
                # nulls come last in descending order, first in ascending order, as in Spark
                by |= {f"n{i}": pc.is_null(x).cast("int8"), f"v{i}": x}
                sorts += [(f"n{i}", "ascending" if down else "descending"), (f"v{i}", "descending" if down else "ascending")]
            order = pc.sort_indices(pa.table(by), sort_keys=sorts).to_numpy()
            own = code.to_numpy(zero_copy_only=False)[order]
            yield batch.take(pa.array(np.sort(order[np.arange(len(own)) - np.searchsorted(own, own) < k])))
    return run


def first_rows(df: DataFrame, key: str, orders: list[tuple[str, bool]], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``key`` with their ``rank``, by ``orders``: columns, true for
    descending. Rows are limited inside Arrow batches first: where a key's rows are near each other,
    few are left to be sorted and shuffled, whatever the size of a task."""
    near = df.mapInArrow(_first_in_batches(key, orders, k), df.schema)
    by = [F.col(name).desc() if down else F.col(name).asc() for name, down in orders]
    return near.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*by))).where(F.col(rank) <= k)
