"""Merkle manifest of a table: leaves, roots and proofs.

Leaves of a group stand in order; every two consecutive nodes (the last one alone where their
number is odd) become the digest of their joined digests, until one is left. A builder owns an
aligned run of ``2 ** LEVELS`` nodes and appends every node of its subtree to a log in the order
of completion. In that order, which is a postorder, the node of level ``l`` whose last leaf is
number ``i`` stands at ``2 * i - popcount(i) + l``: a subtree of ``i`` leaves in front of it holds
that many nodes. So siblings are read from the log by arithmetic, without a search. The builders'
own roots are the nodes of the next tier, which is smaller by ``2 ** LEVELS``; the roots of the
groups are the leaves of one more tree. No task holds more than a builder's run."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import pick, save

LEVELS = 10
#: Leaves in one range of the sorted order, about.
RANGE_ROWS = 500_000
#: Sides of a path's steps: no sibling (the node is hashed alone), sibling on the left or right.
ALONE, LEFT, RIGHT = 0, -1, 1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


# --- digests ----------------------------------------------------------------------------------
def encoded(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hexadecimal) and the siblings of its path give."""
    other = lambda s: F.lower(F.hex(s["node"]))
    return F.aggregate(path, leaf, lambda at, s: F.sha2(
        F.when(s["side"] == LEFT, F.concat(other(s), at)).when(s["side"] == RIGHT, F.concat(at, other(s))).otherwise(at), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path in hexadecimal, joined from the leaf to the root."""
    return F.concat_ws("", F.transform(path, lambda s: F.lower(F.hex(s["node"]))))


# --- the append log ---------------------------------------------------------------------------
def place(last: int, level: int) -> int:
    """Place in the log of the node of ``level`` whose last leaf is number ``last``."""
    return 2 * last - last.bit_count() + level


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    return max(0, n - 1).bit_length()


def _joined(*nodes: bytes) -> bytes:
    return hashlib.sha256("".join(x.hex() for x in nodes).encode()).digest()


def append_log(leaves: list[bytes], levels: int) -> list[bytes]:
    """All nodes of the subtree over ``leaves``, in the order of their completion. A leaf completes
    the levels at which it ends a full run; the last one completes all ``levels``."""
    log: list[bytes] = []
    last = len(leaves) - 1
    for i, node in enumerate(leaves):
        log.append(node)
        done = levels if i == last else min(levels, ((i + 1) & -(i + 1)).bit_length() - 1)
        for level in range(done):
            run = i >> level
            if run & 1:
                log.append(_joined(log[place((run << level) - 1, level)], log[-1]))
            else:
                log.append(_joined(log[-1]))
    return log


def path(log: list[bytes], leaves: int, levels: int, leaf: int) -> list[tuple[int, bytes | None]]:
    """``(side, sibling)`` of each level above ``leaf``, read from the log by place."""
    out = []
    for level in range(levels):
        run = leaf >> level
        if run & 1:
            out.append((LEFT, log[place((run << level) - 1, level)]))
        elif (run + 1) << level < leaves:
            out.append((RIGHT, log[place(min((run + 2) << level, leaves) - 1, level)]))
        else:
            out.append((ALONE, None))
    return out


# --- trees over tables ------------------------------------------------------------------------
def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``n``, the rows of their ``tree`` (a column without nulls), and ``idx``, their
    place among them by ``order`` (from 0). Ranges of the sorted rows are numbered one by one; how
    many rows the ranges before hold is a table of a row a range and tree. ``order`` must tell
    rows apart, or a frequent key would fill a range."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = save(rows.repartitionByRange(parts, tree, *order).withColumn("_range", F.spark_partition_id()), "manifest-ranges")
    counts = dealt.groupBy(tree, "_range").agg(F.count("*").alias("_m"))
    before = Window.partitionBy(tree).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(tree, "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
                           F.sum("_m").over(Window.partitionBy(tree)).alias("n"))
    inside = F.row_number().over(Window.partitionBy(tree, "_range").orderBy(*order)) - 1
    return dealt.withColumn("_in", inside).join(counts, [tree, "_range"]).withColumn(
        "idx", F.col("_before") + F.col("_in")).drop("_range", "_in", "_before")


_STEP = T.StructType([T.StructField("side", T.IntegerType()), T.StructField("node", T.BinaryType())])


def builders(items: DataFrame, levels: int) -> DataFrame:
    """``items(tree, n, idx, node, ...)`` -> a row for each builder: ``(tree, n, block, rows, log)``,
    its items in order and the log of its subtree, written to the shared folder."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                nodes = one.column("rows")[0].values.field("node").to_pylist()
                log = append_log(nodes, min(levels, height(one.column("n")[0].as_py())))
                yield pa.RecordBatch.from_arrays([one.column("tree"), one.column("n"), one.column("block"), one.column("rows"),
                                                  pa.array([log], pa.list_(pa.binary()))], names=["tree", "n", "block", "rows", "log"])

    rest = [c for c in items.columns if c not in ("tree", "n")]
    block = F.expr(f"idx div {1 << levels}").alias("block")
    runs = items.groupBy("tree", "n", block).agg(F.array_sort(F.collect_list(F.struct("idx", *[c for c in rest if c != "idx"]))).alias("rows"))
    schema = T.StructType([*runs.schema.fields, T.StructField("log", T.ArrayType(T.BinaryType()))])
    return save(runs.mapInArrow(run, schema), "manifest-log")


def _proofs(built: DataFrame, levels: int) -> DataFrame:
    """Builders with ``(above, subroot, root)``: the steps above them and the roots they lead to
    -> ``(tree, idx, node, ..., path, subroot, root)`` of each item."""
    kind = pa.list_(pa.struct([("side", pa.int32()), ("node", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                rows, log, above = (one.column(c)[0].values for c in ("rows", "log", "above"))
                n, log, above = len(rows), log.to_pylist(), above.to_pylist()
                up = min(levels, height(one.column("n")[0].as_py()))
                made = [[{"side": s, "node": x} for s, x in path(log, n, up, j)] + above for j in range(n)]
                same = [pa.array([one.column(c)[0].as_py()] * n, t) for c, t in (("tree", pa.string()), ("subroot", pa.binary()), ("root", pa.binary()))]
                own = [rows.field(f.name) for f in rows.type]
                yield pa.RecordBatch.from_arrays([same[0], *own, pa.array(made, kind), *same[1:]],
                                                 names=["tree", *[f.name for f in rows.type], "path", "subroot", "root"])

    own = built.schema["rows"].dataType.elementType.fields
    schema = T.StructType([built.schema["tree"], *own, T.StructField("path", T.ArrayType(_STEP)),
                           T.StructField("subroot", T.BinaryType()), T.StructField("root", T.BinaryType())])
    return built.mapInArrow(run, schema)


def trees(items: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Builders of ``items(tree, n, idx, node, ...)`` with ``above``, the steps from a builder's
    root to its tree's root, and ``root``. ``n`` is the tree's number of items."""
    built = builders(items, levels)
    most = built.agg(F.max("n")).first()[0] or 0
    top = F.element_at("log", -1)
    if most <= 1 << levels:
        return built.withColumn("above", F.array().cast(T.ArrayType(_STEP))).withColumn("root", top)
    nodes = built.select("tree", F.expr(f"(n + {(1 << levels) - 1}) div {1 << levels}").alias("n"), F.col("block").alias("idx"), top.alias("node"))
    upper = _proofs(trees(nodes, levels).withColumn("subroot", F.col("root")), levels)
    return built.join(upper.select("tree", F.col("idx").alias("block"), F.col("path").alias("above"), "root"), ["tree", "block"])


def manifest(rows: DataFrame, order: list[str], levels: int = LEVELS) -> DataFrame:
    """``rows(tree, node, ...)`` -> the same with ``path`` (steps from the leaf to the root of all),
    ``subroot`` (its tree's) and ``root``; trees stand in the order of their names, the leaves of
    a tree by ``order``, then by ``node``. Identical rows are leaves of their own. No rows, no
    manifest."""
    rows = save(rows.withColumn("_row", F.monotonically_increasing_id()), "manifest-leaves")
    built = trees(ranked(rows, "tree", [*order, "node", "_row"]).drop("_row"), levels)
    groups = built.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    top = _proofs(trees(ranked(groups, "tree", ["name"]), levels).withColumn("subroot", F.col("root")), levels)
    top = top.select(F.col("name").alias("tree"), F.col("path").alias("_over"), F.col("root").alias("_all"))
    whole = built.join(top, "tree").withColumn("above", F.concat("above", "_over"))
    return _proofs(whole.withColumn("subroot", F.col("root")).withColumn("root", F.col("_all")).drop("_over", "_all"), levels)


def prove(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Manifest of documents by language, and the check of a claim about each.

    Result: ``doc_id, leaf, subroot, root`` (hexadecimal), ``path``, ``claimed`` (the leaf of the
    row with ``n_chars`` raised by one where ``tampered``, a condition on ``doc_id``, holds),
    ``folded_root`` (from ``claimed`` and the path) and ``verified``. Nulls are values of their own
    and stay null when tampered with; a null language is the first tree, a null id the first leaf.
    Rows with the same id stand by digest; identical rows are leaves each. Other columns, also
    ones that differ in case only, take no part."""
    own = pick(docs, **{c: c for c in FIELDS})
    raised = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")) if tampered is not None else F.col("n_chars")
    columns = [F.col(c) for c in FIELDS]
    claim = [raised if c == "n_chars" else F.col(c) for c in FIELDS]
    leaf = F.unhex(row_digest(columns))
    # a claim that changes nothing is not hashed again
    other = F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), F.unhex(row_digest(claim))) if tampered is not None else F.lit(None).cast("binary")
    rows = own.select(F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"), leaf.alias("node"), "doc_id", other.alias("claim"))
    found = manifest(rows, ["doc_id"], levels)
    low = lambda c: F.lower(F.hex(c))
    done = found.select("doc_id", low("node").alias("leaf"), low("subroot").alias("subroot"), low("root").alias("root"), "path",
                        low(F.coalesce("claim", "node")).alias("claimed"))
    done = done.withColumn("folded_root", folded(F.col("claimed"), F.col("path")))
    return done.withColumn("verified", F.col("folded_root") == F.col("root"))
