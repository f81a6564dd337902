"""SimHash near-dedup with pigeonring filtering.

Fingerprints are 64-bit majority bits over the XXH64 hashes of word shingles. Two fingerprints
link at ``distance`` or fewer differing bits. The bits form a ring of ``segments`` segments; by
the pigeonring principle, a link has a rotation from which every chain of ``l`` consecutive
segments differs in at most ``l * distance / segments`` bits. The chain's first stretch has a
budget below one bit, so it is equal and is the key of a bucket (one key a rotation); the
longer chains prune the candidates of a bucket before the full Hamming check.

Distinct fingerprints are compared, never documents, and each bucket emits a spanning forest,
never its pairs. A bucket of more than ``bucket`` fingerprints is split before any task reads
it: of its other bits, cut in ``distance + 1`` parts, one part must be equal too, so its rows
go on under that many finer keys. Distinct fingerprints equal in all but ``r`` bits are at most
``2 ** r``, so this ends, and loses no link."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import map_text, pick, save
from .words import SOLID, Words, ranges

SHINGLE, DISTANCE, SEGMENTS, BUCKET, SEED = 3, 2, 7, 256, 42


def _fingerprint(width: int, seed: int):
    def start():
        import xxhash

        digest = xxhash.xxh64_intdigest

        def make(column: pa.Array) -> list:
            words = Words(column, SOLID, lower=True)
            out = np.zeros(len(words.counts), np.uint64)
            size = words.end - words.start
            if not len(size):
                return [out.view(np.int64)]
            at = np.cumsum(size + 1) - (size + 1)
            joined = np.full(int(at[-1] + size[-1]), 32, np.uint8)
            joined[ranges(at, size)] = words.data[ranges(words.start, size)]
            made = np.where(words.counts >= width, words.counts - width + 1, np.minimum(words.counts, 1))
            begin = ranges(words.first[:-1], made)
            last = np.minimum(begin + width, np.repeat(words.first[1:], made)) - 1
            text = joined.tobytes()
            hashes = np.fromiter((digest(text[a:b], seed) for a, b in zip(at[begin].tolist(), (at[last] + size[last]).tolist())),
                                 np.uint64, len(begin))
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            some = made > 0
            first = (np.cumsum(made) - made)[some]
            ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
            out[some] = np.packbits(2 * ones > made[some, None], axis=1, bitorder="little").view("<u8").ravel()
            return [out.view(np.int64)]

        return make

    return start


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The ``keep`` columns and ``fp``, the fingerprint as a signed long. Null and wordless
    texts have fingerprint zero; texts of fewer than ``width`` words are one shingle."""
    return map_text(docs, text, keep, [T.StructField("fp", T.LongType())], _fingerprint(width, seed))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * i // parts:len(bits) * (i + 1) // parts] for i in range(parts)]


def ring(distance: int, segments: int) -> tuple[list[int], np.ndarray, list[int]]:
    """By rotation, the mask of the equal stretch and the masks of the longer chains (a row
    each); and the budgets of those chains."""
    if not 0 <= distance < segments <= 64:
        raise ValueError("needs 0 <= distance < segments <= 64")
    masks = [sum(1 << b for b in part) for part in _cut(list(range(64)), segments)]
    grown = [[sum(masks[(r + i) % segments] for i in range(n + 1)) for n in range(segments)] for r in range(segments)]
    budget = [(n + 1) * distance // segments for n in range(segments)]
    equal = budget.count(0)
    return [g[equal - 1] for g in grown], np.array([g[equal:] for g in grown], np.uint64).reshape(segments, -1), budget[equal:]


def finer(mask: int, distance: int) -> list[int]:
    """The bucket's mask with each of ``distance + 1`` parts of its other bits added."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in part) for part in _cut(free, distance + 1)]


def _forest(fp: np.ndarray, mask: np.ndarray, turn: np.ndarray, distance: int, chains: np.ndarray,
            budgets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, root) of a spanning forest of every bucket; rows come by bucket."""
    n, bits = len(fp), fp.view(np.uint64)
    head = np.r_[True, (turn[1:] != turn[:-1]) | (mask[1:] != mask[:-1]) | ((fp & mask)[1:] != (fp & mask)[:-1])]
    end = np.append(np.flatnonzero(head), n)[np.cumsum(head)]
    live, gap, a, b = np.arange(n), 1, [], []
    while len(live := live[live + gap < end[live]]):
        near, diff = live, bits[live] ^ bits[live + gap]
        for chain, budget in zip(chains.T, budgets):
            within = np.bitwise_count(diff & chain[turn[near]]) <= budget
            near, diff = near[within], diff[within]
        near = near[np.bitwise_count(diff) <= distance]
        a.append(near)
        b.append(near + gap)
        gap += 1
    if not a:
        return fp[:0], fp[:0]
    x, y = np.concatenate(a), np.concatenate(b)
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links that connect exactly the fingerprints at
    ``distance`` or fewer differing bits."""
    exact, chains, budgets = ring(distance, segments)
    bucket = max(bucket, 1 << distance)  # with so few free bits, splitting ends

    def keyed(df: DataFrame, choices: F.Column) -> DataFrame:
        return df.select("fp", F.explode(choices).alias("k")).select("fp", "k.turn", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("key"))

    def choice(turn: int, mask: int) -> F.Column:
        return F.struct(F.lit(turn).alias("turn"), F.lit(_signed(mask)).alias("mask"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by bucket; the last bucket of a batch may go on in the next one.
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            rows = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            if not len(rows[0]):
                continue
            fp, mask, turn = rows
            same = (turn == turn[-1]) & (mask == mask[-1]) & ((fp & mask) == (fp[-1] & mask[-1]))
            cut = len(fp) - int(np.argmin(same[::-1])) if not same.all() else 0
            a, b = _forest(fp[:cut], mask[:cut], turn[:cut], distance, chains, budgets)
            held = [x[cut:] for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        a, b = _forest(*held, distance, chains, budgets) if len(held[0]) else (held[0], held[0])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def compared(df: DataFrame) -> DataFrame:
        by = ["turn", "mask", "key"]
        rows = df.repartition(*by).sortWithinPartitions(*by, "fp")
        return rows.select("fp", "mask", F.col("turn").cast("bigint")).mapInArrow(run, "a bigint, b bigint")

    rows = keyed(distinct, F.array(*[choice(r, m) for r, m in enumerate(exact)]))
    at, out = [(r, m) for r, m in enumerate(exact)], None
    while True:
        heavy = save(rows.groupBy("turn", "mask", "key").count().where(F.col("count") > bucket).drop("count"), "buckets")
        crowded = not heavy.isEmpty()
        found = compared(rows.join(heavy, ["turn", "mask", "key"], "left_anti") if crowded else rows)
        out = found if out is None else out.unionByName(found)
        if not crowded:
            return out
        split = F.create_map(*[x for r, m in at for x in (F.lit(f"{r} {_signed(m)}"), F.array(*[choice(r, c) for c in finer(m, distance)]))])
        rows = keyed(rows.join(heavy, ["turn", "mask", "key"], "left_semi"), split[F.concat_ws(" ", "turn", "mask")]).distinct()
        at = list(dict.fromkeys((r, c) for r, m in at for c in finer(m, distance)))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = SHINGLE,
                    distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET, keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, keep..., fp, component_id, root)`` for every row: its fingerprint, and of the
    fingerprints linked to it, directly or by way of others, the smallest id and the smallest
    fingerprint (``root``, one a component also where ids clash).

    Null, empty and wordless texts have fingerprint zero and are linked like any other;
    repeated rows and ids each get a row; a null id is nobody's ``component_id`` unless a
    component has no other. An empty table gives no rows."""
    own = pick(docs, doc_id=doc_id, text=text, **{k: k for k in keep})
    rows = save(fingerprints(own, ["doc_id", *keep], "text", width), "fingerprints")
    distinct = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), distance, segments, bucket))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = rooted.join(least, "root").select("fp", "component_id", "root")
    return rows.join(by_print, "fp").select("doc_id", *keep, "fp", "component_id", "root")
