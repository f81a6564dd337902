"""Frame helpers shared by the operators: columns by exact name, row-wise Arrow mappers over
whole texts, and lineage cuts as tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

# Text bytes that one step of a row-wise mapper holds at once; a longer text is a step of its own.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return read_table(spark, sf_dir, name)


def position(df: DataFrame, name: str) -> int:
    """Index of the column called ``name``: the first with that spelling, else the first that
    differs in case only. Extra columns with clashing names are thereby never ambiguous."""
    for same in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        for i, c in enumerate(df.columns):
            if same(c):
                return i
    raise KeyError(f"no column {name!r} among {df.columns}")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by exact name under new names: ``pick(df, id="doc_id", text="text")``."""
    where = {new: position(df, old) for new, old in columns.items()}
    plain = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"_c{i}").alias(new) for new, i in where.items()])


def dropping(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The columns of ``df`` that stay beside result columns called ``names`` (results win; of
    columns that differ in case only, the first stays)."""
    seen, out = {n.lower() for n in names}, []
    for c in df.columns:
        if c.lower() not in seen:
            seen.add(c.lower())
            out.append(c)
    return out


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared checkpoint folder and read it back: later
    steps start from files that every executor sees, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if (made := _SCRATCH.get()) is not None:
        made.append(out)
    return out


_SCRATCH: ContextVar[list | None] = ContextVar("scratch", default=None)


def release(*frames: DataFrame) -> None:
    """Remove the tables behind frames that ``save`` gave, once everything that reads them is
    written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables saved inside are removed at the end, but for those taken out by ``lasting``."""
    made: list[DataFrame] = []
    token = _SCRATCH.set(made)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        release(*made)


def lasting(df: DataFrame) -> DataFrame:
    """``df``, which stays when the ``scratch`` around it ends."""
    if (made := _SCRATCH.get()) is not None:
        made[:] = [x for x in made if x is not df]
    return df


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy row slices of ``batch`` with about ``most`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(sizes.astype(np.int64)) // most
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def map_text(df: DataFrame, text: str, keep: Sequence[str], fields: Sequence[T.StructField],
             start: Callable[[], Callable[[pa.Array], list]], slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Row-wise Arrow map. ``start()`` runs once a task and returns a function from a slice of
    the text column to the arrays of ``fields``. Result: the ``keep`` columns that no field
    replaces (case ignored), then the fields; rows and their order stay."""
    taken = {f.name.lower() for f in fields}
    left = [k for k in keep if k.lower() not in taken]
    among = [position(df, k) for k in left]
    own = position(df, text)
    frame = pick(df, **{f"k{i}": k for i, k in enumerate(left)}, **({} if own in among else {"text": text}))
    kinds = [frame.schema[f"k{i}"].dataType for i in range(len(left))]
    schema = T.StructType([T.StructField(k, t) for k, t in zip(left, kinds)] + list(fields))
    n = len(left)
    at = among.index(own) if own in among else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, make = to_arrow_schema(schema), start()
        for batch in batches:
            for part in text_slices(batch, at, slice_bytes):
                made = make(part.column(at))
                arrays = [part.column(i) for i in range(n)]
                for f, a in zip(list(target)[n:], made):
                    arrays.append(a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type))
                yield pa.RecordBatch.from_arrays([a.cast(f.type) if a.type != f.type else a for a, f in zip(arrays, target)],
                                                 schema=target)

    return frame.mapInArrow(run, schema)
