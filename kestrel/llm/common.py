"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401  (re-exported)

HOT = 1024
MapFn = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5 (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def is_fold(doc_id: Column, k: int) -> Column:
    """True where the fold is ``k``; a null id belongs to no fold."""
    return F.coalesce(fold(doc_id) == k, F.lit(False))


def join_nodes(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` with the columns of ``right``, which has one row per key and in ``rows`` how many of the ``total``
    rows of ``left`` hold it. Keys with at least 1 / HOT of them, so at most HOT keys, are broadcast and their rows
    stay where they are; only the other keys are shuffled, and none of them fills a task."""
    hot = F.col(rows) * HOT >= total
    few = right.where(hot).drop(rows)
    rest = left.join(F.broadcast(few.select(*on)), on, "left_anti").join(right.where(~hot).drop(rows), on, how)
    return left.join(F.broadcast(few), on).unionByName(rest)


def append_columns(batch: pa.RecordBatch, cols: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with ``cols`` after its own columns; an own column of the same name gives way."""
    names = [n for n in batch.schema.names if n not in cols]
    arrays = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays(arrays + list(cols.values()), names=names + list(cols))


def appended_schema(df: DataFrame, added: str) -> str:
    """DDL of ``df`` plus ``added`` ("name type, ..."), as :func:`append_columns` lays it out."""
    new = {p.strip().split(" ")[0] for p in added.split(",")}
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name not in new]
    return ", ".join(own + [added])


def texts(col: pa.Array) -> Iterator[str | None]:
    """One Python string at a time: a batch of long texts is never held twice as Python objects."""
    for v in col:
        yield v.as_py()


def slices(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes, so that what a task makes of them stays small."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def lean(run: MapFn) -> MapFn:
    """``run``, then what the task's Python worker no longer needs goes back to the system: workers are
    reused by later tasks, and would hold it beside the JVM's heap until then."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Contiguous runs of equal ``keys`` from batches sorted by them, across batch borders."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if rest and key != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(a, b - a))
            last = key
    if rest:
        yield pa.Table.from_batches(rest)


def broadcast_value(spark: SparkSession, value):
    """Broadcast of a fitted model: only objects whose size a parameter bounds go through here."""
    return spark.sparkContext.broadcast(value)
