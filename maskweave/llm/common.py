"""Helpers shared by the corpus operators: input checks, shared scratch tables, word splitting."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.scratch import shared_dir
from ..sources.tables import text_table


#: Rows that a task holds as Python objects at once, and their bytes; a single longer row is held by itself.
ROWS, BYTES = 1_000, 4_000_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile batches of rows on their way to Python end at BYTES, unless the session names a limit of its own.

    A batch lies in the JVM, outside of its heap, and in Python; by default it may have 64 MB, in each task.
    """
    if spark.conf.get(BATCH_BYTES, None) is not None:
        yield
        return
    spark.conf.set(BATCH_BYTES, BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    This cuts lineage: later jobs, and tasks retried after a lost executor, reread the files and recompute nothing.
    The tables lie under ``<shared folder>/scratch``; discard() deletes one that no later step reads, and the rest can
    be deleted when the application has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete what staged() has written for these; nothing that is still to run may read them."""
    for df in tables:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string): just these columns, so that others cannot clash; null texts become empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def whole_row() -> Column:
    """All columns of a row as one, named _row, beside which others of any name can stand; ``_row.*`` gives them back."""
    return F.struct("*").alias("_row")


Columns = dict[str, object]


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows of at most ROWS rows and about BYTES bytes of text and items of lists (as objects)."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)
        elif pa.types.is_list(column.type):
            sizes += 32 * np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    ends, begin = np.cumsum(sizes), 0
    while begin < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + BYTES, "right"))
        end = min(max(fit, begin + 1), begin + ROWS)
        yield batch.slice(begin, end - begin)
        begin = end


#: What a worker keeps from task to task, by name, and how that is dropped.
KEPT: dict[str, Callable[[], None]] = {}


def forget(keep: str) -> None:
    """Drop what tasks of other kinds have left in this worker."""
    for name, drop in KEPT.items():
        if name != keep:
            drop()


def map_batches(df: DataFrame, make: Callable[[Iterator[dict[str, list]]], Iterable[Columns]], schema: str, keep: str = "") -> DataFrame:
    """df's rows as dicts of lists, a few at a time, through ``make``, whose dicts of columns become rows of ``schema``.

    Of what KEPT names, only ``keep`` outlasts the task's beginning.
    """
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keep)
        for columns in make(p.to_pydict() for b in batches for p in pieces(b)):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give back to the system what a task's arrays took: its worker waits for later tasks beside a JVM that needs the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return text_table(spark, f"{sf_dir}/{name}.parquet")


MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))
