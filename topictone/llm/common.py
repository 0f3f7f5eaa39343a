"""Helpers shared by the operators: reading a table, rows in bounded groups of
Arrow batches, and result tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_shared

__all__ = ["LOWER", "collected", "digest", "free_names", "groups_of", "read_table", "released",
           "small_batches", "texts_of", "whole_runs", "write_shared"]

#: bytes.translate table that lower-cases A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ARROW_SETTING, ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it new to the table
    (whose column names Spark compares without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Exactly (id_col, text_col): other columns, whatever their names, are
    dropped at the scan.  A text that is not a string is cast."""
    return df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").cast("string").alias(text_col))


def groups_of(batches: Iterator[pa.RecordBatch], text_col: str,
              max_bytes: int) -> Iterator[pa.Table]:
    """Consecutive rows of one task in tables of about ``max_bytes`` of text (a
    longer single text is a table of its own size), so memory stays bounded."""
    held, size = [], 0
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        for i, n in enumerate(sizes):
            if size and size + n > max_bytes:
                if i > at:
                    held.append(batch.slice(at, i - at))
                yield pa.Table.from_batches(held)
                held, size, at = [], 0, i
            size += n + 16
        if at < len(sizes):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], rows: int, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of one task in batches of a multiple of ``rows`` rows (the last has what is
    left), so that rounding in work done on so many rows at once doesn't depend on the
    sizes of Arrow's batches.  Rows of more than ``max_bytes`` don't wait for others."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows // rows * rows if batch.nbytes <= max_bytes else batch.num_rows
        held = batch.slice(n) if n < batch.num_rows else None
        if n:
            yield batch.slice(0, n)
    if held is not None:
        yield held


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of about ARROW_BYTES at most between Spark and its Python workers,
    for what the session runs from now on (a lower setting stays).  Spark's own bound is
    10,000 rows: tens of MB of text, held several times by the JVM and by the worker of
    every running task."""
    now = spark.conf.get(ARROW_SETTING)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) > ARROW_BYTES:
        spark.conf.set(ARROW_SETTING, str(ARROW_BYTES))


def released(run):
    """``run`` (batches to batches), after which a Python worker hands the memory of its
    task back to the system: the worker lives on, and its free memory would
    otherwise stand beside that of the stages after it."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
            if trim is not None:
                trim(0)

    return task


def collected(df: DataFrame, max_bytes: int, size_of) -> Iterator[list]:
    """Rows of a small table on the driver, in blocks of about ``max_bytes``:
    partitions are streamed one by one, and only one block is held."""
    held, size = [], 0
    for row in df.toLocalIterator():
        n = size_of(row)
        if held and size + n > max_bytes:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


def digest(column):
    """Lowercase hex SHA-256 of a string or binary column, null as empty."""
    return F.sha2(F.coalesce(column.cast("binary"), F.lit(b"")), 256)
