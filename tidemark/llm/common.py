"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import sys
import types
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back: lost executors cost no recomputation."""
    path = run_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other letter alone."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, across tasks."""
    module = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker"))
    return module.__dict__.setdefault("store", {})


def release_store(clear: bool = True) -> None:
    """Give back what earlier operators kept in this worker, and what its allocators hold unused.

    Workers outlive tasks and operators, and idle ones count against an executor's memory too.
    """
    import ctypes

    import pyarrow as pa

    if clear:
        worker_store().clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


@contextmanager
def small_batches(spark: SparkSession):
    """Python workers get rows a few at a time from what is run inside: whole texts are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_files(rows: DataFrame, path: str, compression: str = "none", per_file: int = 0) -> None:
    """Write binary column ``content`` as plain files, in row order within a partition.

    Spark's text writer does the writing, so any Hadoop file system works and
    commits survive lost executors. It ends each row with a line feed.
    """
    writer = rows.select(F.col("content").cast("string").alias("value")).write
    writer.option("compression", compression).option("maxRecordsPerFile", per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of a folder as rows (path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def sized_broadcast(df: DataFrame, most_bytes: int = 8 << 20) -> DataFrame:
    """Mark a staged table for broadcast if all it holds is measured to be small, else leave the join to Spark."""
    width = F.lit(16 * len(df.columns))
    for column, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            width = width + F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df
