"""Read-only scans of event stores in a database."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .schema import Wanted, map_event_columns

QUERY_TIMEOUT_SECONDS = 30  # fixed value: default time allowed for a query


def jdbc_bounds(
    spark: SparkSession, url: str, table: str, column: str, properties: Mapping[str, str] | None = None
) -> tuple[int, int]:
    """Lowest and highest value of a column, asked of the database as one row."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", column):
        raise ValueError(f"unsafe column name '{column}'")
    ends = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("query", f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}")
        .options(**dict(properties or {}))
        .load()
        .first()
    )
    return int(ends["low"] or 0), int(ends["high"] or 0)


def read_jdbc_events(
    spark: SparkSession,
    url: str,
    table: str,
    overrides: Mapping[str, str] | None = None,
    *,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 8,
    fetch_size: int = 10_000,
    query_timeout: int = QUERY_TIMEOUT_SECONDS,
    properties: Mapping[str, str] | None = None,
    not_null: Collection[str] = (),
    where: Iterable[Wanted] = (),
) -> DataFrame:
    """A table of a PostgreSQL, MySQL or other JDBC database as events.

    With ``partition_column`` (and ``bounds``, its lowest and highest value, else
    asked of the database) the table is read in ranges, in parallel. Columns are
    pushed into the queries either way, and so is ``where``; filters on the result
    only for columns in ``not_null``, as in ``map_event_columns``.
    """
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("fetchsize", fetch_size)
        .option("queryTimeout", query_timeout)
        .options(**dict(properties or {}))
    )
    if partition_column is not None:
        if bounds is None:
            bounds = jdbc_bounds(spark, url, table, partition_column, properties)
        reader = (
            reader.option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return map_event_columns(reader.load(), overrides, not_null, where)
