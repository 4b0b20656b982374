"""A table layout for large event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .schema import EVENT_SCHEMA, ORDER


def write_event_table(events: DataFrame, path: str, distinct_aggregates: int = 1_000_000) -> None:
    """Write events as Parquet sorted by (aggregate, sequence).

    The order and a bloom filter on the aggregate let look-ups of one aggregate
    skip files and row groups, as an index would. Ranges are cut by sequence
    too, so an aggregate with most of the events fills many files.
    """
    (
        events.repartitionByRange("aggregate_id", *ORDER)
        .sortWithinPartitions("aggregate_id", *ORDER)
        .write.mode("errorifexists")
        .option("parquet.bloom.filter.enabled#aggregate_id", "true")
        .option("parquet.bloom.filter.expected.ndv#aggregate_id", str(distinct_aggregates))
        .parquet(path)
    )


def read_event_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)
