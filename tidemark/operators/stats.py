"""Store statistics."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default sizes of the listings.
DEFAULT_TYPES, DEFAULT_BUCKET_HOURS, DEFAULT_BUCKETS = 10, 1, 24
NO_TIMESTAMP = "Statistics require a timestamp column"


def store_totals(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Number of events and of distinct aggregates.

    The exact distinct count first folds ids on the map side, so a hot
    aggregate costs one row per task.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return events.agg(
        F.count(F.lit(1)).alias("total_events"), distinct(F.col("aggregate_id")).alias("distinct_aggregates")
    )


def _top(events: DataFrame, column: str, k: int) -> DataFrame:
    counts = events.groupBy(F.col(column).alias("type")).agg(F.count(F.lit(1)).alias("event_count"))
    # NULL sorts last and is only named afterwards
    top = counts.orderBy(F.desc("event_count"), F.asc_nulls_last("type")).limit(k)
    return top.withColumn("type", F.coalesce("type", F.lit("unknown")))


def top_event_types(events: DataFrame, k: int = DEFAULT_TYPES) -> DataFrame:
    return _top(events, "event_type", k)


def top_aggregate_types(events: DataFrame, k: int = DEFAULT_TYPES) -> DataFrame:
    if "aggregate_type" not in events.columns:
        return events.limit(0).select(
            F.lit("").alias("type"), F.lit(0).cast("long").alias("event_count")
        )
    return _top(events, "aggregate_type", k)


def _check(bucket_hours: int, max_buckets: int) -> None:
    if bucket_hours <= 0 or max_buckets <= 0:
        raise ValueError("bucket_hours and max_buckets must be positive")


def bucket_start(ts: Column | str, hours: int) -> Column:
    """Start of the bucket of a timestamp; buckets are aligned to the epoch."""
    return F.window(ts, f"{hours} hours")["start"]


def _label(start: Column) -> Column:
    return F.date_format(start, "yyyy-MM-dd'T'HH:00:00'Z'")


def _buckets(events: DataFrame, hours: int) -> DataFrame:
    return events.groupBy(bucket_start("timestamp", hours).alias("start")).agg(
        F.count(F.lit(1)).alias("event_count")
    )


def throughput(
    events: DataFrame,
    bucket_hours: int = DEFAULT_BUCKET_HOURS,
    max_buckets: int = DEFAULT_BUCKETS,
    as_of: datetime | None = None,
    compat: bool = False,
) -> DataFrame:
    """Events per bucket in the ``bucket_hours * max_buckets`` hours up to ``as_of``, oldest first.

    Buckets without events are absent. ``compat`` keeps hourly buckets whatever
    the width and drops the newest ones beyond ``max_buckets``.
    """
    _check(bucket_hours, max_buckets)
    end = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    seconds = bucket_hours * max_buckets * 3600
    start = end - F.expr(f"interval {seconds} seconds")
    recent = events.filter((F.col("timestamp") >= start) & (F.col("timestamp") <= end))
    buckets = _buckets(recent, 1 if compat else bucket_hours)
    kept = buckets.orderBy(F.asc("start") if compat else F.desc("start")).limit(max_buckets)
    return kept.orderBy("start").select(_label(F.col("start")).alias("bucket"), "event_count")


def throughput_last(
    events: DataFrame, bucket_hours: int = DEFAULT_BUCKET_HOURS, max_buckets: int = DEFAULT_BUCKETS
) -> DataFrame:
    """The last ``max_buckets`` buckets that hold events, whenever they are."""
    kept = _buckets(events, max(bucket_hours, 1)).orderBy(F.desc("start")).limit(max(max_buckets, 1))
    return kept.orderBy("start").select(_label(F.col("start")).alias("bucket"), "event_count")


@dataclass(frozen=True)
class Statistics:
    """The statistics bundle; without timestamps only the message is set."""

    available: bool
    message: str | None = None
    totals: DataFrame | None = None
    event_types: DataFrame | None = None
    aggregate_types: DataFrame | None = None
    throughput: DataFrame | None = None


def statistics(
    events: DataFrame,
    bucket_hours: int = DEFAULT_BUCKET_HOURS,
    max_buckets: int = DEFAULT_BUCKETS,
    as_of: datetime | None = None,
) -> Statistics:
    if "timestamp" not in events.columns:
        return Statistics(False, NO_TIMESTAMP)
    return Statistics(
        True,
        None,
        store_totals(events),
        top_event_types(events),
        top_aggregate_types(events),
        throughput(events, bucket_hours, max_buckets, as_of),
    )


def statistics_rows(events: DataFrame, bucket_hours: int = 1, max_buckets: int = 24) -> DataFrame:
    """The bundle as one table ``section, name, event_count``.

    Each section reads only its own column of a columnar source, so the four
    passes together read about what one pass over the four columns would.
    """

    def section(label: str, rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(label).alias("section"), F.col(name).alias("name"), "event_count")

    totals = store_totals(events).select(
        F.inline(
            F.array(
                F.struct(F.lit("events").alias("name"), F.col("total_events").alias("event_count")),
                F.struct(F.lit("aggregates").alias("name"), F.col("distinct_aggregates").alias("event_count")),
            )
        )
    )
    return (
        section("totals", totals, "name")
        .unionByName(section("event_types", top_event_types(events), "type"))
        .unionByName(section("aggregate_types", top_aggregate_types(events), "type"))
        .unionByName(section("throughput", throughput_last(events, bucket_hours, max_buckets), "bucket"))
    )
