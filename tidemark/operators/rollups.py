"""Totals kept up day by day: mergeable counts and distinct sketches beside the exact ones.

A roll-up row stands for some events of one day; rows of new events are simply
added, also for days that have rows already. Event counts stay exact. Distinct
aggregates come from HyperLogLog sketches of ``2 ** LOG_K`` registers, with a
standard error of ``standard_error()`` of the true number, however many rows are
merged; an aggregate that is active on many days counts once.
"""

from __future__ import annotations

from datetime import date
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG_K = 12


def standard_error(log_k: int = LOG_K) -> float:
    """Relative standard error of a merged sketch."""
    return 1.04 / sqrt(2**log_k)


def daily_totals(events: DataFrame, log_k: int = LOG_K) -> DataFrame:
    """One row per day (UTC; NULL for events without a time): ``day, total_events, aggregates``.

    Sketches are filled on the map side; a day's shuffle is one sketch a task.
    """
    return events.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("total_events"),
        F.hll_sketch_agg("aggregate_id", F.lit(log_k)).alias("aggregates"),
    )


def _merged() -> list[Column]:
    return [
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("aggregates")), F.lit(0)).cast("long").alias("distinct_aggregates"),
    ]


def totals_between(rollup: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """Totals of the days from ``since`` to ``until``, both inclusive; without bounds, of everything."""
    if since is not None:
        rollup = rollup.filter(F.col("day") >= F.lit(since))
    if until is not None:
        rollup = rollup.filter(F.col("day") <= F.lit(until))
    return rollup.agg(*_merged())


def trailing_totals(rollup: DataFrame, days: int = 7) -> DataFrame:
    """Per day with events: events and active aggregates of the ``days`` days that end with it.

    Each row goes to ``days`` windows: the work depends on the days, not on the events.
    """
    if days < 1:
        raise ValueError("days must be positive")
    dated = rollup.filter(F.col("day").isNotNull())
    spread = dated.select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda n: F.date_add("day", n))).alias("__end"),
        "total_events",
        "aggregates",
    )
    ends = dated.select(F.col("day").alias("__end")).distinct()
    kept = spread.join(ends, "__end", "left_semi")
    return kept.groupBy(F.col("__end").alias("day")).agg(*_merged())
