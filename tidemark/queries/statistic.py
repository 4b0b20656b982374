"""Statistics, runs and classification queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.text import classify_event_type, instant_text
from ..operators import sequence, stats
from ..sources.sample_logs import activity_log, order_log, read_sample
from ..sources.schema import normalize_timestamps
from .catalog import query
from .sql_logs import ACTIVITY, ORDERS, activity, iso, order, with_logs

HOUR_LABEL = "strftime(start, '%Y-%m-%dT%H:00:00Z')"


@query("store_totals", activity("SELECT count(*) AS total_events, count(DISTINCT aggregate_id) AS distinct_aggregates FROM activity"))
def _totals(spark, folder):
    return stats.store_totals(activity_log(spark, folder))


@query(
    "top_event_types",
    order("SELECT event_type AS type, count(*) AS event_count FROM order_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
)
def _top(spark, folder):
    return stats.top_event_types(order_log(spark, folder), 3)


@query(
    "top_aggregate_types",
    with_logs(
        ACTIVITY,
        ORDERS,
        body="""SELECT aggregate_type AS type, count(*) AS event_count
        FROM (SELECT aggregate_type FROM activity UNION ALL SELECT aggregate_type FROM order_log) GROUP BY 1""",
    ),
)
def _top_aggregates(spark, folder):
    return stats.top_aggregate_types(activity_log(spark, folder).unionByName(order_log(spark, folder)))


def _bucket(hours: int) -> str:
    return f"to_timestamp((epoch_us(ts) // {hours * 3_600_000_000}) * {hours * 3600}) AT TIME ZONE 'UTC'"


@query(
    "throughput",
    activity(
        f"""SELECT {HOUR_LABEL} AS bucket, event_count FROM (
        SELECT {_bucket(2)} AS start, count(*) AS event_count FROM activity
        WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY 1 DESC LIMIT 24)"""
    ),
)
def _throughput(spark, folder):
    return stats.throughput(activity_log(spark, folder), 2, 24, datetime(2024, 1, 20))


@query(
    "throughput_compat",
    activity(
        f"""SELECT {HOUR_LABEL} AS bucket, event_count FROM (
        SELECT date_trunc('hour', ts) AS start, count(*) AS event_count FROM activity
        WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1 ORDER BY 1 LIMIT 24)"""
    ),
)
def _throughput_compat(spark, folder):
    return stats.throughput(activity_log(spark, folder), 2, 24, datetime(2024, 1, 20), compat=True)


LAST_BUCKETS = f"""SELECT {HOUR_LABEL} AS bucket, event_count FROM (
        SELECT {_bucket(6)} AS start, count(*) AS event_count FROM activity GROUP BY 1 ORDER BY 1 DESC LIMIT 30)"""


@query("throughput_last", activity(LAST_BUCKETS))
def _throughput_last(spark, folder):
    return stats.throughput_last(activity_log(spark, folder), 6, 30)


@query(
    "statistics",
    activity(
        f"""SELECT 'totals' AS section, 'events' AS name, count(*) AS event_count FROM activity
        UNION ALL SELECT 'totals', 'aggregates', count(DISTINCT aggregate_id) FROM activity
        UNION ALL SELECT 'event_types', event_type, count(*) FROM activity GROUP BY 2
        UNION ALL SELECT 'aggregate_types', aggregate_type, count(*) FROM activity GROUP BY 2
        UNION ALL SELECT 'throughput', bucket, event_count FROM ({LAST_BUCKETS})"""
    ),
)
def _statistics(spark, folder):
    return stats.statistics_rows(activity_log(spark, folder), 6, 30)


RUNS = """
marked AS (
  SELECT *, row_number() OVER w - 1 AS idx,
         CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS starts
  FROM order_log WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number)),
runs AS (SELECT *, sum(starts) OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS run FROM marked),
sized AS (
  SELECT *, count(*) OVER (PARTITION BY aggregate_id, run) AS len, min(idx) OVER (PARTITION BY aggregate_id, run) AS run_start
  FROM runs)"""


@query(
    "collapse_runs",
    order(
        """SELECT aggregate_id, 'single' AS kind, event_type, idx AS start_index, CAST(1 AS BIGINT) AS length,
               sequence_number AS first_sequence, sequence_number AS last_sequence FROM sized WHERE len < 4
        UNION ALL
        SELECT aggregate_id, 'group', event_type, run_start, count(*), min(sequence_number), max(sequence_number)
        FROM sized WHERE len >= 4 GROUP BY aggregate_id, event_type, run_start""",
        RUNS,
    ),
)
def _collapse(spark, folder):
    return sequence.collapse_runs(order_log(spark, folder))


@query(
    "timeline_rows",
    order(
        """SELECT aggregate_id, 'single' AS kind, 'single-' || sequence_number AS row_key, event_type, idx + 1 AS step_number,
               idx AS start_index, CAST(1 AS BIGINT) AS length, CAST(NULL AS BOOLEAN) AS expanded,
               CAST(NULL AS BOOLEAN) AS contains_selection, CAST(NULL AS VARCHAR) AS parent_key FROM sized WHERE len < 4
        UNION ALL
        SELECT aggregate_id, 'group', 'group-' || run_start || '-' || count(*), event_type, NULL, run_start, count(*),
               run_start = 1 AND count(*) = 4, bool_or(sequence_number = 3), NULL
        FROM sized WHERE len >= 4 GROUP BY aggregate_id, event_type, run_start
        UNION ALL
        SELECT aggregate_id, 'group-item', 'group-item-' || sequence_number, event_type, idx + 1, idx, 1, NULL, NULL, '1-4'
        FROM sized WHERE len = 4 AND run_start = 1""",
        RUNS,
    ),
)
def _timeline_rows(spark, folder):
    return sequence.timeline_rows(order_log(spark, folder), "1-4", 3)


# expected classes of the event types that occur; all others are of no class
CLASSES = """
named AS (SELECT event_id, event_type FROM order_log UNION ALL SELECT event_id, event_type FROM activity),
classes AS (SELECT * FROM (VALUES ('ORDER_PLACED', 'created', 'created'), ('ORDER_COMPLETED', 'completed', 'completed'),
  ('ORDER_CANCELLED', 'deleted', 'deleted'), ('ERROR', 'failed', 'failed')) AS c(event_type, timeline_class, live_class))"""


@query(
    "classify_event_type",
    with_logs(
        ORDERS, ACTIVITY, CLASSES,
        body="""SELECT event_id, coalesce(timeline_class, 'default') AS timeline_class, coalesce(live_class, 'default') AS live_class
        FROM named LEFT JOIN classes USING (event_type)""",
    ),
)
def _classify(spark, folder):
    return order_log(spark, folder).unionByName(activity_log(spark, folder)).select(
        "event_id",
        classify_event_type(F.col("event_type")).alias("timeline_class"),
        classify_event_type(F.col("event_type"), "live").alias("live_class"),
    )


@query(
    "normalize_timestamps",
    f"""SELECT event_id, {iso('ts')} AS from_iso, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS from_seconds,
    {iso("date_trunc('millisecond', ts)")} AS from_millis FROM events""",
)
def _normalize(spark, folder):
    events = activity_log(spark, folder)

    def back(value):
        return instant_text(normalize_timestamps(value))

    return events.select(
        F.col("event_id").cast("long").alias("event_id"),
        back(instant_text(F.col("timestamp"))).alias("from_iso"),
        back(F.unix_seconds("timestamp")).alias("from_seconds"),
        back(F.unix_millis("timestamp").cast("string")).alias("from_millis"),
    )


@query(
    "validate_events",
    """SELECT page_id, NOT regexp_full_match(aggregate_id, '[a-zA-Z0-9\\-_]{1,255}') AS bad_aggregate_id,
    NOT regexp_full_match(event_type, '[A-Z][A-Z0-9_]{0,127}') AS bad_event_type,
    NOT regexp_full_match(aggregate_type, '[A-Z][A-Z0-9_]{0,63}') AS bad_aggregate_type
    FROM (SELECT page_id, replace(url, '/', '_') AS aggregate_id, CASE WHEN page_id % 2 = 0 THEN 'PAGE_READ' ELSE 'pageRead' END AS event_type,
          upper(split_part(url, '/', 3)) AS aggregate_type FROM pages)""",
)
def _validate(spark, folder):
    from ..sources.schema import validate_events

    pages = read_sample(spark, folder, "pages").select(
        "page_id",
        F.replace("url", F.lit("/"), F.lit("_")).alias("aggregate_id"),
        F.when(F.col("page_id") % 2 == 0, "PAGE_READ").otherwise("pageRead").alias("event_type"),
        F.upper(F.split_part("url", F.lit("/"), F.lit(3))).alias("aggregate_type"),
    )
    return validate_events(pages).select("page_id", "bad_aggregate_id", "bad_event_type", "bad_aggregate_type")


LINES_AS_EVENTS = """
line_events AS (
  SELECT 'ORD-' || l_orderkey AS aggregate_id, l_linenumber AS sequence_number, l_partkey AS part FROM lineitem)"""


def _line_events(spark, folder):
    """Order lines as events; line numbers repeat within an order."""
    line = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey")])
    return read_sample(spark, folder, "lineitem").select(
        line.alias("event_id"),
        F.concat(F.lit("ORD-"), F.col("l_orderkey").cast("string")).alias("aggregate_id"),
        F.col("l_linenumber").cast("long").alias("sequence_number"),
        F.col("l_partkey").alias("global_position"),
    )


@query(
    "check_sequence_keys",
    with_logs(
        LINES_AS_EVENTS,
        body="""SELECT aggregate_id, CAST(sequence_number AS BIGINT) AS sequence_number, count(*) AS copies
        FROM line_events GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
)
def _check_keys(spark, folder):
    from ..sources.schema import check_sequence_keys

    return check_sequence_keys(_line_events(spark, folder))


@query(
    "drop_resent",
    with_logs(
        LINES_AS_EVENTS,
        body="""SELECT aggregate_id, CAST(sequence_number AS BIGINT) AS sequence_number, min(part) AS global_position
        FROM line_events GROUP BY 1, 2""",
    ),
)
def _drop_resent(spark, folder):
    from ..sources.schema import drop_resent

    return drop_resent(_line_events(spark, folder)).drop("event_id")


