"""Retrieval queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_cursor, instant_text
from ..operators import timeline as ops
from ..sources.sample_logs import activity_log, conversation_log, order_log, read_sample
from .catalog import query
from .sql_logs import ACTIVITY, CONVERSATIONS, ORDERS, activity, conversation, iso, order, with_logs

EVENT_SQL = (
    "event_id, aggregate_id, aggregate_type, sequence_number, event_type, payload, metadata, "
    f"{iso('ts')} AS ts_text, global_position"
)
SHORT_SQL = f"aggregate_id, sequence_number, event_type, {iso('ts')} AS ts_text"


def shown(events: DataFrame) -> DataFrame:
    """Events with the timestamp as text."""
    return events.withColumn("ts_text", instant_text(F.col("timestamp"))).drop("timestamp")


def short(events: DataFrame) -> DataFrame:
    return events.select(
        "aggregate_id", "sequence_number", "event_type", instant_text(F.col("timestamp")).alias("ts_text")
    )


@query("map_event_columns", order(f"SELECT {EVENT_SQL} FROM order_log"))
def _map(spark, folder):
    from ..sources.schema import map_event_columns

    physical = order_log(spark, folder).select(
        F.col("event_id").alias("uid"),
        F.col("aggregate_id").alias("stream_id"),
        F.col("aggregate_type").alias("Entity_Type"),
        F.col("sequence_number").alias("version"),
        F.col("event_type").alias("kind"),
        F.col("payload").alias("body"),
        F.col("metadata").alias("headers"),
        F.unix_seconds("timestamp").alias("occurred_at"),
    )
    return shown(map_event_columns(physical, {"event_type": "kind"}))


@query(
    "events_for",
    activity(
        f"SELECT {EVENT_SQL} FROM activity WHERE aggregate_id IN (SELECT 'U-' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"
    ),
)
def _events_for(spark, folder):
    customers = read_sample(spark, folder, "customer").filter("c_mktsegment = 'BUILDING'")
    ids = customers.select(F.concat(F.lit("U-"), F.col("c_custkey").cast("string")).alias("aggregate_id"))
    return shown(ops.events_for(activity_log(spark, folder), ids))


@query(
    "events_page",
    activity(
        f"""SELECT {SHORT_SQL}, step FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS step FROM activity)
        WHERE step BETWEEN 11 AND 30"""
    ),
)
def _events_page(spark, folder):
    page = ops.events_page(activity_log(spark, folder), 20, 10)
    return page.select(
        "aggregate_id", "sequence_number", "event_type",
        instant_text(F.col("timestamp")).alias("ts_text"), "step",
    )


@query(
    "events_after_sequence",
    order(
        f"""SELECT {SHORT_SQL} FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS step
        FROM order_log WHERE sequence_number > 2) WHERE step <= 2"""
    ),
)
def _events_after(spark, folder):
    return short(ops.events_after_sequence(order_log(spark, folder), 2, 2))


CURSOR_SQL = (
    "replace(replace(rtrim(to_base64(encode('{\"seq\":' || last_sequence || ',\"ts\":\"' || "
    + iso("last_ts")
    + " || '\",\"v\":1}' || chr(10))), '='), '+', '-'), '/', '_')"
)


@query(
    "timeline_page",
    activity(
        f"""SELECT aggregate_id, aggregate_type, total_events, page_events, has_more, last_sequence AS next_after,
        CASE WHEN has_more THEN {CURSOR_SQL} END AS next_cursor FROM (
          SELECT aggregate_id, any_value(aggregate_type) AS aggregate_type, count(*) AS total_events,
                 count(*) FILTER (step <= 25) AS page_events, max(step) > 25 AS has_more,
                 max(sequence_number) FILTER (step <= 25) AS last_sequence, max(ts) FILTER (step <= 25) AS last_ts
          FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS step FROM activity)
          GROUP BY aggregate_id)"""
    ),
)
def _timeline_page(spark, folder):
    return ops.timeline_page(activity_log(spark, folder), 25)


@query(
    "events_after_cursor",
    activity(
        f"""SELECT {SHORT_SQL} FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS step FROM activity)
        WHERE step BETWEEN 26 AND 50"""
    ),
)
def _events_after_cursor(spark, folder):
    events = activity_log(spark, folder)
    return short(ops.events_after_cursor(events, ops.timeline_page(events, 25).filter("has_more").select(
        "aggregate_id", F.col("next_cursor").alias("cursor")), 25))


@query(
    "encode_cursor",
    activity(f"SELECT event_id, {CURSOR_SQL} AS cursor FROM (SELECT event_id, sequence_number AS last_sequence, ts AS last_ts FROM activity)"),
)
def _encode_cursor(spark, folder):
    events = activity_log(spark, folder)
    return events.select("event_id", encode_cursor(F.col("sequence_number"), F.col("timestamp")).alias("cursor"))


@query(
    "events_up_to",
    order(f"SELECT {SHORT_SQL} FROM order_log JOIN orders ON aggregate_id = 'ORD-' || o_orderkey WHERE sequence_number <= o_custkey % 7"),
)
def _events_up_to(spark, folder):
    limits = read_sample(spark, folder, "orders").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("aggregate_id"),
        (F.col("o_custkey") % 7).alias("max_sequence"),
    )
    return short(ops.events_up_to(order_log(spark, folder), limits))


@query("recent_events", activity(f"SELECT {EVENT_SQL} FROM activity ORDER BY activity.global_position DESC LIMIT 50"))
def _recent(spark, folder):
    return shown(ops.recent_events(activity_log(spark, folder)))


@query(
    "events_after_position",
    activity(f"SELECT {EVENT_SQL} FROM activity WHERE global_position > 500 ORDER BY activity.global_position LIMIT 200"),
)
def _after_position(spark, folder):
    return shown(ops.events_after_position(activity_log(spark, folder), 500, 200))


@query("count_events", activity("SELECT aggregate_id, count(*) AS event_count FROM activity GROUP BY 1"))
def _count(spark, folder):
    return ops.count_events(activity_log(spark, folder))


@query(
    "aggregate_types",
    with_logs(
        ACTIVITY, CONVERSATIONS, ORDERS,
        body="""SELECT aggregate_type FROM activity UNION SELECT aggregate_type FROM conversation_log
        UNION SELECT aggregate_type FROM order_log""",
    ),
)
def _types(spark, folder):
    events = activity_log(spark, folder).unionByName(conversation_log(spark, folder))
    return ops.aggregate_types(events.unionByName(order_log(spark, folder)))


@query(
    "aggregate_ids_of_type",
    conversation("SELECT DISTINCT aggregate_id FROM conversation_log ORDER BY 1 LIMIT 40 OFFSET 10"),
)
def _ids(spark, folder):
    events = activity_log(spark, folder).unionByName(conversation_log(spark, folder))
    return ops.aggregate_ids_of_type(events, "CONVERSATION", 40, 10)


@query(
    "search_aggregates",
    activity("SELECT DISTINCT aggregate_id FROM activity WHERE aggregate_id ILIKE '%u-1%' ORDER BY 1 LIMIT 20"),
)
def _search(spark, folder):
    return ops.search_aggregates(activity_log(spark, folder), "u-1")


@query(
    "search_summaries",
    activity(
        f"""SELECT {EVENT_SQL} FROM activity WHERE (aggregate_id, sequence_number) IN (
        SELECT aggregate_id, min(sequence_number) FROM activity WHERE aggregate_id ILIKE '%u-1%'
        GROUP BY aggregate_id ORDER BY aggregate_id LIMIT 20)"""
    ),
)
def _summaries(spark, folder):
    return shown(ops.search_summaries(activity_log(spark, folder), "u-1"))


@query(
    "timeline",
    activity(
        f"""SELECT {SHORT_SQL}, step, total_events, 'USER' AS timeline_type FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS step,
               count(*) OVER (PARTITION BY aggregate_id) AS total_events FROM activity)
        WHERE step BETWEEN 6 AND 45"""
    ),
)
def _timeline(spark, folder):
    return ops.timeline(activity_log(spark, folder), 40, 5).select(
        "aggregate_id", "sequence_number", "event_type",
        instant_text(F.col("timestamp")).alias("ts_text"), "step", "total_events", "timeline_type",
    )


@query(
    "timeline_header",
    order(
        """SELECT aggregate_id, CASE WHEN count(*) > 5 THEN 'ORDER' ELSE 'unknown' END AS aggregate_type,
        count(*) AS total_events, greatest(least(count(*) - 5, 3), 0) AS page_events FROM order_log GROUP BY 1"""
    ),
)
def _timeline_header(spark, folder):
    return ops.timeline_header(order_log(spark, folder), 3, 5)


@query(
    "first_event",
    order(f"SELECT {EVENT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS r FROM order_log) WHERE r = 1"),
)
def _first(spark, folder):
    return shown(ops.first_event(order_log(spark, folder)))


@query(
    "last_event",
    order(f"SELECT {EVENT_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number DESC) AS r FROM order_log) WHERE r = 1"),
)
def _last(spark, folder):
    return shown(ops.last_event(order_log(spark, folder)))


@query("event_at", order(f"SELECT {EVENT_SQL} FROM order_log WHERE sequence_number = 3"))
def _at(spark, folder):
    return shown(ops.event_at(order_log(spark, folder), 3))


@query(
    "metadata_only",
    conversation(
        f"SELECT event_id, aggregate_id, aggregate_type, sequence_number, event_type, CAST(NULL AS VARCHAR) AS payload, metadata, {iso('ts')} AS ts_text, global_position FROM conversation_log"
    ),
)
def _metadata(spark, folder):
    return shown(ops.metadata_only(conversation_log(spark, folder)))


@query(
    "filter_events",
    activity(
        f"SELECT {EVENT_SQL} FROM activity WHERE event_type = 'PURCHASE' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'"
    ),
)
def _filter(spark, folder):
    return shown(
        ops.filter_events(
            activity_log(spark, folder), "USER", "PURCHASE", datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
        )
    )


@query(
    "zoom_window",
    activity(
        f"""SELECT {SHORT_SQL} FROM (
        SELECT *, last_value(ts) OVER (PARTITION BY aggregate_id ORDER BY sequence_number
                 ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS e FROM activity WHERE event_type = 'CLICK')
        WHERE ts >= e - INTERVAL 168 HOUR"""
    ),
)
def _zoom(spark, folder):
    return short(ops.zoom_window(activity_log(spark, folder), 168, "CLICK"))


@query(
    "event_types_per_aggregate",
    activity("SELECT aggregate_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types FROM activity GROUP BY 1"),
)
def _types_per(spark, folder):
    found = ops.event_types_per_aggregate(activity_log(spark, folder))
    return found.select("aggregate_id", F.array_join("event_types", ",").alias("event_types"))


@query(
    "query_events",
    activity(
        f"""SELECT event_id, aggregate_id, aggregate_type, sequence_number, event_type, '{{}}' AS payload, metadata,
        {iso('ts')} AS ts_text, global_position FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS step
        FROM activity WHERE event_type = 'VIEW' AND sequence_number > 100) WHERE step <= 10"""
    ),
)
def _query_events(spark, folder):
    return shown(
        ops.query_events(
            activity_log(spark, folder), "TIMELINE", limit=10, cursor_sequence=100, fields="METADATA", event_type="VIEW"
        )
    )
