"""Replay and state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replay as ops
from ..sources.sample_logs import activity_log, conversation_log, order_log, read_sample
from .catalog import query
from .sql_logs import (
    activity_changes, activity_states, conversation, order, order_changes, order_states,
)


@query(
    "current_state",
    activity_states(
        """SELECT aggregate_id, key, value_json, sequence_number AS set_at FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id, key ORDER BY sequence_number DESC) AS r FROM activity_writes)
        WHERE r = 1"""
    ),
)
def _current(spark, folder):
    return ops.current_state(activity_log(spark, folder))


@query(
    "current_state_orders",
    order_states(
        """SELECT aggregate_id, key, arg_max(value_json, sequence_number * 2 + CASE WHEN value_json = '"DELETED"' THEN 0 ELSE 1 END) AS value_json,
        max(sequence_number) AS set_at FROM order_writes GROUP BY 1, 2"""
    ),
)
def _current_orders(spark, folder):
    return ops.current_state(order_log(spark, folder))


@query(
    "replay_heads",
    order("SELECT aggregate_id, max(sequence_number) AS at_sequence, count(*) AS event_count FROM order_log GROUP BY 1"),
)
def _heads(spark, folder):
    return ops.replay_heads(order_log(spark, folder))


@query(
    "parse_payload",
    conversation("SELECT aggregate_id, sequence_number, 'text' AS key, CAST(to_json(text) AS VARCHAR) AS value_json FROM conversation_log"),
)
def _parse(spark, folder):
    return ops.parse_payload(conversation_log(spark, folder)).drop("global_position", "event_id")


@query("field_changes", order_states("SELECT aggregate_id, sequence_number, key, value_json FROM order_writes"))
def _field_changes(spark, folder):
    return ops.field_changes(order_log(spark, folder)).drop("global_position", "event_id")


@query("transitions", activity_changes("SELECT aggregate_id, sequence_number, key, old_json, new_json FROM activity_diffs"))
def _transitions(spark, folder):
    return ops.transitions(activity_log(spark, folder)).drop("global_position", "event_id")


@query("transitions_orders", order_changes("SELECT aggregate_id, sequence_number, key, old_json, new_json FROM order_diffs"))
def _transitions_orders(spark, folder):
    return ops.transitions(order_log(spark, folder)).drop("global_position", "event_id")


@query(
    "event_diffs",
    order_changes(
        """SELECT aggregate_id, sequence_number, string_agg(key || ':' || coalesce(old_json, '-') || '>' || new_json, ' ' ORDER BY key) AS diff_text
        FROM order_diffs GROUP BY 1, 2"""
    ),
)
def _event_diffs(spark, folder):
    grouped = ops.event_diffs(ops.transitions(order_log(spark, folder), grouped=True))
    line = F.transform(
        "diff",
        lambda d: F.concat(d["key"], F.lit(":"), F.coalesce(d["old_json"], F.lit("-")), F.lit(">"), d["new_json"]),
    )
    return grouped.select("aggregate_id", "sequence_number", F.array_join(line, " ").alias("diff_text"))


STATE_AFTER = """
state_rows AS (
  SELECT e.aggregate_id, e.sequence_number AS at_seq, w.key, arg_max(w.value_json, w.sequence_number) AS value_json,
         arg_max(w.value_json, w.sequence_number) FILTER (w.sequence_number < e.sequence_number) AS before_json
  FROM order_log e JOIN order_writes w ON w.aggregate_id = e.aggregate_id AND w.sequence_number <= e.sequence_number
  GROUP BY 1, 2, 3)"""


@query(
    "transition_states",
    order_states(
        """SELECT aggregate_id, at_seq AS sequence_number,
        '{' || coalesce(string_agg('"' || key || '":' || before_json, ',' ORDER BY key) FILTER (before_json IS NOT NULL), '') || '}' AS state_before,
        '{' || string_agg('"' || key || '":' || value_json, ',' ORDER BY key) || '}' AS state_after
        FROM state_rows GROUP BY 1, 2""",
        STATE_AFTER,
    ),
)
def _transition_states(spark, folder):
    return ops.transition_states(order_log(spark, folder)).drop("global_position", "event_id")


@query(
    "state_at",
    order_states(
        """SELECT aggregate_id, at_sequence, key, arg_max(value_json, sequence_number) AS value_json, max(sequence_number) AS set_at
        FROM order_writes JOIN (SELECT 'ORD-' || o_orderkey AS aggregate_id, o_custkey % 9 AS at_sequence FROM orders) USING (aggregate_id)
        WHERE sequence_number <= at_sequence GROUP BY 1, 2, 3"""
    ),
)
def _state_at(spark, folder):
    targets = read_sample(spark, folder, "orders").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("aggregate_id"),
        (F.col("o_custkey") % 9).alias("target"),
    )
    return ops.state_at(order_log(spark, folder), targets)


@query(
    "states_at_events",
    order_states(
        """SELECT aggregate_id, at_seq AS sequence_number, key, value_json FROM state_rows JOIN
        (SELECT aggregate_id, sequence_number AS at_seq FROM order_log WHERE event_type IN ('ORDER_CANCELLED', 'ORDER_COMPLETED')) USING (aggregate_id, at_seq)""",
        STATE_AFTER,
    ),
)
def _states_at_events(spark, folder):
    events = order_log(spark, folder)
    marks = events.filter(F.col("event_type").isin("ORDER_CANCELLED", "ORDER_COMPLETED"))
    return ops.states_at_events(events, marks).drop("global_position", "event_id")


@query(
    "state_as_of",
    activity_states(
        """SELECT aggregate_id, key, arg_max(value_json, sequence_number) AS value_json, max(sequence_number) AS set_at
        FROM activity_writes JOIN (SELECT DISTINCT 'U-' || user_id AS aggregate_id, TIMESTAMP '2024-01-15' AS as_of FROM events) USING (aggregate_id)
        WHERE ts <= as_of GROUP BY 1, 2"""
    ),
)
def _state_as_of(spark, folder):
    events = activity_log(spark, folder)
    targets = events.select("aggregate_id").distinct().withColumn("as_of", F.expr("timestamp'2024-01-15 00:00:00'"))
    return ops.state_as_of(events, targets).drop("as_of")


@query(
    "state_map",
    activity_states(
        """SELECT aggregate_id, '{' || string_agg('"' || key || '":' || value_json, ',' ORDER BY key) || '}' AS state FROM (
        SELECT aggregate_id, key, arg_max(value_json, sequence_number) AS value_json FROM activity_writes GROUP BY 1, 2) GROUP BY 1"""
    ),
)
def _state_map(spark, folder):
    return ops.state_map(ops.current_state(activity_log(spark, folder)))
