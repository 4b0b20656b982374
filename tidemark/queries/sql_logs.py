"""The sample logs and their states as DuckDB SQL, for checking results."""

from __future__ import annotations


def iso(ts: str) -> str:
    """ISO text of a timestamp with fraction digits in groups of three."""
    return (
        f"(strftime({ts}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN '' "
        f"WHEN epoch_us({ts}) % 1000 = 0 THEN strftime({ts}, '.%g') ELSE strftime({ts}, '.%f') END || 'Z')"
    )


ACTIVITY = """
activity AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'U-' || user_id AS aggregate_id, 'USER' AS aggregate_type,
         event_id + 1 AS sequence_number, upper(event_type) AS event_type,
         '{"k":' || json_extract_string(props, '$.k') || ',"cents":' || CAST(round(value * 100) AS BIGINT) || '}' AS payload,
         '{"source":"activity"}' AS metadata, ts, event_id + 1 AS global_position,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents
  FROM events)"""

ORDERS = """
order_lines AS (
  SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(l_partkey) AS part
  FROM lineitem GROUP BY 1, 2),
order_steps AS (
  SELECT o_orderkey AS order_key, o_orderdate AS placed_at, CAST(1 AS BIGINT) AS sequence_number,
         'ORDER_PLACED' AS event_type,
         '{"cust":' || o_custkey || ',"priority":"' || o_orderpriority || '","total_cents":'
           || CAST(round(o_totalprice * 100) AS BIGINT) || ',"status":"PENDING"}' AS payload
  FROM orders
  UNION ALL
  SELECT o_orderkey, o_orderdate, CAST(l_linenumber + 1 AS BIGINT), 'LINE_ITEM_ADDED',
         '{"part":' || part || ',"qty":' || qty || ',"line_cents":' || cents || '}'
  FROM order_lines JOIN orders ON l_orderkey = o_orderkey
  UNION ALL
  SELECT o_orderkey, o_orderdate, CAST(20 AS BIGINT),
         CASE o_orderstatus WHEN 'F' THEN 'ORDER_COMPLETED' ELSE 'ORDER_CANCELLED' END,
         CASE o_orderstatus WHEN 'F' THEN '{"status":"DONE"}' ELSE '{}' END
  FROM orders WHERE o_orderstatus IN ('F', 'P')),
order_log AS (
  SELECT CAST(order_key * 100 + sequence_number AS VARCHAR) AS event_id, 'ORD-' || order_key AS aggregate_id,
         'ORDER' AS aggregate_type, sequence_number, event_type, payload, '{"source":"orders"}' AS metadata,
         placed_at + to_minutes(sequence_number) AS ts, order_key * 100 + sequence_number AS global_position
  FROM order_steps)"""

CONVERSATIONS = """
conversation_log AS (
  SELECT CAST(conv_id * 1000 + turn + 1 AS VARCHAR) AS event_id, 'CONV-' || conv_id AS aggregate_id,
         'CONVERSATION' AS aggregate_type, turn + 1 AS sequence_number, upper(role) AS event_type,
         '{"text":' || to_json(text) || '}' AS payload, '{}' AS metadata,
         TIMESTAMP '2024-01-01' + to_minutes(conv_id * 1000 + turn + 1) AS ts,
         conv_id * 1000 + turn + 1 AS global_position, text
  FROM conversations)"""

# one row per (event, field): what the generic reducer writes
ACTIVITY_WRITES = f"""
activity_writes AS (
  SELECT aggregate_id, sequence_number, ts, '_version' AS key, CAST(sequence_number AS VARCHAR) AS value_json FROM activity
  UNION ALL SELECT aggregate_id, sequence_number, ts, '_lastEventType', '"' || event_type || '"' FROM activity
  UNION ALL SELECT aggregate_id, sequence_number, ts, '_lastUpdated', '"' || {iso('ts')} || '"' FROM activity
  UNION ALL SELECT aggregate_id, sequence_number, ts, 'k', CAST(k AS VARCHAR) FROM activity
  UNION ALL SELECT aggregate_id, sequence_number, ts, 'cents', CAST(cents AS VARCHAR) FROM activity)"""

ORDER_WRITES = f"""
order_writes AS (
  SELECT aggregate_id, sequence_number, ts, '_version' AS key, CAST(sequence_number AS VARCHAR) AS value_json FROM order_log
  UNION ALL SELECT aggregate_id, sequence_number, ts, '_lastEventType', '"' || event_type || '"' FROM order_log
  UNION ALL SELECT aggregate_id, sequence_number, ts, '_lastUpdated', '"' || {iso('ts')} || '"' FROM order_log
  UNION ALL SELECT aggregate_id, sequence_number, ts, 'status', '"DELETED"' FROM order_log WHERE event_type = 'ORDER_CANCELLED'
  UNION ALL SELECT aggregate_id, sequence_number, ts, f.key, CAST(json_extract(payload, '$.' || f.key) AS VARCHAR)
    FROM order_log, unnest(json_keys(payload)) AS f(key))"""

ACTIVITY_DIFFS = """
activity_diffs AS (
  SELECT * FROM (
    SELECT aggregate_id, sequence_number, ts, key,
           lag(value_json) OVER (PARTITION BY aggregate_id, key ORDER BY sequence_number) AS old_json,
           value_json AS new_json
    FROM activity_writes)
  WHERE old_json IS DISTINCT FROM new_json)"""

ORDER_DIFFS = """
order_diffs AS (
  SELECT * FROM (
    SELECT aggregate_id, sequence_number, ts, key,
           lag(value_json) OVER (PARTITION BY aggregate_id, key ORDER BY sequence_number) AS old_json,
           value_json AS new_json
    FROM order_writes)
  WHERE old_json IS DISTINCT FROM new_json)"""


def with_logs(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def activity(body: str, *more: str) -> str:
    return with_logs(ACTIVITY, *more, body=body)


def activity_states(body: str, *more: str) -> str:
    return with_logs(ACTIVITY, ACTIVITY_WRITES, *more, body=body)


def activity_changes(body: str, *more: str) -> str:
    return with_logs(ACTIVITY, ACTIVITY_WRITES, ACTIVITY_DIFFS, *more, body=body)


def order(body: str, *more: str) -> str:
    return with_logs(ORDERS, *more, body=body)


def order_states(body: str, *more: str) -> str:
    return with_logs(ORDERS, ORDER_WRITES, *more, body=body)


def order_changes(body: str, *more: str) -> str:
    return with_logs(ORDERS, ORDER_WRITES, ORDER_DIFFS, *more, body=body)


def conversation(body: str, *more: str) -> str:
    return with_logs(CONVERSATIONS, *more, body=body)
