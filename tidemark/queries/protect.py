"""Governance, export, source and reducer queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions.text import instant_text
from ..operators import export, governance, reducers
from ..operators.detect import scan_anomalies, attach_states, load_rules
from ..operators.replay import current_state, transitions
from ..session import run_folder
from ..sources import registry
from ..sources.layout import read_event_table, write_event_table
from ..sources.sample_logs import activity_log, conversation_log, document_log, order_log, read_sample
from ..sources.schema import EVENT_COLUMNS, event_time, load_event_table, map_event_columns
from ..sources.stream_records import parse_stream_records, split_malformed
from .catalog import query
from .sql_logs import (
    ACTIVITY, CONVERSATIONS, ORDERS, activity, conversation, iso, order, order_changes, order_states, with_logs,
)


def mask_sql(text: str) -> str:
    """CASE over a text with the default rules."""
    tests = " ".join(
        f"WHEN regexp_matches({text}, '{r.regex}') THEN '{r.mask}'" for r in governance.DEFAULT_MASKS
    )
    return f"CASE {tests} ELSE {text} END"


@query(
    "mask_payload",
    f"""SELECT doc_id, '{{"lang":' || to_json({mask_sql('lang')}) || ',"n_chars":' || n_chars || ',"source":'
        || to_json({mask_sql('source')}) || ',"text":' || to_json({mask_sql('text')}) || '}}' AS payload FROM documents""",
)
def _mask(spark, folder):
    masked = governance.mask_payload(document_log(spark, folder))
    return masked.select(F.col("event_id").cast("long").alias("doc_id"), "payload")


@query(
    "mask_payload_nested",
    f"""SELECT doc_id, '{{"body":{{"parts":[' || to_json({mask_sql('text')}) || ',' || n_chars || ',null]}},"lang":' || to_json(lang) || '}}' AS payload FROM documents""",
)
def _mask_nested(spark, folder):
    nested = read_sample(spark, folder, "documents").select(
        "doc_id",
        F.concat(
            F.lit('{"body":{"parts":['), F.to_json(F.col("text").cast("variant")), F.lit(","),
            F.col("n_chars").cast("string"), F.lit(',null]},"lang":"'), F.col("lang"), F.lit('"}'),
        ).alias("payload"),
    )
    return governance.mask_payload(nested)


PRIORITY_RULE = [governance.MaskRule("priority", "[0-9]-[A-Z]", "#")]


def _priority_masked(value: str) -> str:
    return f"CASE WHEN {value} LIKE '\"%' AND regexp_matches({value}, '[0-9]-[A-Z]') THEN '\"#\"' ELSE {value} END"


@query(
    "mask_transitions",
    order_changes(
        f"""SELECT aggregate_id, sequence_number, key, {_priority_masked('old_json')} AS old_json,
        {_priority_masked('new_json')} AS new_json FROM order_diffs"""
    ),
)
def _mask_transitions(spark, folder):
    changed = transitions(order_log(spark, folder))
    return governance.mask_transitions(changed, PRIORITY_RULE).drop("global_position", "event_id")


@query(
    "mask_state",
    order_states(
        f"""SELECT aggregate_id, key, {_priority_masked('value_json')} AS value_json FROM (
        SELECT aggregate_id, key, arg_max(value_json, sequence_number * 2 + CASE WHEN value_json = '"DELETED"' THEN 0 ELSE 1 END) AS value_json
        FROM order_writes GROUP BY 1, 2)"""
    ),
)
def _mask_state(spark, folder):
    return governance.mask_state(current_state(order_log(spark, folder)), PRIORITY_RULE).drop("set_at")


@query(
    "mask_anomalies",
    order_states(
        f"""SELECT aggregate_id, sequence_number, key, {_priority_masked('value_json')} AS value_json FROM (
        SELECT w.aggregate_id, e.sequence_number, w.key, arg_max(w.value_json, w.sequence_number) AS value_json
        FROM order_log e JOIN order_writes w ON w.aggregate_id = e.aggregate_id AND w.sequence_number <= e.sequence_number
        WHERE e.event_type = 'ORDER_CANCELLED' GROUP BY 1, 2, 3)"""
    ),
)
def _mask_anomalies(spark, folder):
    events = order_log(spark, folder)
    rules, _ = load_rules([{"code": "GONE", "condition": "status == DELETED"}])
    states = attach_states(events, scan_anomalies(events, rules))
    return governance.mask_state(states, PRIORITY_RULE).drop("global_position", "event_id")


REQUESTS = """
requests AS (
  SELECT 'ORD-' || o_orderkey AS aggregate_id, CAST(o_custkey % 12 AS BIGINT) AS sequence_number, 'user-' || o_custkey AS user_id,
         CASE WHEN o_orderpriority = '5-LOW' THEN ' ' ELSE o_orderpriority END AS reason FROM orders)"""


def _requests(spark, folder):
    return read_sample(spark, folder, "orders").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("aggregate_id"),
        (F.col("o_custkey") % 12).alias("sequence_number"),
        F.concat(F.lit("user-"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", " ").otherwise(F.col("o_orderpriority")).alias("reason"),
    )


@query(
    "reveal_events",
    order(
        """SELECT user_id, reason, aggregate_id, sequence_number, event_type, payload
        FROM requests JOIN order_log USING (aggregate_id, sequence_number) WHERE trim(reason) <> ''""",
        REQUESTS,
    ),
)
def _reveal(spark, folder):
    revealed, _ = governance.reveal_events(order_log(spark, folder), _requests(spark, folder))
    return revealed.select("user_id", "reason", "aggregate_id", "sequence_number", "event_type", "payload")


@query(
    "reveal_audit",
    order(
        """SELECT 'REVEAL_PII' AS action, r.aggregate_id || '#' || r.sequence_number AS resource_id, user_id,
        '{"reason":"' || reason || '","found":' || (e.event_id IS NOT NULL) || '}' AS details_json
        FROM requests r LEFT JOIN order_log e ON e.aggregate_id = r.aggregate_id AND e.sequence_number = r.sequence_number
        WHERE trim(reason) <> ''""",
        REQUESTS,
    ),
)
def _reveal_audit(spark, folder):
    _, audit = governance.reveal_events(order_log(spark, folder), _requests(spark, folder))
    return audit.select("action", "resource_id", "user_id", "details_json")


POLICY = governance.Policy(
    roles=[
        governance.Role("support", ["view-timeline", "VIEW REPLAY"], ["orders"], ["order"]),
        governance.Role("analyst", ["VIEW_TIMELINE"], ["activity", "chat"], ["USER"]),
        governance.Role("auditor", ["VIEW_AUDIT_LOG"]),
    ],
    default_roles=["analyst"],
    principal_roles={"ann": ["support"]},
)


def _sources(spark, folder):
    return {
        "orders": order_log(spark, folder),
        "activity": activity_log(spark, folder),
        "chat": conversation_log(spark, folder),
    }


ALL_LOGS = """
all_logs AS (
  SELECT event_id, aggregate_id, aggregate_type, sequence_number, 'orders' AS source_id FROM order_log
  UNION ALL SELECT event_id, aggregate_id, aggregate_type, sequence_number, 'activity' FROM activity
  UNION ALL SELECT event_id, aggregate_id, aggregate_type, sequence_number, 'chat' FROM conversation_log)"""


@query(
    "scope_filter",
    with_logs(
        ACTIVITY, ORDERS, CONVERSATIONS, ALL_LOGS,
        body="SELECT * FROM all_logs WHERE source_id = 'orders' OR (source_id IN ('activity', 'chat') AND aggregate_type = 'USER')",
    ),
)
def _scope(spark, folder):
    events = registry.union_sources(_sources(spark, folder))
    seen = governance.scope_filter(events, POLICY, "ann", "view_timeline")
    return seen.select("event_id", "aggregate_id", "aggregate_type", "sequence_number", "source_id")


@query(
    "union_sources",
    with_logs(ACTIVITY, ORDERS, CONVERSATIONS, ALL_LOGS, body="SELECT * FROM all_logs"),
)
def _union(spark, folder):
    return registry.union_sources(_sources(spark, folder)).select(
        "event_id", "aggregate_id", "aggregate_type", "sequence_number", "source_id"
    )


@query(
    "select_source",
    conversation("SELECT event_id, aggregate_id, 'chat' AS source_id FROM conversation_log"),
)
def _select_source(spark, folder):
    return registry.select_source(_sources(spark, folder), " ", "chat").select("event_id", "aggregate_id", "source_id")


@query(
    "authorize_requests",
    """SELECT o_orderkey AS request_id, reason, reason = 'ALLOW' AS allowed FROM (
      SELECT o_orderkey, CASE
        WHEN o_orderpriority = '1-URGENT' THEN 'DENY_AUTH_REQUIRED'
        WHEN permitted_order AND source = 'orders' AND kind = 'Order' THEN 'ALLOW'
        WHEN o_orderpriority = '5-LOW' THEN 'DENY_MISSING_PERMISSION'
        WHEN source IN ('activity') AND kind = 'USER' THEN 'ALLOW'
        WHEN permitted_order AND source <> 'orders' THEN 'DENY_SOURCE_SCOPE'
        WHEN source = 'orders' THEN 'DENY_SOURCE_SCOPE'
        ELSE 'DENY_AGGREGATE_TYPE_SCOPE' END AS reason
      FROM (SELECT o_orderkey, o_orderpriority, o_orderpriority = '2-HIGH' AS permitted_order,
              CASE WHEN o_custkey % 2 = 0 THEN 'orders' ELSE 'activity' END AS source,
              CASE WHEN o_custkey % 3 = 0 THEN 'USER' ELSE 'Order' END AS kind FROM orders))""",
)
def _authorize(spark, folder):
    priority = F.col("o_orderpriority")
    requests = read_sample(spark, folder, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.when(priority != "1-URGENT", "bob").alias("user_id"),
        F.when(priority == "2-HIGH", F.array(F.lit("support"))).otherwise(F.array().cast("array<string>")).alias("roles"),
        F.when(priority == "5-LOW", "reveal pii").otherwise("view-timeline").alias("permission"),
        F.when(F.col("o_custkey") % 2 == 0, "orders").otherwise("activity").alias("source_id"),
        F.when(F.col("o_custkey") % 3 == 0, "USER").otherwise("Order").alias("aggregate_type"),
    )
    return governance.authorize_requests(requests, POLICY).select("request_id", "reason", "allowed")


@query(
    "recent_audit",
    f"""SELECT 'VIEW_' || upper(event_type) AS action, 'U-' || user_id AS user_id, event_id AS audit_id, {iso('ts')} AS at_text
    FROM events WHERE event_type = 'purchase' ORDER BY ts DESC LIMIT 5000""",
)
def _recent_audit(spark, folder):
    audit = read_sample(spark, folder, "events").select(
        F.col("event_id").alias("audit_id"),
        F.concat(F.lit("VIEW_"), F.upper("event_type")).alias("action"),
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    found = governance.recent_audit(audit, 5000, "VIEW_PURCHASE")
    return found.select("action", "user_id", "audit_id", instant_text(F.col("created_at")).alias("at_text"))


@query(
    "export_csv",
    conversation(
        f"""SELECT aggregate_id, CAST(0 AS BIGINT) AS line_no, 'sequence,event_type,timestamp,payload' AS line FROM conversation_log GROUP BY 1
        UNION ALL SELECT aggregate_id, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number),
        sequence_number || ',"' || event_type || '","' || {iso('ts')} || '","' || replace(payload, '"', '""') || '"' FROM conversation_log"""
    ),
)
def _csv(spark, folder):
    return export.export_csv(conversation_log(spark, folder))


EXPORTED = datetime(2024, 2, 1)


@query(
    "export_json",
    order(
        f"""SELECT aggregate_id, CAST(0 AS BIGINT) AS line_no,
          '{{"aggregateId":"' || aggregate_id || '","exportedAt":"2024-02-01T00:00:00Z","eventCount":' || count(*) || ',"limit":100,"events":[' AS line
        FROM order_log GROUP BY 1
        UNION ALL SELECT aggregate_id, row_number() OVER w,
          '{{"eventId":"' || event_id || '","aggregateId":"' || aggregate_id || '","aggregateType":"ORDER","sequenceNumber":' || sequence_number
          || ',"eventType":"' || event_type || '","payload":' || to_json(payload) || ',"metadata":' || to_json(metadata)
          || ',"timestamp":"' || {iso('ts')} || '","globalPosition":' || global_position || '}}'
          || CASE WHEN lead(1) OVER w IS NULL THEN '' ELSE ',' END
        FROM order_log WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number)
        UNION ALL SELECT DISTINCT aggregate_id, CAST(4611686018427387904 AS BIGINT), ']}}' FROM order_log"""
    ),
)
def _json_export(spark, folder):
    return export.export_json(order_log(spark, folder), EXPORTED, limit=100)


def _plain_sql(value: str) -> str:
    return f"coalesce(CASE WHEN {value} LIKE '\"%' THEN json_extract_string({value}, '$') ELSE {value} END, 'null')"


@query(
    "export_markdown",
    order_changes(
        f"""SELECT aggregate_id, CAST(n - 4 AS BIGINT) AS line_no,
          CASE n WHEN 0 THEN '# Event History: ' || aggregate_id WHEN 1 THEN '' WHEN 2 THEN '| # | Event Type | Timestamp | Changes |'
            ELSE '|---|-----------|-----------|----------|' END AS line
        FROM (SELECT DISTINCT aggregate_id FROM order_log), range(4) AS r(n)
        UNION ALL
        SELECT aggregate_id, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number),
          '| ' || sequence_number || ' | ' || event_type || ' | ' || {iso('e.ts')} || ' | ' || coalesce(changes, '—') || ' |'
        FROM order_log e LEFT JOIN (
          SELECT aggregate_id, sequence_number,
            string_agg(key || ': ' || {_plain_sql('old_json')} || ' → ' || {_plain_sql('new_json')}, ', '
              ORDER BY key || ': ' || {_plain_sql('old_json')} || ' → ' || {_plain_sql('new_json')}) AS changes
          FROM order_diffs GROUP BY 1, 2) USING (aggregate_id, sequence_number)"""
    ),
)
def _markdown(spark, folder):
    return export.export_markdown(order_log(spark, folder))


@query(
    "export_fixture",
    order(
        f"""SELECT aggregate_id, CAST(0 AS BIGINT) AS line_no, '// Generated event fixture, do not edit' || chr(10) || '// Aggregate: ' || aggregate_id
          || chr(10) || chr(10) || 'public class ' || regexp_replace(aggregate_id, '[^a-zA-Z0-9_]', '_', 'g') || 'Fixture {{' || chr(10) || chr(10)
          || '    public static List<Map<String, Object>> events() {{' || chr(10) || '        return List.of(' AS line
        FROM order_log GROUP BY aggregate_id
        UNION ALL SELECT aggregate_id, row_number() OVER w, '            Map.of(' || chr(10) || '                "eventType", "' || event_type || '",' || chr(10)
          || '                "sequenceNumber", ' || sequence_number || ',' || chr(10) || '                "payload", "' || replace(payload, '"', chr(92) || '"') || '",' || chr(10)
          || '                "timestamp", "' || {iso('ts')} || '"' || chr(10) || '            )' || CASE WHEN lead(1) OVER w IS NULL THEN '' ELSE ',' END
        FROM order_log WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number)
        UNION ALL SELECT DISTINCT aggregate_id, CAST(4611686018427387904 AS BIGINT), '        );' || chr(10) || '    }}' || chr(10) || '}}' FROM order_log"""
    ),
)
def _fixture(spark, folder):
    return export.export_fixture(order_log(spark, folder))


@query(
    "bulk_export",
    conversation(
        f"""SELECT event_id, aggregate_id, sequence_number, '{{"text":' || to_json({mask_sql('text')}) || '}}' AS payload FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) AS step FROM conversation_log) WHERE step <= 3"""
    ),
)
def _bulk(spark, folder):
    return export.bulk_export(conversation_log(spark, folder), 3).select(
        "event_id", "aggregate_id", "sequence_number", "payload"
    )


RECORDS = """
records AS (
  SELECT event_id AS off, CASE user_id % 5
    WHEN 0 THEN '{"eventId":"e-' || event_id || '","aggregateId":"U-' || user_id || '","aggregateType":"USER","sequenceNumber":"' || event_id
      || '","eventType":"' || event_type || '","payload":{"k":' || json_extract_string(props, '$.k') || '},"metadata":"{\\"a\\":1}"}'
    WHEN 1 THEN '{"event_id":"e-' || event_id || '","aggregate_id":"U-' || user_id || '","sequence_number":' || event_id || ',"timestamp":1704067200}'
    WHEN 2 THEN '{"type":"' || event_type || '","x":' || event_id || '}'
    WHEN 3 THEN 'not json ' || event_id
    ELSE '[' || event_id || ']' END AS value, user_id, user_id % 5 AS form, event_type, props, ts FROM events)"""


PARSED_RECORDS = f"""SELECT CASE WHEN form < 2 THEN 'e-' || off ELSE 'events-0-' || off END AS event_id,
  CASE WHEN form < 2 THEN 'U-' || user_id ELSE CAST(user_id AS VARCHAR) END AS aggregate_id,
  CASE WHEN form = 0 THEN 'USER' ELSE 'unknown' END AS aggregate_type, off AS sequence_number,
  CASE WHEN form IN (0, 2) THEN event_type ELSE 'UnknownEvent' END AS event_type,
  CASE form WHEN 0 THEN '{{"k":' || json_extract_string(props, '$.k') || '}}' WHEN 1 THEN '{{}}' ELSE value END AS payload,
  CASE form WHEN 0 THEN '{{"a":1}}' ELSE '{{}}' END AS metadata,
  CASE WHEN form = 1 THEN '2024-01-01T00:00:00Z' ELSE {iso('ts')} END AS ts_text, off AS global_position
  FROM records WHERE form < 3"""


def as_records(table):
    """Stream records of every form made from an events table, batch or streaming."""
    text = lambda c: F.col(c).cast("string")
    form = F.col("user_id") % 5
    full = F.concat(
        F.lit('{"eventId":"e-'), text("event_id"), F.lit('","aggregateId":"U-'), text("user_id"),
        F.lit('","aggregateType":"USER","sequenceNumber":"'), text("event_id"), F.lit('","eventType":"'), F.col("event_type"),
        F.lit('","payload":{"k":'), F.get_json_object("props", "$.k"), F.lit('},"metadata":"{\\"a\\":1}"}'),
    )
    snake = F.concat(
        F.lit('{"event_id":"e-'), text("event_id"), F.lit('","aggregate_id":"U-'), text("user_id"),
        F.lit('","sequence_number":'), text("event_id"), F.lit(',"timestamp":1704067200}'),
    )
    minimal = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","x":'), text("event_id"), F.lit("}"))
    value = (
        F.when(form == 0, full).when(form == 1, snake).when(form == 2, minimal)
        .when(form == 3, F.concat(F.lit("not json "), text("event_id")))
        .otherwise(F.concat(F.lit("["), text("event_id"), F.lit("]")))
    )
    return table.select(
        text("user_id").alias("key"), value.alias("value"), F.lit("events").alias("topic"), F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"),
    )


@query(
    "parse_stream_records",
    with_logs(
        RECORDS,
        body=PARSED_RECORDS,
    ),
)
def _parse_records(spark, folder):
    good, _ = split_malformed(parse_stream_records(as_records(read_sample(spark, folder, "events"))))
    return good.withColumn("ts_text", instant_text(F.col("timestamp"))).drop("timestamp", "topic", "partition")


@query("split_malformed", with_logs(RECORDS, body='SELECT off AS "offset", value FROM records WHERE form >= 3'))
def _split_malformed(spark, folder):
    _, bad = split_malformed(parse_stream_records(as_records(read_sample(spark, folder, "events"))))
    return bad.select("offset", "value")


@query(
    "route_streams",
    """SELECT 'C-' || c_custkey AS source_id, CASE
      WHEN b.s IS NOT NULL THEN CASE WHEN b.s IN (SELECT 'C-' || s_suppkey FROM supplier) THEN b.s END
      WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'C-' || c_custkey
      WHEN c_custkey = 1400 THEN (SELECT 'C-' || arg_min(s_suppkey, s_suppkey) FROM supplier WHERE s_acctbal > 0) END AS stream_id
    FROM customer LEFT JOIN (
      SELECT o_custkey AS k, CASE WHEN min(o_orderkey) % 3 = 0 THEN '' ELSE 'C-' || min(o_orderkey) END AS s FROM orders GROUP BY 1) b ON b.k = c_custkey""",
)
def _route(spark, folder):
    name = lambda c: F.concat(F.lit("C-"), F.col(c).cast("string"))
    sources = read_sample(spark, folder, "customer").select(
        name("c_custkey").alias("source_id"), (F.col("c_custkey") == 1400).alias("is_default")
    )
    first = read_sample(spark, folder, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    bindings = first.select(
        name("o_custkey").alias("source_id"), F.when(F.col("o") % 3 == 0, "").otherwise(name("o")).alias("stream_id")
    )
    streams = read_sample(spark, folder, "supplier").select(
        name("s_suppkey").alias("stream_id"), (F.col("s_acctbal") > 0).alias("ready"), F.col("s_suppkey").alias("position")
    )
    return registry.route_streams(sources, bindings, streams)


def _balance():
    cents = F.get_json_object("payload", "$.line_cents").try_cast("long")
    return reducers.ColumnReducer(
        sums={"ordered_cents": cents, "lines": F.when(F.col("event_type") == "LINE_ITEM_ADDED", 1).cast("long")},
        latest={"status": F.get_json_object("payload", "$.status")},
    )


@query(
    "replay_columns",
    order(
        """SELECT aggregate_id, sequence_number, event_type,
        CAST(sum(coalesce(CAST(json_extract_string(payload, '$.line_cents') AS BIGINT), 0)) OVER w AS BIGINT) AS ordered_cents,
        CAST(count(*) FILTER (event_type = 'LINE_ITEM_ADDED') OVER w AS BIGINT) AS lines,
        last_value(json_extract_string(payload, '$.status') IGNORE NULLS) OVER w AS status
        FROM order_log WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
)
def _replay_columns(spark, folder):
    return reducers.replay_columns(order_log(spark, folder), _balance()).drop("global_position", "event_id")


@query(
    "reduce_columns",
    order(
        """SELECT aggregate_id, CAST(sum(coalesce(CAST(json_extract_string(payload, '$.line_cents') AS BIGINT), 0)) AS BIGINT) AS ordered_cents,
        count(*) FILTER (event_type = 'LINE_ITEM_ADDED') AS lines,
        arg_max(json_extract_string(payload, '$.status'), sequence_number) AS status FROM order_log GROUP BY 1"""
    ),
)
def _reduce_columns(spark, folder):
    return reducers.reduce_columns(order_log(spark, folder), _balance())


def _fold_lines(state: dict, event: dict) -> dict:
    state["n"] = state.get("n", 0) + 1
    state["qty"] = state.get("qty", 0) + event["payload"].get("qty", 0)
    return state


@query(
    "replay_fold",
    order(
        """SELECT aggregate_id, sequence_number, event_type, '{"n":' || count(*) OVER w || ',"qty":' ||
        CAST(sum(coalesce(CAST(json_extract_string(payload, '$.qty') AS BIGINT), 0)) OVER w AS BIGINT) || '}' AS state
        FROM order_log WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
    ),
)
def _replay_fold(spark, folder):
    return reducers.replay_fold(order_log(spark, folder), _fold_lines).drop("global_position", "event_id")


def _merge_lines(earlier: dict, later: dict) -> dict:
    return {k: earlier.get(k, 0) + later.get(k, 0) for k in earlier.keys() | later.keys()}


@query(
    "replay_mergeable",
    activity(
        """SELECT aggregate_id, sequence_number, '{"n":' || count(*) OVER w || ',"qty":0}' AS state
        FROM activity WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number)"""
    ),
)
def _replay_mergeable(spark, folder):
    fold = reducers.MergeableFold(_fold_lines, _merge_lines)
    return reducers.replay_mergeable(activity_log(spark, folder), fold, 1024).drop(
        "global_position", "event_id", "event_type"
    )


def _reduce_lines(events) -> dict:
    parts = [e["payload"]["part"] for e in events if "part" in e["payload"]]
    return {"parts": parts}


@query(
    "reduce_events",
    order(
        """SELECT aggregate_id, '{"parts":[' || coalesce(string_agg(json_extract_string(payload, '$.part'), ',' ORDER BY sequence_number), '') || ']}' AS state
        FROM order_log GROUP BY 1"""
    ),
)
def _reduce_events(spark, folder):
    return reducers.reduce_events(order_log(spark, folder), _reduce_lines)


@query(
    "replay_with",
    with_logs(
        ORDERS, ACTIVITY, CONVERSATIONS,
        body="""SELECT aggregate_id, sequence_number, key, value_json FROM (
          SELECT aggregate_id, sequence_number, 'n' AS key, CAST(count(*) OVER w AS VARCHAR) AS value_json FROM conversation_log
            WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number)
          UNION ALL SELECT aggregate_id, sequence_number, 'qty', '0' FROM conversation_log
          UNION ALL SELECT aggregate_id, sequence_number, 'spent', CAST(CAST(sum(cents) OVER w AS BIGINT) AS VARCHAR) FROM activity
            WINDOW w AS (PARTITION BY aggregate_id ORDER BY sequence_number))""",
    ),
)
def _replay_with(spark, folder):
    events = activity_log(spark, folder).unionByName(conversation_log(spark, folder)).select(*EVENT_COLUMNS)
    cents = F.get_json_object("payload", "$.cents").try_cast("long")
    chosen = {"USER": reducers.ColumnReducer({"spent": cents}), "CONVERSATION": _fold_lines}
    return reducers.replay_with(events, chosen).drop("global_position", "event_id")


@query(
    "append_audit",
    f"""SELECT 'VIEW_' || upper(event_type) AS action, 'U-' || user_id AS user_id, CAST(event_id AS VARCHAR) AS resource_id,
    {iso('ts')} AS at_text FROM events""",
)
def _append_audit(spark, folder):
    """Two appends to one audit table, read back."""
    records = read_sample(spark, folder, "events").select(
        F.concat(F.lit("VIEW_"), F.upper("event_type")).alias("action"),
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("event_id").cast("string").alias("resource_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    path = run_folder(spark, "audit")
    views = F.col("action") == "VIEW_VIEW"
    governance.append_audit(records.filter(views), path)
    governance.append_audit(records.filter(~views), path)
    kept = spark.read.parquet(path)
    return kept.select("action", "user_id", "resource_id", instant_text(F.col("created_at")).alias("at_text"))


@query(
    "write_json_events",
    conversation("SELECT event_id, aggregate_id, aggregate_type, sequence_number, payload FROM conversation_log"),
)
def _write_json(spark, folder):
    path = run_folder(spark, "json")
    events = conversation_log(spark, folder)
    export.write_json_events(events, path)
    back = spark.read.schema(events.schema).json(path)
    return back.select("event_id", "aggregate_id", "aggregate_type", "sequence_number", "payload")


@query(
    "write_lines",
    order(
        f"""SELECT 'sequence,event_type,timestamp,payload' AS line FROM order_log GROUP BY aggregate_id
        UNION ALL SELECT sequence_number || ',"' || event_type || '","' || {iso('ts')} || '","' || replace(payload, '"', '""') || '"' FROM order_log"""
    ),
)
def _write_lines(spark, folder):
    path = run_folder(spark, "csv")
    export.write_lines(export.export_csv(order_log(spark, folder), ranged=True), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("load_event_table", order("SELECT event_id, aggregate_id, sequence_number, event_type FROM order_log"))
def _load(spark, folder):
    order_log(spark, folder).createOrReplaceTempView("tidemark_order_events")
    events = load_event_table(spark, "tidemark_order_events")
    return events.select("event_id", "aggregate_id", "sequence_number", "event_type")


@query(
    "events_where",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS aggregate_id, event_id AS sequence_number, event_type
    FROM events WHERE user_id IN (7, 11) AND event_id >= 100""",
)
def _where(spark, folder):
    """Two aggregates of a table with its own column names and kinds; the conditions reach the scan."""
    names = {"aggregate_id": "user_id", "sequence_number": "event_id", "timestamp": "ts", "payload": "props"}
    asked = [("aggregate_id", "in", ["7", "11"]), ("sequence_number", ">=", 100)]
    events = map_event_columns(read_sample(spark, folder, "events"), names, where=asked)
    return events.select("event_id", "aggregate_id", "sequence_number", "event_type")


@query(
    "event_time",
    f"SELECT o_orderkey AS id, {iso('o_orderdate')} AS stated, {iso('o_orderdate')} AS recorded FROM orders",
)
def _event_time(spark, folder):
    at = F.col("o_orderdate").cast("timestamp")
    payload = F.to_json(F.struct(instant_text(at).alias("createdDate")))
    return read_sample(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        instant_text(event_time(payload, F.lit(None).cast("timestamp"))).alias("stated"),
        instant_text(event_time(F.lit("{}"), at)).alias("recorded"),
    )


@query(
    "write_event_table",
    order("SELECT event_id, aggregate_id, aggregate_type, sequence_number, event_type, payload, metadata, global_position FROM order_log"),
)
def _write_table(spark, folder):
    path = run_folder(spark, "events")
    write_event_table(order_log(spark, folder), path)
    return read_event_table(spark, path).drop("timestamp")
