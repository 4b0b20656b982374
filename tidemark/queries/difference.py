"""Diff and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import instant_text
from ..operators import detect, diff
from ..operators.replay import current_state, survey, transitions
from ..plans.running import cuts
from ..sources.sample_logs import activity_log, order_log, read_sample
from .catalog import query
from .sql_logs import activity, activity_states, iso, order_changes, order_states

ORDER_LAST = """
order_last AS (
  SELECT aggregate_id, key,
         arg_max(value_json, sequence_number * 2 + CASE WHEN value_json = '"DELETED"' THEN 0 ELSE 1 END) AS value_json
  FROM order_writes GROUP BY 1, 2)"""

PAIRS = """
pairs AS (
  SELECT 'ORD-' || o_orderkey AS left_id, 'ORD-' || (o_orderkey + 1) AS right_id FROM orders)"""


def _pairs(spark, folder):
    key = F.col("o_orderkey")
    return read_sample(spark, folder, "orders").select(
        F.concat(F.lit("ORD-"), key.cast("string")).alias("left_id"),
        F.concat(F.lit("ORD-"), (key + 1).cast("string")).alias("right_id"),
    )


DIFF_AGGREGATES = """
SELECT left_id, right_id, key, l.value_json AS old_json, r.value_json AS new_json
FROM (SELECT left_id, right_id, key, value_json FROM pairs JOIN order_last ON aggregate_id = left_id) l
FULL JOIN (SELECT left_id, right_id, key, value_json FROM pairs JOIN order_last ON aggregate_id = right_id) r
  USING (left_id, right_id, key)
WHERE l.value_json IS DISTINCT FROM r.value_json"""


@query("diff_aggregates", order_states(DIFF_AGGREGATES, ORDER_LAST, PAIRS))
def _diff_aggregates(spark, folder):
    return diff.diff_aggregates(order_log(spark, folder), _pairs(spark, folder))


AT_SEQUENCES = """
at_rows AS (
  SELECT aggregate_id, from_sequence, to_sequence, key,
         arg_max(value_json, sequence_number) FILTER (sequence_number <= from_sequence) AS old_json,
         arg_max(value_json, sequence_number) FILTER (sequence_number <= to_sequence) AS new_json
  FROM order_writes JOIN (
    SELECT 'ORD-' || o_orderkey AS aggregate_id, o_custkey % 3 + 1 AS from_sequence, o_custkey % 5 + 3 AS to_sequence FROM orders)
    USING (aggregate_id)
  GROUP BY 1, 2, 3, 4)"""


@query(
    "diff_at_sequences",
    order_states("SELECT * FROM at_rows WHERE old_json IS DISTINCT FROM new_json", AT_SEQUENCES),
)
def _diff_at(spark, folder):
    requests = read_sample(spark, folder, "orders").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("aggregate_id"),
        (F.col("o_custkey") % 3 + 1).alias("from_sequence"),
        (F.col("o_custkey") % 5 + 3).alias("to_sequence"),
    )
    return diff.diff_at_sequences(order_log(spark, folder), requests)


@query(
    "field_diff",
    order_states(
        """SELECT aggregate_id, key, old_json, new_json FROM (
        SELECT aggregate_id, key, arg_max(value_json, sequence_number) FILTER (sequence_number = 1) AS old_json,
               arg_max(value_json, sequence_number * 2 + CASE WHEN value_json = '"DELETED"' THEN 0 ELSE 1 END) AS new_json
        FROM order_writes GROUP BY 1, 2) WHERE old_json IS DISTINCT FROM new_json"""
    ),
)
def _field_diff(spark, folder):
    events = order_log(spark, folder)
    # the survey of the log holds for its first events too
    plan = survey(events)
    opening = current_state(events.filter(F.col("sequence_number") == 1), plan, grouped=True)
    return diff.field_diff(opening, current_state(events, plan, grouped=True), ["aggregate_id"])


DEEP_DOCUMENTS = """
doc_pairs AS (
  SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority AS priority, count(l_orderkey) AS n,
         CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS qty
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _deep_pairs(spark, folder):
    """Two nested documents per order: as placed and as delivered."""
    lines = read_sample(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty")
    )
    orders = read_sample(spark, folder, "orders")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    n, qty = F.coalesce("n", F.lit(0)), F.coalesce("qty", F.lit(0))
    left = F.to_json(
        F.struct(
            F.struct(
                F.col("o_custkey").alias("cust"),
                F.array(F.lit("open"), F.col("o_orderpriority")).alias("tags"),
                F.lit(3).alias("retries"),
            ).alias("account")
        )
    )
    right = F.to_json(
        F.struct(
            F.struct(
                F.col("o_custkey").alias("cust"),
                F.array(F.lit("open"), F.lit("2-HIGH"), n.cast("string")).alias("tags"),
                F.struct(qty.alias("qty")).alias("delivery"),
            ).alias("account")
        )
    )
    return joined.select(F.col("o_orderkey").alias("id"), left.alias("before"), right.alias("after"))


@query(
    "deep_diff",
    """WITH """
    + DEEP_DOCUMENTS.lstrip()
    + """
    SELECT id, '$.account.tags[1]' AS path, 'changed' AS kind, '"' || priority || '"' AS old_json, '"2-HIGH"' AS new_json
    FROM doc_pairs WHERE priority <> '2-HIGH'
    UNION ALL SELECT id, '$.account.tags[2]', 'added', NULL, '"' || n || '"' FROM doc_pairs
    UNION ALL SELECT id, '$.account.retries', 'removed', '3', NULL FROM doc_pairs
    UNION ALL SELECT id, '$.account.delivery', 'added', NULL, '{"qty":' || qty || '}' FROM doc_pairs""",
)
def _deep_diff(spark, folder):
    return diff.deep_diff(_deep_pairs(spark, folder), "before", "after", ["id"])


@query(
    "diff_rows",
    order_changes(
        """SELECT aggregate_id, sequence_number, key AS field, 'changed' AS kind, old_json, new_json,
        count(*) OVER (PARTITION BY aggregate_id, sequence_number) AS changes FROM order_diffs"""
    ),
)
def _diff_rows(spark, folder):
    by = ["aggregate_id", "sequence_number"]
    events = order_log(spark, folder)
    plan = survey(events)
    changed = transitions(events, plan=plan, grouped=True)
    counted = diff.diff_counts(changed, by, beside=True, dealt=None if cuts(plan.assign) else by[:1])
    rows = diff.diff_rows(counted, [*by, "changes"])
    return rows.select(*by, "field", "kind", "old_json", "new_json", "changes")


@query(
    "changed_keys",
    "WITH "
    + DEEP_DOCUMENTS.lstrip()
    + """
    SELECT id, 'lines' AS key FROM doc_pairs WHERE n % 2 = 1
    UNION ALL SELECT id, 'priority' FROM doc_pairs WHERE priority <> '2-HIGH'
    UNION ALL SELECT id, 'open' FROM doc_pairs WHERE qty >= 100
    UNION ALL SELECT id, 'delivery' FROM doc_pairs WHERE qty > 0""",
)
def _changed_keys(spark, folder):
    """Orders as placed and as delivered: keys that stay, change, come, go, and a nested one."""
    lines = read_sample(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty")
    )
    orders = read_sample(spark, folder, "orders")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
    n, qty = F.coalesce("n", F.lit(0)), F.coalesce("qty", F.lit(0))
    cust = F.col("o_custkey").alias("cust")
    before = F.struct(cust, n.alias("lines"), F.col("o_orderpriority").alias("priority"), F.lit(True).alias("open"))
    after = F.struct(
        cust,
        (n + n % 2).alias("lines"),
        F.lit("2-HIGH").alias("priority"),
        F.when(qty < 100, True).alias("open"),
        F.when(qty > 0, F.struct(F.array(qty).alias("parts"))).alias("delivery"),
    )
    pairs = joined.select(F.col("o_orderkey").alias("id"), F.to_json(before).alias("before"), F.to_json(after).alias("after"))
    return diff.changed_keys(diff.deep_diff(pairs, "before", "after", ["id"]), ["id"])


@query(
    "filter_states",
    activity_states(
        """SELECT aggregate_id, 'cents' AS key, value_json FROM (
        SELECT aggregate_id, arg_max(value_json, sequence_number) AS value_json FROM activity_writes WHERE key = 'cents' GROUP BY 1)
        WHERE CAST(value_json AS BIGINT) > 5000"""
    ),
)
def _filter_states(spark, folder):
    return detect.filter_states(current_state(activity_log(spark, folder)), "cents > 5000").drop("set_at")


PROBES = """
flags AS (
  SELECT aggregate_id, sequence_number, event_type, ts, cents > 6000 AS holds,
         row_number() OVER (PARTITION BY aggregate_id ORDER BY sequence_number) - 1 AS idx,
         count(*) OVER (PARTITION BY aggregate_id) AS n
  FROM activity),
search AS (
  SELECT aggregate_id, CAST(0 AS BIGINT) AS low, n - 1 AS high, CAST(NULL AS BIGINT) AS found, CAST(0 AS BIGINT) AS probes
  FROM flags WHERE idx = n - 1 AND holds
  UNION ALL
  SELECT s.aggregate_id, CASE WHEN f.holds THEN s.low ELSE f.idx + 1 END, CASE WHEN f.holds THEN f.idx - 1 ELSE s.high END,
         CASE WHEN f.holds THEN f.idx ELSE s.found END, s.probes + 1
  FROM search s JOIN flags f ON f.aggregate_id = s.aggregate_id AND f.idx = (s.low + s.high) // 2
  WHERE s.low <= s.high)"""


@query(
    "bisect",
    activity(
        f"""SELECT f.aggregate_id, f.sequence_number, f.event_type, {iso('f.ts')} AS ts_text, s.probes + 1 AS replays,
          'Event #' || f.sequence_number || ' (' || f.event_type || ' at ' || {iso('f.ts')} || ') first caused the condition' AS summary
        FROM search s JOIN flags f ON f.aggregate_id = s.aggregate_id AND f.idx = s.found WHERE s.low > s.high
        UNION ALL
        SELECT aggregate_id, NULL, NULL, NULL, 1, 'Condition never becomes true in entire history'
        FROM flags WHERE idx = n - 1 AND NOT holds""",
        PROBES,
    ).replace("WITH", "WITH RECURSIVE", 1),
)
def _bisect(spark, folder):
    found = detect.bisect(activity_log(spark, folder), "cents > 6000")
    return found.select(
        "aggregate_id", "sequence_number", "event_type", instant_text(F.col("timestamp")).alias("ts_text"), "replays", "summary"
    )


@query(
    "bisect_transitions",
    order_changes(
        """SELECT aggregate_id, sequence_number, key, old_json, new_json FROM order_diffs
        JOIN (SELECT aggregate_id, sequence_number FROM order_log WHERE event_type = 'ORDER_CANCELLED')
        USING (aggregate_id, sequence_number)"""
    ),
)
def _bisect_transitions(spark, folder):
    events = order_log(spark, folder)
    found = detect.bisect(events, "status == DELETED")
    return detect.bisect_transitions(events, found).drop("global_position", "event_id")


@query(
    "first_occurrence",
    activity(
        f"""SELECT aggregate_id, min(sequence_number) FILTER (holds) AS sequence_number,
        arg_min(event_type, sequence_number) FILTER (holds) AS event_type,
        arg_min({iso('ts')}, sequence_number) FILTER (holds) AS ts_text,
        coalesce(max(sequence_number) FILTER (NOT holds), 0) < min(sequence_number) FILTER (holds) AS is_monotone
        FROM (SELECT *, k = 7 AS holds FROM activity) GROUP BY 1 HAVING bool_or(holds)"""
    ),
)
def _first_occurrence(spark, folder):
    found = detect.first_occurrence(activity_log(spark, folder), "k == 7")
    return found.select(
        "aggregate_id", "sequence_number", "event_type", instant_text(F.col("timestamp")).alias("ts_text"), "is_monotone"
    )


RULES, _ = detect.load_rules(
    [
        {"code": "LARGE_VALUE", "condition": "cents >= 9000", "severity": "high", "description": "large value"},
        {"code": "ERROR_SEEN", "condition": "_lastEventType == ERROR", "severity": "critical"},
        {"code": "LOW_K", "condition": "k < 2", "severity": "low"},
    ]
)
REPORT = "code, description, severity, aggregate_id, sequence_number, event_type"


def _hits(source: str) -> str:
    return f"""
hits AS (
  SELECT 'LARGE_VALUE' AS code, 'large value' AS description, 'HIGH' AS severity, aggregate_id, sequence_number, event_type FROM {source} WHERE cents >= 9000
  UNION ALL SELECT 'ERROR_SEEN', '_lastEventType == ERROR', 'CRITICAL', aggregate_id, sequence_number, event_type FROM {source} WHERE event_type = 'ERROR'
  UNION ALL SELECT 'LOW_K', 'k < 2', 'LOW', aggregate_id, sequence_number, event_type FROM {source} WHERE k < 2
  UNION ALL SELECT 'SNAPSHOT_NEEDED', 'Aggregate has many events without snapshot (performance risk)', 'MEDIUM', aggregate_id, sequence_number, event_type
    FROM {source} WHERE sequence_number > 50 AND sequence_number % 50 = 0)"""


RECENT = """
recent_ids AS (
  SELECT aggregate_id FROM (SELECT * FROM activity ORDER BY global_position DESC LIMIT 100)
  GROUP BY aggregate_id ORDER BY min(global_position) LIMIT 20),
recent_log AS (SELECT * FROM activity WHERE aggregate_id IN (SELECT aggregate_id FROM recent_ids))"""


@query("scan_anomalies", activity(f"SELECT {REPORT} FROM hits", _hits("activity")))
def _scan(spark, folder):
    return detect.scan_anomalies(activity_log(spark, folder), RULES).select(*REPORT.split(", "))


@query(
    "scan_anomalies_lasting",
    order_states(
        """SELECT 'GONE' AS code, aggregate_id, sequence_number FROM order_log WHERE event_type = 'ORDER_CANCELLED'
        UNION ALL SELECT 'BIG_ORDER', aggregate_id, sequence_number FROM order_log JOIN (
          SELECT aggregate_id FROM order_writes WHERE key = 'total_cents' AND CAST(value_json AS BIGINT) > 40000000) USING (aggregate_id)"""
    ),
)
def _scan_lasting(spark, folder):
    rules, _ = detect.load_rules(
        [
            {"code": "GONE", "condition": "status == DELETED"},
            {"code": "BIG_ORDER", "condition": "total_cents > 40000000"},
        ]
    )
    return detect.scan_anomalies(order_log(spark, folder), rules).select("code", "aggregate_id", "sequence_number")


@query(
    "snapshot_needed",
    activity(
        """SELECT aggregate_id, sequence_number, 'SNAPSHOT_NEEDED' AS code, 'MEDIUM' AS severity
        FROM activity WHERE sequence_number > 50 AND sequence_number % 50 = 0"""
    ),
)
def _snapshot(spark, folder):
    return detect.scan_anomalies(activity_log(spark, folder)).select(
        "aggregate_id", "sequence_number", "code", "severity"
    )


@query(
    "custom_rule",
    activity("SELECT aggregate_id, sequence_number FROM activity WHERE event_type = 'PURCHASE' AND cents > k * 100"),
)
def _custom(spark, folder):
    rule = detect.Rule(
        "DEAR_PURCHASE",
        "a purchase above its k",
        "LOW",
        ("cents", "k"),
        lambda v: (F.col("event_type") == "PURCHASE")
        & (v("cents").try_cast("double") > v("k").try_cast("double") * 100),
    )
    found = detect.scan_anomalies(activity_log(spark, folder), [rule])
    return found.filter(F.col("code") == "DEAR_PURCHASE").select("aggregate_id", "sequence_number")


@query(
    "attach_states",
    order_states(
        """SELECT w.aggregate_id, e.sequence_number, w.key,
               arg_max(w.value_json, w.sequence_number) AS value_json
        FROM order_log e JOIN order_writes w ON w.aggregate_id = e.aggregate_id AND w.sequence_number <= e.sequence_number
        WHERE e.event_type = 'ORDER_CANCELLED' GROUP BY 1, 2, 3"""
    ),
)
def _attach(spark, folder):
    events = order_log(spark, folder)
    rules, _ = detect.load_rules([{"code": "GONE", "condition": "status == DELETED"}])
    return detect.attach_states(events, detect.scan_anomalies(events, rules)).drop("global_position", "event_id")


@query(
    "report_states",
    order_states(
        """SELECT 'GONE' AS code, aggregate_id, sequence_number, '{' || string_agg('"' || key || '":' || value_json, ',' ORDER BY key) || '}' AS state
        FROM (SELECT w.aggregate_id, e.sequence_number, w.key, arg_max(w.value_json, w.sequence_number) AS value_json
              FROM order_log e JOIN order_writes w ON w.aggregate_id = e.aggregate_id AND w.sequence_number <= e.sequence_number
              WHERE e.event_type = 'ORDER_CANCELLED' GROUP BY 1, 2, 3) GROUP BY 1, 2, 3"""
    ),
)
def _report_states(spark, folder):
    events = order_log(spark, folder)
    rules, _ = detect.load_rules([{"code": "GONE", "condition": "status == DELETED"}])
    reports = detect.report_states(events, detect.scan_anomalies(events, rules))
    return reports.select("code", "aggregate_id", "sequence_number", "state")


@query("scan_recent", activity(f"SELECT {REPORT} FROM hits", RECENT, _hits("recent_log")))
def _scan_recent(spark, folder):
    return detect.scan_recent(activity_log(spark, folder), RULES).select(*REPORT.split(", "))


@query(
    "severity_counts",
    activity(
        """SELECT severity, CASE severity WHEN 'CRITICAL' THEN 'Critical' WHEN 'HIGH' THEN 'High' WHEN 'MEDIUM' THEN 'Warning' ELSE 'Info' END AS label,
        count(*) AS anomalies FROM hits GROUP BY 1""",
        _hits("activity"),
    ),
)
def _severity(spark, folder):
    return detect.severity_counts(detect.scan_anomalies(activity_log(spark, folder), RULES))
