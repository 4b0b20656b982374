"""Queries over what is stored between runs: snapshots of folds, the id index, daily totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import id_index, rollups, snapshots
from ..session import run_folder
from ..sources.sample_logs import activity_log, order_log, read_sample
from .catalog import query
from .retrieval import EVENT_SQL, shown
from .sql_logs import activity, order


def _count_cents(state: dict, event: dict) -> dict:
    state["cents"] = state.get("cents", 0) + event["payload"].get("cents", 0)
    state["n"] = state.get("n", 0) + 1
    return state


def _count_lines(state: dict, event: dict) -> dict:
    state["n"] = state.get("n", 0) + 1
    state["qty"] = state.get("qty", 0) + event["payload"].get("qty", 0)
    return state


@query(
    "fold_snapshots",
    activity(
        """SELECT aggregate_id, max(sequence_number) AS sequence_number, count(*) AS events,
        '{"cents":' || CAST(sum(coalesce(cents, 0)) AS BIGINT) || ',"n":' || count(*) || '}' AS state FROM activity GROUP BY 1"""
    ),
)
def _fold_snapshots(spark, folder):
    """Two runs, as of two moments: the second folds only what the first had not seen."""
    events, store = activity_log(spark, folder), run_folder(spark, "fold-snapshots")
    half = events.agg(F.max("global_position")).first()[0] // 2
    snapshots.advance(events.filter(F.col("global_position") <= half), _count_cents, store, every=100, longest=None)
    snapshots.advance(events, _count_cents, store, every=100, longest=None)
    return snapshots.latest_states(spark, store)


@query(
    "stored_state_at",
    order(
        """SELECT aggregate_id, target, '{"n":' || count(*) || ',"qty":' ||
        CAST(sum(coalesce(CAST(json_extract_string(payload, '$.qty') AS BIGINT), 0)) AS BIGINT) || '}' AS state
        FROM order_log JOIN (SELECT 'ORD-' || o_orderkey AS aggregate_id, o_custkey % 9 AS target FROM orders) USING (aggregate_id)
        WHERE sequence_number <= target GROUP BY 1, 2"""
    ),
)
def _stored_state_at(spark, folder):
    events, store = order_log(spark, folder), run_folder(spark, "fold-snapshots")
    snapshots.advance(events, _count_lines, store, every=3, longest=None)
    targets = read_sample(spark, folder, "orders").select(
        F.concat(F.lit("ORD-"), F.col("o_orderkey").cast("string")).alias("aggregate_id"),
        (F.col("o_custkey") % 9).alias("target"),
    )
    return snapshots.stored_state_at(events, targets, _count_lines, store)


def _indexed(spark, events):
    path = run_folder(spark, "id-index")
    id_index.write_id_index(events, path)
    return path


@query(
    "search_indexed",
    order("SELECT DISTINCT aggregate_id FROM order_log WHERE aggregate_id ILIKE '%rd-7%' ORDER BY 1 LIMIT 200"),
)
def _search_indexed(spark, folder):
    return id_index.search_indexed(spark, _indexed(spark, order_log(spark, folder)), "rd-7", 200)


@query(
    "indexed_ids",
    activity("SELECT DISTINCT aggregate_id FROM activity WHERE contains(lower(aggregate_id), '99')"),
)
def _indexed_ids(spark, folder):
    return id_index.indexed_ids(spark, _indexed(spark, activity_log(spark, folder)), "99")


@query(
    "summaries_indexed",
    activity(
        f"""SELECT {EVENT_SQL} FROM activity WHERE (aggregate_id, sequence_number) IN (
        SELECT aggregate_id, min(sequence_number) FROM activity WHERE aggregate_id ILIKE '%u-1%'
        GROUP BY aggregate_id ORDER BY aggregate_id LIMIT 20)"""
    ),
)
def _summaries_indexed(spark, folder):
    events = activity_log(spark, folder)
    return shown(id_index.summaries_indexed(events, _indexed(spark, events), "u-1"))


def _near(estimate: str, exact: str):
    """Whether an estimate is within four standard errors."""
    return F.abs(F.col(estimate) - F.col(exact)) <= F.greatest(
        F.lit(1.0), 4 * rollups.standard_error() * F.col(exact)
    )


@query(
    "rollup_totals",
    activity("SELECT count(*) AS total_events, count(DISTINCT aggregate_id) AS exact_aggregates, true AS within_error FROM activity"),
)
def _rollup_totals(spark, folder):
    """Roll-ups of two halves of the log, merged, beside the exact distinct count."""
    events = activity_log(spark, folder)
    even = F.col("global_position") % 2 == 0
    rollup = rollups.daily_totals(events.filter(even)).unionByName(rollups.daily_totals(events.filter(~even)))
    exact = events.agg(F.count_distinct("aggregate_id").alias("exact_aggregates"))
    # one row beside one row
    both = rollups.totals_between(rollup).withColumn("__one", F.lit(1)).join(exact.withColumn("__one", F.lit(1)), "__one")
    return both.select("total_events", "exact_aggregates", _near("distinct_aggregates", "exact_aggregates").alias("within_error"))


@query(
    "trailing_totals",
    activity(
        """SELECT day, total_events, exact_aggregates, true AS within_error FROM (
        SELECT strftime(d.day, '%Y-%m-%d') AS day, count(*) AS total_events, count(DISTINCT aggregate_id) AS exact_aggregates
        FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM activity) d JOIN activity a
        ON CAST(a.ts AS DATE) BETWEEN d.day - 6 AND d.day GROUP BY 1)"""
    ),
)
def _trailing_totals(spark, folder):
    events = activity_log(spark, folder)
    kept = rollups.trailing_totals(rollups.daily_totals(events), 7)
    # the exact count, which needs every (aggregate, day) seven times, to hold the estimate against
    seen = events.select("aggregate_id", F.to_date("timestamp").alias("__day")).distinct()
    ends = F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda n: F.date_add("__day", n))).alias("day")
    exact = seen.select("aggregate_id", ends).groupBy("day").agg(F.count_distinct("aggregate_id").alias("exact_aggregates"))
    return kept.join(exact, "day").select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "total_events", "exact_aggregates",
        _near("distinct_aggregates", "exact_aggregates").alias("within_error"),
    )
