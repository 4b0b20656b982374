"""Stated limits are obeyed, exports are whole, windows end where they should, filters reach the scan."""

from datetime import datetime, timedelta

import pytest
from helpers import event, events_df

from pyspark.sql import functions as F
from tidemark.functions.text import instant_text
from tidemark.operators import detect, export, governance, stats, timeline
from tidemark.sources.sample_logs import order_log
from tidemark.sources.schema import SchemaError, load_event_table, map_event_columns, validate_events
from tidemark.streaming import tail


@pytest.fixture(scope="module")
def many(spark):
    rows = [event(f"A{i:04d}", "T", 1, "X", {"n": i}, i) for i in range(1, 1301)]
    rows += [event("B", "T", i, "X", {"n": i}, 1300 + i) for i in range(1, 1301)]
    return events_df(spark, rows).cache()


def test_stated_limits_are_obeyed(many):
    assert timeline.recent_events(many, 2000).count() == 2000
    assert timeline.search_aggregates(many, "a", 1200).count() == 1200
    assert timeline.search_summaries(many, "a", 1200).count() == 1200
    assert timeline.timeline(many, 1250).filter("aggregate_id = 'B'").count() == 1250
    assert timeline.timeline_header(many, 1250).filter("aggregate_id = 'B'").first().page_events == 1250
    assert detect.recent_aggregates(many, 1310, 2000).count() == 11
    audit = many.select("event_id", F.col("timestamp").alias("created_at"))
    assert governance.recent_audit(audit, 1700).count() == 1700


def test_totals_are_longs(many):
    assert dict(timeline.timeline_header(many).dtypes)["total_events"] == "bigint"


def test_bulk_export_is_whole_or_as_long_as_asked(many):
    assert export.bulk_export(many, rules=None).count() == 2600
    assert export.bulk_export(many, 1250, rules=None).count() == 1300 + 1250
    assert export.bulk_export(many, 1, rules=None).count() == 1301


def test_json_document_holds_what_it_announces(many):
    lines = [r.line for r in export.export_json(many.filter("aggregate_id = 'B'"), datetime(2024, 1, 1), 3).orderBy("line_no").collect()]
    assert '"eventCount":3,"limit":3' in lines[0] and len(lines) == 5 and lines[-1] == "]}"
    assert lines[3].endswith("}") and not lines[3].endswith(",")


def test_throughput_ends_at_the_asked_time(spark):
    at = datetime(2024, 1, 20)
    rows = [(at + timedelta(hours=h),) for h in (-60, -47, -3, -2, 0, 1, 30)]
    got = stats.throughput(spark.createDataFrame(rows, "timestamp timestamp"), 2, 24, at).collect()
    assert sum(r.event_count for r in got) == 4
    assert max(r.bucket for r in got).startswith("2024-01-20T00") and min(r.bucket for r in got).startswith("2024-01-18T00")


def test_a_tail_goes_on_where_the_backfill_ends(many):
    found = tail.live_tail(many.filter("global_position <= 200"), many, 50, shared_position=True)
    live = [r.global_position for r in found.stream.orderBy("global_position").collect()]
    # the event at the last position itself was shown
    assert live == list(range(201, 2601))
    assert [r.global_position for r in found.backfill.collect()] == list(range(151, 201))


def test_a_last_line_feed_is_a_bad_shape(spark):
    rows = spark.createDataFrame(
        [("A-1", "MADE", "ORDER"), ("A-1\n", "MADE\n", "ORDER\n")], "aggregate_id string, event_type string, aggregate_type string"
    )
    flags = [tuple(r)[3:] for r in validate_events(rows).collect()]
    assert flags == [(False, False, False), (True, True, True)]


def test_instant_text_does_not_follow_the_session_zone(spark):
    values = spark.sql("SELECT timestamp_micros(x) AS t FROM VALUES (0), (1500000), (-1), (1706745600000001) AS v(x)")
    expected = ["1970-01-01T00:00:00Z", "1970-01-01T00:00:01.500Z", "1969-12-31T23:59:59.999999Z", "2024-02-01T00:00:00.000001Z"]
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [r[0] for r in values.select(instant_text(F.col("t"))).collect()] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_filters_reach_a_mapped_table(spark, many, tmp_path):
    many.write.parquet(str(tmp_path / "log"))
    spark.read.parquet(str(tmp_path / "log")).createOrReplaceTempView("pushed_log")
    known = ("aggregate_id", "sequence_number", "timestamp")
    mapped = load_event_table(spark, "pushed_log", not_null=known)
    one = mapped.filter("aggregate_id = 'B' AND sequence_number > 5 AND timestamp > TIMESTAMP '2000-01-01'")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = next(x for x in plan.split("\n") if "PushedFilters" in x).split("PushedFilters")[1]
    assert all(f"({c}," in pushed for c in known)
    assert one.count() == load_event_table(spark, "pushed_log").filter("aggregate_id = 'B' AND sequence_number > 5").count()
    with pytest.raises(SchemaError):
        load_event_table(spark, "pushed_log", not_null=("nonsense",))


def scanned(df):
    """What the scan is asked for."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    return next(x for x in plan.split("\n") if "PushedFilters" in x).split("PushedFilters")[1]


CONDITIONS = [
    ("aggregate_id", "=", "B"), ("aggregate_id", "=", ""), ("aggregate_id", "in", ["B", ""]), ("aggregate_id", "<", "A"),
    ("aggregate_id", "startswith", "A0"), ("aggregate_type", "=", "unknown"), ("sequence_number", ">", 1200),
    ("sequence_number", "<=", 0), ("timestamp", "<", datetime(2000, 1, 1)), ("timestamp", ">=", datetime(2026, 3, 24, 12)),
    ("global_position", "in", [0, 5]), ("event_type", "=", "X"),
]


@pytest.mark.parametrize("condition", CONDITIONS, ids=str)
def test_conditions_reach_a_table_that_may_hold_nulls(spark, many, tmp_path_factory, condition):
    path = str(tmp_path_factory.getbasetemp() / "with-nulls")
    nothing = spark.range(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in many.dtypes])
    many.union(nothing).write.mode("ignore").parquet(path)
    table = spark.read.parquet(path)
    column, comparison, value = condition
    got = map_event_columns(table, where=[condition])
    assert f"({column}" in scanned(got) or f"Null({column})" in scanned(got)
    mapped = map_event_columns(table)
    test = {"=": lambda c: c == value, "<": lambda c: c < value, "<=": lambda c: c <= value, ">": lambda c: c > value, ">=": lambda c: c >= value,
            "in": lambda c: c.isin(value), "startswith": lambda c: c.startswith(value)}[comparison]
    expected = mapped.filter(test(F.col(column)))
    assert got.count() == expected.count() and got.exceptAll(expected).count() == 0


def test_conditions_on_other_kinds_of_columns(spark):
    rows = spark.createDataFrame([(1, 7, "x", "12", "{}"), (2, None, "y", "zz", "{}"), (3, 8, "z", "3", "{}")], "event_id long, aggregate_id int, event_type string, sequence_number string, payload string")
    ids = lambda *where: sorted(r.event_id for r in map_event_columns(rows, where=where).collect())
    assert ids(("aggregate_id", "=", "7")) == ["1"] and ids(("aggregate_id", "in", ["8", "07", ""])) == ["2", "3"]
    assert ids(("aggregate_id", "=", "x")) == [] and ids(("sequence_number", ">=", 3)) == ["1", "3"]
    assert ids(("sequence_number", "=", 0), ("event_type", ">", "x")) == ["2"]
    with pytest.raises(SchemaError):
        map_event_columns(rows, where=[("aggregate_id", "like", "7")])


def test_json_documents_come_of_one_pass(spark, many):
    """One read besides the look at the ids; the lines are those of a log that is cut."""
    rows = [event("B", "T", i, "X", {"n": i}, 1300 + i) for i in range(1, 40)]
    rows += [event(f"A{i}", "T", 1, "X", None, i) for i in range(3)] + [rows[4]]
    rows += [event(None, "T", i, "X", {"n": i}, 2000 + i, f"n{i}") for i in range(3)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    plain = events_df(spark, rows)
    log = plain.mapInArrow(count, plain.schema)
    for limit in (None, -1, 2, 100):
        read.value = 0
        got = sorted(map(repr, export.export_json(log, datetime(2024, 1, 1), limit).collect()))
        assert read.value <= 2 * len(rows)
        cut = export.export_json(plain, datetime(2024, 1, 1), limit, width=4)
        assert got == sorted(map(repr, cut.collect()))


def test_order_lines_are_dealt_before_they_are_summed(spark, tmp_path):
    """The sums of a scan's task would hold as many groups as its split has lines."""
    lines = [(1, 1, 2.0, 1.5, 7), (1, 1, 3.0, 1.0, 9), (1, 2, 1.0, 4.0, 8), (5, 1, 1.0, 1.0, 1), (None, 1, 1.0, 1.0, 1)]
    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_partkey long"
    spark.createDataFrame(lines, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 3, "F", 10.0, datetime(1996, 1, 2), "1-URGENT"), (2, 3, "O", 10.0, datetime(1996, 1, 2), "5-LOW")]
    columns = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, columns).write.parquet(f"{tmp_path}/orders.parquet")
    log = order_log(spark, str(tmp_path))
    got = sorted((r.aggregate_id, r.sequence_number, r.payload) for r in log.collect())
    assert [(a, n) for a, n, _ in got] == [("ORD-1", 1), ("ORD-1", 2), ("ORD-1", 3), ("ORD-1", 20), ("ORD-2", 1)]
    assert got[1][2] == '{"part":9,"qty":5,"line_cents":250}'
    plan = log._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [line for line in plan.splitlines() if "hashpartitioning(l_orderkey" in line and "l_linenumber" in line]
    assert dealt and all("REPARTITION_BY_COL" in line for line in dealt)
