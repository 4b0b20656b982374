from datetime import datetime, timezone

import pytest
from helpers import T0, canonical_events, event, events_df
from pyspark.sql import functions as F
from tidemark.functions.text import decode_cursor, encode_cursor, instant_text
from tidemark.sources import jdbc, layout, registry, schema
from tidemark.sources.stream_records import parse_stream_records, split_malformed


def test_candidates_are_tried_in_order():
    found = schema.resolve_columns(["ID", "stream_id", "version", "seq", "type", "data"])
    assert found["event_id"] == "ID" and found["sequence_number"] == "version"
    assert found["aggregate_type"] is None and found["timestamp"] is None


def test_missing_required_column_names_what_was_tried():
    with pytest.raises(schema.SchemaError, match="stream_key"):
        schema.resolve_columns(["id", "seq", "type", "data"])


def test_overrides_are_checked():
    columns = ["event_id", "aggregate_id", "sequence_number", "event_type", "payload"]
    with pytest.raises(schema.SchemaError, match="unsafe"):
        schema.resolve_columns(columns, {"payload": "x; drop"})
    with pytest.raises(schema.SchemaError, match="no column"):
        schema.resolve_columns(columns, {"payload": "other"})


def test_defaults(spark):
    rows = spark.createDataFrame(
        [("7", "A", 1, "X", "{}"), (None, None, 2, "Y", None)],
        "id string, entity_id string, seq int, type string, body string",
    )
    got = schema.map_event_columns(rows).orderBy("sequence_number").collect()
    assert got[0].global_position == 7 and got[0].aggregate_type == "unknown" and got[0].metadata == "{}"
    assert got[0].timestamp.replace(tzinfo=timezone.utc).timestamp() == 0 or got[0].timestamp.year == 1970
    assert got[1].event_id == "" and got[1].aggregate_id == "" and got[1].global_position == 0


def test_load_event_table(spark):
    with pytest.raises(schema.SchemaError):
        schema.load_event_table(spark, "no_such_table")
    with pytest.raises(schema.SchemaError, match="searched"):
        schema.load_event_table(spark)
    canonical_events(spark).createOrReplaceTempView("domain_events")
    assert schema.load_event_table(spark).count() == 5
    spark.catalog.dropTempView("domain_events")


def test_timestamps(spark):
    values = ["2026-03-21T10:00:00Z", "1711274400", "1711274400000", " 1711274400.5 ", "2024-05-01", "nonsense", "", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(instant_text(schema.normalize_timestamps(F.col("v")))).collect()]
    assert got == [
        "2026-03-21T10:00:00Z", "2024-03-24T10:00:00Z", "2024-03-24T10:00:00Z", "2024-03-24T10:00:00.500Z",
        "2024-05-01T00:00:00Z", None, None, None,
    ]


def test_validate_and_split(spark):
    df = events_df(
        spark,
        [event("A-1", "ORDER", 1, "ORDER_PLACED", {}), event("bad id", "Order", 1, "x", {}), event("B", "ORDER", 1, None, {})],
    )
    good, bad = schema.split_valid(df)
    assert [r.aggregate_id for r in good.collect()] == ["A-1"]
    assert {r.aggregate_id: (r.bad_aggregate_id, r.bad_event_type) for r in bad.collect()} == {
        "bad id": (True, True), "B": (False, True),
    }


def test_resent_events(spark):
    rows = [event("A", "T", 1, "X", {"v": i}, position=i, event_id=f"e{i}") for i in range(1, 20)]
    df = events_df(spark, rows + [event("A", "T", 2, "X", {}, 30)])
    assert [(r.aggregate_id, r.copies) for r in schema.check_sequence_keys(df).collect()] == [("A", 19)]
    assert sorted(r.event_id for r in schema.drop_resent(df).collect()) == ["A-30", "e1"]


def test_cursor_round_trip(spark):
    df = spark.createDataFrame([(42, datetime(2026, 1, 2, 3, 4, 5))], "s long, t timestamp")
    row = df.select(encode_cursor(F.col("s"), F.col("t")).alias("c")).withColumn("d", decode_cursor(F.col("c"))).first()
    assert "=" not in row.c and row.d.sequence == 42
    blank = spark.createDataFrame([("",), (None,)], "c string").select(decode_cursor(F.col("c"))["sequence"]).collect()
    assert [r[0] for r in blank] == [0, 0]
    with pytest.raises(Exception, match="Invalid cursor"):
        spark.createDataFrame([("!!!",)], "c string").select(decode_cursor(F.col("c"))).collect()


def records(spark, values):
    rows = [("key-1", v, "t", 0, i, T0) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "key string, value string, topic string, partition int, offset long, timestamp timestamp"
    )


def test_stream_records(spark):
    full = (
        '{"eventId":"evt-1","aggregateId":"ACC-001","aggregateType":"BankAccount","sequenceNumber":1,'
        '"eventType":"AccountCreated","payload":{"balance":0},"metadata":{"source":"contract"},"timestamp":"2026-03-21T10:00:00Z"}'
    )
    values = [
        full,
        '{"event_id":"e2","aggregate_id":"A","sequence_number":"7","payload":"{\\"x\\":1}","timestamp":1711274400}',
        '{"eventId":"e3","aggregateId":"A","sequenceNumber":"seven"}',
        '{"type":"Ping","n":1}',
        '{"eventType":"Pong"}',
        "{}",
        "oops",
        "[1]",
        None,
    ]
    good, bad = split_malformed(parse_stream_records(records(spark, values)))
    rows = good.orderBy("global_position").collect()
    assert rows[0].event_id == "evt-1" and rows[0].payload == '{"balance":0}' and rows[0].sequence_number == 1
    assert rows[1].sequence_number == 7 and rows[1].payload == '{"x":1}' and rows[1].event_type == "UnknownEvent"
    assert rows[2].sequence_number == 0 and rows[2].payload == "{}" and rows[2].aggregate_type == "unknown"
    assert (rows[3].event_type, rows[3].aggregate_id, rows[3].sequence_number) == ("Ping", "key-1", 3)
    assert rows[3].payload == values[3] and rows[3].event_id == "t-0-3"
    assert rows[4].event_type == "Pong" and rows[5].event_type == "UnknownEvent"
    assert sorted(r.offset for r in bad.collect()) == [6, 7, 8]
    strict, _ = split_malformed(parse_stream_records(records(spark, values[:2]), strict=True))
    assert strict.orderBy("global_position").collect()[1].event_id == "t-0-1"


def test_sources(spark):
    sources = {"b": canonical_events(spark), "a": canonical_events(spark).limit(2)}
    assert registry.union_sources(sources).groupBy("source_id").count().count() == 2
    assert registry.list_sources(sources) == ["a", "b"]
    assert registry.select_source(sources, " ", default="b").count() == 5
    with pytest.raises(KeyError):
        registry.select_source(sources, "c")


def test_routes(spark):
    sources = spark.createDataFrame(
        [("main", True), ("own", False), ("bound", False), ("none", False), ("lost", False)], "source_id string, is_default boolean"
    )
    bindings = spark.createDataFrame([("bound", "s2"), ("none", " "), ("lost", "gone")], "source_id string, stream_id string")
    streams = spark.createDataFrame(
        [("s1", False, 1), ("s2", True, 2), ("own", True, 3)], "stream_id string, ready boolean, position int"
    )
    got = {r.source_id: r.stream_id for r in registry.route_streams(sources, bindings, streams).collect()}
    assert got == {"main": "s2", "own": "own", "bound": "s2", "none": None, "lost": None}


def test_jdbc_bounds_take_plain_names_only(spark):
    with pytest.raises(ValueError, match="unsafe"):
        jdbc.jdbc_bounds(spark, "jdbc:x", "events", "id; drop")


def test_event_table_layout(spark, tmp_path):
    path = str(tmp_path / "events")
    layout.write_event_table(canonical_events(spark), path)
    one = layout.read_event_table(spark, path).filter("aggregate_id = 'ACC-001'")
    assert [r.sequence_number for r in one.orderBy("sequence_number").collect()] == [1, 2, 3]
    assert "EqualTo(aggregate_id,ACC-001)" in one._jdf.queryExecution().executedPlan().toString()
