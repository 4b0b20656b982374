import json
import random
from datetime import timedelta
from types import SimpleNamespace

import pytest
from helpers import T0, event, events_df
from pyspark.sql import functions as F
from test_replay import random_log
from tidemark.operators import detect, replay
from tidemark.session import run_folder, shared_folder
from tidemark.sources import schema, stream_records
from tidemark.sources.schema import EVENT_SCHEMA
from tidemark.streaming import carry, tail


def as_stream(spark, folder, batches):
    """A file stream that delivers each list of rows as one micro-batch."""
    for rows in batches:
        events_df(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def shuffled_log(seed, n=250):
    """A log whose events arrive up to a few places out of order, and the closed part of it."""
    rng = random.Random(seed)
    rows = []
    for i, row in enumerate(random_log(seed, n)):
        rows.append((*row[:7], T0 + timedelta(minutes=i), row[8]))
    arrival = sorted(range(n), key=lambda i: i + rng.randrange(6))
    # the last event closes all others
    return rows, [rows[i] for i in arrival] + [event("END", "T", 1, "X", {}, 9999, minutes=n + 60)]


def key(r):
    return (r.aggregate_id, r.sequence_number, r.key, r.old_json, r.new_json)


def test_stream_replay_equals_batch(spark, tmp_path):
    rows, arrival = shuffled_log(21)
    stream = as_stream(spark, tmp_path / "in", [arrival[i : i + 60] for i in range(0, len(arrival), 60)])
    got = tail.run_to_folder(carry.stream_replay(stream, "30 minutes"), str(tmp_path / "out")).collect()
    assert not any(r.late for r in got)
    expected = {key(r) for r in replay.transitions(events_df(spark, rows)).collect()}
    assert {key(r) for r in got} == expected and len(got) == len(expected)


def test_resent_events_change_nothing(spark, tmp_path):
    rows, arrival = shuffled_log(22, 80)
    twice = arrival[:-1] + arrival[:-1] + arrival[-1:]
    stream = as_stream(spark, tmp_path / "in", [twice])
    got = tail.run_to_folder(carry.stream_replay(stream, "10 hours"), str(tmp_path / "out")).collect()
    batch = {key(r) for r in replay.transitions(events_df(spark, rows)).collect()}
    assert {key(r) for r in got if not r.late} <= batch


def run(stream, tmp_path, name):
    """Rows of a streaming query and its progress reports."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / name / "rows"))
        .option("checkpointLocation", str(tmp_path / name / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name / "rows")).collect()
    return rows, query.recentProgress


def test_released_rows_leave_the_state(spark, tmp_path):
    """One key, a write a minute in ten micro-batches: what waits is a few rows, not the history."""
    rows = [event("A", "T", i, "X", {"n": i}, i, minutes=i) for i in range(1, 201)]
    stream = as_stream(spark, tmp_path / "in", [rows[i : i + 20] for i in range(0, 200, 20)] + [[event("Z", "T", 1, "X", {}, 999, minutes=9999)]])
    got, progress = run(carry.stream_replay(stream, "5 minutes"), tmp_path, "out")
    assert sorted(r.new_json for r in got if r.key == "n") == sorted(map(str, range(1, 201)))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    # four fields, each with its rows of some 5 minutes and of the batch at hand, its timer and its last value
    assert max(held) < 4 * 60 and held[-1] < 40


def test_waiting_events_lie_in_pages(spark, tmp_path):
    """Entries of the state are pages of events, not writes; what a page has left goes out as the watermark moves."""
    rows = [event("A", "T", i, "X", {"n": i // 2, "m": 1}, i, minutes=i) for i in range(1, 1201)]
    batches = [rows[:900], rows[900:], [event("Z", "T", 1, "X", {}, 9998, minutes=1300)], [event("Z", "T", 2, "X", {}, 9999, minutes=99999)]]
    stream = as_stream(spark, tmp_path / "in", batches)
    got, progress = run(carry.stream_replay(stream, "300 minutes"), tmp_path, "out")
    expected = {key(r) for r in replay.transitions(events_df(spark, rows + batches[2])).collect()}
    assert {key(r) for r in got} == expected and len(got) == len(expected) and not any(r.late for r in got)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) < 20


def test_lanes_of_an_aggregate_are_late_apart(spark, tmp_path):
    """More fields than are kept together; a copy of an event is late in the fields it shares with it."""
    wide = {f"f{i}": i for i in range(150)}
    rows = [event("A", "T", i, "X", {**wide, f"f{i}": -i}, i, minutes=i) for i in range(1, 9)]
    more = event("A", "T", 3, "X", {"f3": 7, "other": 1}, 3, minutes=3)
    narrow = event("A", "T", 10, "X", {"f1": 5, "f149": 6}, 10, minutes=500)
    batches = [rows[:5] + [more], rows[5:], [narrow], [event("Z", "T", 1, "X", {}, 999, minutes=9999)]]
    stream = as_stream(spark, tmp_path / "in", batches)
    got, _ = run(carry.stream_replay(stream, "30 minutes"), tmp_path, "out")
    told = {(r.sequence_number, r.key): (r.old_json, r.new_json) for r in got if not r.late}
    expected = {(r.sequence_number, r.key): (r.old_json, r.new_json) for r in replay.transitions(events_df(spark, [*rows, narrow])).collect()}
    assert told == expected | {(3, "other"): (None, "1")}
    shared = {"f3", "_version", "_lastEventType", "_lastUpdated"}
    assert sorted(r.key for r in got if r.late) == sorted(shared)


def test_late_rows_come_out_apart(spark, tmp_path):
    """Every event is in one of the two outputs, whatever the order of arrival."""
    rows = [event("A", "T", i, "X", {"a": i}, i, minutes=10 * i) for i in range(1, 31)]
    # 5 and 9 arrive when later ones are released; B's event comes behind the watermark, but nothing after it was released
    batches = [[r for i, r in enumerate(rows[:15], 1) if i not in (5, 9)], rows[15:25], [rows[4], rows[8]], rows[25:]]
    batches += [[event("B", "T", 1, "X", {"a": 7}, 500, minutes=20)], [event("END", "T", 1, "X", {}, 999, minutes=9999)]]
    rules, _ = detect.load_rules([{"code": "BIG", "condition": "a >= 3"}])
    stream = as_stream(spark, tmp_path / "in", batches)
    carry.write_apart(carry.stream_anomalies(stream, rules, "30 minutes"), str(tmp_path / "out")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    late = spark.read.parquet(str(tmp_path / "out/late")).collect()
    assert sorted((r.aggregate_id, r.sequence_number, r.fields) for r in late) == [("A", 5, "a"), ("A", 9, "a")]
    assert all(r.code is None and r.late for r in late)
    assert sorted((r.aggregate_id, r.sequence_number) for r in found if r.code == "BIG") == sorted(
        [("A", i) for i in range(3, 31) if i not in (5, 9)] + [("B", 1)]
    )
    history = carry.stream_field_history(stream, [["a"], ["a", "b"]], "30 minutes").filter("aggregate_id != 'END'")
    steps, _ = run(history, tmp_path, "steps")
    assert sorted((r.aggregate_id, r.sequence_number, r.unit) for r in steps) == sorted(
        [("A", i, u) for i in range(1, 31) for u in (0, 1)] + [("B", 1, 0), ("B", 1, 1)]
    )


def test_rows_without_time_are_given_out(spark, tmp_path):
    rows = [event("A", "T", 1, "X", {"a": 1}, 1), (*event("A", "T", 2, "X", {"a": 2}, 2)[:7], None, 2)]
    stream = as_stream(spark, tmp_path / "in", [[rows[0]], [rows[1]], [event("END", "T", 1, "X", {}, 9, minutes=9999)]])
    got, _ = run(carry.stream_replay(stream, "1 minute"), tmp_path, "out")
    assert sorted((r.sequence_number, r.late) for r in got if r.key == "a") == [(1, True), (2, False)]


def test_rules_on_several_fields_equal_batch(spark, tmp_path):
    rows, arrival = shuffled_log(24, 120)
    rules = [
        detect.Rule("PAIR", "both are set", "HIGH", ("status", "a"), lambda v: v("status").isNotNull() & v("a").isNotNull()),
        detect.condition_rule("A2", "a >= 2"),
    ]
    stream = as_stream(spark, tmp_path / "in", [arrival[i : i + 40] for i in range(0, len(arrival), 40)])
    carry.write_apart(carry.stream_anomalies(stream, rules, "30 minutes"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/rows")).collect()
    expected = detect.scan_anomalies(events_df(spark, rows), rules).collect()
    pick = lambda r: (r.aggregate_id, r.sequence_number, r.code)
    assert sorted(map(pick, got)) == sorted(map(pick, expected))
    assert "PAIR" in {r.code for r in got}


def test_an_event_waits_once_for_all_rules(spark, tmp_path):
    """Units of fields share the events that wait, and each gives its own row of every event."""
    rows = [event("A", "T", i, "X", {"a": i} if i % 2 else {"b": i}, i, minutes=i) for i in range(1, 601)]
    stream = as_stream(spark, tmp_path / "in", [rows + rows[:1], [event("Z", "T", 1, "X", {}, 9999, minutes=99999)]])
    history = carry.stream_field_history(stream, [["a"], ["b"], ["a", "b"]], "1000 minutes").filter("aggregate_id = 'A'")
    got, progress = run(history, tmp_path, "out")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) < 10
    seen = {(r.sequence_number, r.unit): (r.f_a, r.f_b) for r in got if not r.late}
    a = {i: str(i if i % 2 else i - 1) for i in range(1, 601)}
    b = {i: None if i == 1 else str(i - i % 2) for i in range(1, 601)}
    assert seen == {(i, u): (a[i] if u != 1 else None, b[i] if u != 0 else None) for i in range(1, 601) for u in range(3)}
    assert len(got) == 1803 and sorted((r.sequence_number, r.unit, r.f_a) for r in got if r.late) == [(1, u, None) for u in range(3)]


def test_resent_stream_equals_batch_and_feeds_replay(spark, tmp_path):
    rows, arrival = shuffled_log(25, 120)
    resent = [(*r[:8], r[8] + 10_000) for r in arrival[:-1:3]]  # the same events at later places of the topic
    both = arrival[:60] + resent[:10] + arrival[60:-1] + resent[10:] + [event("END", "T", 1, "X", {}, 99_999, minutes=9999)]
    stream = as_stream(spark, tmp_path / "in", [both[i : i + 50] for i in range(0, len(both), 50)])
    once, progress = run(tail.drop_resent_stream(stream, "5 hours"), tmp_path, "once")
    wanted = schema.drop_resent(events_df(spark, both)).collect()
    assert sorted((r.aggregate_id, r.sequence_number, r.global_position) for r in once) == sorted(
        (r.aggregate_id, r.sequence_number, r.global_position) for r in wanted
    )
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < 10  # old keys are forgotten
    stepped, _ = run(carry.stream_replay(tail.drop_resent_stream(stream, "5 hours"), None), tmp_path, "replay")
    expected = {key(r) for r in replay.transitions(events_df(spark, rows)).collect()}
    assert not any(r.late for r in stepped) and len(stepped) == len(expected) and {key(r) for r in stepped} == expected


def test_keep_latest_over_batches(spark, tmp_path):
    rows = [event("A", "T", i, "X", {}, i) for i in range(1, 261)]
    stream = as_stream(spark, tmp_path / "in", [rows[:100], rows[100:180], rows[180:]])
    tagged = stream.select(F.lit("src").alias("source_id"), "event_id", "global_position")
    checkpoint = str(tmp_path / "check")
    query = tail.keep_latest(tagged, checkpoint, 200, available_now=True)
    query.awaitTermination()
    latest = tail.in_batches(tail.read_latest(spark, checkpoint, 200)).orderBy("global_position").collect()
    assert [r.global_position for r in latest] == list(range(61, 261))
    assert [r.batch_no for r in latest] == [i // 50 for i in range(200)]


def test_keep_latest_is_bounded_and_starts_anew(spark, tmp_path):
    rows = [event("A", "T", i, "X", {}, i) for i in range(1, 401)]
    events_df(spark, rows[:250]).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "in"))
    tagged = stream.select((F.col("global_position") % 2).cast("string").alias("source_id"), "event_id", "global_position")
    seen = lambda c: sorted(r.global_position for r in tail.read_latest(spark, c, 5).collect())
    first = str(tmp_path / "first")
    tail.keep_latest(tagged, first, 5, available_now=True).awaitTermination()
    assert seen(first) == list(range(241, 251))
    # the same checkpoint goes on, and no more than its parts hold is kept
    events_df(spark, rows[250:]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    query = tail.keep_latest(tagged, first, 5, available_now=True)
    query.awaitTermination()
    assert seen(first) == list(range(391, 401))
    kept = spark.read.format("statestore").option("stateVarName", tail.KEPT).load(first)
    assert kept.count() <= 2 * tail.PARTS * 5
    # a fresh checkpoint knows nothing of what was kept before
    events_df(spark, rows[:20]).coalesce(1).write.parquet(str(tmp_path / "other"))
    other = spark.readStream.schema(EVENT_SCHEMA).parquet(str(tmp_path / "other"))
    tagged = other.select(F.lit("src").alias("source_id"), "event_id", "global_position")
    tail.keep_latest(tagged, str(tmp_path / "second"), 5, available_now=True).awaitTermination()
    assert seen(str(tmp_path / "second")) == list(range(16, 21))


def test_newest_changes_tell_what_came_in(spark, tmp_path):
    rows = [event("A", "T", i, "X", {}, i) for i in range(1, 41)]
    stream = as_stream(spark, tmp_path / "in", [rows[20:], rows[:20]])
    tagged = stream.select(F.lit("src").alias("source_id"), "event_id", "global_position")
    seen = []
    query = (
        tail.newest_changes(tagged, 40)
        .writeStream.outputMode("update")
        .foreachBatch(lambda batch, n: seen.append(sorted(r.global_position for r in batch.collect())))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    assert [s for s in seen if s] == [list(range(21, 41)), list(range(1, 21))]


def test_state_needs_its_store(spark, tmp_path):
    stream = as_stream(spark, tmp_path / "in", [[event("A", "T", 1, "X", {}, 1)]])
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        with pytest.raises(ValueError, match="providerClass"):
            carry.stream_replay(stream)
    finally:
        spark.conf.set(name, before)


def test_live_tail_without_stream(spark):
    rows = [event("A", "T", i, "X", {}, i) for i in range(1, 130)]
    found = tail.live_tail(events_df(spark, rows))
    assert found.marker == "NO_LIVE_STREAM" and found.stream is None
    assert [r.global_position for r in found.backfill.collect()] == list(range(30, 130))


def kafka_records(spark, folder, rows):
    """A stream of Kafka records from (partition, offset, value)."""
    kinds = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"
    whole = [(b"A", json.dumps(v).encode(), "t", p, o, T0) for p, o, v in rows]
    spark.createDataFrame(whole, kinds).write.parquet(str(folder))
    return stream_records.parse_stream_records(spark.readStream.schema(kinds).parquet(str(folder)))


@pytest.mark.parametrize("first_position", [0, 10**9])
def test_live_tail_of_two_partitions(spark, tmp_path, first_position):
    """Offsets and the store's positions are different scales; only what the backfill shows is left out."""
    scale = 0 if first_position == 0 else 1  # a store without positions has 0 throughout
    rows = [event("A", "T", i, "X", {}, first_position + scale * i, event_id=f"e{i}") for i in range(1, 21)]
    rows.append(event("", "T", 0, "X", {}, first_position + scale * 21, event_id=""))

    def record(i):
        return {"eventId": f"e{i}", "aggregateId": "A", "sequenceNumber": i}

    records = [(i % 2, (10**6 if i % 2 else 3) + i, record(i)) for i in range(15, 31)]  # e15 to e20 are in the store
    records += [(0, 40, {"type": "Y"}), (1, 10**6 + 40, {"eventId": "", "aggregateId": "B"})]
    found = tail.live_tail(events_df(spark, rows), kafka_records(spark, tmp_path / "in", records))
    got = sorted(r.event_id for r in tail.run_to_folder(found.stream, str(tmp_path / "out")).collect())
    assert got == sorted(["", "t-0-40", *(f"e{i}" for i in range(21, 31))])
    assert len(found.backfill.collect()) == 21


def test_live_tail_keeps_the_backfill_as_shown(spark, tmp_path):
    """Events that reach store and stream after the backfill was taken are live, whatever the limit."""
    store = str(tmp_path / "store")
    rows = [event("A", "T", i, "X", {}, i) for i in range(1, 31)]
    events_df(spark, rows[:20]).write.parquet(store)
    stream = as_stream(spark, tmp_path / "in", [rows[:15], rows[15:]])
    log = spark.read.schema(EVENT_SCHEMA).parquet(store)
    loose, shared = (tail.live_tail(log, stream, 10, shared_position=known) for known in (False, True))
    events_df(spark, rows[20:]).write.mode("append").parquet(store)
    for found, live in ((loose, [*range(1, 11), *range(21, 31)]), (shared, list(range(21, 31)))):
        got = tail.run_to_folder(found.stream, str(tmp_path / f"out{len(live)}")).collect()
        assert sorted(r.global_position for r in got) == live
        assert [r.global_position for r in found.backfill.collect()] == list(range(11, 21))


def fake_session(folder, master):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder_comes_from_the_session():
    session = fake_session("hdfs://shared/work/", "yarn")
    assert shared_folder(session) == "hdfs://shared/work"
    assert run_folder(session, "x").startswith("hdfs://shared/work/x-")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(fake_session(None, "yarn"))
