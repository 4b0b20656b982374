"""What is stored between runs: snapshots of folds, the id index, daily totals."""

import re
import sys
from datetime import date, datetime, timezone

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from helpers import event, events_df
from tidemark.operators import id_index, rollups, snapshots
from tidemark.operators.reducers import replay_fold
from tidemark.operators.stats import store_totals
from tidemark.operators.timeline import search_aggregates, search_summaries

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def path_text(state, row):
    """Depends on order, so a wrong start or a wrong order shows."""
    state["path"] = (state.get("path", "") + row["payload"].get("x", "?"))[-40:]
    state["n"] = state.get("n", 0) + 1
    return state


def log(spark, rows):
    """Rows of (aggregate, sequence, position)."""
    return events_df(
        spark, [event(a, "T", s, "Step", {"x": chr(97 + (s * 7 + p) % 26)}, p) for a, s, p in rows]
    )


def last_by_fold(events):
    by = F.struct("sequence_number", "global_position", "event_id")
    last = replay_fold(events, path_text).groupBy("aggregate_id").agg(F.max_by("state", by).alias("state"))
    return {r.aggregate_id: r.state for r in last.collect()}


def latest(spark, path):
    return {r.aggregate_id: r.state for r in snapshots.latest_states(spark, path).collect()}


FIRST = [("A", s, s) for s in range(1, 31)] + [("B", s, 100 + s) for s in range(1, 8)]
SECOND = [("A", s, 200 + s) for s in range(31, 36)] + [("C", s, 300 + s) for s in range(1, 4)]


def test_second_run_folds_the_tail_only(spark, tmp_path):
    table, store = str(tmp_path / "log"), str(tmp_path / "store")
    log(spark, FIRST).write.parquet(table)
    folded = spark.sparkContext.accumulator(0)

    def counted(state, row):
        folded.add(1)
        return path_text(state, row)

    snapshots.advance(spark.read.parquet(table), counted, store, every=10)
    assert folded.value == len(FIRST)
    log(spark, SECOND).write.mode("append").parquet(table)
    grown = spark.read.parquet(table)
    snapshots.advance(grown, counted, store, every=10)
    assert folded.value == len(FIRST) + len(SECOND)
    assert latest(spark, store) == last_by_fold(grown)
    # nothing new: nothing folded, nothing stored
    before = snapshots.stored_snapshots(spark, store).count()
    snapshots.advance(grown, counted, store, every=10)
    assert folded.value == len(FIRST) + len(SECOND)
    assert snapshots.stored_snapshots(spark, store).count() == before
    kept = {(r.aggregate_id, r.events) for r in snapshots.stored_snapshots(spark, store).collect()}
    assert kept == {("A", 10), ("A", 20), ("A", 30), ("A", 35), ("B", 7), ("C", 3)}


def test_the_mark_reaches_the_scan(spark, tmp_path, capsys):
    table, store = str(tmp_path / "log"), str(tmp_path / "store")
    log(spark, FIRST).write.parquet(table)
    snapshots.advance(spark.read.parquet(table), path_text, store)
    log(spark, SECOND).write.mode("append").parquet(table)
    onward = snapshots.replay_onward(spark.read.parquet(table), path_text, store)
    assert onward.count() == len(SECOND)
    capsys.readouterr()
    onward.explain("formatted")
    assert "GreaterThan(global_position,107)" in capsys.readouterr().out


def test_late_sequence_and_broken_run(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = [("A", s, s) for s in range(1, 31) if s not in (12, 25)] + [("B", 1, 50)]
    snapshots.advance(log(spark, rows), path_text, store, every=5)
    grown = log(spark, rows + [("A", 25, 60), ("A", 12, 61), ("B", 2, 62)])
    snapshots.advance(grown, path_text, store, every=5)
    assert latest(spark, store) == last_by_fold(grown)
    # snapshots written, mark lost: the same events come again, and more
    plan = snapshots._plan(log(spark, rows + [("A", 25, 60), ("A", 12, 61), ("B", 2, 62), ("B", 3, 63)]), store, None)
    folded = snapshots._fold(plan[0], plan[1], ["aggregate_id"], path_text, 5, plan[3]).filter("stop")
    names = plan[2].columns
    folded.select(*names).write.mode("append").parquet(f"{store}/snapshots")
    last = log(spark, rows + [("A", 25, 60), ("A", 12, 61), ("B", 2, 62), ("B", 3, 63), ("B", 4, 64)])
    snapshots.advance(last, path_text, store, every=5)
    assert latest(spark, store) == last_by_fold(last)
    counts = {r.aggregate_id: r.events for r in snapshots.latest_states(spark, store).collect()}
    assert counts == {"A": 30, "B": 4}


def test_state_at_from_the_nearest_snapshot(spark, tmp_path):
    store = str(tmp_path / "store")
    events = log(spark, FIRST)
    snapshots.advance(events, path_text, store, every=10)
    folded = spark.sparkContext.accumulator(0)

    def counted(state, row):
        folded.add(1)
        return path_text(state, row)

    asked = [("A", 0), ("A", 4), ("A", 20), ("A", 27), ("A", 99), ("B", 6), ("none", 3)]
    targets = spark.createDataFrame(asked, "aggregate_id string, target long")
    got = {(r.aggregate_id, r.target): r.state for r in snapshots.stored_state_at(events, targets, counted, store).collect()}
    assert folded.value == 4 + 0 + 7 + 0 + 6
    every = {(r.aggregate_id, r.sequence_number): r.state for r in replay_fold(events, path_text).collect()}
    assert got == {
        ("A", 4): every["A", 4], ("A", 20): every["A", 20], ("A", 27): every["A", 27],
        ("A", 99): every["A", 30], ("B", 6): every["B", 6],
    }


def test_long_tails_are_refused_unless_allowed(spark, tmp_path):
    store = str(tmp_path / "store")
    with pytest.raises(ValueError, match="'A' has 30 events"):
        snapshots.advance(log(spark, FIRST), path_text, store, longest=29)
    snapshots.advance(log(spark, FIRST), path_text, store, longest=None)
    assert len(latest(spark, store)) == 2
    snapshots.advance(log(spark, FIRST).limit(0), path_text, str(tmp_path / "empty"))
    assert latest(spark, str(tmp_path / "empty")) == {}


IDS = ["ACC-001", "acc-0012", "ÄÖ-acc", "x", "", "aaaa", "AaA", "a%b_c", "日本語-1", "order 7", None]


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    path = str(tmp_path / "index")
    events = events_df(spark, [event(a, "T", s, "Step", {}, 10 * i + s) for i, a in enumerate(IDS) for s in (1, 2)])
    id_index.write_id_index(events, path)
    for text in ["acc", "ACC-001", "a", "aa", "aaaaa", "äö", "%b", "本語", "r 7", "nothing"]:
        limit = 2 if text == "a" else None
        expected = [r[0] for r in search_aggregates(events, text, limit).collect()]
        assert [r[0] for r in id_index.search_indexed(spark, path, text, limit).collect()] == expected, text

    def firsts(found):
        return sorted(found.select("aggregate_id", "event_id", "sequence_number").collect())

    expected = firsts(search_summaries(events, "acc"))
    assert firsts(id_index.summaries_indexed(events, path, "acc")) == expected
    assert firsts(id_index.summaries_indexed(events, path, "acc", 5_000)) == expected
    with pytest.raises(ValueError):
        id_index.search_indexed(spark, path, " ")
    # ids added later, one of them again
    more = events_df(spark, [event(a, "T", 3, "Step", {}, 900 + i) for i, a in enumerate(["acc-0012", "acc-new"])])
    id_index.write_id_index(more, path)
    assert [r[0] for r in id_index.search_indexed(spark, path, "acc-").collect()] == ["ACC-001", "acc-0012", "acc-new"]


def test_a_search_reads_one_list(spark, tmp_path, capsys):
    path = str(tmp_path / "index")
    rows = [event(f"common-{i}", "T", 1, "Step", {}, i) for i in range(50)] + [event("common-zq9", "T", 1, "Step", {}, 99)]
    id_index.write_id_index(events_df(spark, rows), path)
    found = id_index.search_indexed(spark, path, "mon-zq")
    assert [r[0] for r in found.collect()] == ["common-zq9"]
    capsys.readouterr()
    found.explain("formatted")
    assert "EqualTo(gram,-zq)" in capsys.readouterr().out


def test_daily_totals_merge(spark):
    day = 24 * 60
    rows = [
        event(f"A{i % 700}", "T", i, "Step", {}, i, minutes=(i % 10) * day) for i in range(5_000)
    ]
    parts = [events_df(spark, rows[:2_000]), events_df(spark, rows[2_000:])]
    events = parts[0].unionByName(parts[1])
    rollup = rollups.daily_totals(parts[0]).unionByName(rollups.daily_totals(parts[1]))
    exact, kept = store_totals(events).first(), rollups.totals_between(rollup).first()
    assert kept.total_events == exact.total_events == 5_000
    assert abs(kept.distinct_aggregates - 700) <= 4 * rollups.standard_error() * 700
    some = rollups.totals_between(rollup, date(2026, 3, 25), date(2026, 3, 26)).first()
    times = (F.col("timestamp") >= datetime(2026, 3, 25, tzinfo=timezone.utc)) & (F.col("timestamp") < datetime(2026, 3, 27, tzinfo=timezone.utc))
    true = store_totals(events.filter(times)).first()
    assert some.total_events == true.total_events
    assert abs(some.distinct_aggregates - true.distinct_aggregates) <= 4 * rollups.standard_error() * true.distinct_aggregates
    trailing = {r.day: r for r in rollups.trailing_totals(rollup, 3).collect()}
    assert len(trailing) == 10
    assert trailing[date(2026, 3, 24)].total_events == 500
    assert trailing[date(2026, 3, 30)].total_events == 1_500
    nothing = rollups.totals_between(rollups.daily_totals(events.limit(0))).first()
    assert tuple(nothing) == (0, 0)


def test_an_empty_store_costs_no_read(spark, tmp_path):
    """What is joined with snapshots that are not there is not computed."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    log = spark.range(50).selectExpr("string(id) AS aggregate_id")
    stored = snapshots.stored_snapshots(spark, f"{tmp_path}/none")
    assert stored.schema.simpleString() == StructType.fromDDL(snapshots.SNAPSHOT_SCHEMA).simpleString()
    assert stored.join(log.mapInArrow(count, log.schema), "aggregate_id").isEmpty()
    assert read.value == 0


def test_postings_are_as_many_as_characters(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [event(a, "T", 1, "Step", {}, i) for i, a in enumerate(["ab", "ABC", "xyzab", "日本語-1", "b"])]
    id_index.write_id_index(events_df(spark, rows), path)
    postings = spark.read.parquet(f"{path}/postings")
    assert sorted(r.gram for r in postings.filter("aggregate_id = 'xyzab'").collect()) == ["ab", "b", "xyz", "yza", "zab"]
    assert postings.count() == 16
    for text, ids in {"b": ["ABC", "ab", "b", "xyzab"], "ab": ["ABC", "ab", "xyzab"], "za": ["xyzab"], "語-": ["日本語-1"], "1": ["日本語-1"], "abcd": []}.items():
        assert [r[0] for r in id_index.search_indexed(spark, path, text).collect()] == ids, text


def test_snapshots_move_once_to_their_targets(spark, tmp_path):
    """Snapshots are joined by aggregate alone, and a target without events gets the state of its snapshot."""
    store = str(tmp_path / "store")
    events = log(spark, [(a, s, 100 * i + s) for i, a in enumerate("ABC") for s in range(1, 41)])
    snapshots.advance(events.filter("global_position <= 120"), path_text, store, every=10)
    snapshots.advance(events, path_text, store, every=10)
    asked = [(a, t) for a in "ABCD" for t in (0, 5, 10, 20, 33, 99, None)]
    targets = spark.createDataFrame(asked, "aggregate_id string, target long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = snapshots.stored_state_at(events, targets, path_text, store)
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {(r.aggregate_id, r.target): r.state for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(generation" not in plan and "generation#" not in "".join(re.findall(r"Exchange hashpartitioning\(.*", plan))
    # nothing is shuffled behind the fold
    assert "Exchange" not in plan.split("MapInPandas")[0]
    every = {(r.aggregate_id, r.sequence_number): r.state for r in replay_fold(events, path_text).collect()}
    assert got == {(a, t): every[a, min(t, 40)] for a in "ABC" for t in (5, 10, 20, 33, 99)}
