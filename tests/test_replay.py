import json
import random
import re
from datetime import timedelta

from pyspark.sql import functions as F

from helpers import T0, canonical_events, event, events_df, fold
from tidemark.operators import replay
from tidemark.plans.running import event_chunks


def random_log(seed, n=400):
    rng = random.Random(seed)
    kinds = ["ItemCreated", "ItemUpdated", "ItemClosed", "OrderPlacedThenCancelled", "ItemRejected"]
    rows, sequences = [], {}
    for i in range(n):
        # one aggregate holds most rows
        aggregate = "HOT" if rng.random() < 0.6 else f"A-{rng.randrange(8)}"
        sequences[aggregate] = sequences.get(aggregate, 0) + rng.choice([1, 1, 2])
        payload = rng.choice(
            [
                {rng.choice("abc"): rng.randrange(3)},
                {"a": None},
                {"status": "ok", "b": {"x": [1, 2]}},
                {"_version": 7},
                {"t": "5", "f": True},
                "not json",
                "[1, 2]",
                "",
                None,
            ]
        )
        rows.append(event(aggregate, "T", sequences[aggregate], rng.choice(kinds), payload, i + 1))
    return rows


def by_aggregate(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    return groups


def test_transitions_match_a_plain_fold(spark):
    rows = random_log(1)
    expected = {}
    for group in by_aggregate(rows).values():
        for row, before, after in fold(group):
            for key in after:
                if before.get(key) != after[key]:
                    expected[(row[1], row[3], key)] = (before.get(key), after[key])
    for width in (3, 65_536):
        got = {}
        for r in replay.transitions(events_df(spark, rows), width).collect():
            old = None if r.old_json is None else json.loads(r.old_json)
            got[(r.aggregate_id, r.sequence_number, r.key)] = (old, json.loads(r.new_json))
        assert got == expected


def test_states_before_and_after(spark):
    rows = random_log(2, 150)
    got = {
        (r.aggregate_id, r.sequence_number): (json.loads(r.state_before), json.loads(r.state_after))
        for r in replay.transition_states(events_df(spark, rows), width=4).collect()
    }
    expected = {
        (row[1], row[3]): (before, after)
        for group in by_aggregate(rows).values()
        for row, before, after in fold(group)
    }
    assert got == expected


def test_current_state_and_state_at(spark):
    rows = random_log(3, 200)
    df = events_df(spark, rows)
    groups = by_aggregate(rows)
    final = {r.aggregate_id: json.loads(r.state) for r in replay.state_map(replay.current_state(df)).collect()}
    assert final == {a: fold(g)[-1][2] for a, g in groups.items()}

    targets = spark.createDataFrame([(a, 5) for a in groups] + [("HOT", 40)], "aggregate_id string, target long")
    states = replay.state_map(replay.state_at(df, targets), ["aggregate_id", "at_sequence"]).collect()
    got = {(r.aggregate_id, r.at_sequence): json.loads(r.state) for r in states}
    for (aggregate, target), state in got.items():
        assert state == [s for row, _, s in fold(groups[aggregate]) if row[3] <= target][-1]
    assert len(got) == len({t for t in [(a, 5) for a in groups] + [("HOT", 40)]})


def test_many_targets_of_one_aggregate_are_one_sweep(spark, monkeypatch):
    """Every sequence and many times of a hot aggregate, in blocks smaller than their number."""
    monkeypatch.setattr(replay, "BLOCK_TARGETS", 7)
    rows = [(*r[:7], r[7] if i % 5 else r[7] - timedelta(minutes=30), r[8]) for i, r in enumerate(random_log(7, 220))]
    df = events_df(spark, rows)
    groups = by_aggregate(rows)
    asked = [("HOT", t) for t in range(-1, 200)] + [("A-1", 3), ("A-1", 3), ("none", 4), ("HOT", None), (None, 1)]
    targets = spark.createDataFrame(asked, "aggregate_id string, target long")
    states = replay.state_at(df, targets)
    got = {
        (r.aggregate_id, r.at_sequence): json.loads(r.state)
        for r in replay.state_map(states, ["aggregate_id", "at_sequence"]).collect()
    }
    expected = {}
    for aggregate, target in {a for a in asked if None not in a}:
        reached = [s for row, _, s in fold(groups.get(aggregate, [])) if row[3] <= target]
        if reached:
            expected[(aggregate, target)] = reached[-1]
    assert got == expected

    # times out of step with the sequences: the last sequence among the events until then counts
    times = sorted({r[7] for r in groups["HOT"]})[::3]
    asked = spark.createDataFrame([("HOT", t) for t in times], "aggregate_id string, as_of timestamp")
    got = {
        r.at: json.loads(r.state)
        for r in replay.state_map(
            replay.state_as_of(df, asked).withColumn("at", F.unix_micros("as_of")), ["aggregate_id", "at"]
        ).collect()
    }
    expected = {
        int(t.timestamp()) * 1_000_000: fold([r for r in groups["HOT"] if r[7] <= t])[-1][2] for t in times
    }
    assert got == expected


def test_a_sweep_reads_and_returns_each_event_once(spark):
    """A hundred targets on one aggregate do not multiply its events."""
    rows = [event("HOT", "T", i, "Set", {"v": i, f"f{i % 3}": 1}, i) for i in range(1, 601)]
    df = events_df(spark, rows)
    parsed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            parsed.add(batch.num_rows)
            yield batch

    targets = spark.createDataFrame([("HOT", 6 * i) for i in range(1, 101)], "aggregate_id string, target long")
    original = replay.packed_writes
    replay.packed_writes = lambda events, keep=(): original(events.mapInArrow(count, events.schema), keep)
    try:
        states = replay.state_at(df, targets).filter("key = 'v'").collect()
    finally:
        replay.packed_writes = original
    assert sorted((r.at_sequence, int(r.value_json), r.set_at) for r in states) == [(6 * i, 6 * i, 6 * i) for i in range(1, 101)]
    assert parsed.value == 600


def test_canonical_set(spark):
    df = canonical_events(spark)
    state = {r.aggregate_id: json.loads(r.state) for r in replay.state_map(replay.current_state(df)).collect()}
    assert state["ACC-001"]["balance"] == 0 and state["ACC-001"]["amount"] == 40
    assert state["ACC-001"]["_version"] == 3 and state["ACC-001"]["_lastEventType"] == "MoneyWithdrawn"
    heads = {r.aggregate_id: r.at_sequence for r in replay.replay_heads(df).collect()}
    assert heads == {"ACC-001": 3, "ACC-002": 1, "ORD-001": 1}


def test_closing_event_sets_status_unless_payload_does(spark):
    df = events_df(
        spark,
        [
            event("A", "T", 1, "AccountClosed", {"reason": "asked"}),
            event("B", "T", 1, "AccountClosed", {"status": "KEPT"}),
            event("C", "T", 1, "ClosedCreated", {}),
        ],
    )
    state = {r.aggregate_id: json.loads(r.state) for r in replay.state_map(replay.current_state(df)).collect()}
    assert state["A"]["status"] == "DELETED" and state["A"]["reason"] == "asked"
    assert state["B"]["status"] == "KEPT"
    assert "status" not in state["C"]


def test_numbers_compare_by_value(spark):
    df = events_df(spark, [event("A", "T", 1, "X", '{"v":1.0}'), event("A", "T", 2, "X", '{"v":1}')])
    assert replay.transitions(df).filter("key = 'v'").count() == 1


def test_a_hot_aggregate_is_spread_over_tasks(spark):
    """One aggregate with most rows must not end up in one partition."""
    from pyspark.sql import functions as F
    from tidemark.operators import detect, timeline

    events = spark.range(40_000).select(
        F.col("id").cast("string").alias("event_id"),
        F.when(F.col("id") % 4 > 0, "HOT").otherwise(F.concat(F.lit("A-"), (F.col("id") % 997).cast("string"))).alias("aggregate_id"),
        F.lit("T").alias("aggregate_type"),
        F.col("id").alias("sequence_number"),
        F.lit("Set").alias("event_type"),
        F.concat(F.lit('{"v":'), (F.col("id") % 7).cast("string"), F.lit("}")).alias("payload"),
        F.lit("{}").alias("metadata"),
        F.timestamp_seconds("id").alias("timestamp"),
        F.col("id").alias("global_position"),
    )
    saved = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        # joins as on a cluster, where neither side is small
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        ids = events.select("aggregate_id").distinct()
        for result in (
            replay.transitions(events, 500),
            detect.scan_anomalies(events, [detect.condition_rule("V", "v >= 0")], 500),
            timeline.events_page(timeline.events_for(events, ids), 1_000_000, 0, 500),
        ):
            sizes = [r["count"] for r in result.groupBy(F.spark_partition_id()).count().collect()]
            assert max(sizes) < 0.25 * sum(sizes)
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_short_histories_move_once_and_long_ones_are_cut(spark):
    from tidemark.plans.running import event_chunks

    rows = [event("HOT", "T", i, "X", {"v": i % 3, f"k{i % 2}": i}, position=i) for i in range(1, 40)]
    rows += [event(f"A{n}", "T", i, "X", {"v": n}, position=100 * n + i) for n in range(1, 5) for i in range(1, 4)]
    df = events_df(spark, rows)
    cut = {r.aggregate_id for r in event_chunks(df, 4)(df).filter("__chunk IS NOT NULL").collect()}
    assert cut == {"HOT"}
    whole, parts = (sorted(map(tuple, replay.transitions(df, w).collect()), key=repr) for w in (65_536, 4))
    assert whole == parts
    # where nothing is long, writes are not shuffled and no summaries are left
    out = replay.transitions(df)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "__last_old_w" not in plan and not re.search(r"Exchange hashpartitioning\([^)]*key", plan)


def test_columns_of_events_equal_a_row_per_write(spark, monkeypatch):
    """Copies, NULLs among the keys and cut aggregates: both ways of replay give the same rows."""
    rows = random_log(11, 120)
    rows += rows[5:20] + [event(None, "T", 1, "X", {"a": 1}, 900, "n1")]
    rows += [event("A-1", "T", 3, "X", {"a": 2}, 901, "n2", minutes=3)[:3] + (None, *event("A-1", "T", 3, "X", {"a": 2}, 901, "n2")[4:])]
    df = events_df(spark, rows)
    marks = df.filter("sequence_number % 3 = 0")

    def results(width):
        out = [
            replay.transitions(df, width), replay.event_diffs(replay.transitions(df, width, grouped=True)),
            replay.states_at_events(df, marks, width), replay.transition_states(df, width),
            replay.event_changes(df, width, ["event_type"]).filter("size(diff) > 0").drop("step"),
        ]
        return [sorted(map(repr, o.select(*sorted(o.columns)).collect())) for o in out]

    columns = results(65_536), results(4)
    monkeypatch.setattr(replay, "MOST_FIELDS", 0)
    assert columns == (results(65_536), results(65_536))


def test_diffs_and_states_of_events_are_not_shuffled_again(spark):
    """Only events move, by aggregate: neither a row per field nor the diffs of an event are dealt again."""
    df = events_df(spark, random_log(12, 60))
    for out in (
        replay.event_diffs(replay.transitions(df, grouped=True)),
        replay.transition_states(df),
        replay.event_changes(df),
    ):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert re.findall(r"Exchange hashpartitioning\(([^,]*)#", plan) == ["aggregate_id"], plan


def test_a_sweep_deals_events_by_aggregate_and_nothing_else(spark):
    """Neither writes nor states are dealt by field or target; the result is that of a cut log."""
    rows = random_log(13, 120)
    rows += rows[5:20] + [event(None, "T", 1, "X", {"a": 1}, 900, "n1"), event("A-1", "T", 3, "X", {"a": 2}, 901, "n2", 3)]
    rows += [(*event("A-1", "T", 3, "X", {"a": 2}, 902, "n3")[:7], None, 902)]
    df = events_df(spark, rows)
    for at, place, kind, values in (
        ("at", "sequence_number", "long", [None, -1, 0, 2, 3, 3, 50, 10_000, *range(300, 700)]),
        ("as_of", "timestamp", "timestamp", [None, *[T0 + timedelta(minutes=i) for i in (0, 3, 3, 40, 9_000)]]),
    ):
        asked = [(a, v) for a in ("HOT", "A-1", "A-2", "NONE", None) for v in values]
        targets = spark.createDataFrame(asked, f"aggregate_id string, {at} {kind}")
        found = replay.swept_writes(df, targets, at, place)
        cut = replay.swept_writes(df, targets, at, place, event_chunks(df, 4, True))
        got = sorted(map(repr, found.select(*sorted(found.columns)).collect()))
        assert got == sorted(map(repr, cut.select(*sorted(cut.columns)).collect())) and got
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        moved = re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)
        events = [m for m in moved if "key" in m or "__n" in m]
        assert not events, plan
