import random

import pytest
from helpers import event, events_df, fold
from pyspark.sql import functions as F
from test_replay import by_aggregate, random_log
from tidemark.functions.conditions import ConditionError, compile_condition
from tidemark.operators import detect, replay


def plain(condition, state):
    field, op, literal = condition.split(None, 2)
    value = state.get(field)
    if value is None:
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        limit = float(literal)
        return {"<": value < limit, ">": value > limit, "==": value == limit, "!=": value != limit,
                "<=": value <= limit, ">=": value >= limit}[op]
    text = {True: "true", False: "false"}.get(value, value) if isinstance(value, bool) else str(value)
    return {"==": text == literal, "!=": text != literal, "contains": literal in text}.get(op, False)


def plain_bisect(states):
    """(index or None, replays) by literal binary search."""
    if not states[-1]:
        return None, 1
    low, high, found, probes = 0, len(states) - 1, None, 1
    while low <= high:
        middle = (low + high) // 2
        probes += 1
        if states[middle]:
            found, high = middle, middle - 1
        else:
            low = middle + 1
    return found, probes


@pytest.mark.parametrize("part", [2, 5, 65_536])
def test_bisect_follows_the_probes(spark, part):
    rng = random.Random(part)
    rows, position = [], 0
    for a, n in enumerate([1, 2, 3, 5, 8, 13, 40, 97]):
        for s in range(1, n + 1):
            position += 1
            rows.append(event(f"A-{a}", "T", s, "Set", {"v": rng.randrange(3)}, position))
        position += 1
        rows.append(event(f"B-{a}", "T", 1, "Set", {"v": 1}, position))
    got = {r.aggregate_id: r for r in detect.bisect(events_df(spark, rows), "v > 0", width=7, part=part).collect()}
    for aggregate, group in by_aggregate(rows).items():
        folded = fold(group)
        index, replays = plain_bisect([s["v"] > 0 for _, _, s in folded])
        row = got[aggregate]
        assert row.replays == replays, aggregate
        assert row.sequence_number == (None if index is None else folded[index][0][3])


def test_bisect_texts(spark):
    rows = [
        event("A", "T", 1, "AccountCreated", {"balance": 100}, 1),
        event("A", "T", 2, "MoneyWithdrawn", {"balance": -50}, 2),
        event("B", "T", 1, "AccountCreated", {"balance": 0}, 3),
    ]
    asked = spark.createDataFrame([("A",), ("B",), ("C",)], "aggregate_id string")
    got = {r.aggregate_id: r for r in detect.bisect(events_df(spark, rows), "balance < 0", asked).collect()}
    assert got["A"].summary == "Event #2 (MoneyWithdrawn at 2026-03-24T10:02:00Z) first caused the condition"
    assert (got["B"].summary, got["B"].replays) == ("Condition never becomes true in entire history", 1)
    assert (got["C"].summary, got["C"].replays) == ("No events found", 0)
    diffs = detect.bisect_transitions(events_df(spark, rows), detect.bisect(events_df(spark, rows), "balance < 0"))
    assert [(r.old_json, r.new_json) for r in diffs.filter("key = 'balance'").collect()] == [("100", "-50")]


@pytest.mark.parametrize("condition", ["a > 0", "_version == 7", "status == DELETED", "t contains 5", "f != true"])
def test_first_occurrence(spark, condition):
    rows = random_log(5)
    got = {
        r.aggregate_id: (r.sequence_number, r.is_monotone)
        for r in detect.first_occurrence(events_df(spark, rows), condition, width=5).collect()
    }
    expected = {}
    for aggregate, group in by_aggregate(rows).items():
        hits = [(row[3], plain(condition, state)) for row, _, state in fold(group)]
        true = [s for s, h in hits if h]
        if true:
            expected[aggregate] = (true[0], all(h for s, h in hits if s >= true[0]))
    assert got == expected


def test_scan_matches_a_plain_loop(spark):
    rows = random_log(6)
    rules, rejected = detect.load_rules(
        [
            {"code": "GONE", "condition": "status == DELETED", "severity": "high"},
            {"code": "BIG", "condition": "a >= 2", "description": "too big"},
            {"code": "BAD", "condition": "a.b > 1"},
            {"code": "ODD", "condition": "a > 1", "severity": "URGENT"},
        ]
    )
    assert [c for c, _ in rejected] == ["BAD", "ODD"]
    got = {
        (r.aggregate_id, r.sequence_number, r.code)
        for r in detect.scan_anomalies(events_df(spark, rows), rules, width=6).collect()
    }
    expected = set()
    for group in by_aggregate(rows).values():
        for row, _, state in fold(group):
            version = state["_version"]
            if version > 50 and version % 50 == 0:
                expected.add((row[1], row[3], "SNAPSHOT_NEEDED"))
            if plain("status == DELETED", state):
                expected.add((row[1], row[3], "GONE"))
            if plain("a >= 2", state):
                expected.add((row[1], row[3], "BIG"))
    assert got == expected


def test_custom_rule_and_states(spark):
    rows = [
        event("A", "T", 1, "AccountCreated", {"balance": 0}, 1),
        event("A", "T", 2, "MoneyWithdrawn", {"balance": -10}, 2),
        event("A", "T", 3, "Noted", {"note": "x"}, 3),
    ]
    rule = detect.Rule(
        "LOW", "low", "HIGH", ("balance",), lambda v: (v("balance") == "-10") & (F.col("event_type") == "Noted")
    )
    hits = detect.scan_anomalies(events_df(spark, rows), [rule])
    assert [(r.sequence_number, r.code) for r in hits.collect()] == [(3, "LOW")]
    state = {r.key: r.value_json for r in detect.attach_states(events_df(spark, rows), hits).collect()}
    assert state["balance"] == "-10" and state["note"] == '"x"' and state["_version"] == "3"


def test_scan_recent_takes_the_oldest_of_the_recent(spark):
    rows = [event(f"A-{i}", "T", 1, "Set", {"v": -i}, i) for i in range(1, 11)]
    rules, _ = detect.load_rules([{"code": "NEG", "condition": "v < 0"}])
    hits = detect.scan_recent(events_df(spark, rows), rules, limit=5, max_aggregates=2)
    assert {r.aggregate_id for r in hits.collect()} == {"A-6", "A-7"}
    hits = detect.scan_recent(events_df(spark, rows), rules, limit=5, max_aggregates=2, newest_first=True)
    assert {r.aggregate_id for r in hits.collect()} == {"A-10", "A-9"}


@pytest.mark.parametrize("text", [None, "", "balance", "balance; DROP TABLE events; --", "a.b > 1", "a ~ 1", "v < -1"])
def test_bad_conditions(text):
    with pytest.raises(ConditionError):
        compile_condition(text)


def test_lenient_condition():
    assert compile_condition("v < -1.5", strict=False).literal == "-1.5"


def counted(spark, df):
    """The rows of ``df``, and how many of them are read."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), read


def test_a_survey_reads_a_log_once(spark):
    log, read = counted(spark, events_df(spark, random_log(5)))
    found = replay.survey(log)
    assert read.value == len(random_log(5))
    assert {"status", "_version"} <= set(found.fields)


def test_reports_take_the_anomalies_once(spark):
    events = events_df(spark, random_log(5))
    expected = detect.scan_anomalies(events, detect.load_rules([{"code": "LOW", "condition": "balance < 50"}])[0])
    expected = expected.unionByName(expected.limit(1)).unionByName(
        expected.limit(1).withColumn("aggregate_id", F.lit(None).cast("string"))
    ).localCheckpoint()
    joined = expected.join(replay.state_map(detect.attach_states(events, expected), replay.KEYS), replay.KEYS, "left")
    anomalies, read = counted(spark, expected)
    got = detect.report_states(events, anomalies)
    assert got.columns == joined.columns
    rows = sorted(map(repr, got.collect()))
    assert read.value == len(rows) > 2
    assert rows == sorted(map(repr, joined.collect()))


def test_fields_of_any_name_are_replayed(spark):
    payloads = [{"e`f": 1, "q'r": None, "$.x": [1.0]}, {"e`f": 2, "": 5}, {"A": 1, "a": 2}, '{"a":1} and more', '{"a":']
    rows = [event("X", "T", i, "Set", p, i) for i, p in enumerate(payloads, 1)]
    for kept in (rows[:2], rows):
        df = events_df(spark, kept)
        got = {(r.sequence_number, r.key): r.value_json for r in replay.states_at_events(df, df).collect()}
        last = {k: v for (n, k), v in got.items() if n == len(kept) and not k.startswith("_")}
        fields = {"e`f": "2", "q'r": "null", "$.x": "[1]", "": "5"}
        assert last == (fields if len(kept) == 2 else {**fields, "A": "1", "a": "1"})


def test_only_texts_that_may_hold_a_field_are_parsed(spark):
    rows = [
        event("A", "T", 1, "Set", '{"x": 1}', 1),
        event("A", "T", 2, "Set", '{"\\u0078": 2}', 2),
        event("A", "T", 3, "Set", '{"y": 7, "z": "x"}', 3),
        event("A", "T", 4, "Set", None, 4),
        event("A", "T", 5, "Set", "x", 5),
        event("A", "T", 6, "Set", '{"y": 8}', 6),
    ]
    found = detect.narrow_writes(events_df(spark, rows), ["x"])
    assert [r.w_x for r in found.orderBy("sequence_number").collect()] == ["1", "2", None, None, None, None]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(payload" in plan and "CASE WHEN" in plan
