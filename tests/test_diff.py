import json
import re

import pytest
from pyspark.sql import functions as F
from helpers import event, events_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tidemark.operators import diff, replay
from tidemark.plans.running import event_chunks


def plain_diff(left, right, path="$"):
    """(path, kind, old, new) by recursion."""
    if left == right and json.dumps(left, sort_keys=True) == json.dumps(right, sort_keys=True):
        return []
    if left is None:
        return [(path, "added", None, right)]
    if right is None:
        return [(path, "removed", left, None)]
    if isinstance(left, list) and isinstance(right, list):
        out = []
        for i in range(max(len(left), len(right))):
            a = left[i] if i < len(left) else None
            b = right[i] if i < len(right) else None
            out += plain_diff(a, b, f"{path}[{i}]")
        return out
    if isinstance(left, dict) and isinstance(right, dict):
        out = []
        for key in {**left, **right}:
            out += plain_diff(left.get(key), right.get(key), f"{path}.{key}")
        return out
    return [(path, "changed", left, right)]


def deep(spark, pairs, **options):
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = {i: [] for i in range(len(pairs))}
    for r in diff.deep_diff(df, "a", "b", ["id"], **options).collect():
        load = lambda t: None if t is None else json.loads(t)
        got[r.id].append((r.path, r.kind, load(r.old_json), load(r.new_json)))
    return got


def test_deep_diff_cases(spark):
    pairs = [
        (
            {"account": {"balance": 10, "tags": ["open", "vip"]}},
            {"account": {"balance": 25, "tags": ["open", "priority"], "owner": "alice"}},
        ),
        ({"before": {"retries": 3}}, {"before": {}}),
        ({"a": [1]}, {"a": {"b": 1}}),
        ({"a": None}, {"a": None, "b": None}),
        ([], [1]),
        ({"a": {}}, {"a": {"x": []}}),
        (1, 1),
        (None, {"a": 1}),
    ]
    got = deep(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        assert sorted(got[i], key=str) == sorted(plain_diff(a, b), key=str), pairs[i]
    assert {p[0] for p in got[0]} == {"$.account.balance", "$.account.tags[1]", "$.account.owner"}


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.sampled_from(["", "x", "é"]),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from("abc"), inner, max_size=3),
    max_leaves=8,
)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(pairs=st.lists(st.tuples(json_values, json_values), min_size=30, max_size=30))
def test_deep_diff_matches_recursion(spark, pairs):
    got = deep(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        assert sorted(got[i], key=str) == sorted(plain_diff(a, b), key=str)


def test_too_deep_is_an_error(spark):
    nested = lambda v: {"a": {"b": {"c": v}}}
    with pytest.raises(Exception, match="deeper than depth"):
        deep(spark, [(nested({"d": 1}), nested({"d": 2}))], depth=3)


def test_levels_are_counted_outside_of_texts(spark):
    texts = ['{"a":[1,{"b":"]}}"}]}', "1", '"[[["', "[[[", None, '{"\\"{":[]}', "[" * 30 + "]" * 30, '["\\\\",{"a":"\\"["}]', json.dumps({"long": "\\\"{" * 50_000}), '{"x":"\\\\"}', "[[],{},[[]]]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(diff.nesting(F.col("t"))).collect()] == [3, 0, 0, 0, 0, 2, 30, 2, 1, 1, 3]


def test_deep_documents_have_their_patches(spark):
    def nested(levels, leaf):
        for i in range(levels):
            leaf = {"k": leaf} if i % 2 else [leaf]
        return leaf

    pairs = [(nested(40, 1), nested(40, 2)), (nested(3, 1), nested(9, 1)), ({"a": 1}, {"a": 2})]
    got = deep(spark, pairs)
    assert [p[1:] for p in got[0]] == [("changed", 1, 2)] and got[0][0][0].count(".k") == 20
    for i, (a, b) in enumerate(pairs):
        assert sorted(got[i], key=str) == sorted(plain_diff(a, b), key=str)


def test_aggregates_and_sequences(spark):
    df = events_df(
        spark,
        [
            event("A", "T", 1, "Set", {"balance": 10, "status": "OPEN"}, 1),
            event("A", "T", 2, "Set", {"balance": 20}, 2),
            event("B", "T", 1, "Set", {"balance": 50, "status": "OPEN", "flag": "FRAUD"}, 3),
        ],
    )
    pairs = spark.createDataFrame([("A", "B"), ("A", "none")], "left_id string, right_id string")
    found = diff.diff_aggregates(df, pairs).collect()
    plain = {(r.right_id, r.key): (r.old_json, r.new_json) for r in found if not r.key.startswith("_")}
    assert plain == {
        ("B", "balance"): ("20", "50"), ("B", "flag"): (None, '"FRAUD"'),
        ("none", "balance"): ("20", None), ("none", "status"): ('"OPEN"', None),
    }
    requests = spark.createDataFrame([("A", 1, 2), ("A", 2, 1)], "aggregate_id string, from_sequence long, to_sequence long")
    at = diff.diff_at_sequences(df, requests).filter("key = 'balance'").collect()
    assert {(r.from_sequence, r.old_json, r.new_json) for r in at} == {(1, "10", "20"), (2, "20", "10")}


def test_field_diff_and_rows(spark):
    schema = "aggregate_id string, key string, value_json string"
    before = spark.createDataFrame([("A", "balance", "100"), ("A", "status", '"OPEN"'), ("A", "n", "null")], schema)
    after = spark.createDataFrame([("A", "balance", "200"), ("A", "email", '"new@test.com"')], schema)
    changes = diff.field_diff(before, after, ["aggregate_id"])
    assert {r.key for r in changes.collect()} == {"balance", "status", "email"}
    assert {r.kind for r in diff.diff_rows(changes, ["aggregate_id"]).collect()} == {"changed"}
    assert diff.diff_counts(changes, ["aggregate_id"]).first().changes == 3


def test_ends_of_requests_are_paired_where_they_lie(spark, monkeypatch):
    rows = [event(f"A-{i % 7}", "T", i // 7 + 1, "Set", {f"f{i % 3}": i % 5}, i) for i in range(140)]
    df = events_df(spark, [*rows, *rows[:9], event(None, "T", 1, "Set", {"f0": 1}, 999)])
    asked = [(f"A-{i % 8}", a, b) for i in range(8) for a in (None, 0, 1, 5, 30) for b in (None, 0, 5, 6, 30)]
    requests = spark.createDataFrame([*asked, *asked[:3], (None, 1, 2)], "aggregate_id string, from_sequence long, to_sequence long")
    found = diff.diff_at_sequences(df, requests)
    got = sorted(map(repr, found.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not re.findall(r"Exchange hashpartitioning\([^)]*key", plan)
    monkeypatch.setattr(diff, "event_chunks", lambda events: event_chunks(events, 4, True))
    assert got == sorted(map(repr, diff.diff_at_sequences(df, requests).collect())) and got


def test_texts_of_few_brackets_are_not_looked_into(spark):
    flat = '{"a": [1, {"b": 2}]}'
    wide = json.dumps({"a": [{"b": i} for i in range(20)], "t": "[[[[{{{{"})
    rows = [(0, flat, '{"a": [1, {"b": 3}]}'), (1, flat, wide), (2, wide, wide.replace("19", "21")), (3, None, wide), (4, "[[", flat)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    assert [r[0] for r in df.select(diff._brackets(F.col("a"))).collect()] == [3, 3, 30, 0, 2]
    found = diff.deep_diff(df, "a", "b", ["id"])
    explodes = found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode")
    got = {i: [(r.path, r.kind) for r in found.filter(F.col("id") == i).collect()] for i in (0, 2, 3, 4)}
    assert got[0] == [("$.a[1].b", "changed")] and got[2] == [("$.a[19].b", "changed")]
    assert got[3] == [("$", "added")] and got[4] == [("$", "added")]
    assert explodes == 3
    few = diff.deep_diff(df.filter("id = 0"), "a", "b", ["id"])
    bound = few._jdf.queryExecution().optimizedPlan().toString()
    assert bound.count("Generate explode") == 3


def test_last_writes_come_from_events_that_move_once(spark, monkeypatch):
    rows = [
        event("A", "T", 1, "Set", {"x": 1, "s": "a", "n": None}, 1),
        event("A", "T", 2, "Set", {"x": None, "_version": "own"}, 2),
        event("A", "T", 3, "AccountClosed", {"y": {"b": [1, 2.50]}}, 3),
        event("B", "T", 1, "Set", {"x": 1.0, "status": "OPEN", "_lastUpdated": None}, 4),
        event("B", "T", 2, "Cancelled", {"status": None}, 5),
        event("C", "T", 1, None, "no json", 6, minutes=0),
        event(None, "T", 1, "Set", {"x": 9}, 7),
    ]
    df = events_df(spark, [*rows, rows[1]])
    pairs = spark.createDataFrame(
        [("A", "B"), ("B", "C"), ("C", "none"), ("none", "A"), ("A", "A"), (None, "A"), ("A", "B")],
        "left_id string, right_id string",
    )
    first = df.filter("sequence_number = 1")

    def results():
        plan = replay.survey(df)
        frames = [
            replay.current_state(df),
            diff.diff_aggregates(df, pairs),
            diff.field_diff(
                replay.current_state(first, plan, grouped=True), replay.current_state(df, plan, grouped=True), ["aggregate_id"]
            ),
        ]
        return frames, [sorted(map(repr, f.collect())) for f in frames]

    frames, got = results()
    for f in frames:
        plan = f._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert not re.findall(r"Exchange hashpartitioning\([^)]*key", plan)
    # the way by rows: of many fields, and of NULL aggregates that are many
    for name, value in (("MOST_FIELDS", 0), ("maybe_long", lambda largest, width: (largest or 0) == 1)):
        with monkeypatch.context() as patch:
            patch.setattr(replay, name, value)
            assert not replay.in_columns(replay.survey(df))
            assert results()[1] == got
    plain = diff.field_diff(replay.current_state(first), replay.current_state(df), ["aggregate_id"])
    assert sorted(map(repr, plain.collect())) == got[2] and all(got)


def test_counts_lie_beside_the_diffs(spark):
    """Display rows with their counts are those of a join with the counts, and no diff is shuffled for them."""
    rows = [event(f"A{i % 3}", "T", 1 + i // 6, "X", {"n": i, f"f{i % 4}": i // 5}, i) for i in range(60)]
    rows += rows[:9] + [(r[0], None, *r[2:]) for r in rows[:4]] + [(*r[:3], None, *r[4:]) for r in rows[4:8]]
    events, by = events_df(spark, rows), ["aggregate_id", "sequence_number"]
    long = replay.transitions(events)
    wanted = diff.diff_rows(long, by).join(diff.diff_counts(long, by), by)
    grouped = replay.transitions(events, grouped=True)
    assert sorted(map(tuple, diff.diff_counts(grouped, by).collect()), key=str) == sorted(map(tuple, diff.diff_counts(long, by).collect()), key=str)
    found = [
        diff.diff_rows(diff.diff_counts(changes, by, beside=True, dealt=dealt), [*by, "changes"]).select(wanted.columns)
        for changes in (grouped, long, replay.transitions(events, width=2, grouped=True))
        for dealt in (None, by[:1])
    ]
    for got in found:
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, wanted.collect()), key=str)
    moved = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    # plans that were not run: a plan that was is shown twice
    assert moved(found[1].select("*")) == moved(grouped) == 1
