import json
import sys

import pytest
from helpers import event, events_df
from pyspark.sql import functions as F
from pyspark import cloudpickle
from tidemark.operators import reducers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def account(state, event):
    amount = event["payload"].get("amount", 0)
    sign = -1 if event["event_type"] == "MoneyWithdrawn" else 1
    return {"balance": state.get("balance", 0) + sign * amount, "n": state.get("n", 0) + 1}


def add(earlier, later):
    return {k: earlier.get(k, 0) + later.get(k, 0) for k in earlier.keys() | later.keys()}


def log(spark, n=30):
    rows, position = [], 0
    for a in ("A", "B", "C"):
        for s in range(1, n + 1):
            position += 1
            kind = "MoneyWithdrawn" if s % 3 == 0 else "MoneyDeposited"
            rows.append(event(a, "Account", s, kind, {"amount": s * position % 7}, position))
    return rows, events_df(spark, rows)


def expected_states(rows):
    out, state, current = {}, {}, None
    for r in sorted(rows, key=lambda r: (r[1], r[3])):
        if r[1] != current:
            current, state = r[1], {}
        state = account(state, {"event_type": r[4], "payload": json.loads(r[5])})
        out[(r[1], r[3])] = state
    return out


def test_folds_agree(spark):
    rows, df = log(spark)
    expected = expected_states(rows)
    plain = reducers.replay_fold(df, account, batch=7).collect()
    assert {(r.aggregate_id, r.sequence_number): json.loads(r.state) for r in plain} == expected
    merged = reducers.replay_mergeable(df, reducers.MergeableFold(account, add), width=3).collect()
    assert {(r.aggregate_id, r.sequence_number): json.loads(r.state) for r in merged} == expected
    sign = F.when(F.col("event_type") == "MoneyWithdrawn", -1).otherwise(1)
    amount = F.get_json_object("payload", "$.amount").cast("long")
    columns = reducers.ColumnReducer({"balance": sign * amount, "n": F.lit(1)}, {"kind": F.col("event_type")})
    by_column = reducers.replay_columns(df, columns, width=5).collect()
    assert {(r.aggregate_id, r.sequence_number): {"balance": r.balance, "n": r.n} for r in by_column} == expected
    final = {r.aggregate_id: r.balance for r in reducers.reduce_columns(df, columns).collect()}
    assert final == {a: expected[(a, 30)]["balance"] for a in "ABC"}


def test_whole_history(spark):
    _, df = log(spark, 10)
    got = reducers.reduce_events(df, lambda events: [e["sequence_number"] for e in events]).collect()
    assert {r.aggregate_id: json.loads(r.state) for r in got} == {a: list(range(1, 11)) for a in "ABC"}
    early = reducers.reduce_events(df, lambda events: next(iter(events))["event_id"]).collect()
    assert sorted(json.loads(r.state) for r in early) == ["A-1", "B-11", "C-21"]


def test_failure_names_the_event(spark):
    _, df = log(spark, 3)

    def broken(state, event):
        raise KeyError("x")

    with pytest.raises(Exception, match="reducer failed at sequence 1 .*of aggregate"):
        reducers.replay_fold(df, broken).collect()


def test_registry_picks_by_first_type(spark):
    rows = [
        event("A", "Account", 1, "MoneyDeposited", {"amount": 5}, 1),
        event("A", "Other", 2, "MoneyDeposited", {"amount": 6}, 2),
        event("B", "Order", 1, "OrderCreated", {"total": 9}, 3),
        event("C", "Points", 1, "Scored", {"amount": 1}, 4),
        event("C", "Points", 2, "Scored", {"amount": 2}, 5),
    ]
    amount = F.get_json_object("payload", "$.amount").cast("long")
    chosen = {"Account": account, "Points": reducers.ColumnReducer({"points": amount})}
    got = {
        (r.aggregate_id, r.sequence_number, r.key): r.value_json
        for r in reducers.replay_with(events_df(spark, rows), chosen).collect()
        if not r.key.startswith("_")
    }
    assert got == {
        ("A", 1, "balance"): "5", ("A", 1, "n"): "1", ("A", 2, "balance"): "11", ("A", 2, "n"): "2",
        ("B", 1, "total"): "9", ("C", 1, "points"): "1", ("C", 2, "points"): "3",
    }


def test_uncut_aggregates_fold_whole_beside_cut_ones(spark):
    rows = [event(a, "T", i, "X", {"v": 1}, position=i) for a, n in (("HOT", 40), ("A", 5), ("B", 3)) for i in range(1, n + 1)]

    def add(state, row):
        return {"n": state.get("n", 0) + 1}

    fold = reducers.MergeableFold(add, lambda a, b: {"n": a["n"] + b["n"]})
    got = reducers.replay_mergeable(events_df(spark, rows), fold, width=3).collect()
    assert len(got) == 48 and all(json.loads(r.state)["n"] == r.sequence_number for r in got)
