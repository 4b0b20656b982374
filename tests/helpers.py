"""Small logs and a plain-Python replay to compare with."""

import json
from datetime import datetime, timedelta, timezone

from tidemark.sources.schema import EVENT_SCHEMA

T0 = datetime(2026, 3, 24, 10, 0, tzinfo=timezone.utc)


def event(aggregate, kind, sequence, event_type, payload, position=None, event_id=None, minutes=None):
    position = sequence if position is None else position
    return (
        event_id or f"{aggregate}-{position}",
        aggregate,
        kind,
        sequence,
        event_type,
        payload if payload is None or isinstance(payload, str) else json.dumps(payload),
        '{"source":"contract"}',
        T0 + timedelta(minutes=sequence if minutes is None else minutes),
        position,
    )


def events_df(spark, rows):
    return spark.createDataFrame(rows, EVENT_SCHEMA)


def canonical_events(spark):
    """The contract set: two accounts and an order."""
    return events_df(
        spark,
        [
            event("ACC-001", "BankAccount", 1, "AccountCreated", {"balance": 0}, 1),
            event("ACC-001", "BankAccount", 2, "MoneyDeposited", {"amount": 100}, 2),
            event("ACC-001", "BankAccount", 3, "MoneyWithdrawn", {"amount": 40}, 3),
            event("ACC-002", "BankAccount", 1, "AccountCreated", {"balance": 50}, 4),
            event("ORD-001", "Order", 1, "OrderCreated", {"total": 99}, 5),
        ],
    )


def iso(ts):
    text = ts.strftime("%Y-%m-%dT%H:%M:%S")
    micros = ts.microsecond
    if micros:
        text += f".{micros // 1000:03d}" if micros % 1000 == 0 else f".{micros:06d}"
    return text + "Z"


def fold(rows):
    """States after each event of one aggregate, by a plain loop."""
    state, out = {}, []
    for row in sorted(rows, key=lambda r: (r[3], r[8], r[0])):
        before = dict(state)
        state = dict(state)
        state["_version"], state["_lastEventType"], state["_lastUpdated"] = row[3], row[4], iso(row[7])
        low = row[4].lower()
        opening = any(w in low for w in ("created", "opened", "placed", "submitted"))
        if not opening and any(w in low for w in ("deleted", "closed", "cancelled", "rejected")):
            state["status"] = "DELETED"
        try:
            payload = json.loads(row[5])
        except (TypeError, ValueError):
            payload = {}
        state.update(payload if isinstance(payload, dict) else {})
        out.append((row, before, state))
    return out
