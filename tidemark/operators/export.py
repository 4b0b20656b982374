"""Exports as lines: each document is a relation ``aggregate_id, line_no, line``.

A document is never gathered into one value; the writer sorts its lines into
files, so one aggregate may fill many files.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_values import json_string, text
from ..functions.text import csv_field, identifier, instant_text, source_string
from ..plans.running import DEFAULT_WIDTH, cuts, event_chunks, number_rows, running
from ..sources.schema import ORDER
from .governance import DEFAULT_MASKS, MaskRule, mask_payload
from .replay import event_changes
from .timeline import count_events

# The CSV head, and a line number behind all others.
CSV_HEADER = "sequence,event_type,timestamp,payload"
LAST_LINE = 2**62


def _numbered(events: DataFrame, width: int) -> DataFrame:
    return running(
        events,
        ["aggregate_id"],
        ORDER,
        event_chunks(events, width),
        sums={"step": F.lit(1).cast("long")},
        totals={"steps": F.lit(1).cast("long")},
    )


def _lines(df: DataFrame, number: Column, line: Column) -> DataFrame:
    return df.select("aggregate_id", number.cast("long").alias("line_no"), line.alias("line"))


def export_csv(events: DataFrame, width: int = DEFAULT_WIDTH, ranged: bool = False) -> DataFrame:
    """Header line, then one line per event in sequence order.

    ``ranged``, for lines that are to be written: where no aggregate is long, events are dealt
    by ranges of aggregates, and ``write_lines`` need not move their lines again.
    """
    row = F.concat_ws(
        ",",
        F.col("sequence_number").cast("string"),
        csv_field(F.col("event_type")),
        csv_field(instant_text(F.col("timestamp"))),
        csv_field(F.col("payload")),
    )
    assign = event_chunks(events, width)
    if not cuts(assign):
        # the first event of an aggregate brings the header line
        dealt = events.repartitionByRange("aggregate_id") if ranged else events
        body = number_rows(dealt, ["aggregate_id"], ORDER, assign, "step")
        header = F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(CSV_HEADER).alias("line"))
        own = F.struct(F.col("step").cast("long").alias("line_no"), row.alias("line"))
        lines = F.array_compact(F.array(F.when(F.col("step") == 1, header), own))
        made = body.select("aggregate_id", F.inline(lines))
        made.ranged = ranged
        return made
    ids = events.select("aggregate_id").distinct()
    body = number_rows(events, ["aggregate_id"], ORDER, assign, "step")
    return _lines(ids, F.lit(0), F.lit(CSV_HEADER)).unionByName(_lines(body, F.col("step"), row))


def event_json(payload: Column) -> Column:
    """An event as a JSON object; the payload stays JSON text in a string."""

    def quoted(name: str, value: Column) -> Column:
        return F.concat(F.lit(f'"{name}":'), value)

    fields = F.concat_ws(
        ",",
        quoted("eventId", json_string("event_id")),
        quoted("aggregateId", json_string("aggregate_id")),
        quoted("aggregateType", json_string("aggregate_type")),
        quoted("sequenceNumber", F.col("sequence_number").cast("string")),
        quoted("eventType", json_string("event_type")),
        quoted("payload", json_string(payload)),
        quoted("metadata", json_string("metadata")),
        quoted("timestamp", json_string(instant_text(F.col("timestamp")))),
        quoted("globalPosition", F.col("global_position").cast("string")),
    )
    return F.concat(F.lit("{"), fields, F.lit("}"))


def export_json(
    events: DataFrame, exported_at: datetime | None = None, limit: int | None = None, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """A JSON document per aggregate: opening line, one line per event, closing line.

    With a ``limit`` the document holds the first events up to it and names it.
    """
    at = F.current_timestamp() if exported_at is None else F.lit(exported_at).cast("timestamp")
    limit_part = "" if limit is None else f',"limit":{limit}'
    opening = F.concat(
        F.lit('{"aggregateId":'), json_string("aggregate_id"),
        F.lit(',"exportedAt":'), json_string(instant_text(at)),
        F.lit(',"eventCount":'), F.col("event_count").cast("string"),
        F.lit(limit_part + ',"events":['),
    )
    assign = event_chunks(events, width)
    if not cuts(assign):
        # no aggregate is long: its first event brings the opening line, its last one the closing line
        by_order = Window.partitionBy("aggregate_id").orderBy(*ORDER)
        whole = by_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        placed = events.select(
            "*", F.row_number().over(by_order).cast("long").alias("step"), F.count(F.lit(1)).over(whole).alias("event_count")
        )
        if limit is not None:
            most = max(1, limit)
            placed = placed.withColumn("event_count", F.least("event_count", F.lit(most))).filter(F.col("step") <= most)
        follows = F.col("aggregate_id").isNotNull() & (F.col("step") < F.col("event_count"))

        def line(number: Column, text: Column) -> Column:
            return F.struct(number.cast("long").alias("line_no"), text.alias("line"))

        lines = F.array(
            F.when(F.col("step") == 1, line(F.lit(0), opening)),
            line(F.col("step"), F.concat(event_json(F.col("payload")), F.when(follows, ",").otherwise(""))),
            F.when(F.col("step") == F.col("event_count"), line(F.lit(LAST_LINE), F.lit("]}"))),
        )
        return placed.select("aggregate_id", F.inline(F.array_compact(lines)))
    if limit is not None:
        events = first_events(events, limit, width)
    counts = count_events(events)
    body = _numbered(events, width)
    comma = F.when(F.col("step") < F.col("steps"), ",").otherwise("")
    return (
        _lines(counts, F.lit(0), opening)
        .unionByName(_lines(body, F.col("step"), F.concat(event_json(F.col("payload")), comma)))
        .unionByName(_lines(counts, F.lit(LAST_LINE), F.lit("]}")))
    )


def export_markdown(events: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Title, table header, then one table line per event with its field changes."""
    ids = events.select("aggregate_id").distinct()
    titles = [
        F.concat(F.lit("# Event History: "), F.col("aggregate_id")),
        F.lit(""),
        F.lit("| # | Event Type | Timestamp | Changes |"),
        F.lit("|---|-----------|-----------|----------|"),
    ]
    head = ids.select(
        "aggregate_id",
        F.inline(F.array(*[F.struct(F.lit(i - 4).cast("long").alias("line_no"), t.alias("line")) for i, t in enumerate(titles)])),
    )

    def shown(value: Column) -> Column:
        return F.coalesce(text(value), F.lit("null"))

    body = event_changes(events, width, ["event_type", "timestamp"])
    texts = F.transform(
        "diff", lambda d: F.concat(d["key"], F.lit(": "), shown(d["old_json"]), F.lit(" → "), shown(d["new_json"]))
    )
    changes = F.when(F.size("diff") > 0, F.array_join(F.array_sort(texts), ", "))
    row = F.concat(
        F.lit("| "), F.col("sequence_number").cast("string"),
        F.lit(" | "), F.coalesce("event_type", F.lit("null")),
        F.lit(" | "), instant_text(F.col("timestamp")),
        F.lit(" | "), F.coalesce(changes, F.lit("—")), F.lit(" |"),
    )
    return head.unionByName(_lines(body, F.col("step"), row))


def export_fixture(events: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Source text of a test fixture per aggregate; an event is one multi-line block."""
    ids = events.select("aggregate_id").distinct()
    opening = F.concat(
        F.lit("// Generated event fixture, do not edit\n// Aggregate: "), F.col("aggregate_id"),
        F.lit("\n\npublic class "), identifier(F.col("aggregate_id")),
        F.lit("Fixture {\n\n    public static List<Map<String, Object>> events() {\n        return List.of("),
    )
    block = F.concat(
        F.lit('            Map.of(\n                "eventType", "'), source_string(F.col("event_type")),
        F.lit('",\n                "sequenceNumber", '), F.col("sequence_number").cast("string"),
        F.lit(',\n                "payload", "'), source_string(F.col("payload")),
        F.lit('",\n                "timestamp", "'), source_string(instant_text(F.col("timestamp"))),
        F.lit('"\n            )'),
        F.when(F.col("step") < F.col("steps"), ",").otherwise(""),
    )
    return (
        _lines(ids, F.lit(0), opening)
        .unionByName(_lines(_numbered(events, width), F.col("step"), block))
        .unionByName(_lines(ids, F.lit(LAST_LINE), F.lit("        );\n    }\n}")))
    )


def bulk_export(
    events: DataFrame,
    limit: int | None = None,
    rules: Sequence[MaskRule] | None = DEFAULT_MASKS,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """All events, or the first ``limit`` of every aggregate, masked."""
    kept = events if limit is None else first_events(events, limit, width)
    return kept if rules is None else mask_payload(kept, rules)


def first_events(events: DataFrame, limit: int, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The first ``limit`` events of every aggregate, one at least."""
    chunks = event_chunks(events, width)
    return number_rows(events, ["aggregate_id"], ORDER, chunks, "step", max(1, limit)).drop("step")


def write_lines(lines: DataFrame, path: str) -> None:
    """Write documents as text, in order within and across files.

    Range partitioning by (aggregate, line) splits a long document over files; lines that
    an export gives ``ranged`` lie in ranges of aggregates already and are only sorted.
    """
    dealt = lines if getattr(lines, "ranged", False) else lines.repartitionByRange("aggregate_id", "line_no")
    (
        dealt.sortWithinPartitions("aggregate_id", "line_no")
        .select("line")
        .write.mode("errorifexists")
        .text(path)
    )


def write_json_events(events: DataFrame, path: str) -> None:
    """Events as JSON lines, one folder per aggregate type, sorted by aggregate and sequence."""
    (
        events.repartitionByRange("aggregate_type", "aggregate_id", *ORDER)
        .sortWithinPartitions("aggregate_type", "aggregate_id", *ORDER)
        .write.mode("errorifexists")
        .partitionBy("aggregate_type")
        .json(path)
    )
