"""The event relation: column mapping, defaults, checks."""

from __future__ import annotations

import operator
import re
from collections.abc import Collection, Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("aggregate_id", T.StringType()),
        T.StructField("aggregate_type", T.StringType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("global_position", T.LongType()),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# Order inside an aggregate; the last two only break ties.
ORDER = ["sequence_number", "global_position", "event_id"]

# Physical column names tried for each logical column, in order.
COLUMN_CANDIDATES = {
    "event_id": ["event_id", "id", "uid"],
    "aggregate_id": ["aggregate_id", "stream_id", "entity_id", "stream_key"],
    "aggregate_type": ["aggregate_type", "stream_type", "entity_type"],
    "sequence_number": ["sequence_number", "version", "seq", "position", "event_number", "revision"],
    "event_type": ["event_type", "type_name", "event_name", "type"],
    "payload": [
        "payload", "data", "event_data", "body", "json_data", "json_payload", "event_body", "event_payload",
    ],
    "metadata": ["metadata", "meta", "headers"],
    "timestamp": ["timestamp", "occurred_at", "event_timestamp", "created_at", "inserted_at"],
    "global_position": ["global_position", "global_seq", "log_position", "seq_id", "transaction_id"],
}
OPTIONAL_COLUMNS = {"aggregate_type", "metadata", "timestamp", "global_position"}

# Table names tried in order when none is given.
TABLE_CANDIDATES = [
    "event_store", "events", "domain_events", "stored_events", "event_log", "aggregate_events",
    "es_events", "es_event", "mt_events", "domain_event_entry", "event_journal", "outbox_event",
]

# Accepted shapes of names and ids.
AGGREGATE_ID_PATTERN = r"^[a-zA-Z0-9\-_]{1,255}$"
EVENT_TYPE_PATTERN = r"^[A-Z][A-Z0-9_]{0,127}$"
AGGREGATE_TYPE_PATTERN = r"^[A-Z][A-Z0-9_]{0,63}$"
COLUMN_NAME_PATTERN = r"^[a-z][a-z0-9_]{0,63}$"


class SchemaError(ValueError):
    """The table is missing or cannot be read as an event log."""


def resolve_columns(columns: list[str], overrides: Mapping[str, str] | None = None) -> dict[str, str | None]:
    """Physical column for each logical one; None for an absent optional column."""
    overrides = dict(overrides or {})
    for logical, physical in overrides.items():
        if logical not in COLUMN_CANDIDATES:
            raise SchemaError(f"unknown logical column '{logical}'")
        if physical is not None and not re.fullmatch(COLUMN_NAME_PATTERN, physical):
            raise SchemaError(f"unsafe column name '{physical}' for '{logical}'")
    present = {c.lower(): c for c in columns}
    resolved: dict[str, str | None] = {}
    for logical, candidates in COLUMN_CANDIDATES.items():
        tried = [overrides[logical]] if overrides.get(logical) else candidates
        found = next((present[c] for c in tried if c in present), None)
        if found is None and (logical not in OPTIONAL_COLUMNS or overrides.get(logical)):
            raise SchemaError(f"no column for '{logical}'; tried {tried}")
        resolved[logical] = found
    return resolved


def _instant(df: DataFrame, physical: str) -> Column:
    if isinstance(df.schema[physical].dataType, (T.StringType, T.NumericType)):
        return normalize_timestamps(F.col(physical))
    return F.col(physical).cast("timestamp")


# What a NULL in a column stands for.
DEFAULTS = {
    "event_id": "", "aggregate_id": "", "aggregate_type": "unknown", "metadata": "{}",
    "sequence_number": 0, "global_position": 0, "timestamp": datetime.fromtimestamp(0, timezone.utc),
}
COMPARISONS = {
    "=": operator.eq, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda column, values: column.isin(list(values)),
    "startswith": lambda column, prefix: column.startswith(prefix),
}
Wanted = tuple[str, str, object]


def _holds(value, comparison: str, wanted) -> bool:
    """A comparison of plain values."""
    if comparison == "in":
        return value in wanted
    return value.startswith(wanted) if comparison == "startswith" else COMPARISONS[comparison](value, wanted)


def physical_filter(df: DataFrame, physical: str | None, logical: str, comparison: str, wanted) -> Column | None:
    """The condition on a table's own column that says the same as one on the mapped column, where there is one.

    The table's column is compared as it is, so the condition reaches the scan;
    rows with NULL are taken if what NULL stands for meets the condition.
    """
    if physical is None:
        return None
    kind, column = df.schema[physical].dataType, F.col(physical)
    texts = logical not in ("sequence_number", "global_position", "timestamp")
    numbers = logical in ("sequence_number", "global_position")
    if texts and isinstance(kind, T.IntegralType) and comparison in ("=", "in"):
        # a text of a whole number is that number's only form
        asked = [wanted] if comparison == "=" else list(wanted)
        whole = [int(w) for w in asked if re.fullmatch(r"0|-?[1-9][0-9]{0,17}", w)]
        condition = column.isin(whole) if whole else F.lit(False)
    elif (
        texts and isinstance(kind, T.StringType)
        or numbers and isinstance(kind, T.IntegralType)
        or logical == "timestamp" and isinstance(kind, T.TimestampType)
    ):
        condition = COMPARISONS[comparison](column, wanted)
    else:
        return None
    default = DEFAULTS.get(logical)
    if default is not None and logical == "timestamp":
        zoned = lambda t: t if t.tzinfo else t.astimezone()
        wanted = [zoned(t) for t in wanted] if comparison == "in" else zoned(wanted)
    return condition | column.isNull() if default is not None and _holds(default, comparison, wanted) else condition


def map_event_columns(
    df: DataFrame,
    overrides: Mapping[str, str] | None = None,
    not_null: Collection[str] = (),
    where: Iterable[Wanted] = (),
) -> DataFrame:
    """Project a physical table onto the event schema; one narrow select.

    NULLs become defaults. ``where`` keeps rows by conditions (logical column,
    comparison, value), all of which must hold, such as ``("aggregate_id", "=",
    "A-1")``; they are put to the table's own columns, so that they reach the scan
    although NULLs may stand there. Filters on the result reach it only for columns
    that need no default: those named in ``not_null``, or declared so by the table's
    schema, whose type fits too.
    """
    at = resolve_columns(df.columns, overrides)
    where = list(where)
    for logical, comparison, _ in where:
        if logical not in COLUMN_CANDIDATES or comparison not in COMPARISONS:
            raise SchemaError(f"no condition '{comparison}' on '{logical}'")
    reached = [physical_filter(df, at[c] or (at["event_id"] if c == "global_position" else None), c, *rest) for c, *rest in where]
    for condition in reached:
        df = df if condition is None else df.filter(condition)
    mapped = _mapped(df, at, not_null)
    for (logical, comparison, wanted), condition in zip(where, reached):
        mapped = mapped if condition is not None else mapped.filter(COMPARISONS[comparison](F.col(logical), wanted))
    return mapped


def _mapped(df: DataFrame, at: Mapping[str, str | None], not_null: Collection[str]) -> DataFrame:
    unknown = set(not_null) - set(COLUMN_CANDIDATES)
    if unknown:
        raise SchemaError(f"unknown logical columns {sorted(unknown)}")

    def bare(logical: str, kind: T.DataType) -> Column | None:
        physical = at[logical]
        field = None if physical is None else df.schema[physical]
        if field is None or field.dataType != kind or (field.nullable and logical not in not_null):
            return None
        return F.col(physical)

    def text(logical: str, default: str | None = None) -> Column:
        if at[logical] is None:
            return F.lit(default)
        known = bare(logical, T.StringType())
        if known is not None:
            return known
        value = F.col(at[logical]).cast("string")
        return value if default is None else F.coalesce(value, F.lit(default))

    def whole(known: Column | None, mended: Column) -> Column:
        return mended if known is None else known

    epoch = F.timestamp_seconds(F.lit(0))
    ts = epoch if at["timestamp"] is None else F.coalesce(_instant(df, at["timestamp"]), epoch)
    ts = whole(bare("timestamp", T.TimestampType()), ts)
    position = at["global_position"] or at["event_id"]
    return df.select(
        text("event_id", "").alias("event_id"),
        text("aggregate_id", "").alias("aggregate_id"),
        text("aggregate_type", "unknown").alias("aggregate_type"),
        whole(
            bare("sequence_number", T.LongType()),
            F.coalesce(F.col(at["sequence_number"]).try_cast("long"), F.lit(0)),
        ).alias("sequence_number"),
        text("event_type").alias("event_type"),
        text("payload").alias("payload"),
        text("metadata", "{}").alias("metadata"),
        ts.alias("timestamp"),
        whole(
            bare("global_position", T.LongType()), F.coalesce(F.col(position).try_cast("long"), F.lit(0))
        ).alias("global_position"),
    )


def load_event_table(
    spark: SparkSession,
    name: str | None = None,
    overrides: Mapping[str, str] | None = None,
    not_null: Collection[str] = (),
    where: Iterable[Wanted] = (),
) -> DataFrame:
    """The named table, or the first candidate table that exists, as events; ``where`` as in ``map_event_columns``."""
    if name is not None:
        if not spark.catalog.tableExists(name):
            raise SchemaError(f"table or view '{name}' not found")
        return map_event_columns(spark.table(name), overrides, not_null, where)
    for candidate in TABLE_CANDIDATES:
        if spark.catalog.tableExists(candidate):
            return map_event_columns(spark.table(candidate), overrides, not_null, where)
    raise SchemaError(f"no event table found; searched {TABLE_CANDIDATES}")


def normalize_timestamps(value: Column) -> Column:
    """Instant from ISO-8601 text, or from epoch seconds (below 1e12) or milliseconds."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    millis = F.when(number < 1e12, number * 1000).otherwise(number)
    return F.coalesce(
        F.when(text.rlike(r"T|^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text)),
        F.when(~F.isnan(number), F.timestamp_millis(millis.cast("long"))),
    )


def event_time(payload: Column, created_at: Column, now: Column | None = None) -> Column:
    """Time of a mapped event: the payload's ``createdDate``, else the row's own time, else now."""
    stated = normalize_timestamps(F.get_json_object(payload, "$.createdDate"))
    return F.coalesce(stated, created_at.cast("timestamp"), F.current_timestamp() if now is None else now)


def validate_events(df: DataFrame) -> DataFrame:
    """Flag columns: which of id, event type and aggregate type have a bad shape."""

    def bad(column: str, pattern: str) -> Column:
        # the whole value must fit; "$" alone would let a last line feed through
        whole = pattern.removesuffix("$") + r"\z"
        return ~F.coalesce(F.col(column).rlike(whole), F.lit(False))

    return df.withColumns(
        {
            "bad_aggregate_id": bad("aggregate_id", AGGREGATE_ID_PATTERN),
            "bad_event_type": bad("event_type", EVENT_TYPE_PATTERN),
            "bad_aggregate_type": bad("aggregate_type", AGGREGATE_TYPE_PATTERN),
        }
    )


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events and the quarantined rest (with its flags)."""
    flagged = validate_events(df)
    bad = F.col("bad_aggregate_id") | F.col("bad_event_type") | F.col("bad_aggregate_type")
    return flagged.filter(~bad).select(*df.columns), flagged.filter(bad)


def check_sequence_keys(df: DataFrame) -> DataFrame:
    """(aggregate_id, sequence_number) pairs that occur more than once."""
    return (
        df.groupBy("aggregate_id", "sequence_number")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def drop_resent(df: DataFrame) -> DataFrame:
    """One event per (aggregate_id, sequence_number): the first by position.

    Copies are folded on the map side, so a key with many copies costs no task
    more than its share.
    """
    rest = [c for c in df.columns if c not in ("aggregate_id", "sequence_number")]
    kept = df.groupBy("aggregate_id", "sequence_number").agg(
        F.min_by(F.struct(*rest), F.struct("global_position", "event_id")).alias("__event")
    )
    return kept.select("aggregate_id", "sequence_number", "__event.*").select(*df.columns)
