"""Event retrieval: pages, look-ups, searches."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_cursor, encode_cursor
from ..plans.running import DEFAULT_WIDTH, event_chunks, number_rows
from ..plans.small import broadcast_rows
from ..sources.schema import ORDER

# Default number of rows per listing; a stated limit is obeyed.
DEFAULT_PAGE = 500
DEFAULT_RECENT, DEFAULT_SEARCH = 50, 20
ZOOM_HOURS = (1, 6, 24, 168)


def chosen_limit(limit: int | None, default: int) -> int:
    """The stated limit, one row at least, whatever its size; the default where none is stated."""
    return default if limit is None else max(1, limit)


def _number(events: DataFrame, width: int, upto: int | None = None) -> DataFrame:
    return number_rows(events, ["aggregate_id"], ORDER, event_chunks(events, width), "step", upto)


def events_for(events: DataFrame, ids: DataFrame) -> DataFrame:
    """All events of the aggregates listed in ``ids(aggregate_id)``."""
    return events.join(ids.select("aggregate_id").distinct(), "aggregate_id", "left_semi")


def events_page(events: DataFrame, limit: int, offset: int = 0, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Events number offset+1 to offset+limit of every aggregate, with their ``step``."""
    offset = max(0, offset)
    return _number(events, width, offset + limit).filter(F.col("step") > offset)


def events_after_sequence(
    events: DataFrame, after: int, limit: int, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """The first ``limit`` events past a sequence, for every aggregate."""
    return _number(events.filter(F.col("sequence_number") > after), width, limit).drop("step")


def timeline_page(events: DataFrame, limit: int, after: int = 0, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Page header per aggregate: what ``events_after_sequence`` returns and where to go on.

    One row beyond the limit shows whether there is more.
    """
    limit = max(1, limit)
    ahead = _number(events.filter(F.col("sequence_number") > after), width, limit + 1)
    in_page = F.col("step") <= limit
    page = ahead.groupBy("aggregate_id").agg(
        F.count(F.when(in_page, 1)).alias("page_events"),
        F.max(F.col("step") > limit).alias("has_more"),
        F.max(F.when(in_page, F.col("sequence_number"))).alias("last_sequence"),
        F.max_by("timestamp", F.when(in_page, F.col("step"))).alias("last_timestamp"),
        F.min_by("aggregate_type", "step").alias("page_type"),
    )
    totals = count_events(events)
    joined = totals.join(page, "aggregate_id", "left")
    has_more = F.coalesce("has_more", F.lit(False))
    return joined.select(
        "aggregate_id",
        F.coalesce("page_type", F.lit("unknown")).alias("aggregate_type"),
        F.col("event_count").alias("total_events"),
        F.coalesce("page_events", F.lit(0)).alias("page_events"),
        has_more.alias("has_more"),
        F.coalesce("last_sequence", F.lit(after)).cast("long").alias("next_after"),
        F.when(has_more, encode_cursor(F.col("last_sequence"), F.col("last_timestamp"))).alias("next_cursor"),
    )


def events_after_cursor(
    events: DataFrame, cursors: DataFrame, limit: int, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Next page of each aggregate listed in ``cursors(aggregate_id, cursor)``."""
    starts = cursors.select("aggregate_id", decode_cursor(F.col("cursor"))["sequence"].alias("__after"))
    rest = events.join(starts, "aggregate_id").filter(F.col("sequence_number") > F.col("__after"))
    return _number(rest.drop("__after"), width, max(1, limit)).drop("step")


def events_up_to(events: DataFrame, limits: DataFrame | int) -> DataFrame:
    """Events up to a sequence: one number, or ``limits(aggregate_id, max_sequence)``."""
    if isinstance(limits, int):
        return events.filter(F.col("sequence_number") <= limits)
    bounded = events.join(limits.select("aggregate_id", "max_sequence"), "aggregate_id")
    return bounded.filter(F.col("sequence_number") <= F.col("max_sequence")).drop("max_sequence")


def recent_events(events: DataFrame, limit: int | None = None, order_by: str = "global_position") -> DataFrame:
    """The newest events of the whole store, oldest first."""
    newest = [F.desc(order_by)] + [F.desc(c) for c in ("global_position", "event_id") if c != order_by]
    oldest = [F.asc(order_by)] + [F.asc(c) for c in ("global_position", "event_id") if c != order_by]
    return events.orderBy(*newest).limit(chosen_limit(limit, DEFAULT_RECENT)).orderBy(*oldest)


def events_after_position(events: DataFrame, position: int, limit: int) -> DataFrame:
    """The next events in global order past a position."""
    return events.filter(F.col("global_position") > position).orderBy("global_position", "event_id").limit(limit)


def count_events(events: DataFrame) -> DataFrame:
    return events.groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("event_count"))


def aggregate_types(events: DataFrame) -> DataFrame:
    return events.select("aggregate_type").distinct().orderBy("aggregate_type")


def aggregate_ids_of_type(events: DataFrame, aggregate_type: str, limit: int, offset: int = 0) -> DataFrame:
    ids = events.filter(F.col("aggregate_type") == aggregate_type).select("aggregate_id").distinct()
    return ids.orderBy("aggregate_id").offset(max(0, offset)).limit(limit)


def _contains(value: Column, query: str, wildcards: bool) -> Column:
    if wildcards:
        return value.ilike(f"%{query}%")
    return F.contains(F.lower(value), F.lit(query.lower()))


def search_aggregates(
    events: DataFrame, query: str, limit: int | None = None, wildcards: bool = False
) -> DataFrame:
    """Sorted ids that contain ``query`` in any case; ``wildcards`` lets % and _ match."""
    if not query or not query.strip():
        raise ValueError("search text must not be blank")
    ids = events.filter(_contains(F.col("aggregate_id"), query, wildcards)).select("aggregate_id").distinct()
    return ids.orderBy("aggregate_id").limit(chosen_limit(limit, DEFAULT_SEARCH))


def search_summaries(
    events: DataFrame, query: str, limit: int | None = None, wildcards: bool = False
) -> DataFrame:
    """First event of each aggregate found by ``search_aggregates``."""
    limit = chosen_limit(limit, DEFAULT_SEARCH)
    found = broadcast_rows(search_aggregates(events, query, limit, wildcards), limit)
    return first_event(events.join(found, "aggregate_id", "left_semi"))


def _pick(events: DataFrame, by) -> DataFrame:
    rest = [c for c in events.columns if c != "aggregate_id"]
    picked = events.groupBy("aggregate_id").agg(by(F.struct(*rest), F.struct(*ORDER)).alias("__event"))
    return picked.select("aggregate_id", "__event.*").select(*events.columns)


def first_event(events: DataFrame) -> DataFrame:
    return _pick(events, F.min_by)


def last_event(events: DataFrame) -> DataFrame:
    return _pick(events, F.max_by)


def event_at(events: DataFrame, sequence: int) -> DataFrame:
    return events.filter(F.col("sequence_number") == sequence)


def timeline(
    events: DataFrame, limit: int | None = None, offset: int = 0, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """A page of events with the aggregate's whole event count and the page's type."""
    page = events_page(events, chosen_limit(limit, DEFAULT_PAGE), offset, width)
    types = page.groupBy("aggregate_id").agg(F.min_by("aggregate_type", "step").alias("timeline_type"))
    totals = count_events(events).withColumnRenamed("event_count", "total_events")
    return page.join(types, "aggregate_id").join(totals, "aggregate_id")


def timeline_header(
    events: DataFrame, limit: int | None = None, offset: int = 0, width: int = DEFAULT_WIDTH
) -> DataFrame:
    """Per aggregate: total, events in the page and type, ``unknown`` for an empty page."""
    page = events_page(events, chosen_limit(limit, DEFAULT_PAGE), offset, width)
    sizes = page.groupBy("aggregate_id").agg(
        F.count(F.lit(1)).alias("page_events"), F.min_by("aggregate_type", "step").alias("page_type")
    )
    return count_events(events).join(sizes, "aggregate_id", "left").select(
        "aggregate_id",
        F.coalesce("page_type", F.lit("unknown")).alias("aggregate_type"),
        F.col("event_count").alias("total_events"),
        F.coalesce("page_events", F.lit(0)).alias("page_events"),
    )


def metadata_only(events: DataFrame, empty: str | None = None) -> DataFrame:
    """Events without payload (NULL, or ``empty``); the scan no longer reads it."""
    return events.withColumn("payload", F.lit(empty).cast("string"))


def filter_events(
    events: DataFrame,
    aggregate_type: str | None = None,
    event_type: str | None = None,
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Filters of the query object; NULL means any. Bounds are inclusive."""
    if since is not None and until is not None and since > until:
        raise ValueError("since must not be after until")
    if aggregate_type is not None:
        events = events.filter(F.col("aggregate_type") == aggregate_type)
    if event_type is not None:
        events = events.filter(F.col("event_type") == event_type)
    if since is not None:
        events = events.filter(F.col("timestamp") >= F.lit(since))
    if until is not None:
        events = events.filter(F.col("timestamp") <= F.lit(until))
    return events


def zoom_window(events: DataFrame, hours: int, event_type: str | None = None) -> DataFrame:
    """Events within ``hours`` of the last (by sequence) remaining event of their aggregate."""
    kept = filter_events(events, event_type=event_type)
    ends = kept.groupBy("aggregate_id").agg(F.max_by("timestamp", F.struct(*ORDER)).alias("__end"))
    near = F.unix_micros("timestamp") >= F.unix_micros("__end") - hours * 3_600_000_000
    return kept.join(ends, "aggregate_id").filter(near).drop("__end")


def event_types_per_aggregate(events: DataFrame) -> DataFrame:
    return events.groupBy("aggregate_id").agg(F.sort_array(F.collect_set("event_type")).alias("event_types"))


def query_events(
    events: DataFrame,
    kind: str = "TIMELINE",
    *,
    aggregate_id: str | None = None,
    search: str | None = None,
    limit: int = 100,
    cursor_sequence: int = 0,
    fields: str = "ALL",
    **filters,
) -> DataFrame:
    """One query object: TIMELINE pages or SEARCH summaries, with filters and field choice."""
    if limit < 1:
        raise ValueError("limit must be positive")
    chosen = filter_events(events, **filters)
    if kind == "SEARCH":
        found = search_summaries(chosen, search or aggregate_id or "", limit)
    elif kind == "TIMELINE":
        if aggregate_id is not None:
            chosen = chosen.filter(F.col("aggregate_id") == aggregate_id)
        found = events_after_sequence(chosen, cursor_sequence, limit)
    else:
        raise ValueError(f"unknown query kind '{kind}'")
    return metadata_only(found, "{}") if fields == "METADATA" else found

