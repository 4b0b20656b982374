"""State from events, in long form: one row per (aggregate, field).

The generic reducer only ever overwrites fields one by one, so a field's value
after an event is the last value written to it. That makes replay a matter of
"last write per field" instead of a fold over whole states.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.json_values import (
    alike, field_json, field_of, json_string, object_fields, object_parts, object_text, part_json,
)
from ..functions.text import has_any_word, instant_text
from ..plans.running import (
    CHUNK, DEFAULT_WIDTH, Assign, cuts, event_chunks, id_bucket, maybe_long, running, running_inside,
)
from ..sources.schema import ORDER

# Words in event types that open or end an aggregate's life.
OPENING_WORDS = ["created", "opened", "placed", "submitted"]
CLOSING_WORDS = ["deleted", "closed", "cancelled", "rejected"]
DELETED_STATUS = "DELETED"

# Fields that every event writes.
BOOKKEEPING = ["_version", "_lastEventType", "_lastUpdated"]

KEYS = ["aggregate_id", *ORDER]

BLOCK_TARGETS = 256  # targets of one aggregate that are looked through together
MOST_FIELDS = 64  # a log of so many fields is replayed with a column for each


def closes(event_type: Column) -> Column:
    """Whether an event type ends the life; opening words are tested first."""
    return F.coalesce(
        has_any_word(event_type, CLOSING_WORDS) & ~has_any_word(event_type, OPENING_WORDS), F.lit(False)
    )


def _system_values() -> dict[str, Column]:
    return {
        "_version": F.col("sequence_number").cast("string"),
        "_lastEventType": json_string("event_type"),
        "_lastUpdated": F.concat(F.lit('"'), instant_text(F.col("timestamp")), F.lit('"')),
        "status": F.when(closes(F.col("event_type")), json_string(F.lit(DELETED_STATUS))),
    }


def written_value(field: str, parsed: Column) -> Column:
    """Canonical JSON an event writes to one field, NULL when it leaves it alone.

    ``parsed`` is the event's payload as a VARIANT column.
    """
    from_payload = field_of(parsed, field)
    system = _system_values().get(field)
    return from_payload if system is None else F.coalesce(from_payload, system)


def parse_payload(events: DataFrame, column: str = "payload") -> DataFrame:
    """One row per top-level field of a JSON column; malformed text has none."""
    fields = F.map_entries(object_fields(column))
    exploded = events.select(*KEYS, F.explode(fields).alias("__entry"))
    return exploded.select(
        *KEYS,
        F.col("__entry.key").alias("key"),
        F.coalesce(F.to_json("__entry.value"), F.lit("null")).alias("value_json"),
    )


def event_writes(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every event with its field writes as an array (``__writes``); a narrow projection without a shuffle."""
    parsed = events.withColumn("__fields", object_fields("payload"))
    written = F.transform(
        F.map_entries("__fields"),
        lambda e: F.struct(
            e["key"].alias("key"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value_json")
        ),
    )
    system = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value_json")) for k, v in _system_values().items()]
    )
    standing = F.filter(
        system,
        lambda e: e["value_json"].isNotNull() & ~F.map_contains_key(F.col("__fields"), e["key"]),
    )
    return parsed.select(*KEYS, *keep, F.concat(standing, written).alias("__writes"))


def field_changes(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Every field write of every event; a narrow projection without a shuffle."""
    return event_writes(events, keep).select(*KEYS, *keep, F.inline("__writes"))


def packed_writes(events: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Writes as ``key, w``, for aggregations that keep whole writes.

    Every event writes the three bookkeeping fields, so they travel as one row
    per event (``is_book``) and ``unpacked`` takes them apart in the end.
    """
    parsed = events.withColumn("__fields", object_fields("payload"))
    book = F.array(
        *[
            F.coalesce(field_json(F.col("__fields"), name), _system_values()[name]).alias(name)
            for name in BOOKKEEPING
        ]
    )
    closed = closes(F.col("event_type")) & ~F.map_contains_key("__fields", F.lit("status"))
    # rows are numbered: -2 for the status of an end, -1 for the bookkeeping, then the fields;
    # what a row holds is taken out behind the generator, once per row and in generated code
    at = F.col("__at")
    numbered = parsed.select(
        *KEYS, *keep, F.map_entries("__fields").alias("__entries"), book.alias("__book"), closed.alias("__closed")
    ).select(
        *KEYS, *keep, "__entries", "__book",
        F.explode(F.sequence(F.when(F.col("__closed"), -2).otherwise(-1), F.size("__entries") - 1)).alias("__at"),
    )
    entry = F.get("__entries", at)
    rows = numbered.select(
        *KEYS, *keep, "__entries", "__book", "__at",
        F.when(at == -1, "").when(at == -2, "status").otherwise(entry["key"]).alias("key"),
    ).filter((at == -1) | ~F.col("key").isin(*BOOKKEEPING))
    value = (
        F.when(at == -2, json_string(F.lit(DELETED_STATUS)))
        .when(at >= 0, F.coalesce(F.to_json(entry["value"]), F.lit("null")))
    )
    w = F.struct(value.alias("value_json"), F.when(at == -1, F.col("__book")).alias("book"))
    return rows.select(*KEYS, *keep, "key", (at == -1).alias("is_book"), w.alias("w"))


def unpacked(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Turn packed write columns (name to new name) back into one row per field."""
    rest = [c for c in df.columns if c not in ("key", "is_book", *columns)]
    numbers = F.when(F.col("is_book"), F.sequence(F.lit(0), F.lit(len(BOOKKEEPING) - 1))).otherwise(F.array(F.lit(0)))
    apart = df.select("*", F.explode(numbers).alias("__at"))
    at, own = F.col("__at"), F.col("is_book")
    names = F.array(*[F.lit(n) for n in BOOKKEEPING])
    return apart.select(
        *rest,
        F.when(own, F.get(names, at)).otherwise(F.col("key")).alias("key"),
        *[F.when(own, F.get(F.col(f"{c}.book"), at)).otherwise(F.col(f"{c}.value_json")).alias(n) for c, n in columns.items()],
    )


def _differs(old: Column, new: Column) -> Column:
    null = F.lit("null")
    return F.coalesce(old, null) != F.coalesce(new, null)


def _kept_writes(events: DataFrame) -> DataFrame:
    """``packed_writes`` that leave the chunk in, where there is one."""
    return packed_writes(events, [c for c in events.columns if c == CHUNK])


def _stepped(events: DataFrame, assign: Assign) -> DataFrame:
    """Every write with the value it replaces (NULL for a new field)."""
    stepped = running_inside(
        assign(events.select(*KEYS, "event_type", "timestamp", "payload")),
        _kept_writes,
        ["aggregate_id"],
        ["key", "is_book"],
        ORDER,
        previous={"old_w": F.col("w")},
        cut=cuts(assign),
    )
    return unpacked(stepped, {"old_w": "old_json", "w": "value_json"})


@dataclass(frozen=True)
class Survey:
    """What a pass over a log tells: how it is cut, and all fields its events write (NULL if too many).

    ``crowded``: whether events without an aggregate, which are never cut, are as many as those of a long one.
    """

    assign: Assign
    fields: list[str] | None
    crowded: bool = False


def survey(events: DataFrame, width: int = DEFAULT_WIDTH) -> Survey:
    """One pass over ids and payloads, so that the replay itself can be planned as columns of events.

    It holds for every part of the log too.
    """
    # read by a pass over the text; a name that no document has in the end only makes an empty column
    names = F.json_object_keys("payload")
    shapes = (
        events.select(id_bucket().alias("__bucket"), names.alias("__names"))
        .groupBy("__bucket", "__names")
        .agg(F.count(F.lit(1)).alias("__size"))
    )
    sizes = shapes.groupBy("__bucket").agg(F.sum("__size").alias("__size"))
    # whatever filters the groups' keys would reach the scan of one side only: so that both read the same
    # shuffle, the sizes are kept, and NULLs go out behind the buckets and the names
    every = shapes.filter(F.col("__size") > 0).select(F.explode_outer("__names").alias("name")).distinct()
    fields = every.filter(F.col("name").isNotNull())
    nothing = F.lit(None).cast("long")
    found = (
        sizes.agg(
            F.max(F.when(F.col("__bucket").isNotNull(), F.col("__size"))).alias("most"),
            F.max(F.when(F.col("__bucket").isNull(), F.col("__size"))).alias("nameless"),
        )
        .select(F.lit(None).cast("string").alias("name"), "most", "nameless")
        .unionByName(fields.limit(MOST_FIELDS + 1).select("name", nothing.alias("most"), nothing.alias("nameless")))
        .collect()
    )
    written = {r.name for r in found if r.name is not None}
    most = max((r.most for r in found if r.most is not None), default=0)
    nameless = max((r.nameless for r in found if r.nameless is not None), default=0)
    assign = event_chunks(events, width, maybe_long(most, width))
    return Survey(
        assign,
        sorted(written | set(_system_values())) if len(written) <= MOST_FIELDS else None,
        maybe_long(nameless, width),
    )


def _by_aggregate(events: DataFrame, assign: Assign) -> DataFrame:
    """Events dealt by aggregate before they are parsed, where none is cut: only they move, once."""
    return events if cuts(assign) else events.repartition("aggregate_id")


def _write_columns(events: DataFrame, fields: Sequence[str], keep: Sequence[str], is_event: Column | None = None) -> DataFrame:
    """What each event writes to each field, as ``w_<number of the field>``."""
    system = _system_values()
    parts = object_parts("payload", fields)

    def written(i: int, name: str) -> Column:
        value = part_json("__parts", i, fields)
        value = F.coalesce(value, system[name]) if name in system else value
        value = F.coalesce(value, F.lit("")) if name in BOOKKEEPING else value
        return value if is_event is None else F.when(is_event, value)

    parsed = events.withColumn("__parts", parts)
    return parsed.select(*KEYS, *keep, *[written(i, name).alias(f"w_{i}") for i, name in enumerate(fields)])


def entries(fields: Sequence[str], holds: Callable[[Column], Column], **values: Callable[[int], Column]) -> Column:
    """Array of ``key`` and named values (by the field's number): the entries that ``holds`` accepts."""
    every = [
        F.struct(F.lit(name).alias("key"), *[v(i).alias(n) for n, v in values.items()]) for i, name in enumerate(fields)
    ]
    # told apart behind the array: a test per field in one row's code would be too large to be compiled
    kept = F.filter(F.array(*every), holds)
    return F.transform(kept, lambda e: F.struct(e["key"].alias("key"), *[plain(e[n]).alias(n) for n in values]))


def plain(value: Column) -> Column:
    """A written value; the empty text, which is no JSON, stands for bookkeeping written as NULL."""
    return F.nullif(value, F.lit(""))


def _column(prefix: str) -> Callable[[int], Column]:
    return lambda i: F.col(f"{prefix}_{i}")


def _changed_columns(events: DataFrame, plan: Survey, keep: Sequence[str] = (), numbered: bool = False) -> DataFrame:
    """Every event with its field changes as an array (``__diff``), and numbered by ``step`` if asked."""
    fields = plan.fields
    source = events.select(*dict.fromkeys([*KEYS, "event_type", "timestamp", "payload"]))
    stepped = running(
        _write_columns(_by_aggregate(source, plan.assign), fields, keep),
        ["aggregate_id"],
        ORDER,
        plan.assign,
        sums={"step": F.lit(1).cast("long")} if numbered else {},
        previous={f"p_{i}": F.col(f"w_{i}") for i in range(len(fields))},
        keep_chunks=True,
    )
    written, before = _column("w"), _column("p")
    diff = entries(
        fields,
        lambda e: e["new_json"].isNotNull() & _differs(plain(e["old_json"]), plain(e["new_json"])),
        old_json=before,
        new_json=written,
    )
    chunk = [c for c in stepped.columns if c == CHUNK]
    return stepped.select(*KEYS, *keep, *(["step"] if numbered else []), *chunk, diff.alias("__diff"))


def copies(rows: DataFrame) -> WindowSpec:
    """The rows of the same event (equal ``KEYS``); they lie side by side in the windows before."""
    line = Window.partitionBy("aggregate_id", *[c for c in rows.columns if c == CHUNK]).orderBy(*ORDER)
    return line.rangeBetween(Window.currentRow, Window.currentRow)


def first_copies(rows: DataFrame) -> DataFrame:
    """One row of each event."""
    line = Window.partitionBy("aggregate_id", *[c for c in rows.columns if c == CHUNK]).orderBy(*ORDER)
    first = F.row_number().over(line) == F.rank().over(line)
    return rows.withColumn("__first", first).filter("__first").drop("__first")


def event_changes(events: DataFrame, width: int = DEFAULT_WIDTH, keep: Sequence[str] = ()) -> DataFrame:
    """Every event, numbered (``step``), with the changes of all its copies (``diff``, may be empty).

    The changes are put together where the events already are; NULL ``diff`` stands
    for events with a NULL among their keys.
    """
    plan = survey(events, width)
    if plan.fields is None:
        numbered = running(
            events.select(*dict.fromkeys([*KEYS, *keep])), ["aggregate_id"], ORDER, plan.assign,
            sums={"step": F.lit(1).cast("long")},
        )
        return numbered.join(event_diffs(transitions(events, plan=plan)), KEYS, "left")
    rows = _changed_columns(events, plan, keep, numbered=True)
    merged = rows.withColumn("diff", F.flatten(F.collect_list("__diff").over(copies(rows))))
    known = ~F.greatest(*[F.col(c).isNull() for c in KEYS])
    return merged.select(*KEYS, *keep, "step", F.when(known, F.array_sort("diff")).alias("diff"))


def transitions(
    events: DataFrame, width: int = DEFAULT_WIDTH, plan: Survey | None = None, grouped: bool = False
) -> DataFrame:
    """Field diffs of a full replay: one row per (event, changed field).

    ``plan`` is the survey of a log that ``events`` is part of; without it one is
    made of ``events``, which costs a pass over whatever made them. A log of few
    fields (``MOST_FIELDS``) has a column for each, so that only events are moved and
    sorted; one with more goes by a row per write. ``grouped`` leaves the diffs of
    an event in one row, for ``event_diffs``.
    """
    plan = plan or survey(events, width)
    if plan.fields is None:
        stepped = _stepped(events, plan.assign)
        changed = stepped.filter(_differs(F.col("old_json"), F.col("value_json"))).select(
            *KEYS, "key", "old_json", F.col("value_json").alias("new_json")
        )
        return event_diffs(changed) if grouped else changed
    rows = _changed_columns(events, plan)
    if not grouped:
        return rows.select(*KEYS, F.inline("__diff"))
    merged = rows.withColumn("diff", F.flatten(F.collect_list("__diff").over(copies(rows))))
    return first_copies(merged).filter(F.size("diff") > 0).select(*KEYS, F.array_sort("diff").alias("diff"))


def event_diffs(changed: DataFrame) -> DataFrame:
    """Transitions regrouped per event: array of (key, old, new), sorted by key.

    ``transitions(grouped=True)`` come grouped: nothing is shuffled for them.
    """
    if "diff" in changed.columns:
        return changed.select(*KEYS, "diff")
    return changed.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("key", "old_json", "new_json"))).alias("diff")
    )


def states_at_events(
    events: DataFrame, marks: DataFrame, width: int = DEFAULT_WIDTH, plan: Survey | None = None
) -> DataFrame:
    """State after each marked event ``marks(aggregate_id, sequence_number, …order)``, long form.

    A mark is an event that writes nothing, placed right after its event, and picks
    up the last values: work is linear in the events plus the rows returned, whatever
    the number of marks per aggregate. In logs of many fields each mark becomes one
    empty write per field of its aggregate. ``plan`` is as in ``transitions``.
    """
    plan = plan or survey(events, width)
    if plan.fields is not None:
        asked = marks.filter(F.col("aggregate_id").isNotNull()).select(*KEYS).distinct()
        return states_beside(events, asked, plan).select(*KEYS, F.inline("__state"))
    writes = packed_writes(events)
    field = ["aggregate_id", "key", "is_book"]
    names = writes.select(*field).distinct()
    asked = marks.select(*KEYS).distinct().join(names, "aggregate_id")
    columns = [*KEYS, "key", "is_book"]
    nothing = F.lit(None).cast(writes.schema["w"].dataType)
    both = writes.select(*columns, "w", F.lit(0).alias("__mark")).unionByName(
        asked.select(*columns, nothing.alias("w"), F.lit(1).alias("__mark"))
    )
    filled = running(both, field, [*ORDER, "__mark"], plan.assign, latest={"last_w": F.col("w")})
    at_marks = filled.filter((F.col("__mark") == 1) & F.col("last_w").isNotNull()).select(*columns, "last_w")
    return unpacked(at_marks, {"last_w": "value_json"}).select(*KEYS, "key", "value_json")


def states_beside(events: DataFrame, marks: DataFrame, plan: Survey, keep: Sequence[str] = ()) -> DataFrame:
    """Every row of ``marks(…KEYS, …keep)``, copies too, with the state after its event as an array (``__state``).

    For logs of few fields. Marks and events are dealt together; aggregates without a
    mark are left out behind that, before anything of them is parsed.
    """
    names = ["event_type", "timestamp", "payload"]
    both = events.select(*KEYS, *names, F.lit(0).alias("__mark")).unionByName(
        marks.select(*KEYS, *keep, F.lit(1).alias("__mark")), allowMissingColumns=True
    )
    moved = _by_aggregate(both, plan.assign)
    if not cuts(plan.assign):
        # the frame of the order that comes next: one sort does for both
        line = Window.partitionBy("aggregate_id").orderBy(*ORDER, "__mark")
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        moved = moved.withColumn("__marked", F.max("__mark").over(whole)).filter("__marked = 1").drop("__marked")
    filled = running(
        _write_columns(moved, plan.fields, ["__mark", *keep], F.col("__mark") == 0),
        ["aggregate_id"],
        [*ORDER, "__mark"],
        plan.assign,
        latest={f"l_{i}": F.col(f"w_{i}") for i in range(len(plan.fields))},
    )
    state = entries(plan.fields, lambda e: e["value_json"].isNotNull(), value_json=_column("l"))
    return filled.filter("__mark = 1").select(*KEYS, *keep, state.alias("__state"))


def transition_states(events: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """State maps before and after every event, as JSON objects."""
    plan = survey(events, width)
    if plan.fields is None:
        return _joined_states(events, plan)
    numbers = range(len(plan.fields))
    source = events.filter(F.col("aggregate_id").isNotNull()).select(*KEYS, "event_type", "timestamp", "payload")
    rows = running(
        _write_columns(_by_aggregate(source, plan.assign), plan.fields, []),
        ["aggregate_id"],
        ORDER,
        plan.assign,
        sums={"step": F.lit(1).cast("long")},
        latest={f"l_{i}": F.col(f"w_{i}") for i in numbers},
        previous={f"p_{i}": F.col(f"w_{i}") for i in numbers},
        keep_chunks=True,
    )
    written, before, last = _column("w"), _column("p"), _column("l")
    known = ~F.greatest(*[F.col(c).isNull() for c in KEYS])
    made = rows.select(
        *KEYS, "step", *[c for c in rows.columns if c == CHUNK],
        entries(plan.fields, lambda e: e["value_json"].isNotNull(), value_json=last).alias("__after"),
        F.transform(
            entries(plan.fields, lambda e: known & e["written"].isNotNull(), written=written, value_json=before),
            lambda e: F.struct(e["key"].alias("key"), e["value_json"].alias("value_json")),
        ).alias("__replaced"),
    )
    # an event that was stored several times replaces a value with each copy
    per_event = first_copies(
        made.withColumn("__state", F.max_by("__after", "step").over(copies(made)))
        .withColumn("__written", F.flatten(F.collect_list("__replaced").over(copies(made))))
    )
    replaced = F.transform("__written", lambda e: e["key"])
    kept = F.filter("__state", lambda e: ~F.array_contains(replaced, e["key"]))
    state = F.map_from_entries("__state")
    again = F.transform(
        "__written", lambda e: F.struct(e["key"].alias("key"), F.try_element_at(state, e["key"]).alias("value_json"))
    )
    once = F.size(F.array_distinct(replaced)) == F.size(replaced)
    return per_event.select(
        *KEYS,
        object_text(
            F.filter(F.concat(kept, F.col("__written")), lambda e: e["value_json"].isNotNull())
        ).alias("state_before"),
        object_text(F.when(once, F.col("__state")).otherwise(F.concat(kept, again))).alias("state_after"),
    )


def _joined_states(events: DataFrame, plan: Survey) -> DataFrame:
    """``transition_states`` of a log of many fields: states joined with what each event replaces."""
    states = states_at_events(events, events, plan=plan)
    written = _stepped(events, plan.assign).select(*KEYS, "key", "old_json", F.lit(True).alias("__written"))
    joined = states.join(written, [*KEYS, "key"], "left")
    before = F.when(F.col("__written"), F.col("old_json")).otherwise(F.col("value_json"))
    return joined.groupBy(*KEYS).agg(
        object_text(
            F.collect_list(F.when(before.isNotNull(), F.struct("key", before.alias("value_json"))))
        ).alias("state_before"),
        object_text(F.collect_list(F.struct("key", "value_json"))).alias("state_after"),
    )


def state_at(events: DataFrame, targets: DataFrame) -> DataFrame:
    """State after the last event up to ``targets(aggregate_id, target)``, long form."""
    asked = targets.select("aggregate_id", F.col("target").alias("at_sequence"))
    return unpacked(swept_writes(events, asked, "at_sequence", "sequence_number"), {"w": "value_json"}).select(
        "aggregate_id", "at_sequence", "key", "value_json", "set_at"
    )


def state_as_of(events: DataFrame, targets: DataFrame) -> DataFrame:
    """State at a point in time, ``targets(aggregate_id, as_of)``, long form."""
    return unpacked(swept_writes(events, targets, "as_of", "timestamp"), {"w": "value_json"}).select(
        "aggregate_id", "as_of", "key", "value_json", "set_at"
    )


def swept_writes(
    events: DataFrame, targets: DataFrame, at: str, place: str, assign: Assign | None = None
) -> DataFrame:
    """Last write of every field up to each ``targets(aggregate_id, at)``, packed, with ``set_at``.

    The targets of an aggregate cut its history into intervals. Every event falls
    into one of them, is read and parsed once, and leaves its interval's last
    writes on the map side; only these are carried on from target to target. Work
    is linear in the events plus the rows returned; finding the interval costs one
    comparison per ``BLOCK_TARGETS`` targets of the aggregate and a look into one
    block. Events and targets without a place (NULL) take no part. Where no aggregate
    is long, ``dealt_writes`` moves events instead of their writes.
    """
    if not cuts(assign or event_chunks(events)):
        states = dealt_writes(events, targets, at, place)
        return states.select("aggregate_id", "key", "is_book", "w", "set_at", "__target.*")
    per = Window.partitionBy("aggregate_id")
    line = per.orderBy(at)
    numbered = (
        targets.select("aggregate_id", at)
        .filter(F.col(at).isNotNull())
        .distinct()
        .select(
            "aggregate_id", at, F.row_number().over(line).alias("__n"), F.lag(at).over(line).alias("__since"),
            F.count(F.lit(1)).over(per).cast("int").alias("__total"),
        )
    )
    blocks = numbered.groupBy(
        F.col("aggregate_id").alias("__id"), F.floor((F.col("__n") - 1) / BLOCK_TARGETS).alias("__block")
    ).agg(
        F.array_sort(F.collect_list(at)).alias("__ends"),  # at most BLOCK_TARGETS
        F.min("__n").alias("__first"),
        F.min_by("__since", "__n").alias("__since"),
        F.max(at).alias("__until"),
        F.max("__total").alias("__total"),
    )
    inside = (F.col(place) <= F.col("__until")) & (F.col("__since").isNull() | (F.col(place) > F.col("__since")))
    number = F.col("__first") + F.size(F.filter("__ends", lambda end: end < F.col(place)))
    reached = events.join(blocks, (F.col("aggregate_id") == F.col("__id")) & inside).select(
        *events.columns, number.alias("__n"), "__total"
    )
    field = ["aggregate_id", "key", "is_book"]
    last = packed_writes(reached, ["__n", "__total"]).groupBy(*field, "__n", "__total").agg(
        F.max(F.struct(*ORDER, "w")).alias("__last")
    )
    # at most one row per target of the aggregate is left in a field's window
    along = Window.partitionBy(*field).orderBy("__n")
    carried = last.select(
        *field,
        "__n",
        F.max("__last").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__last"),
        (F.coalesce(F.lead("__n").over(along), F.col("__total") + 1) - 1).alias("__upto"),
    )
    spread = carried.select(
        *field,
        F.col("__last.w").alias("w"),
        F.col("__last.sequence_number").alias("set_at"),
        F.explode(F.sequence("__n", "__upto")).alias("__n"),
    )
    return spread.join(numbered.select("aggregate_id", "__n", at), ["aggregate_id", "__n"]).drop("__n")


def dealt_writes(
    events: DataFrame, targets: DataFrame, at: str, place: str, keep: Sequence[str] = ()
) -> DataFrame:
    """``swept_writes`` of a log without long aggregates: a row per target, field and row of ``targets``.

    Events and targets are dealt by aggregate once; numbering, last writes and what is
    carried on are windows over the same deal, so no write is shuffled. ``__target``
    holds ``at`` and the ``keep`` columns of one row of the (distinct) targets.
    """
    asked = targets.select("aggregate_id", at, *keep).filter(F.col("aggregate_id").isNotNull() & F.col(at).isNotNull()).distinct()
    numbered = asked.withColumn("__n", F.dense_rank().over(Window.partitionBy("aggregate_id").orderBy(at)))
    blocks = numbered.groupBy("aggregate_id", F.floor((F.col("__n") - 1) / BLOCK_TARGETS).alias("__block")).agg(
        F.collect_list(F.struct("__n", F.struct(at, *keep).alias("__target"))).alias("__targets"),
        F.min("__n").alias("__from"),
        F.max("__n").alias("__to"),
    )
    blocks = blocks.withColumnRenamed("aggregate_id", "__id")
    # a target comes right after the events of its place
    names = list(dict.fromkeys([*KEYS, "event_type", "timestamp", "payload"]))
    ends = asked.select("aggregate_id", F.col(at).alias("__place")).distinct()
    both = (
        events.filter(F.col("aggregate_id").isNotNull() & F.col(place).isNotNull())
        .select(*names, F.col(place).alias("__place"), F.lit(0).alias("__end"))
        .unionByName(ends.withColumn("__end", F.lit(1)), allowMissingColumns=True)
        .repartition("aggregate_id")
    )
    passing = Window.partitionBy("aggregate_id").orderBy("__place", "__end")
    so_far = passing.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = passing.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = both.select(
        "*", F.sum("__end").over(so_far).alias("__passed"), F.sum("__end").over(whole).cast("int").alias("__total")
    )
    reached = placed.filter("__end = 0 AND __passed < __total").select(
        *names, (F.col("__passed") + 1).cast("int").alias("__n"), "__total"
    )
    field = ["key", "is_book"]
    line = Window.partitionBy("aggregate_id").orderBy(*field, "__n", *ORDER)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    follows = F.lead(F.struct(*field, "__n")).over(line)
    # fields lie one after the other: the largest of what came so far is one of this field
    last = (
        packed_writes(reached, ["__n", "__total"])
        .select("*", F.max(F.struct(*field, *ORDER, "w")).over(upto).alias("__last"), follows.alias("__next"))
        .filter(~F.col("__next").eqNullSafe(F.struct(*field, "__n")))
    )
    goes_on = F.col("__next").isNotNull() & (F.struct(*[F.col("__next").getField(c) for c in field]) == F.struct(*field))
    carried = last.select(
        "aggregate_id",
        *field,
        F.col("__last.w").alias("w"),
        F.col("__last.sequence_number").alias("set_at"),
        "__n",
        F.when(goes_on, F.col("__next.__n") - 1).otherwise(F.col("__total")).alias("__upto"),
    )
    here = (F.col("aggregate_id") == F.col("__id")) & (F.col("__n") <= F.col("__to")) & (F.col("__upto") >= F.col("__from"))
    mine = F.filter("__targets", lambda t: t["__n"].between(F.col("__n"), F.col("__upto")))
    return carried.join(blocks, here).select(
        "aggregate_id", *field, "w", "set_at", F.explode(F.transform(mine, lambda t: t["__target"])).alias("__target")
    )


def _last_writes(events: DataFrame, group: list[str]) -> DataFrame:
    # partial aggregation runs before the shuffle: a long history shrinks to its fields
    writes = packed_writes(events, [c for c in group if c != "aggregate_id"])
    last = writes.groupBy(*group, "key", "is_book").agg(
        F.max_by("w", F.struct(*ORDER)).alias("w"), F.max("sequence_number").alias("set_at")
    )
    return unpacked(last, {"w": "value_json"}).select(*group, "key", "value_json", "set_at")


def in_columns(plan: Survey) -> bool:
    """Whether final states come from a column per field: few fields, and no history too long for one task."""
    return plan.fields is not None and not cuts(plan.assign) and not plan.crowded


def final_columns(events: DataFrame, plan: Survey) -> DataFrame:
    """A row per aggregate: what was last written to each field and by which sequence (``l_``, ``s_<its number>``).

    For logs that are ``in_columns``. Only events move and are sorted, not their writes.
    """
    own = [i for i, name in enumerate(plan.fields) if name not in BOOKKEEPING]
    line = Window.partitionBy("aggregate_id").orderBy(*ORDER)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    system, sequence = _system_values(), F.col("sequence_number")
    rest = {name: value for name, value in system.items() if name not in BOOKKEEPING}
    # every event writes the bookkeeping: that of the last one stands, and its texts are made for that one only
    names = [*KEYS, "event_type", "timestamp"]
    source = events.select(*names, "payload").withColumn("__parts", object_parts("payload", plan.fields))
    written = source.select(
        *names,
        *[
            (F.coalesce(value, rest[name]) if name in rest else value).alias(f"w_{i}")
            for i, name in enumerate(plan.fields)
            for value in [part_json("__parts", i, plan.fields)]
        ],
    )
    passed = written.select(
        *names,
        *[F.col(f"w_{i}").alias(f"l_{i}") for i in range(len(plan.fields)) if i not in own],
        *[F.last(f"w_{i}", ignorenulls=True).over(upto).alias(f"l_{i}") for i in own],
        *[F.last(F.when(F.col(f"w_{i}").isNotNull(), sequence), ignorenulls=True).over(upto).alias(f"s_{i}") for i in own],
        F.lead(F.lit(True)).over(line).alias("__goes_on"),
    )
    last = passed.filter(F.col("__goes_on").isNull())
    return last.select(
        "aggregate_id",
        *[
            F.col(f"l_{i}") if i in own else F.coalesce(f"l_{i}", system[name], F.lit("")).alias(f"l_{i}")
            for i, name in enumerate(plan.fields)
        ],
        *[(F.col(f"s_{i}") if i in own else sequence).alias(f"s_{i}") for i in range(len(plan.fields))],
    )


def current_state(events: DataFrame, plan: Survey | None = None, grouped: bool = False) -> DataFrame:
    """Final value of every field, and the sequence that last wrote it.

    ``plan`` is as in ``transitions``. ``grouped`` leaves the values of an aggregate in one row
    (``state``, a member for each field of the plan), for ``field_diff``, where the log is
    ``in_columns`` and no names differ in case only.
    """
    plan = plan or survey(events)
    if not in_columns(plan):
        return _last_writes(events, ["aggregate_id"])
    # dealt before they are parsed: texts are shorter than columns
    last = final_columns(events.select(*KEYS, "event_type", "timestamp", "payload").repartition("aggregate_id"), plan)
    if grouped and not alike(plan.fields):
        values = [plain(F.col(f"l_{i}")).alias(name) for i, name in enumerate(plan.fields)]
        return last.select("aggregate_id", F.struct(*values).alias("state"))
    every = [
        F.struct(F.lit(name).alias("key"), F.col(f"l_{i}").alias("value_json"), F.col(f"s_{i}").alias("set_at"))
        for i, name in enumerate(plan.fields)
    ]
    state = last.select("aggregate_id", F.inline(F.filter(F.array(*every), lambda e: e["value_json"].isNotNull())))
    return state.select("aggregate_id", "key", plain(F.col("value_json")).alias("value_json"), "set_at")


def replay_heads(events: DataFrame) -> DataFrame:
    """Last sequence and number of events per aggregate."""
    return events.groupBy("aggregate_id").agg(
        F.max("sequence_number").alias("at_sequence"), F.count(F.lit(1)).alias("event_count")
    )


def state_map(state: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Long-form state as one JSON object per aggregate (or per ``by`` key).

    A row grows with the fields of the state, not with the history behind it.
    """
    by = by or ["aggregate_id"]
    return state.groupBy(*by).agg(object_text(F.collect_list(F.struct("key", "value_json"))).alias("state"))
