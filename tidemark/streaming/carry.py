"""Replay and rules on a stream of events.

Events may arrive out of order. Each aggregate keeps the events that the watermark has
not passed, in pages of many (a state entry per page), and releases them in order of
sequence once it has: a page leaves the state when its last event has, pages of which
nothing is released are not written again. Order matters within a lane: a field of the
aggregate in a replay, the fields of the rules together in a field history. What stays
of a lane is its last value and the order of its last released event. An event that
comes after a later one of its lane was released, or that is there already, is marked
``late`` and changes nothing; events behind the watermark are not lost, they are
released or late.

A call of the state is a round trip to the JVM, and a cell of a row between the two costs
as much as many values: so events come as a line of text with all their writes, pages are
these lines, and entries go out as rows of arrays.

The state lives in Spark's RocksDB state store; ``session.configure`` selects it.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..operators.detect import SNAPSHOT_RULE, Rule, narrow_writes, tag_anomalies
from ..operators.replay import BOOKKEEPING, KEYS, event_writes
from ..session import stateful
from ..sources.schema import ORDER

EARLIEST = {"sequence_number": "bigint", "global_position": "bigint", "event_id": "string"}
PAGE = 500  # events in an entry of the state
FEW = 64  # lanes of an aggregate that are kept in one entry; further ones have their own
SHEET = 2_000  # entries in a row that is given out

Event = list[list]  # sequence, position, id, further columns and time; names, if any; values: all of them texts


def _place(event: Event) -> tuple:
    """The order of an event, which can be compared although parts of it may be missing."""
    sequence, position, event_id = event[0][: len(ORDER)]
    return (
        (True, int(sequence)) if sequence is not None else (False, 0),
        (True, int(position)) if position is not None else (False, 0),
        (True, event_id) if event_id is not None else (False, 0),
    )


def _ms(event: Event, behind: int) -> int:
    """Milliseconds; an event without a time waits for none."""
    us = event[0][-1]
    return behind - 1 if us is None else int(us) // 1000


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class _Sheet(Row):
    """A row of arrays of plain values: nothing in it needs to be converted."""

    def asDict(self, recursive: bool = False) -> dict:
        return dict(zip(self.__fields__, self))


class _Release(StatefulProcessor):
    """Gives out each event's values with those before them, in order.

    With ``named`` values come with their names, each of which is a lane; else all are one
    lane, and a value that is missing stands as it was.
    """

    def __init__(self, named: bool, columns: list[str]):
        self.named, self.columns = named, ["aggregate_id", *columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "page int", "events string")
        # what was last given out of a lane: [place, values]
        self.few = handle.getValueState("few", "lanes string")
        self.last = handle.getMapState("last", "lane string", "last string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        behind = timerValues.getCurrentWatermarkInMs()
        pages = self.pages()
        there = {_place(e): self.lanes(e) for page in pages.values() for e in page}
        number = max(pages, default=-1) + 1
        soonest, ready, late, fresh = None, [], [], []
        for row in rows:
            line = row[-1]
            event = json.loads(line)
            place = _place(event)
            if place in there:
                event, again = self.apart(event, there[place])
                late += again
                if event is None:
                    continue
                line = _text(event)
                there[place] = [*there[place], *self.lanes(event)]
            else:
                there[place] = self.lanes(event)
            ms = _ms(event, behind)
            if ms < behind:
                ready.append(event)
                continue
            soonest = ms if soonest is None else min(soonest, ms)
            fresh.append(line)
            if len(fresh) == PAGE:
                self.store(number, fresh)
                number, fresh = number + 1, []
        if ready:
            left = self.take(pages, behind, ready)
            soonest = left if soonest is None else soonest if left is None else min(soonest, left)
        if fresh:
            self.store(number, fresh)
        if soonest is not None:
            self.handle.registerTimer(soonest + 1)
        yield from self.sheets(key, late)
        yield from self.sheets(key, self.released(ready))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        ready: list[Event] = []
        soonest = self.take(self.pages(), timerValues.getCurrentWatermarkInMs(), ready)
        if not ready:
            return
        if soonest is not None:
            self.handle.registerTimer(soonest + 1)
        yield from self.sheets(key, self.released(ready))

    def pages(self) -> dict[int, list[Event]]:
        return {number[0]: json.loads(events[0]) for number, events in self.waiting.iterator()}

    def store(self, number: int, lines: list[str]) -> None:
        self.waiting.updateValue((number,), (f"[{','.join(lines)}]",))

    def lanes(self, event: Event) -> list[str]:
        return event[1] if self.named else [""]

    def apart(self, event: Event, there: list[str]) -> tuple[Event | None, list[list]]:
        """What an event adds whose place is there already, in other lanes; and the entries that are late."""
        if not self.named:
            return None, [self.told(event, None, event[-1], [None] * len(event[-1]), True)]
        head, *pairs = event[0], *zip(*event[1:])
        again = [self.told(event, name, [value], [None], True) for name, value in pairs if name in there]
        others = [p for p in pairs if p[0] not in there]
        return [head, *map(list, zip(*others))] if others else None, again

    def take(self, pages: dict[int, list[Event]], behind: int, ready: list[Event]) -> int | None:
        """Move the events that the watermark has passed from the state to ``ready``; the time of the next one left."""
        soonest = None
        for number, events in pages.items():
            left = []
            for event in events:
                ms = _ms(event, behind)
                if ms < behind:
                    ready.append(event)
                    continue
                left.append(event)
                soonest = ms if soonest is None else min(soonest, ms)
            if not left:
                self.waiting.removeKey((number,))
            elif len(left) < len(events):
                self.store(number, map(_text, left))
        return soonest

    def released(self, ready: list[Event]) -> Iterator[list]:
        if not ready:
            return
        stored = self.few.get()
        few = json.loads(stored[0]) if stored is not None else {}
        known: dict[str, list] = {}  # of the lanes that are met: [place, values]

        def last_of(lane: str, width: int) -> list:
            last = few.get(lane)
            if last is None and len(few) >= FEW:
                own = self.last.getValue((lane,))
                last = json.loads(own[0]) if own is not None else None
            return [None, [None] * width] if last is None else [_place(last), last[1]]

        for place, event in sorted(((_place(e), e) for e in ready), key=lambda r: r[0]):
            for lane, given in zip(event[1], event[2]) if self.named else (("", event[-1]),):
                values = [given] if self.named else given
                last = known.get(lane)
                if last is None:
                    last = known[lane] = last_of(lane, len(values))
                applied, before = last
                late = applied is not None and place <= applied
                yield self.told(event, lane, values, before, late)
                if not late:
                    last[0] = place
                    last[1] = [old if new is None else new for new, old in zip(values, before)]
        for lane, (applied, values) in known.items():
            kept = [[str(x) if there else None for there, x in applied], values]
            # none that is there leaves, so a lane beyond them is found in its own entry only
            if lane in few or len(few) < FEW:
                few[lane] = kept
            else:
                self.last.updateValue((lane,), (_text(kept),))
        self.few.update((_text(few),))

    def told(self, event: Event, lane: str | None, values: list, last: list, late: bool) -> list:
        sequence, position, event_id, *extra, us = event[0]
        order = [None if sequence is None else int(sequence), None if position is None else int(position), event_id]
        return [*order, *extra, lane if self.named else None if us is None else int(us), *values, *last, late]

    def sheets(self, key, entries: Iterable[list]) -> Iterator[Row]:
        """Entries as rows of arrays, an array per column."""
        held: list[list] = []

        def sheet() -> Row:
            row = _Sheet(*key, *map(list, zip(*held)))
            row.__fields__ = self.columns
            return row

        for entry in entries:
            held.append(entry)
            if len(held) == SHEET:
                yield sheet()
                held = []
        if held:
            yield sheet()


def _carried(stream: DataFrame, extra: Sequence[str], names: Sequence[str], named: bool, delay: str | None) -> DataFrame:
    """Each entry with, per name, the last value before it (``last_<name>``).

    ``stream`` has the ``__values`` of events, and their ``__names`` if ``named``; columns in ``extra`` are texts.
    """
    # the watermark moves with the timestamps, but the column itself stays behind:
    # Spark would drop rows that are older than the watermark before they are seen
    timed = stream.withWatermark("timestamp", delay) if delay is not None else stream
    head = F.array(*[F.col(c).cast("string") for c in [*ORDER, *extra]], F.unix_micros("timestamp").cast("string"))
    lists = ["__names", "__values"] if named else ["__values"]
    lines = timed.select("aggregate_id", F.to_json(F.array(head, *lists)).alias("__event"))
    kinds = dict(EARLIEST) | {c: "string" for c in extra} | ({"key": "string"} if named else {"__us": "bigint"})
    kinds |= {c: "string" for c in [*names, *[f"last_{n}" for n in names]]} | {"late": "boolean"}
    schema = "aggregate_id string, " + ", ".join(f"`{c}` array<{kind}>" for c, kind in kinds.items())
    step = _Release(named, list(kinds))
    sheets = stateful(lines).groupBy("aggregate_id").transformWithState(step, schema, "append", "EventTime")
    return sheets.select("aggregate_id", F.inline(F.arrays_zip(*kinds)))


def stream_replay(events: DataFrame, delay: str | None = "10 minutes") -> DataFrame:
    """Field diffs as events arrive, equal to ``transitions`` on the events so far.

    Keyed by aggregate, with a lane for each field, the smallest unit whose order
    matters. A stream that has a watermark already, such as one of
    ``drop_resent_stream``, is given with ``delay`` None.
    """
    # dealt before they are parsed: a file may be read by few tasks, and texts are shorter than their writes
    written = event_writes(events.repartition(*KEYS), keep=["timestamp"])
    lists = {"__names": F.col("__writes.key"), "__values": F.col("__writes.value_json")}
    stepped = _carried(written.withColumns(lists), [], ["value_json"], True, delay)
    null = F.lit("null")
    changed = F.coalesce("last_value_json", null) != F.coalesce("value_json", null)
    return stepped.filter(changed | F.col("late")).select(
        *KEYS, "key", F.col("last_value_json").alias("old_json"), F.col("value_json").alias("new_json"), "late"
    )


def stream_field_history(
    events: DataFrame, units: Iterable[Sequence[str]], delay: str = "10 minutes"
) -> DataFrame:
    """Events with the values of named fields after them, as they arrive.

    ``units`` are groups of fields that are asked for together. Each event gives a
    row per unit (``unit``, its number) in which the fields of the other units are
    NULL; order matters within an aggregate only, so that is the key.
    Rows marked ``late`` have no values.
    """
    units = [list(dict.fromkeys(u)) for u in units]
    fields = list(dict.fromkeys(f for u in units for f in u))
    names = [f"w_{f}" for f in fields]
    narrow = narrow_writes(events, fields).withColumn("__values", F.array(*names))
    carried = _carried(narrow, ["event_type"], names, False, delay)
    value = {f: F.when(~F.col("late"), F.coalesce(f"w_{f}", f"last_w_{f}")) for f in fields}
    own = [
        F.struct(F.lit(n).alias("unit"), *[(value[f] if f in u else F.lit(None).cast("string")).alias(f"f_{f}") for f in fields])
        for n, u in enumerate(units)
    ]
    apart = carried.select(*KEYS, "event_type", F.timestamp_micros("__us").alias("timestamp"), "late", F.inline(F.array(*own)))
    return apart.select(*KEYS, "event_type", "timestamp", "unit", "late", *[f"f_{f}" for f in fields])


def stream_anomalies(events: DataFrame, rules: Iterable[Rule] = (), delay: str = "10 minutes") -> DataFrame:
    """``scan_anomalies`` on a stream, and the events that came too late for it.

    An event goes through the state once, with the fields of all rules. Fields that every event
    writes need no order: rules on these alone are tested as events arrive. A row
    marked ``late`` is an event whose rules on ``fields`` were not tested any more
    (its code, description and severity are NULL). ``write_apart`` parts the two.
    """
    rules = [SNAPSHOT_RULE, *rules]
    fields = {r.fields: sorted(set(r.fields)) for r in rules}
    units = [list(u) for u in dict.fromkeys(tuple(f) for f in fields.values() if not set(f) <= set(BOOKKEEPING))]
    direct = [r for r in rules if set(r.fields) <= set(BOOKKEEPING)]
    none = F.lit(None).cast("string")
    columns = [*KEYS, "event_type", "timestamp", "code", "description", "severity", "late", "fields"]
    parts = []
    if direct:
        named = sorted({f for r in direct for f in r.fields})
        now = narrow_writes(events, named).withColumnsRenamed({f"w_{f}": f"f_{f}" for f in named})
        parts.append(tag_anomalies(now, direct).withColumns({"late": F.lit(False), "fields": none}))
    if units:
        history = stream_field_history(events, units, delay)
        read = F.array(*[F.lit(", ".join(u)) for u in units])
        tests = [F.when(F.lit(n) == F.col("unit"), F.lit(True)) for n in range(len(units))]
        standing = [
            Rule(
                r.code, r.description, r.severity, r.fields,
                lambda value, r=r: r.test(value) & F.coalesce(tests[units.index(fields[r.fields])] & ~F.col("late"), F.lit(False)),
            )
            for r in rules
            if r not in direct
        ]
        found = tag_anomalies(history, standing, ["late", "unit"])
        parts.append(found.withColumn("fields", F.when(F.col("late"), F.get(read, F.col("unit")))))
    out = parts[0]
    for more in parts[1:]:
        out = out.select(columns).unionByName(more.select(columns))
    return out.select(columns)


def write_apart(stream: DataFrame, folder: str, available_now: bool = True):
    """Write rows to ``folder``/rows and late ones to ``folder``/late, a sub-folder per micro-batch.

    A repeated micro-batch overwrites its own sub-folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("NOT late").write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        batch.filter("late").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        batch.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
