"""Conditions over state history: filter, first occurrence, bisect, anomaly rules."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import Condition, ConditionError, compile_condition
from ..functions.json_values import number, object_text, variant
from ..functions.text import SEVERITY_LABELS, instant_text, severity_label
from ..plans.running import DEFAULT_WIDTH, cuts, event_chunks, running
from ..plans.small import broadcast_rows
from ..sources.schema import ORDER
from .replay import (
    KEYS, Survey, state_map, states_at_events, states_beside, survey, transitions, written_value,
)
from .timeline import chosen_limit, recent_events

# The built-in rule and the listing limits.
SNAPSHOT_CODE = "SNAPSHOT_NEEDED"
SNAPSHOT_TEXT = "Aggregate has many events without snapshot (performance risk)"
SNAPSHOT_EVERY = 50
DEFAULT_SCAN, MAX_AGGREGATES = 100, 20
NO_EVENTS = "No events found"
NEVER = "Condition never becomes true in entire history"


def filter_states(states: DataFrame, condition: str | Condition) -> DataFrame:
    """Rows of a long-form state that are the condition's field and satisfy it."""
    condition = compile_condition(condition) if isinstance(condition, str) else condition
    return states.filter((F.col("key") == condition.field) & condition.holds(F.col("value_json")))


def narrow_writes(events: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Events without payload, but with what each writes to the named fields (``w_<field>``)."""
    fields = list(fields)
    # a member's name stands in the text as it is, or with an escape in it: other texts are not parsed
    may_hold = F.contains("payload", F.lit("\\"))
    for f in fields:
        may_hold = may_hold | F.contains("payload", F.lit(f))
    parsed = events.withColumn("__payload", F.when(may_hold, variant("payload")))
    return parsed.select(
        *KEYS, "event_type", "timestamp", *[written_value(f, F.col("__payload")).alias(f"w_{f}") for f in fields]
    )


def field_history(
    events: DataFrame, fields: Iterable[str], width: int = DEFAULT_WIDTH, numbered: bool = False, keep_chunks: bool = False
) -> DataFrame:
    """Every event with the value each named field has after it, as ``f_<field>``.

    ``numbered`` adds the event's index from 1 (``step``) and the aggregate's
    event count (``steps``). ``keep_chunks`` is as in ``running``.
    """
    fields = list(dict.fromkeys(fields))
    narrow = narrow_writes(events, fields)
    one = {"step": F.lit(1).cast("long")} if numbered else {}
    history = running(
        narrow,
        ["aggregate_id"],
        ORDER,
        event_chunks(events, width),
        sums=one,
        latest={f"f_{f}": F.col(f"w_{f}") for f in fields},
        totals={"steps": F.lit(1).cast("long")} if numbered else {},
        keep_chunks=keep_chunks,
    )
    return history.drop(*[f"w_{f}" for f in fields])


def condition_history(
    events: DataFrame, condition: str | Condition, width: int = DEFAULT_WIDTH, keep_chunks: bool = False
) -> DataFrame:
    """Every event, numbered, with whether the state after it satisfies the condition."""
    condition = compile_condition(condition) if isinstance(condition, str) else condition
    history = field_history(events, [condition.field], width, numbered=True, keep_chunks=keep_chunks)
    return history.withColumn("holds", condition.holds(F.col(f"f_{condition.field}"))).drop(f"f_{condition.field}")


def first_occurrence(events: DataFrame, condition: str | Condition, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Earliest event whose state satisfies the condition, per aggregate where there is one.

    ``is_monotone`` says whether it stays satisfied from there on.
    """
    history = condition_history(events, condition, width)
    found = history.groupBy("aggregate_id").agg(
        F.min_by(F.struct("step", *ORDER, "event_type", "timestamp"), F.when(F.col("holds"), F.col("step"))).alias("e"),
        F.max(F.when(~F.col("holds"), F.col("step"))).alias("last_false"),
    )
    return found.filter(F.col("e").isNotNull()).select(
        "aggregate_id",
        F.col("e.sequence_number").alias("sequence_number"),
        F.col("e.event_type").alias("event_type"),
        F.col("e.timestamp").alias("timestamp"),
        (F.coalesce("last_false", F.lit(0)) < F.col("e.step")).alias("is_monotone"),
    )


def _middle(low: Column, high: Column) -> Column:
    return F.floor((low + high) / 2).cast("long")


def _search_node(width: int) -> Column:
    """Where an index falls in the search tree over 0..steps-1.

    The range is halved until it holds at most ``width`` indexes; the result is
    the part's bounds, or the index itself as both bounds when it is a midpoint
    met on the way.
    """
    index = F.col("step") - 1
    start = F.struct(F.lit(0).cast("long").alias("low"), (F.col("steps") - 1).alias("high"))
    rounds = F.greatest(
        F.ceil(F.log2(F.col("steps") / F.lit(width))).cast("int"), F.lit(0)
    )

    def halve(bounds: Column, _: Column) -> Column:
        middle = _middle(bounds["low"], bounds["high"])
        wide = bounds["high"] - bounds["low"] + 1 > width
        return (
            F.when(~wide, bounds)
            .when(index < middle, F.struct(bounds["low"].alias("low"), (middle - 1).alias("high")))
            .when(index > middle, F.struct((middle + 1).alias("low"), bounds["high"].alias("high")))
            .otherwise(F.struct(middle.alias("low"), middle.alias("high")))
        )

    halved = F.aggregate(F.sequence(F.lit(0), rounds), start, halve)
    return F.when(F.col("steps") <= width, start).otherwise(halved)


FLAG = "struct<step:bigint,holds:boolean,sequence_number:bigint,global_position:bigint,event_id:string>"


def _probe(low: Column, high: Column, rounds: Column, flag_at: Callable[[Column], Column]) -> Column:
    """Binary search as a fold: narrow [low, high], remember the last hit, count probes."""

    def step(s: Column, _: Column) -> Column:
        middle = _middle(s["low"], s["high"])
        hit = F.coalesce(flag_at(middle)["holds"], F.lit(False))
        return F.when(s["low"] > s["high"], s).otherwise(
            F.struct(
                F.when(hit, s["low"]).otherwise(middle + 1).alias("low"),
                F.when(hit, middle - 1).otherwise(s["high"]).alias("high"),
                F.when(hit, flag_at(middle)).otherwise(s["found"]).alias("found"),
                (s["probes"] + 1).alias("probes"),
            )
        )

    start = F.struct(
        low.cast("long").alias("low"),
        high.cast("long").alias("high"),
        F.lit(None).cast(FLAG).alias("found"),
        F.lit(0).cast("long").alias("probes"),
    )
    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)


def _probes_without_hit(size: Column) -> Column:
    """How many probes a search through ``size`` events takes that never hits; no search takes more."""
    return F.floor(F.log2(size)).cast("int") + 1


def bisect(
    events: DataFrame,
    condition: str | Condition,
    asked: DataFrame | None = None,
    width: int = DEFAULT_WIDTH,
    part: int = DEFAULT_WIDTH,
) -> DataFrame:
    """The event that a binary search over the history names as the culprit, per aggregate.

    When the condition holds at the end, the probes of the search are followed
    exactly, so a condition that comes and goes gives the same event as probing
    would. ``asked(aggregate_id)`` adds aggregates without events to the result.

    The flags of a history are kept as runs: only the events at which the flag turns
    are held. A probe looks for the last turn at or before it. The search tree over
    a history is cut into parts of at most ``part`` events that are searched
    independently; the search above the parts then picks the one that counts. A
    search enters a part only behind a probe without a hit (or at the first event,
    which is always a turn), so a part begins unsatisfied unless it turns at once,
    one without turns has no hit, and what a search ends at is always a turn.
    """
    condition = compile_condition(condition) if isinstance(condition, str) else condition
    history = condition_history(events, condition, width, keep_chunks=True)
    # the same chunks again: no new shuffle of the rows
    turning = running(history, ["aggregate_id"], ORDER, None, previous={"before": F.col("holds")})
    placed = turning.withColumn("__node", _search_node(part)).select(
        "aggregate_id", *ORDER, "steps", "step", "holds", "__node.low", "__node.high", "before"
    )
    # besides the turns only the probes above the parts, one per part at most
    placed = placed.filter(~F.col("before").eqNullSafe(F.col("holds")) | (F.col("low") == F.col("high")))
    flags = placed.groupBy("aggregate_id", "steps", "low", "high").agg(
        F.array_sort(F.collect_list(F.struct("step", "holds", *ORDER))).alias("flags"),
        F.max_by("holds", "step").alias("last_holds"),
    )
    searched = flags.select(
        "aggregate_id",
        "steps",
        "low",
        "high",
        "last_holds",
        _probe(
            F.col("low"),
            F.col("high"),
            _probes_without_hit(F.col("high") - F.col("low") + 1) + 1,
            lambda i: F.try_element_at(F.filter("flags", lambda f: f["step"] <= i + 1), F.lit(-1)),
        ).alias("hit"),
    ).select("aggregate_id", "steps", "low", "high", "last_holds", "hit.found", "hit.probes")
    # above the parts: a map from a part's first index to its result
    parts = searched.groupBy("aggregate_id", "steps").agg(
        F.map_from_entries(
            F.collect_list(F.struct("low", F.struct("high", "found", "probes")))
        ).alias("parts"),
        F.max_by("last_holds", "high").alias("at_end"),
    )

    def descend(s: Column, _: Column) -> Column:
        middle = _middle(s["low"], s["high"])
        wide = s["high"] - s["low"] + 1 > part
        whole = F.try_element_at(F.col("parts"), s["low"])
        alone = F.try_element_at(F.col("parts"), middle)
        hit = alone["found"].isNotNull()
        inside = F.struct(
            (s["high"] + 1).alias("low"),
            s["high"].alias("high"),
            F.coalesce(whole["found"], s["found"]).alias("found"),
            (s["probes"] + F.coalesce(whole["probes"], _probes_without_hit(s["high"] - s["low"] + 1))).alias("probes"),
        )
        above = F.struct(
            F.when(hit, s["low"]).otherwise(middle + 1).alias("low"),
            F.when(hit, middle - 1).otherwise(s["high"]).alias("high"),
            F.coalesce(alone["found"], s["found"]).alias("found"),
            (s["probes"] + 1).alias("probes"),
        )
        return F.when(s["low"] > s["high"], s).when(wide, above).otherwise(inside)

    start = F.struct(
        F.lit(0).cast("long").alias("low"),
        (F.col("steps") - 1).alias("high"),
        F.lit(None).cast(FLAG).alias("found"),
        F.lit(0).cast("long").alias("probes"),
    )
    levels = F.greatest(F.ceil(F.log2(F.col("steps") / F.lit(part))).cast("int"), F.lit(0)) + 2
    outcome = parts.select(
        "aggregate_id",
        "at_end",
        F.aggregate(F.sequence(F.lit(1), levels), start, descend).alias("s"),
    ).select(
        "aggregate_id",
        "at_end",
        *[F.when(F.col("at_end"), F.col(f"s.found.{c}")).alias(c) for c in ORDER],
        F.when(F.col("at_end"), F.col("s.probes") + 1).otherwise(F.lit(1)).cast("long").alias("replays"),
    )
    culprits = events.select(*KEYS, "event_type", "timestamp")
    # one row per aggregate even if the culprit itself was stored several times
    found = outcome.join(culprits, KEYS, "left").dropDuplicates(["aggregate_id"])
    if asked is not None:
        found = asked.select("aggregate_id").distinct().join(found, "aggregate_id", "left")
    summary = (
        F.when(F.col("at_end").isNull(), NO_EVENTS)
        .when(~F.col("at_end"), NEVER)
        .otherwise(
            F.concat(
                F.lit("Event #"), F.col("sequence_number").cast("string"), F.lit(" ("), F.col("event_type"),
                F.lit(" at "), instant_text(F.col("timestamp")), F.lit(") first caused the condition"),
            )
        )
    )
    return found.select(
        "aggregate_id",
        *ORDER,
        "event_type",
        "timestamp",
        F.coalesce("replays", F.lit(0)).cast("long").alias("replays"),
        summary.alias("summary"),
    )


def bisect_transitions(events: DataFrame, found: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Field diffs of the culprit events of ``bisect``."""
    culprits = found.filter(F.col("sequence_number").isNotNull()).select(*KEYS)
    affected = events.join(culprits.select("aggregate_id"), "aggregate_id", "left_semi")
    # the survey of the whole log holds for a part of it; one of the part would repeat the search
    return transitions(affected, plan=survey(events, width)).join(culprits, KEYS, "left_semi")


@dataclass(frozen=True)
class Rule:
    """An anomaly rule: ``test`` gets a function from field name to its canonical JSON."""

    code: str
    description: str
    severity: str
    fields: tuple[str, ...]
    test: Callable[[Callable[[str], Column]], Column] = field(compare=False)


def _snapshot_due(value: Callable[[str], Column]) -> Column:
    version = number(value("_version")).cast("long")
    return (version > SNAPSHOT_EVERY) & (version % SNAPSHOT_EVERY == 0)


SNAPSHOT_RULE = Rule(SNAPSHOT_CODE, SNAPSHOT_TEXT, "MEDIUM", ("_version",), _snapshot_due)


def condition_rule(code: str, condition: str, severity: str = "MEDIUM", description: str | None = None) -> Rule:
    severity = severity.upper()
    if severity not in SEVERITY_LABELS:
        raise ConditionError(f"unknown severity {severity!r}")
    parsed = compile_condition(condition)
    return Rule(
        code,
        condition if description is None else description,
        severity,
        (parsed.field,),
        lambda value: parsed.holds(value(parsed.field)),
    )


def load_rules(configs: Iterable[Mapping[str, str]]) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules of a configuration, and (code, reason) for each one that is rejected."""
    rules, rejected = [], []
    for config in configs:
        try:
            rules.append(
                condition_rule(
                    config["code"],
                    config["condition"],
                    config.get("severity") or "MEDIUM",
                    config.get("description"),
                )
            )
        except (ConditionError, KeyError) as error:
            rejected.append((config.get("code", ""), str(error)))
    return rules, rejected


def scan_anomalies(events: DataFrame, rules: Iterable[Rule] = (), width: int = DEFAULT_WIDTH) -> DataFrame:
    """One row per event and rule that holds on the state after it.

    Only the fields that rules name are parsed; the built-in rule always runs.
    """
    rules = [SNAPSHOT_RULE, *rules]
    history = field_history(events, [f for r in rules for f in r.fields], width)
    return tag_anomalies(history, rules)


def tag_anomalies(history: DataFrame, rules: Iterable[Rule], untested: Sequence[str] = ()) -> DataFrame:
    """Rule hits over rows that carry the fields' values as ``f_<field>``.

    With ``untested`` these columns stay, and rows where the first of them holds
    come back too, without code, description and severity.
    """

    def value(name: str) -> Column:
        return F.col(f"f_{name}")

    reports = F.array(
        *[
            F.when(
                r.test(value),
                F.struct(
                    F.lit(r.code).alias("code"),
                    F.lit(r.description).alias("description"),
                    F.lit(r.severity).alias("severity"),
                ),
            )
            for r in rules
        ]
    )
    hits = F.array_compact(reports)
    if untested:
        nothing = F.struct(*[F.lit(None).cast("string").alias(c) for c in ("code", "description", "severity")])
        hits = F.when(F.col(untested[0]), F.array(nothing)).otherwise(hits)
    return history.select(*KEYS, "event_type", "timestamp", *untested, F.inline(hits))


def attach_states(events: DataFrame, anomalies: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Long-form state at each anomalous event, one row per field."""
    # as in bisect_transitions, the survey is of the whole log: the scan behind the anomalies is not repeated
    return _attached(events, anomalies, survey(events, width))


def _attached(events: DataFrame, anomalies: DataFrame, plan: Survey) -> DataFrame:
    marks = anomalies.select(*KEYS).distinct()
    if plan.fields is None or cuts(plan.assign):
        events = events.join(marks.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
    return states_at_events(events, marks, plan=plan)


def report_states(events: DataFrame, anomalies: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Anomaly rows with the whole state at the event as a JSON object (``state``).

    The rows themselves go through the replay of a log of few fields as its marks, so
    what made them runs once.
    """
    plan = survey(events, width)
    if plan.fields is None or cuts(plan.assign):
        return anomalies.join(state_map(_attached(events, anomalies, plan), KEYS), KEYS, "left")
    rest = [c for c in anomalies.columns if c not in KEYS]
    marks = anomalies.select(*KEYS, F.struct(F.lit(True).alias("__is"), *rest).alias("__row"))
    beside = states_beside(events, marks, plan, ["__row"])
    # an event with a NULL among its keys is no row's event
    known = ~F.greatest(*[F.col(c).isNull() for c in KEYS])
    return beside.select(
        *KEYS,
        *[F.col("__row").getField(c).alias(c) for c in rest],
        F.when(known & (F.size("__state") > 0), object_text(F.col("__state"))).alias("state"),
    )


def recent_aggregates(
    events: DataFrame,
    limit: int | None = None,
    max_aggregates: int = MAX_AGGREGATES,
    newest_first: bool = False,
    order_by: str = "global_position",
) -> DataFrame:
    """The aggregates a recent scan covers: the first to appear in the newest events."""
    recent = recent_events(
        events.select("aggregate_id", *ORDER, "timestamp"), chosen_limit(limit, DEFAULT_SCAN), order_by
    )
    seen = recent.groupBy("aggregate_id").agg(
        (F.max if newest_first else F.min)(F.struct(order_by, "global_position", "event_id")).alias("__at")
    )
    by = F.desc("__at") if newest_first else F.asc("__at")
    return seen.orderBy(by).limit(max_aggregates).select("aggregate_id")


def scan_recent(
    events: DataFrame,
    rules: Iterable[Rule] = (),
    limit: int | None = None,
    max_aggregates: int = MAX_AGGREGATES,
    newest_first: bool = False,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """``scan_anomalies`` over the whole history of recently active aggregates."""
    chosen = broadcast_rows(recent_aggregates(events, limit, max_aggregates, newest_first), max_aggregates)
    return scan_anomalies(events.join(chosen, "aggregate_id", "left_semi"), rules, width)


def severity_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("severity").agg(F.count(F.lit(1)).alias("anomalies")).select(
        "severity", severity_label(F.col("severity")).alias("label"), "anomalies"
    )
