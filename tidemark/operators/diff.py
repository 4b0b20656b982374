"""Differences between states and between JSON documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_values import FIELD_MAP
from ..plans.running import cuts, event_chunks
from .replay import (
    current_state, dealt_writes, entries, final_columns, in_columns, plain, survey, swept_writes, unpacked,
)

FEW_BRACKETS = 4  # a level more than needed costs less than counting the levels of every text


def _changed(old: Column, new: Column) -> Column:
    null = F.lit("null")
    return F.coalesce(old, null) != F.coalesce(new, null)


def field_diff(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Changed, added and removed fields between two long-form states keyed by ``by`` and ``key``.

    Missing and null count as the same. States that come ``grouped``, a row with all fields
    (``state``) per ``by``, are compared inside the row: no field is shuffled.
    """
    if "state" in before.columns and "state" in after.columns:
        return _grouped_diff(before, after, by)
    old = before.select(*by, "key", F.col("value_json").alias("old_json"))
    new = after.select(*by, "key", F.col("value_json").alias("new_json"))
    return old.join(new, [*by, "key"], "full_outer").filter(_changed(F.col("old_json"), F.col("new_json")))


def _grouped_diff(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    old, new = (df.select(*by, F.col("state").alias(f"__{side}")) for side, df in (("old", before), ("new", after)))
    held = {side: df.schema[f"__{side}"].dataType.names for side, df in (("old", old), ("new", new))}
    names = list(dict.fromkeys([*held["old"], *held["new"]]))

    def value(side: str):
        return lambda i: F.col(f"__{side}")[names[i]] if names[i] in held[side] else F.lit(None).cast("string")

    changed = entries(
        names, lambda e: _changed(e["old_json"], e["new_json"]), old_json=value("old"), new_json=value("new")
    )
    return old.join(new, by, "full_outer").select(*by, F.inline(changed))


def diff_aggregates(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Final state of ``left_id`` against ``right_id`` for each row of ``pairs(left_id, right_id)``.

    An id without events has an empty state. In a log that is ``in_columns`` a state is one
    row, also where pairs meet; else fields are rows.
    """
    plan = survey(events)
    asked = pairs.select("left_id", "right_id").distinct()
    sides = asked.select(
        "left_id",
        "right_id",
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("is_left"), F.col("left_id").alias("aggregate_id")),
                F.struct(F.lit(False).alias("is_left"), F.col("right_id").alias("aggregate_id")),
            )
        ),
    )
    reached = events.join(sides.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
    if in_columns(plan):
        return _paired_columns(sides.join(final_columns(reached, plan), "aggregate_id"), plan.fields)
    state = current_state(reached, plan)
    fields = sides.join(state, "aggregate_id").groupBy("left_id", "right_id", "key").agg(
        F.max(F.when(F.col("is_left"), F.col("value_json"))).alias("old_json"),
        F.max(F.when(~F.col("is_left"), F.col("value_json"))).alias("new_json"),
    )
    return fields.filter(_changed(F.col("old_json"), F.col("new_json")))


def _paired_columns(sides: DataFrame, fields: list[str]) -> DataFrame:
    """Changed fields of each pair, of rows that hold one side's values as ``l_<number of the field>``."""
    values = F.struct(*[F.col(f"l_{i}") for i in range(len(fields))])
    by = ["left_id", "right_id"]
    # dealt first: a pair has two rows, so that sums on the map side would sort all for nothing
    paired = (
        sides.select(*by, "is_left", values.alias("state"))
        .repartition(*by)
        .groupBy(*by)
        .agg(F.max(F.when(F.col("is_left"), F.col("state"))).alias("old"), F.max(F.when(~F.col("is_left"), F.col("state"))).alias("new"))
    )
    changed = entries(
        fields,
        lambda e: _changed(plain(e["old_json"]), plain(e["new_json"])),
        old_json=lambda i: F.col(f"old.l_{i}"),
        new_json=lambda i: F.col(f"new.l_{i}"),
    )
    return paired.select(*by, F.inline(changed))


def diff_at_sequences(events: DataFrame, requests: DataFrame) -> DataFrame:
    """State at ``from_sequence`` against ``to_sequence``, both inclusive, per request.

    Both ends of all requests are targets of one sweep over the events.
    """
    by = ["aggregate_id", "from_sequence", "to_sequence"]
    asked = requests.select(*by).distinct()
    sides = asked.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.lit(True).alias("is_from"), F.col("from_sequence").cast("long").alias("at")),
                F.struct(F.lit(False).alias("is_from"), F.col("to_sequence").cast("long").alias("at")),
            )
        ),
    )
    assign = event_chunks(events)
    if cuts(assign):
        states = swept_writes(events, sides, "at", "sequence_number", assign)
        packed = sides.join(states, ["aggregate_id", "at"]).groupBy(*by, "key", "is_book").agg(
            F.max(F.when(F.col("is_from"), F.col("w"))).alias("w_old"),
            F.max(F.when(~F.col("is_from"), F.col("w"))).alias("w_new"),
        )
    else:
        packed = _paired(dealt_writes(events, sides, "at", "sequence_number", [*by[1:], "is_from"]), by)
    sides_apart = unpacked(packed, {"w_old": "old_json", "w_new": "new_json"})
    return sides_apart.filter(_changed(F.col("old_json"), F.col("new_json")))


def _paired(states: DataFrame, by: list[str]) -> DataFrame:
    """Both ends of a request in a row, where they differ; they lie with their aggregate already."""
    apart = states.select("aggregate_id", "__target.*", "key", "is_book", "w")
    field = [*by, "key", "is_book"]
    line = Window.partitionBy("aggregate_id").orderBy(*field[1:], "is_from")
    own = F.struct(*field)
    sides = apart.select(
        *field,
        "is_from",
        "w",
        F.lag(own).over(line).eqNullSafe(own).alias("__second"),
        F.lead(own).over(line).eqNullSafe(own).alias("__first"),
        F.lead("w").over(line).alias("__w_from"),
    )
    # the end at to_sequence comes first, then the one at from_sequence
    paired = sides.filter(~F.col("__second")).select(
        *field,
        F.when(F.col("is_from"), F.col("w")).when(F.col("__first"), F.col("__w_from")).alias("w_old"),
        F.when(~F.col("is_from"), F.col("w")).alias("w_new"),
    )
    return paired.filter(~F.col("w_old").eqNullSafe(F.col("w_new")))


def nesting(text: Column) -> Column:
    """How many levels of objects and arrays a JSON text has; 0 for what is no JSON."""
    unescaped = F.regexp_replace(text, r"\\.", "")
    brackets = F.regexp_replace(F.regexp_replace(unescaped, r'"[^"]*+"', ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, sign: Column) -> Column:
        now = s["now"] + F.when(sign.isin("{", "["), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    signs = F.filter(F.split(brackets, ""), lambda c: c != "")
    return F.when(F.try_parse_json(text).isNotNull(), F.aggregate(signs, start, step)["most"]).otherwise(F.lit(0))


def _brackets(text: Column) -> Column:
    """How many brackets a text opens: no fewer than its levels, and 0 where there is no text."""
    others = F.replace(F.replace(text, F.lit("{"), F.lit("")), F.lit("["), F.lit(""))
    return F.coalesce(F.char_length(text) - F.char_length(others), F.lit(0))


def deep_diff(documents: DataFrame, left: str, right: str, keep: list[str], depth: int | None = None) -> DataFrame:
    """Patches ``path, kind, old_json, new_json`` that turn one JSON document into the other.

    Objects are compared by key and arrays by index, level by level inside the
    row: each level is one explode, so there is no shuffle. There are as many
    levels as the documents need: without ``depth``, a bound that the caller knows,
    one pass over the texts asks for the deepest pair first. A pair with more levels
    than ``depth`` is an error.
    """
    if depth is None:
        # nothing below the shallower of the two can be compared; texts of few brackets are not looked into
        brackets = F.least(_brackets(F.col(left)), _brackets(F.col(right)))
        levels = F.when(brackets <= FEW_BRACKETS, brackets).otherwise(
            F.least(nesting(F.col(left)), nesting(F.col(right)))
        )
        depth = documents.agg(F.max(levels).alias("most")).first().most or 0

    def node(path: Column, old: Column, new: Column) -> Column:
        return F.struct(path.alias("path"), old.alias("old"), new.alias("new"))

    def shape(value: Column) -> Column:
        head = F.substring(F.to_json(value), 1, 1)
        return F.when(head.isin("{", "["), head)

    old, new, path = F.col("__node.old"), F.col("__node.new"), F.col("__node.path")
    old_text, new_text = F.to_json(old), F.to_json(new)
    differs = _changed(old_text, new_text)
    old_map, new_map, old_list, new_list = (F.col(f"__{s}_{k}") for k in ("map", "list") for s in ("old", "new"))
    members = F.transform(
        F.array_union(F.map_keys(old_map), F.map_keys(new_map)),
        lambda k: node(
            F.concat(path, F.lit("."), k), F.try_element_at(old_map, k), F.try_element_at(new_map, k)
        ),
    )
    longest = F.greatest(F.size(old_list), F.size(new_list))
    items = F.transform(
        F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: node(
            F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), F.get(old_list, i), F.get(new_list, i)
        ),
    )
    nodes = documents.select(
        *keep, node(F.lit("$"), F.try_parse_json(left), F.try_parse_json(right)).alias("__node")
    )
    for _ in range(depth):
        # taken apart in a step of its own: members and items look into the parts many times
        nodes = nodes.select(
            *keep,
            "__node",
            F.try_variant_get(old, "$", FIELD_MAP).alias("__old_map"),
            F.try_variant_get(new, "$", FIELD_MAP).alias("__new_map"),
            F.try_variant_get(old, "$", "array<variant>").alias("__old_list"),
            F.try_variant_get(new, "$", "array<variant>").alias("__new_list"),
        )
        nodes = nodes.select(
            *keep,
            F.explode(
                F.when(old_map.isNotNull() & new_map.isNotNull(), members)
                .when(old_list.isNotNull() & new_list.isNotNull(), items)
                .otherwise(F.array("__node"))
            ).alias("__node"),
        ).filter(differs)
    too_deep = shape(old) == shape(new)
    gone = lambda t: t.isNull() | (t == "null")
    kind = (
        F.when(too_deep, F.raise_error(F.lit("documents are nested deeper than depth")).cast("string"))
        .when(gone(old_text), "added")
        .when(gone(new_text), "removed")
        .otherwise("changed")
    )
    # every level has left out what is equal
    standing = nodes if depth else nodes.filter(differs)
    return standing.select(
        *keep,
        F.col("__node.path").alias("path"),
        kind.alias("kind"),
        F.when(~gone(old_text), old_text).alias("old_json"),
        F.when(~gone(new_text), new_text).alias("new_json"),
    )


def diff_rows(changes: DataFrame, by: list[str]) -> DataFrame:
    """Display rows: patches keep their kind, field diffs all count as changed.

    Field diffs may come grouped, an array (``diff``) per event, as of ``transitions(grouped=True)``.
    """
    if "diff" in changes.columns:
        changes = changes.select(*by, F.inline("diff"))
    patch = "path" in changes.columns
    return changes.select(
        *by,
        F.col("path" if patch else "key").alias("field"),
        (F.col("kind") if patch else F.lit("changed")).alias("kind"),
        "old_json",
        "new_json",
    )


def diff_counts(changes: DataFrame, by: list[str], beside: bool = False, dealt: list[str] | None = None) -> DataFrame:
    """How many patches or field diffs there are per ``by``; field diffs may come grouped.

    ``beside`` leaves every row of ``changes`` whose ``by`` has no NULL and puts its count
    (``changes``) beside it: what a join with the counts would give, without moving the rows
    to one. ``dealt`` are the first columns of ``by``, where rows lie by these already and none of
    their groups is too long for a task.
    """
    size = F.size("diff") if "diff" in changes.columns else F.lit(1)
    if not beside:
        return changes.groupBy(*by).agg(F.sum(size.cast("long")).alias("changes"))
    known = changes.dropna("any", subset=by)
    if dealt:
        # rows with the same rest of ``by`` lie side by side in the order that they have within a group
        line = Window.partitionBy(*dealt).orderBy(*by[len(dealt) :])
        window = line.rangeBetween(Window.currentRow, Window.currentRow)
    else:
        window = Window.partitionBy(*by)
    return known.withColumn("changes", F.sum(size.cast("long")).over(window))


def changed_keys(changes: DataFrame, by: list[str]) -> DataFrame:
    """Top-level keys touched by patches or field diffs, one row each."""
    if "path" in changes.columns:
        key = F.split_part(F.regexp_replace("path", r"^\$\.", ""), F.lit("."), F.lit(1))
    else:
        key = F.col("key")
    return changes.select(*by, key.alias("key")).distinct()
