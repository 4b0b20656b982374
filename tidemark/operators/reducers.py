"""Replay with custom reducers per aggregate type.

Best first: a ``ColumnReducer`` states each field as a running aggregate and
runs on the same chunked plan as everything else. A ``MergeableFold`` is Python
that folds the chunks of a history side by side. A plain Python fold, or a
function over the whole ordered history, has to see the events of an aggregate
one after the other: they stream through one task with the memory of one state,
so long histories want one of the first two.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_values import object_fields
from ..plans.running import CHUNK, CHUNK_FIELDS, DEFAULT_WIDTH, event_chunks, running
from ..sources.schema import ORDER
from .replay import KEYS, transitions

CARRIED = ["aggregate_id", "aggregate_type", *ORDER, "event_type", "payload", "timestamp"]


@dataclass(frozen=True)
class ColumnReducer:
    """Fields as running sums (``sums``) or last written values (``latest``) over event columns."""

    sums: Mapping[str, Column]
    latest: Mapping[str, Column] | None = None


FoldReducer = Callable[[dict, dict], dict]


@dataclass(frozen=True)
class MergeableFold:
    """A fold whose results over adjacent stretches can be merged.

    ``merge(earlier, later)`` must give what folding both stretches in a row
    would. Long histories are then folded chunk by chunk in parallel.
    """

    fold: FoldReducer
    merge: Callable[[dict, dict], dict]


class ReducerError(RuntimeError):
    """A reducer failed; the message names sequence, type and aggregate."""


def with_first_type(events: DataFrame) -> DataFrame:
    """Add ``first_type``: the type of the aggregate's first event, which picks the reducer."""
    first = events.groupBy("aggregate_id").agg(F.min_by("aggregate_type", F.struct(*ORDER)).alias("first_type"))
    return events.join(first, "aggregate_id")


def replay_columns(events: DataFrame, reducer: ColumnReducer, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Every event with the reducer's fields after it."""
    return running(
        events,
        ["aggregate_id"],
        ORDER,
        event_chunks(events, width),
        sums={n: F.coalesce(v, F.lit(0)) for n, v in reducer.sums.items()},
        latest=dict(reducer.latest or {}),
    ).select(*KEYS, "event_type", *reducer.sums, *(reducer.latest or {}))


def reduce_columns(events: DataFrame, reducer: ColumnReducer) -> DataFrame:
    """Final fields only; folds on the map side."""
    return events.groupBy("aggregate_id").agg(
        *[F.sum(F.coalesce(v, F.lit(0))).alias(n) for n, v in reducer.sums.items()],
        *[
            F.max_by(v, F.when(v.isNotNull(), F.struct(*ORDER))).alias(n)
            for n, v in (reducer.latest or {}).items()
        ],
    )


def _parsed(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in batches:
        names = list(batch.columns)
        for values in zip(*[batch[name].tolist() for name in names]):
            yield dict(zip(names, values))


def _sorted(events: DataFrame, group: list[str]) -> DataFrame:
    return (
        events.select(*CARRIED, *[c for c in group if c not in CARRIED])
        .repartition(*group)
        .sortWithinPartitions(*group, *ORDER)
    )


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def replay_fold(events: DataFrame, fold: FoldReducer, batch: int = 5_000) -> DataFrame:
    """State after every event by a Python fold ``fold(state, event) -> state``.

    Events arrive sorted, one aggregate after the other; a task holds one state
    and one batch, never a whole history.
    """
    return _fold_groups(events, ["aggregate_id"], fold, batch)


def _fold_groups(events: DataFrame, group: list[str], fold: FoldReducer, batch: int) -> DataFrame:
    columns = [*KEYS, *[c for c in group if c not in KEYS], "event_type"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, current, state = [], None, {}
        for row in _rows(batches):
            if [row[c] for c in group] != current:
                current, state = [row[c] for c in group], {}
            try:
                state = fold(dict(state), {**row, "payload": _parsed(row["payload"])})
            except Exception as error:
                raise ReducerError(
                    f"reducer failed at sequence {row['sequence_number']} ({row['event_type']}) "
                    f"of aggregate '{row['aggregate_id']}'"
                ) from error
            out.append([row[c] for c in columns] + [_dump(state)])
            if len(out) >= batch:
                yield pd.DataFrame(out, columns=[*columns, "state"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=[*columns, "state"])

    types = dict(events.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", state string"
    return _sorted(events, group).mapInPandas(run, schema)


def replay_mergeable(events: DataFrame, reducer: MergeableFold, width: int = DEFAULT_WIDTH) -> DataFrame:
    """State after every event by a mergeable fold.

    Chunks fold side by side from an empty state; the chunks' results are merged
    along each aggregate, and every event adds what came before its chunk.
    """
    merge = reducer.merge
    # aggregates that are not cut are one chunk; the fold tells groups apart by values, so it has no NULL;
    # events without an aggregate fold by stretch
    none = F.lit(-1).cast("long")
    stretch = F.when(F.col("aggregate_id").isNull(), F.floor(F.col("sequence_number") / F.lit(width))).otherwise(none)
    one = F.struct(stretch.alias("stretch"), none.alias("sequence"), none.alias("stored"))
    chunked = event_chunks(events, width)(events).withColumn(CHUNK, F.coalesce(CHUNK, one)).select("*", f"{CHUNK}.*")
    part = ["aggregate_id", *CHUNK_FIELDS]
    local = _fold_groups(chunked, part, reducer.fold, 5_000)
    ends = local.groupBy(*part).agg(F.max_by("state", F.struct(*ORDER)).alias("state"))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for chunk in batches:
            out = []
            for *key, text in chunk.itertuples(index=False):
                if key[0] != current:
                    current, state = key[0], None
                else:
                    out.append((*key, _dump(state)))
                local = json.loads(text)
                state = local if state is None else merge(state, local)
            yield pd.DataFrame(out, columns=[*part, "__before"])

    before = (
        ends.select(*part, "state")
        .repartition("aggregate_id")
        .sortWithinPartitions(*part)
        .mapInPandas(carry, "aggregate_id string, stretch long, sequence long, stored long, __before string")
    )

    @F.pandas_udf("string")
    def merged(earlier: pd.Series, later: pd.Series) -> pd.Series:
        return pd.Series(
            [b if a is None else _dump(merge(json.loads(a), json.loads(b))) for a, b in zip(earlier, later)]
        )

    return local.join(before, part, "left").select(
        *KEYS, "event_type", merged("__before", "state").alias("state")
    )


def reduce_events(
    events: DataFrame, reduce: Callable[[Iterable[dict]], object], batch: int = 5_000
) -> DataFrame:
    """One JSON state per aggregate from a function over its ordered events (an iterator)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for aggregate, rows in groupby(_rows(batches), key=lambda r: r["aggregate_id"]):
            parsed = ({**r, "payload": _parsed(r["payload"])} for r in rows)
            out.append((aggregate, _dump(reduce(parsed))))
            if len(out) >= batch:
                yield pd.DataFrame(out, columns=["aggregate_id", "state"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["aggregate_id", "state"])

    return _sorted(events, ["aggregate_id"]).mapInPandas(run, "aggregate_id string, state string")


def replay_with(
    events: DataFrame,
    reducers: Mapping[str, ColumnReducer | MergeableFold | FoldReducer],
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Replay with the reducer registered for each aggregate's first type, else the generic one.

    Long form ``key, value_json`` after each event: all fields of custom
    reducers, changed fields of the generic one.
    """
    typed = with_first_type(events)
    own = typed.filter(~F.col("first_type").isin(list(reducers))).drop("first_type")
    out = transitions(own, width).select(*KEYS, "key", F.col("new_json").alias("value_json"))
    for kind, reducer in reducers.items():
        part = typed.filter(F.col("first_type") == kind).drop("first_type")
        if isinstance(reducer, ColumnReducer):
            names = [*reducer.sums, *(reducer.latest or {})]
            replayed = replay_columns(part, reducer, width)
            cells = F.inline(
                F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).cast("string").alias("value_json")) for n in names])
            )
            rows = replayed.select(*KEYS, cells).filter(F.col("value_json").isNotNull())
        else:
            if isinstance(reducer, MergeableFold):
                folded = replay_mergeable(part, reducer, width)
            else:
                folded = replay_fold(part, reducer)
            rows = folded.select(*KEYS, F.explode(object_fields("state"))).select(
                *KEYS, "key", F.coalesce(F.to_json("value"), F.lit("null")).alias("value_json")
            )
        out = out.unionByName(rows)
    return out
