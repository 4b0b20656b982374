"""Plain folds on long histories: snapshots are stored, only what came after them is folded.

A store is a folder with two tables. ``snapshots`` holds the state after every
``every``-th event of an aggregate and after its last one; ``marks`` holds the
highest position each run has seen. A run reads the events beyond the mark (a
filter that reaches the scan) and folds them onto the aggregates' last snapshots.

Events must be numbered by ``global_position`` as they are appended, without
NULLs. An event may come late in sequence: its aggregate is then folded again from
the last snapshot before it, and its snapshots get a new ``generation``; only an
aggregate's newest generation counts. Snapshots are written before the mark, so a
run that breaks in between is made good by the next one in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.schema import ORDER
from .reducers import CARRIED, FoldReducer, ReducerError, _dump, _parsed, _rows
from .replay import KEYS

SNAPSHOT_SCHEMA = (
    "aggregate_id string, sequence_number long, global_position long, event_id string, "
    "state string, events long, generation long"
)
MARK_SCHEMA = "mark long"
EVERY = 1_000
LONGEST = 1_000_000  # events of one aggregate that a run folds in one task unasked


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        # known to be empty when the plan is made: what is joined with it is not computed
        return spark.range(0).filter(F.lit(False)).select(
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(schema)]
        )


def _place() -> Column:
    return F.struct(*ORDER)


def stored_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """All snapshots that count; no rows before the first run."""
    rows = _table(spark, f"{path}/snapshots", SNAPSHOT_SCHEMA)
    newest = rows.groupBy("aggregate_id").agg(F.max("generation").alias("__newest"))
    # none is beyond the newest: an equality would be taken as a key of the join, and the rows would
    # move once more to whoever goes on with them by aggregate
    return rows.join(newest, "aggregate_id").filter(F.col("generation") >= F.col("__newest")).select(*rows.columns)


def stored_mark(spark: SparkSession, path: str) -> int | None:
    """The highest position folded so far."""
    return _table(spark, f"{path}/marks", MARK_SCHEMA).agg(F.max("mark")).first()[0]


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """State after the last event of every aggregate, as of the last run; no fold."""
    last = stored_snapshots(spark, path).groupBy("aggregate_id").agg(
        F.max_by(F.struct("sequence_number", "events", "state"), _place()).alias("__last")
    )
    return last.select("aggregate_id", "__last.*")


def _fold(tail: DataFrame, seeds: DataFrame, group: list[str], fold: FoldReducer, every: int | None, new: int) -> DataFrame:
    """Fold ``tail`` onto ``seeds``, which come as rows ahead of the events they precede.

    A task holds one state and one batch. ``stop`` marks rows to be stored. Without ``every``
    only the last state of each group comes out, that of its seed where it has no events.
    """
    extra = [c for c in group if c not in CARRIED]
    columns = [*KEYS, *extra, "event_type", "state", "events", "generation", "stop"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, current = [], None, None
        state, events, generation = {}, 0, new

        def last() -> list:
            shown = held[-3]
            return [*held[:-3], _dump(shown[0]) if isinstance(shown, list) else shown, *held[-2:], True]

        for row in _rows(batches):
            key = [row[c] for c in group]
            if key != current:
                if held:
                    out.append(last())
                held, current = None, key
                state, events, generation = {}, 0, new
                if len(out) >= 5_000:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if row["__events"] >= 0:
                state, events, generation = _parsed(row["__state"]), row["__events"], row["__generation"]
                if every is None:
                    held = [row[c] for c in [*KEYS, *extra, "event_type"]] + [row["__state"], events, generation]
                continue
            if held and every is not None:
                out.append([*held, events % every == 0])
            event = {c: row[c] for c in CARRIED}
            try:
                state = fold(dict(state), {**event, "payload": _parsed(row["payload"])})
            except Exception as error:
                raise ReducerError(
                    f"reducer failed at sequence {row['sequence_number']} ({row['event_type']}) "
                    f"of aggregate '{row['aggregate_id']}'"
                ) from error
            events += 1
            # a state that may not come out has no text yet
            shown = [state] if every is None else _dump(state)
            held = [row[c] for c in [*KEYS, *extra, "event_type"]] + [shown, events, generation]
            if len(out) >= 5_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if held:
            out.append(last())
        if out:
            yield pd.DataFrame(out, columns=columns)

    none = F.lit(None).cast("string")
    marked = tail.select(
        *CARRIED, *extra, none.alias("__state"), F.lit(-1).cast("long").alias("__events"),
        F.lit(-1).cast("long").alias("__generation"),
    )
    ahead = seeds.select(
        *KEYS, *extra, F.col("state").alias("__state"), F.col("events").alias("__events"),
        F.col("generation").alias("__generation"),
    )
    types = dict(marked.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*KEYS, *extra, "event_type"])
    return (
        marked.unionByName(ahead, allowMissingColumns=True)
        .repartition(*group)
        .sortWithinPartitions(*group, *ORDER)
        .mapInPandas(run, schema + ", state string, events long, generation long, stop boolean")
    )


def _plan(events: DataFrame, path: str, longest: int | None):
    """What a run folds: tail, seeds, snapshots that only change generation, generation, mark."""
    spark = events.sparkSession
    mark = stored_mark(spark, path)
    position = F.col("global_position")
    beyond = events if mark is None else events.filter(position > mark)
    top = beyond.agg(F.max(position)).first()[0]
    new = beyond.filter(position <= (mark if top is None else top))  # the table may grow meanwhile
    stored = stored_snapshots(spark, path)
    generation = 1 + (stored.agg(F.max("generation")).first()[0] or 0)

    first = new.groupBy("aggregate_id").agg(F.min(_place()).alias("__first"))
    reached = stored.join(first, "aggregate_id")
    late = reached.filter(_place() >= F.col("__first")).select("aggregate_id").distinct()
    before = reached.filter(_place() < F.col("__first")).select(*stored.columns)
    seeds = _last(before, ["aggregate_id"])
    tail, moved = new, before.limit(0)
    if not late.isEmpty():
        # only then is anything read again from before the mark
        seeds = seeds.join(late.withColumn("__late", F.lit(True)), "aggregate_id", "left").select(
            *[c for c in seeds.columns if c != "generation"],
            F.when(F.col("__late"), F.lit(generation)).otherwise(F.col("generation")).cast("long").alias("generation"),
        )
        starts = late.join(seeds.select("aggregate_id", _place().alias("__start")), "aggregate_id", "left")
        if mark is not None:
            older = events.filter(position <= mark).join(starts, "aggregate_id")
            older = older.filter(F.col("__start").isNull() | (_place() > F.col("__start")))
            tail = new.unionByName(older.select(*new.columns))
        moved = before.join(late, "aggregate_id", "left_semi").withColumn("generation", F.lit(generation).cast("long"))
    if longest is not None:
        over = tail.groupBy("aggregate_id").count().filter(F.col("count") > longest).first()
        if over:
            raise ValueError(
                f"aggregate '{over[0]}' has {over[1]} events to fold one after the other; "
                "take a ColumnReducer or a MergeableFold, or allow it with longest=None"
            )
    return tail, seeds, moved, generation, top


def _last(snapshots: DataFrame, group: list[str]) -> DataFrame:
    rest = [c for c in snapshots.columns if c not in group]
    last = snapshots.groupBy(*group).agg(F.max_by(F.struct(*rest), _place()).alias("__last"))
    return last.select(*group, "__last.*").select(*snapshots.columns)


def replay_onward(
    events: DataFrame, fold: FoldReducer, path: str, longest: int | None = LONGEST
) -> DataFrame:
    """State after every event since the last run; nothing is stored."""
    tail, seeds, _, generation, _ = _plan(events, path, longest)
    return _fold(tail, seeds, ["aggregate_id"], fold, 1, generation).select(*KEYS, "event_type", "state")


def advance(
    events: DataFrame, fold: FoldReducer, path: str, every: int = EVERY, longest: int | None = LONGEST
) -> None:
    """Fold what came since the last run and store its snapshots and the new mark.

    More than ``longest`` events of one aggregate are refused, as they would run in
    one task; ``longest=None`` allows it.
    """
    if every < 1:
        raise ValueError("every must be positive")
    tail, seeds, moved, generation, top = _plan(events, path, longest)
    if top is None:
        return
    folded = _fold(tail, seeds, ["aggregate_id"], fold, every, generation).filter("stop")
    names = moved.columns
    folded.select(*names).unionByName(moved).write.mode("append").parquet(f"{path}/snapshots")
    events.sparkSession.createDataFrame([(top,)], MARK_SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/marks")


def stored_state_at(events: DataFrame, targets: DataFrame, fold: FoldReducer, path: str) -> DataFrame:
    """State up to each ``targets(aggregate_id, target)`` as of the last run.

    A target folds the events since the last snapshot up to it, fewer than
    ``every`` of them unless one sequence repeats. Targets before an aggregate's
    first event have no row.
    """
    spark = events.sparkSession
    group = ["aggregate_id", "target"]
    asked = targets.select(*group).filter(F.col("target").isNotNull()).distinct()
    stored = stored_snapshots(spark, path)
    seeds = _last(stored.join(asked, "aggregate_id").filter("sequence_number <= target"), group)
    starts = asked.join(seeds.select(*group, _place().alias("__start")), group, "left")
    mark = stored_mark(spark, path)
    folded_so_far = events.limit(0) if mark is None else events.filter(F.col("global_position") <= mark)
    between = folded_so_far.join(starts, "aggregate_id").filter(
        (F.col("sequence_number") <= F.col("target"))
        & (F.col("__start").isNull() | (_place() > F.col("__start")))
    )
    return _fold(between, seeds, group, fold, None, 0).select(*group, "state")
