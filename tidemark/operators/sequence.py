"""Runs of events of the same type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.running import CHUNK, DEFAULT_WIDTH, event_chunks, running
from ..sources.schema import ORDER

MIN_RUN = 4  # fixed value: shortest run shown as a group


def _runs(events: DataFrame, width: int) -> DataFrame:
    """Every event with its index from 0 and the index its run starts at."""
    narrow = events.select("aggregate_id", *ORDER, "event_type")
    placed = running(
        narrow,
        ["aggregate_id"],
        ORDER,
        event_chunks(events, width),
        sums={"step": F.lit(1).cast("long")},
        previous={"before": F.struct("event_type")},
        keep_chunks=True,
    )
    starts = ~F.coalesce(F.col("before.event_type").eqNullSafe(F.col("event_type")), F.lit(False))
    starts = F.col("before").isNull() | starts
    flagged = placed.select(
        "aggregate_id", *ORDER, "event_type", "step",
        F.when(starts, F.col("step")).alias("start_step"), *[c for c in placed.columns if c == CHUNK],
    )
    return running(
        flagged,
        ["aggregate_id"],
        ORDER,
        None,
        latest={"run_step": F.col("start_step")},
    ).drop("start_step")


def collapse_runs(events: DataFrame, min_run: int = MIN_RUN, width: int = DEFAULT_WIDTH) -> DataFrame:
    """Segments of a timeline: a group per run of ``min_run`` or more, else single events.

    Runs fold on the map side, so one run holding most events costs no task
    more than its share; a short run carries its few sequences along.
    """
    offset = F.col("step") - F.col("run_step")
    runs = _runs(events, width).groupBy("aggregate_id", F.col("run_step")).agg(
        F.max("event_type").alias("event_type"),
        F.count(F.lit(1)).alias("length"),
        F.min("sequence_number").alias("first_sequence"),
        F.max("sequence_number").alias("last_sequence"),
        F.array_compact(
            F.array(*[F.max(F.when(offset == i, F.col("sequence_number"))) for i in range(min_run - 1)])
        ).alias("members"),
    )
    start = (F.col("run_step") - 1).alias("start_index")
    grouped = F.col("length") >= min_run
    return runs.select(
        "aggregate_id",
        "event_type",
        grouped.alias("is_group"),
        "length",
        "run_step",
        "first_sequence",
        "last_sequence",
        F.posexplode(F.when(grouped, F.array("first_sequence")).otherwise(F.col("members"))).alias("at", "member"),
        start,
    ).select(
        "aggregate_id",
        F.when(F.col("is_group"), "group").otherwise("single").alias("kind"),
        "event_type",
        (F.col("start_index") + F.col("at")).alias("start_index"),
        F.when(F.col("is_group"), F.col("length")).otherwise(1).cast("long").alias("length"),
        F.col("member").alias("first_sequence"),
        F.when(F.col("is_group"), F.col("last_sequence")).otherwise(F.col("member")).alias("last_sequence"),
    )


def group_key(start_index: Column, length: Column) -> Column:
    return F.concat(start_index.cast("string"), F.lit("-"), length.cast("string"))


def timeline_rows(
    events: DataFrame,
    expanded_key: str | None = None,
    selected_sequence: int | None = None,
    min_run: int = MIN_RUN,
    width: int = DEFAULT_WIDTH,
) -> DataFrame:
    """Display rows after collapsing: single, group and, for the expanded group, its items.

    ``row_index`` orders the rows: the step of the first event, groups before
    their items.
    """
    segments = collapse_runs(events, min_run, width)
    is_group = F.col("kind") == "group"
    key = group_key(F.col("start_index"), F.col("length"))
    expanded = is_group & (key == F.lit(expanded_key)) if expanded_key is not None else F.lit(False)
    rows = segments.select(
        "aggregate_id",
        "kind",
        F.when(is_group, F.concat(F.lit("group-"), key))
        .otherwise(F.concat(F.lit("single-"), F.col("first_sequence").cast("string")))
        .alias("row_key"),
        "event_type",
        F.when(~is_group, F.col("start_index") + 1).alias("step_number"),
        "start_index",
        "length",
        "first_sequence",
        "last_sequence",
        F.when(is_group, expanded).alias("expanded"),
    )
    if selected_sequence is None:
        rows = rows.withColumn("contains_selection", F.when(is_group, F.lit(False)))
    else:
        # sequences may have gaps: a selection counts only if the event exists
        present = (
            events.filter(F.col("sequence_number") == selected_sequence)
            .select("aggregate_id", F.lit(True).alias("__present"))
            .distinct()
        )
        inside = F.lit(selected_sequence).between(F.col("first_sequence"), F.col("last_sequence"))
        rows = rows.join(present, "aggregate_id", "left").withColumn(
            "contains_selection",
            F.when(is_group, F.coalesce(F.col("__present") & inside, F.lit(False))),
        )
    columns = [
        "aggregate_id", "kind", "row_key", "event_type", "step_number", "start_index", "length",
        "expanded", "contains_selection",
    ]
    shown = rows.select(*columns, F.lit(None).cast("string").alias("parent_key"))
    if expanded_key is None:
        return shown
    opened = rows.filter("expanded").select("aggregate_id", "start_index", "length")
    placed = _runs(events, width).withColumn("start_index", F.col("run_step") - 1)
    items = placed.join(opened, ["aggregate_id", "start_index"]).select(
        "aggregate_id",
        F.lit("group-item").alias("kind"),
        F.concat(F.lit("group-item-"), F.col("sequence_number").cast("string")).alias("row_key"),
        "event_type",
        F.col("step").alias("step_number"),
        (F.col("step") - 1).alias("start_index"),
        F.lit(1).cast("long").alias("length"),
        F.lit(None).cast("boolean").alias("expanded"),
        F.lit(None).cast("boolean").alias("contains_selection"),
        F.lit(expanded_key).alias("parent_key"),
    )
    return shown.unionByName(items)
