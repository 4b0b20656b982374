"""Live tail, bounded buffers and throughput on streams."""

from __future__ import annotations

import heapq
from collections.abc import Collection, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

from ..operators.timeline import recent_events
from ..session import run_folder, stateful

# Sizes of the live tail.
BACKFILL, BUFFER, BATCH, CLIENT_ROWS = 100, 200, 50, 100
NO_LIVE_STREAM = "NO_LIVE_STREAM"
SALTS = 64
PARTS = 8  # of a source's buffer in the state store
KEPT = "kept"


@dataclass(frozen=True)
class Tail:
    """Backfill (batch), then the stream; ``marker`` is set when there is no stream."""

    backfill: DataFrame
    stream: DataFrame | None
    marker: str | None


def live_tail(
    events: DataFrame,
    stream: DataFrame | None = None,
    backfill: int = BACKFILL,
    key: Collection[str] = ("event_id",),
    shared_position: bool = False,
) -> Tail:
    """The most recent events of a source, oldest first, and what its stream, if it has one, adds to them.

    No event of the backfill comes twice: stream events with the ``key`` of one
    are dropped, and no others. Where events and stream count positions on one
    scale, ``shared_position`` also drops what lies before the backfill's last
    position. Kafka offsets restart in every partition and are no such scale.
    A key with a NULL or an empty text in it tells nothing and drops nothing.
    """
    recent = recent_events(events, backfill)
    if stream is None:
        return Tail(recent, None, NO_LIVE_STREAM)
    # kept as of now: read again in a later micro-batch, the newest events would be others
    path = run_folder(events.sparkSession, "backfill")
    recent.write.parquet(path)
    shown = events.sparkSession.read.schema(recent.schema).parquet(path)
    if shared_position:
        last = shown.agg(F.max("global_position")).first()[0]
        stream = stream if last is None else stream.filter(F.col("global_position") >= last)
    known = shown.select(*key).distinct()
    for column in key:
        known = known.filter(F.col(column).cast("string") != "")
    live = stream.join(known, list(key), "left_anti").select(*stream.columns)
    return Tail(shown.orderBy("global_position", "event_id"), live, None)


def newest_per_source(events: DataFrame, size: int = BUFFER) -> DataFrame:
    """The newest events of each source; a busy source is first thinned in salted parts."""
    newest = [F.desc("global_position"), F.desc("event_id")]
    salted = events.withColumn("__salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)))
    part = Window.partitionBy("source_id", "__salt").orderBy(*newest)
    thinned = salted.withColumn("__n", F.row_number().over(part)).filter(F.col("__n") <= size)
    # at most SALTS * size rows of a source meet here
    whole = Window.partitionBy("source_id").orderBy(*newest)
    return (
        thinned.drop("__salt").withColumn("__n", F.row_number().over(whole)).filter(F.col("__n") <= size).drop("__n")
    )


def in_batches(kept: DataFrame, size: int = BATCH) -> DataFrame:
    """Number the hand-over batches of kept events, oldest first."""
    oldest = Window.partitionBy("source_id").orderBy("global_position", "event_id")
    return kept.withColumn("batch_no", F.floor((F.row_number().over(oldest) - 1) / size).cast("long"))


class _Newest(StatefulProcessor):
    """Keeps the ``size`` newest rows of a key and gives out those that came in."""

    def __init__(self, names: list[str], types: str, size: int):
        self.names, self.types, self.size = names, types, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState(KEPT, self.types)
        self.order = [self.names.index(c) for c in ("global_position", "event_id")]
        self.out = Row(*self.names, "salt")

    def newest(self, rows: Iterable[tuple]) -> list[tuple]:
        # at most ``size`` rows are held, however many come in
        return heapq.nlargest(self.size, rows, key=lambda r: [(r[i] is not None, r[i]) for i in self.order])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        came = self.newest(tuple(r[c] for c in self.names) for r in rows)
        before = [tuple(r) for r in self.kept.get()]
        kept = self.newest([*before, *came])
        self.kept.put(kept)
        old = set(before)
        for row in kept:
            if row not in old:
                yield self.out(*row, key[1])


def newest_changes(stream: DataFrame, size: int = BUFFER) -> DataFrame:
    """Bounded buffers as a stream: rows that enter a source's newest ``size``, in update mode.

    A source is kept in salted parts of ``size`` rows each, so a busy one is spread
    over tasks; state and memory are bounded by the number of sources.
    """
    kinds = [f"`{c}` {kind}" for c, kind in stream.dtypes]
    salted = stateful(stream).withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(PARTS)).cast("int"))
    step = _Newest(stream.columns, ", ".join(kinds), size)
    return salted.groupBy("source_id", "salt").transformWithState(step, ", ".join([*kinds, "salt int"]), "update", "None")


def keep_latest(
    stream: DataFrame, checkpoint: str, size: int = BUFFER, available_now: bool = False, name: str | None = None
) -> StreamingQuery:
    """Maintain the newest ``size`` events of each source as the keyed state of a running query.

    The state store is the buffer: ``read_latest`` reads it, Spark keeps and compacts
    its versions, and a restart goes on with it. A fresh checkpoint starts empty.
    Pace the input with the source's own rate options. The changes themselves, for
    subscribers, are ``newest_changes``.
    """
    writer = newest_changes(stream, size).writeStream.format("noop").outputMode("update")
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.queryName(name) if name else writer
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_latest(spark: SparkSession, checkpoint: str, size: int = BUFFER) -> DataFrame:
    """The newest events of each source as the last finished micro-batch of ``keep_latest`` left them."""
    state = spark.read.format("statestore").option("stateVarName", KEPT).load(checkpoint)
    return newest_per_source(state.select("list_element.*"), size)


def stream_throughput(events: DataFrame, bucket_hours: int = 1, delay: str = "10 minutes") -> DataFrame:
    """Events per bucket, given out once the watermark has passed the bucket's end.

    Rows that arrive after that are dropped.
    """
    timed = events.select("timestamp").withWatermark("timestamp", delay)
    counts = timed.groupBy(F.window("timestamp", f"{bucket_hours} hours")).agg(F.count(F.lit(1)).alias("event_count"))
    return counts.select(
        F.date_format("window.start", "yyyy-MM-dd'T'HH:00:00'Z'").alias("bucket"), "event_count"
    )


def drop_resent_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """One event per (aggregate_id, sequence_number) of a stream, as long as copies come within ``delay``.

    The first to arrive stays; what is remembered of a key leaves the state once the
    watermark is past it by ``delay``.
    """
    keys = ["aggregate_id", "sequence_number"]
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(keys)


def run_to_folder(stream: DataFrame, folder: str) -> DataFrame:
    """Process what is available now into ``folder`` and read the result."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
