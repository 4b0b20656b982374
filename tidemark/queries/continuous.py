"""Streaming queries, run over the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import instant_text
from ..session import run_folder
from ..sources.sample_logs import activity_events, activity_log, read_sample
from ..sources.stream_records import parse_stream_records, split_malformed
from ..streaming.carry import stream_anomalies, stream_replay, write_apart
from ..streaming.tail import (
    drop_resent_stream, in_batches, keep_latest, live_tail, newest_per_source, read_latest, run_to_folder, stream_throughput,
)
from .catalog import query
from .difference import RULES, _hits
from .protect import PARSED_RECORDS, RECORDS, as_records
from .sql_logs import activity, activity_changes, iso, with_logs


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of activity events."""
    schema = read_sample(spark, folder, "events").schema
    table = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return activity_events(table)


CLOSING = "~closing"


def closed(spark: SparkSession, folder: str, stream: DataFrame) -> DataFrame:
    """The stream with one event a day after all others: once it has arrived, nothing waits for later ones."""
    last = activity_log(spark, folder).agg(F.max("timestamp").alias("at"))
    kinds = dict(stream.dtypes)
    set_to = {"aggregate_id": F.lit(CLOSING), "timestamp": F.col("at") + F.expr("INTERVAL 1 DAY"), "payload": F.lit("{}")}
    # beyond every sequence, and no event of any rule or count
    one = last.select(*[set_to.get(c, F.lit(None).cast(kinds[c])).alias(c) for c in stream.columns])
    path = run_folder(spark, "closing")
    one.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(one.schema).parquet(path))


@query(
    "stream_throughput",
    activity(
        """SELECT strftime(start, '%Y-%m-%dT%H:00:00Z') AS bucket, event_count FROM (
        SELECT date_trunc('hour', ts) AS start, count(*) AS event_count FROM activity GROUP BY 1)"""
    ),
)
def _throughput(spark, folder):
    stream = closed(spark, folder, event_stream(spark, folder))
    return run_to_folder(stream_throughput(stream), run_folder(spark, "throughput"))


@query(
    "stream_replay",
    activity_changes("SELECT aggregate_id, sequence_number, key, old_json, new_json FROM activity_diffs"),
)
def _replay(spark, folder):
    stream = closed(spark, folder, event_stream(spark, folder))
    changes = run_to_folder(stream_replay(stream), run_folder(spark, "replay"))
    return changes.filter("NOT late").drop("late", "global_position", "event_id")


@query(
    "stream_anomalies",
    activity("SELECT code, severity, aggregate_id, sequence_number FROM hits", _hits("activity")),
)
def _anomalies(spark, folder):
    stream = closed(spark, folder, event_stream(spark, folder))
    work = run_folder(spark, "anomalies")
    write_apart(stream_anomalies(stream, RULES), work).awaitTermination()
    found = spark.read.parquet(f"{work}/rows").filter(F.col("aggregate_id") != CLOSING)
    return found.select("code", "severity", "aggregate_id", "sequence_number")


@query(
    "drop_resent_stream",
    activity(
        """SELECT aggregate_id, sequence_number, event_id, event_type, payload FROM (
        SELECT *, row_number() OVER (PARTITION BY aggregate_id, sequence_number ORDER BY global_position, event_id) AS copy
        FROM (SELECT * FROM activity UNION ALL SELECT * FROM activity WHERE k % 2 = 0)) WHERE copy = 1"""
    ),
)
def _resent_stream(spark, folder):
    """Every other event is sent twice, by the value in its payload."""
    stream = event_stream(spark, folder)
    again = event_stream(spark, folder).filter(F.get_json_object("payload", "$.k").cast("long") % 2 == 0)
    once = drop_resent_stream(stream.unionByName(again)).select(
        "aggregate_id", "sequence_number", "event_id", "event_type", "payload"
    )
    return run_to_folder(once, run_folder(spark, "resent"))


@query(
    "keep_latest",
    activity(
        """SELECT source_id, event_id, (row_number() OVER (PARTITION BY source_id ORDER BY global_position) - 1) // 50 AS batch_no FROM (
        SELECT event_type AS source_id, event_id, global_position,
               row_number() OVER (PARTITION BY event_type ORDER BY global_position DESC) AS r FROM activity) WHERE r <= 200"""
    ),
)
def _keep(spark, folder):
    tagged = event_stream(spark, folder).select(
        F.col("event_type").alias("source_id"), "event_id", "global_position"
    )
    checkpoint = run_folder(spark, "latest")
    keep_latest(tagged, checkpoint, available_now=True).awaitTermination()
    return in_batches(read_latest(spark, checkpoint)).select("source_id", "event_id", "batch_no")


@query(
    "newest_per_source",
    activity(
        """SELECT source_id, event_id FROM (SELECT event_type AS source_id, event_id,
        row_number() OVER (PARTITION BY event_type ORDER BY global_position DESC) AS r FROM activity) WHERE r <= 100"""
    ),
)
def _newest(spark, folder):
    tagged = activity_log(spark, folder).withColumn("source_id", F.col("event_type"))
    return newest_per_source(tagged, 100).select("source_id", "event_id")


@query(
    "live_tail",
    activity(
        f"""SELECT event_id, {iso('ts')} AS ts_text, 'backfill' AS part FROM (
        SELECT * FROM activity WHERE global_position <= 5000 ORDER BY global_position DESC LIMIT 100)
        UNION ALL SELECT event_id, {iso('ts')}, 'live' FROM activity
        WHERE global_position > (SELECT max(global_position) FROM activity WHERE global_position <= 5000)"""
    ),
)
def _tail(spark, folder):
    seen = activity_log(spark, folder).filter("global_position <= 5000")
    tail = live_tail(seen, event_stream(spark, folder), shared_position=True)
    live = run_to_folder(tail.stream.select("event_id", "timestamp"), run_folder(spark, "tail"))

    def shown(events: DataFrame, part: str) -> DataFrame:
        return events.select("event_id", instant_text(F.col("timestamp")).alias("ts_text"), F.lit(part).alias("part"))

    return shown(tail.backfill, "backfill").unionByName(shown(live, "live"))


@query("read_stream_events", with_logs(RECORDS, body=PARSED_RECORDS))
def _stream_events(spark, folder):
    schema = read_sample(spark, folder, "events").schema
    table = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    good, _ = split_malformed(parse_stream_records(as_records(table)))
    events = run_to_folder(good, run_folder(spark, "records"))
    return events.withColumn("ts_text", instant_text(F.col("timestamp"))).drop("timestamp", "topic", "partition")
