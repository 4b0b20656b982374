"""Stream records (key, value, topic, partition, offset, timestamp) to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.json_values import FIELD_MAP, kind
from .schema import EVENT_COLUMNS, normalize_timestamps

# Names and defaults of the record forms.
UNKNOWN, UNKNOWN_EVENT = "unknown", "UnknownEvent"
CAMEL = {
    "event_id": "eventId",
    "aggregate_id": "aggregateId",
    "aggregate_type": "aggregateType",
    "sequence_number": "sequenceNumber",
    "event_type": "eventType",
    "payload": "payload",
    "metadata": "metadata",
    "timestamp": "timestamp",
}


def parse_stream_records(records: DataFrame, strict: bool = False) -> DataFrame:
    """Events from records, with ``malformed`` marking records that are no JSON object.

    A record with an event id and an aggregate id is a full event; any other
    object is a minimal one that becomes its own payload. Snake-case names and
    epoch times are accepted too unless ``strict``. Ids made for minimal records
    come from topic, partition and offset, so reading again gives the same ids.
    """
    value = F.col("value").cast("string")
    fields = F.try_variant_get(F.try_parse_json(value), "$", FIELD_MAP)
    parsed = records.withColumns({"__value": value, "__fields": fields})

    def raw(logical: str) -> Column:
        names = [CAMEL[logical]] if strict else [CAMEL[logical], logical]
        return F.coalesce(*[F.to_json(F.try_element_at(F.col("__fields"), F.lit(n))) for n in dict.fromkeys(names)])

    def plain(value_json: Column) -> Column:
        as_text = F.try_variant_get(F.try_parse_json(value_json), "$", "string")
        return F.when(kind(value_json) == "string", as_text).when(kind(value_json) != "null", value_json)

    def named(logical: str) -> Column:
        return plain(raw(logical))

    def embedded(logical: str) -> Column:
        """JSON text of an object; a string that holds an object counts as that object."""
        json_text = raw(logical)
        inner = F.try_variant_get(F.try_parse_json(json_text), "$", "string")
        unwrapped = F.when(
            (kind(json_text) == "string") & F.try_variant_get(F.try_parse_json(inner), "$", FIELD_MAP).isNotNull(),
            F.to_json(F.try_parse_json(inner)),
        ).otherwise(json_text)
        return F.coalesce(unwrapped, F.lit("{}"))

    full = named("event_id").isNotNull() & named("aggregate_id").isNotNull()
    sequence = F.coalesce(named("sequence_number").try_cast("double").try_cast("long"), F.lit(0))
    bare_type = F.coalesce(
        named("event_type"), plain(F.to_json(F.try_element_at(F.col("__fields"), F.lit("type")))), F.lit(UNKNOWN_EVENT)
    )
    made_id = F.concat_ws("-", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    event_time = F.try_to_timestamp(named("timestamp")) if strict else normalize_timestamps(named("timestamp"))
    return parsed.select(
        F.when(full, named("event_id")).otherwise(made_id).alias("event_id"),
        F.when(full, named("aggregate_id"))
        .otherwise(F.coalesce(F.col("key").cast("string"), F.lit(UNKNOWN)))
        .alias("aggregate_id"),
        F.when(full, F.coalesce(named("aggregate_type"), F.lit(UNKNOWN))).otherwise(UNKNOWN).alias("aggregate_type"),
        F.when(full, sequence).otherwise(F.col("offset")).cast("long").alias("sequence_number"),
        F.when(full, F.coalesce(named("event_type"), F.lit(UNKNOWN_EVENT))).otherwise(bare_type).alias("event_type"),
        F.when(full, embedded("payload")).otherwise(F.col("__value")).alias("payload"),
        F.when(full, embedded("metadata")).otherwise("{}").alias("metadata"),
        F.when(full, F.coalesce(event_time, F.col("timestamp"))).otherwise(F.col("timestamp")).alias("timestamp"),
        F.col("offset").cast("long").alias("global_position"),
        "topic",
        "partition",
        F.col("__fields").isNull().alias("malformed"),
        F.col("__value").alias("value"),
    )


def split_malformed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and the records to put aside with where they came from."""
    good = parsed.filter(~F.col("malformed")).select(*EVENT_COLUMNS, "topic", "partition")
    bad = parsed.filter("malformed").select("topic", "partition", F.col("global_position").alias("offset"), "value")
    return good, bad


def read_stream_events(spark: SparkSession, servers: str, topic: str, strict: bool = False, **options: str) -> DataFrame:
    """A topic from its latest offsets as parsed records; needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
    )
    return parse_stream_records(reader.options(**options).load(), strict)
