"""Event logs read from the sample tables: user activity, orders, conversations, documents.

All but the order log are plain projections, so filters on the log reach the
parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT_COLUMNS

EMPTY_JSON = "{}"


def read_sample(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _json(*parts: Column | str) -> Column:
    """JSON text from alternating literal text and string columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def activity_events(table: DataFrame) -> DataFrame:
    """The activity projection of an ``events`` table, batch or streaming."""
    return table.select(
        _text("event_id").alias("event_id"),
        F.concat(F.lit("U-"), _text("user_id")).alias("aggregate_id"),
        F.lit("USER").alias("aggregate_type"),
        (F.col("event_id") + 1).alias("sequence_number"),
        F.upper("event_type").alias("event_type"),
        _json(
            '{"k":',
            F.get_json_object("props", "$.k"),
            ',"cents":',
            _cents(F.col("value")).cast("string"),
            "}",
        ).alias("payload"),
        F.lit('{"source":"activity"}').alias("metadata"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.col("event_id") + 1).alias("global_position"),
    )


def activity_log(spark: SparkSession, folder: str) -> DataFrame:
    """One aggregate per user; sequence and position follow the event id."""
    return activity_events(read_sample(spark, folder, "events"))


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """One aggregate per order: placed, one event per line number, then completed or cancelled.

    Lines sharing a line number are summed into one event, which keeps the
    sequence unique without numbering rows.
    """
    orders = read_sample(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("cust"),
        F.col("o_orderstatus").alias("order_status"),
        _cents(F.col("o_totalprice")).alias("total"),
        F.col("o_orderdate").cast("timestamp").alias("placed_at"),
        F.col("o_orderpriority").alias("priority"),
    )
    lines = (
        read_sample(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey")
        # hardly a line shares its number: sums on the map side would hold a whole split in memory for nothing
        .repartition("l_orderkey", "l_linenumber")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.sum(F.col("l_quantity").cast("long")).alias("qty"),
            F.sum(_cents(F.col("l_extendedprice"))).alias("cents"),
            F.max("l_partkey").alias("part"),
        )
        .withColumnRenamed("l_orderkey", "order_key")
    )
    # numbers go through the join, the texts are made behind it
    order_lines = lines.join(orders.select("order_key", "placed_at"), "order_key").select(
        "order_key",
        "placed_at",
        (F.col("l_linenumber") + 1).cast("long").alias("sequence_number"),
        F.lit("LINE_ITEM_ADDED").alias("event_type"),
        _json(
            '{"part":', _text("part"), ',"qty":', _text("qty"), ',"line_cents":', _text("cents"), "}"
        ).alias("payload"),
    )
    placed = orders.select(
        "order_key",
        "placed_at",
        F.lit(1).cast("long").alias("sequence_number"),
        F.lit("ORDER_PLACED").alias("event_type"),
        _json(
            '{"cust":', _text("cust"), ',"priority":"', F.col("priority"), '","total_cents":', _text("total"),
            ',"status":"PENDING"}',
        ).alias("payload"),
    )
    ended = orders.filter(F.col("order_status").isin("F", "P")).select(
        "order_key",
        "placed_at",
        F.lit(20).cast("long").alias("sequence_number"),
        F.when(F.col("order_status") == "F", "ORDER_COMPLETED").otherwise("ORDER_CANCELLED").alias("event_type"),
        F.when(F.col("order_status") == "F", '{"status":"DONE"}').otherwise(EMPTY_JSON).alias("payload"),
    )
    position = F.col("order_key") * 100 + F.col("sequence_number")
    return (
        placed.unionByName(order_lines)
        .unionByName(ended)
        .select(
            position.cast("string").alias("event_id"),
            F.concat(F.lit("ORD-"), _text("order_key")).alias("aggregate_id"),
            F.lit("ORDER").alias("aggregate_type"),
            "sequence_number",
            "event_type",
            "payload",
            F.lit('{"source":"orders"}').alias("metadata"),
            F.timestamp_micros(
                F.unix_micros("placed_at") + F.col("sequence_number") * 60_000_000
            ).alias("timestamp"),
            position.alias("global_position"),
        )
        .select(*EVENT_COLUMNS)
    )


def conversation_log(spark: SparkSession, folder: str) -> DataFrame:
    """One aggregate per conversation, one event per turn."""
    position = F.col("conv_id") * 1000 + F.col("turn") + 1
    return read_sample(spark, folder, "conversations").select(
        position.cast("string").alias("event_id"),
        F.concat(F.lit("CONV-"), _text("conv_id")).alias("aggregate_id"),
        F.lit("CONVERSATION").alias("aggregate_type"),
        (F.col("turn") + 1).alias("sequence_number"),
        F.upper("role").alias("event_type"),
        F.to_json(F.struct("text")).alias("payload"),
        F.lit(EMPTY_JSON).alias("metadata"),
        F.timestamp_seconds(F.lit(1_704_067_200) + position * 60).alias("timestamp"),
        position.alias("global_position"),
    )


def document_log(spark: SparkSession, folder: str) -> DataFrame:
    """One aggregate per document with its whole text as payload."""
    position = F.col("doc_id") + 1
    return read_sample(spark, folder, "documents").select(
        _text("doc_id").alias("event_id"),
        F.concat(F.lit("DOC-"), _text("doc_id")).alias("aggregate_id"),
        F.lit("DOCUMENT").alias("aggregate_type"),
        F.lit(1).cast("long").alias("sequence_number"),
        F.lit("DOCUMENT_CREATED").alias("event_type"),
        F.to_json(F.struct("lang", "n_chars", "source", "text")).alias("payload"),
        F.lit(EMPTY_JSON).alias("metadata"),
        F.timestamp_seconds(F.lit(1_704_067_200) + position * 60).alias("timestamp"),
        position.alias("global_position"),
    )
