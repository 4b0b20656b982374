"""Several event stores side by side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SOURCE = "default"


def union_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All events with the ``source_id`` they come from, sources in order of their ids."""
    if not sources:
        raise ValueError("no sources")
    tagged = [sources[name].withColumn("source_id", F.lit(name)) for name in sorted(sources)]
    result = tagged[0]
    for part in tagged[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def select_source(
    sources: Mapping[str, DataFrame], source_id: str | None = None, default: str = DEFAULT_SOURCE
) -> DataFrame:
    """The named source; blank means the default, an unknown name is an error."""
    name = source_id.strip() if source_id and source_id.strip() else default
    if name not in sources:
        raise KeyError(f"unknown source '{name}'; known: {sorted(sources)}")
    return sources[name].withColumn("source_id", F.lit(name))


def list_sources(sources: Mapping[str, DataFrame]) -> list[str]:
    return sorted(sources)


def route_streams(sources: DataFrame, bindings: DataFrame, streams: DataFrame) -> DataFrame:
    """The stream each source tails, NULL for none.

    ``sources(source_id, is_default)``, ``bindings(source_id, stream_id)``,
    ``streams(stream_id, ready, position)``. An explicit binding decides (a
    blank one means none); else a stream of the same name; else, for the
    default source, the first stream that is ready.
    """
    names = streams.select("stream_id").distinct()
    known = names.select(F.col("stream_id").alias("__bound"))
    bound = bindings.select(
        "source_id", F.trim("stream_id").alias("__bound"), F.lit(True).alias("__explicit")
    ).join(known.withColumn("__known", F.lit(True)), "__bound", "left")
    same = names.select(F.col("stream_id").alias("source_id"), F.col("stream_id").alias("__same"))
    routed = sources.join(bound, "source_id", "left").join(same, "source_id", "left")
    first_ready = streams.filter("ready").agg(F.min_by("stream_id", "position")).scalar()
    explicit = F.when(F.col("__known"), F.col("__bound"))
    fallback = F.coalesce("__same", F.when(F.col("is_default"), first_ready))
    return routed.select(
        "source_id", F.when(F.coalesce("__explicit", F.lit(False)), explicit).otherwise(fallback).alias("stream_id")
    )
