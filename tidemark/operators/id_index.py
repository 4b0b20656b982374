"""Substring search over aggregate ids without reading the log: postings of trigrams.

``postings`` has a row for every distinct id and every place in its lower-case form: the
run of three characters that begins there, shorter at the end. Ids stay in the files
they are dealt to; each file is sorted by that run, so a look-up skips all other row
groups and pages. Shorter texts begin some run wherever they stand. ``sizes`` counts
the ids behind each run of three. A search reads the postings
of the rarest run in the search text only: a posting holds its whole id, so the
rest of the text is checked on the spot, and the lists of its other runs, which
could only confirm the same, stay unread. Sizes only choose the list: where a broken
run left some out, searches find the same and read more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .timeline import DEFAULT_SEARCH, chosen_limit, first_event

GRAM = 3
ROW_GROUP = 8 << 20  # bytes of postings that a look-up skips or opens
LISTED = 1_000  # ids that a filter on the log may list


def _grams(text: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(text))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def write_id_index(events: DataFrame, path: str) -> None:
    """Add the ids of ``events`` to the index at ``path``; NULL and empty ids are in no search.

    Later events may be added by further calls. An id that comes again is stored
    again and found once.
    """
    ids = events.select("aggregate_id").filter(F.col("aggregate_id") != "").distinct()
    batch = f"{path}/postings/batch={uuid.uuid4().hex}"
    (
        # a list is spread over the files: no posting moves, and a long one is read by many tasks
        ids.select(F.explode(_grams(F.lower("aggregate_id"))).alias("gram"), "aggregate_id")
        .sortWithinPartitions("gram", "aggregate_id")
        .write.option("parquet.block.size", ROW_GROUP)
        .parquet(batch)
    )
    # counted from what was written, so that ids are taken apart once
    runs = events.sparkSession.read.parquet(batch).filter(F.char_length("gram") == GRAM)
    sizes = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("ids"))
    sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("append").parquet(f"{path}/sizes")


def indexed_ids(spark: SparkSession, path: str, query: str) -> DataFrame:
    """All ids that contain ``query`` in any case."""
    if not query or not query.strip():
        raise ValueError("search text must not be blank")
    low = query.lower()
    postings = spark.read.parquet(f"{path}/postings")
    if len(low) < GRAM:
        postings = postings.filter(F.col("gram").startswith(low))
    else:
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        # one row per run of the search text at most
        known = spark.read.parquet(f"{path}/sizes").filter(F.col("gram").isin(grams))
        sizes = dict(known.groupBy("gram").agg(F.sum("ids")).collect())
        postings = postings.filter(F.col("gram") == min(grams, key=lambda g: (sizes.get(g, 0), g)))
    found = postings.filter(F.contains(F.lower("aggregate_id"), F.lit(low)))
    return found.select("aggregate_id").distinct()


def search_indexed(spark: SparkSession, path: str, query: str, limit: int | None = None) -> DataFrame:
    """What ``search_aggregates`` finds, read from the index."""
    found = indexed_ids(spark, path, query)
    return found.orderBy("aggregate_id").limit(chosen_limit(limit, DEFAULT_SEARCH))


def summaries_indexed(events: DataFrame, path: str, query: str, limit: int | None = None) -> DataFrame:
    """What ``search_summaries`` finds; the ids found reach the log's scan as a filter."""
    limit = chosen_limit(limit, DEFAULT_SEARCH)
    found = search_indexed(events.sparkSession, path, query, limit)
    if limit > LISTED:
        return first_event(events.join(found, "aggregate_id", "left_semi"))
    ids = [r[0] for r in found.collect()]  # LISTED at most
    return first_event(events.filter(F.col("aggregate_id").isin(ids)))
