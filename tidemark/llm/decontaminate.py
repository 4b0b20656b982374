"""Benchmark decontamination as a prefix-filtered set join, in Spark's own functions.

A window is ``size`` consecutive words of a benchmark item, or a shorter item as
a whole. Words are ordered by how rare they are in the documents. A document can
only hold a window if it holds the window's rarest word, so that word is the
whole prefix that must be joined: documents' words meet the prefix words, the
words beside it must stand beside it in the window, its place in the window gives
the only possible start (which must lie in the document, with room for the
window), and the words from there are compared with the window.

Documents are split into words once and told apart by row numbers. Null texts have
no words, very long ones are rows like others. Repeated documents, doc_ids or items
are judged row by row; a null item_id is not listed, but its windows mark words.
Windows of several items at one place all count (no ties are broken). Documents
without hits, an empty benchmark and an empty table give zeros or no rows. Only the
named columns are read, so extra ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, sized_broadcast, staged

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(F.col(text), F.lit(""))), NO_WORD), "")


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Rows (item_id, window, length): the distinct windows of each item, words joined by blanks."""
    items = benchmark.select("item_id", words("text").alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("length", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("length") + 1)
    return (
        items.select("item_id", "w", "length", F.explode(starts).alias("start"))
        .select("item_id", F.array_join(F.slice("w", F.col("start"), F.col("length")), " ").alias("window"), "length")
        .distinct()
    )


def split_rows(documents: DataFrame, row: str | None = None) -> DataFrame:
    """Rows (_row, doc_id, n, w): every document's words, split once; ``row`` is a number they have already."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    docs = documents.select(number.alias("_row"), "doc_id", words("text").alias("w"))
    return staged(docs.withColumn("n", F.size("w").cast("long")), "document-words")


def prefixes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (word, window, length, place, before, after): each window's rarest word, where it first stands, and its neighbours."""
    parts = wanted.select("window", "length").distinct().select(
        "window", "length", F.posexplode(F.split("window", " ")).alias("place", "word")
    )
    vocabulary = staged(parts.select("word").distinct(), "benchmark-words")
    counts = (
        docs.select(F.explode("w").alias("word"))
        .join(sized_broadcast(vocabulary), "word")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("first")
    found = parts.join(counts, "word", "left").groupBy("window", "length").agg(rarest)
    inside = F.split("window", " ")
    return found.select(
        "first.word", "window", "length", "first.place",
        F.get(inside, F.col("first.place") - 1).alias("before"), F.get(inside, F.col("first.place") + 1).alias("after"),
    )


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Per document doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return judged(split_rows(documents), benchmark, size).drop("_row")


def uncontaminated(documents: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The documents, whole rows, in which no window of the benchmark occurs."""
    row = "_row"
    while row in documents.columns:
        row += "_"
    numbered = staged(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = judged(split_rows(numbered, row), benchmark, size).filter("contaminated").select(F.col("_row").alias(row))
    return numbered.join(sized_broadcast(staged(found, "contaminated")), row, "left_anti").drop(row)


def judged(docs: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    wanted = staged(windows(benchmark, size), "benchmark-windows")
    prefix = staged(prefixes(docs, wanted), "benchmark-prefixes")
    # a word with its neighbours: most places of a prefix word are ruled out before they move
    near = F.transform(
        "w", lambda word, at: F.struct(at.alias("pos"), word.alias("word"), F.get("w", at - 1).alias("left"), F.get("w", at + 1).alias("right"))
    )
    places = docs.select("_row", "n", F.inline(near)).join(sized_broadcast(prefix), "word").filter(
        (F.col("before").isNull() | (F.col("left") == F.col("before")))
        & (F.col("after").isNull() | (F.col("right") == F.col("after")))
    )
    candidates = staged(
        places.withColumn("start", F.col("pos") - F.col("place"))
        .filter("start >= 0 AND start + length <= n")
        .groupBy("_row")
        .agg(F.collect_set(F.struct("start", "length", "window")).alias("found")),  # places of one document
        "benchmark-candidates",
    )
    fits = F.expr("filter(found, f -> array_join(slice(w, f.start + 1, f.length), ' ') = f.window)")
    covered = F.expr("array_distinct(flatten(transform(found, f -> sequence(f.start, f.start + f.length - 1))))")
    # the words themselves move only for documents with candidates: first their numbers, then what they may hold
    asked = docs.select("_row", "w").join(sized_broadcast(candidates.select("_row")), "_row", "left_semi")
    hits = (
        asked.join(sized_broadcast(candidates), "_row")
        .select("_row", fits.alias("found"))
        .filter(F.size("found") > 0)
        .select(
            "_row",
            F.size(covered).cast("long").alias("n_hit"),
            F.array_distinct(F.transform("found", lambda f: f["window"])).alias("held"),
        )
    )
    hits = staged(hits, "benchmark-hits")
    items = (
        hits.select("_row", F.explode("held").alias("window"))
        .join(wanted.select("item_id", "window").filter("item_id IS NOT NULL"), "window")
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    marked = hits.select("_row", "n_hit").join(items, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return docs.select("_row", "doc_id", "n").join(marked, "_row", "left").select(
        "_row",
        "doc_id",
        F.col("n").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
