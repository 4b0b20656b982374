"""Near-duplicate classes by circulant MinHash, banding and exact verification.

Two permutations give all coordinates of a signature: the first scatters a
text's shingles, the second is shifted by one place per coordinate, and each
coordinate is the smallest image. Bands of coordinates are bucket keys. Texts
with equal shingle sets are one class from the start, so copies cost nothing.

Within buckets no group is multiplied out. A round links each class to the first
(then the last) class of its buckets; confirmed links join components. The last
two rounds compare what different components still share a bucket: pairs of small
buckets as rows, large buckets in blocks of classes inside tasks, where a pair is
looked at in its first common bucket only and counts only if it may reach
the threshold by its sizes, by its signatures, and by counts of shingles in 256
bins, which bound the common shingles from above. The first of them takes from each
block a spanning forest of its likest pairs, which joins families whose hubs are
unlike them by as many rows as they have members; the second takes all pairs
of what is still apart, so that no link is lost. Every link is confirmed on the
full sets. Very long texts are sets like others; of extra columns none is read. At similarity 0.8 a pair shares no bucket with a chance of about 1e-7,
and a signature errs by more than 0.2 with one of 1e-11.

Null and blank texts have no shingles and are linked with nothing. A null doc_id
is linked but names no component, unless all of a component are null. Rows that
repeat a doc_id get the same answer if their texts are linked. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_store, sized_broadcast, small_batches, staged
from .word_hash import Words, mixed, shingles

BANDS, ROWS = 40, 5
SLACK = 0.2  # a signature may underestimate by as much before exact sets decide
SMALL = 4  # classes in a bucket whose pairs are rows
CHUNK = 512  # classes of a larger bucket that meet as many others in one task
PAYLOAD = ["n", "keys", "sketch", "bins"]


def permuted(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """``size`` coordinates of a set; coordinate k uses the second permutation shifted by k."""
    scattered = (mixed(hashes, 7) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    least = np.full(size, np.iinfo(np.uint32).max, dtype=np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for start in range(0, len(scattered), 1024):
        least = np.minimum(least, permuted(scattered[None, start : start + 1024] + shifts).min(axis=1))
    return least


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    rows = coordinates.reshape(bands, -1).astype(np.uint64)
    key = mixed(np.arange(bands, dtype=np.uint64), 11)
    for k in range(rows.shape[1]):
        key = mixed(key ^ rows[:, k], 12 + k)
    return key.astype(np.int64)


def binned(hashes: np.ndarray) -> bytes:
    """How many shingles fall in each of 256 bins; all 255 if one holds more."""
    counts = np.bincount((mixed(hashes, 9) >> np.uint64(56)).astype(np.int64), minlength=256)
    return (counts if counts.max() < 256 else np.full(256, 255)).astype(np.uint8).tobytes()


def likeness(x: dict, y: dict, percent: int) -> np.ndarray:
    """Estimated similarities of the rows of two sides, -1 where it cannot be reached; arrays n, sketch, bins, row by row."""
    alike = (x["sketch"] == y["sketch"]).mean(axis=1)
    common = np.minimum(x["bins"], y["bins"]).sum(axis=1, dtype=np.int64)
    common[(x["bins"].min(axis=1) == 255) | (y["bins"].min(axis=1) == 255)] = np.iinfo(np.int32).max
    common = np.minimum(common, np.minimum(x["n"], y["n"]))
    possible = (alike >= percent / 100 - SLACK) & (100 * common >= percent * (x["n"] + y["n"] - common))
    return np.where(possible, alike, -1.0)


def forest(pairs: np.ndarray, alike: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of pairs of places the likest ones that join all that any of them join; equal labels are one already."""
    _, up = np.unique(labels, return_inverse=True)
    up = up.tolist()
    place = np.arange(len(up)).tolist()

    def top(k: int) -> int:
        while place[k] != k:
            place[k] = k = place[place[k]]
        return k

    chosen = []
    for at in np.lexsort((pairs[:, 1], pairs[:, 0], -alike)).tolist():
        a, b = (top(up[k]) for k in pairs[at])
        if a != b:
            place[a] = b
            chosen.append(at)
    return pairs[chosen]


def described(documents: DataFrame, shingle: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document doc_id, n, set (hash of its shingles, null if none), keys, sketch (a byte per coordinate), bins."""

    def describe(batches):
        import pyarrow as pa

        release_store()
        words = Words()
        for batch in batches:
            ids = batch.column(0)
            for row, hashes, begins in words.stretches(batch.column(1)):
                n, sets, keys, sketches, bins = [], [], [], [], []
                for own in shingles(hashes, begins, shingle):
                    n.append(len(own))
                    if not len(own):
                        for column in (sets, keys, sketches, bins):
                            column.append(None)
                        continue
                    sums = [int(mixed(own, s).sum(dtype=np.uint64)) for s in (1, 2)]
                    sets.append(b"".join(x.to_bytes(8, "little") for x in sums))
                    coordinates = signature(own, bands * rows)
                    keys.append(band_keys(coordinates, bands))
                    sketches.append(coordinates.astype(np.uint8).tobytes())
                    bins.append(binned(own))
                out = pa.RecordBatch.from_arrays(
                    [
                        ids.slice(row, len(n)), pa.array(n, pa.int64()), pa.array(sets, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(bins, pa.binary()),
                    ],
                    ["doc_id", "n", "set", "keys", "sketch", "bins"],
                )
                yield out
        release_store()

    return documents.select("doc_id", "text").mapInArrow(
        describe, "doc_id long, n long, set binary, keys array<long>, sketch binary, bins binary"
    )


def shingle_sets(documents: DataFrame, shingle: int) -> DataFrame:
    """(id, shingles): the sorted 64-bit shingle hashes of rows (id, text)."""

    def sets(batches):
        import pyarrow as pa

        words = Words()
        for batch in batches:
            for row, hashes, begins in words.stretches(batch.column(1)):
                found = [s.tobytes() for s in shingles(hashes, begins, shingle)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(found)), pa.array(found, pa.binary())], ["id", "shingles"]
                )
        release_store()

    return documents.select("id", "text").mapInArrow(sets, "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def confirm(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[row].as_buffer(), np.uint64) for c in (2, 3))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        release_store()

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        confirm, "a long, b long"
    )


def possible_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes, signatures and bins do not rule out."""

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            x, y = (
                {
                    "n": batch.column(2 + at).to_numpy(),
                    "sketch": stacked(batch.column(3 + at)),
                    "bins": stacked(batch.column(4 + at)),
                }
                for at in (0, 3)
            )
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(likeness(x, y, percent) >= 0, pa.bool_()))

    parts = ["n", "sketch", "bins"]
    left = classes.select(F.col("id").alias("a"), *[F.col(c).alias(f"x_{c}") for c in parts])
    right = classes.select(F.col("id").alias("b"), *[F.col(c).alias(f"y_{c}") for c in parts])
    order = ["a", "b", *[f"x_{c}" for c in parts], *[f"y_{c}" for c in parts]]
    return pairs.join(left, "a").join(right, "b").select(*order).mapInArrow(keep, "a long, b long")


def stacked(column) -> np.ndarray:
    """Equally long binaries as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id that links (a, b) reach, by contraction.

    Every id hooks on to its smallest neighbour's; links inside what has become
    one are dropped, so that the links left shrink at least by half a round.
    """
    ends = links.filter("a != b")
    edges = staged(ends.select("a", "b").union(ends.select("b", "a")).distinct(), "links")
    names = edges.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    while edges.limit(1).count():
        hooks = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("hook"))
        ahead = hooks.select(F.col("a").alias("hook"), F.col("hook").alias("far"))
        hooks = staged(hooks.join(ahead, "hook").select(F.col("a").alias("was"), F.col("far").alias("now")), "hooks")
        names = staged(renamed(names, "label", hooks), "labels")
        edges = staged(renamed(renamed(edges, "a", hooks), "b", hooks).filter("a != b").distinct(), "links")
    return names


def renamed(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``column`` with its values replaced where ``hooks`` (was, now) has them."""
    kept = [F.coalesce("now", column).alias(column) if c == column else c for c in df.columns]
    return df.join(hooks.withColumnRenamed("was", column), column, "left").select(*kept)


def joined_names(names: DataFrame, links: DataFrame) -> DataFrame:
    """``names`` (id, label) after more links, which need only join the labels known so far."""
    known = names.select(F.col("id").alias("was"), F.col("label").alias("now"))
    over = components(renamed(renamed(links, "a", known), "b", known))
    single = over.join(names.select("id"), "id", "left_anti")  # ids without a name so far
    merged = renamed(names, "label", over.select(F.col("id").alias("was"), F.col("label").alias("now")))
    return staged(merged.union(single), "near-dup-names")


def near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document doc_id, n_shingles, component_id (smallest linked doc_id), kept."""
    with small_batches(documents.sparkSession):
        rows = staged(described(documents, shingle), "near-dup-rows")
        classes = staged(
            rows.filter("set IS NOT NULL")
            .groupBy("set")
            .agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in PAYLOAD])
            .withColumn("id", F.monotonically_increasing_id()),
            "near-dup-classes",
        )
        names = linked_classes(documents, rows, classes, shingle, percent)
        labelled = classes.join(names, "id", "left").select("set", "low", F.coalesce("label", "id").alias("label"))
        lowest = labelled.groupBy("label").agg(F.min("low").alias("component_id"))
        answer = staged(labelled.join(lowest, "label").select("set", "component_id"), "near-dup-answer")
    linked = rows.filter("set IS NOT NULL").select("doc_id", "n", "set").join(answer, "set").drop("set")
    alone = rows.filter("set IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def linked_classes(documents: DataFrame, rows: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(id, label) of the classes that have links."""
    spark = documents.sparkSession
    keys = classes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("held"))
    members = staged(
        classes.select("id", "n", F.explode("keys").alias("key")).join(keys.filter("held > 1"), "key").drop("held"),
        "near-dup-members",
    )  # of buckets with more than one class
    names = spark.createDataFrame([], "id long, label long")
    tried = spark.createDataFrame([], "a long, b long")
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    for turn in ("first", "last", "likest", "all"):
        named = members.join(names, "id", "left").select("id", "n", "key", F.coalesce("label", "id").alias("label"))
        if turn in ("likest", "all"):
            pairs = unlike_pairs(staged(named, "near-dup-named"), classes, fits, percent, turn == "likest")
        else:
            pairs = hub_pairs(named, fits, turn == "first")
        pairs = staged(pairs.join(tried, ["a", "b"], "left_anti"), "near-dup-pairs")
        if not pairs.limit(1).count():
            continue
        used = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = texts_of(documents, rows, classes, used, shingle)
        names = joined_names(names, staged(confirmed(pairs, sets, percent), "near-dup-links"))
        tried = tried.union(pairs)  # of written tables
    return names


def without_near_duplicates(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents, whole rows, with the smallest doc_id of each component.

    Where doc_ids are missing or repeated, rows are told apart by their place instead.
    """
    ids = documents.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("named")).first()
    if ids["n"] == ids["named"]:
        found = near_duplicates(documents, shingle, percent)
        return documents.join(sized_broadcast(staged(found.filter("NOT kept").select("doc_id"), "dropped")), "doc_id", "left_anti")
    name = "_row"
    while name in documents.columns:
        name += "_"
    numbered = staged(documents.withColumn(name, F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(numbered.select(F.col(name).alias("doc_id"), "text"), shingle, percent)
    dropped = staged(found.filter("NOT kept").select(F.col("doc_id").alias(name)), "dropped")
    return numbered.join(sized_broadcast(dropped), name, "left_anti").drop(name)


def hub_pairs(named: DataFrame, fits, first: bool) -> DataFrame:
    """For each class one class of another component from its buckets: the first, or the last, by label."""
    pick = F.min if first else F.max
    hubs = named.groupBy("key").agg(pick(F.struct("label", "id", "n")).alias("hub"))
    met = named.join(hubs, "key").select(
        "id", "n", "label", F.col("hub.id").alias("other"), F.col("hub.n").alias("m"), F.col("hub.label").alias("theirs")
    )
    one = met.filter(F.col("label") != F.col("theirs")).filter(fits).groupBy("id").agg(pick("other").alias("other"))
    return one.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def unlike_pairs(named: DataFrame, classes: DataFrame, fits, percent: int, likest: bool = False) -> DataFrame:
    """Pairs of classes of different components that share a bucket and may be similar.

    With ``likest`` each block of a large bucket gives a forest of its likest pairs only.
    """
    counted = named.groupBy("key", "label").agg(F.count("*").alias("held"))
    buckets = staged(
        counted.groupBy("key")
        .agg(
            F.count("*").alias("labels"), F.sum("held").alias("held"),
            F.max(F.struct("held", "label")).alias("most"),
        )
        .filter("labels > 1"),
        "near-dup-buckets",
    )
    few = named.join(buckets.filter(F.col("held") <= SMALL).select("key"), "key")
    few = staged(few, "near-dup-few")
    other = few.select("key", F.col("id").alias("other"), F.col("n").alias("m"), F.col("label").alias("theirs"))
    rows = (
        few.join(other, "key")
        .filter("id < other AND label != theirs")
        .filter(fits)
        .select(F.col("id").alias("a"), F.col("other").alias("b"))
        .distinct()
    )
    return possible_pairs(rows, classes, percent).union(block_pairs(named, buckets, classes, percent, likest))


def block_pairs(named: DataFrame, buckets: DataFrame, classes: DataFrame, percent: int, likest: bool = False) -> DataFrame:
    """The same for large buckets: classes of the largest component there meet the others in blocks."""
    large = buckets.filter(F.col("held") > SMALL).select(
        "key",
        F.col("most.label").alias("main"),
        F.ceil(F.col("most.held") / CHUNK).alias("mains"),
        F.ceil((F.col("held") - F.col("most.held")) / CHUNK).alias("others"),
    )
    rows = named.join(large, "key").withColumn("ours", F.col("label") == F.col("main"))
    chunk = F.pmod(F.xxhash64("id"), F.when(F.col("ours"), F.col("mains")).otherwise(F.col("others")))
    rows = rows.withColumn("chunk", chunk)
    # unit (i, j): chunk i of the main component and chunk j of the others; unit (-1 - i, j): two chunks of others
    with_main = F.when(
        F.col("ours"),
        F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda j: F.struct(F.col("chunk").alias("i"), j.alias("j"))),
    ).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.struct(i.alias("i"), F.col("chunk").alias("j")))
    )
    among = F.when(
        ~F.col("ours") & (F.col("others") > 1),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.col("others") - 1), lambda j: j != F.col("chunk")),
            lambda j: F.struct((-1 - F.least(j, F.col("chunk"))).alias("i"), F.greatest(j, F.col("chunk")).alias("j")),
        ),
    ).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<i: BIGINT, j: BIGINT>>)"))
    units = rows.select("key", "id", "label", "ours", "chunk", F.explode(F.concat(with_main, among)).alias("unit")).select(
        "key", "id", "label", "ours", "chunk", "unit.i", "unit.j"
    )
    payload = classes.select("id", *PAYLOAD)

    def compare(rows):
        import pandas as pd

        key, first = rows["key"].iloc[0], rows["i"].iloc[0]
        ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        ours, chunks = rows["ours"].to_numpy(dtype=bool), rows["chunk"].to_numpy()
        side = {
            "n": rows["n"].to_numpy(dtype=np.int64),
            "sketch": np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(len(rows), -1),
            "bins": np.frombuffer(b"".join(rows["bins"]), np.uint8).reshape(len(rows), -1),
        }
        keys = np.stack(rows["keys"].to_numpy())
        band = int(np.flatnonzero(keys[0] == key)[0])
        found, alike = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        for k in np.flatnonzero(~ours).tolist():
            # the others meet the main chunk; a chunk of others meets itself in the unit of the first
            # main chunk, and another chunk of others in the unit of the two
            if first < 0:
                meets = (chunks != chunks[k]) & (ids > ids[k])
            else:
                meets = ours | (ids > ids[k]) if first == 0 else ours.copy()
            meets &= labels != labels[k]
            small, big = np.minimum(side["n"], side["n"][k]), np.maximum(side["n"], side["n"][k])
            meets &= 100 * small >= percent * big
            at = np.flatnonzero(meets)
            at = at[~(keys[at, :band] == keys[k, :band]).any(axis=1)]  # met in an earlier bucket
            if len(at):
                one = {c: np.repeat(v[k : k + 1], len(at), axis=0) for c, v in side.items()}
                like = likeness(one, {c: v[at] for c, v in side.items()}, percent)
                at, like = at[like >= 0], like[like >= 0]
                found.append(np.stack([np.full(len(at), k), at], axis=1))
                alike.append(like)
        pairs = np.concatenate(found)
        if likest:
            pairs = forest(pairs, np.concatenate(alike), labels)
        return pd.DataFrame({"a": ids[pairs].min(axis=1, initial=2**63 - 1), "b": ids[pairs].max(axis=1, initial=-1)})

    return units.join(payload, "id").groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def texts_of(documents: DataFrame, rows: DataFrame, classes: DataFrame, used: DataFrame, shingle: int) -> DataFrame:
    """Shingle sets of the classes in use, from one document of each."""
    chosen = staged(classes.join(used, "id").select("id", "set", "low"), "near-dup-chosen")
    unnamed = chosen.filter("low IS NULL").limit(1).count()
    if not unnamed:
        by_id = documents.select("doc_id", "text").join(
            sized_broadcast(chosen.select("id", F.col("low").alias("doc_id"))), "doc_id"
        )
        found = shingle_sets(by_id.select("id", "text"), shingle)
        repeated = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count()
        if not repeated:
            return staged(found, "near-dup-sets")
    # doc_ids that do not name one text: find the classes' texts by their sets
    return staged(sets_by_hash(documents, chosen, shingle), "near-dup-sets")


def sets_by_hash(documents: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    def sets(batches):
        import pyarrow as pa

        words = Words()
        for batch in batches:
            for _, hashes, begins in words.stretches(batch.column(0)):
                found = [s for s in shingles(hashes, begins, shingle) if len(s)]
                sums = [b"".join(int(mixed(x, s).sum(dtype=np.uint64)).to_bytes(8, "little") for s in (1, 2)) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sums, pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["set", "shingles"]
                )

    every = documents.select("text").mapInArrow(sets, "set binary, shingles binary")
    return every.join(chosen.select("id", "set"), "set").groupBy("id").agg(F.first("shingles").alias("shingles"))
