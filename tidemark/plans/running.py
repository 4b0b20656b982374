"""Running values per group that survive one group holding most of the rows.

A plain window sends all rows of a group to one task. Here a long group is cut
into chunks along its order: windows run per (group, chunk), each chunk leaves one
summary row, and a second window over the summaries gives every chunk what the
chunks before it add up to. The work is spread over as many tasks as there are
chunks, and only the summaries of a group meet in one place. Groups of aggregates
that are not long have no chunk (NULL) and are done with the one window: their rows
move once, and where no aggregate is long nothing but that window is left.

All rows of a lower chunk come before all rows of a higher one. Group columns
must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
CHUNK_FIELDS = ["stretch", "sequence", "stored"]
DEFAULT_WIDTH = 65_536

# An aggregate counts as long and a stretch as heavy beyond so many widths, and beyond this share of all rows.
HEAVY_WIDTHS = 4
MAX_HEAVY = 100_000
BUCKETS = 16_384  # hash buckets of ids that are counted to see whether an aggregate can be long

Assign = Callable[[DataFrame], DataFrame]


def _cut(position: str, width: int) -> Column:
    return F.floor(F.col(position) / F.lit(width)).cast("long")


def _beyond(sizes: DataFrame, width: int) -> DataFrame:
    """The sizes that count as long or heavy: a list that can be broadcast."""
    beyond = F.col("__size") > float(HEAVY_WIDTHS * width)
    if width < DEFAULT_WIDTH:
        # narrow cuts could leave many; of full width each has more than 262 144 rows
        share = sizes.agg(F.coalesce(F.sum("__size"), F.lit(0)) / MAX_HEAVY).scalar()
        beyond = beyond & (F.col("__size") > share)
    return F.broadcast(sizes.filter(beyond).drop("__size"))


def long_aggregates(events: DataFrame, width: int = DEFAULT_WIDTH) -> DataFrame:
    """The few aggregates of ``events`` that are worth cutting (``aggregate_id``), to be broadcast."""
    return _beyond(events.groupBy("aggregate_id").agg(F.count(F.lit(1)).alias("__size")), width)


def id_bucket() -> Column:
    """The hash bucket of an aggregate; events without one are in none."""
    return F.when(F.col("aggregate_id").isNotNull(), F.pmod(F.xxhash64("aggregate_id"), F.lit(BUCKETS)))


def maybe_long(largest_bucket: int | None, width: int) -> bool:
    """Whether an aggregate can be long, by the size of the largest bucket of ids."""
    return (largest_bucket or 0) > HEAVY_WIDTHS * width


def _largest_bucket(events: DataFrame) -> int | None:
    sizes = events.groupBy(id_bucket().alias("__bucket")).agg(F.count(F.lit(1)).alias("__size"))
    return sizes.filter(F.col("__bucket").isNotNull()).agg(F.max("__size").alias("most")).first().most


def event_chunks(events: DataFrame, width: int = DEFAULT_WIDTH, cut: bool | None = None) -> Assign:
    """How rows made from ``events`` are cut: long aggregates into stretches of ``width`` sequences.

    A stretch is small as long as (aggregate, sequence) is unique. Where copies
    make it heavy, it is cut further by sequence and position. Long aggregates are
    counted first, and heavy stretches among their rows; both lists are short (each
    entry has more than ``HEAVY_WIDTHS`` widths of rows) and broadcast. Rows of all
    other aggregates get no chunk.

    A pass over the ids comes first: where no hash bucket of them is as large as a long
    aggregate, nothing is cut and nothing is planned for it. ``cut`` is what a caller
    knows of that already.
    """
    if cut is None:
        cut = maybe_long(_largest_bucket(events), width)
    if not cut:
        nothing = F.lit(None).cast("struct<stretch:bigint,sequence:bigint,stored:bigint>")

        def leave(df: DataFrame) -> DataFrame:
            return df.withColumn(CHUNK, nothing)

        leave.cut = False
        return leave
    stretch = _cut("sequence_number", width)
    long = long_aggregates(events, width)
    sizes = (
        events.join(long, "aggregate_id", "left_semi")
        .groupBy("aggregate_id", stretch.alias("__stretch"))
        .agg(F.count(F.lit(1)).alias("__size"))
    )
    heavy = _beyond(sizes, width).withColumn("__heavy", F.lit(True))

    def assign(df: DataFrame) -> DataFrame:
        def if_heavy(value: Column) -> Column:
            return F.when(F.col("__heavy"), value).otherwise(F.lit(-1).cast("long"))

        marked = df.join(long.withColumn("__long", F.lit(True)), "aggregate_id", "left")
        placed = marked.withColumn("__stretch", F.when(F.col("__long"), stretch))
        joined = placed.join(F.broadcast(heavy), ["aggregate_id", "__stretch"], "left")
        chunk = F.struct(
            F.col("__stretch").alias("stretch"),
            if_heavy(F.col("sequence_number")).alias("sequence"),
            if_heavy(_cut("global_position", width)).alias("stored"),
        )
        return joined.select(*df.columns, F.when(F.col("__long"), chunk).alias(CHUNK))

    return assign


def cuts(assign: Assign | None) -> bool:
    """Whether an assignment gives any row a chunk."""
    return assign is not None and getattr(assign, "cut", True)


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    assign: Assign | None,
    *,
    sums: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    keep_chunks: bool = False,
) -> DataFrame:
    """Add running columns to ``df``.

    ``sums``: sum up to and including the row. ``latest``: last non-NULL value
    up to and including the row. ``previous``: last non-NULL value before the
    row. ``totals``: sum over the whole group. ``keep_chunks`` leaves the chunk
    in, so a second pass (without ``assign``) needs no new shuffle of the rows; where
    nothing is cut there is none.
    """
    sums, latest, previous, totals = (dict(x or {}) for x in (sums, latest, previous, totals))
    carried = {**latest, **previous}
    chunked = assign(df) if cuts(assign) else df
    is_cut = CHUNK in chunked.columns
    columns = [c for c in df.columns if c != CHUNK]
    group, order = list(group), list(order)
    part = [*group, CHUNK] if is_cut else group

    known = F.lit(True)  # a group with NULL has no totals
    for c in group:
        known = known & F.col(c).isNotNull()
    rows = Window.partitionBy(*part).orderBy(*order)
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = rows.rowsBetween(Window.unboundedPreceding, -1)
    inside = chunked.select(
        "*",
        *[F.sum(v).over(upto).alias(n) for n, v in sums.items()],
        *[F.last(v, ignorenulls=True).over(upto).alias(n) for n, v in latest.items()],
        *[F.last(v, ignorenulls=True).over(before).alias(n) for n, v in previous.items()],
        *[F.when(known, F.sum(v).over(Window.partitionBy(*part))).alias(f"__own_{n}") for n, v in totals.items()],
    )

    if not is_cut:
        return inside.select(
            *columns, *sums, *carried, *[F.col(f"__own_{n}").alias(n) for n in totals]
        )

    summaries = chunked.filter(F.col(CHUNK).isNotNull()).groupBy(*part).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(v).alias(f"__sum_{n}") for n, v in sums.items()],
        *[F.sum(v).alias(f"__total_{n}") for n, v in totals.items()],
        *[
            F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(f"__last_{n}")
            for n, v in carried.items()
        ],
    )
    earlier = _earlier(group)
    whole = Window.partitionBy(*group)
    carries = summaries.select(
        *part,
        F.sum("__rows").over(earlier).alias("__start"),
        *[F.sum(f"__sum_{n}").over(earlier).alias(f"__sum_{n}") for n in sums],
        *[F.last(f"__last_{n}", ignorenulls=True).over(earlier).alias(f"__last_{n}") for n in carried],
        *[F.sum(f"__total_{n}").over(whole).alias(f"__whole_{n}") for n in totals],
    )
    if not totals:
        # the first chunk of a group receives nothing: most groups drop out here
        carries = carries.filter(F.col("__start").isNotNull())

    return inside.join(carries.drop("__start"), part, "left").select(
        *columns,
        *[(F.col(n) + F.coalesce(f"__sum_{n}", F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(n, f"__last_{n}").alias(n) for n in carried],
        *[F.coalesce(f"__whole_{n}", f"__own_{n}").alias(n) for n in totals],
        *([CHUNK] if keep_chunks else []),
    )


def running_inside(
    chunked: DataFrame,
    rows: Callable[[DataFrame], DataFrame],
    group: Sequence[str],
    inner: Sequence[str],
    order: Sequence[str],
    *,
    latest: Mapping[str, Column] | None = None,
    previous: Mapping[str, Column] | None = None,
    cut: bool = True,
) -> DataFrame:
    """``latest`` and ``previous`` of ``running`` per (group, inner), for rows made from ``chunked`` events.

    ``rows`` makes any number of rows of each event and keeps the group. Events
    without a chunk are dealt by group before their rows are made, and all inner
    groups of a group share one sort: the many rows never move. Events of long
    groups take the way of ``running``.
    """
    latest, previous = dict(latest or {}), dict(previous or {})
    group, inner, order = list(group), list(inner), list(order)
    whole = chunked.filter(F.col(CHUNK).isNull()).drop(CHUNK).repartition(*group)
    line = Window.partitionBy(*group).orderBy(*inner, *order)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = line.rowsBetween(Window.unboundedPreceding, -1)

    def seen(value: Column, frame) -> Column:
        # the last value of any inner group: it counts if it is of this one
        return F.last(F.when(value.isNotNull(), F.struct(*inner, value.alias("__value"))), ignorenulls=True).over(frame)

    made = rows(whole)
    carried = {n: seen(v, upto) for n, v in latest.items()} | {n: seen(v, before) for n, v in previous.items()}
    beside = made.select("*", *[v.alias(f"__seen_{n}") for n, v in carried.items()])

    def of_this(name: str) -> Column:
        last = F.col(f"__seen_{name}")
        same = [last[c].eqNullSafe(F.col(c)) for c in inner]
        for c in same[1:]:
            same[0] = same[0] & c
        return F.when(same[0], last["__value"]).alias(name)

    short = beside.select(*made.columns, *[of_this(n) for n in carried])
    if not cut:
        return short
    long = rows(chunked.filter(F.col(CHUNK).isNotNull()))
    return short.unionByName(running(long, [*group, *inner], order, None, latest=latest, previous=previous))


def _earlier(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    assign: Assign,
    name: str,
    upto: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 1; with ``upto``, keep the first so many.

    Chunks that start beyond ``upto`` are dropped before anything is sorted.
    """
    if upto is None:
        return running(df, group, order, assign, sums={name: F.lit(1).cast("long")})
    group, order, part = list(group), list(order), [*group, CHUNK]
    if not cuts(assign):
        first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("long")
        return df.select("*", first.alias(name)).filter(F.col(name) <= upto)
    chunked = assign(df)
    starts = (
        chunked.filter(F.col(CHUNK).isNotNull())
        .groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(*part, F.coalesce(F.sum("__rows").over(_earlier(group)), F.lit(0)).alias("__start"))
        .filter(F.col("__start") < upto)
    )
    inside = Window.partitionBy(*part).orderBy(*order)
    return (
        chunked.join(starts, part, "left")
        .filter(F.col(CHUNK).isNull() | F.col("__start").isNotNull())
        .withColumn(name, (F.row_number().over(inside) + F.coalesce("__start", F.lit(0))).cast("long"))
        .filter(F.col(name) <= upto)
        .select(*df.columns, name)
    )
