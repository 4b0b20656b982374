"""Exact top-k search by inner product: a Voronoi join of queries and data.

Data and queries are grouped by their nearest pivot. Summaries (count, radius,
largest norm) bound the inner products between a group of queries and a cell of
data from both sides: cells that surely hold k better vectors give each group a
bound, and a cell below the bound is never sent to the group. What is sent is
searched in blocks, exactly, in integers.

Vectors that are null, empty, or hold null or non-finite components take no
part; vectors of different lengths are never compared. Equal scores go to the
smaller id, so repeated vectors have a defined order; rows with the same id are
separate candidates, except that a query never meets its own id. An empty table
gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

PIVOTS = 32  # cells; the pivots are that many vectors of a bounded sample
SAMPLE = 1024
BLOCK = 4096  # vectors in a block of data; bounds a task's memory
QUERIES = 512  # queries in a block
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int) -> DataFrame:
    """Rows (id, v) with floor(scale * x) for every component."""
    v = F.col(vector_column)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    return vectors.filter(sound & F.col(id_column).isNotNull()).select(
        F.col(id_column).alias("id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"),
    )


def chosen_pivots(data: DataFrame, count: int, sample: int) -> np.ndarray:
    """Vectors far from each other, picked from a sample of fixed size."""
    rows = data.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    points = np.array([r.v for r in rows], dtype=np.float64)
    picked = [0]
    distance = ((points - points[0]) ** 2).sum(axis=1)
    while len(picked) < min(count, len(points)) and distance.max() > 0:
        picked.append(int(distance.argmax()))
        distance = np.minimum(distance, ((points - points[picked[-1]]) ** 2).sum(axis=1))
    return points[picked]


def blocked(data: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """Blocks of vectors of one cell: cell, ids, matrix, count, radius, own (the largest of a third column)."""

    def assign(batches):
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(cell):
            ids = np.concatenate([x[0] for x in held[cell]])
            matrix = np.concatenate([x[1] for x in held[cell]])
            own = max(int(x[2].max()) for x in held.pop(cell))
            radius = float(np.sqrt(((matrix - pivots[cell]) ** 2).sum(axis=1).max()))
            return pa.RecordBatch.from_pydict(
                {
                    "cell": pa.array([cell], pa.int32()),
                    "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                    "matrix": pa.array([matrix.astype("<f8").tobytes()], pa.binary()),
                    "count": pa.array([len(ids)], pa.int64()),
                    "radius": pa.array([radius], pa.float64()),
                    "own": pa.array([own], pa.int64()),
                }
            )

        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                ids = part.column(0).to_numpy()
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                copies = part.column(2).to_numpy() if part.num_columns > 2 else np.ones(len(ids), dtype=np.int64)
                far = (pivots**2).sum(axis=1) - 2 * matrix @ pivots.T
                cells = far.argmin(axis=1)
                for cell in np.unique(cells).tolist():
                    mine = cells == cell
                    held.setdefault(cell, []).append((ids[mine], matrix[mine], copies[mine]))
                    if sum(len(x[0]) for x in held[cell]) >= size:
                        yield block(cell)
        for cell in list(held):
            yield block(cell)

    return data.mapInArrow(assign, "cell int, ids binary, matrix binary, count long, radius double, own long")


def allowed(pivots: np.ndarray, cells: list, groups: list, k: int) -> list[tuple[int, int, float]]:
    """(group, cell, upper bound) of what a group of queries may need, from the summaries alone."""
    out = []
    for group, _, rho, own in groups:
        g = pivots[group]
        bounds = []
        for cell, count, radius, _ in cells:
            middle = float(g @ pivots[cell])
            slack = np.linalg.norm(g) * radius + rho * np.linalg.norm(pivots[cell]) + rho * radius
            slack += 1e-9 * (abs(middle) + slack)  # rounding must not lose a cell
            bounds.append((middle - slack, middle + slack, cell, count))
        # rows of a query's own id are left out of its search: at most ``own`` of the rows counted
        seen, floor = 0, -np.inf
        for low, _, _, count in sorted(bounds, reverse=True):
            seen += count
            if seen >= k + own:
                floor = low
                break
        out += [(group, cell, high) for _, high, cell, _ in bounds if high >= floor]
    return out


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    scale: int = 64,
    pivots: int = PIVOTS,
) -> DataFrame:
    """Each query's k largest inner products over all vectors but those of its own id.

    ``queries`` are rows of the same columns. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    kinds = "query_id long, vec_id long, score long"
    data = staged(quantised(vectors, id_column, vector_column, scale), "knn-data")
    repeated = data.groupBy("id").agg(F.count("*").alias("copies")).filter("copies > 1")
    wanted = quantised(queries, id_column, vector_column, scale).join(repeated, "id", "left")
    wanted = staged(wanted.select("id", "v", F.coalesce("copies", F.lit(1)).alias("copies")), "knn-queries")
    lengths = [r[0] for r in wanted.select(F.size("v")).distinct().orderBy(F.size("v")).limit(1000).collect()]
    if len(lengths) == 1000:
        raise ValueError("the queries have a thousand different lengths; these are not vectors of one space")
    parts = []
    for length in lengths:
        own = data.filter(F.size("v") == length)
        centres = chosen_pivots(own, pivots, SAMPLE) if own.limit(1).count() else None
        if centres is None:
            continue
        cells = staged(blocked(own, centres, BLOCK), "knn-cells")
        groups = staged(blocked(wanted.filter(F.size("v") == length), centres, QUERIES), "knn-groups")
        summary = [
            sorted(tuple(r) for r in x.groupBy("cell").agg(F.sum("count"), F.max("radius"), F.max("own")).collect())
            for x in (cells, groups)
        ]  # one row a cell
        plan = allowed(centres, *summary, k)
        needed = spark.createDataFrame([(g, c) for g, c, _ in plan], "group int, cell int")
        pairs = (
            groups.select(F.col("cell").alias("group"), F.col("ids").alias("q_ids"), F.col("matrix").alias("q"))
            .join(F.broadcast(needed), "group")  # at most pivots x pivots rows
            .join(cells.select("cell", "ids", "matrix"), "cell")
            .select("q_ids", "q", "ids", "matrix")
        )
        parts.append(pairs.mapInArrow(searcher(length, k), kinds))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if (np.abs(q).max(initial=0.0)) * (np.abs(x).max(initial=0.0)) * q.shape[1] < EXACT:
        return np.rint(q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return (whole(q) @ whole(x).T).astype(np.int64)


def searcher(length: int, k: int):
    """Local search of one block of queries in one block of data."""

    def search(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q, ids, x = (batch.column(c)[row].as_buffer() for c in range(4))
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                scores = products(np.frombuffer(q, "<f8").reshape(-1, length), np.frombuffer(x, "<f8").reshape(-1, length))
                order = np.argsort(ids, kind="stable")
                ids, scores = ids[order], scores[:, order]
                queries, best, values = [], [], []
                for i, query in enumerate(q_ids.tolist()):
                    own = np.flatnonzero(ids != query)
                    mine = scores[i, own]
                    if len(own) > k:
                        edge = np.partition(mine, len(mine) - k)[len(mine) - k]
                        above = np.flatnonzero(mine > edge)
                        ties = np.flatnonzero(mine == edge)[: k - len(above)]  # smallest ids first
                        take = np.concatenate([above, ties])
                    else:
                        take = np.arange(len(own))
                    queries += [query] * len(take)
                    best.append(ids[own[take]])
                    values.append(mine[take])
                if queries:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(queries, pa.int64()), pa.array(np.concatenate(best)), pa.array(np.concatenate(values))],
                        ["query_id", "vec_id", "score"],
                    )

    return search
