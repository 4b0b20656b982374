"""Ranked lexical search as an exact sparse ball-tree inner-product search.

Items and documents are sparse vectors over the items' terms: an item holds how
often it has a term, a document the term's saturated frequency; terms weigh by
rarity. Scores are inner products of the two in integers. Terms that no item has
cannot score and are left out of the vectors, so they do not widen the balls.

Documents are read once: each task turns whole texts into sparse rows, which are
written together with the texts' lengths; corpus counts are sums over those rows.
Then each task grows ball trees over its documents, a block at a time: a node has
the centroid of its documents and the radius that holds them all, and splits
along the line between two far documents. An item's score in a node is at most
``q.c + |q| r``. Nodes are visited best bound first and the search of a tree ends
at the first bound below the item's k-th best score so far; leaves are scored
exactly. Bounds are computed in doubles and rounded up by more than their
arithmetic can err; a node that may tie is visited. A term's weight can be put on
either side of the product without changing it; both forms are grown into the
tree's bounds and the smaller counts. The best of all tasks are ranked per item.

Items are taken in blocks of bounded size (``ITEM_BYTES`` of text), each with its
own pass, so any number of items may be asked. Terms are told apart by 64-bit
hashes (two of them are the same with a chance of about 1 in 10^18 a pair).

Null texts have no terms; they, texts without terms and empty tables count
nothing and get no rows. Items without terms, or whose terms no document holds,
have no rows. Repeated items and a null item_id are answered row by row. Rows that
repeat a doc_id are ranked each for itself; a null doc_id comes last among equal
scores. Very long texts are rows like others. Only the named columns are read, so
extra ones cannot clash.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release_store, staged
from .word_hash import Words

ITEM_BYTES = 4 << 20  # of items' texts searched for together
CELLS = 6 << 20  # numbers in a block's matrix of documents and terms
BLOCK = 4096  # documents of a tree at most
LEAF = 16
LAST = np.iinfo(np.int64).max  # stands for a null doc_id


class Terms(Words):
    """Splits texts into runs of letters, digits and all that is not ASCII."""

    def __init__(self):
        super().__init__()
        self.solid = np.zeros(256, dtype=bool)
        self.solid[[*b"0123456789", *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Items:
    """A block of items: their row numbers, ids and term counts over a sorted vocabulary."""

    rows: list[int]
    ids: list
    vocabulary: np.ndarray
    terms: list[np.ndarray]
    counts: list[np.ndarray]


def items_of(rows: list) -> Items:
    import pyarrow as pa

    hashes, begins, done = [], [0], 0
    for _, part, starts in Terms().stretches(pa.array([r.text for r in rows], pa.string())):
        hashes.append(part)
        begins.extend((starts[1:] + done).tolist())
        done += len(part)
    every = np.concatenate([np.zeros(0, np.uint64), *hashes])
    vocabulary, place = np.unique(every, return_inverse=True)
    own = [np.unique(place[a:b], return_counts=True) for a, b in zip(begins, begins[1:])]
    return Items([r._row for r in rows], [r.item_id for r in rows], vocabulary, [o[0] for o in own], [o[1] for o in own])


def blocks_of_items(items: DataFrame, most_bytes: int):
    """Blocks of items, as many as ``most_bytes`` of text allow; one block in the driver at a time."""
    numbered = staged(items.select("item_id", "text").withColumn("_row", F.monotonically_increasing_id()), "items")
    rows, held = [], 0
    for row in numbered.filter("text IS NOT NULL").toLocalIterator():
        size = 4 * len(row.text)
        if rows and held + size > most_bytes:
            yield items_of(rows)
            rows, held = [], 0
        rows.append(row)
        held += size
    if rows:
        yield items_of(rows)


def sparse_rows(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Per document with terms: doc_id, n of all its terms, and the places and counts of those in the vocabulary."""

    def rows(batches):
        import pyarrow as pa

        release_store()
        split = Terms()
        for batch in batches:
            for row, hashes, begins in split.stretches(batch.column(1)):
                n = np.diff(begins)
                at = np.searchsorted(vocabulary, hashes)
                at[at == len(vocabulary)] = 0
                known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(at), bool)
                key = np.repeat(np.arange(len(n)), n)[known] * np.int64(len(vocabulary) + 1) + at[known]
                key, count = np.unique(key, return_counts=True)
                text, term = np.divmod(key, len(vocabulary) + 1)
                cuts = np.searchsorted(text, np.arange(len(n) + 1)).tolist()
                term, count = term.astype("<u4"), count.astype("<u4")
                out = pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(n)), pa.array(n, pa.int64()),
                        pa.array([term[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([count[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    ["doc_id", "n", "terms", "counts"],
                )
                yield out.filter(pa.array(n > 0))
        release_store()

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        rows, "doc_id long, n long, terms binary, counts binary"
    )


def holding(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def count(batches):
        import pyarrow as pa

        held = np.zeros(size, np.int64)
        for batch in batches:
            held += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at], pa.int64())], ["term", "held"])

    out = np.zeros(size, np.int64)
    sums = rows.select("terms").mapInArrow(count, "term long, held long").groupBy("term").agg(F.sum("held").alias("held"))
    for row in sums.toLocalIterator():  # at most the vocabulary of a block of items
        out[row.term] = row.held
    return out


@dataclass
class Tree:
    """A ball tree over the rows of a matrix, in the order of its leaves."""

    order: np.ndarray
    begin: list[int]
    end: list[int]
    children: list[tuple[int, int] | None]
    centroids: np.ndarray
    radii: np.ndarray


def grown(points: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.arange(len(points))
    squares = np.einsum("ij,ij->i", points, points)
    # rounding of squared distances: relative to the numbers subtracted, over all terms
    slip = (points.shape[1] + 8) * 4e-16 * 4 * float(squares.max(initial=0.0))
    begin, end, children, centroids, radii = [0], [len(points)], [], [], []
    node = 0
    while node < len(begin):
        a, b = begin[node], end[node]
        own = points[order[a:b]]
        centroid = own.mean(axis=0)
        away = np.maximum(squares[order[a:b]] - 2 * (own @ centroid) + centroid @ centroid, 0)
        centroids.append(centroid)
        radii.append(math.sqrt(float(away.max(initial=0.0)) + slip) * (1 + 1e-9))
        if b - a <= leaf or not away.max() > slip:
            children.append(None)
        else:
            one = own[int(away.argmax())]
            other = own[int((squares[order[a:b]] - 2 * (own @ one)).argmax())]
            side = np.argsort(own @ (other - one), kind="stable")
            order[a:b] = order[a:b][side]
            middle = (a + b) // 2
            children.append((len(begin), len(begin) + 1))
            begin += [a, middle]
            end += [middle, b]
        node += 1
    return Tree(order, begin, end, children, np.array(centroids).reshape(len(begin), -1), np.array(radii))


class Search:
    """The best documents of every item among those seen so far."""

    def __init__(self, items: Items, weights: np.ndarray, k: int, leaf: int = LEAF):
        self.k, self.leaf = k, leaf
        self.items = items
        self.products = [weights[t] * c for t, c in zip(items.terms, items.counts)]
        self.best: list[list[tuple[int, int]]] = [[] for _ in items.rows]
        self.leaves = self.scored = 0  # leaves there were for all items, and those that were scored
        self.weights = weights.astype(np.float64)
        # the share of a term's weight that documents carry: half or all of it
        self.sides = []
        for share in (0.5, 1.0):
            asked = np.zeros((len(items.rows), len(weights)))
            for row, (t, c) in enumerate(zip(items.terms, items.counts)):
                asked[row, t] = c * self.weights[t] ** (1 - share)
            self.sides.append((self.weights**share, asked, np.sqrt((asked**2).sum(axis=1)) * (1 + 1e-9)))

    def see(self, names: np.ndarray, values: np.ndarray) -> None:
        """Look for better documents in a block: their ids and integer values per term."""
        scale, asked, length = self.sides[-1]
        tree = grown(values * scale, self.leaf)
        bounds = asked @ tree.centroids.T + length[:, None] * tree.radii
        for scale, asked, length in self.sides[:-1]:
            points = (values * scale)[tree.order]
            centroids = tree.centroids * (scale / np.maximum(self.sides[-1][0], 1e-300))
            bounds = np.minimum(bounds, asked @ centroids.T + length[:, None] * self.reach(points, tree, centroids))
        bounds = bounds * (1 + 1e-9) + 1
        names, values = names[tree.order], values[tree.order]
        leaves = sum(c is None for c in tree.children)
        for row in range(len(self.best)):
            if len(self.products[row]):
                self.leaves += leaves
                self.descend(row, tree, bounds[row].tolist(), names, values)

    def reach(self, points: np.ndarray, tree: Tree, centroids: np.ndarray) -> np.ndarray:
        """Radii of the tree's nodes around other centroids."""
        out = np.zeros(len(tree.begin))
        squares = np.einsum("ij,ij->i", points, points)
        slip = (points.shape[1] + 8) * 4e-16 * 4 * float(max(squares.max(initial=0.0), (centroids**2).sum(axis=1).max(initial=0.0)))
        for node, (a, b, centroid) in enumerate(zip(tree.begin, tree.end, centroids)):
            away = squares[a:b] - 2 * (points[a:b] @ centroid) + centroid @ centroid
            out[node] = math.sqrt(max(float(away.max(initial=0.0)), 0.0) + slip) * (1 + 1e-9)
        return out

    def descend(self, row: int, tree: Tree, bounds: list[float], names: np.ndarray, values: np.ndarray) -> None:
        best, terms, product = self.best[row], self.items.terms[row], self.products[row]
        ahead = [(-bounds[0], 0)]
        while ahead:
            bound, node = heapq.heappop(ahead)
            if len(best) == self.k and -bound < best[0][0]:
                return
            if (pair := tree.children[node]) is not None:
                for child in pair:
                    heapq.heappush(ahead, (-bounds[child], child))
                continue
            self.scored += 1
            a, b = tree.begin[node], tree.end[node]
            scores = values[a:b, terms] @ product
            floor = best[0][0] if len(best) == self.k else 1
            for at in np.flatnonzero(scores >= floor).tolist():
                found = (int(scores[at]), -int(names[a + at]))
                if len(best) < self.k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)


def saturated(n: np.ndarray, terms: list[bytes], counts: list[bytes], total: int, length: int, size: int) -> np.ndarray:
    """Integer values of a block of documents, a row each."""
    values = np.zeros((len(n), size), np.int64)
    for row, (own, t, c) in enumerate(zip(n.tolist(), terms, counts)):
        damping = 75 + 25 * own * total // length
        count = np.frombuffer(c, "<u4").astype(np.int64)
        values[row, np.frombuffer(t, "<u4")] = 1_000_000_000 * count // (1000 * count + 12 * damping)
    return values


def best_of_tasks(rows: DataFrame, items: Items, weights: np.ndarray, total: int, length: int, k: int) -> DataFrame:
    """(_row, item_id, doc_id, score): each task's best documents of every item."""
    size = len(items.vocabulary)
    block = max(LEAF, min(BLOCK, CELLS // max(1, size)))

    def look(batches):
        import pyarrow as pa

        search = Search(items, weights, k)
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                part = batch.slice(start, block)
                names = part.column(0).fill_null(LAST).to_numpy()
                n, terms, counts = (part.column(c) for c in (1, 2, 3))
                values = saturated(n.to_numpy(), terms.to_pylist(), counts.to_pylist(), total, length, size)
                search.see(names, values)
        for row, found in zip(range(len(items.rows)), search.best):
            names = [None if -d == LAST else -d for _, d in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([items.rows[row]] * len(found), pa.int64()), pa.array([items.ids[row]] * len(found), pa.int64()),
                    pa.array(names, pa.int64()), pa.array([s for s, _ in found], pa.int64()),
                ],
                ["_row", "item_id", "doc_id", "score"],
            )
        release_store()

    return rows.mapInArrow(look, "_row long, item_id long, doc_id long, score long")


def ranked(documents: DataFrame, items: DataFrame, k: int = 20, most_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per item its ``k`` best documents with a score above 0: item_id, rank, doc_id, score."""
    found = documents.sparkSession.createDataFrame([], "_row long, item_id long, doc_id long, score long")
    for block in blocks_of_items(items, most_bytes):
        rows = staged(sparse_rows(documents, block.vocabulary), "lexical-rows")
        whole = rows.agg(F.count("*").alias("total"), F.sum("n").alias("length")).first()
        if not whole.total:
            continue
        held = holding(rows, len(block.vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * whole.total + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)
        found = found.union(staged(best_of_tasks(rows, block, weights, whole.total, whole.length, k), "lexical-best"))
    order = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
