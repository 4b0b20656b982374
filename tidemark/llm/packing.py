"""Best-fit packing of documents into sequences, certified by lower bounds.

Pieces are dealt evenly to groups of bounded size. Each group is packed best-fit
decreasing, and dual feasible functions give a lower bound on its sequences. A
group that meets the bound keeps all but its emptiest sequence; a group with a
gap also gives up its emptiest ones. What is given up is exchanged: dealt to
fewer groups and packed again, until one group is left. Only lengths move
between machines, never texts.

Null texts are empty documents (the end id alone), repeated rows are packed like
any others, an empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import struct
import zlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_store, small_batches, staged
from .tokens import CHUNKS_KEPT, default_tokenizer, encoded

PER_GROUP = 4096  # pieces packed together; bounds a task's memory at any input size
GIVEN_UP = 4  # sequences given up per sequence above the bound


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most sequences that any of the dual feasible functions proves necessary."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    # f(x) = 1 above 1 - e, x between, 0 below e
    for low in np.unique(np.minimum(sizes, capacity - sizes)):
        if 0 < low <= capacity // 2:
            big = sizes > capacity - low
            middle = (sizes >= low) & ~big
            need = int(counts[big].sum()) * capacity + int((sizes * counts)[middle].sum())
            best = max(best, -(-need // capacity))
    # f(x) = x where (k + 1) x is whole, else floor((k + 1) x) / k
    for k in range(1, 21):
        scaled = sizes * (k + 1)
        whole = scaled % capacity == 0
        value = np.where(whole, sizes * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), dtype=np.int64)
    offsets = np.zeros(len(lengths), dtype=np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by what is left
    some = 0  # bit r is set while room[r] holds a sequence
    opened = 0
    sizes = lengths.tolist()
    for i in order.tolist():
        size = sizes[i]
        fitting = some >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            chosen = room[left].pop()
            if not room[left]:
                some ^= 1 << left
        else:
            left, chosen = capacity, opened
            opened += 1
        bins[i], offsets[i] = chosen, capacity - left
        left -= size
        if not room[left]:
            some |= 1 << left
        room[left].append(chosen)
    return bins, offsets


def pieces(
    documents: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, kept: int = CHUNKS_KEPT
) -> DataFrame:
    """Token counts of whole texts, cut only where a document is longer than a sequence.

    Returns doc_id, piece, start, length, ids_crc32.
    """
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)

    def cut(batches):
        import pyarrow as pa

        release_store(clear=False)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, coded in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1), kept=kept)):
                ids = coded + end
                n = len(ids) // 4
                for number, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, number, start, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return documents.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def solver(capacity: int, turn: int, last: bool):
    """Packs one group; ``_keep`` marks the pieces whose sequence is final."""

    def solve(key, rows):
        import pandas as pd

        lengths = rows["length"].to_numpy(dtype=np.int64)
        if not (1 <= lengths.min() and lengths.max() <= capacity):
            raise ValueError("lengths must be between 1 and the capacity")
        bins, offsets = best_fit_decreasing(lengths, capacity)
        count = int(bins.max()) + 1
        keep = np.ones(count, dtype=bool)
        if not last:
            fill = np.bincount(bins, weights=lengths, minlength=count)
            gap = count - lower_bound(lengths, capacity)
            emptiest = np.argsort(fill, kind="stable")[: 1 + GIVEN_UP * gap]
            keep[emptiest[fill[emptiest] < capacity]] = False
        return pd.DataFrame(
            {
                "_item": rows["_item"],
                "length": lengths,
                "sequence_id": (turn << 56) + (int(key[0]) << 24) + bins,
                "offset": offsets,
                "_keep": keep[bins],
            }
        )

    return solve


def pack(items: DataFrame, capacity: int = 4096, per_group: int = PER_GROUP) -> DataFrame:
    """Add sequence_id and offset to rows with a column ``length`` of 1 to ``capacity``."""
    names = {c.lower() for c in items.columns}
    clash = names & {"_item", "_group", "_round", "_keep", "sequence_id", "offset"}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are taken by the packing")
    items = staged(items.withColumn("_item", F.monotonically_increasing_id()), "pack-items")
    open_, left = items.select("_item", "length"), items.count()
    done: list[DataFrame] = []
    turn, settle = 0, False
    while left:
        groups = max(1, -(-left // per_group))
        dealt = open_.withColumn("_group", F.pmod(F.xxhash64("_item", F.lit(turn)), F.lit(groups)))
        solved = staged(
            dealt.groupBy("_group").applyInPandas(
                solver(capacity, turn, settle or groups == 1), "_item long, length long, sequence_id long, offset long, _keep boolean"
            ),
            "pack-round",
        )
        done.append(solved.filter("_keep").select("_item", "sequence_id", "offset"))
        open_ = solved.filter("NOT _keep").select("_item", "length")
        before, left = left, open_.count()
        turn += 1
        settle = left * 2 > before  # exchanging so much again would not pay: the next groups keep all they hold
    if not done:
        return items.drop("_item").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long"))
    placed = reduce(DataFrame.unionByName, done)
    return items.join(placed, "_item").drop("_item")


def pack_documents(
    documents: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096, kept: int = CHUNKS_KEPT
) -> DataFrame:
    """Pieces of all documents with the sequence and the offset where each is placed.

    ``kept`` chunks of text are remembered per worker: memory against time, never results.
    """
    with small_batches(documents.sparkSession):
        items = staged(pieces(documents, tokenizer, end_id, capacity, kept), "pieces")
    return pack(items, capacity)
