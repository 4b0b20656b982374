"""Periodic runs of words by a sparse diagonal table over lags.

Words match their earlier occurrences; matches at one lag that follow each other
are a diagonal, and a diagonal of at least as many matches as its lag is a run: a
stretch with that period that goes on for two periods or more and cannot be made
longer. Positions are taken in order, every match makes the diagonal of its lag
longer, and a diagonal that ends is a run at once if it is long enough.

Only lags that can still become runs are active. A diagonal of lag ``q`` needs
``q`` matches in a row, so from lag 8 on an earlier occurrence counts only if the
next ``g`` words are alike too, ``g`` being the power of two up to ``q``. Equal
stretches of ``g`` words are told by ranks that double from level to level, and
positions whose stretch stands once are dropped for good. Occurrences that follow
each other by half a stretch or less lie in one run of a shorter period, so lags
between them are no smallest periods and are left out; a text of one word repeated
has no active lag beyond 7. The same stretch found at several lags has the
smallest as its period.

Texts of a batch are laid end to end, parted by words that occur nowhere else, and
looked at together; no text is cut. Words are compared as they stand, by value.

Null texts, empty and blank ones have no words, no runs and an empty collapsed
text. Repeated rows and doc_ids are answered row by row, a null doc_id like any
other. An empty table gives no rows. Only the named columns are read, so extra
ones cannot clash. Runs come in the order of start, then period.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .common import release_store
from .word_hash import mixed

TOGETHER = 1 << 17  # words of texts looked at together; a longer text is looked at alone
DENSE = 8  # lags below it are compared word by word


def alike(lag: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where diagonals of ``lag`` begin (at the earlier words) and how many matches they have."""
    if len(ids) <= lag:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], ids[lag:] == ids[:-lag], [False]])))
    return turns[::2], turns[1::2] - turns[::2]


def repeated(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``DENSE`` words stand there again, and the rank of these words."""
    n = len(ids) - DENSE + 1
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spread = mixed(ids.astype(np.uint64))
    key = np.zeros(n, np.uint64)
    for k in range(DENSE):
        key = mixed(key ^ spread[k : k + n], k)
    # equal words have equal keys: what stands alone by key stands alone; the rest is compared by words
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    at = np.sort(order[np.concatenate([same, [False]]) | np.concatenate([[False], same])])
    if not len(at):
        return at, at
    rows = ids[at[:, None] + np.arange(DENSE)]
    rank = np.unique(np.ascontiguousarray(rows).view([("", rows.dtype)] * DENSE), return_inverse=True)[1].ravel()
    return shared(at, rank)


def shared(at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the ranks that one position has alone."""
    keep = np.bincount(rank)[rank] > 1 if len(rank) else np.zeros(0, bool)
    return at[keep], rank[keep]


def doubled(at: np.ndarray, rank: np.ndarray, size: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """From stretches of ``size`` words to stretches of twice as many."""
    table = np.full(n + size, -1, np.int64)
    table[at] = rank
    second = table[at + size]
    at, rank, second = at[second >= 0], rank[second >= 0], second[second >= 0]
    if not len(at):
        return at, rank
    return shared(at, np.unique(rank * (second.max() + 1) + second, return_inverse=True)[1].ravel())


def matches(at: np.ndarray, rank: np.ndarray, size: int):
    """Yield (lag, later position) of equal stretches, for lags from ``size`` up to twice that."""
    order = np.lexsort((at, rank))
    at, rank = at[order], rank[order]
    step = np.arange(len(at))
    again = np.concatenate([[False], rank[1:] == rank[:-1]])
    near = again & (np.diff(at, prepend=at[:1]) <= size // 2)
    first = np.maximum.accumulate(np.where(again, 0, step))
    earlier = np.maximum.accumulate(np.where(near, 0, step)) - 1  # the last one before those in the same run
    while len(step):
        keep = earlier >= first[step]
        step, earlier = step[keep], earlier[keep]
        lag = at[step] - at[earlier]
        keep = lag < 2 * size
        step, earlier, lag = step[keep], earlier[keep], lag[keep]
        yield lag[lag >= size], at[step[lag >= size]]
        earlier = earlier - 1


def runs(ids: np.ndarray, longest: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``least`` words or more, by start and period.

    ``longest`` bounds the length of a run.
    """
    found = []
    for lag in range(1, min(DENSE, longest // 2 + 1)):
        start, count = alike(lag, ids)
        long = count >= max(lag, least - lag)
        found.append(np.stack([start[long], count[long] + lag, np.full(long.sum(), lag)], axis=1))
    size, (at, rank) = DENSE, repeated(ids) if longest >= 2 * DENSE else (np.zeros(0, np.int64),) * 2
    while len(at) and 2 * size <= longest:
        parts = list(matches(at, rank, size))
        lag, later = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((later, lag))
        lag, later = lag[order], later[order]
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(lag) != 0) | (np.diff(later) != 1)])[: len(lag)])
        count = np.diff(begins, append=len(lag)) + size - 1
        lag, start = lag[begins], later[begins] - lag[begins]
        long = count >= np.maximum(lag, least - lag)
        found.append(np.stack([start, count + lag, lag], axis=1)[long])
        at, rank = doubled(at, rank, size, len(ids))
        size *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    other = np.ones(len(rows), bool)
    other[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)  # of one stretch only the smallest period
    rows = rows[other]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words without what repeats the first period of a run, joined by one blank."""
    if len(found):
        edges = np.zeros(len(words) + 1, np.int64)
        np.add.at(edges, found[:, 0] + found[:, 2], 1)
        np.add.at(edges, found[:, 0] + found[:, 1], -1)
        words = [w for w, covered in zip(words, np.cumsum(edges[:-1]).tolist()) if not covered]
    return b" ".join(words)


def looked_at(texts: list[list[bytes]], least: int):
    """Yield (runs, collapsed text) for texts given as lists of words."""
    index: dict[bytes, int] = {}
    number = index.setdefault
    ids: list[int] = []
    begins = []
    for k, words in enumerate(texts):
        begins.append(len(ids))
        ids.extend([number(w, len(index)) for w in words])
        ids.append(-1 - k)  # a word of its own ends every text
    found = runs(np.array(ids, np.int64), max(map(len, texts)), least)
    cuts = np.searchsorted(found[:, 0], [*begins, len(ids)])
    for words, begin, a, b in zip(texts, begins, cuts, cuts[1:]):
        own = found[a:b] - np.array([begin, 0, 0])
        yield own, collapsed(words, own)


def periodic_runs(documents: DataFrame, least: int = 12) -> DataFrame:
    """Per document doc_id, runs (start, length, period of each) and collapsed, its text without repetitions.

    Runs have ``least`` words or more and two periods or more. Words are what blanks
    (space, tab, line ends) part.
    """

    def look(batches):
        import pyarrow as pa

        def out(ids, texts):
            spans, ends, left = [np.zeros((0, 3), np.int64)], [0], []
            for own, text in looked_at(texts, least):
                spans.append(own)
                ends.append(ends[-1] + len(own))
                left.append(text)
            columns = np.concatenate(spans).T
            pieces = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)
            text = pa.array(left, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([ids, lists, text], ["doc_id", "runs", "collapsed"])

        release_store()
        for batch in batches:
            texts, row, held = [], 0, 0
            for at, text in enumerate(batch.column(1)):
                value = text.as_buffer() if text.is_valid else None
                words = bytes(value).split() if value is not None else []
                if texts and held + len(words) > TOGETHER:
                    yield out(batch.column(0).slice(row, len(texts)), texts)
                    texts, row, held = [], at, 0
                texts.append(words)
                held += len(words) + 1
            if texts:
                yield out(batch.column(0).slice(row, len(texts)), texts)
        release_store()

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        look, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
