"""Document quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its pairs of neighbouring character classes (letters, digits,
blanks, line ends, every ASCII sign for itself) and its repetitions: words equal
to the one before, word pairs and lines seen earlier, and words that stand among
the ``WINDOW`` - 1 before them, whatever the text's length. Term frequencies, weighted by rarity, are projected on the leading
singular vectors of a bounded sample of labelled documents. Every document is
compared with every vector of that sample by exact cosines, a block at a time,
and the nearest neighbours' labels, weighted by similarity, are its score.

The sample is at most ``SAMPLE`` labelled rows, up to half of them of either
label, chosen by a hash of doc_id; it is the only thing that is bounded. A text without words has no vector and scores 0.
Null texts are empty. Repeated documents get equal scores; several labels of one
document count as the lowest; null labels are skipped. Without any labels of
both kinds every text scores the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import release_store, small_batches, staged
from .word_hash import Words, mixed

SAMPLE = 4096  # labelled documents that vote
DIMENSIONS = 48
NEIGHBOURS = 15
BLOCK = 2048  # documents compared at once
SIGNS = 8  # classes before those of the ASCII signs
CLASSES = 41
EXTRA = 4
WINDOW = 100  # words in which a word counts as repeated


def character_classes() -> np.ndarray:
    """The class of every byte."""
    table = np.full(256, 5, dtype=np.int64)  # control characters
    table[97:123], table[65:91], table[48:58] = 0, 1, 2
    table[32], table[10] = 3, 4
    table[128:192], table[192:256] = 6, 7
    signs = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[signs] = SIGNS + np.arange(len(signs))
    table[127] = CLASSES - 1
    return table


def frequencies(texts) -> np.ndarray:
    """A row of term frequencies for each text of an Arrow column; all zero without words."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    table, words = character_classes(), Words()
    pairs = CLASSES * CLASSES
    out = np.zeros((len(texts), pairs + EXTRA), dtype=np.float32)
    for row, hashes, begins in words.stretches(texts):
        n = len(begins) - 1
        for k, text in enumerate(texts.slice(row, n)):
            a, b = int(begins[k]), int(begins[k + 1])
            if a == b:
                continue
            data = text.as_buffer()
            classes = table[np.frombuffer(data, np.uint8)]
            mine = out[row + k]
            mine[:pairs] = np.bincount(classes[:-1] * CLASSES + classes[1:], minlength=pairs) / len(classes)
            own = hashes[a:b]
            two = mixed(own[:-1]) ^ own[1:]
            lines = bytes(data).split(b"\n")
            mine[pairs] = (own[:-1] == own[1:]).mean() if b - a > 1 else 0
            mine[pairs + 1] = 1 - len(np.unique(two)) / max(1, len(two))
            mine[pairs + 2] = 1 - len(set(lines)) / len(lines)
            places = np.argsort(own, kind="stable")
            again = (own[places[1:]] == own[places[:-1]]) & (np.diff(places) < WINDOW)
            mine[pairs + 3] = again.sum() / (b - a)
    return out


@dataclass
class Model:
    weights: np.ndarray  # of terms, by rarity
    axes: np.ndarray  # singular vectors
    points: np.ndarray  # unit vectors of the labelled documents
    labels: np.ndarray
    share: float  # of label 1

    def embed(self, terms: np.ndarray) -> np.ndarray:
        vectors = (np.log1p(1000 * terms) * self.weights) @ self.axes
        length = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)

    def vote(self, terms: np.ndarray) -> np.ndarray:
        scores = np.zeros(len(terms))
        if not len(self.points):
            scores[terms.any(axis=1)] = self.share
            return scores
        k = min(NEIGHBOURS, len(self.points))
        for start in range(0, len(terms), BLOCK):
            part = terms[start : start + BLOCK]
            cosine = self.embed(part) @ self.points.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosine, near, axis=1), 0, None).astype(np.float64) ** 8
            total = weight.sum(axis=1)
            voted = np.divide((weight * self.labels[near]).sum(axis=1), total, out=np.full(len(part), self.share), where=total > 0)
            scores[start : start + BLOCK] = np.where(part.any(axis=1), np.clip(voted, 0, 1), 0.0)
        return scores


def fit(documents: DataFrame, labels: DataFrame, learnable: Column, sample: int = SAMPLE) -> Model:
    """Learn from the labelled rows where ``learnable`` (of doc_id) holds."""
    known = (
        labels.filter(learnable)
        .filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    # as many rows of either label, so that the rarer one has neighbours to offer
    one, other = (
        known.filter(which).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2)
        for which in ("quality > 0", "quality <= 0")
    )
    chosen = one.union(other)

    def terms(batches):
        import pyarrow as pa

        for batch in batches:
            rows = frequencies(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["quality", "terms"]
            )

    found = (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows
        .groupBy("doc_id", "quality")
        .agg(F.min("text").alias("text"))
        .select("quality", "text")
        .mapInArrow(terms, "quality int, terms binary")
        .collect()  # at most ``sample`` rows
    )
    width = CLASSES * CLASSES + EXTRA
    x = np.array([np.frombuffer(r.terms, np.float32) for r in found]).reshape(-1, width)
    y = np.array([float(r.quality > 0) for r in found])
    y, x = y[x.any(axis=1)], x[x.any(axis=1)]
    share = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        none = np.zeros((0, 1), dtype=np.float32)
        return Model(np.zeros(width, np.float32), np.zeros((width, 1), np.float32), none, y[:0], share)
    weights = (np.log((len(x) + 1) / ((x > 0).sum(axis=0) + 1)) + 1).astype(np.float32)
    tall = np.log1p(1000 * x) * weights
    values, vectors = np.linalg.eigh(tall.T.astype(np.float64) @ tall)
    order = np.argsort(-values)[:DIMENSIONS]
    model = Model(weights, vectors[:, order].astype(np.float32), np.zeros((0, 1), np.float32), y, share)
    model.points = model.embed(x)
    # the order of rows must not matter to ties
    order = np.lexsort((*model.points.T[:4], y))
    model.points, model.labels = model.points[order], y[order]
    return model


def scorer(model: Model) -> Callable[[Column], Column]:
    """A column function from text to score."""

    @arrow_udf("double")
    def score(texts):
        import pyarrow as pa

        release_store()
        scores = []
        for start in range(0, len(texts), 512):
            scores.append(model.vote(frequencies(texts.slice(start, 512))))
        return pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())

    return lambda text: score(F.coalesce(text, F.lit("")))


def kept_rows(documents: DataFrame, labels: DataFrame, learnable: Column, threshold: float = 0.3) -> DataFrame:
    """The documents, whole rows, that score ``threshold`` or more, as a written table."""
    with small_batches(documents.sparkSession):
        score = scorer(fit(documents, labels, learnable))
        return staged(documents.filter(score(F.col("text")) >= threshold), "quality-kept")


def quality(documents: DataFrame, labels: DataFrame, learnable: Column, threshold: float = 0.3) -> DataFrame:
    """Per document doc_id, score and predicted (1 from ``threshold`` on)."""
    score = scorer(fit(documents, labels, learnable))
    return documents.select("doc_id", score(F.col("text")).alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )
