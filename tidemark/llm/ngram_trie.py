"""Language-model scoring with an Elias-Fano n-gram trie in shards.

The model is a bigram model over words and an end mark:

    p(w | v) = (c(v, w) + mu * p1(w)) / (c(v) + mu),  p1(w) = (c(w) + 1) / (N + V + 1)

A shard's trie has two levels. The first holds the contexts v as an Elias-Fano
sequence with monotone Elias-Fano pointers to their successors; the second holds
the successors, made monotone by the place of their context, with one byte of
quantised log10 c(v, w) / (c(v) + mu) each, over a range that reaches down to one
occurrence after the most frequent context. A query finds the context, follows its
pointers and searches for the successor among that context's own. The levels lie
one after the other in a file that is memory-mapped.

Texts become blocks of tokens. Each block sends its distinct bigrams to the
shards of their contexts, a blob per shard; a shard merges the training counts,
builds its trie, answers every block and is gone. A context with a large share
of all tokens is split by successor, so no shard grows with one word. Counts
cover all training texts; nothing is sampled, pruned or capped.

Words are told apart by 64-bit hashes, successors of one context by 40 bits.
Null texts are empty (the end mark alone). Repeated rows count and are scored
each. An empty table gives no rows; without training texts every count is 0.
"""

from __future__ import annotations

import mmap
import struct
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import run_folder
from .elias_fano import EliasFano, encode
from .word_hash import Words, mixed

END = np.uint64(0x5EED0FE2D0C5EED5)  # the end mark's place among the words' hashes
BLOCK = 1 << 20  # tokens in a block
SHARD = 1 << 21  # tokens per shard
COMMON = 2000  # a word with one in so many tokens of a block is looked at for splitting
SPLITS = 64
HEAD = "<QQQ"  # where the pointers, the successors and the probabilities begin
SUCCESSOR_BITS = 40


class Trie:
    """Two levels over one buffer."""

    def __init__(self, buffer):
        pointers, successors, codes = struct.unpack_from(HEAD, buffer, 0)
        self.contexts = EliasFano(buffer, struct.calcsize(HEAD))
        self.pointers = EliasFano(buffer, pointers)
        self.successors = EliasFano(buffer, successors)
        self.codes = np.frombuffer(buffer, np.uint8, self.successors.n, codes)

    @staticmethod
    def build(contexts: np.ndarray, sizes: np.ndarray, successors: np.ndarray, codes: np.ndarray) -> bytes:
        """From sorted contexts, their numbers of successors, the successors in order, and their codes."""
        places = np.repeat(np.arange(len(contexts), dtype=np.uint64), sizes)
        levels = [
            encode(contexts),
            encode(np.concatenate([[0], np.cumsum(sizes)])),
            encode((places << np.uint64(SUCCESSOR_BITS)) | successors),
        ]
        ends = struct.calcsize(HEAD) + np.cumsum([len(x) for x in levels])
        return struct.pack(HEAD, *ends.tolist()) + b"".join(levels) + codes.tobytes()

    def lookup(self, contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
        """The code of each (context, successor), 0 where the trie does not hold it."""
        n = len(contexts)
        found = np.zeros(n, dtype=np.uint8)
        if not self.contexts.n or not n:
            return found
        alike, back = np.unique(contexts, return_inverse=True)
        place = self.contexts.successor(np.zeros(len(alike)), np.full(len(alike), self.contexts.n), alike)
        inside = place < self.contexts.n
        inside[inside] = self.contexts.select(place[inside]) == alike[inside]
        rows = np.flatnonzero(inside[back])
        at = place[back[rows]]
        wanted = (at.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors[rows]
        lo, hi = (self.pointers.select(at + k).astype(np.int64) for k in (0, 1))
        spot = self.successors.successor(lo, hi, wanted)
        real = spot < hi
        real[real] = self.successors.select(spot[real]) == wanted[real]
        found[rows[real]] = self.codes[spot[real]]
        return found


def lowest(common: dict[int, int], tokens: int, mu: float) -> float:
    """A log10 that no stored probability is below."""
    # a word that is not among the common ones makes up less than 2 / COMMON of all tokens
    most = max([*common.values(), 2 * tokens // COMMON])
    return -max(1.0, float(np.log10(most + mu)))


def quantise(logs: np.ndarray, low: float) -> np.ndarray:
    return (1 + np.rint(254 * (1 - np.clip(logs, low, 0.0) / low))).astype(np.uint8)


def restored(low: float) -> np.ndarray:
    """The probability of each code."""
    values = 10.0 ** (low * (1 - (np.arange(256) - 1) / 254))
    values[0] = 0.0
    return values


def short(x: np.ndarray) -> np.ndarray:
    return mixed(x, 3) >> np.uint64(64 - SUCCESSOR_BITS)


def packed(x: np.ndarray) -> bytes:
    """40-bit numbers in five bytes each."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), dtype=np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def narrow(x: np.ndarray) -> bytes:
    """Counts in one, two, four or eight bytes each; the first byte tells."""
    top = int(x.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def blocks_of(documents: DataFrame, training: Column, size: int = BLOCK) -> DataFrame:
    """Blocks of whole documents: ids, training flags, words per document, tokens, words, counts, common words."""

    def read(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        words = Words()
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        tokens = 0

        def block():
            hashes = np.concatenate([h[2] for h in held])
            lengths = np.concatenate([h[3] for h in held]).astype(np.int64)
            flags = np.concatenate([h[1] for h in held])
            vocabulary, index = np.unique(hashes, return_inverse=True)
            ends = np.cumsum(lengths)
            full = np.insert(index, ends, len(vocabulary))  # an end mark after each text
            trained = np.repeat(flags, lengths + 1)
            counts = np.bincount(full[trained], minlength=len(vocabulary) + 1)
            every = np.bincount(full, minlength=len(vocabulary) + 1)
            vocabulary = np.append(vocabulary, END)
            common = np.flatnonzero(every * COMMON >= len(full))
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([sum((h[0] for h in held), [])], pa.list_(pa.int64())),
                    "training": pa.array([flags.tobytes()], pa.binary()),
                    "lengths": pa.array([lengths.astype("<u4").tobytes()], pa.binary()),
                    "tokens": pa.array([full.astype("<u4").tobytes()], pa.binary()),
                    "words": pa.array([vocabulary.tobytes()], pa.binary()),
                    "counts": pa.array([narrow(counts)], pa.binary()),
                    "n_tokens": pa.array([len(full)], pa.int64()),
                    "n_trained": pa.array([int(trained.sum())], pa.int64()),
                    "common": pa.array([vocabulary[common].astype(np.int64).tolist()], pa.list_(pa.int64())),
                    "often": pa.array([every[common].tolist()], pa.list_(pa.int64())),
                }
            )

        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), np.array(batch.column(2).to_pylist(), dtype=bool)
            for row, hashes, begins in words.stretches(batch.column(1)):
                n = len(begins) - 1
                held.append((ids[row : row + n], flags[row : row + n], hashes, np.diff(begins)))
                tokens += len(hashes) + n
                if tokens >= size:
                    yield block()
                    number, held, tokens = number + 1, [], 0
        if held:
            yield block()

    return documents.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("t")).mapInArrow(
        read,
        "block long, doc_ids array<long>, training binary, lengths binary, tokens binary, words binary, "
        "counts binary, n_tokens long, n_trained long, common array<long>, often array<long>",
    )


def common_words(blocks: DataFrame) -> dict[int, int]:
    """Training counts of the words with a large share of all tokens, the end mark among them; at most 2000."""
    total = blocks.agg(F.sum("n_tokens")).first()[0] or 0
    pairs = blocks.select(F.explode(F.arrays_zip("common", "often")).alias("x")).select("x.common", "x.often")
    chosen = {
        r[0] & 0xFFFFFFFFFFFFFFFF
        for r in pairs.groupBy("common").agg(F.sum("often").alias("n")).filter(F.col("n") * COMMON >= total).select("common").collect()
    } | {int(END)}
    wanted = np.array(sorted(chosen), dtype=np.uint64)

    def count(batches):
        import pyarrow as pa

        sums = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for words, counts in zip(batch.column(0), batch.column(1)):
                words, counts = np.frombuffer(words.as_py(), np.uint64), widened(counts.as_py())
                place = np.minimum(np.searchsorted(wanted, words), len(wanted) - 1)
                hit = wanted[place] == words
                np.add.at(sums, place[hit], counts[hit])
        yield pa.RecordBatch.from_pydict({"word": wanted.astype(np.int64), "n": sums})

    summed = blocks.select("words", "counts").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in summed.collect()}  # one row a common word
    return {int(w): found.get(int(w), 0) for w in wanted}


class Routes:
    """A block's distinct bigrams in the order in which they are sent to the shards."""

    def __init__(self, tokens: np.ndarray, words: np.ndarray, common: np.ndarray, shards: int):
        end = len(words) - 1
        context = np.concatenate([[end], tokens[:-1]]).astype(np.uint64)
        keys, self.back = np.unique((context << np.uint64(32)) | tokens.astype(np.uint64), return_inverse=True)
        self.v, self.w = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        split = np.isin(words, common)
        part = np.where(split[self.v], words[self.w] % np.uint64(SPLITS), np.uint64(0))
        shard = mixed(words[self.v] + part, 5) % np.uint64(shards)
        self.order = np.argsort(shard, kind="stable")
        self.cuts = np.searchsorted(shard[self.order], np.arange(shards + 1, dtype=np.uint64))


def asked(blocks: DataFrame, common: dict[int, int], shards: int) -> DataFrame:
    """Rows (shard, block, contexts, sizes, successors, counts): a block's bigrams for one shard."""
    often = np.array(sorted(common), dtype=np.uint64)

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                block, flags, lengths, tokens, words = (batch.column(c)[row].as_py() for c in range(5))
                words = np.frombuffer(words, np.uint64)
                routes = Routes(np.frombuffer(tokens, "<u4"), words, often, shards)
                trained = np.repeat(np.frombuffer(flags, bool), np.frombuffer(lengths, "<u4").astype(np.int64) + 1)
                counts = np.bincount(routes.back[trained], minlength=len(routes.v))
                brief = short(words)
                out: list[tuple] = []
                for shard in np.flatnonzero(np.diff(routes.cuts)).tolist():
                    mine = routes.order[routes.cuts[shard] : routes.cuts[shard + 1]]
                    contexts, sizes = np.unique(routes.v[mine], return_counts=True)
                    out.append(
                        (
                            shard, block, words[contexts].tobytes(), narrow(sizes),
                            packed(brief[routes.w[mine]]), narrow(counts[mine]),
                        )
                    )
                kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
                names = ["shard", "block", "contexts", "sizes", "successors", "counts"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return blocks.select("block", "training", "lengths", "tokens", "words").mapInArrow(
        ask, "shard int, block long, contexts binary, sizes binary, successors binary, counts binary"
    )


def shard_answers(common: dict[int, int], mu: float, low: float):
    """Build one shard's trie from all blocks' counts and answer the blocks from it."""
    often = np.array(sorted(common), dtype=np.uint64)
    often_counts = np.array([common[int(w)] for w in often], dtype=np.int64)

    def answer(rows):
        import pandas as pd

        contexts = [np.frombuffer(x, np.uint64) for x in rows["contexts"]]
        sizes = [widened(x) for x in rows["sizes"]]
        v = np.concatenate([np.repeat(c, s) for c, s in zip(contexts, sizes)])
        w = np.concatenate([unpacked(x) for x in rows["successors"]])
        c = np.concatenate([widened(x) for x in rows["counts"]])
        # merge the training counts of equal bigrams
        seen = c > 0
        names, place = np.unique(v[seen], return_inverse=True)
        key = (place.astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | w[seen]
        keys, back = np.unique(key, return_inverse=True)
        counts = np.bincount(back, weights=c[seen], minlength=len(keys)).astype(np.int64)
        owner = (keys >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
        totals = np.bincount(owner, weights=counts, minlength=len(names)).astype(np.int64)
        spot = np.minimum(np.searchsorted(often, names), len(often) - 1)
        split = often[spot] == names
        totals[split] = often_counts[spot[split]]  # a split context is counted in many shards
        logs = np.log10(counts / (totals[owner] + mu)) if len(keys) else np.zeros(0)
        data = Trie.build(
            names, np.bincount(owner, minlength=len(names)), keys & np.uint64((1 << SUCCESSOR_BITS) - 1),
            quantise(logs, low),
        )
        with tempfile.TemporaryFile() as file:  # a nameless file of this task, mapped while it answers
            file.write(data)
            file.flush()
            with mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ) as mapped:
                trie = Trie(mapped)
                codes = trie.lookup(v, w)
                del trie
        at = np.concatenate([[0], np.cumsum([s.sum() for s in sizes])]).tolist()
        answers = []
        for own in contexts:
            place = np.minimum(np.searchsorted(names, own), max(0, len(names) - 1))
            hit = names[place] == own if len(names) else np.zeros(len(own), bool)
            answers.append(narrow(np.where(hit, totals[place] if len(names) else 0, 0)))
        first = np.zeros(len(rows), dtype=np.int64)
        first[0] = int((~split).sum())
        return pd.DataFrame(
            {
                "block": rows["block"], "shard": rows["shard"],
                "codes": [codes[a:b].tobytes() for a, b in zip(at, at[1:])],
                "totals": answers, "distinct": first,
            }
        )

    return answer


def finisher(common: dict[int, int], shards: int, trained: int, distinct: int, mu: float, low: float):
    """Put a block's answers together into scores of its documents."""
    often = np.array(sorted(common), dtype=np.uint64)
    often_counts = np.array([common[int(w)] for w in often], dtype=np.int64)

    def finish(block, answers):
        import pandas as pd

        row = block.iloc[0]
        words, tokens = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], "<u4")
        routes = Routes(tokens, words, often, shards)
        codes = np.zeros(len(routes.v), dtype=np.uint8)
        counts = np.zeros(len(words), dtype=np.int64)
        for shard, own, totals in zip(answers["shard"], answers["codes"], answers["totals"]):
            mine = routes.order[routes.cuts[shard] : routes.cuts[shard + 1]]
            codes[mine] = np.frombuffer(own, np.uint8)
            counts[np.unique(routes.v[mine])] = widened(totals)
        spot = np.minimum(np.searchsorted(often, words), len(often) - 1)
        split = often[spot] == words
        counts[split] = often_counts[spot[split]]
        single = (counts + 1.0) / (trained + distinct + 1.0)
        pair = restored(low)[codes] + mu / (counts[routes.v] + mu) * single[routes.w]
        lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64) + 1
        begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flags = np.frombuffer(row["training"], bool)
        return pd.DataFrame(
            {
                "doc_id": pd.array(row["doc_ids"], dtype="Int64"),
                "held_out": ~flags,
                "n_tokens": lengths,
                "n_known": np.add.reduceat((counts[tokens] > 0).astype(np.int64), begins),
                "train_tokens": np.int64(trained),
                "base_score": np.add.reduceat(np.log10(single)[tokens], begins),
                "score": np.add.reduceat(np.log10(pair)[routes.back], begins),
            }
        )

    return finish


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(documents: DataFrame, training: Column, mu: float = 1000.0) -> DataFrame:
    """Train on the rows where ``training`` holds and score every row."""
    spark = documents.sparkSession
    path = run_folder(spark, "lm-blocks")
    blocks_of(documents, training).write.option("compression", "zstd").parquet(path)
    blocks = spark.read.parquet(path)
    every, trained = blocks.agg(F.sum("n_tokens"), F.sum("n_trained")).first()
    if not every:
        return spark.createDataFrame([], RESULT)
    common = common_words(blocks)
    low = lowest(common, every, mu)
    shards = max(12, -(-every // SHARD))
    path = run_folder(spark, "lm-answers")
    asked(blocks, common, shards).groupBy("shard").applyInPandas(
        shard_answers(common, mu, low), "block long, shard int, codes binary, totals binary, distinct long"
    ).write.parquet(path)
    answers = spark.read.parquet(path)
    distinct = answers.agg(F.sum("distinct")).first()[0] + sum(n > 0 for n in common.values())
    sent = blocks.select("block", "doc_ids", "training", "lengths", "tokens", "words")
    return (
        sent.groupBy("block")
        .cogroup(answers.select("block", "shard", "codes", "totals").groupBy("block"))
        .applyInPandas(finisher(common, shards, trained, distinct, mu, low), RESULT)
    )
