"""Token-id files: concatenated ids with Elias-Fano document boundaries.

A file holds consecutive documents in ascending doc_id order: a head, the
Elias-Fano coded ends of the documents, their doc_ids, then the ids, two bytes
each where the vocabulary allows it. Document i spans ``select(i-1)`` to
``select(i)``; no table of 64-bit offsets is kept.

Null texts are empty documents (the end id alone); null doc_ids come first;
repeated doc_ids keep one entry per row, ordered by text. An empty table gives no
files with documents. Columns other than doc_id and text are not read, so extra
columns cannot clash.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import run_folder
from .common import read_files, staged, write_files
from .elias_fano import EliasFano, encode
from .tokens import default_tokenizer, encoded

MAGIC = b"EFTOKEN1"
HEAD = "<8sBB6xqqQQQ"  # magic, id width, nulls, partition, file, documents, tokens, bytes of doc_ids
HEAD_SIZE = struct.calcsize(HEAD)
FILE_TOKENS = 1 << 22  # a file is closed once it holds as many


def pack_file(partition: int, number: int, doc_ids: list, ids: list[bytes]) -> bytes:
    """One file's bytes from doc_ids and 32-bit ids per document."""
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    ends = np.cumsum([len(x) // 4 for x in ids])
    nulls = sum(d is None for d in doc_ids)
    known = zlib.compress(np.array([d for d in doc_ids if d is not None], dtype="<i8").tobytes(), 1)
    head = struct.pack(HEAD, MAGIC, width, nulls > 0, partition, number, len(ids), len(flat), len(known))
    mask = np.packbits(np.array([d is None for d in doc_ids], dtype=np.uint8)).tobytes() if nulls else b""
    return head + encode(ends) + known + mask + flat.astype(f"<u{width}").tobytes()


class TokenFile:
    """A file's documents, read in place from a buffer."""

    def __init__(self, buffer):
        magic, self.width, nulls, self.partition, self.number, self.documents, self.tokens, known = struct.unpack_from(HEAD, buffer)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        self.ends = EliasFano(buffer, HEAD_SIZE)
        at = HEAD_SIZE + self.ends.size
        ids = np.frombuffer(zlib.decompress(buffer[at : at + known]), "<i8").tolist()
        at += known
        if nulls:
            size = (self.documents + 7) // 8
            mask = np.unpackbits(np.frombuffer(buffer, np.uint8, size, at))[: self.documents]
            left = iter(ids)
            ids = [None if m else next(left) for m in mask]
            at += size
        self.doc_ids = ids
        self.ids = np.frombuffer(buffer, f"<u{self.width}", self.tokens, at)

    def bounds(self):
        """Where consecutive documents begin and the last of them ends, a run of documents at a time."""
        at = 0
        for ends in self.ends.runs():
            yield np.concatenate([[at], ends.astype(np.int64)])
            at = int(ends[-1])

    def document(self, index: int) -> np.ndarray:
        start = int(self.ends.select([index - 1])[0]) if index else 0
        return self.ids[start : int(self.ends.select([index])[0])]


def write_token_files(documents: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, file_tokens: int = FILE_TOKENS) -> None:
    """Encode every whole text and write the files of a folder, range-partitioned by doc_id."""
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)

    def files(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        number = held = 0
        doc_ids: list = []
        ids: list[bytes] = []
        for batch in batches:
            for doc_id, coded in zip(batch.column(0).to_pylist(), encoded(tokenizer, batch.column(1))):
                doc_ids.append(doc_id)
                ids.append(coded + end)
                held += len(ids[-1]) // 4
                if held >= file_tokens:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_file(partition, number, doc_ids, ids)], pa.binary())], ["content"])
                    number, held, doc_ids, ids = number + 1, 0, [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([pack_file(partition, number, doc_ids, ids)], pa.binary())], ["content"])

    ordered = (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    write_files(ordered.mapInArrow(files, "content binary"), path, per_file=1)


def read_token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a folder's files: doc_id, start over all files, n_tokens, ids_crc32."""

    def documents(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                if len(data) < HEAD_SIZE:  # a partition without rows
                    continue
                file = TokenFile(data)
                done = 0
                for bounds in file.bounds():
                    n = len(bounds) - 1
                    crc = [zlib.crc32(file.ids[a:b].astype("<u4")) for a, b in zip(bounds[:-1], bounds[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file.partition] * n, pa.int64()),
                            pa.array([file.number] * n, pa.int64()),
                            pa.array(file.doc_ids[done : done + n], pa.int64()),
                            pa.array(bounds[:-1], pa.int64()),
                            pa.array(np.diff(bounds), pa.int64()),
                            pa.array(crc, pa.int64()),
                        ],
                        ["part", "number", "doc_id", "local", "n_tokens", "ids_crc32"],
                    )
                    done += n

    rows = staged(
        read_files(spark, path).mapInArrow(
            documents, "part long, number long, doc_id long, local long, n_tokens long, ids_crc32 long"
        ),
        "token-index",
    )
    # two levels of running totals: files within a partition, then partitions
    sizes = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    part_starts = parts.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("part_start"))
    starts = (
        sizes.withColumn("file_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(part_starts, "part")
        .select("part", "number", (F.col("part_start") + F.col("file_start")).alias("base"))
    )
    return rows.join(starts, ["part", "number"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_files(documents: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write all documents as token-id files and return the index read back from them."""
    spark = documents.sparkSession
    path = run_folder(spark, "token-files")
    write_token_files(documents, path, tokenizer, end_id)
    return read_token_index(spark, path)
