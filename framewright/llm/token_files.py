"""Token ids in directly addressable files.

The ids of a shard are split into chunks of eight bits. Level 0 has the low chunk of every id; a level's continuation bitmap
says which of its ids go on, and the next level holds only those. A rank directory (set bits before every 512) turns a place
into the place on the next level, so any single id, or any range, is read by a few lookups without decoding a block.

File, little endian: magic "DAC2", then 64-bit counts of ids, documents and levels; document ids (int64), a byte each that says
whether the id is null, and the first id of each document (int64); then per level its number of chunks, the chunks, the bitmap and the
rank directory. Documents are range partitioned and sorted by id, and a task starts a new file every FILE_IDS ids, so no task
or row grows with the data. The files lie in the shared folder, are moved into place whole, and are read back by Spark.

Edge cases: null and empty texts hold the end id only; null document ids sort first and stay null; rows that repeat an id are
stored one after another; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.llm import tokenizing
from framewright.llm.shared import put_file, work_folder, written

MAGIC, CHUNK, RANK_EVERY = b"DAC2", 8, 512
FILE_IDS = 2_000_000
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    """A file of the ids with its documents' ids and first places."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while True:
        more = rest >> CHUNK > 0
        bitmap = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(bitmap) // (RANK_EVERY // 8)) * (RANK_EVERY // 8), np.uint8)
        padded[:len(bitmap)] = bitmap
        per = ONES[padded].reshape(-1, RANK_EVERY // 8).sum(axis=1, dtype=np.int64)
        rank = np.concatenate([[0], np.cumsum(per)]).astype("<u4")
        levels.append((rest & (2**CHUNK - 1)).astype(np.uint8).tobytes() + bitmap.tobytes() + rank.tobytes())
        sizes = np.array([len(rest), len(bitmap), len(rank)], "<i8").tobytes()
        levels[-1] = sizes + levels[-1]
        rest = rest[more] >> CHUNK
        if not len(rest):
            break
    missing = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = np.array([len(ids), len(doc_ids), len(levels)], "<i8").tobytes()
    return b"".join([MAGIC, head, names.tobytes(), missing.tobytes(), np.asarray(starts, "<i8").tobytes(), *levels])


class Reader:
    """Random access to the ids of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        at = 4
        take = lambda kind, n, at: np.frombuffer(data, kind, n, at)
        self.n, docs, levels = (int(x) for x in take("<i8", 3, at))
        at += 24
        self.doc_ids = [None if m else int(d) for d, m in zip(take("<i8", docs, at), take("u1", docs, at + 8 * docs))]
        at += 9 * docs
        self.starts = take("<i8", docs, at)
        at += 8 * docs
        self.levels = []
        for _ in range(levels):
            n, b, r = (int(x) for x in take("<i8", 3, at))
            at += 24
            self.levels.append((take("u1", n, at), take("u1", b, at + n), take("<u4", r, at + n + b)))
            at += n + b + 4 * r

    @staticmethod
    def _rank(level, place: int) -> int:
        """Set bits of the level's bitmap before a place."""
        _, bitmap, rank = level
        block = place // RANK_EVERY
        lo, hi = block * RANK_EVERY // 8, place // 8
        found = int(rank[block]) + int(ONES[bitmap[lo:hi]].sum(dtype=np.int64))
        return found + (int(ONES[bitmap[hi] & ((1 << place % 8) - 1)]) if place % 8 else 0)

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.n:
            raise IndexError(place)
        value, shift = 0, 0
        for level in self.levels:
            chunks, bitmap, _ = level
            value |= int(chunks[place]) << shift
            if not bitmap[place // 8] >> (place % 8) & 1:
                break
            place, shift = self._rank(level, place), shift + CHUNK
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of [start, stop)."""
        out = np.zeros(stop - start, "<u4")
        where = np.arange(stop - start)
        for k, level in enumerate(self.levels):
            if start >= stop:
                break
            chunks, bitmap, _ = level
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(CHUNK * k)
            bits = np.unpackbits(bitmap[start // 8:-(-stop // 8)], bitorder="little")
            more = bits[start % 8:start % 8 + stop - start].astype(bool)
            where = where[more]
            start = self._rank(level, start)
            stop = start + len(where)
        return out

    def document(self, i: int) -> tuple[int, int]:
        """First id and end of the i-th document."""
        return int(self.starts[i]), int(self.starts[i + 1]) if i + 1 < len(self.starts) else self.n


MANIFEST = "path string, task int, file int, n_docs long, n_tokens long"


def write(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the files of all documents in ascending doc_id order; a row per file in that order (task, file)."""

    def run(batches):
        task = TaskContext.get().partitionId()
        cache = tokenizing.word_ids(path)
        ids, names, starts, size, file = [], [], [], 0, 0

        def flush():
            target = f"{folder}/ids-{task:06d}-{file:05d}.dac"
            put_file(target, encode(np.frombuffer(b"".join(ids), "<u4"), names, np.array(starts, np.int64)))
            return pa.RecordBatch.from_arrays(
                [pa.array([target]), pa.array([task], pa.int32()), pa.array([file], pa.int32()),
                 pa.array([len(names)], pa.int64()), pa.array([size], pa.int64())],
                ["path", "task", "file", "n_docs", "n_tokens"])

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), cache.batch(texts)):
                data += tokenizing.END.to_bytes(4, "little")
                names.append(doc_id)
                starts.append(size)
                ids.append(data)
                size += len(data) // 4
                if size >= FILE_IDS:
                    yield flush()
                    ids, names, starts, size, file = [], [], [], 0, file + 1
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranged = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ranged.mapInArrow(run, MANIFEST)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                file = Reader(content.as_py())
                spans = [file.document(i) for i in range(len(file.doc_ids))]
                size = len(spans)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py().rsplit("/", 1)[1]] * size), pa.array(file.doc_ids, pa.int64()),
                     pa.array([a for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()),
                     pa.array([zlib.crc32(file.slice(a, b).tobytes()) for a, b in spans], pa.int64())],
                    ["name", "doc_id", "at", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    order = Window.orderBy("task", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = manifest.select(F.element_at(F.split("path", "/"), -1).alias("name"),
                            F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("base"))
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "name string, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "name").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write all documents and read every one back from the files."""
    spark = docs.sparkSession
    folder = work_folder(spark, "token-files")
    manifest = written(write(docs, path, folder), "token-manifest")
    if not manifest.take(1):
        return docs.limit(0).selectExpr("cast(doc_id as long) doc_id", "0L as start", "0L as n_tokens", "0L as ids_crc32")
    return read(manifest, folder)
