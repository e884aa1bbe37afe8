"""Best-fit packing under several capacities.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared lengths). A piece of length n uses
(n, 1, n * n) of them, so lengths are all that matters, and at most ``tokens`` lengths exist. The vector best-fit runs over the
histogram of lengths: a sequence is filled again and again with the length that fits every residual capacity and has the greatest
weighted dot product with the residuals (or leaves the least weighted residual norm), and the finished pattern is used as many
times as its lengths last. The plan has at most a few thousand patterns for any number of documents; each piece finds its
place from its length and its number among the pieces of that length. These numbers are given per task and shifted by the counts of the
tasks before it, so no length, however common, meets in one task.

A document longer than a sequence is cut so that all pieces but the first are full; the first may be shorter.

Edge cases: null and empty texts are one end token; null ids and repeated rows are packed like any other row; an empty table
gives no rows; a capacity that a single piece exceeds raises an error.
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
from framewright.llm.shared import written

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, number long"


def pieces(docs: DataFrame, path: str, tokens: int) -> DataFrame:
    """The pieces of every document with their number among the pieces of the same length of the same task."""

    def run(batches):
        task, counts = TaskContext.get().partitionId(), np.zeros(tokens + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = tokenizing.byte_level_ids(path, text or "").astype("<u4").tobytes() + b"\x02\x00\x00\x00"
                n = len(data) // 4
                stop, piece = (n - 1) % tokens + 1, 0
                at = 0
                while at < n:
                    rows.append((doc_id, piece, at, stop - at, zlib.crc32(data[4 * at:4 * stop]), task, int(counts[stop - at])))
                    counts[stop - at] += 1
                    at, stop, piece = stop, stop + tokens, piece + 1
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "task", "number"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def plan(counts: dict[int, int], tokens: int, documents: int, attention: float, weights=(1.0, 1.0, 1.0),
         rule: str = "dot") -> list[tuple[int, list[int]]]:
    """Patterns (times used, lengths in order) that take every counted length exactly once. Capacities hold for each pattern."""
    lengths = np.array(sorted(counts), np.int64)
    left = np.array([counts[n] for n in lengths], np.int64)
    use = np.stack([lengths / tokens, np.full(len(lengths), 1 / documents), lengths.astype(float) ** 2 / attention], axis=1)
    if len(lengths) and (use > 1 + 1e-12).any():
        raise ValueError("a piece exceeds a capacity")
    w = np.array(weights, float)
    out = []
    while left.any():
        room, taken, order = np.ones(3), np.zeros_like(left), []
        while True:
            fits = (left > taken) & (use <= room + 1e-9).all(axis=1)
            if not fits.any():
                break
            score = (use * w) @ room if rule == "dot" else -(((room - use) ** 2) @ w)
            i = int(np.flatnonzero(fits)[np.argmax(score[fits])])
            # as many of the best length as stay best while it fits
            room = room - use[i]
            taken[i] += 1
            order.append(int(lengths[i]))
        used = taken > 0
        times = int((left[used] // taken[used]).min())
        left = left - times * taken
        out.append((times, order))
    return out


class Seats:
    """Where the k-th piece of each length goes: (sequence, offset), from a plan."""

    def __init__(self, patterns: list[tuple[int, list[int]]]):
        self.first, self.base, self.offsets = {}, {}, {}
        given: dict[int, int] = {}
        sequence = 0
        for times, order in patterns:
            at, places = 0, {}
            for n in order:
                places.setdefault(n, []).append(at)
                at += n
            for n, offsets in places.items():
                self.first.setdefault(n, []).append(given.get(n, 0))
                self.base.setdefault(n, []).append(sequence)
                self.offsets.setdefault(n, []).append(offsets)
                given[n] = given.get(n, 0) + times * len(offsets)
            sequence += times
        self.sequences = sequence

    def of(self, length: int, number: int) -> tuple[int, int]:
        from bisect import bisect_right

        i = bisect_right(self.first[length], number) - 1
        copy, slot = divmod(number - self.first[length][i], len(self.offsets[length][i]))
        return self.base[length][i] + copy, self.offsets[length][i][slot]


def pack(docs: DataFrame, path: str, tokens: int = 1024, documents: int = 1024, attention: float | None = None,
         weights=(1.0, 1.0, 1.0), rule: str = "dot") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    attention = float(tokens) ** 2 if attention is None else float(attention)
    cut = written(pieces(docs, path, tokens), "pieces")
    counted = written(cut.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counted.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # at most ``tokens`` rows
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    seats = Seats(plan(histogram, tokens, documents, attention, weights, rule))
    numbered = cut.join(shifts, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("shift")).alias("number"))

    def run(batches):
        for batch in batches:
            found = [seats.of(n, k) for n, k in zip(batch.column("length").to_pylist(), batch.column("number").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start")], batch.column("length").cast(pa.int64()),
                 batch.column("ids_crc32"), pa.array([s for s, _ in found], pa.int64()),
                 pa.array([o for _, o in found], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
