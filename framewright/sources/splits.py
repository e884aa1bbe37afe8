"""Records of text files whose splits do not end where records end.

Both readers work the same way. Spark cuts the files at line ends (or at closing braces); a task runs over a split under every state it
may begin in and returns one small row: where each state leads. Windows over those rows give the state each split really begins in. A
second run groups the lines of a split into records; the pieces at the borders are put together by their order, at most two
pieces a split. What is joined back to the splits is one row of some 50 bytes per split, a few millionths of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Kinds of pieces: a whole record, the end of one begun in an earlier split, the start of one that a later split ends.
WHOLE, HEAD, TAIL = 0, 1, 2
PIECES = "file string, block long, ordinal long, kind int, text string"


def lines_of(spark: SparkSession, path: str | list[str], sep: str = "\n") -> DataFrame:
    """(value, file, block): the text between separators in file order, with the split it belongs to."""
    rows = spark.read.option("lineSep", sep).text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, bool]]:
    """Slices of batches that lie in one split: ((file, block), slice, whether it is the first one of the split)."""
    last = None
    for b in batches:
        files, blocks = b.column("file"), b.column("block")
        at = 0
        while at < b.num_rows:
            key = (files[at].as_py(), blocks[at].as_py())
            if (files[b.num_rows - 1].as_py(), blocks[b.num_rows - 1].as_py()) == key:
                end = b.num_rows
            else:  # the first place where another split begins
                low, high = at, b.num_rows - 1
                while high - low > 1:
                    mid = (low + high) // 2
                    same = (files[mid].as_py(), blocks[mid].as_py()) == key
                    low, high = (mid, high) if same else (low, mid)
                end = high
            yield key, b.slice(at, end - at), key != last
            last, at = key, end


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of (file, block, ordinal, kind, text) rows."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    columns = zip(*rows) if rows else ([], [], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                      names=["file", "block", "ordinal", "kind", "text"])


def whole_records(found: DataFrame, glue: str) -> DataFrame:
    """(file, block, ordinal, text): whole records as they are, pieces put together in the order of their splits."""
    order = Window.partitionBy("file").orderBy("block", "kind")
    cut = found.where(F.col("kind") != WHOLE)
    numbered = cut.withColumn("record", F.count_if(F.col("kind") == TAIL).over(order))
    whole = numbered.groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("block", "kind", "ordinal", "text"))).alias("parts"))
    joined = whole.select("file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["ordinal"].alias("ordinal"),
                          F.array_join(F.col("parts")["text"], glue).alias("text"))
    return found.where(F.col("kind") == WHOLE).select("file", "block", "ordinal", "text").unionByName(joined)


def before(column: Column) -> Column:
    """A running expression over the splits of a file before this one."""
    return column.over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def with_state(lines: DataFrame, states: DataFrame) -> DataFrame:
    """The lines with the columns of their split; the lines keep their order, as the splits' rows are sent to all tasks."""
    return lines.join(F.broadcast(states), ["file", "block"], "left")


def scan(lines: DataFrame, body: Callable, schema: str) -> DataFrame:
    """``body`` over the runs of lines of each task."""
    return lines.mapInArrow(lambda batches: body(runs(batches)), schema)
