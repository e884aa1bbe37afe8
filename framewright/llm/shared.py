"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.session import prepare, work_folder

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Bounds of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 8192, 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given parquet table."""
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there and survives lost executors."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def settled(rows: DataFrame, keep: list, **made: Column) -> DataFrame:
    """The kept columns and the made ones, each evaluated once per row: a generator of one element stands between them and what
    follows, so that later filters and columns do not repeat their expressions."""
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()])))
    return rows.select(*keep, one.alias("__made")).select(*keep, "__made.*")


def words(text: Column) -> Column:
    """The words between ASCII white space; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def slot_filter(rows: DataFrame, key: str, ids: DataFrame, slots: int = 1 << 20) -> DataFrame:
    """Rows whose key may be among ``ids``: a broadcast of at most ``slots`` hash slots, whatever the size of ``ids``.

    It only thins what is shuffled by the exact join that follows; with very many ids it lets everything pass.
    """
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    seen = ids.select(spread(F.col(ids.columns[0])).cast("int").alias("__slot")).distinct()
    return rows.join(F.broadcast(seen), spread(F.col(key)).cast("int") == F.col("__slot"), "left_semi")


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path) if ":" in path else f"file://{path}")


def put_file(path: str, data: bytes) -> None:
    """Write a file of the shared folder in one step: a task that runs twice leaves one whole file."""
    import uuid

    store, at = _place(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    draft = f"{at.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
    with store.open_output_stream(draft, compression=None) as out:
        out.write(data)
    store.move(draft, at)


def get_file(path: str) -> bytes:
    store, at = _place(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read()


def folder_of(df: DataFrame) -> str:
    """The folder of a frame read back by ``written``; empty when it has no files."""
    files = df.inputFiles()
    return files[0].rsplit("/", 1)[0] if files else ""


def file_batches(folder: str, columns: list[str], rows: int):
    """Tables of at most ``rows`` rows of the Parquet files of a shared folder, in the order of the files' names, inside a task."""
    import pyarrow.parquet as pq
    from pyarrow import Table, fs

    if not folder:
        return
    store, at = _place(folder)
    for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                for batch in pq.ParquetFile(f).iter_batches(rows, columns=columns):
                    yield Table.from_batches([batch])


def removed(spark: SparkSession, *folders: str) -> None:
    """Remove folders made by ``written`` or ``work_folder`` that nothing reads any more; an empty name is no folder."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for place in (hadoop.Path(folder) for folder in folders if folder):
        place.getFileSystem(conf).delete(place, True)


def group_rows(folder: str, column: str, value: int, columns: list[str], filters: list):
    """Some rows of one value's part of a shared folder that was written by that column, inside a task."""
    import pyarrow.parquet as pq

    store, at = _place(f"{folder}/{column}={value}")
    return pq.read_table(at, filesystem=store, columns=columns, filters=filters, partitioning=None)


def matrix(vectors):
    """A column of lists of whole numbers as a matrix of 64-bit numbers; shorter lists are padded with zeros."""
    import numpy as np
    import pyarrow as pa

    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(lengths.max()) if len(lengths) else 0
    if (lengths == wide).all():
        return flat.reshape(len(lengths), wide)
    out = np.zeros((len(lengths), wide), dtype=np.int64)
    out[np.arange(wide) < lengths[:, None]] = flat
    return out
