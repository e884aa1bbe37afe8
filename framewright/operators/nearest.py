"""The nearest of any number of centres, exactly, by pruned groups.

Centres belong to the nearest of about sqrt(centres) pivots, at most ``PIVOTS``, and lie in one folder per pivot with their distance to it. A
row looks in its own pivot's group first. The triangle inequality then leaves only the groups that can hold a centre as near as that,
and inside a group only the centres whose distance to the pivot fits. Rows are dealt by pivot and a hash, so a crowded pivot is
spread; a task holds one batch of rows, one batch of centres and the pivots.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framewright.session import work_folder

PIVOTS = 1024
BATCH_ROWS, TILE = 4096, 1 << 20
#: Room for rounding in a pruned distance.
SLACK = 1e-9


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _squares(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, features added in order so that every engine gives the same last bits."""
    out = np.zeros((len(rows), len(centres)))
    for j in range(rows.shape[1]):
        gap = rows[:, j, None] - centres[None, :, j]
        out += gap * gap
    return out


def _to_pivots(pivots: np.ndarray):
    def task(batches):
        for b in batches:
            z = _matrix(b.column("z"))
            step = max(1, TILE // len(pivots))
            found = [_squares(z[i:i + step], pivots) for i in range(0, len(z), step)]
            near = np.concatenate([f.argmin(axis=1) for f in found]) if found else np.zeros(0, int)
            far = np.sqrt(np.concatenate([f.min(axis=1) for f in found])) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(far)],
                                             names=[*b.schema.names, "pivot", "away"])
    return task


def _group(folder: str, pivot: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches (classes, centres, distances to the pivot) of a group's files."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}"
    store, at = fs.FileSystem.from_uri(uri)
    place = f"{at}/pivot={pivot}"
    if store.get_file_info(place).type == fs.FileType.NotFound:
        return
    for info in sorted(store.get_file_info(fs.FileSelector(place)), key=lambda i: i.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as f:
                for b in pq.ParquetFile(f).iter_batches(BATCH_ROWS, columns=["class", "z", "away"]):
                    yield np.array(b.column("class").to_pylist(), dtype=object), _matrix(b.column("z")), b.column("away").to_numpy()


def _search(folder: str):
    """Improves (best, class) of rows that lie together by pivot, within their pivot's group."""
    def task(batches):
        for b in batches:
            pivot, z, away = b.column("pivot").to_numpy(), _matrix(b.column("z")), b.column("away").to_numpy()
            best = b.column("best").to_numpy(zero_copy_only=False).copy()
            names = np.array(b.column("class").to_pylist(), dtype=object)
            for p in np.unique(pivot):
                mine = np.flatnonzero(pivot == p)
                for classes, centres, reach in _group(folder, int(p)):
                    step = max(1, TILE // len(centres))
                    for i in range(0, len(mine), step):
                        some = mine[i:i + step]
                        limit = np.sqrt(best[some].max()) * (1 + SLACK)
                        low, high = away[some].min() - limit, away[some].max() + limit
                        fits = np.flatnonzero((reach >= low - SLACK * (1 + np.abs(low))) & (reach <= high * (1 + SLACK) + SLACK))
                        if not len(fits):
                            continue
                        d = _squares(z[some], centres[fits])
                        least = d.min(axis=1)
                        for k in np.flatnonzero(least <= best[some]):
                            name = min(classes[fits][d[k] == least[k]])
                            r = some[k]
                            if least[k] < best[r] or names[r] is None or name < names[r]:
                                best[r], names[r] = least[k], name
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(best), pa.array(names.tolist(), pa.string())],
                                             names=["row", "best", "class"])
    return task


def _others(pivots: np.ndarray, reach: np.ndarray):
    """For every row the other pivots whose group can hold a centre at least as near as its best one."""
    def task(batches):
        for b in batches:
            z, own = _matrix(b.column("z")), b.column("pivot").to_numpy()
            best = np.sqrt(b.column("best").to_numpy()) * (1 + SLACK)
            step = max(1, TILE // len(pivots))
            for i in range(0, len(z), step):
                d = np.sqrt(_squares(z[i:i + step], pivots))
                may = (d - reach[None, :]) * (1 - SLACK) <= best[i:i + step, None] + SLACK
                may[np.arange(len(d)), own[i:i + step]] = False
                r, p = np.nonzero(may)
                part = b.take(pa.array(r + i))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("z"), pa.array(p.astype(np.int32)), pa.array(d[r, p]), part.column("best"),
                     part.column("class")], names=["row", "z", "pivot", "away", "best", "class"])
    return task


def _written(df: DataFrame, name: str, by: str | None = None) -> tuple[DataFrame, str]:
    path = work_folder(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def nearest(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """``rows`` (any columns and the array ``z``) with ``class``, the nearest of ``centres`` (class, z); ties go to the first class name.

    The result is exact. Without centres the class is null.
    """
    keep = rows.columns
    rows, _ = _written(rows.withColumn("row", F.monotonically_increasing_id()), "nearest-rows")
    n = centres.count()
    if not n:
        return rows.withColumn("class", F.lit(None).cast("string")).select(*keep, "class")
    many = min(PIVOTS, max(1, math.isqrt(n)))
    picked = centres.orderBy(F.xxhash64("class"), "class").limit(many).select("z").collect()
    pivots = np.array([r["z"] for r in picked], dtype=float)
    at_pivot = centres.select("class", "z").mapInArrow(_to_pivots(pivots), "class string, z array<double>, pivot int, away double")
    # one folder per pivot, its centres in order of distance; a crowded pivot has several files
    spread = F.pmod(F.xxhash64("class"), F.lit(1 + n // 1_000_000)).cast("int")
    grouped = at_pivot.repartition(F.col("pivot"), spread).sortWithinPartitions("pivot", "away")
    stored, folder = _written(grouped.select("pivot", "class", "z", "away"), "nearest-centres", "pivot")
    ends = {r["pivot"]: r["m"] for r in stored.groupBy("pivot").agg(F.max("away").alias("m")).collect()}
    reach = np.array([ends.get(p, -np.inf) for p in range(many)])

    def improved(frame: DataFrame) -> DataFrame:
        dealt = frame.repartitionByRange("pivot", F.xxhash64("row")).sortWithinPartitions("pivot", "away")
        return dealt.mapInArrow(_search(folder), "row long, best double, class string")

    start = rows.select("row", "z").mapInArrow(_to_pivots(pivots), "row long, z array<double>, pivot int, away double")
    start = start.withColumns({"best": F.lit(float("inf")), "class": F.lit(None).cast("string")})
    own, _ = _written(improved(start).join(start.select("row", "z", "pivot", "away"), "row"), "nearest-own")
    more = own.select("row", "z", "pivot", "best", "class").mapInArrow(
        _others(pivots, reach), "row long, z array<double>, pivot int, away double, best double, class string")
    found = own.select("row", "best", "class").unionByName(improved(more))
    least = found.groupBy("row").agg(F.min(F.struct("best", "class"))["class"].alias("class"))
    return rows.join(least, "row").select(*keep, "class")
