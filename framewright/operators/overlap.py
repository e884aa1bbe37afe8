"""Which columns of a workspace may hold each other's values, from bounded samples of their distinct values.

Every column keeps the distinct values whose hash falls below a threshold, a power of two chosen so that about ``SAMPLE`` remain; a
column with fewer distinct values is kept whole. One more scan probes all columns with all samples: a cell is shuffled only if its hash is in
some sample. The share of a column's sample found in another column then estimates how much of the first the second contains, however
different their sizes are: exactly for columns kept whole, else within a Hoeffding margin that fails with probability ``RISK``.
What is shuffled, sent to all tasks and collected is bounded by the number of columns, not by the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions.text import INTEGRAL, is_number, is_text, is_time, key_text
from framewright.operators.profile import profiled_columns
from framewright.session import work_folder

SAMPLE, RISK = 4096, 1e-12
#: Columns up to which the samples' hashes (at most some 8,000 a column, 8 bytes each) are sent to all tasks.
BROADCAST_COLUMNS = 1024


@dataclass(frozen=True)
class Place:
    """A column of the workspace: its number, table, name and level (one in 2**level hashes is kept)."""

    number: int
    table: str
    column: str
    level: int


def family(dtype) -> str:
    """Numbers and text meet, since a key is often a number in one table and text in the other; times stay apart."""
    return "value" if is_number(dtype) or is_text(dtype) else "other"


def cell_texts(df: DataFrame, mine: list[Place]) -> DataFrame:
    """The key texts of the named columns, each column called by its number. Blank text is still empty here: what follows names a cell
    more than once, and only a column of its own is evaluated once."""
    def text(column: str) -> Column:
        c, dtype = F.col(f"`{column}`"), df.schema[column].dataType
        if is_text(dtype):
            return F.lower(F.trim(c.cast("string")))
        return c.cast("string") if is_time(dtype) or isinstance(dtype, INTEGRAL) else key_text(c, dtype)  # never blank, nothing to fold

    return df.select(*[text(p.column).alias(str(p.number)) for p in mine])


def cell_hashes(df: DataFrame, mine: list[Place], sampled: bool) -> DataFrame:
    """The hash of each cell's key text within its family, all or those that the level of their column keeps; null where there is none."""
    kinds = {p.number: family(df.schema[p.column].dataType) for p in mine}
    rows = cell_texts(df, mine)
    rows = rows.select(*[F.when(F.col(str(n)) != "", F.xxhash64(F.lit(kind), F.col(str(n)))).alias(str(n)) for n, kind in kinds.items()])
    if sampled:
        masks = {str(p.number): F.lit((1 << p.level) - 1).cast("long") for p in mine}
        rows = rows.select(*[F.when(F.col(n).bitwiseAND(mask) == 0, F.col(n)).alias(n) for n, mask in masks.items()])
    return rows


def long_cells(wide: DataFrame, name: str) -> DataFrame:
    """(place, ``name``) of the filled cells of columns that are called by their numbers."""
    return wide.unpivot([], wide.columns, "place", name).where(F.col(name).isNotNull()).withColumn("place", F.col("place").cast("int"))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def places(tables: dict[str, DataFrame]) -> list[Place]:
    """All flat columns with the level that their estimated number of distinct values asks for; one aggregate per table."""
    out: list[Place] = []
    for name, df in tables.items():
        columns = profiled_columns(df)
        if not columns:
            continue
        folded = lambda c: F.lower(F.trim(F.col(f"`{c}`"))) if is_text(df.schema[c].dataType) else F.col(f"`{c}`")  # noqa: B023, E731
        sizes = df.agg(*[F.approx_count_distinct(folded(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        for i, c in enumerate(columns):
            out.append(Place(len(out), name, c, max(0, math.ceil(math.log2(max(1, sizes[f"n{i}"]) / SAMPLE)))))
    return out


def _cells(tables: dict[str, DataFrame], found: list[Place], sampled: bool) -> DataFrame:
    """(place, h) of the filled cells of all tables, all of them or those that the level of their column keeps."""
    parts = []
    for name, df in tables.items():
        mine = [p for p in found if p.table == name]
        if mine:
            parts.append(long_cells(cell_hashes(df, mine, sampled), "h"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def containments(tables: dict[str, DataFrame]) -> tuple[list[Place], dict[tuple[int, int], float]]:
    """The columns, and for ordered pairs of columns of different tables the largest share of the first's distinct values that the second
    can hold. Pairs that are not named hold at most the margin of a sample, below 6 %."""
    found = places(tables)
    if not found:
        return [], {}
    kept = _written(_cells(tables, found, True).distinct(), "overlap-samples")
    seen = kept.select("h").distinct()
    seen = F.broadcast(seen) if len(found) <= BROADCAST_COLUMNS else seen
    hits = _cells(tables, found, False).join(seen, "h", "left_semi").distinct()
    whole = hits.join(kept.withColumn("sampled", F.lit(True)), ["place", "h"], "left")
    # per hash the columns that hold it and those whose sample it is in; equal lists are counted before pairs are formed
    lists = whole.groupBy("h").agg(F.array_sort(F.collect_list("place")).alias("holders"),
                                   F.array_sort(F.collect_list(F.when(F.col("sampled"), F.col("place")))).alias("owners"))
    lists = lists.groupBy("holders", "owners").agg(F.count("*").alias("n"))
    pairs = lists.select("n", "holders", F.explode("owners").alias("a")).select("a", "n", F.explode("holders").alias("b"))
    rows = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    size = {r["a"]: r["n"] for r in rows if r["a"] == r["b"]}
    share = {}
    for r in rows:
        a, b = found[r["a"]], found[r["b"]]
        if a.table != b.table:
            margin = math.sqrt(-math.log(RISK) / (2 * size[a.number])) if a.level else 0.0
            share[a.number, b.number] = min(1.0, r["n"] / size[a.number] + margin)
    return found, share
