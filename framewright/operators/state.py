"""Statistics of a table that follow its cleaning steps by what changed.

A state holds the rows, per column the missing cells and, for numbers, count, sum and sum of squares, and how often each row occurs, as
a table of row prints (two 64-bit hashes) and counts. All of it can be added and subtracted: a step that changes cells is applied once, the
rows that differ are taken out with their old values and put in with their new ones. A step that removes rows or columns is measured
anew, one pass. So the log of a history costs a bounded number of passes per step, however long the history is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions.missing import is_missing
from framewright.functions.numbers import finite
from framewright.functions.text import is_number
from framewright.operators.profile import profiled_columns
from framewright.session import work_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame written once and read again."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _facts(df: DataFrame, weight: Column, source: str = "") -> list[Column]:
    """Weighted sums of a table's rows, or of the rows held in the struct column ``source``."""
    at = lambda n: F.col(f"`{source}`.`{n}`") if source else F.col(f"`{n}`")
    out = [F.sum(weight).alias("rows")]
    for i, n in enumerate(profiled_columns(df)):
        out.append(F.sum(F.when(is_missing(at(n), df.schema[n].dataType), weight).otherwise(0)).alias(f"missing_{i}"))
        if is_number(df.schema[n].dataType):
            v = finite(at(n))
            out += [F.sum(F.when(v.isNotNull(), weight).otherwise(0)).alias(f"count_{i}"),
                    F.sum(F.coalesce(v, F.lit(0.0)) * weight).alias(f"sum_{i}"), F.sum(F.coalesce(v * v, F.lit(0.0)) * weight).alias(f"squares_{i}")]
    return out


def _print(columns: list[str], source: str = "") -> list[Column]:
    """Two hashes of a row."""
    cells = [F.col(f"`{source}`.`{n}`") if source else F.col(f"`{n}`") for n in columns]
    return [F.xxhash64(*cells).alias("h1"), F.xxhash64(F.lit(1), *cells).alias("h2")]


@dataclass(frozen=True)
class TableState:
    """``sums`` by name, the flat columns they belong to, and the prints of the rows with their counts."""

    columns: tuple[str, ...]
    sums: dict
    prints: DataFrame

    @staticmethod
    def of(df: DataFrame) -> TableState:
        flat = profiled_columns(df)
        sums = df.agg(*_facts(df, F.lit(1).cast("long"))).first().asDict()
        counted = df.select(*_print(flat)).groupBy("h1", "h2").agg(F.count("*").alias("n"))
        return TableState(tuple(flat), {k: v or 0 for k, v in sums.items()}, stored(counted, "row-prints"))

    @property
    def rows(self) -> int:
        return self.sums["rows"]

    @property
    def missing(self) -> int:
        return sum(self.sums[f"missing_{i}"] for i in range(len(self.columns)))

    @property
    def duplicates(self) -> int:
        """Rows beyond the first of each repeated row."""
        return self.prints.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")).first()["d"]

    def moments(self) -> dict[str, tuple[int, float, float]]:
        """Count, mean and population variance of every numeric column."""
        out = {}
        for i, n in enumerate(self.columns):
            k = self.sums.get(f"count_{i}")
            if k:
                mean = self.sums[f"sum_{i}"] / k
                out[n] = (k, mean, max(0.0, self.sums[f"squares_{i}"] / k - mean * mean))
        return out

    def changed(self, pairs: DataFrame) -> TableState:
        """The state after rows (``before``, ``after``, structs of the same columns and types) were exchanged."""
        flat = list(self.columns)
        view = pairs.select("after.*")
        put = pairs.agg(*_facts(view, F.lit(1).cast("long"), "after")).first().asDict()
        took = pairs.agg(*_facts(view, F.lit(1).cast("long"), "before")).first().asDict()
        sums = {k: v + (put[k] or 0) - (took[k] or 0) for k, v in self.sums.items()}
        moved = pairs.select(*_print(flat, "before"), F.lit(-1).alias("n")).unionByName(pairs.select(*_print(flat, "after"), F.lit(1).alias("n")))
        counted = self.prints.unionByName(moved.groupBy("h1", "h2").agg(F.sum("n").alias("n")))
        counted = counted.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 0")
        return TableState(self.columns, sums, stored(counted, "row-prints"))


def exchanged(df: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``after`` (which carries the old row in ``before``) that differ from it."""
    pairs = after.select("before", F.struct(*[F.col(f"`{n}`") for n in names]).alias("after"))
    differs = [~F.col(f"before.`{n}`").eqNullSafe(F.col(f"after.`{n}`")) for n in names]
    test = differs[0]
    for d in differs[1:]:
        test = test | d
    return pairs.where(test)
