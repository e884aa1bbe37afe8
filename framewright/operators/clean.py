"""Cleaning actions. Each is an immutable description with ``apply(df) -> df``; plans stay lazy."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framewright.functions.missing import missing_in
from framewright.functions.numbers import finite, half_up, to_number
from framewright.functions.text import INTEGRAL, cased, is_number, is_text
from framewright.operators.filters import fences, parsed_dates
from framewright.operators.profile import duplicate_count, missing_counts, numbers_long, profiled_columns
from framewright.operators.scale import exact_quantiles, join_keys, one_row, ordered_blocks
from framewright.operators.state import TableState, exchanged, stored

# Words read as a boolean when a column is converted.
TRUE_WORDS = ["true", "yes", "y", "t", "1"]
FALSE_WORDS = ["false", "no", "n", "f", "0"]


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _num(df: DataFrame, name: str) -> Column:
    """The numeric reading of a cell, also of numbers stored as text."""
    return _col(name) if is_number(df.schema[name].dataType) else to_number(_col(name))


def _fraction_type(dtype: T.DataType) -> T.DataType:
    """The type a column needs to take a fractional value: whole-number columns become double."""
    return T.DoubleType() if isinstance(dtype, INTEGRAL) else dtype


def _text_columns(df: DataFrame, name: str | None) -> list[str]:
    return [name] if name else [f.name for f in df.schema.fields if is_text(f.dataType)]


class Action:
    """A cleaning step. ``changed`` is the predicate of rows it changes, None when it removes rows or columns."""

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def changed(self, df: DataFrame) -> Column | None:
        return None


@dataclass(frozen=True)
class RemoveDuplicates(Action):
    """Keep one of every set of identical rows; the copies are dropped map-side first."""

    def apply(self, df):
        return df.dropDuplicates()


@dataclass(frozen=True)
class RemoveDuplicateIds(Action):
    """Keep the first or last row per id in a stated order; only one row per id and task is shuffled.

    Rows without an id (null or blank) are nobody's duplicates and all stay.
    """

    column: str
    order_by: tuple[str, ...]
    keep: str = "first"

    def apply(self, df):
        rest = [c for c in profiled_columns(df) if c not in self.order_by]
        names = [*self.order_by, *rest]
        order = [_col(c).asc() if self.keep == "first" else _col(c).desc() for c in names]
        key = _col(self.column).cast("string")
        named = F.coalesce(F.trim(key) != "", F.lit(False))
        first = df.where(named).withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        return first.where(F.col("_rn") == 1).drop("_rn").unionByName(df.where(~named))


@dataclass(frozen=True)
class DropMissing(Action):
    """Drop rows with a missing cell in one column, or in any."""

    column: str | None = None

    def apply(self, df):
        names = [self.column] if self.column else profiled_columns(df)
        return df.where(~reduce(or_, [missing_in(df, n) for n in names]))


@dataclass(frozen=True)
class DropMostlyMissing(Action):
    """Drop columns with at least ``threshold`` percent missing cells."""

    threshold: float = 70.0

    def apply(self, df):
        rows = missing_counts(df).where(F.col("missing_pct") >= self.threshold).select("column").collect()
        return df.drop(*[r[0] for r in rows])


@dataclass(frozen=True)
class Impute(Action):
    """Fill missing cells with the mean, median, mode or a constant, learnt from the other cells."""

    column: str
    strategy: str = "median"
    value: object = None

    def changed(self, df):
        return missing_in(df, self.column, "fill")

    def learnt(self, df: DataFrame) -> Column:
        gone = missing_in(df, self.column, "fill")
        known = df.where(~gone)
        if self.strategy == "constant":
            return F.lit(self.value)
        if self.strategy == "mode":
            shown = F.trim(_col(self.column)) if is_text(df.schema[self.column].dataType) else _col(self.column)
            counts = known.groupBy(shown.alias("v")).agg(F.count("*").alias("n"))
            best = counts.agg(F.min(F.struct(-F.col("n"), F.col("v"))).alias("b")).select("b.v").scalar()
            unknown = F.lit("Unknown") if is_text(df.schema[self.column].dataType) else F.lit(0)
            return F.coalesce(best, unknown)
        long = numbers_long(known, [self.column])
        if self.strategy == "mean":
            fact = long.agg(F.avg("v").alias("m"))
        else:
            fact = exact_quantiles(long, [], F.col("v"), {"m": 0.5})
        return F.coalesce(half_up(fact.select("m").scalar(), 2), F.lit(0.0))

    def apply(self, df):
        dtype = df.schema[self.column].dataType
        if self.strategy in ("mean", "median"):
            dtype = _fraction_type(dtype)
        known = _col(self.column).cast(dtype)
        filled = F.when(missing_in(df, self.column, "fill"), self.learnt(df).cast(dtype)).otherwise(known)
        return df.withColumn(self.column, filled)


@dataclass(frozen=True)
class Carry(Action):
    """Forward or backward fill within ``keys`` in a stated order.

    Rows are split into ordered blocks, filled inside each block, and every block receives the last known value of the
    blocks before it, so one long group is worked on by many tasks.
    """

    column: str
    order_by: tuple[str, ...]
    keys: tuple[str, ...] = ()
    direction: str = "forward"

    def changed(self, df):
        return missing_in(df, self.column, "fill")

    def apply(self, df):
        back = self.direction == "backward"
        rest = [c for c in profiled_columns(df) if c not in (*self.order_by, *self.keys, self.column)]
        way = lambda c: _col(c).desc_nulls_last() if back else _col(c).asc_nulls_first()
        order = [way(c) for c in (*self.order_by, *rest)]
        known = F.when(~missing_in(df, self.column, "fill"), _col(self.column))
        blocks = ordered_blocks(df.withColumn("_known", known), [*[_col(k) for k in self.keys], *order])
        inside = Window.partitionBy("_block", *self.keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        place = F.struct(*[_col(c) for c in (*self.order_by, *rest)])
        pick = F.min_by if back else F.max_by
        last = F.when(F.col("_known").isNotNull(), place)
        ends = blocks.groupBy("_block", *self.keys).agg(pick("_known", last).alias("_end"))
        before = Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select("_block", *self.keys, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
        local = blocks.withColumn("_local", F.last("_known", ignorenulls=True).over(inside))
        joined = join_keys(local, carried, ["_block", *self.keys])
        return joined.withColumn(self.column, F.coalesce("_local", "_carry")).select(*df.columns)


@dataclass(frozen=True)
class Trim(Action):
    """Strip blanks around the text of one or all text columns."""

    column: str | None = None

    def changed(self, df):
        return reduce(or_, [F.coalesce(_col(c) != F.trim(_col(c)), F.lit(False)) for c in _text_columns(df, self.column)])

    def apply(self, df):
        return df.withColumns({c: F.trim(_col(c)) for c in _text_columns(df, self.column)})


@dataclass(frozen=True)
class Recase(Action):
    """Trimmed title, lower or upper case for one or all text columns."""

    column: str | None = None
    style: str = "title"

    def changed(self, df):
        names = _text_columns(df, self.column)
        return reduce(or_, [F.coalesce(_col(c) != cased(_col(c), self.style), F.lit(False)) for c in names])

    def apply(self, df):
        return df.withColumns({c: cased(_col(c), self.style) for c in _text_columns(df, self.column)})


@dataclass(frozen=True)
class Alias(Action):
    """Replace trimmed values by a mapping."""

    column: str
    mapping: tuple[tuple[str, str], ...]

    def changed(self, df):
        return F.trim(_col(self.column)).isin([k for k, _ in self.mapping])

    def apply(self, df):
        pairs = F.create_map(*[F.lit(x) for pair in self.mapping for x in pair])
        return df.withColumn(self.column, F.coalesce(pairs[F.trim(_col(self.column))], _col(self.column)))


@dataclass(frozen=True)
class Replace(Action):
    """Replace one exact value."""

    column: str
    old: object
    new: object

    def changed(self, df):
        return _col(self.column).cast("string") == str(self.old)

    def apply(self, df):
        dtype = df.schema[self.column].dataType
        return df.withColumn(self.column, F.when(self.changed(df), F.lit(self.new).cast(dtype)).otherwise(_col(self.column)))


@dataclass(frozen=True)
class Convert(Action):
    """Convert to numeric, datetime, boolean or text; what cannot be read becomes null and is counted by ``rejects``."""

    column: str
    target: str

    def converted(self, df: DataFrame) -> Column:
        column, dtype = _col(self.column), df.schema[self.column].dataType
        if self.target == "numeric":
            return finite(column) if is_number(dtype) else to_number(column)
        if self.target == "datetime":
            return parsed_dates(df, self.column).cast("date")
        if self.target == "boolean":
            word = F.lower(F.trim(column.cast("string")))
            return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
        return column.cast("string")

    def changed(self, df):
        return ~missing_in(df, self.column)

    def apply(self, df):
        return df.withColumn(self.column, self.converted(df))

    def rejects(self, df: DataFrame) -> DataFrame:
        bad = ~missing_in(df, self.column) & self.converted(df).isNull()
        return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("rejected"))


def _bounds(df: DataFrame, column: str, method: str = "iqr") -> Column:
    """Struct (low, high) from a scalar subquery: 1.5 * IQR fences or mean +- 3 standard deviations."""
    if method == "zscore":
        long = numbers_long(df, [column])
        facts = long.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
        return one_row(facts.select((F.col("m") - 3 * F.col("s")).alias("low"), (F.col("m") + 3 * F.col("s")).alias("high")))
    return one_row(fences(df.select(_num(df, column).alias(column)), [column]).select("low", "high"))


@dataclass(frozen=True)
class Cap(Action):
    """Pull values outside the bounds (given, or the IQR fences) to the bounds rounded to two decimals."""

    column: str
    low: float | None = None
    high: float | None = None

    def limits(self, df: DataFrame) -> tuple[Column, Column]:
        if self.low is not None and self.high is not None:
            return F.lit(float(self.low)), F.lit(float(self.high))
        found = _bounds(df, self.column)
        return found["low"], found["high"]

    def changed(self, df):
        low, high = self.limits(df)
        return (_num(df, self.column) < low) | (_num(df, self.column) > high)

    def apply(self, df):
        low, high = self.limits(df)
        v, dtype = _num(df, self.column), _fraction_type(df.schema[self.column].dataType)
        capped = F.when(v < low, half_up(low, 2).cast(dtype)).when(v > high, half_up(high, 2).cast(dtype))
        capped = capped.otherwise(_col(self.column).cast(dtype))
        return df.withColumn(self.column, capped)


@dataclass(frozen=True)
class RemoveOutliers(Action):
    """Drop rows outside the IQR fences or beyond three standard deviations; null and text cells stay."""

    column: str
    method: str = "iqr"

    def apply(self, df):
        limits = _bounds(df, self.column, self.method)
        outside = (_num(df, self.column) < limits["low"]) | (_num(df, self.column) > limits["high"])
        return df.where(~F.coalesce(outside, F.lit(False)))


@dataclass(frozen=True)
class OutliersToMedian(Action):
    """Replace values outside the IQR fences with the median."""

    column: str

    def changed(self, df):
        limits = _bounds(df, self.column)
        return (_num(df, self.column) < limits["low"]) | (_num(df, self.column) > limits["high"])

    def apply(self, df):
        dtype = _fraction_type(df.schema[self.column].dataType)
        middle = exact_quantiles(df, [], _num(df, self.column), {"m": 0.5}).scalar()
        return df.withColumn(
            self.column, F.when(self.changed(df), half_up(middle, 2).cast(dtype)).otherwise(_col(self.column).cast(dtype))
        )


@dataclass(frozen=True)
class ClearCells(Action):
    """Null the cells outside an allowed range, so that imputation can then reach them."""

    column: str
    low: float | None = None
    high: float | None = None

    def changed(self, df):
        tests = []
        if self.low is not None:
            tests.append(_num(df, self.column) < self.low)
        if self.high is not None:
            tests.append(_num(df, self.column) > self.high)
        return F.coalesce(reduce(or_, tests), F.lit(False))

    def apply(self, df):
        return df.withColumn(self.column, F.when(~self.changed(df), _col(self.column)))


@dataclass(frozen=True)
class DropColumn(Action):
    column: str

    def apply(self, df):
        return df.drop(self.column)


@dataclass(frozen=True)
class DropConstant(Action):
    """Drop columns whose non-missing cells hold one value."""

    def apply(self, df):
        names = profiled_columns(df)
        shown = {n: F.when(~missing_in(df, n, "profile"), F.trim(_col(n).cast("string"))) for n in names}
        ends = df.agg(*[F.min(e).alias(f"lo_{i}") for i, e in enumerate(shown.values())],
                      *[F.max(e).alias(f"hi_{i}") for i, e in enumerate(shown.values())]).first()
        same = [n for i, n in enumerate(names) if ends[f"lo_{i}"] is not None and ends[f"lo_{i}"] == ends[f"hi_{i}"]]
        return df.drop(*same)


@dataclass(frozen=True)
class Rename(Action):
    column: str
    new_name: str

    def apply(self, df):
        new = self.new_name.strip()
        if not new or (new in df.columns and new != self.column):
            raise ValueError(f"cannot rename {self.column} to {self.new_name!r}")
        return df.withColumnRenamed(self.column, new)


def affected(df: DataFrame, action: Action) -> DataFrame:
    """Rows before and after and rows changed or removed, one row."""
    test = action.changed(df)
    if test is not None:
        facts = df.agg(F.count("*").alias("rows_before"), F.count_if(F.coalesce(test, F.lit(False))).alias("affected_rows"))
        return facts.select("rows_before", F.col("rows_before").alias("rows_after"), "affected_rows")
    after = action.apply(df).agg(F.count("*").alias("n")).scalar()
    facts = df.agg(F.count("*").alias("rows_before")).withColumn("rows_after", after)
    return facts.withColumn("affected_rows", F.col("rows_before") - F.col("rows_after"))


def log_entry(df: DataFrame, action: Action, step: int) -> DataFrame:
    """Audit row of one applied action with table statistics on both sides."""
    after = action.apply(df)
    counts = affected(df, action)
    missing = lambda t: missing_counts(t, "basic").agg(F.sum("missing").alias("m")).scalar()
    doubles = lambda t: duplicate_count(t).scalar()
    return counts.select(
        F.lit(step).cast("long").alias("step"), F.lit(type(action).__name__).alias("action"),
        F.lit(getattr(action, "column", None)).cast("string").alias("column"), "rows_before", "rows_after", "affected_rows",
        missing(df).cast("long").alias("missing_before"), missing(after).cast("long").alias("missing_after"),
        doubles(df).cast("long").alias("duplicates_before"), doubles(after).cast("long").alias("duplicates_after"),
    )


def preview(df: DataFrame, action: Action, key: list[str], limit: int = 5) -> DataFrame:
    """The first changed rows with the names of the changed fields and the values before and after.

    Of an action that removes rows, the first removed rows: ``changed`` is ``removed``, and ``after`` is null.
    A changed row carries its old values through the action, so rows of equal keys are not mixed up.
    """
    rest = [c for c in df.columns if c not in key]
    texts = lambda names: F.struct(*[_col(c).cast("string").alias(c) for c in names])
    if action.changed(df) is None:
        after = action.apply(df)
        if set(after.columns) == set(df.columns):
            gone = df.exceptAll(after.select(*[_col(c) for c in df.columns])).withColumn("before", texts(rest))
            return gone.withColumns({"changed": F.lit("removed"), "after": F.lit(None).cast(gone.schema["before"].dataType)}).orderBy(
                *key).limit(limit).select(*key, "changed", "before", "after")
    after = action.apply(df.withColumn("before", texts(rest)))
    shared = [c for c in rest if c in after.columns]
    both = after.withColumn("after", texts(shared))
    names = F.array_compact(F.array(*[
        F.when(~F.col(f"before.`{c}`").eqNullSafe(F.col(f"after.`{c}`")), F.lit(c)) for c in shared
    ]))
    changed = both.withColumn("changed", names).where(F.size("changed") > 0)
    return changed.orderBy(*key).limit(limit).select(*key, F.concat_ws(",", "changed").alias("changed"), "before", "after")


@dataclass(frozen=True)
class History:
    """Actions over an untouched source. ``current`` folds them; undo is the fold without the last one."""

    source: DataFrame
    actions: tuple[Action, ...] = field(default_factory=tuple)

    def do(self, action: Action) -> "History":
        return History(self.source, (*self.actions, action))

    def undo(self) -> "History":
        return History(self.source, self.actions[:-1])

    def revert(self) -> "History":
        return History(self.source)

    def current(self) -> DataFrame:
        return reduce(lambda df, a: a.apply(df), self.actions, self.source)

    def log(self) -> DataFrame:
        """One audit row per applied action, with rows, missing cells and duplicates on both sides.

        Every step is applied once to the stored result of the one before; the statistics follow by what it changed (see ``state``).
        """
        df, rows = self.source, []
        state = TableState.of(df) if self.actions else None
        for i, action in enumerate(self.actions, start=1):
            test = action.changed(df)
            names = list(df.columns)
            after = action.apply(df.withColumn("before", F.struct(*[_col(n) for n in names])) if test is not None else df)
            kept = stored(after, "clean-step")
            same = test is not None and [(f.name, f.dataType) for f in after.schema.fields if f.name in names] == [
                (f.name, f.dataType) for f in df.schema.fields]
            clean_rows = kept.drop("before") if test is not None else kept
            now = state.changed(exchanged(df, kept, names)) if same else TableState.of(clean_rows)
            touched = df.agg(F.count_if(F.coalesce(test, F.lit(False))).alias("n")).first()["n"] if test is not None else state.rows - now.rows
            rows.append((i, type(action).__name__, getattr(action, "column", None), state.rows, now.rows, touched, state.missing, now.missing,
                         state.duplicates, now.duplicates))
            df, state = clean_rows, now
        return self.source.sparkSession.createDataFrame(rows, LOGGED)


LOGGED = """step long, action string, column string, rows_before long, rows_after long, affected_rows long, missing_before long,
 missing_after long, duplicates_before long, duplicates_after long"""
