"""Row filters, column selection, samples and paging."""

from __future__ import annotations

from decimal import ROUND_CEILING, ROUND_FLOOR, Decimal, InvalidOperation
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from framewright.functions.dates import parse_date
from framewright.functions.missing import missing_in
from framewright.functions.numbers import to_number
from framewright.functions.text import is_number, is_text, is_time
from framewright.operators.scale import TASK_SHARE, _parts, exact_quantiles, heavy_keys, number_rows


def _number(df: DataFrame, name: str) -> Column:
    column = F.col(f"`{name}`")
    return column if is_number(df.schema[name].dataType) else to_number(column)


def _as_float(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def _as_decimal(value) -> Decimal | None:
    """The number a literal stands for, digit by digit; None for what is no finite number."""
    try:
        number = Decimal(str(value).strip())
    except InvalidOperation:
        return None
    return number if number.is_finite() else None


#: Limits of 64-bit columns and the digits a decimal column can hold.
LEAST, MOST, DIGITS = -2**63, 2**63 - 1, 38


def _compared(column: Column, dtype: T.DataType, op: str, value) -> Column:
    """A comparison in the column's own type, so that it is exact and reaches the scan."""
    sides = {"gt": column.__gt__, "gte": column.__ge__, "lt": column.__lt__, "lte": column.__le__, "eq": column.__eq__}
    number = _as_decimal(value)
    if number is None or not isinstance(dtype, (T.IntegralType, T.DecimalType)):
        plain = _as_float(value)
        if plain is None:
            if op != "eq":
                raise ValueError(f"{value!r} is no number")
            return F.when(column.isNotNull(), F.lit(False))
        return sides[op](F.lit(plain))
    always, never = (F.when(column.isNotNull(), F.lit(x)) for x in (True, False))
    if isinstance(dtype, T.DecimalType):
        if len(number.as_tuple().digits) + max(0, number.as_tuple().exponent) <= DIGITS and -number.as_tuple().exponent <= DIGITS:
            return sides[op](F.lit(number))
        return sides[op](F.lit(float(number)))
    whole = number == number.to_integral_value()
    low, high = (int(number.to_integral_value(r)) for r in (ROUND_FLOOR, ROUND_CEILING))
    if op == "eq":
        return sides[op](F.lit(low)) if whole and LEAST <= low <= MOST else never
    if op in ("gt", "lte"):  # between whole numbers the limit is the one below
        return (never if op == "gt" else always) if low > MOST else (always if op == "gt" else never) if low < LEAST else sides[op](F.lit(low))
    return (never if op == "gte" else always) if high > MOST else (always if op == "gte" else never) if high < LEAST else sides[op](F.lit(high))


def condition(df: DataFrame, name: str, op: str, value) -> Column:
    """One predicate. Numbers compare digit by digit in the column's type, so the test reaches the scan; text ignores case."""
    column, dtype = F.col(f"`{name}`"), df.schema[name].dataType
    if op in ("gt", "gte", "lt", "lte"):
        if is_time(dtype):
            limit = F.lit(value).cast(dtype)
            return {"gt": column > limit, "gte": column >= limit, "lt": column < limit, "lte": column <= limit}[op]
        return _compared(_number(df, name), dtype if is_number(dtype) else T.DoubleType(), op, value)
    if op == "contains":
        return F.contains(F.lower(column.cast("string")), F.lit(str(value).lower()))
    if op == "in":
        wanted = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
        if is_number(dtype):
            if isinstance(dtype, T.DecimalType):
                tests = [_compared(column, dtype, "eq", v) for v in wanted if _as_decimal(v) is not None]
                return reduce(or_, tests) if tests else F.when(column.isNotNull(), F.lit(False))
            if isinstance(dtype, T.IntegralType):
                whole = [n for n in map(_as_decimal, wanted) if n is not None and n == n.to_integral_value()]
                return column.isin([int(n) for n in whole if LEAST <= n <= MOST])
            return column.isin([n for n in map(_as_float, wanted) if n is not None])
        return F.lower(column.cast("string")).isin([str(v).lower() for v in wanted])
    if op not in ("eq", "neq"):
        raise ValueError(f"unknown operator {op}")
    if is_number(dtype):
        same = _compared(column, dtype, "eq", value)
    elif is_time(dtype):
        same = column == F.lit(value).cast(dtype)
    else:
        same = F.lower(column.cast("string")) == str(value).lower()
    return same if op == "eq" else ~same


def filter_rows(df: DataFrame, name: str, op: str, value) -> DataFrame:
    """Rows that meet one condition; null never matches."""
    return df.where(condition(df, name, op, value))


def filter_share(df: DataFrame, name: str, op: str, value) -> DataFrame:
    """Matching rows, all rows and the match share in one pass."""
    hit = F.coalesce(condition(df, name, op, value), F.lit(False))
    counts = df.agg(F.count_if(hit).alias("matched"), F.count("*").alias("total"))
    return counts.withColumn("match_pct", 100.0 * F.col("matched") / F.nullif(F.col("total"), F.lit(0)))


def filter_all(df: DataFrame, conditions: list[tuple[str, str, object]]) -> DataFrame:
    """Rows meeting every condition; a condition with an empty value is off."""
    live = [condition(df, n, op, v) for n, op, v in conditions if v not in (None, "", [])]
    return df.where(reduce(and_, live)) if live else df


def slice_rows(df: DataFrame, slicers: dict[str, object], conditions: list[tuple] = ()) -> DataFrame:
    """Dashboard slicers: exact equality per column, ``ALL`` switches one off; merged with chart conditions."""
    live = [F.col(f"`{n}`") == F.lit(v) for n, v in slicers.items() if v not in (None, "", "ALL")]
    kept = df.where(reduce(and_, live)) if live else df
    return filter_all(kept, list(conditions))


def search(df: DataFrame, text: str, per_column: dict[str, str] | None = None) -> DataFrame:
    """Rows where any column contains the text, ignoring case, and each named column its own text."""
    kept = df
    if text:
        tests = [condition(df, n, "contains", text) for n in df.columns]
        kept = kept.where(reduce(or_, [F.coalesce(t, F.lit(False)) for t in tests]))
    return filter_all(kept, [(n, "contains", v) for n, v in (per_column or {}).items()])


def rows_missing(df: DataFrame, level: str = "basic") -> DataFrame:
    """Rows with at least one missing cell."""
    return df.where(reduce(or_, [missing_in(df, n, level) for n in df.columns]))


def repeated_rows(df: DataFrame) -> DataFrame:
    """Each repeated row once with the number of its copies. Counting is map-side, so copies never meet in a task."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("_copies")).where(F.col("_copies") > 1)


def rows_duplicate(df: DataFrame) -> DataFrame:
    """All copies of every repeated row. The join key is a hash; all columns are compared null-safely after it.

    Rows with many copies are spread: of each repeated row a task gets one share of the copies beside one copy to compare with.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    cuts = _parts(heavy_keys(df.select(mark.alias("_mark")), "_mark"), TASK_SHARE)
    hot = F.col("_mark").isin(list(cuts)) if cuts else F.lit(False)
    most = max(cuts.values(), default=1)
    salt = F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(most))).otherwise(0)
    repeated = repeated_rows(df).drop("_copies").withColumn("_mark", mark)
    every = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    other = repeated.select(F.col("_mark").alias("_m"), F.explode(every).alias("_s"), *[F.col(f"`{c}`").alias("_r_" + c) for c in df.columns])
    match = [F.col("_mark") == F.col("_m"), F.col("_salt") == F.col("_s")]
    match += [F.col(f"`{c}`").eqNullSafe(F.col(f"`_r_{c}`")) for c in df.columns]
    return df.withColumn("_mark", mark).withColumn("_salt", salt).join(other, match, "left_semi").drop("_mark", "_salt")


def fences(df: DataFrame, names: list[str], keys: list[str] | None = None) -> DataFrame:
    """Per numeric column: quartiles and 1.5 * IQR fences, one row per column."""
    long = df.select(*(keys or []), *[F.col(f"`{n}`").cast("double").alias(n) for n in names]).unpivot(
        keys or [], names, "column", "value"
    )
    q = exact_quantiles(long, [*(keys or []), "column"], F.col("value"), {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"iqr": iqr, "low": F.col("q1") - 1.5 * iqr, "high": F.col("q3") + 1.5 * iqr})


def fence_row(df: DataFrame, names: list[str]) -> Column:
    """The fences of the named columns as a map column (one entry per column) from a scalar subquery."""
    wide = fences(df, names).agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("q1", "q3", "iqr", "low", "high")))).alias("m")
    )
    return wide.scalar()


def rows_outlier(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows with a value outside the IQR fences in any numeric column."""
    names = names or [f.name for f in df.schema.fields if is_number(f.dataType)]
    tests = [(F.col(f"`{n}`") < F.col("_f")[n]["low"]) | (F.col(f"`{n}`") > F.col("_f")[n]["high"]) for n in names]
    return df.withColumn("_f", fence_row(df, names)).where(reduce(or_, tests)).drop("_f")


def columns_of_kind(df: DataFrame, kind: str) -> DataFrame:
    """Only the columns of a storage kind: number, text, time or other."""
    tests = {"number": is_number, "text": is_text, "time": is_time}
    if kind == "other":
        keep = [f.name for f in df.schema.fields if not any(t(f.dataType) for t in tests.values())]
    else:
        keep = [f.name for f in df.schema.fields if tests[kind](f.dataType)]
    return df.select(*[f"`{n}`" for n in keep])


def slicer_values(df: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """The distinct non-blank values in order, over all rows; with a ``limit`` the first ones."""
    column = F.col(f"`{name}`")
    values = df.where(~missing_in(df, name)).select(column.alias("value")).distinct().orderBy("value")
    return values if limit is None else values.limit(limit)


def systematic_sample(df: DataFrame, order: list[str], points: int = 500) -> DataFrame:
    """Every k-th row in a total order, k = max(1, floor(rows / points)); ties fall to the remaining columns."""
    rest = [c for c in df.columns if c not in order]
    numbered = number_rows(df, [F.col(f"`{c}`") for c in [*order, *rest]], "_no")
    step = df.select(F.greatest(F.lit(1), F.floor(F.count("*") / points)).cast("long")).scalar()
    return numbered.where((F.col("_no") - 1) % step == 0).drop("_no")


def sort_page(df: DataFrame, name: str, ties: list[str], page: int, size: int, descending: bool = False) -> DataFrame:
    """One page of the table sorted by a column, nulls last, text ignoring case."""
    column = F.col(f"`{name}`")
    key = F.lower(column) if is_text(df.schema[name].dataType) else column
    first = key.desc_nulls_last() if descending else key.asc_nulls_last()
    return df.orderBy(first, *[F.col(f"`{t}`") for t in ties]).offset((page - 1) * size).limit(size)


def parsed_dates(df: DataFrame, name: str) -> Column:
    """The column as timestamp_ntz, parsing text by the known layouts."""
    column = F.col(f"`{name}`")
    return parse_date(column) if is_text(df.schema[name].dataType) else column.cast("timestamp_ntz")


