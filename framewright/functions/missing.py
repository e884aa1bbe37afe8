"""What counts as a missing cell: three named levels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Words that stand for a missing cell.
FILL_WORDS = ["na", "n/a", "null", "none", "-", "--", "nil"]
PROFILE_WORDS = FILL_WORDS + ["undefined", "missing", "#n/a"]


def is_missing(column: Column, dtype: T.DataType, level: str = "basic") -> Column:
    """``basic``: null, empty text, NaN. ``fill`` and ``profile`` add blank text and placeholder words."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return column.isNull() | F.isnan(column)
    if not isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return column.isNull()
    if level == "basic":
        return column.isNull() | (column == "")
    words = {"fill": FILL_WORDS, "profile": PROFILE_WORDS}[level]
    return column.isNull() | F.lower(F.trim(column)).isin(["", *words])


def missing_in(df, name: str, level: str = "basic") -> Column:
    """The predicate for a column of ``df``."""
    return is_missing(F.col(f"`{name}`"), df.schema[name].dataType, level)
