"""Numeric expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Symbols that may surround a number written as text, and the accepted number syntax.
NUMBER_SYMBOLS = r"[$,€£₹¥%\s]"
PLAIN_SYMBOLS = r"[$,€£¥%]"
NUMBER_SYNTAX = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def half_up(value: Column, digits: int = 0) -> Column:
    """Round half towards positive infinity at ``digits`` decimals, as a double.

    Four more digits are rounded first: a sum that is a half but for its last bits then rounds the same way in whatever
    order its rows were added. Numbers that have no digits left to round are returned as they are.
    """
    scale, number = float(10**digits), value.cast("double")
    rounded = F.floor(F.round(number * scale, 4) + 0.5).cast("double") / scale
    return F.when(F.abs(number * scale) < float(2**52), rounded).otherwise(number)


def to_number(text: Column, symbols: str = NUMBER_SYMBOLS) -> Column:
    """Text such as ``$1,234.50`` or ``12 %`` as a double, else null."""
    bare = F.trim(F.regexp_replace(text.cast("string"), symbols, ""))
    number = F.when(bare.rlike(NUMBER_SYNTAX), bare).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def finite(value: Column) -> Column:
    """The value as a double, null for NaN, the infinities and what cannot be read."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def number_of(df: DataFrame, name: str) -> Column:
    """The numeric reading of a column, also of numbers written as text; null where there is none."""
    column = F.col(f"`{name}`")
    return to_number(column) if df.schema[name].dataType.typeName() in ("string", "varchar", "char") else finite(column)


def ratio(top: Column, bottom: Column) -> Column:
    """Division that yields null for a zero or null divisor."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole rounded half up; 0 for an empty whole."""
    return F.coalesce(half_up(ratio(part, whole) * 100, digits), F.lit(0.0))


def sample_skewness(population: Column, n: Column) -> Column:
    """Bias-corrected skewness G1 from Spark's population skewness; null below three values."""
    count = n.cast("double")
    return F.when(n > 2, population * F.sqrt(count * (count - 1)) / (count - 2))


def sample_kurtosis(population: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population excess; null below four values."""
    count = n.cast("double")
    return F.when(n > 3, (count - 1) / ((count - 2) * (count - 3)) * ((count + 1) * population + 6))


def compact(value: Column, prefix: str = "", suffix: str = "") -> Column:
    """1234 -> 1.2k, 2500000 -> 2.50M, with unit marks around."""
    size = F.abs(value)
    body = (
        F.when(size >= 1_000_000, F.concat(F.format_string("%.2f", half_up(value / 1_000_000, 2)), F.lit("M")))
        .when(size >= 1_000, F.concat(F.format_string("%.1f", half_up(value / 1_000, 1)), F.lit("k")))
        .otherwise(F.format_string("%.2f", half_up(value, 2)))
    )
    return F.concat(F.lit(prefix), body, F.lit(suffix))


def plain_text(value: Column) -> Column:
    """A number as text without exponent and trailing zeros, to six decimals."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value), "[.]?0+$", ""))
