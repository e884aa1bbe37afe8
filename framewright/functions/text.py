"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
# Phrases neutralised in text that goes to a model, with what replaces each, in this order.
UNSAFE_PHRASES = [
    (r"ignore\s+previous\s+instructions", "[DATA_SANITIZED: instruction bypass attempt]"),
    (r"system\s+prompt", "[DATA_SANITIZED: system token]"),
    (r"reveal\s+api\s*key", "[DATA_SANITIZED: credential request]"),
    (r"system\s*:", "data_label:"),
    (r"assistant\s*:", "data_label:"),
    (r"user\s*:", "data_label:"),
]


def sanitize(text: Column, limit: int | None = None) -> Column:
    """The whole text with unsafe phrases replaced; with a ``limit``, a longer result ends in ``...``."""
    safe = F.coalesce(text, F.lit(""))
    for phrase, mark in UNSAFE_PHRASES:
        safe = F.regexp_replace(safe, "(?i)" + phrase, mark)
    if limit is None:
        return safe
    return F.when(F.length(safe) > limit, F.concat(F.substring(safe, 1, limit - 3), F.lit("..."))).otherwise(safe)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def fold_key(text: Column) -> Column:
    """Join and grouping form of a text key: trimmed, lower case, blank as null."""
    folded = F.lower(F.trim(text.cast("string")))
    return F.when(folded != "", folded)


def key_text(column: Column, dtype: T.DataType) -> Column:
    """Comparable text of a key of any type: whole numbers without decimals, text folded, blank as null."""
    if isinstance(dtype, T.DecimalType):
        return F.regexp_replace(column.cast("string"), r"\.0+$", "")
    if is_number(dtype) and not isinstance(dtype, INTEGRAL):
        whole = (column == F.floor(column)) & (F.abs(column) < float(2**63))
        return F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string"))
    return fold_key(column)


def bare(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def pretty_name(name: str) -> str:
    """order_totalPrice -> Order Total Price (column names are schema, so this is plain text work)."""
    import re

    spaced = re.sub(r"([a-z])([A-Z])", r"\1 \2", name.replace("_", " "))
    return " ".join(part[:1].upper() + part[1:] for part in spaced.split())


def cased(text: Column, style: str) -> Column:
    """Trimmed text in title, lower or upper case."""
    trimmed = F.trim(text)
    return {"title": F.initcap, "lower": F.lower, "upper": F.upper}[style](trimmed)
