"""Date parsing and calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The text layouts tried, first match wins; and what a date looks like.
DATE_LAYOUTS = [
    (r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"),
    (r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}$", "yyyy/M/d"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}", None),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "d/M/yyyy"),
    (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "d-M-yyyy"),
    (r"^[A-Za-z]{3} [0-9]{1,2}, [0-9]{4}$", "MMM d, yyyy"),
]
DATE_SHAPE = (
    r"^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}"
    r"|[A-Za-z]{3,9}\s+[0-9]{1,2},?\s+[0-9]{4}"
)
GRAINS = ("daily", "weekly", "monthly", "quarterly", "yearly")


def parse_date(text: Column) -> Column:
    """Text as a timestamp_ntz by the known layouts, null when none fits."""
    trimmed = F.trim(text)
    tries = []
    for shape, layout in DATE_LAYOUTS:
        candidate = F.when(trimmed.rlike(shape), trimmed)
        if layout is None:
            tries.append(F.to_timestamp_ntz(F.try_to_timestamp(F.regexp_replace(candidate, "T", " ").substr(1, 19))
                                            .cast("string")))
        else:
            tries.append(F.try_to_timestamp(candidate, F.lit(layout)).cast("timestamp_ntz"))
    return F.coalesce(*tries)


def period_start(when: Column, grain: str) -> Column:
    """First day of the calendar period as a date; weeks are ISO weeks starting on Monday."""
    day = when.cast("date")
    unit = {"weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}
    return day if grain == "daily" else F.trunc(day, unit[grain])


def period_key(when: Column, grain: str) -> Column:
    """Sortable period text: 2024-03-09, 2024-W10, 2024-03, 2024-Q1, 2024."""
    day = when.cast("date")
    if grain == "daily":
        return F.date_format(day, "yyyy-MM-dd")
    if grain == "weekly":
        iso_year = F.year(F.date_add(F.trunc(day, "week"), 3))
        return F.format_string("%04d-W%02d", iso_year, F.weekofyear(day))
    if grain == "monthly":
        return F.date_format(day, "yyyy-MM")
    if grain == "quarterly":
        return F.format_string("%04d-Q%d", F.year(day), F.quarter(day))
    return F.date_format(day, "yyyy")


def period_label(when: Column, grain: str) -> Column:
    """Display text: 9 Mar 2024, W10 2024, Mar 2024, Q1 2024, 2024."""
    day = when.cast("date")
    if grain == "daily":
        return F.date_format(day, "d MMM yyyy")
    if grain == "weekly":
        return F.format_string("W%02d %04d", F.weekofyear(day), F.year(F.date_add(F.trunc(day, "week"), 3)))
    if grain == "monthly":
        return F.date_format(day, "MMM yyyy")
    if grain == "quarterly":
        return F.format_string("Q%d %04d", F.quarter(day), F.year(day))
    return F.date_format(day, "yyyy")


def next_start(start: Column, grain: str, steps: int = 1) -> Column:
    """The start ``steps`` periods later (earlier when negative)."""
    if grain == "daily":
        return F.date_add(start, steps)
    if grain == "weekly":
        return F.date_add(start, 7 * steps)
    months = {"monthly": 1, "quarterly": 3, "yearly": 12}[grain]
    return F.add_months(start, months * steps)


def grain_for_days(days: float, limits: tuple[int, ...] = (14, 90, 1095, 3650)) -> str:
    """The grain an ``auto`` request resolves to for a span of days."""
    for limit, grain in zip(limits, GRAINS):
        if days <= limit:
            return grain
    return "yearly"
