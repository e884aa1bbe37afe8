"""Calendar aggregation with growth, running totals and moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.functions.dates import grain_for_days, next_start, period_key, period_label, period_start
from framewright.functions.numbers import half_up, number_of, ratio
from framewright.operators.aggregate import grouped, label, top_keys
from framewright.operators.filters import parsed_dates
from framewright.operators.scale import join_keys

# Default moving-average windows per grain.
DEFAULT_WINDOW = {"daily": 7, "weekly": 2, "monthly": 3, "quarterly": 2, "yearly": 2}
PRESETS = ("last_7_days", "last_30_days", "last_90_days", "this_month", "last_month", "this_quarter", "last_quarter",
           "this_year", "last_year", "custom", "all_time")


def date_span(df: DataFrame, date: str):
    """First and last date, one bounded row brought to the driver."""
    day = parsed_dates(df, date)
    return df.agg(F.min(day).alias("lo"), F.max(day).alias("hi")).first()


def in_preset(df: DataFrame, date: str, preset: str, start=None, end=None) -> DataFrame:
    """Rows of a date preset counted back from the latest date in the data."""
    if preset == "all_time":
        return df
    day = parsed_dates(df, date)
    if preset == "custom":
        kept = df
        if start is not None:
            kept = kept.where(day >= F.lit(start).cast("timestamp_ntz"))
        if end is not None:
            kept = kept.where(day <= F.lit(end).cast("timestamp_ntz"))
        return kept
    last = date_span(df, date)["hi"]
    anchor = F.lit(last).cast("timestamp_ntz")
    if preset.endswith("_days"):
        days = int(preset.split("_")[1])
        return df.where((day >= anchor - F.expr(f"interval {days} days")) & (day <= anchor))
    which, unit = preset.split("_")
    first = F.trunc(anchor.cast("date"), unit)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    if which == "this":
        return df.where((day >= first.cast("timestamp_ntz")) & (day <= anchor))
    return df.where((day >= F.add_months(first, -months).cast("timestamp_ntz")) & (day < first.cast("timestamp_ntz")))


def resolve_grain(df: DataFrame, date: str, grain: str = "auto", limits=(14, 90, 1095, 3650)) -> str:
    """The asked grain, or the one that fits the span of the data."""
    if grain != "auto":
        return grain
    span = date_span(df, date)
    if span["lo"] is None:
        return "monthly"
    return grain_for_days((span["hi"] - span["lo"]).total_seconds() / 86_400, limits)


def growth(current: Column, before: Column, digits: int = 1) -> Column:
    """Percent change against the previous period; from zero it is 100 when positive, else 0."""
    change = half_up((current - before) / F.abs(F.nullif(before, F.lit(0.0))) * 100, digits)
    return F.when(before.isNull(), F.lit(None)).when(before == 0, F.when(current > 0, 100.0).otherwise(0.0)).otherwise(change)


def periods(df: DataFrame, date: str, metric: str | None, agg: str = "sum", grain: str = "monthly",
            keys: list[str] | None = None) -> DataFrame:
    """One row per calendar period (and key): start, key, label, value and record count.

    A metric that is no number leaves the row out of the value but not of the count; undated rows are left out.
    """
    keys = keys or []
    day = parsed_dates(df, date)
    src = df.withColumn("period_start", period_start(day, grain)).where(F.col("period_start").isNotNull())
    out = grouped(src, [*keys, "period_start"], None if metric is None else F.col(f"`{metric}`"), agg)
    rounded = half_up(F.col("value"), 2)
    return out.select(
        *keys, "period_start", period_key(F.col("period_start"), grain).alias("period"),
        period_label(F.col("period_start"), grain).alias("label"), rounded.alias("value"), "records",
    )


def with_running(points: DataFrame, grain: str, window: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Growth, running total and full-window moving average over aggregated periods (bounded by the calendar)."""
    window = window or DEFAULT_WINDOW[grain]
    order = Window.partitionBy(*(keys or [])).orderBy("period_start")
    frame = order.rowsBetween(1 - window, 0)
    return points.select(
        "*",
        growth(F.col("value"), F.lag("value").over(order)).alias("growth_pct"),
        half_up(F.sum("value").over(order.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("cumulative"),
        F.when(F.count("*").over(frame) == window, half_up(F.avg("value").over(frame), 2)).alias("moving_avg"),
    )


def temporal(df: DataFrame, date: str, metric: str | None, agg: str = "sum", grain: str = "auto",
             preset: str = "all_time", window: int | None = None, keys: list[str] | None = None, start=None,
             end=None) -> DataFrame:
    """Filter by date range, pick the grain, aggregate per period and add growth, running total, moving average."""
    kept = in_preset(df, date, preset, start, end)
    resolved = resolve_grain(kept, date, grain)
    return with_running(periods(kept, date, metric, agg, resolved, keys), resolved, window, keys)


def dense_periods(points: DataFrame, grain: str) -> DataFrame:
    """All calendar periods between the first and the last, gaps flagged and valued 0."""
    step = {"daily": "1 day", "weekly": "7 days", "monthly": "1 month", "quarterly": "3 months", "yearly": "1 year"}[grain]
    frame = points.agg(F.min("period_start").alias("lo"), F.max("period_start").alias("hi")).where("lo is not null")
    frame = frame.select(F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("period_start"))
    joined = frame.join(points.select("period_start", "value", "records"), "period_start", "left")
    return joined.select(
        "period_start", period_key(F.col("period_start"), grain).alias("period"),
        F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("records", F.lit(0)).cast("long").alias("records"),
        F.col("records").isNull().alias("is_gap"),
    )


def compare_periods(points: DataFrame, grain: str, mode: str = "previous", keys: list[str] | None = None) -> DataFrame:
    """Value against the previous period or the same period a year ago, by calendar and not by row distance.

    Points of several series name their ``keys``; each is compared with itself.
    """
    keys = keys or []
    back = {"daily": 365, "weekly": 52, "monthly": 12, "quarterly": 4, "yearly": 1}[grain] if mode == "year" else 1
    if mode == "year" and grain == "daily":  # from the row's own day, as 28 and 29 February lead to one day a year on
        earlier = points.select(*keys, F.col("period_start").alias("_then"), F.col("value").alias("base_value"))
        seen = points.withColumn("_then", F.add_months("period_start", -12).cast(points.schema["period_start"].dataType))
        key = "_then"
    else:
        moved, seen, key = next_start(F.col("period_start"), grain, back), points, "period_start"
        earlier = points.select(*keys, moved.alias(key), F.col("value").alias("base_value"))
    earlier = earlier.groupBy(*keys, key).agg(F.max("base_value").alias("base_value"))
    joined = join_keys(seen, earlier, [*keys, key], "left")
    return joined.select(
        *keys, "period_start", "period", "value", "base_value", half_up(F.col("value") - F.col("base_value"), 2).alias("delta"),
        growth(F.col("value"), F.col("base_value")).alias("change_pct"),
    )


def series_by(df: DataFrame, date: str, metric: str, dimension: str, agg: str = "sum", grain: str = "monthly",
              top: int | None = None) -> DataFrame:
    """Period by series in long form: every cell with rows, or, with ``top``, the largest series by total with 0 where
    one has no rows."""
    src = df.withColumn("series", label(df, dimension))
    if top is None:
        return periods(src, date, metric, agg, grain, ["series"]).select("period", "series", "value", "records")
    names = top_keys(src, "series", top, number_of(df, metric))
    cells = periods(src.join(F.broadcast(names), "series", "left_semi"), date, metric, agg, grain, ["series"])
    every = names.agg(F.collect_list("series").alias("s")).scalar()
    frame = periods(src, date, None, "count", grain).select("period_start", "period", F.explode(every).alias("series"))
    joined = frame.join(cells.select("period_start", "series", "value", "records"), ["period_start", "series"], "left")
    return joined.select(
        "period", "series", F.coalesce("value", F.lit(0.0)).alias("value"),
        F.coalesce("records", F.lit(0)).cast("long").alias("records"),
    )


def temporal_summary(points: DataFrame, agg: str = "sum") -> DataFrame:
    """Records, periods, total (or mean), mean per period, peak, trough and overall growth."""
    total = F.sum("value") if agg in ("sum", "count") else half_up(F.avg("value"), 2)
    out = points.agg(
        F.sum("records").alias("records"), F.count("*").alias("periods"), total.alias("total"),
        F.min_by("period", F.struct(-F.col("value"), F.col("period"))).alias("peak_period"), F.max("value").alias("peak"),
        F.min_by("period", F.struct(F.col("value"), F.col("period"))).alias("trough_period"),
        F.min("value").alias("trough"), F.min_by("value", "period_start").alias("first_value"),
        F.max_by("value", "period_start").alias("last_value"),
    )
    overall = ratio(F.col("last_value") - F.col("first_value"), F.abs(F.col("first_value"))) * 100
    return out.select(
        F.col("records").cast("long").alias("records"), "periods", half_up(F.col("total"), 2).alias("total"),
        half_up(F.col("total") / F.col("periods"), 2).alias("avg_per_period"), "peak_period", "peak", "trough_period",
        "trough", F.coalesce(half_up(overall, 1), F.lit(0.0)).alias("overall_growth_pct"),
    )


def eda_trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Period sums on the finer automatic grain with change and partial three-period average."""
    grain = resolve_grain(df, date, "auto", (14, 90, 730, 1825))
    day = parsed_dates(df, date)
    src = df.select(day.alias("_d"), number_of(df, metric).alias("_v")).where("_d is not null and _v is not null")
    if grain == "weekly":
        period = F.concat(F.date_format("_d", "yyyy-MM"), F.lit("-W"), F.ceil(F.dayofmonth("_d") / 7).cast("string"))
    else:
        period = period_key(F.col("_d"), grain)
    points = src.groupBy(period.alias("period")).agg(
        half_up(F.sum("_v"), 2).alias("value"), F.count("*").alias("records")
    )
    order = Window.orderBy("period")
    before = F.lag("value").over(order)
    change = half_up((F.col("value") - before) / F.abs(F.nullif(before, F.lit(0.0))) * 100, 1)
    return points.select(
        "period", "value", "records", change.alias("change_pct"),
        half_up(F.avg("value").over(order.rowsBetween(-2, 0)), 2).alias("moving_avg"),
    )


def eda_trend_summary(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Growth, mean change, peak, trough and the direction of the trend."""
    points = eda_trend(df, date, metric)
    out = points.agg(
        F.count("*").alias("periods"), F.min_by("value", "period").alias("first_value"),
        F.max_by("value", "period").alias("last_value"), half_up(F.avg("change_pct"), 1).alias("avg_change"),
        F.min_by("period", F.struct(-F.col("value"), F.col("period"))).alias("peak_period"),
        F.min_by("period", F.struct(F.col("value"), F.col("period"))).alias("trough_period"),
    )
    grew = F.when(
        F.col("first_value") > 0, half_up((F.col("last_value") - F.col("first_value")) / F.col("first_value") * 100, 1)
    ).otherwise(0.0)
    drift = F.coalesce(F.col("avg_change"), F.lit(0.0))
    way = F.when(grew > 10, "GROWING").when(grew < -10, "DECLINING").when(F.abs(drift) > 25, "VOLATILE")
    return out.select(
        "periods", grew.alias("growth_pct"), drift.alias("avg_change_pct"), "peak_period", "trough_period",
        way.otherwise("STABLE").alias("direction"),
    )


def daily_trend(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Sum, mean and count per date."""
    day = parsed_dates(df, date).cast("date")
    value = number_of(df, metric)
    return df.where(day.isNotNull()).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(
        half_up(F.sum(value), 2).alias("sum"), half_up(F.avg(value), 2).alias("avg"), F.count(value).alias("records")
    )


# Words in metric names and the symbols of currencies.
MONEY_NAME = "revenue|sales|profit|cost|price|income|salary|spend|mrr|arr|gmv"
SHARE_NAME = "rate|percentage|pct|margin|ratio|growth|discount"
COUNT_NAME = "count|orders|items|users|sessions|quantity|qty"
CURRENCIES = (("inr|rupee|₹", "₹"), ("eur|euro|€", "€"), ("gbp|pound|£", "£"))


def metric_unit(name: str) -> dict:
    """Unit of a metric from its name."""
    import re

    lower = name.lower()
    if re.search(MONEY_NAME, lower):
        symbol = next((s for words, s in CURRENCIES if re.search(words, lower)), "$")
        return {"type": "currency", "prefix": symbol, "suffix": ""}
    if re.search(SHARE_NAME, lower):
        return {"type": "percentage", "prefix": "", "suffix": "%"}
    return {"type": "count" if re.search(COUNT_NAME, lower) else "number", "prefix": "", "suffix": ""}


def unit_of_metric(name: Column) -> Column:
    """The same for a column of metric names: a struct of type, prefix and suffix."""
    lower = F.lower(name)
    symbol = F.coalesce(*[F.when(lower.rlike(words), F.lit(s)) for words, s in CURRENCIES], F.lit("$"))
    kind = F.when(lower.rlike(MONEY_NAME), "currency").when(lower.rlike(SHARE_NAME), "percentage").when(
        lower.rlike(COUNT_NAME), "count").otherwise("number")
    return F.struct(kind.alias("type"), F.when(kind == "currency", symbol).otherwise("").alias("prefix"),
                    F.when(kind == "percentage", "%").otherwise("").alias("suffix"))


