"""The calendar aggregate over a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framewright.functions.dates import period_key, period_start
from framewright.functions.numbers import finite


def stream_periods(stream: DataFrame, date: str, metric: str, grain: str = "daily", delay: str = "1 day",
                   keys: list[str] | None = None) -> DataFrame:
    """Sum and count per period of a streaming table.

    Periods are event-time windows of one day under a watermark, so state is dropped as days close; coarser grains are
    folded from the daily rows downstream with ``fold_days``.
    """
    stamped = stream.withColumn("_at", F.col(f"`{date}`").cast("timestamp")).withWatermark("_at", delay)
    days = stamped.groupBy(*(keys or []), F.window("_at", "1 day").alias("_w")).agg(
        F.sum(finite(F.col(f"`{metric}`"))).alias("value"), F.count("*").alias("records")
    )
    return days.select(*(keys or []), F.col("_w.start").cast("date").alias("period_start"), "value", "records")


def fold_days(days: DataFrame, grain: str, keys: list[str] | None = None) -> DataFrame:
    """Daily rows as a coarser calendar grain."""
    start = period_start(F.col("period_start"), grain)
    out = days.groupBy(*(keys or []), start.alias("start")).agg(F.sum("value").alias("value"), F.sum("records").alias("records"))
    return out.select(*(keys or []), period_key(F.col("start"), grain).alias("period"), "value", "records")
