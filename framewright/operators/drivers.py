"""What changed a metric between two halves of the calendar, and by which factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions.numbers import half_up, number_of, percent, ratio
from framewright.operators.aggregate import label
from framewright.operators.filters import parsed_dates
from framewright.operators.scale import number_rows, one_row


def middle_date(df: DataFrame, date: str) -> Column:
    """The first date of the second half of the distinct dates, as a scalar."""
    days = df.select(parsed_dates(df, date).alias("d")).where("d is not null").distinct()
    numbered = number_rows(days, [F.col("d")], "no")
    half = days.agg(F.floor(F.count("*") / 2).cast("long").alias("h")).scalar()
    return numbered.where(F.col("no") == half + 1).agg(F.min("d").alias("d")).scalar()


def split_halves(df: DataFrame, date: str, metric: str) -> DataFrame:
    """Rows with ``_v`` and ``_current`` (the later half of the distinct dates)."""
    day = parsed_dates(df, date)
    return df.where(day.isNotNull()).withColumns({
        "_v": F.coalesce(number_of(df, metric), F.lit(0.0)), "_current": day >= middle_date(df, date)
    })


def driver_totals(df: DataFrame, metric: str, date: str) -> DataFrame:
    """Baseline and current total with their difference, one row."""
    sums = split_halves(df, date, metric).agg(
        F.sum(F.when(~F.col("_current"), F.col("_v"))).alias("b"), F.sum(F.when(F.col("_current"), F.col("_v"))).alias("c")
    )
    gap = F.col("c") - F.col("b")
    return sums.select(
        half_up(F.col("b"), 2).alias("baseline_total"), half_up(F.col("c"), 2).alias("current_total"),
        half_up(gap, 2).alias("total_delta"), half_up(F.coalesce(ratio(gap, F.col("b")), F.lit(0.0)) * 100, 1).alias("delta_pct"),
    )


def driver_delta(df: DataFrame, metric: str, date: str, dimensions: list[str], top: int | None = None) -> DataFrame:
    """Change per factor of every dimension with its share of the total change, largest first, or the ``top`` of them.

    Dimensions are unpivoted, so all factors come from one conditional sum.
    """
    dims = list(dimensions)
    halves = split_halves(df, date, metric)
    src = halves.select("_v", "_current", *[label(df, d).alias(d) for d in dims])
    totals = one_row(src.agg(
        (F.sum(F.when(F.col("_current"), F.col("_v")).otherwise(-F.col("_v")))).alias("delta")
    ))
    long = src.unpivot(["_v", "_current"], dims, "dimension", "factor")
    sums = long.groupBy("dimension", "factor").agg(
        F.coalesce(F.sum(F.when(~F.col("_current"), F.col("_v"))), F.lit(0.0)).alias("b"),
        F.coalesce(F.sum(F.when(F.col("_current"), F.col("_v"))), F.lit(0.0)).alias("c"),
    )
    rows = sums.withColumn("gap", F.col("c") - F.col("b")).withColumn("_t", totals)
    share = F.coalesce(ratio(F.col("gap"), F.abs(F.col("_t.delta"))) * 100, F.lit(0.0))
    out = rows.where(F.abs("gap") > 0.001).select(
        "dimension", "factor", half_up(F.col("b"), 2).alias("baseline"), half_up(F.col("c"), 2).alias("current"),
        half_up(F.col("gap"), 2).alias("delta"), half_up(share, 1).alias("contribution_pct"),
        F.when(F.col("gap") > 0, "favorable").otherwise("unfavorable").alias("direction"),
        F.when(F.abs(share) > 20, "MAJOR").when(F.abs(share) > 8, "MODERATE").otherwise("MINOR").alias("significance"),
    )
    out = out.orderBy(F.abs("delta").desc(), "dimension", "factor")
    return out if top is None else out.limit(top)


def decompose_profit(df: DataFrame, revenue: str, cost: str) -> DataFrame:
    """Profit as revenue minus cost."""
    facts = df.agg(F.sum(number_of(df, revenue)).alias("r"), F.sum(number_of(df, cost)).alias("c"))
    rows = F.array(
        F.struct(F.lit("profit").alias("part"), half_up(F.col("r") - F.col("c"), 2).alias("value")),
        F.struct(F.lit(revenue).alias("part"), half_up(F.col("r"), 2).alias("value")),
        F.struct(F.lit(cost).alias("part"), half_up(F.col("c"), 2).alias("value")),
    )
    return facts.select(F.inline(rows)).withColumn(
        "pct_of_revenue",
        percent(F.col("value"), facts.select("r").scalar(), 1),
    )


def decompose_volume(df: DataFrame, metric: str) -> DataFrame:
    """A total as number of rows times average value."""
    facts = df.agg(F.count("*").alias("n"), F.sum(number_of(df, metric)).alias("s"))
    rows = F.array(
        F.struct(F.lit("total").alias("part"), half_up(F.col("s"), 2).alias("value")),
        F.struct(F.lit("volume").alias("part"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit("average_value").alias("part"), half_up(ratio(F.col("s"), F.col("n")), 2).alias("value")),
    )
    return facts.select(F.inline(rows))
