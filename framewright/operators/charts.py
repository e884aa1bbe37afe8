"""Chart-ready aggregates: series, distributions, bridges, points and headline figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.functions.numbers import half_up, number_of, percent, ratio
from framewright.operators.aggregate import grouped, label
from framewright.operators.filters import systematic_sample
from framewright.operators.scale import exact_quantiles, join_keys, one_row, settle


def bar(df: DataFrame, dimension: str, metric: str | None = None, agg: str = "sum", sort: str = "desc",
        top: int | None = None) -> DataFrame:
    """One dimension, one measure (rows when no metric is given), sorted, optionally the top N."""
    src = df.withColumn("category", label(df, dimension))
    out = grouped(src, ["category"], None if metric is None else F.col(f"`{metric}`"), agg)
    out = out.select("category", half_up(F.col("value"), 2).alias("value"), "records")
    if sort != "none":
        first = F.col("value").desc_nulls_last() if sort == "desc" else F.col("value").asc_nulls_last()
        out = out.orderBy(first, "category")
    return out if top is None else out.limit(top)


def multi_series(df: DataFrame, dimension: str, series: str, metric: str | None = None, agg: str = "sum",
                 top: int | None = None, max_series: int | None = None) -> DataFrame:
    """Dimension by series in columns with the total over all series; absent cells are 0.

    Every series gets a column; with ``max_series`` the largest ones do and the others share the column ``other_series``.
    Totals and ``other_series`` are measured on the rows, as means, medians and distinct counts cannot be added up.
    """
    src = df.withColumns({"category": label(df, dimension), "_series": label(df, series)})
    value = None if metric is None else F.col(f"`{metric}`")
    found = src.groupBy("_series").agg(F.count("*").alias("records"))
    ranked = found.orderBy(F.col("records").desc(), "_series").select("_series")
    names = [r[0] for r in (ranked if max_series is None else ranked.limit(max_series + 1)).collect()]
    more = max_series is not None and len(names) > max_series
    names = names[:max_series] if more else names
    slot = F.when(F.col("_series").isin(names), F.col("_series")) if more else F.col("_series")
    cells = grouped(src.withColumn("_slot", slot), ["category", "_slot"], value, agg)
    columns = [(n, F.col("_slot") == n) for n in sorted(names)]
    if more:
        columns.append(("other_series", F.col("_slot").isNull()))
    sums = [half_up(F.coalesce(F.sum(F.when(test, F.col("value"))), F.lit(0.0)), 2).alias(n) for n, test in columns]
    if value is None or agg in ("sum", "count"):
        wide = cells.groupBy("category").agg(*sums, half_up(F.sum("value"), 2).alias("total"))
    else:
        total = grouped(src, ["category"], value, agg, "total").select("category", half_up(F.col("total"), 2).alias("total"))
        wide = join_keys(cells.groupBy("category").agg(*sums), total, ["category"])
    wide = wide.orderBy(F.col("total").desc(), "category")
    return wide if top is None else wide.limit(top)


def box_plot(df: DataFrame, metric: str, group: str | None = None) -> DataFrame:
    """Five-number summary with mean, IQR, clipped fences, outlier count and row count per group."""
    name = F.lit("Overall") if group is None else F.coalesce(F.trim(F.col(f"`{group}`").cast("string")), F.lit("Overall"))
    src = df.select(name.alias("category"), number_of(df, metric).alias("_v")).where(F.col("_v").isNotNull())
    base = src.groupBy("category").agg(
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.avg("_v").alias("mean"), F.count("*").alias("count")
    )
    quart = exact_quantiles(src, ["category"], F.col("_v"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    box = join_keys(base, quart, ["category"])
    iqr = F.col("q3") - F.col("q1")
    box = box.withColumns({
        "iqr": iqr, "low": F.greatest(F.col("min"), F.col("q1") - 1.5 * iqr),
        "high": F.least(F.col("max"), F.col("q3") + 1.5 * iqr),
    })
    box, small = settle(box)
    limits = box.select("category", "low", "high")
    outside = join_keys(src, F.broadcast(limits) if small else limits, ["category"]).groupBy("category").agg(
        F.count_if((F.col("_v") < F.col("low")) | (F.col("_v") > F.col("high"))).alias("outliers")
    )
    numbers = ["min", "q1", "median", "q3", "max", "mean", "iqr", "low", "high"]
    return join_keys(box, outside, ["category"]).select(
        "category", *[half_up(F.col(n), 2).alias(n) for n in numbers], "outliers", "count"
    )


def box_top_groups(df: DataFrame, metric: str, group: str, top: int | None = None) -> DataFrame:
    """Box plots of the groups with at least two values, highest medians first; with ``top`` only the first ones."""
    found = box_plot(df, metric, group).where(F.col("count") >= 2).orderBy(F.col("median").desc(), "category")
    return found if top is None else found.limit(top)


def bin_count(n: Column, rule: str) -> Column:
    """Number of bins: ``profile`` floor in 4..8, ``chart`` ceil in 5..15, ``report`` round in 5..12 of sqrt(n)."""
    root = F.sqrt(n.cast("double"))
    form, low, high = {
        "profile": (F.floor(root), 4, 8), "chart": (F.ceil(root), 5, 15), "report": (F.floor(root + 0.5), 5, 12)
    }[rule]
    return F.greatest(F.lit(low), F.least(F.lit(high), form)).cast("int")


def histogram(df: DataFrame, metric: str, rule: str = "chart") -> DataFrame:
    """Equal-width bins with a closed last bin; empty bins stay with count 0."""
    src = df.select(number_of(df, metric).alias("_v")).where(F.col("_v").isNotNull())
    facts = src.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    facts = facts.withColumn("bins", bin_count(F.col("n"), rule))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    facts = facts.withColumn("width", F.when(width > 0, width).otherwise(1.0))
    bounds = one_row(facts)
    placed = src.withColumn("_b", bounds).select(
        F.least(F.floor((F.col("_v") - F.col("_b.lo")) / F.col("_b.width")), F.col("_b.bins") - 1)
        .cast("long").alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count("*").alias("records"))
    frame = facts.where(F.col("n") > 0).select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("bins") - 1).cast("long"))).alias("bin")
    )
    top = F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(
        F.col("lo") + (F.col("bin") + 1) * F.col("width")
    )
    joined = frame.join(counts, "bin", "left")
    return joined.select(
        "bin", half_up(F.col("lo") + F.col("bin") * F.col("width"), 2).alias("bin_min"), half_up(top, 2).alias("bin_max"),
        F.coalesce("records", F.lit(0)).cast("long").alias("records"),
        percent(F.coalesce("records", F.lit(0)), F.col("n"), 2).alias("pct"),
    )


def modal_bin(df: DataFrame, metric: str) -> DataFrame:
    """The fullest bin of the report histogram."""
    return histogram(df, metric, "report").orderBy(F.col("records").desc(), "bin").limit(1)


def _steps(df: DataFrame, dimension: str, metric: str | None, blank: str) -> DataFrame:
    name = F.coalesce(F.trim(F.col(f"`{dimension}`").cast("string")), F.lit(blank)).alias("name")
    amount = F.count("*").cast("double") if metric is None else F.sum(F.coalesce(number_of(df, metric), F.lit(0.0)))
    return df.groupBy(name).agg(half_up(amount, 2).alias("value"))


def funnel(df: DataFrame, dimension: str, metric: str | None = None, top: int | None = None) -> DataFrame:
    """The stages by volume (all, or the ``top`` largest) with share of the first stage, step conversion and drop-off."""
    stages = _steps(df, dimension, metric, "Stage")
    if top is not None:
        stages = stages.orderBy(F.col("value").desc(), "name").limit(top)
    order = Window.orderBy(F.col("value").desc(), F.col("name"))
    before = F.lag("value").over(order)
    step = F.when(before.isNull() | (before > 0), ratio(F.col("value"), F.coalesce(before, F.col("value"))) * 100)
    out = stages.select(
        F.row_number().over(order).cast("long").alias("step"), "name", "value",
        half_up(ratio(F.col("value"), F.first("value").over(order)) * 100, 1).alias("pct_of_top"),
        half_up(F.coalesce(step, F.lit(100.0)), 1).alias("step_conversion"),
    )
    return out.withColumn("drop_off", half_up(100 - F.col("step_conversion"), 1))


def waterfall(df: DataFrame, dimension: str, metric: str | None = None, top: int | None = None) -> DataFrame:
    """The steps by label with base and running total, then the net total row, which is the sum over all rows.

    With ``top`` the largest steps stay and the others become one step ``Other``.
    """
    steps = _steps(df, dimension, metric, "Other")
    if top is not None:
        largest = Window.orderBy(F.abs("value").desc(), "name")
        name = F.when(F.row_number().over(largest) <= top, F.col("name")).otherwise("Other")
        steps = steps.withColumn("name", name).groupBy("name").agg(F.sum("value").alias("value"))
    order = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum("value").over(order)
    bridge = steps.select(
        F.row_number().over(Window.orderBy("name")).cast("long").alias("step"), "name", F.col("value").alias("delta"),
        half_up(F.when(F.col("value") >= 0, running - F.col("value")).otherwise(running), 2).alias("base"),
        half_up(running, 2).alias("cumulative"), F.lit(False).alias("is_total"),
    )
    net = F.coalesce(F.sum("value"), F.lit(0.0))
    total = steps.agg(half_up(net, 2).alias("delta"), (F.count("*") + 1).alias("step")).select(
        "step", F.lit("Net Total").alias("name"), "delta", F.lit(0.0).alias("base"), F.col("delta").alias("cumulative"),
        F.lit(True).alias("is_total"),
    )
    return bridge.unionByName(total)


def scatter(df: DataFrame, x: str, y: str, order: list[str], group: str | None = None, points: int = 500) -> DataFrame:
    """Systematically sampled points; rows without two finite numbers are left out."""
    sample = systematic_sample(df.select(*{*order, x, y, *([group] if group else [])}), order, points)
    cols = [number_of(df, x).alias("x"), number_of(df, y).alias("y")]
    if group:
        cols.append(label(df, group).alias("series"))
    return sample.select(*[F.col(f"`{o}`") for o in order], *cols).where("x is not null and y is not null")


def bubble(df: DataFrame, x: str, y: str, size: str, order: list[str], points: int = 500) -> DataFrame:
    """Scatter points with a size clamped to 20..600."""
    sample = systematic_sample(df.select(*{*order, x, y, size}), order, points)
    return sample.select(
        *[F.col(f"`{o}`") for o in order], number_of(df, x).alias("x"), number_of(df, y).alias("y"),
        F.greatest(F.lit(20.0), F.least(F.lit(600.0), number_of(df, size))).alias("size"),
    ).where("x is not null and y is not null")


def headline(chart: DataFrame, name: str = "category", value: str = "value") -> DataFrame:
    """Total, mean, first and last item, top-three share and items at or above the mean of a bar-like chart."""
    facts = one_row(chart.agg(F.sum(value).alias("total"), F.avg(value).alias("mean")))
    best = chart.orderBy(F.col(value).desc(), name).limit(3).agg(F.sum(value).alias("t")).scalar()
    src = chart.withColumn("_f", facts)
    out = src.agg(
        F.count("*").alias("items"),
        F.max("_f.total").alias("total"),
        F.max("_f.mean").alias("mean"),
        F.min_by(name, F.struct(-F.col(value), F.col(name))).alias("top_item"),
        F.max(value).alias("top_value"),
        F.max_by(name, F.struct(-F.col(value), F.col(name))).alias("bottom_item"),
        F.min(value).alias("bottom_value"),
        F.count_if(F.col(value) >= F.col("_f.mean")).alias("at_or_above_mean"),
    )
    return out.select(
        "items", half_up(F.col("total"), 2).alias("total"), half_up(F.col("mean"), 2).alias("mean"), "top_item",
        "top_value", "bottom_item", "bottom_value", percent(F.col("top_value"), F.col("total"), 1).alias("top_pct"),
        percent(best, F.col("total"), 1).alias("top3_pct"), "at_or_above_mean",
    )


def trend_headline(points: DataFrame, period: str = "period", value: str = "value") -> DataFrame:
    """Net change, peak, low and mean of a line chart's points."""
    out = points.agg(
        F.count("*").alias("periods"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
        F.min_by(value, period).alias("first_value"), F.max_by(value, period).alias("last_value"),
        F.min_by(period, F.struct(-F.col(value), F.col(period))).alias("peak_period"), F.max(value).alias("peak_value"),
        F.min_by(period, F.struct(F.col(value), F.col(period))).alias("low_period"), F.min(value).alias("low_value"),
    )
    change = ratio(F.col("last_value") - F.col("first_value"), F.abs(F.col("first_value"))) * 100
    return out.select(
        "periods", half_up(F.col("total"), 2).alias("total"), half_up(F.col("mean"), 2).alias("mean"),
        half_up(change, 1).alias("net_change_pct"), "peak_period", "peak_value", "low_period", "low_value",
    )


def bridge_headline(bridge: DataFrame) -> DataFrame:
    """Net value, best and worst step of a waterfall."""
    steps = F.when(~F.col("is_total"), F.col("delta"))
    ranked = F.when(~F.col("is_total"), F.struct("delta", "name"))
    return bridge.agg(
        F.count(steps).alias("steps"), F.max(F.when(F.col("is_total"), F.col("delta"))).alias("net"),
        F.max_by("name", ranked).alias("best_step"), F.max(steps).alias("best_delta"),
        F.min_by("name", ranked).alias("worst_step"), F.min(steps).alias("worst_delta"),
    )


def funnel_headline(stages: DataFrame) -> DataFrame:
    """End-to-end retention and the step that loses most."""
    later = F.when(F.col("step") > 1, F.col("drop_off"))
    out = stages.agg(
        F.count("*").alias("stages"), F.min_by("value", "step").alias("first_value"),
        F.max_by("value", "step").alias("last_value"), F.max_by("name", F.when(F.col("step") > 1, F.struct("drop_off", "name"))).alias("worst_stage"),
        F.max(later).alias("worst_drop"),
    )
    return out.select(
        "stages", "first_value", "last_value", percent(F.col("last_value"), F.col("first_value"), 1).alias("retention_pct"),
        "worst_stage", "worst_drop",
    )


