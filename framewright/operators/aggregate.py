"""Group summaries, shares, cards and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.functions.numbers import finite, half_up, number_of, percent, ratio, to_number
from framewright.functions.text import is_text
from framewright.operators.scale import exact_quantiles, join_keys, one_row, running_total

PLAIN = ("sum", "avg", "mean", "min", "max", "count", "count_distinct")


def label(df: DataFrame, name: str) -> Column:
    """Group label: null becomes ``Unknown``, blank text ``(Empty)``."""
    column = F.col(f"`{name}`")
    if not is_text(df.schema[name].dataType):
        return F.coalesce(column.cast("string"), F.lit("Unknown"))
    return F.when(column.isNull(), "Unknown").when(F.trim(column) == "", "(Empty)").otherwise(F.trim(column))


def measure(agg: str, value: Column) -> Column:
    """The aggregate expression of a chart or table metric."""
    if agg == "count":
        return F.count(value).cast("double")
    if agg == "count_distinct":
        return F.countDistinct(value).cast("double")
    functions = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max}
    return functions[agg](finite(value))


def grouped(df: DataFrame, keys: list[str], value: Column | None, agg: str, name: str = "value") -> DataFrame:
    """One measure per group plus its row count; medians go the sketch-and-count way. Numbers written as text are read."""
    if value is not None and not agg.startswith("count") and is_text(df.select(value).schema.fields[0].dataType):
        value = to_number(value)
    if agg == "median":
        src = df.withColumn("_m", value)
        middle = exact_quantiles(src, keys, F.col("_m"), {name: 0.5})
        counts = src.groupBy(*keys).agg(F.count("*").alias("records"))
        return join_keys(counts, middle, keys, "left") if keys else counts.withColumn(name, middle.scalar())
    if value is None:
        return df.groupBy(*keys).agg(F.count("*").cast("double").alias(name), F.count("*").alias("records"))
    return df.groupBy(*keys).agg(measure(agg, value).alias(name), F.count("*").alias("records"))


def group_summary(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Sum, mean, median, count, min, max and share of the total per group."""
    src = df.select(label(df, dimension).alias("category"), number_of(df, metric).alias("_v"))
    src = src.where(F.col("_v").isNotNull())
    base = src.groupBy("category").agg(
        F.sum("_v").alias("sum"), F.avg("_v").alias("mean"), F.count("_v").alias("count"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
    )
    base = join_keys(base, exact_quantiles(src, ["category"], F.col("_v"), {"median": 0.5}), ["category"])
    total = src.agg(F.sum("_v").alias("t")).scalar()
    return base.select(
        "category",
        half_up(F.col("sum"), 2).alias("sum"),
        half_up(F.col("mean"), 2).alias("mean"),
        half_up(F.col("median"), 2).alias("median"),
        "count",
        half_up(F.col("min"), 2).alias("min"),
        half_up(F.col("max"), 2).alias("max"),
        half_up(ratio(F.col("sum"), total) * 100, 1).alias("share_pct"),
    )


def group_agg(df: DataFrame, dimension: str, metric: str, agg: str = "sum") -> DataFrame:
    """One aggregate per group, largest first."""
    src = df.withColumn("group_value", label(df, dimension))
    out = grouped(src, ["group_value"], F.col(f"`{metric}`"), agg)
    return out.select("group_value", half_up(F.col("value"), 2).alias("value"), "records").orderBy(
        F.col("value").desc_nulls_last(), "group_value"
    )


def summary_table(df: DataFrame, dimension: str, metric: str | None, agg: str = "sum", sort: str = "desc",
                  top: int | None = None) -> DataFrame:
    """Value, record count and share of the total per group."""
    src = df.withColumn("category", label(df, dimension))
    out = grouped(src, ["category"], None if metric is None else F.col(f"`{metric}`"), agg)
    total = out.agg(F.sum("value").alias("t")).scalar()
    out = out.select(
        "category", half_up(F.col("value"), 2).alias("value"), "records", percent(F.col("value"), total, 1).alias("pct")
    )
    order = {
        "desc": [F.col("value").desc_nulls_last(), F.col("category")],
        "asc": [F.col("value").asc_nulls_last(), F.col("category")],
        "alpha": [F.col("category")],
    }[sort]
    out = out.orderBy(*order)
    return out if top is None else out.limit(top)


def top_keys(df: DataFrame, key: str, top: int, weight: Column | None = None) -> DataFrame:
    """The ``top`` values of a column by weight (rows by default); ties by value."""
    score = F.count("*") if weight is None else F.sum(weight)
    return df.groupBy(key).agg(score.alias("_w")).orderBy(F.col("_w").desc_nulls_last(), key).limit(top).select(key)


def keep_top(df: DataFrame, key: str, top: int, weight: Column | None = None) -> DataFrame:
    """Rows whose key is among the top values. The list holds at most ``top`` rows, so it is broadcast."""
    return df.join(F.broadcast(top_keys(df, key, top, weight)), key, "left_semi")


def crosstab(df: DataFrame, rows: str, columns: str, top: int | None = None) -> DataFrame:
    """Counts per cell of two columns with the totals of its row and its column; with ``top`` see ``dense_grid``."""
    src = df.select(label(df, rows).alias("row_value"), label(df, columns).alias("column_value"))
    counts = src.groupBy("row_value", "column_value").agg(F.count("*").alias("records"))
    grid = counts if top is None else dense_grid(counts, "records", top)
    for key in ("row", "column"):
        totals = grid.groupBy(f"{key}_value").agg(F.sum("records").alias(f"{key}_total"))
        grid = join_keys(grid, totals, [f"{key}_value"])
    return grid


def dense_grid(cells: DataFrame, amount: str, top: int, by: str | None = None) -> DataFrame:
    """The ``top`` rows and columns by ``by``, all others summed as ``Other``; absent cells are 0."""
    by = by or amount
    for key in ("row_value", "column_value"):
        best = top_keys(cells, key, top, F.col(by)).withColumnRenamed(key, "_best")
        named = cells.join(F.broadcast(best), F.col(key) == F.col("_best"), "left")
        cells = named.withColumn(key, F.coalesce("_best", F.lit("Other"))).drop("_best")
    sums = cells.groupBy("row_value", "column_value").agg(F.sum(amount).alias(amount))
    names = sums.agg(F.collect_set("column_value").alias("names")).scalar()  # top + 1 at most
    grid = sums.select("row_value").distinct().withColumn("column_value", F.explode(names))
    return grid.join(sums, ["row_value", "column_value"], "left").na.fill(0, [amount])


def heatmap(df: DataFrame, rows: str, columns: str, metric: str | None = None, top: int | None = None) -> DataFrame:
    """Count or sum per cell of two dimensions that has rows; with ``top`` a dense grid with ``Other``."""
    src = df.withColumns({"row_value": label(df, rows), "column_value": label(df, columns)})
    amount = F.count("*").cast("double") if metric is None else F.sum(number_of(df, metric))
    cells = src.groupBy("row_value", "column_value").agg(amount.alias("value"), F.count("*").alias("records"))
    grid = cells if top is None else dense_grid(cells, "value", top, "records")
    return grid.select(
        "row_value", "column_value", half_up(F.col("value"), 2).alias("value")
    )


def combo(df: DataFrame, dimension: str, first: str, second: str, agg: str = "sum", top: int | None = None) -> DataFrame:
    """Primary sum or mean and secondary mean per category, largest primary first."""
    out = df.groupBy(label(df, dimension).alias("category")).agg(
        measure(agg, number_of(df, first)).alias("first_value"), measure("avg", number_of(df, second)).alias("second_value")
    )
    out = out.select(
        "category", half_up(F.col("first_value"), 2).alias("first_value"),
        half_up(F.col("second_value"), 2).alias("second_value"),
    ).orderBy(F.col("first_value").desc_nulls_last(), "category")
    return out if top is None else out.limit(top)


def kpi_card(df: DataFrame, metric: str, agg: str = "sum") -> DataFrame:
    """Headline value with min, max and mean of the metric."""
    value = number_of(df, metric)
    facts = df.agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"), F.count(value).alias("records")
    )
    head = grouped(df, [], F.col(f"`{metric}`"), agg).select("value").scalar()
    return facts.select(
        half_up(head, 2).alias("value"), half_up(F.col("min"), 2).alias("min"), half_up(F.col("max"), 2).alias("max"),
        half_up(F.col("avg"), 2).alias("avg"), "records",
    )


def gauge(df: DataFrame, metric: str, target: float, agg: str = "sum") -> DataFrame:
    """Aggregate against a target with a status at 85 and 60 percent."""
    head = grouped(df, [], F.col(f"`{metric}`"), agg)
    pct = half_up(ratio(F.col("value"), F.lit(float(target))) * 100, 1)
    return head.select(
        half_up(F.col("value"), 2).alias("value"), F.lit(float(target)).alias("target"), pct.alias("pct_of_target"),
        F.when(pct >= 85, "ON_TRACK").when(pct >= 60, "AT_RISK").otherwise("BEHIND").alias("status"),
    )


def half_split(df: DataFrame, metric: str, date: str, ties: list[str], agg: str = "sum") -> DataFrame:
    """Prior half against current half of the rows in date order, split at floor(rows / 2).

    Only one row per distinct date is ordered over the whole table; rows of the one date the middle falls on are
    ordered by the tie columns.
    """
    src = df.where(F.col(f"`{date}`").isNotNull())
    days = src.groupBy(F.col(f"`{date}`").alias("_d")).agg(F.count("*").alias("_n"))
    upto = running_total(days, [], [F.col("_d")], F.col("_n"), "_hi")
    middle = src.select(F.floor(F.count("*") / 2).cast("long")).scalar()
    cut = one_row(upto.where(F.col("_hi") >= middle).orderBy("_d").limit(1).select("_d", "_n", "_hi"))
    spare = (middle - (cut["_hi"] - cut["_n"])).cast("int")
    on_day = src.where(F.col(f"`{date}`") == cut["_d"])
    first_rows = running_total(on_day, [], [F.col(f"`{t}`") for t in ties], F.lit(1).cast("long"), "_no")
    same_day = first_rows.withColumn("period", F.when(F.col("_no") <= spare, "previous").otherwise("current")).drop("_no")
    other = src.where(F.col(f"`{date}`") != cut["_d"]).withColumn(
        "period", F.when(F.col(f"`{date}`") < cut["_d"], "previous").otherwise("current")
    )
    halves = other.unionByName(same_day)
    out = grouped(halves, ["period"], F.col(f"`{metric}`"), agg)
    wide = out.agg(
        F.max(F.when(F.col("period") == "previous", F.col("value"))).alias("previous"),
        F.max(F.when(F.col("period") == "current", F.col("value"))).alias("current"),
        F.max(F.when(F.col("period") == "previous", F.col("records"))).alias("previous_records"),
        F.max(F.when(F.col("period") == "current", F.col("records"))).alias("current_records"),
    )
    change = ratio(F.col("current") - F.col("previous"), F.abs(F.col("previous"))) * 100
    return wide.select(
        half_up(F.col("previous"), 2).alias("previous"), half_up(F.col("current"), 2).alias("current"),
        half_up(change, 1).alias("change_pct"), "previous_records", "current_records",
    )


def segments(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Segment totals with mean, median, count, share and contribution rank."""
    out = group_summary(df, dimension, metric).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(out, [], [F.col("sum").desc(), F.col("category")], F.col("one"), "rank")
    return ranked.select(
        F.col("category").alias("segment"), F.col("sum").alias("total"), F.col("mean").alias("average"), "median",
        "count", "share_pct", "rank",
    )


def top_bottom(df: DataFrame, dimension: str, metric: str, top: int = 10) -> DataFrame:
    """The best and worst groups by sum with their share; each side is a top-k, never a full sort in one task."""
    sums = df.groupBy(label(df, dimension).alias("name")).agg(F.sum(number_of(df, metric)).alias("value"))
    sums = sums.where(F.col("value").isNotNull())
    total = sums.agg(F.sum("value").alias("t")).scalar()
    best = sums.orderBy(F.col("value").desc(), F.col("name")).limit(top)
    worst = sums.orderBy(F.col("value").asc(), F.col("name").desc()).limit(top)
    down = Window.orderBy(F.col("value").desc(), F.col("name"))
    up = Window.orderBy(F.col("value").asc(), F.col("name").desc())
    both = best.select(F.lit("top").alias("side"), F.row_number().over(down).cast("long").alias("rank"), "name", "value")
    both = both.unionByName(
        worst.select(F.lit("bottom").alias("side"), F.row_number().over(up).cast("long").alias("rank"), "name", "value")
    )
    return both.select(
        "side", "rank", "name", half_up(F.col("value"), 2).alias("value"),
        percent(F.col("value"), total, 1).alias("share_pct"),
    )


def driver_share(df: DataFrame, factor: str, metric: str) -> DataFrame:
    """Sum per factor, share of the total, distance from the mean factor and its weight class."""
    sums = df.groupBy(label(df, factor).alias("factor")).agg(
        F.sum(number_of(df, metric)).alias("value"), F.count("*").alias("records")
    )
    facts = one_row(sums.agg(F.sum("value").alias("t"), F.avg("value").alias("m")))
    out = sums.withColumn("_a", facts)
    share = ratio(F.col("value"), F.col("_a.t")) * 100
    return out.select(
        "factor", half_up(F.col("value"), 2).alias("value"), "records", half_up(share, 1).alias("share_pct"),
        half_up(F.col("value") - F.col("_a.m"), 2).alias("delta_from_mean"),
        F.when(share > 25, "MAJOR").when(share > 10, "MODERATE").otherwise("MINOR").alias("significance"),
    )


def business_kpis(df: DataFrame, revenue: str | None, profit: str | None, order_id: str | None,
                  others: list[str] = ()) -> DataFrame:
    """Revenue, profit, margin, distinct orders, average order value; with fewer than four of them, the means of all other columns."""
    aggs = {"orders": F.countDistinct(f"`{order_id}`") if order_id else F.count("*")}
    if revenue:
        aggs["revenue"] = F.sum(number_of(df, revenue))
    if profit:
        aggs["profit"] = F.sum(number_of(df, profit))
    base = [n for n in ("revenue", "profit") if n in aggs]
    rows = [(n, F.col(n).cast("double")) for n in base]
    if revenue and profit:
        rows.append(("margin_pct", ratio(F.col("profit"), F.col("revenue")) * 100))
    rows.append(("orders", F.col("orders").cast("double")))
    if revenue:
        rows.append(("average_order_value", ratio(F.col("revenue"), F.col("orders"))))
    if len(rows) < 4:
        for n in others:
            aggs[f"avg_{n}"] = F.avg(number_of(df, n))
            rows.append((f"avg_{n}", F.col(f"`avg_{n}`")))
    facts = df.agg(*[e.alias(n) for n, e in aggs.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("kpi"), half_up(v, 2).alias("value")) for n, v in rows])
    return facts.select(F.inline(pairs))


def find_kpi_columns(df: DataFrame) -> dict:
    """Revenue, profit and order columns by name, for ``business_kpis``."""
    import re

    numbers = [f.name for f in df.schema.fields if hasattr(f.dataType, "typeName") and f.dataType.typeName() in
               ("double", "float", "decimal", "long", "integer", "short", "byte")]

    def pick(exact: str, loose: str | None, names: list[str]) -> str | None:
        hits = [n for n in names if re.search(exact, n, re.I)]
        if not hits and loose:
            hits = [n for n in names if re.search(loose, n, re.I)]
        return hits[0] if hits else None

    revenue = pick(r"^(revenue|sales|total_amount|gross_sales|turnover)$", r"revenue|sales", numbers)
    profit = pick(r"^(profit|net_profit|income|net_income)$", r"profit", numbers)
    return {
        "revenue": revenue,
        "profit": profit,
        "order_id": pick(r"^(order_id|invoice_id|transaction_id)$", None, df.columns),
        "others": [n for n in numbers if n not in (revenue, profit)],
    }
