"""Insight, recommendation and report tables, composed from the other operators."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framewright.functions.numbers import half_up, number_of, percent, ratio
from framewright.operators import aggregate, classify, keys, profile as prof, quality, stats, temporal
from framewright.operators.profile import Profile
from framewright.operators.scale import one_row

INSIGHT = ["insight", "subject", "metric", "value", "impact", "confidence"]
# Names of the measure an insight looks at first.
LEADING_MEASURE = r"sales|revenue|profit|salary|mrr|score"
EDA_MEASURE = r"sales|revenue|profit|income"
TREND_MEASURE = r"sales|revenue|profit"


def pick_measure(names: list[str], pattern: str) -> str | None:
    """The first numeric column whose name fits, else the first one."""
    return next((n for n in names if re.search(pattern, n, re.I)), names[0] if names else None)


def insight(rows: DataFrame, name: str, subject: Column, metric: Column, value: Column, impact: Column | str, confidence: int) -> DataFrame:
    as_col = impact if isinstance(impact, Column) else F.lit(impact)
    return rows.select(
        F.lit(name).alias("insight"), subject.cast("string").alias("subject"), metric.cast("string").alias("metric"),
        value.cast("double").alias("value"), as_col.alias("impact"), F.lit(confidence).cast("long").alias("confidence"),
    )


def union(parts: list[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """The rows of all parts; with a session, no parts give an empty table of insights."""
    if not parts and spark is not None:
        return spark.createDataFrame([], "insight string, subject string, metric string, value double, impact string, confidence long")
    return reduce(lambda a, b: a.unionByName(b), parts)


def _shares(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """Group sums with share of the total and number of groups."""
    sums = df.groupBy(aggregate.label(df, dimension).alias("category")).agg(F.sum(number_of(df, metric)).alias("sum"))
    facts = one_row(sums.agg(F.sum("sum").alias("total"), F.count("*").alias("groups")))
    return sums.withColumn("_f", facts).select("category", "sum", F.col("_f.groups").alias("groups"),
                                               percent(F.col("sum"), F.col("_f.total"), 1).alias("share"))


def dataset_insights(p: Profile) -> DataFrame:
    """Leading and weakest segment, strongest pair, first outlier column, time coverage and entity diversity."""
    df, numbers, words, dates = p.df, p.of_type("numeric"), p.of_type("categorical"), p.of_type("datetime")
    parts = []
    if words and numbers:
        metric = pick_measure(numbers, LEADING_MEASURE)
        shares = _shares(df, words[0], metric)
        best = shares.orderBy(F.col("sum").desc(), "category").limit(1)
        worst = shares.where(F.col("groups") >= 3).orderBy(F.col("sum").asc(), F.col("category").desc()).limit(1)
        parts.append(insight(best, "leading_segment", F.col("category"), F.lit(metric), F.col("share"), "POSITIVE", 96))
        parts.append(insight(worst, "weakest_segment", F.col("category"), F.lit(metric), F.col("share"), "WARNING", 94))
    if len(numbers) >= 2:
        pairs = stats.corr_pearson(df, numbers).where((F.abs("r") >= 0.4) & (F.abs("r") < 0.999))
        top = pairs.orderBy(F.abs("r").desc(), "column_a", "column_b").limit(1)
        parts.append(insight(top, "strongest_pair", F.concat_ws(" & ", "column_a", "column_b"), F.lit("pearson_r"), F.col("r"), "NEUTRAL", 92))
    if numbers:
        tails = p.columns().where((F.col("outliers") > 0) & (F.col("outlier_pct") >= 3)).orderBy("position").limit(1)
        parts.append(insight(tails, "outlier_tail", F.col("column"), F.lit("outlier_pct"), F.col("outlier_pct"), "WARNING", 95))
    if dates and numbers:
        span = p.facts().where(F.col("column") == dates[0])
        parts.append(insight(span, "time_coverage", F.concat_ws(" to ", "min_day", "max_day"), F.lit(dates[0]), F.col("range_days"), "POSITIVE", 94))
    entity = next((r["column"] for r in p.facts_rows if r["type"] == "id" or r["cardinality_pct"] > 80), None)
    if entity and numbers:
        rows = p.facts().where(F.col("column") == entity)
        parts.append(insight(rows, "entity_diversity", F.col("column"), F.lit("distinct"), F.col("distinct"), "POSITIVE", 90))
    return union(parts, p.df.sparkSession)


def recommended_analyses(p: Profile) -> DataFrame:
    """Analyses that fit the columns at hand."""
    n, w, d = p.of_type("numeric"), p.of_type("categorical"), p.of_type("datetime")
    rows = []
    if w and n:
        rows.append(("segment_comparison", "Diagnostic", "bar", ",".join([w[0], n[0]])))
    if len(n) >= 2:
        rows.append(("correlation_and_regression", "Predictive", "scatter", ",".join(n)))
    if d and n:
        rows.append(("time_series", "Descriptive", "line", ",".join([d[0], n[0]])))
    if len(w) >= 2:
        rows.append(("cross_tabulation", "Diagnostic", "bar", ",".join(w[:2])))
    return p.df.sparkSession.createDataFrame(rows, "analysis string, category string, chart string, columns string")


def eda_insights(p: Profile) -> DataFrame:
    """Concentration, top correlation, trend, skew and margin findings."""
    df, numbers, words, dates = p.df, p.of_type("numeric"), p.of_type("categorical"), p.of_type("datetime")
    parts = []
    if words and numbers:
        metric = pick_measure(numbers, EDA_MEASURE)
        best = _shares(df, words[0], metric).orderBy(F.col("sum").desc(), "category").limit(1)
        impact = F.when(F.col("share") > 40, "WARNING").otherwise("POSITIVE")
        parts.append(insight(best, "concentration", F.col("category"), F.lit(metric), F.col("share"), impact, 96))
    if len(numbers) >= 2:
        top = stats.corr_pearson(df, numbers).orderBy(F.abs("r").desc(), "column_a", "column_b").limit(1).where(F.abs("r") >= 0.4)
        impact = F.when(F.col("r") > 0, "POSITIVE").otherwise("NEUTRAL")
        parts.append(insight(top, "correlation", F.concat_ws(" & ", "column_a", "column_b"), F.col("strength"), F.col("r"), impact, 92))
    if dates and numbers:
        metric = pick_measure(numbers, TREND_MEASURE)
        trend = temporal.eda_trend_summary(df, dates[0], metric).where(F.col("periods") >= 2)
        impact = F.when(F.col("growth_pct") >= 0, "POSITIVE").otherwise("NEGATIVE")
        parts.append(insight(trend, "trend", F.col("direction"), F.lit(metric), F.col("growth_pct"), impact, 94))
    if numbers:
        skewed = p.columns().where(F.abs("skewness") > 1.5).orderBy("position").limit(1)
        parts.append(insight(skewed, "skewness", F.col("column"), F.lit("skewness"), half_up(F.col("skewness"), 2), "WARNING", 95))
    found = aggregate.find_kpi_columns(df)
    if found["revenue"] and found["profit"]:
        margin = aggregate.business_kpis(df, **found).where(F.col("kpi") == "margin_pct")
        impact = F.when(F.col("value") >= 15, "POSITIVE").otherwise("WARNING")
        parts.append(insight(margin, "margin", F.lit(found["profit"]), F.lit("margin_pct"), half_up(F.col("value"), 1), impact, 90))
    return union(parts, p.df.sparkSession)


def recommend_charts(p: Profile) -> DataFrame:
    """Charts that fit the profile, in the order they should be shown."""
    facts = {r["column"]: r for r in p.facts_rows}
    n, w, d = p.of_type("numeric"), p.of_type("categorical"), p.of_type("datetime")

    def fitting(names: list[str], test) -> str | None:
        return next((c for c in names if test(facts[c]["distinct"])), None)

    rows = []
    if d and n:
        rows.append(("trend", "line", d[0], pick_measure(n, r"sales|revenue|profit|income|cost|price|volume"), None, "sum"))
    if w and n:
        first = fitting(w, lambda u: u <= 8) or w[0]
        metric = pick_measure(n, r"sales|revenue|profit|salary|mrr|score|rating")
        rows.append(("category_breakdown", "bar", first, metric, None, "sum"))
        if len(w) > 1:
            second = fitting([c for c in w if c != first], lambda u: u <= 6) or w[1]
            rows.append(("grouped_breakdown", "bar", first, metric, second, "sum"))
    if len(n) >= 2:
        rows.append(("scatter", "scatter", n[0], n[1], w[0] if w else None, None))
    if n:
        rows.append(("distribution", "histogram", pick_measure(n, r"salary|mrr|sales|revenue|age|tenure|score"), None, None, None))
        low = fitting(w, lambda u: 2 <= u <= 5)
        if low:
            rows.append(("proportion", "donut", low, n[0], None, "sum"))
    schema = "chart string, type string, x string, y string, series string, agg string"
    return p.df.sparkSession.createDataFrame(rows, schema)


def chart_type_for(x_type: str | None, y_type: str | None = None, distinct: int | None = None) -> str:
    """The chart type that suits a pair of logical types."""
    if x_type in ("datetime", "date"):
        return "line"
    if x_type == "numeric" and y_type == "numeric":
        return "scatter"
    if x_type == "categorical" and distinct and distinct <= 6:
        return "donut"
    return "bar"


def dashboard_insights(bar: DataFrame | None = None, line: DataFrame | None = None, scatter: DataFrame | None = None) -> DataFrame:
    """Findings over finished charts: trend, top share, top against second, correlation of at least 0.4."""
    parts = []
    if line is not None:
        ends = line.agg(F.min_by("value", "period").alias("a"), F.max_by("value", "period").alias("b"),
                        F.min("period").alias("p"), F.max("period").alias("q"), F.count("*").alias("n")).where("n >= 2 and a > 0")
        change = half_up((F.col("b") - F.col("a")) / F.col("a") * 100, 1)
        impact = F.when(change >= 0, "POSITIVE").otherwise("NEGATIVE")
        parts.append(insight(ends, "trend", F.concat_ws(" to ", "p", "q"), F.lit("change_pct"), change, impact, 95))
    if bar is not None:
        total = bar.agg(F.sum("value").alias("t")).scalar()
        best = bar.orderBy(F.col("value").desc(), "category").limit(2).agg(
            F.max("value").alias("a"), F.min("value").alias("b"), F.count("*").alias("n"),
            F.min_by("category", F.struct(-F.col("value"), F.col("category"))).alias("first"),
            F.max_by("category", F.struct(-F.col("value"), F.col("category"))).alias("second"),
        ).withColumn("t", total).where("t > 0 and a > 0")
        parts.append(insight(best, "contribution", F.col("first"), F.lit("share_pct"), percent(F.col("a"), F.col("t"), 1), "POSITIVE", 96))
        ahead = half_up(ratio(F.col("a") - F.col("b"), F.col("b")) * 100, 1)
        parts.append(insight(best.where("n = 2 and b > 0"), "comparison", F.concat_ws(" vs ", "first", "second"), F.lit("ahead_pct"), ahead, "NEUTRAL", 94))
    if scatter is not None:
        r = scatter.agg(half_up(F.corr("x", "y"), 2).alias("r"), F.count("*").alias("n")).where("n >= 6 and abs(r) >= 0.4")
        parts.append(insight(r, "correlation", F.lit("x & y"), F.lit("pearson_r"), F.col("r"), "NEUTRAL", 92))
    return union(parts)


def report_overview(p: Profile) -> DataFrame:
    """Rows, columns by type, missing cells, duplicates and score of a table, one row."""
    kinds = {"numeric_columns": "numeric", "categorical_columns": "categorical", "date_columns": "datetime"}
    facts = p.facts().agg(
        F.max("total").alias("rows"), F.count("*").alias("columns"),
        *[F.count_if(F.col("type") == t).alias(n) for n, t in kinds.items()],
        F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_cells"),
    )
    scored = quality.score(p).select("score", "rating")
    row = one_row(scored)
    return facts.withColumn("_s", row).select(
        "rows", "columns", *kinds, "missing_cells",
        percent(F.col("missing_cells"), F.col("rows") * F.col("columns")).alias("missing_pct"),
        F.lit(p.duplicates).cast("long").alias("duplicate_rows"), F.col("_s.score").alias("score"), F.col("_s.rating").alias("rating"),
    )


def report_dictionary(p: Profile) -> DataFrame:
    """Column dictionary: type, semantic class, role, completeness and distinct count."""
    classes = classify.classify(p).select("column", "semantic_type", "suggested_role")
    return p.facts().join(F.broadcast(classes), "column").select(
        "column", "type", "semantic_type", "suggested_role", (100 - F.col("null_pct")).alias("complete_pct"), "distinct",
        F.col("top_value").alias("example"),
    )


def report_tables(p: Profile, log: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of a report by name; figures only."""
    numbers = p.of_type("numeric")
    tables = {
        "overview": report_overview(p), "quality": quality.audit(p).drop("position"), "score": quality.explain_score(p),
        "kpis": aggregate.business_kpis(p.df, **aggregate.find_kpi_columns(p.df)), "dictionary": report_dictionary(p),
        "insights": dataset_insights(p),
    }
    if numbers:
        tables["statistics"] = stats.describe(p.df.select(*numbers), [n for n in numbers if n in stats.numeric_columns(p.df)])
    if log is not None:
        tables["cleaning_log"] = log
    return tables


def report_checks(p: Profile, tables: dict[str, DataFrame]) -> DataFrame:
    """Do the report's figures equal their sources? One row per check."""
    rows = p.df.agg(F.count("*").alias("n")).scalar()
    overview = tables["overview"]
    now = quality.score(p).select("score").scalar()
    base = overview.select(
        (F.col("rows") == rows).alias("row_count"), (F.col("score") == now).alias("quality_score"),
        (F.col("columns") == F.lit(len(p.names))).alias("column_count"),
    )
    dictionary = tables["dictionary"].agg(F.count("*").alias("n")).scalar()
    base = base.withColumn("dictionary_complete", dictionary == F.lit(len(p.names)))
    names = ["row_count", "quality_score", "column_count", "dictionary_complete"]
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in names])
    return base.select(F.inline(pairs))


def workspace_quality(tables: dict[str, DataFrame], relationships: DataFrame | None = None) -> DataFrame:
    """Score per table, number of sound relationships, schema conflicts and duplicate entities."""
    profiles = {n: prof.profile(df) for n, df in tables.items()}
    parts = [
        quality.score(p).select(F.lit("score").alias("part"), F.lit(n).alias("subject"), F.col("score").alias("value"))
        for n, p in profiles.items()
    ]
    if relationships is not None:
        sound = relationships.agg(F.count_if(F.col("overlap_pct") >= 95).cast("double").alias("value"))
        parts.append(sound.select(F.lit("sound_relationships").alias("part"), F.lit("workspace").alias("subject"), "value"))
    conflicts = keys.schema_conflicts(profiles).agg(F.count("*").cast("double").alias("value"))
    parts.append(conflicts.select(F.lit("schema_conflicts").alias("part"), F.lit("workspace").alias("subject"), "value"))
    for n, df in tables.items():
        named = [c for c in profiles[n].names if re.search(keys.ENTITY_NAME, c) and df.schema[c].dataType.typeName() == "string"]
        if named:
            found = keys.duplicate_entities(df, named).agg(F.count("*").cast("double").alias("value"))
            parts.append(found.select(F.lit("duplicate_entities").alias("part"), F.lit(n).alias("subject"), "value"))
    return union(parts)


