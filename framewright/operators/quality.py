"""Quality audit, score, score explanation and cleaning plan, all from profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.functions.numbers import half_up, percent
from framewright.operators.profile import Profile

ALL_COLUMNS = "(All Columns)"
# Name patterns, the order of cleaning steps and the weights of the score.
MAY_BE_NEGATIVE = "(?i)profit|return|delta|change|growth|variance|diff|balance|loss|temperature|lat|long"
NEVER_NEGATIVE = "(?i)age|price|cost|salary|revenue|sales|quantity|count|tenure|days|distance|height|weight|speed|volume|discount"
AGE_NAME = "(?i)age"
SHARE_NAME = "(?i)percent|percentage|ratio|rate|pct"
STEP_ORDER = ["whitespace_padding", "casing_inconsistency", "incorrect_types", "invalid_dates", "duplicate_rows",
              "duplicate_ids", "mostly_missing_columns", "missing_values", "impossible_values", "negative_values",
              "outliers_iqr", "outliers_zscore", "constant_columns", "redundant_columns"]
WEIGHTS = [("Completeness", "completeness", 30), ("Uniqueness", "uniqueness", 20), ("Validity", "validity", 20),
           ("Type Consistency", "type_consistency", 10), ("Category Consistency", "category_consistency", 10),
           ("Outlier Health", "outlier_health", 10)]


def _issue(dimension: str, test: Column, severity: Column | str, rows: Column, pct: Column, fix: Column | str,
           lower: Column | None = None, upper: Column | None = None) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None).cast("double")
    body = F.struct(
        F.lit(dimension).alias("dimension"), as_col(severity).alias("severity"), rows.cast("long").alias("affected_rows"),
        pct.cast("double").alias("affected_pct"), as_col(fix).alias("fix"),
        (none if lower is None else lower).alias("lower"), (none if upper is None else upper).alias("upper"),
    )
    return F.when(F.coalesce(test, F.lit(False)), body)


def column_issues(p: Profile) -> DataFrame:
    """Issues found column by column."""
    c = F.col
    total, gap = c("total"), c("null_pct")
    text = c("type").isin("categorical", "text")
    number = c("type") == "numeric"
    name = c("column")
    fill = (
        F.when(number, F.when(F.abs(F.coalesce("skewness", F.lit(0.0))) > 1, "impute_median").otherwise("impute_mean"))
        .when(c("type") == "categorical", "impute_mode").otherwise("drop_missing")
    )
    pct = lambda n: percent(n, total)
    low, high = c("q1") - 1.5 * c("iqr"), c("q3") + 1.5 * c("iqr")
    over = c("over_100")
    share_hit = name.rlike(SHARE_NAME) & (c("max") > 100) & (c("min") >= 0) & (c("mean") < 200) & (over > 0) & (
        over < total * 0.1
    )
    rules = [
        _issue("mostly_missing_columns", (c("missing") > 0) & (gap >= 70), "HIGH", c("missing"), gap, "drop_column"),
        _issue("missing_values", (c("missing") > 0) & (gap < 70),
               F.when(gap > 20, "HIGH").when(gap > 5, "MEDIUM").otherwise("LOW"), c("missing"), gap, fill),
        _issue("duplicate_ids", c("is_id") & (c("distinct") < total) & (total > 1), "HIGH", total - c("distinct"),
               pct(total - c("distinct")), "remove_duplicate_ids"),
        _issue("incorrect_types", c("recommended").isNotNull() & (c("recommended") != c("type")), "MEDIUM", total,
               F.lit(100.0), F.concat(F.lit("convert_"), c("recommended"))),
        _issue("whitespace_padding", text & (c("padded") > 0), "LOW", c("padded"), pct(c("padded")), "trim_whitespace"),
        _issue("casing_inconsistency", text & (c("variant_groups") > 0), "LOW", c("variant_rows"), pct(c("variant_rows")),
               "standardize_case"),
        _issue("outliers_iqr", number & (c("outlier_pct") > 2), F.when(c("outlier_pct") > 15, "HIGH").otherwise("MEDIUM"),
               c("outliers"), c("outlier_pct"), "cap_outliers", half_up(low, 2), half_up(high, 2)),
        _issue("negative_values", number & name.rlike(NEVER_NEGATIVE) & ~name.rlike(MAY_BE_NEGATIVE) & (c("negatives") > 0),
               "HIGH", c("negatives"), pct(c("negatives")), "clear_negative"),
        _issue("impossible_values", number & name.rlike(AGE_NAME) & (c("max") > 130), "HIGH", c("over_130"),
               pct(c("over_130")), "clear_impossible"),
        _issue("impossible_values", number & share_hit, "MEDIUM", over, pct(over), "cap_outliers", F.lit(0.0), F.lit(100.0)),
        _issue("constant_columns", c("is_constant") & (total > 5), "MEDIUM", total, F.lit(100.0), "drop_column"),
        _issue("near_constant_columns", ~c("is_constant") & c("is_near_constant") & (total > 20), "LOW", total,
               c("dominant_pct"), "inspect_only"),
        _issue("invalid_dates", (c("type") == "datetime") & (c("invalid_dates") > 0), "HIGH", c("invalid_dates"),
               pct(c("invalid_dates")), "convert_datetime"),
    ]
    hits = F.filter(F.array(*rules), lambda i: i.isNotNull())
    return p.columns().select("column", "position", F.explode(hits).alias("i")).select("column", "position", "i.*")


def audit(p: Profile) -> DataFrame:
    """All issues: repeated rows first, then the columns'."""
    spark = p.df.sparkSession
    rows = F.lit(p.duplicates).cast("long")
    share = percent(rows, F.lit(p.total))
    whole = spark.range(1).select(
        F.lit(ALL_COLUMNS).alias("column"), F.lit(-1).alias("position"), F.lit("duplicate_rows").alias("dimension"),
        F.when(share > 5, "HIGH").when(share > 1, "MEDIUM").otherwise("LOW").alias("severity"), rows.alias("affected_rows"),
        share.alias("affected_pct"), F.lit("remove_duplicates").alias("fix"), F.lit(None).cast("double").alias("lower"),
        F.lit(None).cast("double").alias("upper"),
    ).where(F.col("affected_rows") > 0)
    return whole.unionByName(column_issues(p))


def score(p: Profile) -> DataFrame:
    """The 0 to 100 score with its six parts, rating and totals, one row."""
    cells = p.total * len(p.facts_rows)
    found = audit(p).agg(
        F.count("*").alias("issues"), F.count_if(F.col("severity") == "HIGH").alias("high"),
        F.count_if(F.col("severity") == "MEDIUM").alias("medium"), F.count_if(F.col("severity") == "LOW").alias("low"),
        F.coalesce(F.sum(F.when(F.col("dimension").isin("negative_values", "impossible_values", "invalid_dates"),
                                F.col("affected_rows"))), F.lit(0)).alias("invalid_values"),
        F.count_if(F.col("dimension") == "incorrect_types").alias("types"),
        F.count_if(F.col("dimension").isin("casing_inconsistency", "whitespace_padding")).alias("texts"),
    )
    missing = p.facts().agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("m")).scalar()
    outliers = p.numeric().agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("o")).scalar()
    rows = found.withColumns({"missing_cells": missing, "outliers": outliers})
    c = F.col
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    dup = percent(F.lit(p.duplicates), F.lit(p.total))
    parts = {
        "completeness": clamp(half_up(100 - percent(c("missing_cells"), F.lit(cells)) * 2.5)),
        "uniqueness": clamp(half_up(100 - dup * 5)),
        "validity": clamp(half_up(100 - (c("high") * 10 + c("invalid_values") * 0.5))),
        "type_consistency": clamp(100.0 - c("types") * 15),
        "category_consistency": clamp(100.0 - c("texts") * 10),
        "outlier_health": clamp(half_up(100 - F.least(F.lit(30.0), c("outliers") / F.lit(max(1, p.total)) * 150))),
    }
    weighted = sum((c(key) * (weight / 100) for _, key, weight in WEIGHTS), F.lit(0.0))
    scored = rows.withColumns(parts).withColumn(
        "score", F.greatest(F.lit(5.0), F.least(F.lit(100.0), half_up(weighted)))
    )
    rating = (
        F.when(c("score") >= 90, "EXCELLENT").when(c("score") >= 75, "GOOD").when(c("score") >= 50, "NEEDS ATTENTION")
        .otherwise("CRITICAL ISSUES")
    )
    return scored.select(
        "score", rating.alias("rating"), *parts, "issues", "high", "medium", "low",
        F.lit(p.duplicates).cast("long").alias("duplicate_rows"), "missing_cells", "invalid_values", "outliers",
    )


def explain_score(p: Profile) -> DataFrame:
    """Weight, score, lost points and the count behind them, one row per part of the score."""
    behind = {"completeness": "missing_cells", "uniqueness": "duplicate_rows", "validity": "invalid_values",
              "type_consistency": "types", "category_consistency": "texts", "outlier_health": "outliers"}
    counted = score(p).withColumns({
        "types": (100 - F.col("type_consistency")) / 15, "texts": (100 - F.col("category_consistency")) / 10
    })
    rows = F.array(*[
        F.struct(F.lit(label).alias("part"), F.lit(weight).cast("long").alias("weight"), F.col(key).alias("score"),
                 half_up((100 - F.col(key)) * weight / 100).alias("penalty"),
                 F.col(behind[key]).cast("long").alias("evidence"))
        for label, key, weight in WEIGHTS
    ])
    return counted.select(F.inline(rows))


def cleaning_plan(p: Profile) -> DataFrame:
    """Actionable issues in the order they should be cleaned."""
    rank = F.create_map(*[x for i, d in enumerate(STEP_ORDER) for x in (F.lit(d), F.lit(i + 1))])
    order = Window.orderBy("priority", "position", "dimension")
    steps = audit(p).where(F.col("fix") != "inspect_only").withColumn(
        "priority", F.coalesce(rank[F.col("dimension")], F.lit(50))
    )
    return steps.select(
        F.row_number().over(order).cast("long").alias("step"), "dimension", "column", "severity", "fix", "lower", "upper",
        "affected_rows",
    )


def projected_score(p: Profile) -> DataFrame:
    """The score now and the score expected after the plan."""
    now = F.col("score")
    return score(p).select(
        now.alias("current_score"), F.least(F.lit(100.0), half_up(now + (100 - now) * 0.85)).alias("projected_score")
    )
