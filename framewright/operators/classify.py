"""Semantic classes, roles, units and schema sheets from profile rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions.numbers import half_up
from framewright.operators.profile import Profile

# Name and value patterns of the semantic classes.
GEO_NAME = "(?i)^(country|nation|state|province|city|region|territory|zip|postal|postal_code|zipcode|lat|latitude|lon|longitude|continent|county|district|town)$"
ID_NAME = "(?i)^(id|uuid|_id|.*_id|.*id|key|code|customer_id|order_id|user_id|employee_id|product_id|trans_id|invoice_id|sku|account_num|account_number|ssn)$"
CURRENCY_NAME = "(?i)^(revenue|sales|profit|price|cost|salary|income|budget|amount|total|mrr|arr|arr_usd|ltv|cac|spend|fee|tax|gross_margin|net_income|unit_price|discount_amount|balance)$"
PERCENT_NAME = "(?i)^(percentage|pct|rate|ratio|margin|discount|tax_rate|interest_rate|conversion_rate|churn_rate|roi|bounce_rate|growth_rate)$"
TARGET_NAME = "(?i)^(target|label|churn|churned|converted|status|outcome|fraud|default|is_churn|is_default|revenue|sales|profit|rating|score|class|category)$"
ORDINAL_NAME = "(?i)^(rating|grade|level|tier|priority|stage|satisfaction|rank|ranking|size|education|experience_level|severity)$"
TIME_NAME = "(?i)date|time|timestamp|created_at|updated_at|year|month|quarter|day"
MONEY_WORD = "(?i)sales|revenue|profit|cost|spend|price|amount"
RATE_WORD = "(?i)rate|ratio|margin|pct|pct_"
BOUNDED_WORD = "(?i)rate|ratio|margin|discount"
#: Share of a column's cells from which a kind of value tells something about the column.
SOME = 0.1


def with_shares(p: Profile) -> DataFrame:
    """One row per column with its profile and the share of its cells that read as each kind of value."""
    return p.columns().join(F.broadcast(p.shares()), "column", "left")


def some(kind: str) -> Column:
    """Whether at least one cell in ten reads as that kind, judged on all cells."""
    return F.coalesce(F.col(f"share_{kind}") >= SOME, F.lit(False))


def classify(p: Profile) -> DataFrame:
    """Semantic type, role, confidence and target flag of every column; the first rule that fits wins."""
    rows = with_shares(p)
    name = F.regexp_replace(F.lower("column"), r"[\s_-]+", "_")
    kind, total = F.col("type"), F.col("total")
    is_target = name.rlike(TARGET_NAME)
    in_unit = (F.col("min") >= 0) & (F.col("max") <= 1) & name.rlike(RATE_WORD)
    in_hundred = (F.col("min") >= 0) & (F.col("max") <= 100) & name.rlike(BOUNDED_WORD)
    money = name.rlike(CURRENCY_NAME) | some("money") | (
        (F.col("mean") > 10) & ~name.rlike(PERCENT_NAME) & name.rlike(MONEY_WORD)
    )
    rate = name.rlike(PERCENT_NAME) | some("percent") | in_unit | in_hundred
    whole = (F.col("min") == F.floor("min")) & (F.col("max") == F.floor("max"))
    rules = [
        ("datetime", 95, (kind == "datetime") | name.rlike(TIME_NAME)),
        ("boolean", 95, (kind == "boolean") | ((F.col("distinct") == 2) & F.col("all_flag_words"))),
        ("identifier", 90, name.rlike(ID_NAME) | (kind == "id") | (
            (F.col("cardinality_pct") > 95) & (total >= 20) & kind.isin("categorical", "text"))),
        ("geographic", 92, name.rlike(GEO_NAME) | some("geo")),
        ("currency", 92, (kind == "numeric") & F.coalesce(money, F.lit(False))),
        ("percentage", 90, (kind == "numeric") & F.coalesce(rate, F.lit(False))),
        ("numeric_discrete", 88, (kind == "numeric") & (F.col("distinct") < 20) & F.coalesce(whole, F.lit(False))),
        ("numeric_continuous", 85, kind == "numeric"),
        ("categorical_ordinal", 88, name.rlike(ORDINAL_NAME) | some("ordinal")),
        ("text_free", 80, (F.col("cardinality_pct") > 60) & (total > 50)),
        ("categorical_nominal", 90, F.lit(True)),
    ]
    chosen = F.coalesce(*[F.when(test, F.struct(F.lit(n).alias("s"), F.lit(c).alias("c"))) for n, c, test in rules])
    out = rows.withColumn("_pick", chosen).withColumn("semantic_type", F.col("_pick.s"))
    semantic = F.col("semantic_type")
    number = semantic.isin("currency", "percentage", "numeric_discrete", "numeric_continuous")
    words = semantic.isin("categorical_ordinal", "text_free", "categorical_nominal")
    target = is_target & ((semantic == "boolean") | number | (words & (F.col("distinct") <= 10)))
    role = (
        F.when(semantic == "datetime", "time")
        .when(semantic == "identifier", "identifier")
        .when(semantic == "boolean", F.when(target, "target").otherwise("feature"))
        .when(number, "measure")
        .when(words & target, "target")
        .otherwise("dimension")
    )
    primary = (
        F.when(semantic == "datetime", "datetime").when(semantic == "boolean", "boolean")
        .when(semantic == "identifier", F.when(kind == "numeric", "numeric").otherwise("id"))
        .when(number, "numeric").otherwise("categorical")
    )
    return out.select(
        "column", F.col("type").alias("logical_type"), primary.alias("primary_type"), "semantic_type",
        role.alias("suggested_role"), F.col("_pick.c").cast("long").alias("confidence"), target.alias("is_target_candidate"),
    )


# Role and unit words of the schema sheet.
ROLE_ID = "_id|id$|^id_|guid|uuid|code|sku|key|number|ref|token"
ROLE_DATE = "date|time|timestamp|year|month|quarter|created|updated"
ROLE_NUMBER_ID = "_id|id$|zip|postal|phone|year"
UNITS = [
    ("USD", r"\b(usd|\$|dollar|price|cost|sales|revenue|amount|salary|wage|fee|spend|budget)\b"),
    ("EUR", r"\b(eur|euro|€)\b"),
    ("GBP", r"\b(gbp|pound|£)\b"),
    ("INR", r"\b(inr|rupee|₹)\b"),
    ("PERCENT", r"\b(pct|percent|percentage|rate|ratio|margin|share|growth)\b"),
    ("COUNT", r"\b(qty|quantity|count|units|items|volume|clicks|visits)\b"),
    ("DISTANCE", r"\b(distance|miles|km|meters|feet)\b"),
    ("WEIGHT", r"\b(weight|kg|lbs|pounds|grams|ton)\b"),
]


def unit_of(name: Column) -> Column:
    """Physical unit or currency named in a column name; ``_`` counts as a word break."""
    words = F.regexp_replace(F.lower(name), "_", " ")
    return F.coalesce(*[F.when(words.rlike(pattern), F.lit(unit)) for unit, pattern in UNITS], F.lit("UNKNOWN"))


def schema_sheet(p: Profile) -> DataFrame:
    """Type, nullability, cardinality tier, semantic role, unit and key score of every column."""
    rows = with_shares(p)
    lower = F.regexp_replace(F.lower("column"), "[^a-z0-9]", "_")
    total, distinct = F.col("total"), F.col("distinct")
    unique = F.coalesce(100.0 * distinct / F.nullif(F.col("valid"), F.lit(0)), F.lit(0.0))
    filled = 100.0 * F.col("valid") / F.nullif(total, F.lit(0))
    tier = (
        F.when((unique >= 99.5) & (filled >= 99), "UNIQUE")
        .when((distinct > 50) | (distinct / total > 0.4), "HIGH")
        .when(distinct > 10, "MEDIUM").otherwise("LOW")
    )
    data_type = (
        F.when(F.col("type") == "numeric", "number").when(F.col("type").isin("datetime", "boolean", "categorical"), F.col("type"))
        .otherwise("string")
    )
    role = (
        F.when(lower.rlike(ROLE_ID) & (unique > 80), "IDENTIFIER")
        .when((data_type == "datetime") | lower.rlike(ROLE_DATE), "DATE")
        .when((data_type == "number") & lower.rlike(ROLE_NUMBER_ID) & (unique > 50), "IDENTIFIER")
        .when(data_type == "number", "METRIC")
        .when((distinct <= 20) | (distinct / total <= 0.15), "CATEGORICAL")
        .when(distinct / total <= 0.6, "DIMENSION").otherwise("TEXT")
    )
    unit = F.when((unit_of(F.col("column")) == "UNKNOWN") & some("percent"), "PERCENT")
    return rows.select(
        "column", data_type.alias("data_type"), (F.col("missing") > 0).alias("nullable"), F.col("missing").alias("null_count"),
        half_up(100.0 * F.col("missing") / F.nullif(total, F.lit(0)), 1).alias("null_pct"), F.col("distinct"),
        tier.alias("cardinality"), role.alias("semantic_role"), F.coalesce(unit, unit_of(F.col("column"))).alias("unit"),
    )
