"""Execution of a one-level analysis plan: an intent with its columns chooses the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from framewright.operators import aggregate, charts, drivers, ml, stats, temporal

INTENTS = ("AGGREGATION", "RANKING", "SEGMENT", "TREND", "CORRELATION", "ANOMALY", "COMPARISON", "DISTRIBUTION", "BOXPLOT",
           "RELATIONSHIP", "DRIVERS", "PREDICTION")


def run_plan(df: DataFrame, intent: str, metric: str | None = None, dimension: str | None = None, date: str | None = None,
             key: list[str] | None = None, agg: str = "sum", top: int | None = None, features: list[str] | None = None) -> DataFrame:
    """The result table of one intent: whole, or its ``top`` rows. A ranking shows ten of either side unless told otherwise."""
    if intent == "AGGREGATION":
        groups = aggregate.group_agg(df, dimension, metric, agg)
        return groups if top is None else groups.limit(top)
    if intent == "RANKING":
        return aggregate.top_bottom(df, dimension, metric, top or 10)
    if intent == "SEGMENT":
        return aggregate.segments(df, dimension, metric)
    if intent == "TREND":
        return temporal.temporal(df, date, metric, agg)
    if intent == "CORRELATION":
        return stats.corr_target(df, metric, features)
    if intent == "ANOMALY":
        return stats.anomalies(df, key or [], [metric], top)
    if intent == "COMPARISON":
        return stats.compare_largest(df, dimension, metric)
    if intent == "DISTRIBUTION":
        return charts.histogram(df, metric, "report")
    if intent == "BOXPLOT":
        return charts.box_top_groups(df, metric, dimension)
    if intent == "RELATIONSHIP":
        return stats.bivariate(df, dimension, metric)
    if intent == "DRIVERS":
        return drivers.driver_delta(df, metric, date, [dimension], top)
    if intent == "PREDICTION":
        return ml.train_regression(df, metric, features, key[0]).metrics
    raise ValueError(f"unknown intent {intent}")
