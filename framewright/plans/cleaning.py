"""From audit to cleaned table: plan rows become actions, applied in plan order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from framewright.operators import clean
from framewright.operators.profile import Profile, dataset_stats, profile
from framewright.operators.quality import cleaning_plan, score


def to_action(step, order_by: tuple[str, ...]) -> list[clean.Action]:
    """The actions of one plan row; impossible cells are cleared and then imputed."""
    column, fix = step["column"], step["fix"]
    if fix.startswith("impute_"):
        return [clean.Impute(column, fix.removeprefix("impute_"))]
    if fix.startswith("convert_"):
        return [clean.Convert(column, fix.removeprefix("convert_"))]
    if fix == "clear_negative":
        return [clean.ClearCells(column, low=0.0), clean.Impute(column, "median")]
    if fix == "clear_impossible":
        return [clean.ClearCells(column, high=130.0), clean.Impute(column, "median")]
    simple = {
        "trim_whitespace": lambda: clean.Trim(column), "standardize_case": lambda: clean.Recase(column, "title"),
        "remove_duplicates": clean.RemoveDuplicates, "drop_missing": lambda: clean.DropMissing(column),
        "remove_duplicate_ids": lambda: clean.RemoveDuplicateIds(column, order_by, "first"),
        "cap_outliers": lambda: clean.Cap(column, step["lower"], step["upper"]),
        "drop_column": lambda: clean.DropColumn(column),
    }
    return [simple[fix]()] if fix in simple else []


def plan_history(p: Profile, order_by: tuple[str, ...]) -> clean.History:
    """The whole cleaning plan as a history over the source. The plan has a few rows per column."""
    history = clean.History(p.df)
    for step in sorted(cleaning_plan(p).collect(), key=lambda r: r["step"]):
        for action in to_action(step, order_by):
            history = history.do(action)
    return history


def clean_by_plan(p: Profile, order_by: tuple[str, ...]) -> DataFrame:
    """The table after the whole plan."""
    return plan_history(p, order_by).current()


def preview_statistics(df: DataFrame, action: clean.Action) -> DataFrame:
    """Rows, columns, missing cells, duplicates and quality score of the table before and after an action, one row a side."""
    parts = []
    for side, table in (("before", df), ("after", action.apply(df))):
        p = profile(table)
        parts.append(dataset_stats(p, score(p).first()["score"]).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])
