"""One entry for all chart types: a declarative spec becomes one plan, filters always first."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from framewright.functions.numbers import half_up
from framewright.functions.text import is_time
from framewright.operators import aggregate, charts, temporal
from framewright.operators.filters import filter_all, slice_rows
from framewright.operators.scale import exact_quantiles

# The chart types and which of them show a plain category aggregate.
CATEGORY_CHARTS = ("bar", "horizontal_bar", "column", "line", "area", "step_line", "pie", "donut", "radar", "polar_area",
                   "treemap", "radial_bar")
OTHER_CHARTS = ("scatter", "bubble", "histogram", "box", "waterfall", "funnel", "heatmap", "composed", "gauge", "kpi_card",
                "table")
CHARTS = CATEGORY_CHARTS + OTHER_CHARTS
FILTER_OPS = {"equals": "eq", "not_equals": "neq", "contains": "contains", "greater_than": "gt", "less_than": "lt", "in": "in"}


@dataclass(frozen=True)
class ChartSpec:
    """What to draw. ``filters`` holds (column, operator, value)."""

    type: str
    x: str | None = None
    y: str | None = None
    group: str | None = None
    agg: str = "sum"
    sort: str = "desc"
    top: int = 0
    grain: str = "auto"
    preset: str = "all_time"
    target: float | None = None
    order_by: tuple[str, ...] = ()
    filters: tuple[tuple[str, str, object], ...] = field(default_factory=tuple)
    reference_line: str = "none"
    reference_value: float | None = None


def chart_data(df: DataFrame, spec: ChartSpec) -> DataFrame:
    """The rows of a chart."""
    if spec.type not in CHARTS:
        raise ValueError(f"unknown chart type {spec.type}")
    rows = filter_all(df, [(c, FILTER_OPS[op], v) for c, op, v in spec.filters])
    out = _dispatch(rows, spec)
    return reference_line(out, spec) if spec.reference_line != "none" and "value" in out.columns else out


def dashboard_rows(df: DataFrame, slicers: dict[str, object], filters: tuple = (), date: str | None = None,
                   preset: str = "all_time") -> DataFrame:
    """Rows a dashboard shows: slicers, chart filters and the global date preset together."""
    kept = slice_rows(df, slicers, [(c, FILTER_OPS[op], v) for c, op, v in filters])
    return temporal.in_preset(kept, date, preset) if date else kept


def _dispatch(df: DataFrame, s: ChartSpec) -> DataFrame:
    kind, metric, top = s.type, s.y or s.x, s.top
    if kind == "kpi_card":
        return aggregate.kpi_card(df, metric, s.agg)
    if kind == "histogram":
        return charts.histogram(df, metric)
    if kind == "box":
        return charts.box_plot(df, metric, s.group or (s.x if s.x != metric else None))
    if s.x is None:
        raise ValueError(f"{kind} needs a category column")
    if kind == "gauge":
        return aggregate.gauge(df, metric, s.target, s.agg)
    if kind in ("scatter", "bubble"):
        if not s.order_by or s.y is None:
            raise ValueError(f"{kind} needs y and order_by")
        if kind == "scatter":
            return charts.scatter(df, s.x, s.y, list(s.order_by), s.group)
        return charts.bubble(df, s.x, s.y, s.group, list(s.order_by))
    if is_time(df.schema[s.x].dataType) and s.y is not None:
        if s.group:
            kept = temporal.in_preset(df, s.x, s.preset)
            return temporal.series_by(kept, s.x, s.y, s.group, s.agg, temporal.resolve_grain(kept, s.x, s.grain), top or None)
        return temporal.temporal(df, s.x, s.y, s.agg, s.grain, s.preset)
    if kind == "waterfall":
        return charts.waterfall(df, s.x, s.y, top or None)
    if kind == "funnel":
        return charts.funnel(df, s.x, s.y, top or None)
    if kind == "heatmap":
        return aggregate.heatmap(df, s.x, s.group, s.y, top or None)
    if kind == "composed":
        return aggregate.combo(df, s.x, s.y, s.group, s.agg, top or None)
    if kind == "table":
        return aggregate.summary_table(df, s.x, s.y, s.agg, s.sort, top or None)
    if s.group and s.group != s.x:
        return charts.multi_series(df, s.x, s.group, s.y, s.agg, top or None)
    return charts.bar(df, s.x, s.y, s.agg, s.sort, top or None)


def reference_line(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """Adds the mean, the median or a constant as a ``reference`` column."""
    if spec.reference_line == "constant":
        level = F.lit(float(spec.reference_value))
    elif spec.reference_line == "mean":
        level = half_up(rows.agg(F.avg("value").alias("m")).scalar(), 2)
    else:
        level = half_up(exact_quantiles(rows, [], F.col("value"), {"m": 0.5}).scalar(), 2)
    return rows.withColumn("reference", level)
