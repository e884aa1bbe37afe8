"""Headline timings: one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every query is run once to warm up and then
timed as the median of BENCH_RUNS further runs; results are written to the no-op sink, so all columns are computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from framewright import local_session  # noqa: E402
from framewright.operators import aggregate, charts, insights, profile, quality  # noqa: E402
from framewright.queries import registry  # noqa: E402

HEADLINE = [
    "segment_revenue", "filter_compare", "join_inner", "join_full", "join_preview", "group_summary", "chart_multi_series",
    "box_plot", "histogram", "kpi_half_split", "temporal_growth", "temporal_series", "rows_duplicate", "rows_outlier",
    "profile_counts_orders", "audit_issues_orders", "clean_dedup", "clean_ffill", "clean_impute_median",
    "relationship_discover", "describe", "anova", "chi_square", "mann_whitney", "corr_pearson", "corr_spearman", "anomalies",
    "driver_delta", "nearest_centroid", "sanitize_text", "html_tables",
]


def bench_orders(spark, rows: int):
    """The studied system's own benchmark table: 8 columns of index arithmetic."""
    i = F.col("id")
    region = F.element_at(F.array(*[F.lit(x) for x in ("North", "South", "East", "West", "Central")]), (i % 5 + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(x) for x in ("A", "B", "C", "D", "E")]), (i % 5 + 1).cast("int"))
    return spark.range(0, rows, numPartitions=8).select(
        (i + 10000).alias("order_id"), region.alias("region"), kind.alias("category"),
        (50 + (i % 800) * 1.25 + (i % 7) * 4.3).alias("sales"), (1 + i % 12).cast("int").alias("quantity"),
        ((i % 5) * 0.05).alias("discount"), (15 + (i % 300) * 0.85 - (i % 5) * 12).alias("profit"),
        F.date_add(F.lit("2025-01-01").cast("date"), (i % 365).cast("int")).alias("order_date"),
    )


def suite(spark, rows: int) -> None:
    """Profile, audit, insights, group sum, chart and report tables over the benchmark table."""
    df = bench_orders(spark, rows)
    p = profile.profile(df)
    quality.audit(p).collect()
    insights.dataset_insights(p).collect()
    aggregate.group_agg(df, "region", "sales").collect()
    charts.scatter(df, "quantity", "sales", ["order_id"]).collect()
    insights.report_overview(p).collect()


def timed(run, runs: int) -> float:
    run()
    seconds = []
    for _ in range(runs):
        start = time.time()
        run()
        seconds.append(time.time() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    registry.load_all()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores)
    queries = {}
    for name in sys.argv[1:] or HEADLINE:
        run = registry.QUERIES[name]
        queries[name] = timed(lambda: run(spark, folder).write.format("noop").mode("overwrite").save(), runs)
    if not sys.argv[1:]:
        queries["pipeline_1m_rows"] = timed(lambda: suite(spark, 1_000_000), runs)
    total = round(sum(queries.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": queries, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
