"""Nothing is cut off, merged or rounded away."""

import pytest
from pyspark.sql import functions as F

from framewright.functions.numbers import half_up
from framewright.functions.text import sanitize
from framewright.operators import aggregate, charts, clean, drivers, filters, insights, joins, keys, ml, profile, stats, temporal
from framewright.sources import files


def test_half_up_of_large_numbers(spark):
    rows = spark.createDataFrame([(1e17,), (8e16,), (1e22,), (2.5,), (None,)], "x double")
    got = [tuple(r) for r in rows.select(half_up(F.col("x"), 2), half_up(F.col("x"), 3), half_up(F.col("x"))).collect()]
    assert got == [(1e17, 1e17, 1e17), (8e16, 8e16, 8e16), (1e22, 1e22, 1e22), (2.5, 2.5, 3.0), (None, None, None)]


def test_long_ids_compare_exactly(spark):
    rows = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 2,)], "id long")
    assert [r.id for r in rows.where(filters.condition(rows, "id", "eq", str(2**53 + 1))).collect()] == [2**53 + 1]
    assert rows.where(filters.condition(rows, "id", "neq", 2**53 + 1)).count() == 2
    assert rows.where(filters.condition(rows, "id", "eq", "1.5")).count() == 0


def test_long_filter_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = orders.where(filters.condition(orders, "o_orderkey", "eq", "5"))._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,5)" in plan


def test_header_names_that_start_like_blank_ones(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,_category,,_c_flag\n1,a,,x\n2,b,,y\n")
    assert files.read_delimited(spark, str(tmp_path / "a.csv")).columns == ["id", "_category", "_c_flag"]


def test_rows_without_id_stay(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (" ", 3), ("a", 4), ("a", 5)], "k string, n int")
    kept = clean.RemoveDuplicateIds("k", ("n",)).apply(rows)
    assert sorted(r.n for r in kept.collect()) == [1, 2, 3, 4]


def test_waterfall_is_whole(spark):
    rows = spark.createDataFrame([(f"g{i:02d}", float(i - 9)) for i in range(25)], "g string, v double")
    for top, steps in ((None, 25), (4, 5)):
        got = charts.waterfall(rows, "g", "v", top).collect()
        assert len(got) == steps + 1
        assert [r.delta for r in got if r.is_total] == [75.0]


def test_every_dimension_is_analysed(spark):
    rows = spark.range(40).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("d"), F.col("id").cast("double").alias("v"),
                                  *[(F.col("id") % (i + 2)).cast("string").alias(f"x{i}") for i in range(6)])
    got = drivers.driver_delta(rows, "v", "d", [f"x{i}" for i in range(6)], top=1000)
    assert {r.dimension for r in got.select("dimension").distinct().collect()} == {f"x{i}" for i in range(6)}


def test_number_of_clusters_is_taken_as_given(spark):
    rows = spark.range(60).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 * 3).cast("double").alias("b"))
    assert ml.kmeans(rows, ["a", "b"], k=9)["sizes"].count() == 9
    with pytest.raises(ValueError):
        ml.kmeans(rows, ["a", "b"], k=1)


def test_sanitize_keeps_the_whole_text(spark):
    rows = spark.createDataFrame([("x" * 5000,)], "t string")
    assert rows.select(F.length(sanitize(F.col("t")))).first()[0] == 5000
    assert rows.select(F.length(sanitize(F.col("t"), 2000))).first()[0] == 2000


def test_leap_day_compares_with_its_own_day(spark):
    points = spark.sql("""select timestamp'2024-02-28' as period_start, '2024-02-28' as period, 10.0D as value union all
        select timestamp'2024-02-29', '2024-02-29', 99.0D union all select timestamp'2025-02-28', '2025-02-28', 20.0D""")
    got = temporal.compare_periods(points, "daily", "year").where("period = '2025-02-28'").first()
    assert got.base_value == 10.0


def test_text_numbers_are_read_everywhere(spark):
    rows = spark.createDataFrame([("a", "$1,000.50", 1.0), ("a", "n/a", 2.0), ("b", "3", 3.0), ("b", "12%", 4.0)], "g string, m string, x double")
    assert {r.group_value: r.value for r in aggregate.group_agg(rows, "g", "m").collect()} == {"a": 1000.5, "b": 15.0}
    assert stats.corr_pearson(rows, ["m", "x"]).first().n == 3
    assert insights.dataset_insights(profile.profile(spark.createDataFrame([("u",), ("v",)], "only string"))).count() == 0


def test_no_group_vanishes_from_charts(spark):
    rows = spark.range(400).select((F.col("id") % 20).cast("string").alias("g"), (F.col("id") % 13).cast("string").alias("s"))
    assert charts.funnel(rows, "g").count() == 20
    wide = charts.multi_series(rows, "g", "s")
    assert "other_series" in wide.columns and wide.count() == 20
    names = [c for c in wide.columns if c not in ("category", "total")]
    assert wide.select(F.sum(sum((F.col(f"`{c}`") for c in names), F.lit(0.0)))).first()[0] == 400
    for top in (None, 3):
        assert aggregate.crosstab(rows, "g", "s", top).agg(F.sum("records")).first()[0] == 400
    assert aggregate.heatmap(rows, "g", "s", top=3).count() == 16


def test_preview_of_equal_keys_and_of_removals(spark):
    rows = spark.createDataFrame([(1, " a"), (2, "b"), (2, "c "), (3, None)], "k int, v string")
    got = clean.preview(rows, clean.Trim("v"), ["k"]).collect()
    assert [(r.k, r.before.v, r.after.v) for r in got] == [(1, " a", "a"), (2, "c ", "c")]
    gone = clean.preview(rows, clean.DropMissing("v"), ["k"]).collect()
    assert [(r.k, r.changed, r.after) for r in gone] == [(3, "removed", None)]


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_joins_with_null_keys_and_a_hot_right_side(spark, how):
    left = spark.range(300).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("k"), F.col("id").alias("a"))
    right = spark.range(200).select(F.when(F.col("id") % 4 > 0, F.lit(3)).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("b"))
    got = joins.safe_join(left, right, "k", "k", how)
    plain = left.join(right, "k", how)
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))


def test_decimal_and_text_keys_meet(spark):
    big = "12345678901234567890"
    left = spark.sql(f"select cast('{big}' as decimal(20,0)) as k, 1 as a union all select cast(7 as decimal(20,0)), 2")
    right = spark.createDataFrame([(big, 1), ("7", 2)], "k string, b int")
    assert joins.safe_join(left, right, "k", "k").count() == 2
    numbers = spark.range(50).select(F.col("id").alias("order_id"))
    texts = spark.range(50).select(F.col("id").cast("string").alias("order_id"))
    assert keys.discover_relationships({"x": numbers, "y": texts}).first().matches == 50


def test_one_odd_value_does_not_decide_the_type(spark):
    rows = spark.range(1000).select(F.when(F.col("id") == 0, "!").otherwise(F.concat(F.lit("abc-"), F.lpad(F.col("id").cast("string"), 6, "0"))).alias("c"))
    assert profile.profile(rows).facts_rows[0]["type"] == "id"
