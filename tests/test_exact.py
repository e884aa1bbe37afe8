"""Numbers that doubles cannot tell apart, totals that cannot be added up, and series compared with themselves."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from framewright.operators import charts, filters, profile, temporal


@pytest.mark.parametrize("kind", ["bigint", "decimal(20,0)"])
def test_limits_are_exact(spark, kind):
    big = 2**53
    rows = spark.range(100).select((F.col("id") + F.lit(big)).cast(kind).alias("k"))
    keys = [big + i for i in range(100)]
    for op, test in [("gt", lambda a, b: a > b), ("gte", lambda a, b: a >= b), ("lt", lambda a, b: a < b), ("lte", lambda a, b: a <= b),
                     ("eq", lambda a, b: a == b), ("neq", lambda a, b: a != b)]:
        for limit in (str(big + 1), big + 7, f"{big + 7}.5", "-3", "1e30", "-1e30", Decimal(big + 3)):
            want = sorted(k for k in keys if test(k, Decimal(str(limit))))
            got = sorted(int(r.k) for r in filters.filter_rows(rows, "k", op, limit).collect())
            assert got == want, (op, limit)
    got = sorted(int(r.k) for r in filters.filter_rows(rows, "k", "in", f"{big + 1}, x, {big + 2}.0, {big + 3}.5, 1e40").collect())
    assert got == [big + 1, big + 2]


def test_nulls_and_words_match_nothing(spark):
    rows = spark.createDataFrame([(None, None), (1, 1.5)], "k long, d double")
    assert filters.filter_rows(rows, "k", "neq", "x").count() == 1
    assert filters.filter_rows(rows, "k", "lt", "1e30").count() == 1
    assert filters.filter_rows(rows, "d", "in", "1.5,zz").count() == 1
    with pytest.raises(ValueError):
        filters.filter_rows(rows, "k", "gt", "abc")


def test_distinct_whole_numbers(spark):
    rows = spark.range(100).select((F.col("id") + F.lit(2**53)).alias("k"), (F.col("id") / 4).cast("decimal(10,4)").alias("d"),
                                   (F.col("id") % 3).cast("double").alias("f"))
    facts = {r["column"]: r for r in profile.profile(rows).facts().collect()}
    assert [facts[c]["distinct"] for c in "kdf"] == [100, 100, 3]
    tops = {(r["column"], r["rank"]): r["value"] for r in profile.profile(rows).top().collect()}
    assert tops["k", 1] == str(2**53) and tops["d", 2] == "0.25" and tops["d", 1] == "0"


def test_series_totals_come_from_rows(spark):
    rows = spark.createDataFrame([("a", f"s{i}", float(i), i % 2) for i in range(15)], "g string, s string, v double, k int")
    wide = charts.multi_series(rows, "g", "s", "v", "mean", max_series=10).first()
    assert wide["total"] == 7.0 and wide["other_series"] == 7.0
    assert charts.multi_series(rows, "g", "s", "k", "count_distinct").first()["total"] == 2.0
    assert len(charts.multi_series(rows, "g", "s", "v").columns) == 17


def test_keyed_series_are_compared_with_themselves(spark):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-02-01", 3.0), ("b", "2024-01-01", 10.0), ("b", "2024-02-01", 5.0), (None, "2024-02-01", 2.0)]
    points = spark.createDataFrame(rows, "k string, d string, value double").selectExpr("k", "cast(d as timestamp) as period_start", "d as period", "value")
    got = {(r.k, r.period): r.base_value for r in temporal.compare_periods(points, "monthly", keys=["k"]).collect()}
    assert got["a", "2024-02-01"] == 1.0 and got["b", "2024-02-01"] == 10.0 and got[None, "2024-02-01"] is None


@pytest.mark.parametrize("rows,distinct", [(0, 1), (3, 3), (1000, 1), (60_000, 60_000), (60_000, 7), (5000, 400)])
def test_systematic_samples_are_every_kth_row(spark, rows, distinct):
    df = spark.range(rows).select(F.when(F.col("id") % 13 != 0, (F.col("id") * 7919) % distinct).alias("k"), F.md5(F.col("id").cast("string")).alias("w"), "id")
    want = sorted(([(r.k is not None, r.k or 0), r.w, r.id] for r in df.collect()))
    step = max(1, rows // 50)
    got = filters.systematic_sample(df.repartition(5), ["k"], 50).collect()
    assert sorted(r.id for r in got) == sorted(r[2] for r in want[::step])
