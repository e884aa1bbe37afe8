"""Rule boundaries on hand-made tables of a few rows."""

import pytest
from pyspark.sql import functions as F

from framewright.functions import dates, numbers, text
from framewright.functions.missing import missing_in
from framewright.operators import (
    aggregate, charts, classify, clean, filters, insights, keys, ml, profile, quality, stats, temporal,
)
from framewright.sources import files, html_tables


def one(df, expression):
    return df.select(expression).first()[0]


@pytest.mark.parametrize("value, want", [
    ("$1,234.50", 1234.5), (" 12 % ", 12.0), ("₹ 5", 5.0), ("1e3", 1000.0), ("12d", None), ("", None), ("N/A", None),
    ("-.5", -0.5), ("1.2.3", None), ("NaN", None),
])
def test_to_number(spark, value, want):
    assert one(spark.createDataFrame([(value,)], "x string"), numbers.to_number(F.col("x"))) == want


@pytest.mark.parametrize("value, digits, want", [(2.5, 0, 3.0), (-2.5, 0, -2.0), (1.005, 1, 1.0), (0.125, 2, 0.13)])
def test_half_up(spark, value, digits, want):
    assert one(spark.createDataFrame([(value,)], "x double"), numbers.half_up(F.col("x"), digits)) == want


@pytest.mark.parametrize("value, level, want", [
    ("", "basic", True), (" ", "basic", False), ("N/A", "basic", False), ("N/A", "fill", True), ("missing", "fill", False),
    ("missing", "profile", True), (" Nil ", "fill", True), ("x", "profile", False), (None, "basic", True),
])
def test_missing_levels(spark, value, level, want):
    df = spark.createDataFrame([(value,)], "x string")
    assert one(df, missing_in(df, "x", level)) is want


@pytest.mark.parametrize("value, want", [
    ("2024-03-09", "2024-03-09"), ("09/03/2024", "2024-03-09"), ("2024-13-45", None), ("not a date", None),
    ("2024-03-09T10:11:12Z", "2024-03-09"), ("Mar 9, 2024", "2024-03-09"), ("31-12-1999", "1999-12-31"),
])
def test_parse_date(spark, value, want):
    df = spark.createDataFrame([(value,)], "x string")
    assert one(df, F.date_format(dates.parse_date(F.col("x")), "yyyy-MM-dd")) == want


@pytest.mark.parametrize("day, grain, key", [
    ("2024-12-30", "weekly", "2025-W01"), ("2021-01-03", "weekly", "2020-W53"), ("2024-12-30", "quarterly", "2024-Q4"),
    ("2024-02-29", "monthly", "2024-02"), ("2024-02-29", "yearly", "2024"), ("2024-02-29", "daily", "2024-02-29"),
])
def test_period_key(spark, day, grain, key):
    df = spark.createDataFrame([(day,)], "x string").select(F.col("x").cast("date").alias("x"))
    assert one(df, dates.period_key(F.col("x"), grain)) == key


@pytest.mark.parametrize("days, grain", [(14, "daily"), (15, "weekly"), (90, "weekly"), (1095, "monthly"), (3650, "quarterly"),
                                         (3651, "yearly")])
def test_auto_grain(days, grain):
    assert dates.grain_for_days(days) == grain


def test_growth_from_zero(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 0.0), (4, -5.0)], "d int, v double")
    days = df.select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")).alias("d"), "v")
    got = temporal.temporal(days, "d", "v", "sum", "daily", window=2).orderBy("period").collect()
    assert [r["growth_pct"] for r in got] == [None, 100.0, -100.0, 0.0]
    assert [r["moving_avg"] for r in got] == [None, 2.5, 2.5, -2.5]
    assert [r["cumulative"] for r in got] == [0.0, 5.0, 5.0, 0.0]


def test_fence_value_is_no_outlier(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 8)], "v double")
    limits = filters.fences(df, ["v"]).first()
    edge = df.union(df.limit(0)).where(F.col("v") == limits["high"])
    assert filters.rows_outlier(df).count() == df.where((F.col("v") > limits["high"]) | (F.col("v") < limits["low"])).count()
    assert edge.join(filters.rows_outlier(df), "v").count() == 0


def column_type(spark, values, kind="string"):
    p = profile.profile(spark.createDataFrame([(v,) for v in values], f"x {kind}"))
    return p.facts_rows[0]


def test_types(spark):
    assert column_type(spark, ["yes", "no", "yes", "no"])["type"] == "boolean"
    assert column_type(spark, ["1", "0", "1", "0"])["type"] == "numeric"
    assert column_type(spark, ["$1", "$2", "3", "4", "x"] + ["5"] * 3)["type"] == "numeric"
    assert column_type(spark, ["2024-01-01", "2024-01-02", "05/02/2024", "bad", "2024-01-05", "2024-01-06"])["type"] == "datetime"
    assert column_type(spark, [f"id{i:05d}" for i in range(30)])["type"] == "id"
    assert column_type(spark, [f"some words {i} and more" for i in range(30)])["type"] == "text"
    assert column_type(spark, ["a", "b"] * 20)["type"] == "categorical"
    assert column_type(spark, [None, "", "n/a"])["type"] == "text"
    assert column_type(spark, [True, False, True, True], "boolean")["type"] == "boolean"
    assert column_type(spark, ["₹ 1 000", "₹ 2 000"] * 3)["recommended"] == "numeric"


def test_empty_and_tiny_tables(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert profile.missing_counts(empty).count() == 2
    assert filters.rows_duplicate(empty).count() == 0
    assert charts.histogram(empty, "b").count() == 0
    single = profile.profile(spark.createDataFrame([("x", 1.0)], "a string, b double"))
    row = single.numeric().first()
    assert (row["variance"], row["skewness"], row["outliers"]) == (0.0, None, 0)
    nulls = profile.profile(spark.createDataFrame([(None, 1.0)] * 6, "a string, b double"))
    assert {r["dimension"] for r in quality.audit(nulls).collect()} >= {"mostly_missing_columns", "duplicate_rows"}


@pytest.mark.parametrize("gone, severity", [(1, "LOW"), (2, "MEDIUM"), (4, "MEDIUM"), (5, "HIGH"), (13, "HIGH"), (14, "drop")])
def test_missing_severity(spark, gone, severity):
    """Of 20 rows: exactly 5 % is LOW, exactly 20 % MEDIUM, 70 % means drop the column."""
    rows = [(i, None if i < gone else f"v{i % 3}") for i in range(20)]
    found = quality.audit(profile.profile(spark.createDataFrame(rows, "n int, c string"))).where("column = 'c'").collect()
    hits = [r for r in found if "missing" in r["dimension"]]
    assert hits[0]["fix"] == "drop_column" if severity == "drop" else hits[0]["severity"] == severity


def test_score_bounds_and_plan_order(spark):
    rows = [(i % 4, None if i % 2 else " x ", -5 if i == 3 else 999 if i == 4 else 30, "same") for i in range(60)]
    p = profile.profile(spark.createDataFrame(rows, "row_id int, word string, age int, k string"))
    score = quality.score(p).first()
    assert 5 <= score["score"] <= 100
    plan = [r["dimension"] for r in quality.cleaning_plan(p).orderBy("step").collect()]
    order = [quality.STEP_ORDER.index(d) for d in plan]
    assert order == sorted(order) and "negative_values" in plan and "impossible_values" in plan
    parts = quality.explain_score(p).collect()
    assert sum(r["weight"] for r in parts) == 100


def test_cleaning_is_idempotent(spark):
    df = spark.createDataFrame([(1, " a B ", 5.0), (1, " a B ", 5.0), (2, None, 900.0), (3, "x", 6.0), (4, "y", 7.0), (5, "z", 5.5)],
                               "id int, w string, v double")
    for action in (clean.RemoveDuplicates(), clean.DropMissing(), clean.Trim(), clean.Recase(None, "title"), clean.Cap("v", 0, 10)):
        once = action.apply(df)
        assert sorted(map(tuple, action.apply(once).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_history(spark):
    df = spark.createDataFrame([(1, " a "), (2, None)], "id int, w string")
    h = clean.History(df).do(clean.Trim("w")).do(clean.DropMissing("w")).do(clean.Rename("w", "word"))
    assert h.current().columns == ["id", "word"] and h.current().count() == 1
    assert h.undo().current().columns == ["id", "w"]
    assert h.undo().undo().current().count() == 2
    assert h.revert().current().collect() == df.collect()
    log = h.log().orderBy("step").collect()
    assert [r["affected_rows"] for r in log] == [1, 1, 0]
    with pytest.raises(ValueError):
        clean.Rename("w", "id").apply(df)


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "k string, o int")
    assert sorted(r["o"] for r in clean.RemoveDuplicateIds("k", ("o",)).apply(df).collect()) == [1, 2, 3]
    assert sorted(r["o"] for r in clean.RemoveDuplicateIds("k", ("o",), "last").apply(df).collect()) == [1, 2, 4]


def test_group_labels_and_shares(spark):
    df = spark.createDataFrame([(None, 1.0), ("", 2.0), (" ", 3.0), ("a", 4.0), (" a", 5.0), ("b", None)], "g string, v double")
    got = {r["category"]: r for r in aggregate.group_summary(df, "g", "v").collect()}
    assert set(got) == {"Unknown", "(Empty)", "a"}
    assert got["a"]["median"] == 4.5 and got["(Empty)"]["sum"] == 5.0
    assert sum(r["share_pct"] for r in got.values()) == pytest.approx(100, abs=0.2)


def test_histogram_counts_every_row(spark):
    df = spark.range(1000).select((F.col("id") % 37).cast("double").alias("v"))
    for rule in ("chart", "report", "profile"):
        assert charts.histogram(df, "v", rule).agg(F.sum("records")).first()[0] == 1000
    same = spark.createDataFrame([(5.0,)] * 9, "v double")
    assert charts.histogram(same, "v").agg(F.max("records")).first()[0] == 9


def test_period_sums_equal_total(spark):
    df = spark.range(500).select(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("id") * 3).cast("int")).alias("d"),
                                 F.col("id").cast("double").alias("v"))
    for grain in dates.GRAINS:
        assert temporal.periods(df, "d", "v", "sum", grain).agg(F.sum("value")).first()[0] == 499 * 500 / 2
    gaps = temporal.dense_periods(temporal.periods(df, "d", "v", "sum", "daily"), "daily")
    assert gaps.agg(F.count_if("is_gap")).first()[0] == 499 * 2


def test_statistics_textbook(spark):
    rows = [("a", v) for v in (1.0, 2.0, 3.0, 4.0, 5.0)] + [("b", v) for v in (2.0, 4.0, 6.0, 8.0, 10.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = stats.welch_t(df, "g", "v", "a", "b").first()
    assert (t["t_statistic"], t["df"]) == (-1.897, 6) and t["p_value"] == pytest.approx(0.1066, abs=5e-4)
    f = stats.anova(df, "g", "v").first()
    assert f["f_statistic"] == pytest.approx(3.6, abs=1e-3)
    u = stats.mann_whitney(df, "g", "v", "a", "b").first()
    assert u["u_statistic"] == 5.0  # rank sum of a = 1 + 2.5 + 4 + 5.5 + 7
    assert stats.test_by_groups(df, "g", "v").first()["test"] == "welch_t"
    d = stats.describe(df, ["v"]).first()
    assert (d["count"], d["mean"], d["median"], d["mode"]) == (10, 4.5, 4.0, 2.0)


def test_correlation_is_pairwise(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 6.0, 5.0), (4.0, None, 2.0), (5.0, 10.0, 4.0)],
                               "a double, b double, c double")
    got = {(r["column_a"], r["column_b"]): r for r in stats.corr_pearson(df).collect()}
    assert got[("a", "b")]["r"] == 1.0 and got[("a", "b")]["n"] == 4 and got[("a", "b")]["p_value"] == 0.0
    rank = {(r["column_a"], r["column_b"]): r["r"] for r in stats.corr_spearman(df).collect()}
    assert rank[("a", "b")] == 1.0


def test_keys(spark):
    people = spark.createDataFrame([(i, f"P{i}") for i in range(1, 31)], "id int, name string")
    sales = spark.createDataFrame([(i % 30 + 1, float(i)) for i in range(200)], "people_id int, amount double")
    found = keys.discover_relationships({"people": people, "sales": sales}).collect()
    best = [r for r in found if {r["source_column"], r["target_column"]} == {"id", "people_id"}]
    assert len(best) == 1 and best[0]["cardinality"] == "MANY_TO_ONE" and best[0]["confidence"] == 99.0
    pk = {r["column"]: r for r in keys.primary_keys(profile.profile(people)).collect()}
    assert pk["id"]["confidence"] == 100 and pk["id"]["is_candidate"]
    codes = spark.createDataFrame([(f"AB-{i:03d}",) for i in range(12)], "sku string")
    assert keys.primary_keys(profile.profile(codes)).first()["confidence"] == 100


def test_units(spark):
    df = spark.createDataFrame([(n,) for n in ("price", "unit_qty", "km", "total_eur", "x", "growth_rate")], "n string")
    got = {r[0]: r[1] for r in df.select("n", classify.unit_of(F.col("n"))).collect()}
    assert got == {"price": "USD", "unit_qty": "COUNT", "km": "DISTANCE", "total_eur": "EUR", "x": "UNKNOWN", "growth_rate": "PERCENT"}
    assert temporal.metric_unit("revenue_eur")["prefix"] == "€" and temporal.metric_unit("tax_pct")["suffix"] == "%"
    assert text.pretty_name("order_totalPrice") == "Order Total Price"
    assert insights.chart_type_for("categorical", None, 4) == "donut"


def test_html_tables():
    page = ("<table><tr><th>A</th><th></th></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
            "<table><tr><td>x<br>y</td></tr><tr></tr></table><table><tr><th>only</th></tr></table>")
    got = html_tables.tables_of(page)
    assert got == [[{"A": "1", "Col_1": "2", "Col_2": "3"}], [{"Col_0": "xy"}]]
    assert html_tables.tables_of(None) == []


def test_json_shapes(spark, tmp_path):
    shapes = {"array": '[{"a": 1}, {"a": 2, "b": "x"}]', "data": '{"data": [{"a": 1}, {"a": 2, "b": "x"}], "n": 2}',
              "object": '{"a": 1, "b": "x"}', "scalars": '{"rows": [1, 2, 3]}'}
    for name, body in shapes.items():
        (tmp_path / f"{name}.json").write_text(body)
    read = lambda n, rows=None: files.read_json(spark, str(tmp_path / f"{n}.json"), rows)
    assert sorted(read("array").columns) == ["a", "b"] and read("array").count() == 2
    assert sorted(read("data").columns) == ["a", "b"] and read("data").count() == 2
    assert read("object").count() == 1
    assert [r["value"] for r in read("scalars", "rows").collect()] == [1, 2, 3]


def test_csv_header_rules(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a ,, b\n1,,x\n,,\n ,, \n2,,y\n")
    got = files.read_delimited(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["a", "b"] and got.count() == 2


def test_database_options():
    plain = files.database_options("jdbc:x", "sales")
    assert plain["dbtable"] == "sales" and "query" not in plain
    assert files.database_options("jdbc:x", "select 1 as a;")["query"] == "select 1 as a"
    split = files.database_options("jdbc:x", "select * from t", partition=("id", 0, 100, 8))
    assert split["dbtable"] == "(select * from t) t" and split["numPartitions"] == "8"


def test_models_learn_signal_and_not_noise(spark):
    df = spark.range(600).select("id", (F.col("id") % 17).cast("double").alias("x"), (F.rand(1) * 10).alias("noise"))
    df = df.withColumn("y", F.col("x") * 3 + 2).withColumn("cls", F.when(F.col("x") > 8, "hi").otherwise("lo")).cache()
    assert ml.train_regression(df, "y", ["x"], "id").metrics.first()["r2"] > 0.99
    assert ml.train_regression(df, "noise", ["x"], "id").metrics.first()["r2"] < 0.2
    first = ml.train_classification(df, "cls", ["x", "noise"], "id", "random_forest").metrics.first()
    again = ml.train_classification(df, "cls", ["x", "noise"], "id", "random_forest").metrics.first()
    assert first["accuracy"] > 0.95 and first == again
    folds = ml.kfold(df, "cls", ["x"], "id", "decision_tree", 3).collect()
    assert len(folds) == 3 and min(r["score"] for r in folds) > 0.9
    groups = ml.kmeans(df, ["x"], 2)
    assert groups["sizes"].agg(F.sum("records")).first()[0] == 600 and groups["facts"].first()["silhouette"] > 0.5


def test_streaming_periods(spark, tmp_path):
    from framewright.streaming.periods import fold_days, stream_periods

    rows = spark.range(240).select((F.lit("2024-01-01 00:00:00").cast("timestamp") + F.expr("make_interval(0,0,0,0,cast(id as int),0,0)"))
                                   .cast("timestamp_ntz").alias("ts"), F.lit(1.0).alias("v"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run = (stream_periods(stream, "ts", "v").writeStream.outputMode("complete").format("memory").queryName("days")
           .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    run.awaitTermination(120)
    days = spark.table("days")
    assert days.count() == 10 and days.agg(F.sum("records")).first()[0] == 240
    assert {r["period"]: r["value"] for r in fold_days(days, "monthly").collect()} == {"2024-01": 240.0}
