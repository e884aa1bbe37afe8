"""Features of any cardinality and the pruned search for the nearest of many centres."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.operators import encoding, ml, nearest


def brute(rows, centres):
    names = sorted(centres)
    c = np.array([centres[n] for n in names])
    return {k: names[int(((c - np.array(z)) ** 2).sum(axis=1).argmin())] for k, z in rows.items()}


@pytest.mark.parametrize("many,dims,spread", [(1, 3, 1.0), (2, 1, 1.0), (700, 2, 1.0), (100_000, 3, 1.0), (3000, 4, 0.001)])
def test_nearest_of_many(spark, many, dims, spread):
    r = np.random.default_rng(many)
    centres = {f"k{i:06d}": (r.normal(size=dims) * (1 if i % 3 else spread)).round(3).tolist() for i in range(many)}
    rows = {i: r.normal(size=dims).round(3).tolist() for i in range(300)}
    rows[1] = rows[0]
    got = nearest.nearest(spark.createDataFrame(list(rows.items()), "k long, z array<double>").repartition(4),
                          spark.createDataFrame(list(centres.items()), "class string, z array<double>"))
    assert {x.k: x["class"] for x in got.collect()} == brute(rows, centres)


def test_nearest_without_centres(spark):
    rows = spark.createDataFrame([(1, [0.0])], "k long, z array<double>")
    assert nearest.nearest(rows, spark.createDataFrame([], "class string, z array<double>")).first()["class"] is None
    assert nearest.nearest(rows.limit(0), rows.select(F.lit("a").alias("class"), "z")).count() == 0


@pytest.mark.parametrize("many", [1500, 100_000])
def test_categories_of_any_number_train(spark, many):
    rows = spark.range(many * 2).select("id", F.concat(F.lit("c"), F.col("id") % many).alias("word"),
                                        (F.col("id") % many % 10).cast("double").alias("y"))
    trained = ml.train_regression(rows, "y", ["word"], "id", "ols")
    assert trained.metrics.first()["r2"] > 0.1  # half of the tested categories were seen once or twice in training
    assert trained.importances().first()["importance"] > 0


def test_target_means_do_not_leak(spark):
    """Unique categories and a random target: within the fold the mean would be the target itself."""
    rows = spark.range(4000).select("id", F.col("id").cast("string").alias("word"), F.rand(3).alias("y"))
    assert abs(ml.train_regression(rows, "y", ["word"], "id", "ols").metrics.first()["r2"]) < 0.1
    data = ml.prepared(rows, F.col("y"), ["word"], "id", "_y")
    train = data.where("not is_test")
    coded = encoding.TargetMeans("word", 1).fit(train).transform(train)
    assert abs(coded.select(F.corr("_y", "word__mean0")).first()[0]) < 0.1
    assert coded.count() == train.count()


def test_target_means_by_hand(spark):
    rows = [(i, "ab"[i % 2] if i % 5 else None, i % 3, float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, w string, _fold int, _y double")
    got = {r.id: r.w__mean0 for r in encoding.TargetMeans("w", 1).fit(df).transform(df).collect()}
    for i, w, f, _ in rows:
        rest = [y for _, v, g, y in rows if g != f and v == w]
        prior = np.mean([y for _, _, g, y in rows if g != f])
        assert got[i] == pytest.approx((sum(rest) + encoding.SMOOTH * prior) / (len(rest) + encoding.SMOOTH))
    new = spark.createDataFrame([(1, "a"), (2, "unseen")], "id long, w string")
    score = {r.id: r.w__mean0 for r in encoding.TargetMeans("w", 1).fit(df).transform(new).collect()}
    seen = [y for _, v, _, y in rows if v == "a"]
    mean = np.mean([y for *_, y in rows])
    assert score[1] == pytest.approx((sum(seen) + encoding.SMOOTH * mean) / (len(seen) + encoding.SMOOTH)) and score[2] == pytest.approx(mean)


def test_many_classes_are_joined(spark):
    rows = spark.range(3000).select("id", F.concat(F.lit("class"), F.col("id") % 12).alias("c"), (F.col("id") % 12 * 5.0).alias("x"))
    trained = ml.train_classification(rows, "c", ["x"], "id", "decision_tree")
    assert trained.predictions.count() > 0 and trained.metrics.first()["accuracy"] > 0.8
    assert ml.nearest_centroid(rows, "c", ["x"], "id").where("actual <> predicted").count() == 0


def test_training_rows_are_dealt_by_number(spark, monkeypatch):
    """1,000 rows in one small file: the model is fitted on partitions of at most some 100 rows, none left out."""
    from pyspark.sql import functions as F

    from framewright.operators import ml

    seen = []

    class Fitted(Exception):
        pass

    class Line:
        def __init__(self, stages):
            pass

        def fit(self, train):
            seen.extend(r["n"] for r in train.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
            raise Fitted

    monkeypatch.setattr(ml, "ROWS_PER_TASK", 100, raising=False)
    monkeypatch.setattr(ml, "Pipeline", Line)
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("x"), (F.col("id") * 2.0).alias("y")).coalesce(1)
    for run in (lambda: ml.train_regression(rows, "y", ["x"], "id", "gradient_boosting", test_pct=0),
                lambda: ml.train_classification(rows, "x", ["y"], "id", "decision_tree", test_pct=0),
                lambda: ml.kmeans(rows, ["x", "y"])):
        seen.clear()
        try:
            run()
        except Fitted:
            pass
        assert sum(seen) == 1000 and max(seen) <= 150
