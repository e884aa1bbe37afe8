"""Joins with keys of half a per cent, a third and heat on both sides, copies of one row, and ranks of all pairs at once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.operators import filters, scale, stats


@pytest.fixture(scope="module")
def sides(spark):
    """Left: a third ``hot``, 0.5 % ``warm``, some null; right: ``hot`` heavy too, ``wide`` heavy on the right only."""
    key = lambda n: F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 200 == 1, "warm").when(F.col("id") % 50 == 2, None).otherwise(
        F.concat(F.lit("k"), (F.col("id") % n).cast("string")))
    left = spark.range(20_000).select("id", key(5000).alias("key"))
    right = spark.range(3000).select(F.col("id").alias("other"), F.when(F.col("id") % 100 == 0, "hot").when(F.col("id") % 4 == 1, "k7")
                                     .when(F.col("id") % 500 == 2, None).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key"))
    return left.repartition(7), right.repartition(3)


@pytest.mark.parametrize("how", ["inner", "left", "right"])
def test_rows_of_skewed_joins(sides, how):
    left, right = sides
    got = Counter(tuple(r) for r in scale.skew_join(left, right, "key", how).select("key", "id", "other").collect())
    assert got == Counter(tuple(r) for r in left.join(right, "key", how).select("key", "id", "other").collect())


def test_no_task_gets_more_than_its_share(sides):
    left, right = sides
    share = 0.003
    heavy, other = scale.heavy_keys(left, "key", share), scale.heavy_keys(right, "key", share)
    assert {"hot", "warm"} <= set(heavy) and {"hot", "k7"} <= set(other)
    placed = scale._grid(left, right, "key", scale._parts(heavy, share), scale._parts(other, share))
    for df, total in zip(placed, (20_000, 3000)):
        most = df.where("key is not null").groupBy("key", "_salt", "_across").count().agg(F.max("count")).first()[0]
        assert most <= 2 * share * total + 8  # a hash spreads unevenly by chance
    copies = [df.where("key = 'hot'").count() for df in placed]
    assert sum(copies) <= left.where("key = 'hot'").count() * right.where("key = 'hot'").count()


def test_even_and_empty_sides(spark):
    left = spark.range(100).select(F.col("id").alias("key"), F.lit(1).alias("a"))
    none = left.select("key", F.col("a").alias("b")).limit(0)
    assert scale.skew_join(left, none, "key", "left").count() == 100 and scale.skew_join(left, none, "key").count() == 0
    assert scale.skew_join(none, left, "key", "left").count() == 0


def test_copies_of_one_row(spark):
    rows = spark.createDataFrame([(1, "a")] * 3000 + [(i, None) for i in range(2000)] + [(5, None), (7, "x")], "k int, w string").repartition(4)
    assert filters.rows_duplicate(rows).groupBy("k", "w").count().collect().sort() == [(1, "a", 3000), (5, None, 2)].sort()
    assert Counter(tuple(r) for r in filters.rows_duplicate(rows).collect()) == {(1, "a"): 3000, (5, None): 2}


def test_spearman_of_all_pairs(spark):
    import pandas as pd

    rows = [(float(i % 17) if i % 5 else None, 0.0 if i % 3 else float(i), float(-i) if i % 7 else None, float(i * i % 101)) for i in range(800)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(6)
    want = pd.DataFrame(rows, columns=list("abcd")).corr(method="spearman")
    got = {(r.column_a, r.column_b): r for r in stats.corr_spearman(df).collect()}
    assert len(got) == 6
    for (a, b), r in got.items():
        assert r.r == pytest.approx(want.loc[a, b], abs=6e-4)
        assert r.n == sum(x["abcd".index(a)] is not None and x["abcd".index(b)] is not None for x in rows)
    assert stats.corr_spearman(df, ["a"]).count() == 0
