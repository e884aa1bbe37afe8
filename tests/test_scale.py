"""Hot keys, ties and block borders: results must not depend on how rows are spread."""

import random

import pytest
from pyspark.sql import functions as F

from framewright.operators import clean, scale
from framewright.operators.joins import join_preview, safe_join


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of the rows share key ``a``; many values tie."""
    rng = random.Random(7)
    rows = [(i, "a" if i % 3 else f"k{i % 50}", float(rng.randint(0, 300)) if i % 7 else None) for i in range(6000)]
    return spark.createDataFrame(rows, "id long, k string, v double")


@pytest.mark.parametrize("accuracy", [100, 1000, 20000])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_quantiles_are_exact(hot, keys, accuracy):
    probs = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p9": 0.9, "hi": 1.0}
    got = scale.exact_quantiles(hot, keys, F.col("v"), probs, accuracy)
    args = ", ".join(f"percentile(v, {p}) as {n}" for n, p in probs.items())
    want = hot.groupBy(*keys).agg(*[F.expr(a) for a in args.replace("), ", ")|").replace("lo, ", "lo|").replace("q1, ", "q1|")
                                    .replace("m, ", "m|").replace("p9, ", "p9|").split("|")])
    for a, b in zip(rows_of(got), rows_of(want.where("m is not null"))):
        assert a[: len(keys)] == b[: len(keys)]
        assert a[len(keys):] == pytest.approx(b[len(keys):])


def test_quantiles_continuous(spark):
    df = spark.range(0, 200_000).select((F.rand(3) * 1000).alias("v")).cache()
    got = scale.exact_quantiles(df, [], F.col("v"), {"q": 0.333, "m": 0.5}, 5000).first()
    want = df.agg(F.expr("percentile(v, 0.333)"), F.expr("percentile(v, 0.5)")).first()
    assert tuple(got) == pytest.approx(tuple(want))


@pytest.mark.parametrize("parts", [1, 7])
def test_number_rows(hot, parts):
    got = scale.number_rows(hot.repartition(parts), [F.col("v").asc_nulls_first(), F.col("id")], "no").collect()
    order = sorted(got, key=lambda r: (r["v"] is not None, r["v"] or 0, r["id"]))
    assert [r["no"] for r in order] == list(range(1, len(got) + 1))


def test_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0, 3.0, None)], "v double")
    got = {r["v"]: r["rank"] for r in scale.average_ranks(df, "v", "rank").collect()}
    assert got == {1.0: 1.0, 2.0: 2.0, 3.0: 4.0}


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_hot_key_join(spark, hot, how):
    names = spark.createDataFrame([(" A ", 1), ("a", 2), ("k6", 3), ("zz", 4), (None, 5), ("  ", 6)], "name string, code int")
    got = safe_join(hot.withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k"))), names, "k", "name", how)
    plain = hot.withColumn("k", F.when(F.col("id") % 11 != 0, F.col("k")))
    fold = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    want = plain.withColumn("x", fold("k")).join(names.withColumn("y", fold("name")), F.col("x") == F.col("y"), how).drop("x", "y")
    assert rows_of(got) == rows_of(want.select(*got.columns))
    assert join_preview(plain, names, "k", "name", how).first()["output_rows"] == got.count()


def test_hot_keys_are_salted(hot):
    assert scale.hot_keys(hot, "k", 0.2) == ["a"]
    plan = scale.skew_join(hot, hot.select("k").distinct(), "k", "left")._jdf.queryExecution().toString()
    assert "_salt" in plan


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("parts", [1, 13])
def test_carry_over_block_borders(hot, direction, parts):
    got = clean.Carry("v", ("id",), ("k",), direction).apply(hot.repartition(parts)).collect()
    seen, want = {}, {}
    for r in sorted(hot.collect(), key=lambda r: r["id"], reverse=direction == "backward"):
        if r["v"] is not None:
            seen[r["k"]] = r["v"]
        want[r["id"]] = seen.get(r["k"])
    assert {r["id"]: r["v"] for r in got} == want


def test_settle_keeps_large_aggregates_as_plans(spark):
    small, is_small = scale.settle(spark.range(10).groupBy("id").count(), 10)
    assert is_small and small.count() == 10
    big, is_small = scale.settle(spark.range(11).groupBy("id").count(), 10)
    assert not is_small and big.count() == 11
