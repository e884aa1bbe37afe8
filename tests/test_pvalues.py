"""Tail probabilities against textbook values and identities."""

import math

import pytest

from framewright.functions import pvalues as pv


@pytest.mark.parametrize("t, df, p", [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (12.706, 1, 0.05), (2.845, 20, 0.01)])
def test_t(t, df, p):
    assert pv.f_tail(t * t, 1.0, df) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize("f, a, b, p", [(3.885, 2, 12, 0.05), (4.103, 2, 10, 0.05), (1.0, 5, 5, 0.5)])
def test_f(f, a, b, p):
    assert pv.f_tail(f, a, b) == pytest.approx(p, abs=2e-4)


@pytest.mark.parametrize("x, df, p", [(3.841, 1, 0.05), (9.488, 4, 0.05), (23.209, 10, 0.01), (2.0, 2, math.exp(-1))])
def test_chi2(x, df, p):
    assert pv.upper_gamma(df / 2, x / 2) == pytest.approx(p, abs=2e-4)


def test_limits():
    assert pv.f_tail(0.0, 3, 3) == 1.0
    assert pv.upper_gamma(1.0, 0.0) == 1.0
    assert pv.incomplete_beta(2, 3, 1.0) == 1.0


def test_chi_square_matches_spark_ml(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import ChiSquareTest

    from framewright.operators.stats import chi_square

    rows = [(i % 2, (i // 2) % 3 if i % 5 else 0) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int")
    ours = chi_square(df, "a", "b").first()
    theirs = ChiSquareTest.test(VectorAssembler(inputCols=["b"], outputCol="x").transform(df), "x", "a").first()
    assert ours["chi_square"] == pytest.approx(theirs["statistics"][0], abs=1e-3)
    assert ours["p_value"] == pytest.approx(theirs["pValues"][0], abs=1e-5)
    assert ours["df"] == theirs["degreesOfFreedom"][0]
