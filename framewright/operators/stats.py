"""Descriptive statistics, hypothesis tests, correlation, regression and anomalies.

Every test is an aggregate of the rows followed by a formula on a handful of aggregated rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from framewright.functions import pvalues as pv
from framewright.functions.numbers import half_up, number_of, ratio, sample_kurtosis, sample_skewness
from framewright.functions.text import is_number
from framewright.operators.aggregate import label
from framewright.operators.profile import numbers_long
from framewright.operators.scale import average_ranks, exact_quantiles, join_keys, one_row, running_total
from framewright.session import ensure_checkpoint_dir

PAIR_CHUNK = 400


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, nulls, centre, spread, shape, quartiles and confidence intervals, one row per numeric column."""
    columns = columns or numeric_columns(df)
    long = numbers_long(df, columns)
    total = df.agg(F.count("*").alias("n")).scalar()
    base = long.groupBy("column").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("variance"),
        F.stddev_samp("v").alias("sd"), F.min("v").alias("min"), F.max("v").alias("max"), F.skewness("v").alias("g1"),
        F.kurtosis("v").alias("g2"),
    )
    counts = long.groupBy("column", "v").agg(F.count("*").alias("k"))
    modes = counts.groupBy("column").agg(F.min(F.struct(-F.col("k"), F.col("v"))).alias("m")).select(
        "column", F.col("m.v").alias("mode")
    )
    quart = exact_quantiles(long, ["column"], F.col("v"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    rows = base.join(F.broadcast(quart), "column").join(F.broadcast(modes), "column")
    error = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    out = {"mean": "mean", "median": "median", "mode": "mode", "std_dev": "sd", "variance": "variance", "min": "min", "max": "max",
           "q1": "q1", "q3": "q3"}
    cols = [F.col("column"), F.col("n").alias("count"), (total - F.col("n")).alias("nulls")]
    cols += [half_up(F.col(c), 2).alias(n) for n, c in out.items()]
    cols += [
        half_up(F.col("max") - F.col("min"), 2).alias("range"), half_up(F.col("q3") - F.col("q1"), 2).alias("iqr"),
        half_up(sample_skewness(F.col("g1"), F.col("n")), 2).alias("skewness"),
        half_up(sample_kurtosis(F.col("g2"), F.col("n")), 2).alias("kurtosis"), half_up(error, 3).alias("std_error"),
    ]
    for level, z in ((90, 1.645), (95, 1.960), (99, 2.576)):
        cols.append(half_up(F.col("mean") - z * error, 2).alias(f"ci{level}_low"))
        cols.append(half_up(F.col("mean") + z * error, 2).alias(f"ci{level}_high"))
    return rows.select(*cols)


def group_moments(df: DataFrame, group: str, metric: str, least: int = 2) -> DataFrame:
    """n, mean, sample variance and shape per group with at least ``least`` values."""
    src = df.select(label(df, group).alias("grp"), number_of(df, metric).alias("v")).where(F.col("v").isNotNull())
    return src.groupBy("grp").agg(
        F.count("*").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("var"),
        F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2"),
    ).where(F.col("n") >= least)


def _pair(df: DataFrame, group: str, metric: str, first: str, second: str) -> DataFrame:
    """Moments of two groups side by side, one row."""
    both = df.where(F.trim(F.col(f"`{group}`").cast("string")).isin(first, second))
    rows = group_moments(both, group, metric, 3)
    picks = []
    for tag, name in (("1", first), ("2", second)):
        for c in ("n", "mean", "var", "g1", "g2"):
            picks.append(F.max(F.when(F.col("grp") == name, F.col(c))).alias(c + tag))
    return rows.agg(*picks).where(F.col("n1").isNotNull() & F.col("n2").isNotNull())


def assumptions(df: DataFrame, group: str, metric: str, first: str, second: str) -> DataFrame:
    """Sample size, normality by shape and equality of variances for two groups."""
    row = _pair(df, group, metric, first, second)
    least = F.least("n1", "n2")
    shape = [F.abs(sample_skewness(F.col(f"g1{i}"), F.col(f"n{i}"))) < 1 for i in (1, 2)]
    shape += [F.abs(sample_kurtosis(F.col(f"g2{i}"), F.col(f"n{i}"))) < 2 for i in (1, 2)]
    normal = shape[0] & shape[1] & shape[2] & shape[3]
    v1, v2 = (F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)) for c in ("var1", "var2"))
    spread = F.greatest(v1, v2) / F.least(v1, v2)
    checks = F.array(
        F.struct(F.lit("sample_size").alias("assumption"),
                 F.when(least >= 30, "PASSED").when(least >= 10, "WARNING").otherwise("VIOLATED").alias("status"),
                 least.cast("double").alias("evidence")),
        F.struct(F.lit("normality").alias("assumption"), F.when(normal, "PASSED").otherwise("WARNING").alias("status"),
                 half_up(F.abs(sample_skewness(F.col("g11"), F.col("n1"))), 2).alias("evidence")),
        F.struct(F.lit("equal_variance").alias("assumption"),
                 F.when(spread < 2, "PASSED").otherwise("WARNING").alias("status"), half_up(spread, 2).alias("evidence")),
    )
    return row.select(F.inline(checks))


def band(value: Column, *steps: tuple[float, str], below: str) -> Column:
    """The name of the highest step reached."""
    out = F.lit(below)
    for limit, name in sorted(steps):
        out = F.when(value >= limit, name).otherwise(out)
    return out


def welch_t(df: DataFrame, group: str, metric: str, first: str, second: str, alpha: float = 0.05,
            comparisons: int = 1) -> DataFrame:
    """Welch's two-sample t-test: t, degrees of freedom, p-values, Cohen's d and 95 % interval of the difference.

    ``comparisons`` above 1 applies the Bonferroni correction to ``alpha``.
    """
    c = F.col
    e1, e2 = c("var1") / c("n1"), c("var2") / c("n2")
    error = F.sqrt(e1 + e2)
    gap = c("mean1") - c("mean2")
    free = F.pow(e1 + e2, F.lit(2)) / (F.pow(e1, F.lit(2)) / (c("n1") - 1) + F.pow(e2, F.lit(2)) / (c("n2") - 1))
    pooled = F.sqrt(((c("n1") - 1) * c("var1") + (c("n2") - 1) * c("var2")) / (c("n1") + c("n2") - 2))
    row = _pair(df, group, metric, first, second).withColumns({
        "t": F.coalesce(ratio(gap, error), F.lit(0.0)), "d": F.coalesce(F.abs(ratio(gap, pooled)), F.lit(0.0)),
        "df": F.greatest(F.lit(1.0), half_up(F.coalesce(free, (c("n1") + c("n2") - 2).cast("double")))),
        "gap": gap, "error": error,
    })
    exact = row.withColumn("p", pv.t_exact("t", "df"))
    level = alpha / comparisons
    return exact.select(
        F.lit(first).alias("group1"), F.lit(second).alias("group2"), "n1", "n2", half_up(c("mean1"), 2).alias("mean1"),
        half_up(c("mean2"), 2).alias("mean2"), half_up(c("t"), 3).alias("t_statistic"), c("df").cast("long").alias("df"),
        half_up(pv.t_approx(c("t")), 4).alias("p_approx"), half_up(c("p"), 6).alias("p_value"),
        (c("p") < level).alias("is_significant"), F.lit(level).alias("alpha"), half_up(c("d"), 3).alias("cohens_d"),
        band(c("d"), (0.8, "Large"), (0.5, "Medium"), (0.2, "Small"), below="Negligible").alias("effect"),
        half_up(c("gap") - 1.96 * c("error"), 2).alias("ci_low"), half_up(c("gap") + 1.96 * c("error"), 2).alias("ci_high"),
    )


def anova(df: DataFrame, group: str, metric: str, alpha: float = 0.05, comparisons: int = 1) -> DataFrame:
    """One-way analysis of variance from per-group n, mean and variance."""
    groups = group_moments(df, group, metric, 2)
    facts = groups.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    rows = groups.withColumn("_f", one_row(facts))
    sums = rows.agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("_f.grand"), F.lit(2))).alias("ssb"),
        F.sum(F.col("var") * (F.col("n") - 1)).alias("ssw"),
    ).where(F.col("groups") >= 2)
    c = F.col
    sums = sums.withColumns({"df1": (c("groups") - 1).cast("double"), "df2": (c("n") - c("groups")).cast("double")})
    sums = sums.withColumn("f", F.coalesce(ratio(c("ssb") / c("df1"), c("ssw") / F.nullif(c("df2"), F.lit(0.0))), F.lit(0.0)))
    eta = F.coalesce(ratio(c("ssb"), c("ssb") + c("ssw")), F.lit(0.0))
    exact = sums.withColumn("p", pv.f_exact("f", "df1", "df2"))
    return exact.select(
        "groups", "n", half_up(c("ssb"), 2).alias("ss_between"), half_up(c("ssw"), 2).alias("ss_within"),
        half_up(c("f"), 3).alias("f_statistic"), c("df1").cast("long").alias("df_between"),
        c("df2").cast("long").alias("df_within"), half_up(pv.f_approx(c("f"), c("df1"), c("df2")), 4).alias("p_approx"),
        half_up(c("p"), 6).alias("p_value"), (c("p") < alpha / comparisons).alias("is_significant"),
        half_up(eta, 3).alias("eta_squared"), band(eta, (0.14, "Large"), (0.06, "Medium"), below="Small").alias("effect"),
    )


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Observed cells of two categorical columns with their margins, blanks left out; absent cells are zero."""
    src = df.select(label(df, rows).alias("r"), label(df, columns).alias("c")).where("r <> '(Empty)' and c <> '(Empty)'")
    seen = src.groupBy("r", "c").agg(F.count("*").alias("observed"))
    r_sum = seen.groupBy("r").agg(F.sum("observed").alias("row_total"))
    c_sum = seen.groupBy("c").agg(F.sum("observed").alias("column_total"))
    return seen.join(r_sum, "r").join(c_sum, "c")


def _small_cells(r_sum: DataFrame, c_sum: DataFrame, total: Column) -> Column:
    """Number of cells of the full grid with an expected count below 5, without building the grid.

    A cell of row total r is small when its column total lies below 5 * n / r. Both margins are laid on one axis and the
    columns below each limit are a running count.
    """
    limits = r_sum.select((5.0 * total / F.col("row_total")).alias("at"), F.lit(0).alias("kind")).groupBy("at", "kind").agg(
        F.count("*").alias("rows"))
    totals = c_sum.select(F.col("column_total").cast("double").alias("at"), F.lit(1).alias("kind")).groupBy("at", "kind").agg(
        F.count("*").alias("columns"))
    axis = limits.withColumn("columns", F.lit(0).cast("long")).unionByName(totals.withColumn("rows", F.lit(0).cast("long")))
    below = running_total(axis, [], [F.col("at"), F.col("kind")], F.col("columns"), "below")
    return below.agg(F.coalesce(F.sum(F.col("rows") * F.col("below")), F.lit(0)).alias("small")).scalar()


def chi_square(df: DataFrame, rows: str, columns: str, alpha: float = 0.05, comparisons: int = 1) -> DataFrame:
    """Pearson's test of independence with Cramer's V and the expected-count check.

    Only observed cells are visited: the empty ones add their expected counts, which is what the observed ones leave of n.
    """
    c = F.col
    seen = contingency(df, rows, columns)
    r_sum = seen.groupBy("r").agg(F.sum("observed").alias("row_total"))
    c_sum = seen.groupBy("c").agg(F.sum("observed").alias("column_total"))
    total = seen.agg(F.sum("observed").alias("t")).scalar()
    expected = c("row_total") * c("column_total") / total
    gap = F.pow(c("observed") - expected, F.lit(2)) / expected
    sums = seen.agg(F.sum(gap).alias("seen_part"), F.sum(expected).alias("seen_expected"), F.sum("observed").alias("n"))
    sums = sums.withColumns({
        "nr": r_sum.agg(F.count("*").alias("n")).scalar(), "nc": c_sum.agg(F.count("*").alias("n")).scalar(),
        "chi2": c("seen_part") + c("n") - c("seen_expected"), "small": _small_cells(r_sum, c_sum, total),
    }).where("nr >= 2 and nc >= 2")
    sums = sums.withColumns({"df": ((c("nr") - 1) * (c("nc") - 1)).cast("double"), "cells": c("nr") * c("nc")})
    v = F.sqrt(c("chi2") / (c("n") * F.least(c("nr") - 1, c("nc") - 1)))
    exact = sums.withColumn("p", pv.chi2_exact("chi2", "df"))
    return exact.select(
        half_up(c("chi2"), 3).alias("chi_square"), c("df").cast("long").alias("df"), "n",
        half_up(pv.chi2_approx(c("chi2"), c("df")), 4).alias("p_approx"), half_up(c("p"), 6).alias("p_value"),
        (c("p") < alpha / comparisons).alias("is_significant"), half_up(v, 3).alias("cramers_v"),
        band(v, (0.35, "Strong"), (0.15, "Moderate"), below="Weak").alias("effect"), c("small").alias("small_cells"),
        F.when(c("small") == 0, "PASSED").when(c("small") / c("cells") < 0.2, "WARNING").otherwise("VIOLATED").alias("expected_check"),
    )


def mann_whitney(df: DataFrame, group: str, metric: str, first: str, second: str, alpha: float = 0.05,
                 comparisons: int = 1) -> DataFrame:
    """Rank-sum test with average ranks on ties: U, z, p, rank-biserial correlation, medians and spreads."""
    name = F.trim(F.col(f"`{group}`").cast("string"))
    src = df.select(name.alias("grp"), number_of(df, metric).alias("v")).where(
        F.col("grp").isin(first, second) & F.col("v").isNotNull()
    )
    ranks = average_ranks(src.select("v"), "v", "rank").drop("n")
    counts = src.groupBy("grp", "v").agg(F.count("*").alias("k"))
    sums = counts.join(ranks, "v").groupBy("grp").agg(
        F.sum(F.col("rank") * F.col("k")).alias("rank_sum"), F.sum("k").alias("n")
    )
    quart = exact_quantiles(src, ["grp"], F.col("v"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    sums = join_keys(sums, quart, ["grp"])
    picks = []
    for tag, value in (("1", first), ("2", second)):
        for col in ("rank_sum", "n", "q1", "median", "q3"):
            picks.append(F.max(F.when(F.col("grp") == value, F.col(col))).alias(col + tag))
    c = F.col
    row = sums.agg(*picks).where("n1 >= 3 and n2 >= 3")
    u1 = c("rank_sum1") - c("n1") * (c("n1") + 1) / 2.0
    pairs = c("n1").cast("double") * c("n2")
    row = row.withColumn("u", F.least(u1, pairs - u1)).withColumn(
        "z", (c("u") - pairs / 2) / F.sqrt(pairs * (c("n1") + c("n2") + 1) / 12)
    )
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), pv.normal_two_sided(c("z"))))
    biserial = 1 - 2 * c("u") / pairs
    return row.select(
        "n1", "n2", half_up(c("rank_sum1"), 1).alias("rank_sum1"), half_up(c("rank_sum2"), 1).alias("rank_sum2"),
        half_up(c("u"), 1).alias("u_statistic"), half_up(c("z"), 3).alias("z"), half_up(p, 4).alias("p_approx"),
        (p < alpha / comparisons).alias("is_significant"), half_up(biserial, 3).alias("rank_biserial"),
        band(F.abs(biserial), (0.5, "Large"), (0.3, "Medium"), below="Small").alias("effect"),
        half_up(c("median1"), 2).alias("median1"), half_up(c("median2"), 2).alias("median2"),
        half_up(c("q31") - c("q11"), 2).alias("iqr1"), half_up(c("q32") - c("q12"), 2).alias("iqr2"),
    )


def _labelled(pairs: DataFrame) -> DataFrame:
    """Strength, direction and p-values of correlation pairs ``column_a, column_b, r, n``."""
    c = F.col
    size = F.abs(c("r"))
    free = (c("n") - 2).cast("double")
    rows = pairs.where("n >= 3").withColumn("r", half_up(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)), 3))
    t = F.when(size < 1, c("r") * F.sqrt(free) / F.sqrt(1 - c("r") * c("r")))
    rows = rows.withColumns({"t": t, "df": free})
    exact = rows.withColumn("p", F.when(size >= 1, 0.0).otherwise(pv.t_exact("t", "df")))
    return exact.select(
        "column_a", "column_b", "r", "n",
        band(size, (0.8, "Very Strong"), (0.6, "Strong"), (0.4, "Moderate"), (0.2, "Weak"), below="Very Weak").alias("strength"),
        F.when(c("r") > 0.05, "positive").when(c("r") < -0.05, "negative").otherwise("none").alias("direction"),
        half_up(c("p"), 6).alias("p_value"),
    )


def pearson_pairs(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pairwise-complete Pearson correlation of the named pairs, many pairs per pass over the data."""
    out = None
    for start in range(0, len(pairs), PAIR_CHUNK):
        chunk = pairs[start: start + PAIR_CHUNK]
        aggs = []
        for i, (a, b) in enumerate(chunk):
            x, y = number_of(df, a), number_of(df, b)
            both = x.isNotNull() & y.isNotNull()
            aggs += [F.corr(F.when(both, x), F.when(both, y)).alias(f"r{i}"), F.count_if(both).alias(f"n{i}")]
        rows = F.array(*[
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, (a, b) in enumerate(chunk)
        ])
        part = df.agg(*aggs).select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def corr_pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair."""
    return _labelled(pearson_pairs(df, list(combinations(columns or numeric_columns(df), 2))))


def corr_spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spearman correlation of every pair: the Pearson correlation of average ranks over pairwise-complete rows.

    All pairs go through the same passes: value pairs are counted in long form, one range-split running total ranks the
    values of every pair and side (a pair's own rows only, so missing cells of other columns change nothing), and the
    correlations come from weighted sums. The number of passes does not grow with the number of columns.
    """
    names = columns or numeric_columns(df)
    pairs = list(combinations(names, 2))
    if not pairs:
        return _labelled(df.sparkSession.createDataFrame([], "column_a string, column_b string, r double, n long"))
    src = df.select(*[number_of(df, c).alias(f"v{i}") for i, c in enumerate(names)])
    at = {c: F.col(f"v{i}") for i, c in enumerate(names)}
    long = F.array(*[F.struct(F.lit(i).alias("pair"), at[a].alias("x"), at[b].alias("y")) for i, (a, b) in enumerate(pairs)])
    met = src.select(F.inline(F.filter(long, lambda p: p["x"].isNotNull() & p["y"].isNotNull())))
    ensure_checkpoint_dir(df.sparkSession)
    cells = met.groupBy("pair", "x", "y").agg(F.count("*").alias("k")).checkpoint()
    sides = F.array(F.struct(F.lit("x").alias("side"), F.col("x").alias("v")), F.struct(F.lit("y").alias("side"), F.col("y").alias("v")))
    counts = cells.select("pair", "k", F.inline(sides)).groupBy("pair", "side", "v").agg(F.sum("k").alias("n"))
    up_to = running_total(counts, ["pair", "side"], [F.col("v").asc()], F.col("n"), "upto")
    ranks = up_to.select("pair", "side", "v", (F.col("upto") - (F.col("n") - 1) / 2.0).alias("rank"))
    rank = lambda side: ranks.where(F.col("side") == side).select("pair", F.col("v").alias(side), F.col("rank").alias(f"r{side}"))
    size = cells.groupBy("pair").agg(F.sum("k").alias("rows"))
    ranked = cells.join(rank("x"), ["pair", "x"]).join(rank("y"), ["pair", "y"]).join(F.broadcast(size), "pair")
    middle = (F.col("rows") + 1) / 2.0
    dx, dy, k = F.col("rx") - middle, F.col("ry") - middle, F.col("k")
    sums = ranked.groupBy("pair").agg(
        (F.sum(dx * dy * k) / F.sqrt(F.nullif(F.sum(dx * dx * k) * F.sum(dy * dy * k), F.lit(0.0)))).alias("r"), F.sum("k").alias("n"))
    table = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, column_a string, column_b string")
    return _labelled(table.join(sums, "pair").select("column_a", "column_b", "r", "n"))


def corr_strong(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.4) -> DataFrame:
    """Pairs at or above a threshold of absolute correlation."""
    return corr_pearson(df, columns).where(F.abs("r") >= threshold)


def corr_target(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """Correlation of every other numeric column with one target, strongest first."""
    others = [c for c in (columns or numeric_columns(df)) if c != target]
    rows = _labelled(pearson_pairs(df, [(c, target) for c in others]))
    return rows.orderBy(F.abs("r").desc(), "column_a")


def bivariate(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation, slope, intercept, fit and rows whose deviations from the means have opposite signs."""
    src = df.select(number_of(df, x).alias("x"), number_of(df, y).alias("y")).where("x is not null and y is not null")
    facts = one_row(src.agg(F.avg("x").alias("mx"), F.avg("y").alias("my")))
    rows = src.withColumn("_m", facts)
    out = rows.agg(
        F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"),
        F.count_if((F.col("x") - F.col("_m.mx")) * (F.col("y") - F.col("_m.my")) < 0).alias("opposite"),
    )
    return out.select(
        "n", half_up(F.col("r"), 3).alias("r"), half_up(F.col("r2"), 4).alias("r2"), half_up(F.col("slope"), 4).alias("slope"),
        half_up(F.col("intercept"), 2).alias("intercept"), "opposite",
    )


def fitted(df: DataFrame, x: str, y: str, keep: list[str]) -> DataFrame:
    """Predicted value and residual of every row by the least-squares line."""
    src = df.select(*[F.col(f"`{k}`") for k in keep], number_of(df, x).alias("x"), number_of(df, y).alias("y"))
    src = src.where("x is not null and y is not null")
    line = one_row(src.agg(F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b")))
    rows = src.withColumn("_l", line).withColumn("_p", F.col("_l.a") * F.col("x") + F.col("_l.b"))
    return rows.select(
        *keep, "x", "y", half_up(F.col("_p"), 2).alias("predicted"), half_up(F.col("y") - F.col("_p"), 2).alias("residual")
    )


def anomalies(df: DataFrame, key: list[str], columns: list[str] | None = None, top: int | None = None) -> DataFrame:
    """All values outside the IQR fences with z score, method and extremeness, or the ``top`` furthest."""
    columns = columns or [c for c in numeric_columns(df) if c not in key]
    long = df.select(*[F.col(f"`{k}`") for k in key], *[number_of(df, c).alias(c) for c in columns]).unpivot(
        key, columns, "column", "value"
    ).where(F.col("value").isNotNull())
    facts = long.groupBy("column").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    quart = exact_quantiles(long, ["column"], F.col("value"), {"q1": 0.25, "q3": 0.75})
    limits = facts.join(F.broadcast(quart), "column")
    rows = long.join(F.broadcast(limits), "column")
    c = F.col
    iqr = c("q3") - c("q1")
    z = F.coalesce(F.abs(ratio(c("value") - c("m"), c("s"))), F.lit(0.0))
    out = rows.where((c("value") < c("q1") - 1.5 * iqr) | (c("value") > c("q3") + 1.5 * iqr)).select(
        *key, "column", "value", half_up(z, 2).alias("score"), F.when(z > 3, "ZSCORE").otherwise("IQR").alias("method"),
        ((c("value") > c("q3") + 3 * iqr) | (z > 3.5)).alias("is_extreme"),
        F.when(c("value") > c("q3") + 1.5 * iqr, "HIGH").otherwise("LOW").alias("side"),
    )
    if top is None:
        return out
    return out.orderBy(c("score").desc(), "column", *key).limit(top)


def largest_groups(df: DataFrame, group: str, top: int = 2) -> list[str]:
    """Names of the largest groups, at most ``top`` values."""
    rows = df.groupBy(label(df, group).alias("g")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "g").limit(top)
    return [r[0] for r in rows.collect()]


def compare_largest(df: DataFrame, group: str, metric: str, alpha: float = 0.05) -> DataFrame:
    """Welch's test between the two largest groups."""
    first, second = largest_groups(df, group)
    return welch_t(df, group, metric, first, second, alpha)


def test_by_groups(df: DataFrame, group: str, metric: str, alpha: float = 0.05) -> DataFrame:
    """Two groups of three or more rows: t-test; more groups: analysis of variance. Statistic, p and verdict."""
    groups = group_moments(df, group, metric, 3).orderBy("grp").limit(3).select("grp").collect()
    if len(groups) < 2:
        raise ValueError("the test needs two groups of at least three values")
    if len(groups) == 2:
        out = welch_t(df, group, metric, groups[0][0], groups[1][0], alpha)
        return out.select(F.lit("welch_t").alias("test"), F.col("t_statistic").alias("statistic"), "p_approx", "p_value", "is_significant")
    out = anova(df, group, metric, alpha)
    return out.select(F.lit("anova").alias("test"), F.col("f_statistic").alias("statistic"), "p_approx", "p_value", "is_significant")


test_by_groups.__test__ = False
