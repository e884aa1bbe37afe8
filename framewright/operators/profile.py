"""Column profiles: logical type, completeness, distribution, top values, spelling variants and dates.

The number of passes does not depend on the number of columns: one for the counted distinct values (each kind of column
reads its own), four over the numeric columns (moments, percentile sketch, bracket counts, fences) and one for repeated
rows. What reaches the driver is one row per column (ten for top values), never more.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framewright.functions.dates import DATE_SHAPE, parse_date
from framewright.functions.missing import PROFILE_WORDS, missing_in
from framewright.functions.numbers import (
    PLAIN_SYMBOLS, finite, half_up, percent, plain_text, sample_kurtosis, sample_skewness, to_number,
)
from framewright.functions.text import is_number, is_text, is_time
from framewright.operators.charts import bin_count
from framewright.operators.scale import exact_quantiles

# Words read as true or false, and column names that suggest an identifier.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0"]
EXPLICIT_WORDS = ["true", "false", "yes", "no"]
ID_NAME = "(?i)id|uuid|key|code|guid|ssn|identifier|token"
UUID_SHAPE = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
CODE_SHAPE = "^[a-z]{2,4}[-_]?[0-9]{2,8}$"

# How cells of a kind read.
GEO_VALUE = "(?i)^(usa|united states|uk|canada|germany|france|india|china|japan|brazil|california|texas|new york|london|tokyo|paris|north america|europe|asia)$"
ORDINAL_VALUE = "(?i)^(low|medium|high|critical|tier [1-5]|grade [a-f]|[1-5] stars?)$"
VALUE_KINDS = {"money": "[$€£¥₹]", "percent": "%", "geo": GEO_VALUE, "ordinal": ORDINAL_VALUE}

# Fixed value: how a cell of an identifier reads. A column is one if more than this share of its cells does.
ID_VALUE = "id|^[a-z0-9_-]{6,}$"
ID_SHARE = 0.8
#: From here on a double cannot tell whole numbers apart.
EXACT = 2**53
FACTS = """column string, position int, kind string, total long, missing long, valid long, distinct long, padded long,
 null_pct double, cardinality_pct double, type string, recommended string, confidence double, is_id boolean,
 is_high_cardinality boolean, top_value string, top_count long, dominant_pct double, is_constant boolean,
 is_near_constant boolean, variant_rows long, variant_groups long, sample string, min_day string, max_day string,
 range_days long, invalid_dates long, all_flag_words boolean, has_uuid boolean, all_codes boolean"""
NUMERIC = """column string, count long, min double, max double, mean double, median double, variance double, stddev double,
 q1 double, q3 double, iqr double, skewness double, kurtosis double, outliers long, outlier_pct double, z_outliers long,
 negatives long, over_100 long, over_130 long"""


def profiled_columns(df: DataFrame) -> list[str]:
    """Flat columns in order; nested ones are not profiled."""
    flat = lambda d: is_text(d) or is_number(d) or is_time(d) or isinstance(d, T.BooleanType)
    return [f.name for f in df.schema.fields if flat(f.dataType)]


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct trimmed values of every column with their count and how many were padded with blanks.

    Numbers are distinct in their own type; ``num`` reads them as doubles, and ``value`` shows those that a double would round.

    Columns of one kind (number, time, text) are unpivoted together and shuffled once by (column, value). Equal values
    are summed before the shuffle, so neither a frequent value nor a wide table makes a hot task; each kind reads only
    its own columns.
    """
    columns = columns or profiled_columns(df)
    parts = []
    is_whole = lambda d: isinstance(d, T.IntegralType)
    is_decimal = lambda d: isinstance(d, T.DecimalType)
    is_float = lambda d: is_number(d) and not is_whole(d) and not is_decimal(d)
    is_word = lambda d: not is_number(d) and not is_time(d)
    # numbers are told apart in their own type: a double would merge whole numbers from 2**53 on
    for kind, cast, test in (("number", "bigint", is_whole), ("number", "decimal", is_decimal), ("number", "double", is_float),
                             ("time", "timestamp_ntz", is_time), ("text", "string", is_word)):
        names = [n for n in columns if test(df.schema[n].dataType)]
        if not names:
            continue
        if cast == "decimal":
            cells = [F.regexp_replace(F.col(f"`{n}`").cast("string"), r"(\.\d*?)0+$|^$", "$1").alias(n) for n in names]
        else:
            cells = [F.col(f"`{n}`").cast(cast).alias(n) for n in names]
        long = df.select(*cells).unpivot([], names, "column", "v")
        flags = [n for n in names if isinstance(df.schema[n].dataType, T.BooleanType)]
        if kind == "text":
            trimmed = long.select("column", F.trim("v").alias("value"), (F.col("v") != F.trim("v")).alias("p"))
            counted = trimmed.groupBy("column", "value").agg(F.count("*").alias("n"), F.count_if("p").alias("padded"))
        else:
            v = F.when(~F.isnan("v"), F.col("v")) if cast == "double" else F.col("v")
            counted = long.select("column", v.alias("v")).groupBy("column", "v").agg(F.count("*").alias("n"))
            counted = counted.withColumn("padded", F.lit(0).cast("long"))
        text = {"string": F.col("value") if kind == "text" else None, "decimal": F.regexp_replace("v", r"\.$", "") if cast == "decimal" else None,
                "bigint": F.when(F.abs("v") >= EXACT, F.col("v").cast("string")) if cast == "bigint" else None}.get(cast)
        parts.append(counted.select(
            "column", F.when(F.col("column").isin(flags), "bool").otherwise(kind).alias("kind") if flags else F.lit(kind).alias("kind"),
            (text if text is not None else F.lit(None).cast("string")).alias("value"),
            (F.col("v").cast("double") if kind == "number" else F.lit(None).cast("double")).alias("num"),
            (F.col("v") if kind == "time" else F.lit(None).cast("timestamp_ntz")).alias("at"), "n", "padded",
        ))
    return reduce(lambda x, y: x.unionByName(y), parts)


FACT_SUMS = ("flag_n", "explicit_n", "flag_word_n", "plain_n", "number_n", "shaped_n", "dated_n", "uuid_n", "code_n", "id_n")


def _text_cells(counts: DataFrame) -> DataFrame:
    """Text values folded to lower case, one row per (column, folded value) with what its spellings look like."""
    n, value = F.col("n"), F.col("value")
    folded = F.lower(value)
    gone = F.coalesce(value.isNull() | folded.isin(["", *PROFILE_WORDS]), F.lit(False))
    day = parse_date(value)
    ok = ~F.col("gone")

    def rows(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.coalesce(test, F.lit(False)) & ok, n)), F.lit(0))

    shaped = value.rlike(DATE_SHAPE) & (F.col("day") > F.lit("1970-01-01").cast("timestamp_ntz"))
    dated = F.col("day").isNotNull() & (F.length(value) >= 6) & ~value.rlike("^[0-9]+$")
    marked = counts.where(F.col("kind").isin("text", "bool")).withColumns({"gone": gone, "folded": folded, "day": day})
    return marked.groupBy("column", "kind", "folded", "gone").agg(
        F.sum("n").alias("n"), F.sum("padded").alias("padded"), F.count("*").alias("spellings"),
        rows(folded.isin(BOOLEAN_WORDS)).alias("flag_n"),
        rows(folded.isin(EXPLICIT_WORDS) | (F.col("kind") == "bool")).alias("explicit_n"),
        rows(folded.isin([*BOOLEAN_WORDS, "y", "n"])).alias("flag_word_n"),
        rows(to_number(value, PLAIN_SYMBOLS).isNotNull()).alias("plain_n"), rows(to_number(value).isNotNull()).alias("number_n"),
        rows(shaped).alias("shaped_n"), rows(dated).alias("dated_n"), rows(folded.rlike(UUID_SHAPE)).alias("uuid_n"),
        rows(folded.rlike(CODE_SHAPE)).alias("code_n"), rows(folded.rlike(ID_VALUE)).alias("id_n"), F.min(F.when(ok, value)).alias("sample"),
        F.min(F.when(ok, F.col("day"))).alias("lo"), F.max(F.when(ok, F.col("day"))).alias("hi"),
    ).drop("folded")


def _typed_cells(counts: DataFrame) -> DataFrame:
    """Numbers and times in the shape of ``_text_cells``; every value is its own group already."""
    n, num, at = F.col("n"), F.col("num"), F.col("at")
    number, none = F.col("kind") == "number", F.lit(0).cast("long")
    ok = num.isNotNull() | at.isNotNull()
    flag = F.when(num.isin([0.0, 1.0]), n).otherwise(0)
    return counts.where(F.col("kind").isin("number", "time")).select(
        "column", "kind", (~ok).alias("gone"), "n", "padded", F.lit(1).cast("long").alias("spellings"), flag.alias("flag_n"),
        none.alias("explicit_n"), flag.alias("flag_word_n"), F.when(number & ok, n).otherwise(0).alias("plain_n"),
        F.when(number & ok, n).otherwise(0).alias("number_n"), F.when(~number & ok, n).otherwise(0).alias("shaped_n"),
        F.when(~number & ok, n).otherwise(0).alias("dated_n"), none.alias("uuid_n"), none.alias("code_n"), none.alias("id_n"),
        at.alias("lo"), at.alias("hi"),
    )


def _per_column(cells: DataFrame, sample: Column) -> DataFrame:
    ok = ~F.col("gone")
    live = F.when(ok, F.col("n"))
    return cells.groupBy("column", "kind").agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("missing"),
        F.coalesce(F.sum(F.when(ok, F.col("spellings"))), F.lit(0)).alias("distinct"), F.sum("padded").alias("padded"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FACT_SUMS], sample.alias("sample"),
        F.coalesce(F.sum(F.when(F.col("spellings") > 1, live)), F.lit(0)).alias("variant_rows"),
        F.count_if((F.col("spellings") > 1) & ok).alias("variant_groups"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
    )


def column_facts(counts: DataFrame, columns: list[str], tops: DataFrame | None = None) -> DataFrame:
    """One row per column from counted values: counts, logical type, flags, dominance, variants, dates.

    Numbers and times aggregate fixed-width values only; the text part is aggregated apart, so its strings slow nothing
    else down. ``tops`` are the top values when they are known already.
    """
    per = _per_column(_text_cells(counts), F.min("sample")).unionByName(
        _per_column(_typed_cells(counts), F.max(F.lit(None).cast("string")))
    )
    first = (tops if tops is not None else top_values(counts, 1)).where(F.col("rank") == 1)
    per = per.join(F.broadcast(first.select("column", F.col("value").alias("shown"), F.col("count").alias("top_n"))),
                   "column", "left")
    valid, distinct, total = F.col("valid"), F.col("distinct"), F.col("total")
    share = distinct / valid
    id_like = F.col("id_n") / valid > ID_SHARE
    logical = (
        F.when(valid == 0, "text")
        .when((F.col("flag_n") / valid > 0.95) & (valid > 3) & (F.col("explicit_n") > 0), "boolean")
        .when(F.col("plain_n") / valid > 0.85, "numeric")
        .when(F.col("shaped_n") / valid > 0.8, "datetime")
        .when((share > 0.95) & (valid > 10) & id_like, "id")
        .when((share < 0.4) | (distinct <= 25), "categorical")
        .otherwise("text")
    )
    looks_text = F.col("type").isin("text", "categorical") & (valid > 0)
    to_num, to_day = F.col("number_n") / valid, F.col("dated_n") / valid
    is_id = (F.col("column").rlike(ID_NAME) & (distinct > total * 0.7)) | ((distinct == total) & (total > 5))
    top_n = F.col("top_n")
    is_day = F.col("type") == "datetime"
    positions = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    return (
        per.withColumn("valid", total - F.col("missing"))
        .withColumn("type", logical)
        .select(
            "column", positions[F.col("column")].alias("position"), "kind", "total", "missing", "valid", "distinct", "padded",
            percent(F.col("missing"), total).alias("null_pct"), percent(distinct, total).alias("cardinality_pct"), "type",
            F.when(looks_text & (to_num >= 0.9), "numeric").when(looks_text & (to_day >= 0.85), "datetime").alias("recommended"),
            F.when(looks_text & (to_num >= 0.9), half_up(to_num * 100)).when(
                looks_text & (to_day >= 0.85), half_up(to_day * 100)).otherwise(100.0).alias("confidence"),
            is_id.alias("is_id"),
            ((distinct > 20) & (percent(distinct, total) > 80) & ~is_id).alias("is_high_cardinality"),
            F.col("shown").alias("top_value"), F.coalesce(top_n, F.lit(0)).cast("long").alias("top_count"),
            percent(F.coalesce(top_n, F.lit(0)), valid).alias("dominant_pct"), (distinct == 1).alias("is_constant"),
            ((percent(F.coalesce(top_n, F.lit(0)), valid) >= 95) & (distinct > 1)).alias("is_near_constant"),
            "variant_rows", "variant_groups", "sample",
            F.when(is_day, F.date_format("lo", "yyyy-MM-dd")).alias("min_day"),
            F.when(is_day, F.date_format("hi", "yyyy-MM-dd")).alias("max_day"),
            F.when(is_day, half_up((F.unix_micros(F.col("hi").cast("timestamp"))
                                    - F.unix_micros(F.col("lo").cast("timestamp"))) / 86_400_000_000).cast("long"))
            .alias("range_days"),
            F.when(is_day, valid - F.col("dated_n")).alias("invalid_dates"),
            (F.col("flag_word_n") == valid).alias("all_flag_words"), (F.col("uuid_n") > 0).alias("has_uuid"),
            ((F.col("code_n") == valid) & (valid > 0)).alias("all_codes"),
        )
    )


def value_shares(counts: DataFrame) -> DataFrame:
    """Per column the share of its filled cells that read as each kind of value, over all distinct values."""
    folded = F.lower(F.col("value"))
    filled = F.col("value").isNotNull() | F.col("num").isNotNull() | F.col("at").isNotNull()
    live = counts.where(filled & ~F.coalesce(folded.isin(["", *PROFILE_WORDS]), F.lit(False)))
    text = F.when(F.col("kind").isin("text", "bool"), F.trim("value"))
    return live.groupBy("column").agg(*[
        (F.sum(F.when(text.rlike(pattern), F.col("n")).otherwise(0)) / F.sum("n")).alias(f"share_{kind}") for kind, pattern in VALUE_KINDS.items()])


def shown(value: Column, num: Column, at: Column) -> Column:
    """A cell as display text."""
    return F.coalesce(value, plain_text(num), at.cast("string"))


def top_values(counts: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` values per column by count, ties by value. The rank limit is applied before the shuffle."""
    folded = F.lower(F.col("value"))
    filled = F.col("value").isNotNull() | F.col("num").isNotNull() | F.col("at").isNotNull()
    live = counts.where(filled & ~F.coalesce(folded.isin(["", *PROFILE_WORDS]), F.lit(False)))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), "num", "at", "value")
    ranked = live.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "column", F.col("rank").cast("long").alias("rank"), shown(F.col("value"), F.col("num"), F.col("at")).alias("value"),
        F.col("n").alias("count"),
    )


def case_variants(counts: DataFrame) -> DataFrame:
    """Values spelled in several cases: the most frequent spelling, how many spellings and rows."""
    text = counts.where(F.col("kind") == "text").withColumn("folded", F.lower("value"))
    text = text.where(F.col("folded").isNotNull() & ~F.col("folded").isin(["", *PROFILE_WORDS]))
    return text.groupBy("column", "folded").agg(
        F.count("*").alias("spellings"), F.sum("n").alias("rows"), F.min_by("value", F.struct(-F.col("n"), F.col("value")))
        .alias("standard"),
    ).where(F.col("spellings") > 1)


def numbers_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v) of the numeric reading of the named columns, finite values only."""
    picks = [
        (finite(F.col(f"`{n}`")) if is_number(df.schema[n].dataType) else to_number(F.col(f"`{n}`"))).alias(n)
        for n in columns
    ]
    return df.select(*picks).unpivot([], columns, "column", "v").where(F.col("v").isNotNull())


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments, quartiles, fences and outlier counts per numeric column, to three decimals."""
    long = numbers_long(df, columns)
    base = long.groupBy("column").agg(
        F.count("*").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"),
        F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("stddev"), F.skewness("v").alias("g1"),
        F.kurtosis("v").alias("g2"),
    )
    quart = exact_quantiles(long, ["column"], F.col("v"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    many = F.col("count") > 1
    whole = base.join(F.broadcast(quart), "column").select(
        "column", "count", "min", "max", half_up(F.col("mean"), 3).alias("mean"), half_up(F.col("median"), 3).alias("median"),
        F.when(many, half_up(F.col("variance"), 3)).otherwise(0.0).alias("variance"),
        F.when(many, half_up(F.col("stddev"), 3)).otherwise(0.0).alias("stddev"),
        half_up(F.col("q1"), 3).alias("q1"), half_up(F.col("q3"), 3).alias("q3"),
        half_up(sample_skewness(F.col("g1"), F.col("count")), 3).alias("skewness"),
        half_up(sample_kurtosis(F.col("g2"), F.col("count")), 3).alias("kurtosis"),
    ).withColumn("iqr", half_up(F.col("q3") - F.col("q1"), 3))
    rows = df.sparkSession.createDataFrame(whole.collect(), whole.schema)
    limits = rows.select("column", "mean", "stddev", (F.col("q1") - 1.5 * F.col("iqr")).alias("low"),
                         (F.col("q3") + 1.5 * F.col("iqr")).alias("high"))
    v = F.col("v")
    outside = long.join(F.broadcast(limits), "column").groupBy("column").agg(
        F.count_if((v < F.col("low")) | (v > F.col("high"))).alias("outliers"),
        F.count_if((F.col("stddev") > 0) & (F.abs((v - F.col("mean")) / F.nullif(F.col("stddev"), F.lit(0.0))) > 3))
        .alias("z_outliers"),
        F.count_if(v < 0).alias("negatives"), F.count_if(v > 100).alias("over_100"), F.count_if(v > 130).alias("over_130"),
    )
    return rows.join(F.broadcast(outside), "column").select(
        "column", "count", "min", "max", "mean", "median", "variance", "stddev", "q1", "q3", "iqr", "skewness", "kurtosis",
        "outliers", percent(F.col("outliers"), F.col("count")).alias("outlier_pct"), "z_outliers", "negatives", "over_100",
        "over_130",
    )


def numeric_histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Profile histogram (4 to 8 equal bins, empty ones kept) of every numeric column."""
    long = numbers_long(df, columns)
    facts = long.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    facts = facts.withColumn("bins", bin_count(F.col("n"), "profile"))
    span = (F.col("hi") - F.col("lo")) / F.col("bins")
    facts = facts.withColumn("width", F.when(span > 0, span).otherwise(1.0))
    facts = df.sparkSession.createDataFrame(facts.collect(), facts.schema)
    placed = long.join(F.broadcast(facts), "column").select(
        "column", F.least(F.floor((F.col("v") - F.col("lo")) / F.col("width")), F.col("bins") - 1).cast("long").alias("bin")
    )
    counts = placed.groupBy("column", "bin").agg(F.count("*").alias("records"))
    frame = facts.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("bins") - 1).cast("long"))))
    top = F.when(F.col("bin") == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (F.col("bin") + 1) * F.col("width"))
    return frame.join(F.broadcast(counts), ["column", "bin"], "left").select(
        "column", "bin", half_up(F.col("lo") + F.col("bin") * F.col("width"), 2).alias("bin_min"),
        half_up(top, 2).alias("bin_max"), F.coalesce("records", F.lit(0)).cast("long").alias("records"),
    )


class Profile:
    """The profile of a table: bounded row lists computed on first use, offered as DataFrames."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.names = profiled_columns(df)

    @cached_property
    def _counted(self) -> tuple[list, list, list]:
        counts = value_counts(self.df, self.names).persist()
        try:
            best = top_values(counts)
            tops = [tuple(r) for r in best.collect()]
            shares = [tuple(r) for r in value_shares(counts).collect()]
            known = self.df.sparkSession.createDataFrame(tops, best.schema)
            facts = [r.asDict() for r in column_facts(counts, self.names, known).collect()]
        finally:
            counts.unpersist()
        return sorted(facts, key=lambda r: r["position"]), tops, shares

    @property
    def facts_rows(self) -> list[dict]:
        return self._counted[0]

    @cached_property
    def numeric_rows(self) -> list:
        columns = self.of_type("numeric")
        return [tuple(r) for r in numeric_profile(self.df, columns).collect()] if columns else []

    @cached_property
    def duplicates(self) -> int:
        return duplicate_count(self.df).first()[0]

    @property
    def total(self) -> int:
        return self.facts_rows[0]["total"] if self.facts_rows else 0

    def facts(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.facts_rows, FACTS)

    def numeric(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self.numeric_rows, NUMERIC)

    def top(self) -> DataFrame:
        return self.df.sparkSession.createDataFrame(self._counted[1], "column string, rank long, value string, count long")

    def shares(self) -> DataFrame:
        """Per column the share of cells of each kind of value."""
        return self.df.sparkSession.createDataFrame(self._counted[2], "column string" + "".join(f", share_{k} double" for k in VALUE_KINDS))

    def columns(self) -> DataFrame:
        """Facts with the numeric part joined on: one row per column."""
        return self.facts().join(F.broadcast(self.numeric()), "column", "left")

    def of_type(self, *types: str) -> list[str]:
        return [r["column"] for r in self.facts_rows if r["type"] in types]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each repeated row; copies are counted map-side."""
    return df.groupBy(*[F.col(f"`{c}`") for c in profiled_columns(df)]).agg(F.count("*").alias("_copies")).agg(
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).cast("long").alias("duplicates")
    )


def profile(df: DataFrame) -> Profile:
    """Profile every flat column; each part runs when it is first asked for."""
    return Profile(df)


def missing_counts(df: DataFrame, level: str = "profile") -> DataFrame:
    """Missing cells per column at one level, in one pass without a shuffle of rows."""
    flat = profiled_columns(df)
    flags = df.select(*[missing_in(df, n, level).alias(n) for n in flat])
    wide = flags.agg(*[F.count_if(F.col(f"`{n}`")).alias(n) for n in flat], F.count("*").alias("_total"))
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("missing")) for n in flat])
    return wide.select("_total", F.inline(rows)).select(
        "column", "missing", F.col("_total").alias("total"), percent(F.col("missing"), F.col("_total")).alias("missing_pct")
    )


def dataset_stats(p: Profile, score: float | None = None) -> DataFrame:
    """Rows, columns, missing cells (basic level), duplicates and the score of a table."""
    missing = missing_counts(p.df, "basic").agg(F.sum("missing").alias("m")).scalar()
    return p.df.sparkSession.range(1).select(
        F.lit(p.total).cast("long").alias("rows"), F.lit(len(p.facts_rows)).cast("long").alias("columns"),
        missing.cast("long").alias("missing_cells"), F.lit(p.duplicates).cast("long").alias("duplicate_rows"),
        F.lit(score).cast("double").alias("score"),
    )
