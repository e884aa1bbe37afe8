"""Equi joins on a normalised key, their hazard report and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from framewright.functions.numbers import half_up
from framewright.functions.text import INTEGRAL, key_text
from framewright.operators.scale import skew_join


def key_pair(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> tuple[Column, Column]:
    """Comparable key columns of the two sides.

    Equal integral types stay raw. Anything else compares as trimmed lower-case text, whole numbers without decimals.
    """
    lt, rt = left.schema[left_key].dataType, right.schema[right_key].dataType
    if isinstance(lt, INTEGRAL) and isinstance(rt, INTEGRAL):
        return F.col(f"`{left_key}`").cast("long"), F.col(f"`{right_key}`").cast("long")
    if isinstance(lt, (T.DateType, T.TimestampType, T.TimestampNTZType)) and lt == rt:
        return F.col(f"`{left_key}`"), F.col(f"`{right_key}`")
    return key_text(F.col(f"`{left_key}`"), lt), key_text(F.col(f"`{right_key}`"), rt)


def safe_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    prefixes: tuple[str, str] = ("left", "right"),
    hot: list | None = None,
) -> DataFrame:
    """INNER, LEFT, RIGHT or FULL join on one key per side.

    Blank keys never match but their rows stay in outer joins. Equal-named columns other than the key get the two
    prefixes; an equal-named key is kept once, filled from whichever side has it. Inner, left and right joins salt
    hot keys, measured by one pass over the key column unless given as ``hot`` (``[]`` for a side known to be even); a
    full join is the left join plus the right rows without a partner.
    """
    lk, rk = key_pair(left, left_key, right, right_key)
    shared = {c.lower() for c in left.columns} & {c.lower() for c in right.columns}  # names meet whatever their case
    one_key = left_key.lower() == right_key.lower()
    l_names = {c: f"{prefixes[0]}_{c}" if c.lower() in shared and not (one_key and c == left_key) else c for c in left.columns}
    r_names = {c: f"{prefixes[1]}_{c}" if c.lower() in shared else c for c in right.columns}
    l_side = left.select(lk.alias("_key"), *[F.col(f"`{c}`").alias(n) for c, n in l_names.items()])
    r_side = right.select(rk.alias("_key"), *[F.col(f"`{c}`").alias(n) for c, n in r_names.items()])
    if how == "full":
        kept = skew_join(l_side, r_side, "_key", "left", hot=hot)
        known = l_side.where(F.col("_key").isNotNull()).select("_key").distinct()
        alone = r_side.join(known, "_key", "left_anti")
        joined = kept.unionByName(alone, allowMissingColumns=True)
    else:
        joined = skew_join(l_side, r_side, "_key", how, hot=hot)
    out = []
    for c, n in l_names.items():
        column = F.col(f"`{n}`")
        if one_key and c == left_key:
            column = F.coalesce(column, F.col(f"`{r_names[right_key]}`"))
        out.append(column.alias(n))
    out += [F.col(f"`{n}`") for c, n in r_names.items() if not (one_key and c == right_key)]
    return joined.select(*out)


def key_counts(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows per key on both sides: the full join of two small count tables, ``_key, l, r``."""
    lk, rk = key_pair(left, left_key, right, right_key)
    l_counts = left.select(lk.alias("_key")).where(F.col("_key").isNotNull()).groupBy("_key").agg(F.count("*").alias("l"))
    r_counts = right.select(rk.alias("_key")).where(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.count("*").alias("r")
    )
    return l_counts.join(r_counts, "_key", "full").na.fill(0, ["l", "r"])


def join_preview(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Exact size and hazards of a join without running it."""
    counts = key_counts(left, right, left_key, right_key).agg(
        F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("r") > 0, F.col("l"))), F.lit(0)).alias("matched_left"),
        F.coalesce(F.sum(F.when(F.col("l") > 0, F.col("r"))), F.lit(0)).alias("matched_right"),
    )
    l_total = left.agg(F.count("*").alias("n")).scalar()
    r_total = right.agg(F.count("*").alias("n")).scalar()
    sized = counts.withColumns({"left_rows": l_total, "right_rows": r_total})
    lost_l = F.col("left_rows") - F.col("matched_left")
    lost_r = F.col("right_rows") - F.col("matched_right")
    extra = {"inner": F.lit(0), "left": lost_l, "right": lost_r, "full": lost_l + lost_r}[how]
    rows = F.col("pairs") + extra
    base = F.greatest(F.lit(1), F.col("left_rows"), F.col("right_rows"))
    factor = rows / base
    warn = F.concat_ws(
        ",",
        F.when(factor > 2, F.lit("multiplication")),
        F.when(F.lit(how in ("inner", "right")) & (lost_l > 0), F.lit("left_rows_dropped")),
        F.when(F.lit(how in ("inner", "left")) & (lost_r > 0), F.lit("right_rows_unmatched")),
    )
    return sized.select(
        "left_rows",
        "right_rows",
        "matched_left",
        lost_l.cast("long").alias("unmatched_left"),
        "matched_right",
        lost_r.cast("long").alias("unmatched_right"),
        rows.cast("long").alias("output_rows"),
        half_up(factor, 2).alias("factor"),
        ((factor > 2.5) & (rows > 5000)).alias("dangerous"),
        warn.alias("warnings"),
    )


def unmatched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows without a partner (swap the sides for the other half). The right side is reduced to its keys."""
    lk, rk = key_pair(left, left_key, right, right_key)
    keys = right.select(rk.alias("_key")).where(F.col("_key").isNotNull()).distinct()
    return left.withColumn("_key", lk).join(keys, "_key", "left_anti").drop("_key")


def matched(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left rows that have a partner."""
    lk, rk = key_pair(left, left_key, right, right_key)
    keys = right.select(rk.alias("_key")).where(F.col("_key").isNotNull()).distinct()
    return left.withColumn("_key", lk).join(keys, "_key", "left_semi").drop("_key")


def recommend_join(relationships: DataFrame) -> DataFrame:
    """Join type per stored relationship: INNER from 95 % of matching source keys, else LEFT."""
    return relationships.select(
        "source_table", "source_column", "target_table", "target_column", "overlap_pct",
        F.when(F.col("overlap_pct") >= 95, "INNER").otherwise("LEFT").alias("join_type"),
    )


def recommend_by_name(left: DataFrame, right: DataFrame) -> dict | None:
    """Without a stored relationship: the first column name both tables have, as a LEFT join."""
    lower = {c.lower(): c for c in right.columns}
    for c in left.columns:
        if c.lower() in lower:
            return {"left_key": c, "right_key": lower[c.lower()], "join_type": "LEFT"}
    return None


