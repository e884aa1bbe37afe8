"""Building blocks that keep hot keys and global orders off a single task.

* ``one_row``: a one-row aggregate used inside another plan as a scalar subquery (no join, no collect).
* ``exact_quantiles``: exact percentiles per group from bounded sketches plus a count of the narrow remainder.
* ``ordered_blocks`` / ``running_total`` / ``number_rows``: global or per-group order over range-split blocks.
* ``skew_join``: an equi join that spreads hot keys over several tasks.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from framewright.functions.numbers import finite
from framewright.session import ensure_checkpoint_dir

SKETCH_ACCURACY = 20_000
SMALL_ROWS = 10_000


def one_row(row: DataFrame) -> Column:
    """The only row of an aggregate as a struct column usable in any other plan."""
    return row.select(F.struct(*[F.col(f"`{c}`") for c in row.columns])).scalar()


def with_row(df: DataFrame, row: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` with the aggregate's row attached as struct column ``name``."""
    return df.withColumn(name, one_row(row))


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join of an aggregate back to rows of the same keys; the keys are kept once."""
    if not keys:
        raise ValueError("join_keys needs at least one key")
    named = right.select(*[F.col(f"`{k}`").alias("_r_" + k) for k in keys], *[c for c in right.columns if c not in keys])
    match = [F.col(f"`{k}`").eqNullSafe(F.col("`_r_" + k + "`")) for k in keys]
    return left.join(named, match, how).drop(*["_r_" + k for k in keys])


def settle(aggregate: DataFrame, limit: int = SMALL_ROWS) -> tuple[DataFrame, bool]:
    """Run an aggregate that is expected to be small: (local rows, True), or the unchanged plan and False beyond ``limit``.

    This is the size check behind every broadcast of a per-group table: at most ``limit`` rows ever reach the driver.
    """
    rows = aggregate.limit(limit + 1).collect()
    if len(rows) > limit:
        return aggregate, False
    return aggregate.sparkSession.createDataFrame(rows, aggregate.schema), True


def join_small(left: DataFrame, aggregate: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``join_keys`` that broadcasts the aggregate when it turns out small, and joins by shuffle when not."""
    rows, small = settle(aggregate)
    return join_keys(left, F.broadcast(rows) if small else rows, keys, how)


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: Column,
    probs: dict[str, float],
    accuracy: int = SKETCH_ACCURACY,
) -> DataFrame:
    """Exact linear-interpolated percentiles of ``value`` per group: ``keys + probs`` names.

    A mergeable sketch brackets every wanted percentile within 4/accuracy of the group's rows. Rows inside a
    bracket keep their value, all others collapse to one counted marker per gap, so after the map-side count only a
    sliver of each group's distinct values is ordered, however hot the group is. Groups of up to ``accuracy`` rows
    take their whole range as the bracket. A rank that falls outside its bracket would raise an error instead of
    giving an approximate answer.
    """
    src = df.select(*keys, finite(value).alias("_v")).where(F.col("_v").isNotNull())
    margin = 4.0 / accuracy
    cuts: list[float] = []
    for p in probs.values():
        cuts += [max(0.0, p - margin), min(1.0, p + margin)]
    marks = src.groupBy(*keys).agg(
        F.percentile_approx("_v", [*cuts, 0.0, 1.0], accuracy).alias("_cuts"), F.count("*").alias("_n")
    )
    near = F.col("_n") > accuracy
    ends = [
        F.when(near, F.col("_cuts")[i]).otherwise(F.col("_cuts")[len(cuts) + i % 2]).alias(f"_c{i}")
        for i in range(len(cuts))
    ]
    side, small = settle(marks.select(*keys, *ends))
    edges = [f"_c{i}" for i in range(len(cuts))]
    if not keys:
        joined = src.withColumn("_o", one_row(side)).select("_v", *[F.col(f"_o.{e}").alias(e) for e in edges])
    else:
        joined = join_keys(src, F.broadcast(side) if small else side, keys)
    v = F.col("_v")
    brackets = [(F.col(edges[2 * i]), F.col(edges[2 * i + 1])) for i in range(len(probs))]
    inside = reduce(or_, [(v >= lo) & (v <= hi) for lo, hi in brackets])
    tops = [F.when(v > hi, hi) for _, hi in brackets]
    below = F.greatest(*tops) if len(tops) > 1 else tops[0]
    counted = (
        joined.select(*keys, F.when(inside, v).otherwise(below).alias("_at"), (~inside).alias("_gap"))
        .groupBy(*keys, "_at", "_gap")
        .agg(F.count("*").alias("_k"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_at").asc_nulls_first(), "_gap")
    ranked = counted.withColumn("_hi", F.sum("_k").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumns({
        "_lo": F.col("_hi") - F.col("_k"), "_n": F.sum("_k").over(Window.partitionBy(*keys))
    })
    known = F.when(F.col("_gap"), F.raise_error(F.lit("quantile rank left its bracket")).cast("double")).otherwise(
        F.col("_at")
    )
    picks, finals = [], []
    for i, (name, p) in enumerate(probs.items()):
        place = (F.col("_n") - 1) * F.lit(float(p))
        for part, rank in (("f", F.floor(place)), ("c", F.ceil(place))):
            hit = (rank >= F.col("_lo")) & (rank < F.col("_hi"))
            picks.append(F.max(F.when(hit, known)).alias(f"_{part}{i}"))
        spread = place - F.floor(place)
        finals.append((F.col(f"_f{i}") * (1 - spread) + F.col(f"_c{i}") * spread).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks).select(*keys, *finals)


def ordered_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    """Split by range of the full order into blocks; ``_block`` grows with the order.

    The split is written to the checkpoint folder so that every later use sees the same blocks, also after an
    executor is lost. Ties on the first order column are split by the following ones, so no value is too hot.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*order).withColumn("_block", F.spark_partition_id()).checkpoint()


def running_totals(df: DataFrame, keys: list[str], order: list[Column], amounts: dict[str, Column]) -> DataFrame:
    """Running sums of some amounts per group in one order, by name, without one task per group; the table is read once."""
    places = range(len(amounts))
    blocks = ordered_blocks(
        df.withColumns({f"_amount{i}": a for i, a in enumerate(amounts.values())}),
        [*[F.col(k).asc_nulls_first() for k in keys], *order],
    )
    sums = blocks.groupBy("_block", *keys).agg(*[F.sum(f"_amount{i}").alias(f"_part{i}") for i in places])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_block", *keys, *[F.coalesce(F.sum(f"_part{i}").over(before), F.lit(0)).alias(f"_offset{i}") for i in places])
    local = Window.partitionBy("_block", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = blocks.withColumns({f"_local{i}": F.sum(f"_amount{i}").over(local) for i in places})
    numbered = join_keys(within, offsets, ["_block", *keys])
    totals = [(F.col(f"_local{i}") + F.col(f"_offset{i}")).alias(name) for i, name in enumerate(amounts)]
    return numbered.select(*df.columns, *totals)


def running_total(df: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """Running sum of ``amount`` per group in order, without one task per group."""
    return running_totals(df, keys, order, {name: amount})


def number_rows(df: DataFrame, order: list[Column], name: str = "row_no", keys: list[str] | None = None) -> DataFrame:
    """1-based row number in a total order over the whole table (or per group)."""
    return running_total(df, keys or [], order, F.lit(1).cast("long"), name)


def average_ranks(df: DataFrame, value: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Distinct values with their count ``n`` and average rank ``name``; nulls are left out."""
    keys = keys or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    up_to = running_total(counts, keys, [F.col(value).asc()], F.col("n"), "_upto")
    return up_to.withColumn(name, F.col("_upto") - (F.col("n") - 1) / 2.0).drop("_upto")


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> list:
    """Keys holding more than ``share`` of all rows: at most 1/share values, so safe to bring to the driver."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.select(F.count("*")).scalar()
    rows = counts.where(F.col("_n") > total * share).select(key).limit(int(1 / share) + 1).collect()
    return [r[0] for r in rows]


def _salted(left: DataFrame, right: DataFrame, key: str, how: str, salts: int, hot: list) -> DataFrame:
    """Left rows of hot keys, and left rows without a key, spread over ``salts`` tasks; the right rows of hot keys repeated per salt."""
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]) + F.spark_partition_id(), F.lit(salts))
    salted = left.withColumn("_salt", F.when(is_hot | F.col(key).isNull(), spread).otherwise(F.lit(0)).cast("int"))
    if not hot:
        copies = right.withColumn("_salt", F.lit(0))
    else:
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        copies = right.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


#: Most rows of one key that a task gets from one side of a join, as a share of that side; what the summary of frequent keys tracks.
TASK_SHARE, TRACKED = 0.002, 40
#: Tasks that rows without a key are spread over; they match nothing.
NULL_TASKS = 64


def heavy_keys(df: DataFrame, key: str, share: float = TASK_SHARE) -> dict:
    """Keys of more than ``share`` of all rows with their count, from one mergeable summary: one pass, nothing shuffled, at most
    1/share keys. A key that holds more is never missed; counts may be too high by a small part of the share."""
    many = int(1 / share)
    row = df.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(`{key}`, {many}, {many * TRACKED})").alias("top")).first()
    return {r["item"]: (r["count"], row["n"]) for r in row["top"] or [] if r["item"] is not None and r["count"] > share * row["n"]}


def _parts(heavy: dict, share: float) -> dict:
    """Parts a heavy key is cut into, so that each holds at most ``share`` of its side."""
    return {k: math.ceil(count / (share * total)) for k, (count, total) in heavy.items()}


def _grid(left: DataFrame, right: DataFrame, key: str, cuts: dict, other: dict) -> tuple[DataFrame, DataFrame]:
    """Both sides with every heavy key laid out as a grid: left rows in one of ``cuts[key]`` rows of it, copied to its columns, right rows
    in one of ``other[key]`` columns, copied to its rows. A pair of rows meets in one cell, and there are never more copies
    than pairs. Rows of other keys have one cell."""
    dtype = left.schema[key].dataType

    def parts(known: dict) -> Column:
        if not known:
            return F.lit(1)
        names = [F.lit(k).cast(dtype) for k in known]
        table = F.map_from_arrays(F.array(*names), F.array(*[F.lit(n) for n in known.values()]))
        return F.when(F.coalesce(F.col(key).isin(list(known)), F.lit(False)), F.element_at(table, F.col(key))).otherwise(1)

    def place(df: DataFrame, own: Column, across: Column, names: tuple[str, str], known: dict, copied: dict) -> DataFrame:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]) + F.spark_partition_id()
        spread = F.pmod(row, F.when(F.col(key).isNull(), NULL_TASKS).otherwise(own)).cast("int")
        placed = df.withColumn(names[0], spread)
        if not copied:
            return placed.withColumn(names[1], F.lit(0))
        cells = F.when(across > 1, F.sequence(F.lit(0), across - 1)).otherwise(F.array(F.lit(0)))
        return placed.withColumn(names[1], F.explode(cells))

    left = place(left, parts(cuts), parts(other), ("_salt", "_across"), cuts, other)
    return left, place(right.where(F.col(key).isNotNull()), parts(other), parts(cuts), ("_across", "_salt"), other, cuts)


def _gridded(left: DataFrame, right: DataFrame, key: str, how: str, cuts: dict, other: dict) -> DataFrame:
    """The join of the two sides over their grids."""
    left, right = _grid(left, right, key, cuts, other)
    return left.join(right, [key, "_salt", "_across"], how).drop("_salt", "_across")


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", salts: int = 16,
              hot: list | None = None, share: float = TASK_SHARE) -> DataFrame:
    """Equi join on ``key`` (same name on both sides) with hot keys of either side, and rows without a key, spread over tasks.

    One pass over either side's keys finds those that hold more than ``share`` of it; each is cut into as many parts as leave no task
    more than that share, in proportion on both sides (see ``_gridded``). Keys that are cut on the right have partners there, so in
    a left join their part is an inner join, made apart. A caller that knows the hot keys of the left side names them (``[]``: even, the
    plain join; they get ``salts`` parts). ``right`` is the mirror image of ``left``.
    """
    if how == "right":
        turned = skew_join(right, left, key, "left", salts, hot, share)
        return turned.select(key, *[c for c in left.columns if c != key], *[c for c in right.columns if c != key])
    if hot is not None:
        return _salted(left, right, key, how, salts, hot) if hot else left.join(right, key, how)
    cuts, other = (_parts(heavy_keys(df, key, share), share) for df in (left, right))
    if how == "inner":
        return _gridded(left.where(F.col(key).isNotNull()), right, key, how, cuts, other) if cuts or other else left.join(right, key, how)
    wide = F.coalesce(F.col(key).isin(list(other)), F.lit(False)) if other else F.lit(False)
    rest = _gridded(left.where(~wide), right.where(~wide), key, how, {k: n for k, n in cuts.items() if k not in other}, {})
    return rest.unionByName(_gridded(left.where(wide), right.where(wide), key, "inner", cuts, other)) if other else rest
