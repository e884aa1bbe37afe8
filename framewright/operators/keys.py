"""Primary and foreign key candidates, relationships, schema conflicts and duplicate entities."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framewright.functions.numbers import half_up
from framewright.functions.text import bare, is_number, is_text
from framewright.operators.joins import key_counts
from framewright.operators.overlap import Place, cell_texts, containments, family, long_cells
from framewright.operators.profile import Profile
from framewright.session import work_folder

# The columns that name entities.
ENTITY_NAME = "(?i)name|customer|client|company|title|product"


def primary_keys(p: Profile) -> DataFrame:
    """Key score of every column from uniqueness, completeness, name and value shape; a candidate from 60 on.

    The shape is judged on all values: numbers that never repeat, some UUID, or nothing but letter-digit codes.
    """
    rows = p.facts()
    unique = 100.0 * F.col("distinct") / F.nullif(F.col("valid"), F.lit(0))
    filled = 100.0 * F.col("valid") / F.nullif(F.col("total"), F.lit(0))
    name = bare(F.col("column"))
    steady = (F.col("kind") == "number") & (F.col("distinct") == F.col("valid"))
    shape = steady | F.col("has_uuid") | F.col("all_codes")
    points = (
        F.when(unique == 100, 45).when(unique >= 99, 35).when(unique >= 90, 15)
        + F.when(filled == 100, 25).when(filled >= 99, 15).otherwise(-20)
        + F.when(name.rlike("^id|(id|key|code|sku)$"), 20).otherwise(0)
        + F.when(F.coalesce(shape, F.lit(False)), 10).otherwise(0)
    )
    confidence = F.when(points.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), points))).cast("long")
    return rows.select(
        "column", half_up(F.coalesce(unique, F.lit(0.0)), 1).alias("uniqueness"), half_up(filled, 1).alias("non_null_pct"),
        confidence.alias("confidence"), (confidence >= 60).alias("is_candidate"),
    )


def name_similarity(a: Column, b: Column, table_a: Column, table_b: Column) -> Column:
    """100 for equal names, 95 for table + id/key, 80 when one contains the other, else 20."""
    x, y = bare(a), bare(b)
    ta, tb = (F.regexp_replace(bare(t), "csv|xlsx|xls|table", "") for t in (table_a, table_b))
    linked = x.isin(F.concat(tb, F.lit("id")), F.concat(tb, F.lit("key"))) | y.isin(
        F.concat(ta, F.lit("id")), F.concat(ta, F.lit("key"))
    )
    return (
        F.when(x == y, 100).when(linked, 95).when(F.contains(x, y) | F.contains(y, x), 80).otherwise(20).cast("double")
    )


#: Columns per mask of a value: the bits of a long without its sign.
MASK_BITS = 62


def held_values(tables: dict[str, DataFrame], columns: list[Place]) -> DataFrame:
    """(places, values): how many distinct values are held by exactly these columns, by the columns' numbers.

    A value carries one bit per column, so equal values meet in one hash aggregate that also works before the shuffle."""
    spots = {p.number: i for i, p in enumerate(columns)}
    words = range(-(-len(columns) // MASK_BITS))
    parts = None
    for name, df in tables.items():
        for kind in ("value", "other"):
            mine = [p for p in columns if p.table == name and family(df.schema[p.column].dataType) == kind]
            if not mine:
                continue
            cells = long_cells(cell_texts(df, [replace(p, number=spots[p.number]) for p in mine]), "value").where("value <> ''")
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(MASK_BITS)))
            masks = [F.when(F.floor(F.col("place") / MASK_BITS) == w, bit).otherwise(F.lit(0).cast("long")).alias(f"m{w}") for w in words]
            part = cells.select(F.lit(kind).alias("family"), "value", *masks)
            parts = part if parts is None else parts.unionByName(part)
    masks = [f"m{w}" for w in words]
    by_value = parts.groupBy("family", "value").agg(*[F.bit_or(m).alias(m) for m in masks])
    counts = by_value.groupBy(*masks).agg(F.count("*").alias("values"))
    set_in = lambda i: F.getbit(f"m{i // MASK_BITS}", F.lit(i % MASK_BITS)) == 1
    places = F.array_compact(F.array(*[F.when(set_in(i), F.lit(p.number)) for i, p in enumerate(columns)]))
    return counts.select(places.alias("places"), "values")


def filled_cells(tables: dict[str, DataFrame], columns: list[Place]) -> dict[int, int]:
    """How many cells of each column are filled, by its number."""
    out: dict[int, int] = {}
    for name, df in tables.items():
        mine = [p for p in columns if p.table == name]
        if mine:
            texts = cell_texts(df, mine)
            row = texts.agg(*[F.count_if(F.col(c) != "").alias(c) for c in texts.columns]).first()
            out |= {p.number: row[str(p.number)] for p in mine}
    return out


def promising_places(tables: dict[str, DataFrame], minimum: float) -> list[Place]:
    """The columns of pairs that can reach ``minimum`` by what their samples, names and a unique side allow at most."""
    spark = next(iter(tables.values())).sparkSession
    found, share = containments(tables)
    ends = {(min(p), max(p)) for p in share}
    rows = [(a, b, found[a].table, found[a].column, found[b].table, found[b].column,
             100 * max(share.get((a, b), 0.0), share.get((b, a), 0.0))) for a, b in sorted(ends)]
    pairs = spark.createDataFrame(rows, "a int, b int, ta string, ca string, tb string, cb string, most double")
    similar = F.greatest(name_similarity(F.col("ca"), F.col("cb"), F.col("ta"), F.col("tb")),
                         name_similarity(F.col("cb"), F.col("ca"), F.col("tb"), F.col("ta")))
    able = (F.col("most") >= 30) & (half_up(F.col("most") * 0.6 + similar * 0.25 + 15) >= minimum)
    numbers = {n for r in pairs.where(able).select("a", "b").collect() for n in r}
    return [found[n] for n in sorted(numbers)]


def promising_columns(tables: dict[str, DataFrame], minimum: float) -> dict[str, list[str]]:
    """The names of these columns by table."""
    out: dict[str, list[str]] = {}
    for p in promising_places(tables, minimum):
        out.setdefault(p.table, []).append(p.column)
    return out


FOUND = """source_table string, source_column string, target_table string, target_column string, matches long, overlap_pct double,
 target_overlap_pct double, name_similarity double, cardinality string, confidence double"""


def discover_relationships(tables: dict[str, DataFrame], minimum: float = 55.0) -> DataFrame:
    """Foreign key candidates between all ordered table pairs over all flat columns, the stronger of two inverted ones kept.

    Samples of the distinct values first drop the columns that no pair can be made of (see ``overlap``); only the cells of
    the others are shuffled. There each distinct value carries a bit per column it occurs in; equal sets of columns are counted, and column
    pairs are made from those counts. No pair of values is ever formed.
    """
    spark = next(iter(tables.values())).sparkSession
    columns = promising_places(tables, minimum)
    if not columns:
        return spark.createDataFrame([], FOUND)
    held = held_values(tables, columns)
    path = work_folder(spark, "held-values")  # a row per set of columns that occurs
    held.write.parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    filled = filled_cells(tables, columns)
    known = spark.createDataFrame([(p.number, p.table, p.column, filled[p.number]) for p in columns],
                                  "place int, table string, column string, filled long")
    sizes = held.select(F.explode("places").alias("place"), "values").groupBy("place").agg(F.sum("values").alias("distinct"))
    sizes = sizes.join(known, "place")
    left = held.where(F.size("places") > 1).select("places", "values", F.explode("places").alias("source"))
    both = left.select("source", F.explode("places").alias("target"), "values").where("source <> target")
    pairs = both.groupBy("source", "target").agg(F.sum("values").alias("matches"))
    for side in ("source", "target"):
        named = sizes.select(
            F.col("place").alias(side), F.col("table").alias(f"{side}_table"), F.col("column").alias(f"{side}_column"),
            F.col("distinct").alias(f"{side}_distinct"), (F.col("distinct") == F.col("filled")).alias(f"{side}_unique"),
        )
        pairs = pairs.join(named, side)
    pairs = pairs.where("source_table <> target_table")
    s_pct = 100.0 * F.col("matches") / F.col("source_distinct")
    t_pct = 100.0 * F.col("matches") / F.col("target_distinct")
    similar = name_similarity(F.col("source_column"), F.col("target_column"), F.col("source_table"), F.col("target_table"))
    bonus = F.when(F.col("source_unique") | F.col("target_unique"), 15.0).otherwise(0.0)
    sure = F.least(F.lit(99.0), half_up(F.greatest(s_pct, t_pct) * 0.6 + similar * 0.25 + bonus))
    cardinality = (
        F.when(F.col("source_unique") & F.col("target_unique"), "ONE_TO_ONE").when(F.col("source_unique"), "ONE_TO_MANY")
        .when(F.col("target_unique"), "MANY_TO_ONE").otherwise("MANY_TO_MANY")
    )
    scored = pairs.where(F.greatest(s_pct, t_pct) >= 30).select(
        "source_table", "source_column", "target_table", "target_column", "matches", half_up(s_pct, 1).alias("overlap_pct"),
        half_up(t_pct, 1).alias("target_overlap_pct"), similar.alias("name_similarity"), cardinality.alias("cardinality"),
        sure.alias("confidence"),
    ).where(F.col("confidence") >= minimum)
    ends = F.array_sort(F.array(
        F.concat_ws(".", "source_table", "source_column"), F.concat_ws(".", "target_table", "target_column")
    ))
    many_first = F.when(F.col("cardinality") == "ONE_TO_MANY", 1).otherwise(0)
    best = Window.partitionBy("_ends").orderBy(
        F.col("confidence").desc(), many_first, F.col("overlap_pct").desc(), "source_table", "source_column"
    )
    ranked = scored.withColumn("_ends", ends).withColumn("_r", F.row_number().over(best))
    return ranked.where(F.col("_r") == 1).drop("_ends", "_r")


def validate_relationship(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Matched and unmatched distinct keys, repeated keys, nulls and validity of one relationship."""
    counts = key_counts(left, right, left_key, right_key).agg(
        F.count_if(F.col("l") > 0).alias("source_keys"), F.count_if(F.col("r") > 0).alias("target_keys"),
        F.count_if((F.col("l") > 0) & (F.col("r") > 0)).alias("matched_keys"),
        F.coalesce(F.sum(F.greatest(F.col("l") - 1, F.lit(0))), F.lit(0)).alias("source_duplicates"),
        F.coalesce(F.sum(F.greatest(F.col("r") - 1, F.lit(0))), F.lit(0)).alias("target_duplicates"),
        F.coalesce(F.sum("l"), F.lit(0)).alias("l_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("r_rows"),
    )
    facts = counts.withColumns({
        "l_total": left.agg(F.count("*").alias("n")).scalar(), "r_total": right.agg(F.count("*").alias("n")).scalar()
    })
    lt, rt = left.schema[left_key].dataType, right.schema[right_key].dataType
    fits = (is_number(lt) and is_number(rt)) or (is_text(lt) and is_text(rt)) or lt == rt
    share = F.coalesce(half_up(100.0 * F.col("matched_keys") / F.nullif(F.col("source_keys"), F.lit(0)), 1), F.lit(0.0))
    return facts.select(
        "source_keys", "target_keys", "matched_keys", (F.col("source_keys") - F.col("matched_keys")).alias("unmatched_source"),
        (F.col("target_keys") - F.col("matched_keys")).alias("unmatched_target"), share.alias("match_pct"),
        F.col("source_duplicates").cast("long").alias("source_duplicates"),
        F.col("target_duplicates").cast("long").alias("target_duplicates"),
        (F.col("l_total") - F.col("l_rows")).cast("long").alias("source_nulls"),
        (F.col("r_total") - F.col("r_rows")).cast("long").alias("target_nulls"), F.lit(fits).alias("types_fit"),
        (F.lit(fits) & (share > 15)).alias("is_valid"),
    )


def schema_conflicts(profiles: dict[str, Profile]) -> DataFrame:
    """Columns of equal normalised name but different logical type in two tables (schema rows only)."""
    parts = None
    for name, p in profiles.items():
        part = p.facts().select(F.lit(name).alias("table"), "column", "type", bare(F.col("column")).alias("plain"))
        parts = part if parts is None else parts.unionByName(part)
    a = parts.select("plain", F.col("table").alias("table_a"), F.col("column").alias("column_a"), F.col("type").alias("type_a"))
    b = parts.select("plain", F.col("table").alias("table_b"), F.col("column").alias("column_b"), F.col("type").alias("type_b"))
    both = a.join(b, "plain").where((F.col("table_a") < F.col("table_b")) & (F.col("type_a") != F.col("type_b")))
    texts = ("text", "categorical", "id")
    hard = ((F.col("type_a") == "numeric") & F.col("type_b").isin(*texts)) | (
        (F.col("type_b") == "numeric") & F.col("type_a").isin(*texts)
    )
    fix = F.when((F.col("type_a") == "numeric") | (F.col("type_b") == "numeric"), "numeric").otherwise("string")
    return both.select(
        "table_a", "column_a", "type_a", "table_b", "column_b", "type_b",
        F.when(hard, "HIGH").otherwise("MEDIUM").alias("severity"), fix.alias("harmonize_to"),
    )


def duplicate_entities(df: DataFrame, columns: list[str] | None = None, min_length: int = 0) -> DataFrame:
    """Spellings of name-like columns that differ only in case, blanks or punctuation, all groups.

    Equal spellings are counted first, so a group holds each spelling once however often it occurs. ``min_length`` leaves short ones out.
    """
    import re

    columns = columns or [f.name for f in df.schema.fields if is_text(f.dataType) and re.search(ENTITY_NAME, f.name)]
    long = df.select(*[F.col(f"`{c}`") for c in columns]).unpivot([], columns, "column", "value")
    counts = long.where(F.length("value") >= min_length).groupBy("column", "value").agg(F.count("*").alias("rows"))
    plain = counts.withColumn("plain", bare(F.col("value"))).where(F.col("plain") != "")
    groups = plain.groupBy("column", "plain").agg(
        F.count("*").alias("spellings"), F.sum("rows").alias("rows"),
        F.min_by("value", F.struct(-F.col("rows"), F.col("value"))).alias("main_value"),
    ).where(F.col("spellings") > 1)
    others = plain.join(groups.withColumnRenamed("rows", "group_rows"), ["column", "plain"])
    return others.where(F.col("value") != F.col("main_value")).select(
        "column", "main_value", F.col("value").alias("similar_value"), "rows", F.lit(0.95).alias("similarity")
    )


def reconcile(left: DataFrame, left_metric: str, right: DataFrame, right_metric: str, tolerance_pct: float = 0.01) -> DataFrame:
    """Two totals, their difference and MATCH or DISCREPANCY by tolerance."""
    a = left.agg(F.sum(F.col(f"`{left_metric}`").cast("double")).alias("left_total"))
    b = right.agg(F.sum(F.col(f"`{right_metric}`").cast("double")).alias("t")).scalar()
    both = a.withColumn("right_total", b)
    gap = F.col("left_total") - F.col("right_total")
    pct = 100.0 * gap / F.nullif(F.abs(F.col("right_total")), F.lit(0.0))
    return both.select(
        half_up(F.col("left_total"), 2).alias("left_total"), half_up(F.col("right_total"), 2).alias("right_total"),
        half_up(gap, 2).alias("difference"), half_up(pct, 4).alias("difference_pct"),
        F.when(F.abs(pct) <= tolerance_pct, "MATCH").otherwise("DISCREPANCY").alias("status"),
    )


def unit_conflicts(sheets: dict[str, DataFrame]) -> DataFrame:
    """Columns of equal normalised name with different known units in two schema sheets."""
    parts = None
    for name, sheet in sheets.items():
        part = sheet.where(F.col("unit") != "UNKNOWN").select(
            F.lit(name).alias("table"), "column", "unit", bare(F.col("column")).alias("plain")
        )
        parts = part if parts is None else parts.unionByName(part)
    a = parts.select("plain", *[F.col(c).alias(f"{c}_a") for c in ("table", "column", "unit")])
    b = parts.select("plain", *[F.col(c).alias(f"{c}_b") for c in ("table", "column", "unit")])
    return a.join(b, "plain").where((F.col("table_a") < F.col("table_b")) & (F.col("unit_a") != F.col("unit_b"))).drop("plain")


