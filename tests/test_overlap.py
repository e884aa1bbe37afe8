"""Sampled containment and pruned discovery against plain sets."""

from pyspark.sql import functions as F

from framewright.operators import keys, overlap


def workspace(spark):
    """Columns of very different sizes: 30,000 of 120,000 ids contained, a tenth shared, nothing shared, and a few codes."""
    ids = spark.range(120_000).select(F.col("id").alias("id"), F.md5(F.col("id").cast("string")).alias("note"),
                                      (F.col("id") % 7).cast("string").alias("code"))
    sales = spark.range(60_000).select((F.col("id") % 30_000 * 4).alias("id_ref"), (F.col("id") * 10).alias("tenth"),
                                       F.sha1(F.col("id").cast("string")).alias("noise"), F.lit(None).cast("string").alias("blank"))
    codes = spark.createDataFrame([(str(i), f"name {i}") for i in range(7)], "code string, label string")
    return {"items": ids, "sales": sales, "codes": codes}


def test_containments_bound_the_truth(spark):
    tables = workspace(spark)
    found, share = overlap.containments(tables)
    sets = {}
    for p in found:
        rows = tables[p.table].select(p.column).distinct().collect()
        sets[p.number] = {str(r[0]) for r in rows if r[0] is not None}
    for a in found:
        for b in found:
            if a.table != b.table and sets[a.number]:
                truth = len(sets[a.number] & sets[b.number]) / len(sets[a.number])
                known = share.get((a.number, b.number), 0.06)
                assert truth <= known + 1e-9, (a, b)
                assert known <= truth + 0.16, (a, b)
    by_name = {(p.table, p.column): p for p in found}
    assert by_name["codes", "code"].level == 0 < by_name["items", "note"].level


def test_discovery_reads_only_promising_columns(spark):
    tables = workspace(spark)
    columns = keys.promising_columns(tables, 55.0)
    assert columns == {"items": ["id", "code"], "sales": ["id_ref"], "codes": ["code"]}
    rows = keys.discover_relationships(tables).collect()
    best = {(r.source_column, r.target_column): r for r in rows}
    assert best["id_ref", "id"].matches == 30_000 and best["id_ref", "id"].cardinality == "MANY_TO_ONE"
    assert best["code", "code"].overlap_pct == 100.0 and len(rows) <= 4


def test_nothing_in_common(spark):
    a = spark.createDataFrame([(1, "x")], "k int, w string")
    b = spark.createDataFrame([], "q int")
    assert keys.discover_relationships({"a": a, "b": b}).count() == 0
    assert keys.discover_relationships({"a": a, "b": a.select(F.array("k").alias("k"))}).count() == 0


def test_a_cell_is_folded_once_per_pass(spark):
    """The text of a cell is not made anew for each time that a condition names it, nor per element of an array."""
    tables = workspace(spark)
    found = overlap.places(tables)
    texts = sum(dict(tables[p.table].dtypes)[p.column] == "string" for p in found)
    for sampled in (True, False):
        plan = overlap._cells(tables, found, sampled)._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("lower(trim(") <= texts and "lambda" not in plan


def test_values_of_many_columns_meet_in_one_aggregate(spark):
    """100 columns, more than a mask has bits, against plain sets; lists of columns are not collected per value."""
    wide = spark.range(50).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(70)])
    other = spark.range(40).select(*[(F.col("id") * (i + 1)).cast("string").alias(f"d{i}") for i in range(30)])
    tables = {"wide": wide, "other": other}
    found = overlap.places(tables)
    held = keys.held_values(tables, found)
    assert "collect_list" not in held._jdf.queryExecution().optimizedPlan().toString()
    want, got = {}, {}
    for p in found:
        for (v,) in tables[p.table].select(p.column).distinct().collect():
            want.setdefault(str(v), []).append(p.number)
    for r in held.collect():
        got[tuple(r.places)] = r["values"]
    lists = [tuple(sorted(v)) for v in want.values()]
    assert got == {k: lists.count(k) for k in lists}
    assert keys.filled_cells(tables, found) == {p.number: tables[p.table].count() for p in found}
