"""A table's statistics after each cleaning step equal those measured anew."""

import pytest
from pyspark.sql import functions as F

from framewright.operators import clean
from framewright.operators.state import TableState
from framewright.plans.cleaning import preview_statistics


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i % 40, " a " if i % 3 else ("b" if i % 2 else None), float(i % 7) if i % 5 else None, "" if i % 11 == 0 else f"n{i % 4}")
            for i in range(300)]
    return spark.createDataFrame(rows, "id int, w string, v double, t string").repartition(4)


ACTIONS = [clean.Trim("w"), clean.Impute("v", "median"), clean.ClearCells("v", 1.0, 5.0), clean.RemoveDuplicates(), clean.Recase("t", "upper"),
           clean.DropMissing("w"), clean.Rename("t", "text"), clean.DropColumn("v"), clean.Replace("w", "a", "zz")]


def test_states_follow_the_steps(table):
    history, df = clean.History(table), table
    for a in ACTIONS:
        history = history.do(a)
    log = history.log().orderBy("step").collect()
    assert [r.action for r in log] == [type(a).__name__ for a in ACTIONS]
    for r, a in zip(log, ACTIONS):
        before, df = TableState.of(df), a.apply(df)
        after = TableState.of(df)
        assert (r.rows_before, r.missing_before, r.duplicates_before) == (before.rows, before.missing, before.duplicates), r
        assert (r.rows_after, r.missing_after, r.duplicates_after) == (after.rows, after.missing, after.duplicates), r
    assert log[0].affected_rows > 0 and log[3].affected_rows == log[3].duplicates_before


def test_moments_follow_exchanged_rows(table):
    from framewright.operators.state import exchanged

    action = clean.ClearCells("v", 1.0, 5.0)
    after = action.apply(table.withColumn("before", F.struct(*table.columns)))
    moved = TableState.of(table).changed(exchanged(table, after, table.columns))
    fresh = TableState.of(action.apply(table))
    assert moved.moments()["id"] == pytest.approx(fresh.moments()["id"]) and moved.moments()["v"] == pytest.approx(fresh.moments()["v"])
    assert (moved.rows, moved.missing, moved.duplicates) == (fresh.rows, fresh.missing, fresh.duplicates)
    assert moved.prints.exceptAll(fresh.prints.select(*moved.prints.columns)).count() == 0


def test_preview_of_both_sides(table):
    before, after = preview_statistics(table, clean.RemoveDuplicates()).orderBy(F.col("side").desc()).collect()
    assert before.side == "before" and before.duplicate_rows > 0 == after.duplicate_rows and after.rows < before.rows
    assert 0 <= before["score"] <= after["score"] <= 100


def test_empty_history_and_table(spark, table):
    assert clean.History(table).log().count() == 0
    r = clean.History(table.limit(0)).do(clean.Trim("w")).log().first()
    assert (r.rows_before, r.missing_after, r.duplicates_after) == (0, 0, 0)
