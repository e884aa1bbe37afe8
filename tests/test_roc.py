"""ROC points and area: empty texts, and what is moved."""

import duckdb
import pytest
from pyspark.sql import functions as F

from framewright.operators import ml
from framewright.queries import registry

registry.load_all()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labelled documents, one of them empty, and one without a label."""
    at = str(tmp_path_factory.mktemp("roc"))
    rows = [(i, "ab " * (i % 7) + "12 " * (i % 5 + 1), "en", "web", 0) for i in range(60)] + [(60, "", "en", "web", 0), (61, "x", "en", "web", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 2), 0) for i in range(61)], "doc_id long, quality long, toxic long").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", ["roc_points", "roc_auc"])
def test_an_empty_text_is_scored_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    text = lambda rows: sorted(tuple(repr(float(v)) for v in r) for r in rows)
    got = registry.QUERIES[name](spark, folder).collect()
    assert text(got) == text(con.execute(registry.ORACLE[name]).fetchall()) and got


@pytest.mark.parametrize("name", ["roc_points", "roc_auc"])
def test_no_text_is_moved_and_texts_are_read_once(spark, folder, name, monkeypatch):
    scored, plain = [], ml.roc_points
    monkeypatch.setattr(ml, "roc_points", lambda rows, *a: scored.append(rows) or plain(rows, *a))
    out = registry.QUERIES[name](spark, folder)
    join = scored[0]._jdf.queryExecution().optimizedPlan()
    while join.nodeName() != "Join":
        join = join.children().apply(0)
    assert "text#" not in join.left().output().mkString(" ") + join.right().output().mkString(" ")
    assert "documents.parquet" not in out._jdf.queryExecution().executedPlan().toString()


def test_points_of_both_sums(spark):
    rows = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(37)).cast("double").alias("score"), (F.col("id") % 3 == 0).alias("hit"))
    got = sorted((tuple(r) for r in ml.roc_points(rows, F.col("hit")).collect()), key=lambda r: -r[0])
    tp = fp = 0
    for threshold, t, f, tpr, fpr, _, pos, neg in got:
        tp, fp = tp + pos, fp + neg
        assert (t, f) == (tp, fp) and abs(tpr - tp / 334) < 1e-6 and abs(fpr - fp / 666) < 1e-6
    assert (tp, fp) == (334, 666)
