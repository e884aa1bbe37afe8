"""Readers against Python's own csv and json on files cut into many small splits."""

import csv
import json
import random

import pytest

from framewright.sources import delimited, files

ODD = ["a", "b,c", 'x "q" y', "line1\nline2", "", "tab\tz", '"', '""', "\n", "end\r\nmore", "é;|", '5" pipe', ",,,", "\n\n\n", " pad "]


@pytest.fixture(params=["128m", "4k", "600"])
def splits(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "100"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("sep,name", [(",", "x.csv"), ("\t", "x.txt"), (";", "y.csv"), ("|", "z.txt")])
def test_quoted_records(spark, splits, tmp_path, sep, name):
    r = random.Random(len(name) + ord(sep))
    rows = [[i, r.choice(ODD), r.choice(ODD) * r.randint(0, 3), "", r.random()] for i in range(700)]
    with open(tmp_path / name, "w", newline="") as f:
        w = csv.writer(f, delimiter=sep)
        w.writerow([" id ", "t", "t", "", "v"])
        w.writerows(rows)
    df = files.read_delimited(spark, str(tmp_path / name))
    assert df.dtypes == [("id", "int"), ("t", "string"), ("t_2", "string"), ("v", "double")]
    got = sorted((x[0], x[1] or "", x[2] or "", x[3]) for x in df.collect())
    assert got == sorted((a, b, c, e) for a, b, c, _, e in rows)


def test_several_files_and_stray_quotes(spark, splits, tmp_path):
    for k in range(3):
        text = "id,t\r\n" + "".join(f'{k * 100 + i},5" of {i}\r\n\r\n' for i in range(60)) + f'{k * 100 + 99},"last\n{k}"'
        (tmp_path / f"p{k}.csv").write_bytes(text.encode())
    got = {r.id: r.t for r in files.read_delimited(spark, str(tmp_path)).collect()}
    assert len(got) == 183 and got[101] == '5" of 1' and got[299] == "last\n2"


def test_types_of_cells(spark, tmp_path):
    (tmp_path / "t.csv").write_text("i,l,d,b,day,at,mixed,none\n1,9007199254740993,1.5,true,2024-01-02,2024-01-02 03:04:05,1,\n"
                                    " 2,3,2e3,FALSE,2024-02-03,2024-01-02T03:04:05,x,\n")
    assert [t for _, t in files.read_delimited(spark, str(tmp_path / "t.csv")).dtypes] == [
        "int", "bigint", "double", "boolean", "date", "timestamp", "string", "string"]


def test_line_states():
    rule = delimited.Lines(",")
    for line, outside, inside in [("a,b", False, True), ('"a', True, False), ('a"', False, False), ('"a""b",c', False, False),
                                  ('a,"b', True, False), ('x""y', False, True), ('"', True, False), ('","', False, True), ("", False, True)]:
        assert (rule.after(line, False), rule.after(line, True)) == (outside, inside), line


def objects(n):
    r = random.Random(5)
    return [{"id": i, "s": r.choice(["a}", "{[", '"', "\\", '\\"', "x\ny", "ü", "]} , {", "}}}}"]), "k": [{"data": [{"z": i}]}] * (i % 3),
             "o": None if i % 3 else {"data": [i]}} for i in range(n)]


@pytest.mark.parametrize("form", ["lines", "array", "pretty", "wrapped", "pretty wrapped"])
def test_json_layouts(spark, splits, tmp_path, form):
    rows = objects(500)
    whole = {"meta": {"data": [{"id": -1}], "x": "]}"}, "other": [{"id": -2}, "}", 3], "data": rows, "after": [{"id": -3}]}
    text = {"lines": "\n".join(map(json.dumps, rows)), "array": "﻿ " + json.dumps(rows, ensure_ascii=False),
            "pretty": json.dumps(rows, indent=3), "wrapped": json.dumps(whole), "pretty wrapped": json.dumps(whole, indent=1)}[form]
    (tmp_path / "x.json").write_text(text, encoding="utf-8")
    (tmp_path / "y.json").write_text(json.dumps({"data": [{"id": 9000, "s": "other file"}]}))
    got = {r["id"]: r.asDict(True) for r in files.read_json(spark, str(tmp_path)).collect()}
    assert len(got) == 501 and got[9000]["s"] == "other file"
    for x in rows:
        assert {k: got[x["id"]][k] for k in ("s", "k", "o")} == {k: x[k] for k in ("s", "k", "o")}


def test_small_json(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": {"c": [2]}}')
    assert files.read_json(spark, str(tmp_path / "one.json")).first().asDict(True) == {"a": 1, "b": {"c": [2]}}
    (tmp_path / "none.json").write_text(" [ ] ")
    assert files.read_json(spark, str(tmp_path / "none.json"), schema="a int").count() == 0
    (tmp_path / "odata.json").write_text('{"@odata.count": 2, "value": [{"x": 1}, {"x": 2}]}')
    assert sorted(r.x for r in files.read_odata(spark, str(tmp_path / "odata.json")).collect()) == [1, 2]


def test_splits_grow_with_the_files(spark, tmp_path):
    """4 MB in splits of at least a kilobyte: some thousand splits, not four thousand, and the same rows."""
    from pyspark.sql import functions as F

    from framewright.queries import files as queries, registry

    path, seen = str(tmp_path / "lines"), []
    spark.range(500_000).select(F.format_string("%07d", "id").alias("value")).coalesce(1).write.text(path)

    def read():
        rows = spark.read.text(path)
        seen.append(rows.rdd.getNumPartitions())
        return rows

    back = queries.in_small_splits(registry.Tables(spark, ""), path, read, 1 << 10)
    assert 1000 <= seen[0] <= 1100 and back.agg(F.countDistinct("value")).first()[0] == 500_000


def test_a_given_schema_needs_no_pass_for_the_header(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('id,"t\nu"\n1,"x\ny"\n2,z\n')
    monkeypatch.setattr(delimited, "_names", lambda *_: pytest.fail("the header was read"))
    got = files.read_delimited(spark, str(tmp_path / "a.csv"), ",", "id long, t string").collect()
    assert sorted(tuple(r) for r in got) == [(1, "x\ny"), (2, "z")]
