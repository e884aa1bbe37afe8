"""Versions written at the same time, failed writers and readers that opened earlier."""

import threading

import pytest
from pyspark.sql import functions as F

from framewright.sources.snapshots import Snapshots


def test_writers_at_the_same_time(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "t"))
    assert store.write(spark.range(3), "loaded") == 1
    got, gate = [], threading.Barrier(4)

    def write(i):
        gate.wait()
        got.append((Snapshots(spark, str(tmp_path / "t")).write(spark.range(10 * (i + 1)), f"writer {i}"), i))

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in got) == [2, 3, 4, 5]
    assert all(store.read(v).count() == 10 * (i + 1) for v, i in got)
    assert {r.version: r.rows for r in store.log().collect()} == {1: 3, **{v: 10 * (i + 1) for v, i in got}}


def test_lost_claims_take_the_next_number(spark, tmp_path, monkeypatch):
    """A writer that read the log before another one finished still gets its own number and leaves the other's rows alone."""
    root = str(tmp_path / "t")
    Snapshots(spark, root).write(spark.range(1), "loaded")
    late = Snapshots(spark, root)
    seen = []
    monkeypatch.setattr(late, "latest", lambda: seen.append(1) or (1 if len(seen) == 1 else Snapshots.latest(late)))
    Snapshots(spark, root).write(spark.range(2), "first")
    assert late.write(spark.range(7), "second") == 3
    assert [Snapshots(spark, root).read(v).count() for v in (1, 2, 3)] == [1, 2, 7]


def test_failed_writers_leave_no_version(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "t"))
    store.write(spark.range(5), "loaded")
    opened = store.read(1)
    with pytest.raises(Exception):
        store.write(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), "broken")
    assert store.latest() == 1 and store.log().count() == 1
    assert store.write(spark.range(6), "next") == 2 and opened.count() == 5
    with pytest.raises(ValueError):
        store.read(9)


def test_claims_through_the_file_system_interface(spark, tmp_path):
    """The way of HDFS, run on a local folder."""
    store = Snapshots(spark, f"file:{tmp_path}/t")
    claim = lambda n: store._claim_by_rename(f"{store.root}/drafts/{n}", f"{store.root}/log/{n}.json", f'{{"version": {n}}}\n')
    assert [claim(1), claim(1), claim(2)] == [True, False, True]
    assert store.latest() == 2
