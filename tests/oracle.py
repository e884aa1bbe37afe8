"""Run registered queries next to their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from framewright import local_session  # noqa: E402
from framewright.queries import registry  # noqa: E402

registry.load_all()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for table in registry.TABLES:
        con.execute(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def cell(value):
    """A comparable form: exact for everything but the last bits of a float."""
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "~"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows])


def compare(spark, con, folder: str, name: str) -> tuple[str, float, int]:
    """('ok' or what differs, Spark seconds, row count)."""
    start = time.time()
    df = registry.QUERIES[name](spark, folder)
    got = df.collect()
    took = time.time() - start
    if name not in registry.ORACLE:
        return ("rows-only" if got else "rows-only, EMPTY"), took, len(got)
    cur = con.execute(registry.ORACLE[name])
    sql_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(sql_names):
        return f"columns {sorted(df.columns)} vs {sorted(sql_names)}", took, len(got)
    a, b = rows_of(df.columns, got), rows_of(sql_names, want)
    if a == b:
        return "ok", took, len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y][:2]
    return f"DIFF rows {len(a)} vs {len(b)}; {bad} cols {sorted(df.columns)}", took, len(got)


if __name__ == "__main__":
    folder = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session("8")
    con = connect(folder)
    bad = 0
    for name in registry.QUERIES:
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            state, took, n = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            state, took, n = f"ERROR {type(e).__name__}: {str(e)[:600]}", 0.0, 0
        bad += not (state == "ok" or state == "rows-only")
        print(f"{name:32s} {took:6.2f}s {n:7d} {state}", flush=True)
    print("queries", len(registry.QUERIES), "bad", bad)
