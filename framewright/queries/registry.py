"""Registry of runnable queries: name -> (Spark callable, comparable SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.session import prepare

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder as DataFrames, plus views with known dirt."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in DIRTY:
            return self.spark.sql(DIRTY[name], **{b: getattr(self, b) for b in ("orders", "customer", "events")})
        raise AttributeError(name)


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with the SQL that must give the same rows."""

    def keep(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return keep


def hu(x: str, digits: int = 0) -> str:
    """SQL text of half-up rounding, as ``functions.numbers.half_up``."""
    y = f"(({x})::double)"
    return f"(case when abs({y}*{10**digits}) < 4503599627370496 then floor(round({y}*{10**digits}, 4)+0.5)/{10**digits} else {y} end)"


# The same text runs on both engines; {table} is a DataFrame in Spark and a view in SQL.
DIRTY = {
    "dirty_orders": """
        select o_orderkey as order_id, o_custkey as cust_id,
          case when o_orderkey % 25 = 0 then 'N/A' else o_orderstatus end as status,
          case when o_orderkey % 5 = 0 then null when o_orderkey % 97 = 0 then o_totalprice * 50
               else o_totalprice end as price,
          case when o_orderkey % 9 = 0 then concat('  ', o_orderpriority, ' ')
               when o_orderkey % 11 = 0 then lower(o_orderpriority) else o_orderpriority end as priority,
          o_orderdate as order_date, 'S1' as store,
          case when o_orderkey % 10 <> 0 then null else concat('note ', cast(o_custkey % 7 as string)) end as note
        from {orders}
        union all
        select o_orderkey, o_custkey, case when o_orderkey % 25 = 0 then 'N/A' else o_orderstatus end, null,
          case when o_orderkey % 9 = 0 then concat('  ', o_orderpriority, ' ')
               when o_orderkey % 11 = 0 then lower(o_orderpriority) else o_orderpriority end,
          o_orderdate, 'S1',
          concat('note ', cast(o_custkey % 7 as string))
        from {orders} where o_orderkey % 50 = 0""",
    "dirty_customer": """
        select case when c_custkey % 40 = 0 then c_custkey - 1 else c_custkey end as customer_id, c_name as customer_name,
          case when c_custkey % 8 = 0 then concat('$', cast(c_acctbal as string))
               else cast(c_acctbal as string) end as balance_text,
          cast(case when c_custkey % 100 = 12 then -5 when c_custkey % 100 = 45 then 999
               else 20 + c_custkey % 60 end as int) as age,
          case when c_custkey % 6 = 0 then concat(' ', c_mktsegment) when c_custkey % 7 = 0 then lower(c_mktsegment)
               else c_mktsegment end as segment,
          case when c_custkey % 13 = 0 then 'USA' when c_custkey % 17 = 0 then 'U.S.A.' when c_custkey % 19 = 0 then ' usa '
               else 'Canada' end as country,
          case when c_custkey % 2 = 0 then 'yes' else 'no' end as active
        from {customer}""",
    "dirty_events": """
        select event_id, user_id, event_type, ts, case when event_id % 3 = 0 then null else value end as value,
          case when event_id % 4 = 0 then concat(substr(cast(ts as string), 9, 2), '/', substr(cast(ts as string), 6, 2),
                 '/', substr(cast(ts as string), 1, 4))
               when event_id % 29 = 0 then 'not a date' when event_id % 31 = 0 then '2024-13-45'
               else substr(cast(ts as string), 1, 10) end as date_text
        from {events}""",
}


def with_views(sql: str) -> str:
    """SQL with the dirty views it names put in front as common table expressions."""
    needed = [n for n in DIRTY if n in sql]
    if not needed:
        return sql
    parts = [f"{n} as ({DIRTY[n].format(orders='orders', customer='customer', events='events')})" for n in needed]
    head = "with " + ", ".join(parts)
    body = sql.strip()
    return head + (", " + body[5:] if body.lower().startswith("with ") else " " + body)


def load_all() -> None:
    """Import every query module so that the registry is full."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"framewright.queries.{module}")


MODULES = ["flagship", "rows", "joining", "groups", "calendar", "profiles", "cleaning", "relations", "statistics", "files",
           "insighting", "models"]
