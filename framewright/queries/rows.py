"""Filters, searches, samples and pages."""


from functools import reduce

from pyspark.sql import functions as F

from framewright.operators import filters as f
from framewright.queries.registry import Tables, query

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, l_linestatus"


def line_columns(df):
    return df.select(*[c.strip() for c in LINE.split(",")])


@query("filter_eq", f"select {LINE} from lineitem where lower(l_returnflag) = 'r'")
def _(t: Tables):
    return line_columns(f.filter_rows(t.lineitem, "l_returnflag", "eq", "r"))


@query("filter_compare", f"select {LINE} from lineitem where l_quantity >= 45 and l_extendedprice < 60000")
def _(t: Tables):
    return line_columns(f.filter_all(t.lineitem, [("l_quantity", "gte", 45), ("l_extendedprice", "lt", 60000)]))


# Keys that doubles cannot tell apart, and decimals of 20 digits.
BIG = "o_orderkey + 9007199254740992 as big, (o_orderkey + 9007199254740992)::decimal(20,0) as exact, o_orderkey"


@query("filter_exact_numbers", f"""with b as (select {BIG} from orders)
  select 'gt' as test, o_orderkey from b where big > 9007199254740995 union all select 'lte', o_orderkey from b where big <= 9007199254740999
  union all select 'lt', o_orderkey from b where big < 9007199254741003 union all select 'gte', o_orderkey from b where exact >= 9007199254741001
  union all select 'in', o_orderkey from b where big in (9007199254740993, 9007199254740994)
  union all select 'eq', o_orderkey from b where exact = 9007199254740997 union all select 'half', o_orderkey from b where big > 9007199254740994""")
def _(t: Tables):
    """Limits next to each other above 2**53, on long and decimal keys."""
    big = F.col("o_orderkey") + F.lit(2**53)
    rows = t.orders.select(big.alias("big"), big.cast("decimal(20,0)").alias("exact"), "o_orderkey")
    tests = [("gt", "big", "gt", "9007199254740995"), ("lte", "big", "lte", 9007199254740999), ("lt", "big", "lt", "9007199254741003"),
             ("gte", "exact", "gte", "9007199254741001"), ("in", "big", "in", "9007199254740993, 9007199254740994"),
             ("eq", "exact", "eq", 9007199254740997), ("half", "big", "gt", "9007199254740994.5")]
    parts = [f.filter_rows(rows, c, op, v).select(F.lit(n).alias("test"), "o_orderkey") for n, c, op, v in tests]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("filter_date", "select o_orderkey, o_orderpriority from orders where o_orderdate > timestamp '1998-01-01'")
def _(t: Tables):
    return f.filter_rows(t.orders, "o_orderdate", "gt", "1998-01-01").select("o_orderkey", "o_orderpriority")


@query("filter_in", """select o_orderkey, o_orderpriority from orders
  where lower(o_orderpriority) in ('1-urgent', '2-high')""")
def _(t: Tables):
    return f.filter_rows(t.orders, "o_orderpriority", "in", "1-URGENT, 2-high").select("o_orderkey", "o_orderpriority")


@query("filter_contains_hit", "select p_partkey, p_name, p_type from part where contains(lower(p_type), 'promo')")
def _(t: Tables):
    return f.filter_rows(t.part, "p_type", "contains", "Promo").select("p_partkey", "p_name", "p_type")


@query("filter_contains", "select p_partkey, p_name, p_type from part where contains(lower(p_type), 'brass')")
def _(t: Tables):
    return f.filter_rows(t.part, "p_type", "contains", "BRASS").select("p_partkey", "p_name", "p_type")


@query("filter_not_equals", """select o_orderkey, o_orderstatus from orders
  where lower(o_orderstatus) <> 'f' and contains(lower(o_orderpriority), 'high')""")
def _(t: Tables):
    kept = f.filter_all(t.orders, [("o_orderstatus", "neq", "F"), ("o_orderpriority", "contains", "high"),
                                   ("o_totalprice", "gt", None)])
    return kept.select("o_orderkey", "o_orderstatus")


@query("filter_share", """select count(*) filter (where l_quantity > 30)::bigint as matched, count(*)::bigint as total,
  100.0::double * count(*) filter (where l_quantity > 30) / count(*) as match_pct from lineitem""")
def _(t: Tables):
    return f.filter_share(t.lineitem, "l_quantity", "gt", 30)


@query("slicer_filter", f"select {LINE} from lineitem where l_returnflag = 'R' and l_quantity > 10")
def _(t: Tables):
    return line_columns(f.slice_rows(t.lineitem, {"l_returnflag": "R", "l_linestatus": "ALL"}, [("l_quantity", "gt", 10)]))


@query("global_search", """select c_custkey, c_name from customer where (contains(lower(c_mktsegment), 'build')
  or contains(lower(c_name), 'build')) and contains(lower(c_name), '1')""")
def _(t: Tables):
    return f.search(t.customer.select("c_custkey", "c_name", "c_mktsegment"), "Build", {"c_name": "1"}).select(
        "c_custkey", "c_name"
    )


@query("rows_missing", "select order_id, status, price from dirty_orders where price is null")
def _(t: Tables):
    return f.rows_missing(t.dirty_orders.select("order_id", "status", "price"))


@query("rows_duplicate", """select order_id, status, priority, note from (select *, count(*) over
  (partition by order_id, cust_id, status, price, priority, order_date, store, note) as n from dirty_orders) where n > 1""")
def _(t: Tables):
    return f.rows_duplicate(t.dirty_orders).select("order_id", "status", "priority", "note")


FENCED = """{c} < q[1] - 1.5*(q[2]-q[1]) or {c} > q[2] + 1.5*(q[2]-q[1])"""


@query("rows_outlier", f"""with p as (select quantile_cont(price, [0.25, 0.75]) as q from dirty_orders)
  select order_id, price from dirty_orders, p where {FENCED.format(c='price')}""")
def _(t: Tables):
    return f.rows_outlier(t.dirty_orders.select("order_id", "price"), ["price"])


@query("columns_by_kind", "select l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def _(t: Tables):
    kept = f.columns_of_kind(t.lineitem, "number")
    return kept.drop("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("slicer_values_all", "select distinct p_name as value from part where trim(p_name) <> ''")
def _(t: Tables):
    return f.slicer_values(t.part, "p_name")


@query("slicer_values", "select distinct p_brand as value from part where p_brand <> '' order by 1 limit 40")
def _(t: Tables):
    return f.slicer_values(t.part, "p_brand", 40)


@query("systematic_sample", """with n as (select *, row_number() over (order by l_orderkey, l_linenumber, l_quantity) as r,
  greatest(1, count(*) over () // 500) as k from lineitem) select l_orderkey, l_linenumber, l_quantity from n
  where (r - 1) % k = 0""")
def _(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return f.systematic_sample(rows, LINE_KEY, 500)


@query("sort_page", """select order_id, priority, price from dirty_orders
  order by price desc nulls last, order_id limit 25 offset 50""")
def _(t: Tables):
    return f.sort_page(t.dirty_orders, "price", ["order_id"], 3, 25, True).select("order_id", "priority", "price")


