"""Joins and their reports."""

from pyspark.sql import functions as F

from framewright.operators import joins as j
from framewright.queries.registry import Tables, hu, query


def big_customers(t: Tables):
    return t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("cust_id"), "c_name", "c_mktsegment")


def late_orders(t: Tables):
    return t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("cust_id"), "o_orderkey", "o_totalprice")


SIDES = """with l as (select o_custkey as cust_id, o_orderkey, o_totalprice from orders where o_totalprice > 200000),
  r as (select c_custkey as cust_id, c_name, c_mktsegment from customer where c_acctbal > 5000) """
for _how, _sql in (("inner", "join"), ("left", "left join"), ("right", "right join"), ("full", "full join")):
    query(f"join_{_how}", SIDES + f"""select coalesce(l.cust_id, r.cust_id) as cust_id, o_orderkey, o_totalprice, c_name,
      c_mktsegment from l {_sql} r on l.cust_id = r.cust_id""")(
        lambda t, how=_how: j.safe_join(late_orders(t), big_customers(t), "cust_id", "cust_id", how)
    )


@query("join_inner_whole", """select l_orderkey as order_id, l_linenumber, l_extendedprice, o_custkey, o_totalprice
  from lineitem join orders on l_orderkey = o_orderkey""")
def _(t: Tables):
    lines = t.lineitem.select(F.col("l_orderkey").alias("order_id"), "l_linenumber", "l_extendedprice")
    return j.safe_join(lines, t.orders.select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_totalprice"), "order_id", "order_id")


@query("join_text_key", """select a.n_name as left_n_name, b.n_name as right_n_name, a.n_nationkey as left_n_nationkey,
  b.n_nationkey as right_n_nationkey from (select concat(' ', lower(n_name)) as k, n_name, n_nationkey from nation) a
  join (select upper(n_name) as k2, n_name, n_nationkey from nation) b on lower(trim(a.k)) = lower(trim(b.k2))""")
def _(t: Tables):
    a = t.nation.select(F.concat(F.lit(" "), F.lower("n_name")).alias("k"), "n_name", "n_nationkey")
    b = t.nation.select(F.upper("n_name").alias("k2"), "n_name", "n_nationkey")
    return j.safe_join(a, b, "k", "k2").drop("k", "k2")


@query("join_preview", f"""with l as (select o_custkey as k, count(*) as n from orders group by 1),
  r as (select c_custkey as k, count(*) as m from customer where c_acctbal > 0 group by 1),
  b as (select sum(n*m) as pairs, sum(n) as ml, sum(m) as mr from l join r using (k)),
  z as (select *, (select count(*) from orders) as lr, (select count(*) from customer where c_acctbal > 0) as rr from b)
  select lr::bigint as left_rows, rr::bigint as right_rows, ml::bigint as matched_left, (lr-ml)::bigint as unmatched_left,
    mr::bigint as matched_right, (rr-mr)::bigint as unmatched_right, pairs::bigint as output_rows,
    {hu('pairs/greatest(1, lr, rr)', 2)} as factor, pairs/greatest(1, lr, rr) > 2.5 and pairs > 5000 as dangerous,
    concat_ws(',', case when pairs/greatest(1, lr, rr) > 2 then 'multiplication' end,
      case when lr > ml then 'left_rows_dropped' end, case when rr > mr then 'right_rows_unmatched' end) as warnings
  from z""")
def _(t: Tables):
    return j.join_preview(t.orders, t.customer.where("c_acctbal > 0"), "o_custkey", "c_custkey")


@query("join_preview_full", f"""with l as (select l_partkey as k, count(*) as n from lineitem group by 1),
  r as (select l_suppkey as k, count(*) as m from lineitem group by 1),
  f as (select coalesce(sum(n*m), 0) as pairs, coalesce(sum(case when m is not null then n end), 0) as ml,
    coalesce(sum(case when n is not null then m end), 0) as mr from l full join r using (k)),
  z as (select *, (select count(*) from lineitem) as lr, (select count(*) from lineitem) as rr from f),
  y as (select *, pairs + lr - ml + rr - mr as o from z)
  select lr::bigint as left_rows, rr::bigint as right_rows, ml::bigint as matched_left, (lr-ml)::bigint as unmatched_left,
    mr::bigint as matched_right, (rr-mr)::bigint as unmatched_right, o::bigint as output_rows,
    {hu('o/greatest(1, lr, rr)', 2)} as factor, o/greatest(1, lr, rr) > 2.5 and o > 5000 as dangerous,
    case when o/greatest(1, lr, rr) > 2 then 'multiplication' else '' end as warnings from y""")
def _(t: Tables):
    return j.join_preview(t.lineitem, t.lineitem, "l_partkey", "l_suppkey", "full")


@query("join_unmatched", """select c_custkey, c_name from customer
  where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)""")
def _(t: Tables):
    return j.unmatched(t.customer, t.orders.where("o_totalprice > 200000"), "c_custkey", "o_custkey").select(
        "c_custkey", "c_name"
    )


@query("join_matched", """select c_custkey, c_name from customer
  where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 200000)""")
def _(t: Tables):
    return j.matched(t.customer, t.orders.where("o_totalprice > 200000"), "c_custkey", "o_custkey").select(
        "c_custkey", "c_name"
    )


@query("join_by_name", """select o_orderkey, o_custkey as custkey, c_name from orders left join customer on o_custkey = c_custkey""")
def _(t: Tables):
    """Without a stored relationship: the join that the column names suggest."""
    left = t.orders.select("o_orderkey", F.col("o_custkey").alias("custkey"))
    right = t.customer.select(F.col("c_custkey").alias("CustKey"), "c_name")
    found = j.recommend_by_name(left, right)
    return j.safe_join(left, right, found["left_key"], found["right_key"], found["join_type"].lower()).select(
        "o_orderkey", "custkey", "c_name")
