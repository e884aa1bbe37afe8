"""Monthly revenue per market segment with growth, running total and three-month average."""

from pyspark.sql import functions as F

from framewright.operators.joins import safe_join
from framewright.operators.temporal import periods, with_running
from framewright.queries.registry import Tables, hu, query


def segment_revenue(t: Tables):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")
    )
    orders = t.orders.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("cust_id"), "o_orderdate"
    )
    customers = t.customer.select(F.col("c_custkey").alias("cust_id"), F.col("c_mktsegment").alias("segment"))
    bought = safe_join(orders, customers, "cust_id", "cust_id").drop("cust_id")
    joined = safe_join(lines, bought, "order_id", "order_id")
    points = periods(joined, "o_orderdate", "revenue", "sum", "monthly", ["segment"])
    out = with_running(points, "monthly", 3, ["segment"])
    return out.select("segment", "period", "value", "records", "growth_pct", "cumulative", "moving_avg")


query("segment_revenue", f"""
with m as (
  select c_mktsegment as segment, strftime(o_orderdate, '%Y-%m') as period,
         {hu('sum(l_extendedprice*(1-l_discount))', 2)} as value, count(*) as records
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by 1, 2),
w as (select *, lag(value) over (partition by segment order by period) as p,
  count(*) over (partition by segment order by period rows 2 preceding) as c,
  avg(value) over (partition by segment order by period rows 2 preceding) as a,
  sum(value) over (partition by segment order by period) as s from m)
select segment, period, value, records, {hu('(value-p)/abs(p)*100', 1)} as growth_pct, {hu('s', 2)} as cumulative,
  case when c = 3 then {hu('a', 2)} end as moving_avg from w""")(segment_revenue)
