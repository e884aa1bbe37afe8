"""Drivers, insights, recommendations, reports and chart dispatch."""

from pyspark.sql import functions as F

from framewright.functions.numbers import compact
from framewright.operators import charts as c, drivers as d, insights as i, keys as k, profile as p, temporal as tm
from framewright.plans.analysis import run_plan
from framewright.plans.charts import ChartSpec, chart_data, dashboard_rows
from framewright.queries.calendar import points_sql, running_sql
from framewright.queries.profile_sql import audit_ctes, facts_ctes
from framewright.queries.registry import Tables, hu, query

MID = """days as (select distinct o_orderdate as d from orders), mid as (select d as m from days order by d limit 1
    offset (select count(*)//2 from days)),
  h as (select *, o_orderdate >= m as cur from orders, mid)"""


@query("driver_totals", f"""with {MID}, s as (select sum(o_totalprice) filter (where not cur) as b,
    sum(o_totalprice) filter (where cur) as c from h)
  select {hu('b', 2)} as baseline_total, {hu('c', 2)} as current_total, {hu('c-b', 2)} as total_delta,
    {hu('(c-b)/b*100', 1)} as delta_pct from s""")
def _(t: Tables):
    return d.driver_totals(t.orders, "o_totalprice", "o_orderdate")


@query("driver_delta", f"""with {MID}, l as (select 'o_orderstatus' as dimension, o_orderstatus as factor, cur, o_totalprice as v from h
    union all select 'o_orderpriority', o_orderpriority, cur, o_totalprice from h),
  t as (select sum(case when cur then v else -v end) as gap from l where dimension = 'o_orderstatus'),
  s as (select dimension, factor, coalesce(sum(v) filter (where not cur), 0) as b, coalesce(sum(v) filter (where cur), 0) as c
    from l group by 1, 2), x as (select *, (c-b)/abs(gap)*100 as share from s, t)
  select dimension, factor, {hu('b', 2)} as baseline, {hu('c', 2)} as current, {hu('c-b', 2)} as delta,
    {hu('share', 1)} as contribution_pct, case when c > b then 'favorable' else 'unfavorable' end as direction,
    case when abs(share) > 20 then 'MAJOR' when abs(share) > 8 then 'MODERATE' else 'MINOR' end as significance
  from x where abs(c-b) > 0.001 order by abs({hu('c-b', 2)}) desc, dimension, factor limit 10""")
def _(t: Tables):
    return d.driver_delta(t.orders, "o_totalprice", "o_orderdate", ["o_orderstatus", "o_orderpriority"], top=10)


@query("metric_decomposition", f"""with f as (select count(*) as n, sum(o_totalprice) as s from orders)
  select 'total' as part, {hu('s', 2)} as value from f union all select 'volume', n::double from f
  union all select 'average_value', {hu('s/n', 2)} from f""")
def _(t: Tables):
    return d.decompose_volume(t.orders, "o_totalprice")


@query("profit_decomposition", f"""with f as (select sum(l_extendedprice) as r, sum(l_extendedprice*l_discount) as c from lineitem),
  v as (select 'profit' as part, {hu('r-c', 2)} as value from f union all select 'l_extendedprice', {hu('r', 2)} from f
    union all select 'cost', {hu('c', 2)} from f)
  select part, value, {hu('value*100/(select r from f)', 1)} as pct_of_revenue from v""")
def _(t: Tables):
    return d.decompose_profit(t.lineitem.withColumn("cost", F.col("l_extendedprice") * F.col("l_discount")), "l_extendedprice", "cost")


def sales(t: Tables):
    return t.orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("state"),
                           F.col("o_orderpriority").alias("channel"), F.col("o_totalprice").alias("revenue"),
                           (F.col("o_totalprice") * 0.2 + F.col("o_custkey")).alias("profit"), F.col("o_orderdate").alias("order_date"))


SALES = """sales as (select o_orderkey as order_id, o_orderstatus as state, o_orderpriority as channel, o_totalprice as revenue,
  o_totalprice*0.2::double+o_custkey as profit, o_orderdate as order_date from orders)"""


@query("insights", f"""with {SALES}, g as (select state, sum(revenue) as s from sales group by 1), t as (select sum(s) as t from g),
  c as (select 'order_id & revenue' as p, {hu('corr(order_id, revenue)', 3)} as r, 1 as o from sales union all
    select 'order_id & profit', {hu('corr(order_id, profit)', 3)}, 0 from sales union all
    select 'revenue & profit', {hu('corr(revenue, profit)', 3)}, 2 from sales)
  select * from (select 'leading_segment' as insight, state as subject, 'revenue' as metric, {hu('s*100/t', 1)} as value,
    'POSITIVE' as impact, 96::bigint as confidence from g, t order by s desc, state limit 1)
  union all select * from (select 'weakest_segment', state, 'revenue', {hu('s*100/t', 1)}, 'WARNING', 94 from g, t
    order by s, state desc limit 1)
  union all select * from (select 'strongest_pair', p, 'pearson_r', r, 'NEUTRAL', 92 from c where abs(r) >= 0.4 and abs(r) < 0.999
    order by abs(r) desc, p limit 1)
  union all select 'time_coverage', concat(strftime(min(order_date), '%Y-%m-%d'), ' to ', strftime(max(order_date), '%Y-%m-%d')),
    'order_date', datediff('day', min(order_date), max(order_date))::double, 'POSITIVE', 94 from sales
  union all select 'entity_diversity', 'order_id', 'distinct', count(distinct order_id)::double, 'POSITIVE', 90 from sales""")
def _(t: Tables):
    return i.dataset_insights(p.profile(sales(t)))


@query("dataset_insights_dirty")
def _(t: Tables):
    return i.dataset_insights(p.profile(t.dirty_customer))


@query("eda_insights_dirty")
def _(t: Tables):
    return i.eda_insights(p.profile(t.dirty_customer))


@query("recommended_analyses", """select * from (values ('segment_comparison', 'Diagnostic', 'bar', 'state,order_id'),
  ('correlation_and_regression', 'Predictive', 'scatter', 'order_id,revenue,profit'),
  ('time_series', 'Descriptive', 'line', 'order_date,order_id'), ('cross_tabulation', 'Diagnostic', 'bar', 'state,channel'))
  v(analysis, category, chart, columns)""")
def _(t: Tables):
    return i.recommended_analyses(p.profile(sales(t)))


@query("eda_insights", f"""with {SALES}, g as (select state, sum(revenue) as s from sales group by 1),
  y as (select year(order_date) as y, {hu('sum(revenue)', 2)} as v from sales group by 1),
  e as (select {hu('(arg_max(v, y)-arg_min(v, y))/arg_min(v, y)*100', 1)} as g from y),
  ch as (select {hu('(v-lag(v) over (order by y))/abs(lag(v) over (order by y))*100', 1)} as c from y),
  m as (select {hu('avg(c)', 1)} as a from ch),
  k as (select {hu(hu('sum(profit)/sum(revenue)*100', 2), 1)} as mg from sales)
  select * from (select 'concentration' as insight, state as subject, 'revenue' as metric, {hu('s*100/(select sum(s) from g)', 1)}
    as value, case when s*100/(select sum(s) from g) > 40 then 'WARNING' else 'POSITIVE' end as impact, 96::bigint as confidence
    from g order by s desc, state limit 1)
  union all select * from (select 'correlation', 'revenue & profit', case when {hu('corr(revenue, profit)', 3)} >= 0.8 then 'Very Strong'
    else '?' end, {hu('corr(revenue, profit)', 3)}, 'POSITIVE', 92 from sales)
  union all select 'trend', case when g > 10 then 'GROWING' when g < -10 then 'DECLINING' when abs(a) > 25 then 'VOLATILE' else
    'STABLE' end, 'revenue', g, case when g >= 0 then 'POSITIVE' else 'NEGATIVE' end, 94 from e, m
  union all select 'margin', 'profit', 'margin_pct', mg, case when mg >= 15 then 'POSITIVE' else 'WARNING' end, 90 from k""")
def _(t: Tables):
    return i.eda_insights(p.profile(sales(t)))


@query("chart_recommend", """select * from (values ('trend', 'line', 'order_date', 'revenue', null, 'sum'),
  ('category_breakdown', 'bar', 'state', 'revenue', null, 'sum'), ('grouped_breakdown', 'bar', 'state', 'revenue', 'channel', 'sum'),
  ('scatter', 'scatter', 'order_id', 'revenue', 'state', null), ('distribution', 'histogram', 'revenue', null, null, null),
  ('proportion', 'donut', 'state', 'order_id', null, 'sum')) v(chart, type, x, y, series, agg)""")
def _(t: Tables):
    return i.recommend_charts(p.profile(sales(t)))


@query("dashboard_insights", f"""with b as (select o_orderpriority as c, {hu('sum(o_totalprice)', 2)} as v from orders group by 1),
  r as (select *, row_number() over (order by v desc, c) as n, sum(v) over () as t from b),
  l as (select strftime(o_orderdate, '%Y') as y, {hu('sum(o_totalprice)', 2)} as v from orders group by 1),
  e as (select min(y) as a, max(y) as z, {hu('(arg_max(v, y)-arg_min(v, y))/arg_min(v, y)*100', 1)} as g from l)
  select 'trend' as insight, concat(a, ' to ', z) as subject, 'change_pct' as metric, g as value,
    case when g >= 0 then 'POSITIVE' else 'NEGATIVE' end as impact, 95::bigint as confidence from e
  union all select 'contribution', c, 'share_pct', {hu('v*100/t', 1)}, 'POSITIVE', 96 from r where n = 1
  union all select 'comparison', concat(x.c, ' vs ', y.c), 'ahead_pct', {hu('(x.v-y.v)/y.v*100', 1)}, 'NEUTRAL', 94
    from r x, r y where x.n = 1 and y.n = 2
  union all select 'correlation', 'x & y', 'pearson_r', {hu('corr(p_partkey, p_retailprice)', 2)}, 'NEUTRAL', 92 from part
    having abs(corr(p_partkey, p_retailprice)) >= 0.4""")
def _(t: Tables):
    line = tm.periods(t.orders, "o_orderdate", "o_totalprice", "sum", "yearly")
    points = t.part.select(F.col("p_partkey").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return i.dashboard_insights(c.bar(t.orders, "o_orderpriority", "o_totalprice"), line, points)


@query("report_overview", f"""with {audit_ctes('dirty_customer')} select (select max(total) from facts)::bigint as rows, 7::bigint as columns,
  (select count(*) filter (where type = 'numeric') from facts) as numeric_columns,
  (select count(*) filter (where type = 'categorical') from facts) as categorical_columns,
  (select count(*) filter (where type = 'datetime') from facts) as date_columns, missing_cells,
  {hu('missing_cells*100/(total*7)', 2)} as missing_pct, duplicate_rows, score, case when score >= 90 then 'EXCELLENT'
    when score >= 75 then 'GOOD' when score >= 50 then 'NEEDS ATTENTION' else 'CRITICAL ISSUES' end as rating from scored""")
def _(t: Tables):
    return i.report_overview(p.profile(t.dirty_customer))


@query("report_dictionary", f"""with {facts_ctes('dirty_customer')} select c as "column", type, case c when 'customer_id' then 'identifier'
  when 'customer_name' then 'identifier' when 'balance_text' then 'currency' when 'age' then 'numeric_continuous'
  when 'segment' then 'categorical_nominal' when 'country' then 'geographic' else 'boolean' end as semantic_type,
  case c when 'customer_id' then 'identifier' when 'customer_name' then 'identifier' when 'balance_text' then 'measure'
  when 'age' then 'measure' when 'active' then 'feature' else 'dimension' end as suggested_role, 100-null_pct as complete_pct,
  distinct_n as "distinct", top_value as example from facts""")
def _(t: Tables):
    return i.report_dictionary(p.profile(t.dirty_customer))


@query("report_checks", """select * from (values ('row_count', true), ('quality_score', true), ('column_count', true),
  ('dictionary_complete', true)) v("check", passed)""")
def _(t: Tables):
    profile = p.profile(t.dirty_customer)
    return i.report_checks(profile, i.report_tables(profile))


@query("workspace_quality")
def _(t: Tables):
    tables = {"customers": t.dirty_customer, "orders": t.dirty_orders}
    links = k.discover_relationships({"customer": t.customer.select("c_custkey"), "orders": t.orders.select("o_custkey")})
    return i.workspace_quality(tables, links)


@query("chart_dispatch_bar", f"""with b as (select o_orderpriority as category, {hu('avg(o_totalprice)', 2)} as value, count(*) as records
    from orders where lower(o_orderstatus) <> 'p' and o_totalprice > 50000 group by 1)
  select *, {hu('(select avg(value) from b)', 2)} as reference from b""")
def _(t: Tables):
    return chart_data(t.orders, ChartSpec("donut", "o_orderpriority", "o_totalprice", agg="mean", reference_line="mean", filters=(
        ("o_orderstatus", "not_equals", "P"), ("o_totalprice", "greater_than", 50000))))


@query("chart_dispatch_line", running_sql(points_sql("orders", "o_orderdate", "max(o_totalprice)", "quarterly"), 2))
def _(t: Tables):
    out = chart_data(t.orders, ChartSpec("line", "o_orderdate", "o_totalprice", agg="max"))
    return out.select("period", "value", "records", "growth_pct", "cumulative", "moving_avg")


@query("chart_dispatch_median_line", f"""with b as (select p_brand as category, {hu('sum(p_retailprice)', 2)} as value, count(*) as records
    from part group by 1) select *, {hu('(select median(value) from b)', 2)} as reference from b""")
def _(t: Tables):
    return chart_data(t.part, ChartSpec("treemap", "p_brand", "p_retailprice", reference_line="median"))


@query("chart_dispatch_all")
def _(t: Tables):
    """Row count of every chart type over orders."""
    from framewright.plans.charts import CHARTS

    parts = []
    for kind in CHARTS:
        spec = ChartSpec(kind, "o_orderpriority", "o_totalprice", "o_orderstatus" if kind in ("heatmap",) else None, target=1e6)
        if kind in ("scatter", "bubble"):
            spec = ChartSpec(kind, "o_custkey", "o_totalprice", "o_custkey" if kind == "bubble" else None, order_by=("o_orderkey",))
        if kind == "composed":
            spec = ChartSpec(kind, "o_orderpriority", "o_totalprice", "o_custkey")
        parts.append(chart_data(t.orders, spec).agg(F.count("*").alias("rows")).select(F.lit(kind).alias("chart"), "rows"))
    return i.union(parts)


@query("plan_ranking", f"""with s as (select l_linestatus as name, sum(l_quantity) as v from lineitem group by 1),
  r as (select *, row_number() over (order by v desc, name) as d, row_number() over (order by v, name desc) as u from s)
  select 'top' as side, d as rank, name, {hu('v', 2)} as value, {hu('v*100/(select sum(v) from s)', 1)} as share_pct from r
  union all select 'bottom', u, name, {hu('v', 2)}, {hu('v*100/(select sum(v) from s)', 1)} from r""")
def _(t: Tables):
    return run_plan(t.lineitem, "RANKING", "l_quantity", "l_linestatus")


@query("compact_numbers", f"""select o_orderkey, case when o_totalprice >= 1000
  then concat('$', printf('%.1f', {hu('o_totalprice/1000', 1)}), 'k')
  else concat('$', printf('%.2f', {hu('o_totalprice', 2)})) end as shown from orders""")
def _(t: Tables):
    return t.orders.select("o_orderkey", compact(F.col("o_totalprice"), "$").alias("shown"))




@query("dashboard_rows", """select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 100000
  and o_orderdate >= date_trunc('year', (select max(o_orderdate) from orders where o_orderstatus = 'F' and o_totalprice > 100000))""")
def _(t: Tables):
    rows = dashboard_rows(t.orders, {"o_orderstatus": "F", "o_orderpriority": "ALL"}, (("o_totalprice", "greater_than", 100000),),
                          "o_orderdate", "this_year")
    return rows.select("o_orderkey", "o_totalprice")
