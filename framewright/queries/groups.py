"""Group summaries, cards, rankings and chart aggregates."""

from pyspark.sql import functions as F

from framewright.operators import aggregate as a, charts as c
from framewright.queries.profile_sql import number_sql
from framewright.queries.registry import Tables, hu, query

REVENUE = "l_extendedprice*(1-l_discount)"


@query("group_summary", f"""select l_returnflag as category, {hu('sum(l_extendedprice)', 2)} as sum,
  {hu('avg(l_extendedprice)', 2)} as mean, {hu('median(l_extendedprice)', 2)} as median, count(*) as count,
  {hu('min(l_extendedprice)', 2)} as min, {hu('max(l_extendedprice)', 2)} as max,
  {hu('sum(l_extendedprice)/(select sum(l_extendedprice) from lineitem)*100', 1)} as share_pct from lineitem group by 1""")
def _(t: Tables):
    return a.group_summary(t.lineitem, "l_returnflag", "l_extendedprice")


@query("group_summary_dirty", f"""select trim(note) as category, {hu('sum(cust_id)', 2)} as sum, {hu('avg(cust_id)', 2)} as mean,
  {hu('median(cust_id)', 2)} as median, count(*) as count, {hu('min(cust_id)', 2)} as min, {hu('max(cust_id)', 2)} as max,
  {hu('sum(cust_id)/(select sum(cust_id) from dirty_orders)*100', 1)} as share_pct
  from (select coalesce(note, 'Unknown') as note, cust_id from dirty_orders) group by 1""")
def _(t: Tables):
    return a.group_summary(t.dirty_orders, "note", "cust_id")


@query("group_agg_text_numbers", f"""select active as group_value, {hu('sum(v)', 2)} as value, count(*) as records
  from (select active, {number_sql('balance_text')} as v from dirty_customer) group by 1""")
def _(t: Tables):
    return a.group_agg(t.dirty_customer, "active", "balance_text")


for _agg in ("sum", "avg", "count", "min", "max", "median"):
    query(f"group_agg_{_agg}", f"""select o_orderpriority as group_value, {hu(_agg + '(o_totalprice)', 2)} as value,
      count(*) as records from orders group by 1""")(
        lambda t, agg=_agg: a.group_agg(t.orders, "o_orderpriority", "o_totalprice", agg)
    )


@query("chart_bar", f"""select p_brand as category, {hu('sum(p_retailprice)', 2)} as value, count(*) as records from part
  group by 1 order by 2 desc, 1 limit 10""")
def _(t: Tables):
    return c.bar(t.part, "p_brand", "p_retailprice", "sum", "desc", 10)


@query("chart_count_distinct", """select l_returnflag as category, count(distinct l_suppkey)::double as value,
  count(*) as records from lineitem group by 1""")
def _(t: Tables):
    return c.bar(t.lineitem, "l_returnflag", "l_suppkey", "count_distinct", "none")


@query("chart_multi_series", f"""select o_orderpriority as category,
  {hu("coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0)", 2)} as "F",
  {hu("coalesce(sum(o_totalprice) filter (where o_orderstatus = 'O'), 0)", 2)} as "O",
  {hu("coalesce(sum(o_totalprice) filter (where o_orderstatus = 'P'), 0)", 2)} as "P",
  {hu('sum(o_totalprice)', 2)} as total from orders group by 1""")
def _(t: Tables):
    return c.multi_series(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice")


@query("summary_table", f"""select p_brand as category, {hu('avg(p_retailprice)', 2)} as value, count(*) as records,
  {hu('avg(p_retailprice)*100/(select sum(v) from (select avg(p_retailprice) as v from part group by p_brand))', 1)} as pct
  from part group by 1""")
def _(t: Tables):
    return a.summary_table(t.part, "p_brand", "p_retailprice", "avg", "alpha")




@query("crosstab", """select o_orderpriority as row_value, o_orderstatus as column_value, count(*) as records,
  (sum(count(*)) over (partition by o_orderpriority))::bigint as row_total,
  (sum(count(*)) over (partition by o_orderstatus))::bigint as column_total from orders group by 1, 2""")
def _(t: Tables):
    return a.crosstab(t.orders, "o_orderpriority", "o_orderstatus")


@query("heatmap", f"""select p_brand as row_value, p_size::varchar as column_value, {hu('sum(p_retailprice)', 2)} as value
  from part group by 1, 2""")
def _(t: Tables):
    return a.heatmap(t.part, "p_brand", "p_size", "p_retailprice")


@query("heatmap_top", f"""with a as (select p_brand as v from part group by 1 order by count(*) desc, 1 limit 15),
  b as (select p_size::varchar as v from part group by 1 order by count(*) desc, 1 limit 15),
  x as (select case when p_brand in (from a) then p_brand else 'Other' end as r,
    case when p_size::varchar in (from b) then p_size::varchar else 'Other' end as s, sum(p_retailprice) as v from part group by 1, 2)
  select p.r as row_value, q.s as column_value, {hu('coalesce(x.v, 0)', 2)} as value
  from (select distinct r from x) p cross join (select distinct s from x) q left join x on x.r = p.r and x.s = q.s""")
def _(t: Tables):
    return a.heatmap(t.part, "p_brand", "p_size", "p_retailprice", 15)


@query("chart_multi_series_other", f"""with b as (select p_brand as v from part group by 1 order by count(*) desc, 1 limit 2)
  select p_type as category, {hu("coalesce(sum(p_retailprice) filter (where p_brand = (select min(v) from b)), 0)", 2)} as first,
  {hu("coalesce(sum(p_retailprice) filter (where p_brand = (select max(v) from b)), 0)", 2)} as second,
  {hu("coalesce(sum(p_retailprice) filter (where p_brand not in (from b)), 0)", 2)} as other_series,
  {hu('sum(p_retailprice)', 2)} as total from part group by 1""")
def _(t: Tables):
    return c.multi_series(t.part, "p_type", "p_brand", "p_retailprice", max_series=2).toDF(
        "category", "first", "second", "other_series", "total")


@query("chart_multi_series_means", f"""with b as (select p_brand as v from part group by 1 order by count(*) desc, 1 limit 2)
  select p_type as category, {hu("coalesce(avg(p_size) filter (where p_brand = (select min(v) from b)), 0)", 2)} as first,
  {hu("coalesce(avg(p_size) filter (where p_brand = (select max(v) from b)), 0)", 2)} as second,
  {hu("coalesce(avg(p_size) filter (where p_brand not in (from b)), 0)", 2)} as other_series,
  {hu('avg(p_size)', 2)} as total from part group by 1""")
def _(t: Tables):
    return c.multi_series(t.part, "p_type", "p_brand", "p_size", "avg", max_series=2).toDF("category", "first", "second", "other_series", "total")


@query("chart_multi_series_distinct", """select o_orderpriority as category,
  count(distinct o_custkey) filter (where o_orderstatus = 'F')::double as "F", count(distinct o_custkey) filter (where o_orderstatus = 'O')::double as "O",
  count(distinct o_custkey) filter (where o_orderstatus = 'P')::double as "P", count(distinct o_custkey)::double as total from orders group by 1""")
def _(t: Tables):
    return c.multi_series(t.orders, "o_orderpriority", "o_orderstatus", "o_custkey", "count_distinct")


@query("combo", f"""select o_orderpriority as category, {hu('sum(o_totalprice)', 2)} as first_value,
  {hu('avg(o_custkey)', 2)} as second_value from orders group by 1""")
def _(t: Tables):
    return a.combo(t.orders, "o_orderpriority", "o_totalprice", "o_custkey")


@query("kpi_card", f"""select {hu('median(l_extendedprice)', 2)} as value, {hu('min(l_extendedprice)', 2)} as min,
  {hu('max(l_extendedprice)', 2)} as max, {hu('avg(l_extendedprice)', 2)} as avg, count(*) as records from lineitem""")
def _(t: Tables):
    return a.kpi_card(t.lineitem, "l_extendedprice", "median")


@query("gauge", f"""select {hu('avg(l_quantity)', 2)} as value, 40.0::double as target, {hu('avg(l_quantity)/40*100', 1)} as
  pct_of_target, case when avg(l_quantity)/40*100 >= 85 then 'ON_TRACK' when avg(l_quantity)/40*100 >= 60 then 'AT_RISK'
  else 'BEHIND' end as status from lineitem""")
def _(t: Tables):
    return a.gauge(t.lineitem, "l_quantity", 40.0, "avg")


@query("kpi_half_split", f"""with n as (select o_totalprice as v, row_number() over (order by o_orderdate, o_orderkey) as r,
    count(*) over () // 2 as h from orders),
  s as (select sum(v) filter (where r <= h) as p, sum(v) filter (where r > h) as c, count(*) filter (where r <= h) as pn,
    count(*) filter (where r > h) as cn from n)
  select {hu('p', 2)} as previous, {hu('c', 2)} as current, {hu('(c-p)/abs(p)*100', 1)} as change_pct,
    pn as previous_records, cn as current_records from s""")
def _(t: Tables):
    return a.half_split(t.orders, "o_totalprice", "o_orderdate", ["o_orderkey"])


@query("business_kpis", f"""with b as (select sum({REVENUE}) as r, sum({REVENUE}) - sum(l_quantity*900) as p,
    count(distinct l_orderkey) as o from lineitem)
  select 'revenue' as kpi, {hu('r', 2)} as value from b union all select 'profit', {hu('p', 2)} from b
  union all select 'margin_pct', {hu('p/r*100', 2)} from b union all select 'orders', o::double from b
  union all select 'average_order_value', {hu('r/o', 2)} from b""")
def _(t: Tables):
    sales = t.lineitem.select(F.col("l_orderkey").alias("order_id"), F.expr(REVENUE).alias("revenue"),
                              F.expr(f"{REVENUE} - l_quantity*900").alias("profit"))
    return a.business_kpis(sales, **a.find_kpi_columns(sales))


@query("segment", f"""with s as (select c_mktsegment as segment, sum(c_acctbal) as x, avg(c_acctbal) as m,
    median(c_acctbal) as d, count(*) as count from customer group by 1)
  select segment, {hu('x', 2)} as total, {hu('m', 2)} as average, {hu('d', 2)} as median, count,
    {hu('x/(select sum(c_acctbal) from customer)*100', 1)} as share_pct,
    row_number() over (order by {hu('x', 2)} desc, segment) as rank from s""")
def _(t: Tables):
    return a.segments(t.customer, "c_mktsegment", "c_acctbal")


@query("top_bottom", f"""with s as (select p_brand as name, sum(p_retailprice) as v from part group by 1),
  r as (select *, row_number() over (order by v desc, name) as d, row_number() over (order by v, name desc) as u from s)
  select 'top' as side, d as rank, name, {hu('v', 2)} as value, {hu('v*100/(select sum(v) from s)', 1)} as share_pct from r
  where d <= 5 union all select 'bottom', u, name, {hu('v', 2)}, {hu('v*100/(select sum(v) from s)', 1)} from r where u <= 5
  """)
def _(t: Tables):
    return a.top_bottom(t.part, "p_brand", "p_retailprice", 5)


@query("driver_share", f"""with s as (select l_returnflag as factor, sum(l_extendedprice) as v, count(*) as n from lineitem
    group by 1), f as (select sum(v) as t, avg(v) as m from s)
  select factor, {hu('v', 2)} as value, n as records, {hu('v/t*100', 1)} as share_pct, {hu('v-m', 2)} as delta_from_mean,
    case when v/t*100 > 25 then 'MAJOR' when v/t*100 > 10 then 'MODERATE' else 'MINOR' end as significance from s, f""")
def _(t: Tables):
    return a.driver_share(t.lineitem, "l_returnflag", "l_extendedprice")


BOX = """with v as ({src}),
  g as (select category, min(x) as lo, max(x) as hi, avg(x) as m, count(*) as n, quantile_cont(x, 0.25) as q1,
    median(x) as q2, quantile_cont(x, 0.75) as q3 from v group by 1),
  f as (select *, greatest(lo, q1-1.5*(q3-q1)) as low, least(hi, q3+1.5*(q3-q1)) as high from g),
  o as (select category, count(*) filter (where x < low or x > high) as outliers from v join f using (category) group by 1)
  select category, {lo} as min, {q1} as q1, {q2} as median, {q3} as q3, {hi} as max, {m} as mean, {iqr} as iqr,
    {low} as low, {high} as high, outliers, n as count from f join o using (category) {tail}"""
_ROUND = {"lo": hu("lo", 2), "q1": hu("q1", 2), "q2": hu("q2", 2), "q3": hu("q3", 2), "hi": hu("hi", 2), "m": hu("m", 2),
          "iqr": hu("q3-q1", 2), "low": hu("low", 2), "high": hu("high", 2)}


@query("box_plot", BOX.format(src="select status as category, price as x from dirty_orders where price is not null",
                              tail="", **_ROUND))
def _(t: Tables):
    return c.box_plot(t.dirty_orders, "price", "status")


@query("box_top_groups", BOX.format(src="select p_brand as category, p_retailprice as x from part",
                                    tail=f"where n >= 2 order by {hu('q2', 2)} desc, category limit 8", **_ROUND))
def _(t: Tables):
    return c.box_top_groups(t.part, "p_retailprice", "p_brand", 8)


def histogram_sql(source: str, x: str, bins: str) -> str:
    return f"""with f as (select min({x}) as lo, max({x}) as hi, count({x}) as n, {bins} as bins from {source}),
  w as (select *, case when hi > lo then (hi-lo)/bins else 1.0 end as width from f),
  h as (select least(floor(({x}-lo)/width), bins-1)::bigint as bin, count(*) as records from {source}, w
    where {x} is not null group by 1),
  s as (select *, unnest(generate_series(0, bins::bigint-1)) as bin from w)
  select s.bin::bigint as bin, {hu('lo+s.bin*width', 2)} as bin_min,
    {hu('case when s.bin = bins-1 then hi else lo+(s.bin+1)*width end', 2)} as bin_max,
    coalesce(records, 0)::bigint as records, {hu('coalesce(records, 0)*100/n', 2)} as pct
  from s left join h on h.bin = s.bin"""


@query("histogram", histogram_sql("lineitem", "l_extendedprice", "greatest(5, least(15, ceil(sqrt(count(l_extendedprice)))))"))
def _(t: Tables):
    return c.histogram(t.lineitem, "l_extendedprice")


@query("histogram_modal_bin", histogram_sql("events", "value", "greatest(5, least(12, floor(sqrt(count(value))+0.5)))")
       + " order by records desc, bin limit 1")
def _(t: Tables):
    return c.modal_bin(t.events, "value")


FUNNEL = f"""with s as (select event_type as name, count(*)::double as value from events group by 1),
  w as (select *, row_number() over o as step, lag(value) over o as p, first_value(value) over o as f from s
    window o as (order by value desc, name))
  select step, name, value, {hu('value/f*100', 1)} as pct_of_top, {hu('coalesce(value/p*100, 100)', 1)} as step_conversion,
    {hu('100-' + hu('coalesce(value/p*100, 100)', 1), 1)} as drop_off from w"""


@query("funnel", FUNNEL)
def _(t: Tables):
    return c.funnel(t.events, "event_type")


@query("funnel_headline", f"""with x as ({FUNNEL}) select count(*) as stages, arg_min(value, step) as first_value,
  arg_max(value, step) as last_value, {hu('arg_max(value, step)*100/arg_min(value, step)', 1)} as retention_pct,
  arg_max(name, (drop_off, name)) filter (where step > 1) as worst_stage, max(drop_off) filter (where step > 1) as worst_drop
  from x""")
def _(t: Tables):
    return c.funnel_headline(c.funnel(t.events, "event_type"))


WATERFALL = f"""with s as (select n_name as name, {hu('sum(c_acctbal)', 2)} as v from customer join nation
    on c_nationkey = n_nationkey group by 1),
  w as (select *, row_number() over (order by name) as step, sum(v) over (order by name) as r from s)
  select step, name, v as delta, {hu('case when v >= 0 then r-v else r end', 2)} as base, {hu('r', 2)} as cumulative,
    false as is_total from w
  union all select count(*)+1, 'Net Total', {hu('sum(v)', 2)}, 0.0::double, {hu('sum(v)', 2)}, true from s"""


def balances(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))


@query("waterfall", WATERFALL)
def _(t: Tables):
    return c.waterfall(balances(t), "n_name", "c_acctbal")


@query("waterfall_headline", f"""with x as ({WATERFALL}) select count(*) filter (where not is_total) as steps,
  max(delta) filter (where is_total) as net, arg_max(name, (delta, name)) filter (where not is_total) as best_step,
  max(delta) filter (where not is_total) as best_delta, arg_min(name, (delta, name)) filter (where not is_total) as worst_step,
  min(delta) filter (where not is_total) as worst_delta from x""")
def _(t: Tables):
    return c.bridge_headline(c.waterfall(balances(t), "n_name", "c_acctbal"))


@query("scatter", """with n as (select *, row_number() over (order by p_partkey) as r, greatest(1, count(*) over () // 500) as k
  from part) select p_partkey, p_size::double as x, p_retailprice as y, p_brand as series from n where (r-1) % k = 0""")
def _(t: Tables):
    return c.scatter(t.part, "p_size", "p_retailprice", ["p_partkey"], "p_brand")


@query("bubble", """with n as (select *, row_number() over (order by o_orderkey) as r, greatest(1, count(*) over () // 500) as k
  from orders) select o_orderkey, o_custkey::double as x, o_totalprice as y,
  greatest(20.0, least(600.0, o_totalprice/500))::double as size from n where (r-1) % k = 0""")
def _(t: Tables):
    src = t.orders.withColumn("size_of", F.col("o_totalprice") / 500)
    return c.bubble(src, "o_custkey", "o_totalprice", "size_of", ["o_orderkey"])


@query("chart_headline", f"""with s as (select p_brand as category, {hu('sum(p_retailprice)', 2)} as value from part group by 1),
  f as (select sum(value) as t, avg(value) as m from s)
  select count(*) as items, {hu('max(t)', 2)} as total, {hu('max(m)', 2)} as mean, arg_min(category, (-value, category)) as
    top_item, max(value) as top_value, arg_max(category, (-value, category)) as bottom_item, min(value) as bottom_value,
    {hu('max(value)*100/max(t)', 1)} as top_pct,
    {hu('(select sum(value) from (select value from s order by value desc, category limit 3))*100/max(t)', 1)} as top3_pct,
    count(*) filter (where value >= m) as at_or_above_mean from s, f""")
def _(t: Tables):
    return c.headline(c.bar(t.part, "p_brand", "p_retailprice", sort="none"))
