"""Calendar periods, growth and trends."""

from pyspark.sql import functions as F

from framewright.operators import charts as c, temporal as p
from framewright.queries.registry import Tables, hu, query

KEYS = {
    "daily": "strftime({d}, '%Y-%m-%d')", "weekly": "strftime({d}, '%G-W%V')", "monthly": "strftime({d}, '%Y-%m')",
    "quarterly": "concat(year({d})::varchar, '-Q', quarter({d})::varchar)", "yearly": "year({d})::varchar",
}
LABELS = {
    "daily": "strftime({d}, '%-d %b %Y')", "weekly": "strftime({d}, 'W%V %G')", "monthly": "strftime({d}, '%b %Y')",
    "quarterly": "concat('Q', quarter({d})::varchar, ' ', year({d})::varchar)", "yearly": "year({d})::varchar",
}
UNITS = {"daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def points_sql(table: str, date: str, value: str, grain: str, where: str = "true") -> str:
    key, label = KEYS[grain].format(d=date), LABELS[grain].format(d=date)
    return f"""select {key} as period, max({label}) as label, date_trunc('{UNITS[grain]}', min({date}))::date as start,
      {hu(value, 2)} as value, count(*) as records from {table} where {where} group by 1"""


for _grain in UNITS:
    query(f"period_{_grain}", f"""select period, label, start::varchar as start, value, records from (
      {points_sql('orders', 'o_orderdate', 'sum(o_totalprice)', _grain)})""")(
        lambda t, g=_grain: p.periods(t.orders, "o_orderdate", "o_totalprice", "sum", g).selectExpr(
            "period", "label", "cast(period_start as string) as start", "value", "records")
    )
for _agg, _sql in (("avg", "avg"), ("median", "median"), ("min", "min"), ("max", "max")):
    query(f"temporal_{_agg}", f"""select period, value, records from (
      {points_sql('events', 'ts', f'{_sql}(value)', 'daily')})""")(
        lambda t, a=_agg: p.periods(t.events, "ts", "value", a, "daily").select("period", "value", "records")
    )


@query("temporal_count_distinct", f"""select period, value, records from (
  {points_sql('events', 'ts', 'count(distinct user_id)', 'weekly')})""")
def _(t: Tables):
    return p.periods(t.events, "ts", "user_id", "count_distinct", "weekly").select("period", "value", "records")


def running_sql(points: str, window: int) -> str:
    return f"""with m as ({points}), w as (select *, lag(value) over (order by period) as b,
      sum(value) over (order by period) as s, avg(value) over (order by period rows {window - 1} preceding) as a,
      count(*) over (order by period rows {window - 1} preceding) as c from m)
    select period, value, records, case when b = 0 then case when value > 0 then 100.0 else 0.0 end
      else {hu('(value-b)/abs(b)*100', 1)} end::double as growth_pct, {hu('s', 2)} as cumulative,
      case when c = {window} then {hu('a', 2)} end as moving_avg from w"""


RUNNING = ["period", "value", "records", "growth_pct", "cumulative", "moving_avg"]


@query("temporal_growth", running_sql(points_sql("orders", "o_orderdate", "sum(o_totalprice)", "monthly"), 3))
def _(t: Tables):
    return p.temporal(t.orders, "o_orderdate", "o_totalprice", "sum", "monthly").select(*RUNNING)


@query("temporal_auto", running_sql(points_sql("events", "ts", "count(*)", "weekly"), 2))
def _(t: Tables):
    return p.temporal(t.events, "ts", None, "count").select(*RUNNING)


@query("temporal_daily_ma", running_sql(points_sql("events", "ts", "sum(value)", "daily"), 7))
def _(t: Tables):
    return p.temporal(t.events, "ts", "value", "sum", "daily").select(*RUNNING)


_A = "(select max(o_orderdate) from orders)"
RANGES = {
    "last_7_days": f"o_orderdate >= {_A} - interval 7 day", "last_30_days": f"o_orderdate >= {_A} - interval 30 day",
    "last_90_days": f"o_orderdate >= {_A} - interval 90 day", "all_time": "true",
    "custom": "o_orderdate between timestamp '1996-03-01' and timestamp '1997-02-01'",
}
for _u in ("month", "quarter", "year"):
    _n = {"month": 1, "quarter": 3, "year": 12}[_u]
    RANGES[f"this_{_u}"] = f"o_orderdate >= date_trunc('{_u}', {_A})"
    RANGES[f"last_{_u}"] = (f"o_orderdate < date_trunc('{_u}', {_A}) and "
                            f"o_orderdate >= date_trunc('{_u}', {_A}) - interval {_n} month")


@query("range_presets", " union all ".join(
    f"select '{k}' as preset, count(*) as records, {hu('coalesce(sum(o_totalprice), 0)', 2)} as value from orders where {w}"
    for k, w in RANGES.items()))
def _(t: Tables):
    from functools import reduce

    from pyspark.sql import functions as F

    from framewright.functions.numbers import half_up

    parts = []
    for preset in p.PRESETS:
        rows = p.in_preset(t.orders, "o_orderdate", preset, "1996-03-01", "1997-02-01")
        parts.append(rows.agg(F.lit(preset).alias("preset"), F.count("*").alias("records"),
                              half_up(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("value")))
    return reduce(lambda x, y: x.unionByName(y), parts)


SPARSE = "o_totalprice > 350000"


@query("temporal_dense", f"""with m as ({points_sql('orders', 'o_orderdate', 'sum(o_totalprice)', 'daily', SPARSE)}),
  s as (select unnest(generate_series((select min(start) from m)::timestamp, (select max(start) from m)::timestamp,
    interval 1 day)) as d)
  select strftime(d, '%Y-%m-%d') as period, coalesce(value, 0.0)::double as value, coalesce(records, 0)::bigint as records,
    records is null as is_gap from s left join m on m.start = s.d::date""")
def _(t: Tables):
    points = p.periods(t.orders.where(SPARSE), "o_orderdate", "o_totalprice", "sum", "daily")
    return p.dense_periods(points, "daily").drop("period_start")


@query("temporal_series", f"""with k as (select o_orderpriority as series from orders group by 1
    order by sum(o_totalprice) desc, 1 limit 3),
  m as (select strftime(o_orderdate, '%Y-%m') as period, o_orderpriority as series, {hu('sum(o_totalprice)', 2)} as value,
    count(*) as records from orders group by 1, 2)
  select q.period, k.series, coalesce(value, 0.0)::double as value, coalesce(records, 0)::bigint as records
  from (select distinct period from m) q cross join k left join m on m.period = q.period and m.series = k.series""")
def _(t: Tables):
    return p.series_by(t.orders, "o_orderdate", "o_totalprice", "o_orderpriority", top=3)


@query("temporal_summary", f"""with m as ({points_sql('orders', 'o_orderdate', 'sum(o_totalprice)', 'quarterly')}),
  a as (select sum(records)::bigint as records, count(*) as periods, sum(value) as t, max(value) as peak, min(value) as trough,
    arg_min(period, (-value, period)) as peak_period, arg_min(period, (value, period)) as trough_period,
    arg_min(value, period) as f, arg_max(value, period) as l from m)
  select records, periods, {hu('t', 2)} as total, {hu('t/periods', 2)} as avg_per_period, peak_period, peak, trough_period,
    trough, {hu('(l-f)/abs(f)*100', 1)} as overall_growth_pct from a""")
def _(t: Tables):
    return p.temporal_summary(p.periods(t.orders, "o_orderdate", "o_totalprice", "sum", "quarterly"))


def compare_sql(grain: str, back: str) -> str:
    return f"""with m as ({points_sql('orders', 'o_orderdate', 'sum(o_totalprice)', grain)})
      select a.period, a.value, b.value as base_value, {hu('a.value-b.value', 2)} as delta,
        {hu('(a.value-b.value)/abs(b.value)*100', 1)} as change_pct
      from m a left join m b on b.start = (a.start - interval {back})::date"""


@query("prev_period", compare_sql("weekly", "7 day"))
def _(t: Tables):
    points = p.periods(t.orders, "o_orderdate", "o_totalprice", "sum", "weekly")
    return p.compare_periods(points, "weekly").drop("period_start")


@query("prev_year", compare_sql("monthly", "12 month"))
def _(t: Tables):
    points = p.periods(t.orders, "o_orderdate", "o_totalprice", "sum", "monthly")
    return p.compare_periods(points, "monthly", "year").drop("period_start")


EDA = f"""with m as (select strftime(o_orderdate, '%Y') as period, {hu('sum(o_totalprice)', 2)} as value, count(*) as records
    from orders group by 1),
  w as (select *, lag(value) over (order by period) as b, avg(value) over (order by period rows 2 preceding) as a from m)
  select period, value, records, {hu('(value-b)/abs(b)*100', 1)} as change_pct, {hu('a', 2)} as moving_avg from w"""


@query("eda_trend", EDA)
def _(t: Tables):
    return p.eda_trend(t.orders, "o_orderdate", "o_totalprice")


@query("eda_trend_weeks", f"""with m as (select concat(strftime(ts, '%Y-%m'), '-W', ceil(day(ts)/7)::int::varchar) as period,
    {hu('sum(value)', 2)} as value, count(*) as records from events where value is not null group by 1),
  w as (select *, lag(value) over (order by period) as b, avg(value) over (order by period rows 2 preceding) as a from m)
  select period, value, records, {hu('(value-b)/abs(b)*100', 1)} as change_pct, {hu('a', 2)} as moving_avg from w""")
def _(t: Tables):
    return p.eda_trend(t.events, "ts", "value")


@query("eda_trend_summary", f"""with x as ({EDA}), a as (select count(*) as periods, arg_min(value, period) as f,
    arg_max(value, period) as l, {hu('avg(change_pct)', 1)} as d, arg_min(period, (-value, period)) as peak_period,
    arg_min(period, (value, period)) as trough_period from x),
  g as (select *, {hu('(l-f)/f*100', 1)} as g from a)
  select periods, g as growth_pct, d as avg_change_pct, peak_period, trough_period, case when g > 10 then 'GROWING'
    when g < -10 then 'DECLINING' when abs(d) > 25 then 'VOLATILE' else 'STABLE' end as direction from g""")
def _(t: Tables):
    return p.eda_trend_summary(t.orders, "o_orderdate", "o_totalprice")


@query("daily_trend", f"""select strftime(ts, '%Y-%m-%d') as day, {hu('sum(value)', 2)} as sum, {hu('avg(value)', 2)} as avg,
  count(value) as records from events group by 1""")
def _(t: Tables):
    return p.daily_trend(t.events, "ts", "value")


@query("trend_headline", f"""with m as ({points_sql('orders', 'o_orderdate', 'sum(o_totalprice)', 'yearly')}),
  a as (select count(*) as periods, sum(value) as t, avg(value) as m, arg_min(value, period) as f, arg_max(value, period) as l,
    arg_min(period, (-value, period)) as peak_period, max(value) as peak_value,
    arg_min(period, (value, period)) as low_period, min(value) as low_value from m)
  select periods, {hu('t', 2)} as total, {hu('m', 2)} as mean, {hu('(l-f)/abs(f)*100', 1)} as net_change_pct, peak_period,
    peak_value, low_period, low_value from a""")
def _(t: Tables):
    return c.trend_headline(p.periods(t.orders, "o_orderdate", "o_totalprice", "sum", "yearly"))


@query("prev_period_by_key", f"""with m as (select o_orderpriority, strftime(o_orderdate, '%Y-%m') as period,
    date_trunc('month', min(o_orderdate))::date as start, {hu('sum(o_totalprice)', 2)} as value from orders group by 1, 2)
  select a.o_orderpriority, a.period, a.value, b.value as base_value, {hu('a.value-b.value', 2)} as delta,
    {hu('(a.value-b.value)/abs(b.value)*100', 1)} as change_pct
  from m a left join m b on b.start = (a.start - interval 1 month)::date and b.o_orderpriority = a.o_orderpriority""")
def _(t: Tables):
    """Every series against its own previous month."""
    keys = ["o_orderpriority"]
    points = p.periods(t.orders, "o_orderdate", "o_totalprice", "sum", "monthly", keys)
    return p.compare_periods(points, "monthly", keys=keys).drop("period_start")


NAMES = "concat_ws('_', case p_size % 5 when 0 then 'Net' when 1 then 'discount' when 2 then 'orders' when 3 then 'price' else p_brand end, " \
        "case p_partkey % 4 when 0 then 'EUR' when 1 then 'rate' when 2 then 'gbp' else p_type end)"


@query("metric_units", f"""with n as (select p_partkey, {NAMES} as name, lower({NAMES}) as l from part),
  k as (select *, case when regexp_matches(l, '{p.MONEY_NAME}') then 'currency' when regexp_matches(l, '{p.SHARE_NAME}') then 'percentage'
    when regexp_matches(l, '{p.COUNT_NAME}') then 'count' else 'number' end as type from n)
  select p_partkey, name, type, case when type <> 'currency' then '' when regexp_matches(l, 'inr|rupee|₹') then '₹'
    when regexp_matches(l, 'eur|euro|€') then '€' when regexp_matches(l, 'gbp|pound|£') then '£' else '$' end as prefix,
    case when type = 'percentage' then '%' else '' end as suffix from k""")
def _(t: Tables):
    names = t.part.select("p_partkey", F.expr(NAMES).alias("name"))
    return names.select("p_partkey", "name", p.unit_of_metric(F.col("name")).alias("u")).select("p_partkey", "name", "u.*")
