"""Cleaning actions, previews, plans and undo."""

from pyspark.sql import functions as F

from framewright.operators import clean as cl, profile as p
from framewright.plans.cleaning import clean_by_plan, plan_history, preview_statistics
from framewright.queries.profile_sql import SCHEMAS, number_sql
from framewright.queries.registry import Tables, hu, query

ORDER_COLUMNS = ", ".join(SCHEMAS["dirty_orders"])
WORDS = "('', 'na', 'n/a', 'null', 'none', '-', '--', 'nil')"


def shown(df):
    """Order date as text, so that both engines print it alike."""
    return df.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd"))


SHOWN = ORDER_COLUMNS.replace("order_date", "strftime(order_date, '%Y-%m-%d') as order_date")


@query("clean_dedup", f"select distinct {SHOWN} from dirty_orders")
def _(t: Tables):
    return shown(cl.RemoveDuplicates().apply(t.dirty_orders))


for _keep, _dir in (("first", ""), ("last", "desc")):
    _order = ", ".join(f"{c} {_dir}" for c in ("customer_name", "customer_id", "balance_text", "age", "segment", "country", "active"))
    query(f"clean_dedup_id_{_keep}", f"""select customer_id, customer_name, age from (select *, row_number() over
      (partition by customer_id order by {_order}) as r from dirty_customer) where r = 1""")(
        lambda t, keep=_keep: cl.RemoveDuplicateIds("customer_id", ("customer_name",), keep).apply(t.dirty_customer).select(
            "customer_id", "customer_name", "age")
    )


@query("clean_dedup_id_missing", """with d as (select case when customer_id % 7 = 0 then null else customer_id end as id, customer_name, age
    from dirty_customer), r as (select *, row_number() over (partition by id order by customer_name, age) as n from d)
  select id, customer_name, age from r where n = 1 or id is null""")
def _(t: Tables):
    """Rows without an id are no duplicates of each other."""
    rows = t.dirty_customer.selectExpr("case when customer_id % 7 = 0 then null else customer_id end as id", "customer_name", "age")
    return cl.RemoveDuplicateIds("id", ("customer_name",)).apply(rows)


@query("clean_drop_missing", "select order_id, price from dirty_orders where price is not null")
def _(t: Tables):
    return cl.DropMissing("price").apply(t.dirty_orders).select("order_id", "price")


@query("clean_drop_missing_any", "select event_id, value from dirty_events where value is not null and date_text <> ''")
def _(t: Tables):
    return cl.DropMissing().apply(t.dirty_events).select("event_id", "value")


@query("clean_drop_sparse_cols", f"select {SHOWN.replace(', note', '')} from dirty_orders")
def _(t: Tables):
    return shown(cl.DropMostlyMissing(70).apply(t.dirty_orders))


for _strategy, _stat in (("mean", "avg(price)"), ("median", "median(price)")):
    query(f"clean_impute_{_strategy}", f"""select order_id, coalesce(price, (select {hu(_stat, 2)} from dirty_orders)) as price
      from dirty_orders""")(
        lambda t, s=_strategy: cl.Impute("price", s).apply(t.dirty_orders).select("order_id", "price")
    )


@query("clean_impute_mode", f"""with k as (select trim(status) as v from dirty_orders where lower(trim(status)) not in {WORDS}
    group by 1 order by count(*) desc, 1 limit 1)
  select order_id, case when status is null or lower(trim(status)) in {WORDS} then (select v from k) else status end as status
  from dirty_orders""")
def _(t: Tables):
    return cl.Impute("status", "mode").apply(t.dirty_orders).select("order_id", "status")


@query("clean_impute_const", "select order_id, coalesce(note, 'none given') as note from dirty_orders")
def _(t: Tables):
    return cl.Impute("note", "constant", "none given").apply(t.dirty_orders).select("order_id", "note")


@query("clean_ffill", """select event_id, user_id, coalesce(value, last_value(value ignore nulls) over
  (partition by user_id order by ts, event_id rows unbounded preceding)) as value from dirty_events""")
def _(t: Tables):
    rows = t.dirty_events.select("event_id", "user_id", "ts", "value")
    return cl.Carry("value", ("ts", "event_id"), ("user_id",)).apply(rows).drop("ts")


@query("clean_bfill", """select event_id, user_id, coalesce(value, last_value(value ignore nulls) over
  (partition by user_id order by ts desc, event_id desc rows unbounded preceding)) as value from dirty_events""")
def _(t: Tables):
    rows = t.dirty_events.select("event_id", "user_id", "ts", "value")
    return cl.Carry("value", ("ts", "event_id"), ("user_id",), "backward").apply(rows).drop("ts")


@query("clean_ffill_global", """select event_id, coalesce(value, last_value(value ignore nulls) over
  (order by ts, event_id rows unbounded preceding)) as value from dirty_events""")
def _(t: Tables):
    return cl.Carry("value", ("ts", "event_id")).apply(t.dirty_events.select("event_id", "ts", "value")).drop("ts")


@query("clean_trim", "select order_id, trim(priority) as priority, trim(status) as status from dirty_orders")
def _(t: Tables):
    return cl.Trim().apply(t.dirty_orders).select("order_id", "priority", "status")


@query("clean_case_title", r"""select customer_id, customer_name, list_aggregate(list_transform(string_split(trim(segment), ' '),
  lambda w: concat(upper(w[1]), lower(w[2:]))), 'string_agg', ' ') as segment from dirty_customer""")
def _(t: Tables):
    return cl.Recase("segment", "title").apply(t.dirty_customer).select("customer_id", "customer_name", "segment")


for _style in ("lower", "upper"):
    query(f"clean_case_{_style}", f"select customer_name, {_style}(trim(segment)) as segment from dirty_customer")(
        lambda t, s=_style: cl.Recase("segment", s).apply(t.dirty_customer).select("customer_name", "segment")
    )


@query("clean_alias", """select customer_name, case trim(country) when 'USA' then 'United States'
  when 'U.S.A.' then 'United States' when 'usa' then 'United States' else country end as country from dirty_customer""")
def _(t: Tables):
    pairs = (("USA", "United States"), ("U.S.A.", "United States"), ("usa", "United States"))
    return cl.Alias("country", pairs).apply(t.dirty_customer).select("customer_name", "country")


@query("clean_replace", "select order_id, case when status = 'N/A' then 'unknown' else status end as status from dirty_orders")
def _(t: Tables):
    return cl.Replace("status", "N/A", "unknown").apply(t.dirty_orders).select("order_id", "status")


@query("clean_convert_numeric", f"select customer_name, {number_sql('balance_text')} as balance_text from dirty_customer")
def _(t: Tables):
    return cl.Convert("balance_text", "numeric").apply(t.dirty_customer).select("customer_name", "balance_text")


_DAY = """coalesce(case when regexp_matches(date_text, '^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$') then try_strptime(date_text, '%Y-%m-%d')
  end, case when regexp_matches(date_text, '^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$') then try_strptime(date_text, '%d/%m/%Y') end)"""


@query("clean_convert_datetime", f"select event_id, strftime({_DAY}, '%Y-%m-%d') as day from dirty_events")
def _(t: Tables):
    days = cl.Convert("date_text", "datetime").apply(t.dirty_events)
    return days.select("event_id", F.date_format("date_text", "yyyy-MM-dd").alias("day"))


@query("clean_convert_rejects", f"""select count(*) as rows, count(*) filter (where {_DAY} is null) as rejected
  from dirty_events""")
def _(t: Tables):
    return cl.Convert("date_text", "datetime").rejects(t.dirty_events)


@query("clean_convert_boolean", "select customer_name, active = 'yes' as active from dirty_customer")
def _(t: Tables):
    return cl.Convert("active", "boolean").apply(t.dirty_customer).select("customer_name", "active")


LIMITS = """with q as (select quantile_cont(price, 0.25) as a, quantile_cont(price, 0.75) as b, median(price) as m from dirty_orders),
  f as (select a-1.5*(b-a) as low, b+1.5*(b-a) as high, m from q) """


@query("clean_cap", LIMITS + f"""select order_id, case when price < low then {hu('low', 2)} when price > high then {hu('high', 2)}
  else price end as price from dirty_orders, f""")
def _(t: Tables):
    return cl.Cap("price").apply(t.dirty_orders).select("order_id", "price")


@query("clean_cap_bounds", "select order_id, greatest(1000.0, least(300000.0, price))::double as price from dirty_orders where price is not null")
def _(t: Tables):
    return cl.Cap("price", 1000, 300000).apply(t.dirty_orders).select("order_id", "price").where("price is not null")


@query("clean_remove_outliers", LIMITS + """select order_id, price from dirty_orders, f
  where price is null or not (price < low or price > high)""")
def _(t: Tables):
    return cl.RemoveOutliers("price").apply(t.dirty_orders).select("order_id", "price")


@query("clean_remove_zscore", """with f as (select avg(price) as m, stddev_pop(price) as s from dirty_orders)
  select order_id, price from dirty_orders, f where price is null or price between m-3*s and m+3*s""")
def _(t: Tables):
    return cl.RemoveOutliers("price", "zscore").apply(t.dirty_orders).select("order_id", "price")


@query("clean_outlier_median", LIMITS + f"""select order_id, case when price < low or price > high then {hu('m', 2)} else price end
  as price from dirty_orders, f""")
def _(t: Tables):
    return cl.OutliersToMedian("price").apply(t.dirty_orders).select("order_id", "price")


@query("clean_impossible", """with c as (select customer_name, case when age between 0 and 130 then age end as age from dirty_customer)
  select customer_name, coalesce(age, (select floor(round(median(age)*100, 4)+0.5)/100 from c))::double as age from c""")
def _(t: Tables):
    h = cl.History(t.dirty_customer).do(cl.ClearCells("age", 0, 130)).do(cl.Impute("age", "median"))
    return h.current().select("customer_name", "age")


@query("clean_drop_column", f"select {SHOWN.replace(', store', '')} from dirty_orders")
def _(t: Tables):
    return shown(cl.DropColumn("store").apply(t.dirty_orders))


@query("clean_drop_const", f"select {SHOWN.replace(', store', '')} from dirty_orders")
def _(t: Tables):
    return shown(cl.DropConstant().apply(t.dirty_orders))


@query("clean_rename", "select order_id, price as amount from dirty_orders")
def _(t: Tables):
    return cl.Rename("price", "amount").apply(t.dirty_orders).select("order_id", "amount")


@query("clean_preview", """select customer_id, customer_name, 'segment' as changed, segment as old_value, trim(segment) as new_value
  from dirty_customer where segment <> trim(segment) order by customer_id, customer_name limit 5""")
def _(t: Tables):
    rows = t.dirty_customer.select("customer_id", "customer_name", "segment")
    out = cl.preview(rows, cl.Trim("segment"), ["customer_id", "customer_name"])
    return out.select("customer_id", "customer_name", "changed", F.col("before.segment").alias("old_value"),
                      F.col("after.segment").alias("new_value"))


@query("clean_preview_removed", """select order_id, 'removed' as changed from dirty_orders where note is null order by 1 limit 5""")
def _(t: Tables):
    rows = t.dirty_orders.select("order_id", "note")
    return cl.preview(rows, cl.DropMissing("note"), ["order_id"]).select("order_id", "changed")


@query("clean_log", f"""with d as (select distinct * from dirty_orders),
  z as (select count(*) as r, count(*) filter (where price is null) as mp, sum((price is null)::int + (note is null)::int) as m from dirty_orders),
  y as (select count(*) as r, sum((price is null)::int + (note is null)::int) as m,
    count(*) filter (where priority <> trim(priority) or status <> trim(status) or note <> trim(note)) as padded from d)
  select 1::bigint as step, 'RemoveDuplicates' as action, null::varchar as "column", z.r as rows_before, y.r as rows_after,
    z.r-y.r as affected_rows, z.m::bigint as missing_before, y.m::bigint as missing_after, z.r-y.r as duplicates_before,
    0::bigint as duplicates_after from z, y
  union all select 2, 'Trim', null, y.r, y.r, y.padded, y.m::bigint, y.m::bigint, 0, 0 from y""")
def _(t: Tables):
    return cl.History(t.dirty_orders).do(cl.RemoveDuplicates()).do(cl.Trim()).log()


@query("clean_preview_statistics", """with d as (select distinct * from dirty_orders),
  m as (select sum((price is null)::int + (note is null)::int)::bigint as m, count(*) as r from dirty_orders),
  n as (select sum((price is null)::int + (note is null)::int)::bigint as m, count(*) as r from d)
  select 'before' as side, m.r as rows, 8::bigint as columns, m.m as missing_cells, m.r - n.r as duplicate_rows from m, n
  union all select 'after', n.r, 8, n.m, 0 from n""")
def _(t: Tables):
    return preview_statistics(t.dirty_orders, cl.RemoveDuplicates()).drop("score")


@query("clean_undo", "select order_id, trim(priority) as priority from dirty_orders")
def _(t: Tables):
    h = cl.History(t.dirty_orders).do(cl.Trim("priority")).do(cl.DropMissing("price")).undo()
    return h.current().select("order_id", "priority")


@query("clean_revert", "select order_id, priority from dirty_orders")
def _(t: Tables):
    h = cl.History(t.dirty_orders).do(cl.Trim("priority")).do(cl.DropMissing("price")).revert()
    return h.current().select("order_id", "priority")


@query("clean_apply_plan", f"""with a as (select customer_id, customer_name, {number_sql('balance_text')} as bal, age,
    trim(segment) as segment, trim(country) as country, active from dirty_customer),
  t as (select customer_id, customer_name, bal, age, concat(upper(segment[1]), lower(segment[2:])) as segment,
    list_aggregate(list_transform(string_split(country, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), 'string_agg', ' ')
      as country, active from a),
  k as (select * exclude (r) from (select *, row_number() over (partition by customer_id order by customer_name, age) as r from t)
    where r = 1),
  g as (select *, case when not (age > 130) then age end as age1 from k),
  i as (select * replace (coalesce(age1, (select floor(round(median(age1)*100, 4)+0.5)/100 from g))::double as age1) from g),
  n as (select *, case when not (age1 < 0) then age1 end as age2 from i)
  select customer_id, customer_name, coalesce(age2, (select floor(round(median(age2)*100, 4)+0.5)/100 from n))::double as age, segment, country,
    active from n""")
def _(t: Tables):
    return clean_by_plan(p.profile(t.dirty_customer), ("customer_name",)).drop("balance_text")


@query("clean_plan_actions")
def _(t: Tables):
    history = plan_history(p.profile(t.dirty_orders), ("order_id",))
    rows = [(i + 1, type(a).__name__, getattr(a, "column", None)) for i, a in enumerate(history.actions)]
    return t.spark.createDataFrame(rows, "step long, action string, column string")
