"""Profiles, classification, audit and score."""


from pyspark.sql import functions as F

from framewright.functions.numbers import half_up
from framewright.operators import classify as cl, profile as p, quality as q
from framewright.queries.profile_sql import (
    GONE, NUMERIC_COLUMNS, SCHEMAS, audit_ctes, facts_ctes, numeric_ctes,
)
from framewright.queries.registry import Tables, hu, query


def facts(df):
    return p.column_facts(p.value_counts(df), p.profiled_columns(df))


for _level, _words in (("basic", "('')"), ("fill", "('', 'na', 'n/a', 'null', 'none', '-', '--', 'nil')"), ("profile", GONE)):
    _cells = " union all ".join(
        f"""select '{c}' as "column", count(*) filter (where {c} is null""" + (
            "" if k != "text" else f" or {c} = ''" if _level == "basic" else f" or lower(trim({c})) in {_words}")
        + ") as missing, count(*) as total from dirty_orders" for c, k in SCHEMAS["dirty_orders"].items()
    )
    query(f"missing_{_level}", f"""select "column", missing, total, {hu('missing*100/total', 2)} as missing_pct
      from ({_cells})""")(lambda t, level=_level: p.missing_counts(t.dirty_orders, level))

for _table in ("dirty_orders", "dirty_customer", "dirty_events", "orders"):
    query(f"infer_types_{_table}", f"""with {facts_ctes(_table)} select c as "column", kind, type from facts""")(
        lambda t, n=_table: facts(getattr(t, n)).select("column", "kind", "type")
    )
    query(f"profile_counts_{_table}", f"""with {facts_ctes(_table)} select c as "column", total, missing, valid,
      distinct_n as "distinct", padded, null_pct, cardinality_pct, dominant_pct, top_value, top_count, is_id,
      (distinct_n > 20 and cardinality_pct > 80 and not is_id) as is_high_cardinality, distinct_n = 1 as is_constant,
      dominant_pct >= 95 and distinct_n > 1 as is_near_constant, variant_rows, variant_groups from facts""")(
        lambda t, n=_table: facts(getattr(t, n)).select(
            "column", "total", "missing", "valid", "distinct", "padded", "null_pct", "cardinality_pct", "dominant_pct",
            "top_value", "top_count", "is_id", "is_high_cardinality", "is_constant", "is_near_constant", "variant_rows",
            "variant_groups")
    )


@query("recommend_types", f"""with {facts_ctes('dirty_customer')} select c as "column", type, recommended, confidence
  from facts""")
def _(t: Tables):
    return facts(t.dirty_customer).select("column", "type", "recommended", "confidence")


@query("profile_dates", f"""with {facts_ctes('dirty_events')} select c as "column", min_day, max_day, range_days, invalid_dates
  from facts where type = 'datetime'""")
def _(t: Tables):
    return facts(t.dirty_events).where("type = 'datetime'").select("column", "min_day", "max_day", "range_days", "invalid_dates")


for _table in ("dirty_orders", "dirty_customer", "dirty_events"):
    query(f"profile_numeric_{_table}", f"""with {numeric_ctes(_table, NUMERIC_COLUMNS[_table])}
      select c as "column", n as count, min, max, mean, median, floor(round(variance, 4)+0.5) as variance, stddev, q1, q3, iqr, skewness, kurtosis, outliers,
        outlier_pct, z_outliers, negatives, over_100, over_130 from numeric_rows""")(
        lambda t, n=_table: p.numeric_profile(getattr(t, n), NUMERIC_COLUMNS[n]).withColumn(
            "variance", half_up(F.col("variance")))
    )


@query("profile_histogram", f"""with l as (select 'l_quantity' as c, l_quantity as v from lineitem union all
    select 'l_extendedprice', l_extendedprice from lineitem union all select 'l_discount', l_discount from lineitem),
  f as (select c, min(v) as lo, max(v) as hi, greatest(4, least(8, floor(sqrt(count(*)))))::int as bins from l group by 1),
  w as (select *, case when hi > lo then (hi-lo)/bins else 1.0 end as width from f),
  h as (select l.c, least(floor((v-lo)/width), bins-1)::bigint as bin, count(*) as records from l join w on w.c = l.c group by 1, 2),
  s as (select *, unnest(generate_series(0, bins-1)) as bin from w)
  select s.c as "column", s.bin::bigint as bin, {hu('lo+s.bin*width', 2)} as bin_min,
    {hu('case when s.bin = bins-1 then hi else lo+(s.bin+1)*width end', 2)} as bin_max, coalesce(records, 0)::bigint as records
  from s left join h on h.c = s.c and h.bin = s.bin""")
def _(t: Tables):
    return p.numeric_histograms(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])


for _table in ("dirty_orders", "dirty_customer", "part"):
    query(f"profile_top_values_{_table}", f"""with {facts_ctes(_table)} select c as "column", rank, shown as value, n as count
      from tops where rank <= 10""")(lambda t, n=_table: p.top_values(p.value_counts(getattr(t, n))))


@query("profile_case_variants", f"""with {facts_ctes('dirty_customer')}, w as (select c, folded, value, count(*) as n from m
    where not gone and kind = 'text' group by 1, 2, 3)
  select c as "column", folded, count(*) as spellings, sum(n)::bigint as rows, arg_min(value, (-n, value)) as standard from w
  group by 1, 2 having count(*) > 1""")
def _(t: Tables):
    return p.case_variants(p.value_counts(t.dirty_customer))


@query("dataset_stats", f"""with d as (select coalesce(sum(n-1), 0)::bigint as d, sum(n)::bigint as r from (select count(*) as n
    from dirty_orders group by {', '.join(SCHEMAS['dirty_orders'])}))
  select r as rows, 8::bigint as columns, (select sum(case when status is null or status = '' then 1 else 0 end
    + case when price is null then 1 else 0 end + case when note is null or note = '' then 1 else 0 end
    + case when priority is null or priority = '' then 1 else 0 end) from dirty_orders)::bigint as missing_cells,
    d as duplicate_rows from d""")
def _(t: Tables):
    return p.dataset_stats(p.profile(t.dirty_orders)).drop("score")


def named(pattern: str) -> str:
    """SQL test of a normalised column name against one of the operator's own patterns."""
    return f"regexp_matches(nm, '{pattern.removeprefix('(?i)')}')"


CLASS_RULES = f"""case when type = 'datetime' or {named(cl.TIME_NAME)} then 'datetime'
  when type = 'boolean' or (distinct_n = 2 and flag_word_n = valid) then 'boolean'
  when {named(cl.ID_NAME)} or type = 'id' or (cardinality_pct > 95 and total >= 20 and type in ('categorical', 'text')) then 'identifier'
  when {named(cl.GEO_NAME)} or any_geo then 'geographic'
  when type = 'numeric' and ({named(cl.CURRENCY_NAME)} or any_money
    or (mean > 10 and not {named(cl.PERCENT_NAME)} and {named(cl.MONEY_WORD)})) then 'currency'
  when type = 'numeric' and ({named(cl.PERCENT_NAME)} or any_percent or (min >= 0 and max <= 1 and {named(cl.RATE_WORD)})
    or (min >= 0 and max <= 100 and {named(cl.BOUNDED_WORD)})) then 'percentage'
  when type = 'numeric' and distinct_n < 20 and min = floor(min) and max = floor(max) then 'numeric_discrete'
  when type = 'numeric' then 'numeric_continuous'
  when {named(cl.ORDINAL_NAME)} or any_ordinal then 'categorical_ordinal'
  when cardinality_pct > 60 and total > 50 then 'text_free' else 'categorical_nominal' end"""
SHARES = ", ".join(f"coalesce(sum(n) filter (where regexp_matches(lower(trim(shown)), '{v.removeprefix('(?i)')}')), 0) >= {cl.SOME}*sum(n) as any_{k}"
                   for k, v in p.VALUE_KINDS.items())
for _table in ("dirty_orders", "dirty_customer", "dirty_events", "customer"):
    query(f"classify_columns_{_table}", f"""with {facts_ctes(_table)}, {numeric_ctes(_table, NUMERIC_COLUMNS[_table])},
      s as (select c, {SHARES} from tops group by 1),
      x as (select f.*, n.min, n.max, n.mean, s.* exclude (c), regexp_replace(lower(f.c), '[\\s_-]+', '_', 'g') as nm
        from facts f left join numeric_rows n on n.c = f.c left join s on s.c = f.c),
      y as (select *, {CLASS_RULES} as semantic_type,
        {named(cl.TARGET_NAME)} as tn from x),
      z as (select *, tn and (semantic_type in ('boolean', 'currency', 'percentage', 'numeric_discrete', 'numeric_continuous')
        or (semantic_type in ('categorical_ordinal', 'text_free', 'categorical_nominal') and distinct_n <= 10)) as tc from y)
      select c as "column", type as logical_type, semantic_type, tc as is_target_candidate,
        case when semantic_type = 'datetime' then 'time' when semantic_type = 'identifier' then 'identifier'
          when semantic_type = 'boolean' then case when tc then 'target' else 'feature' end
          when semantic_type in ('currency', 'percentage', 'numeric_discrete', 'numeric_continuous') then 'measure'
          when tc then 'target' else 'dimension' end as suggested_role,
        case semantic_type when 'datetime' then 95 when 'boolean' then 95 when 'identifier' then 90 when 'geographic' then 92
          when 'currency' then 92 when 'percentage' then 90 when 'numeric_discrete' then 88 when 'numeric_continuous' then 85
          when 'categorical_ordinal' then 88 when 'text_free' then 80 else 90 end::bigint as confidence from z""")(
        lambda t, n=_table: cl.classify(p.profile(getattr(t, n))).drop("primary_type")
    )


@query("schema_sheet", f"""with {facts_ctes('dirty_customer')}, x as (select *, 100.0*distinct_n/valid as u, 100.0*valid/total as fl,
    regexp_replace(lower(c), '[^a-z0-9]', '_', 'g') as nm, case when type = 'numeric' then 'number'
      when type in ('datetime', 'boolean', 'categorical') then type else 'string' end as data_type from facts)
  select c as "column", data_type, missing > 0 as nullable, missing as null_count, {hu('missing*100/total', 1)} as null_pct,
    distinct_n as "distinct", case when u >= 99.5 and fl >= 99 then 'UNIQUE' when distinct_n > 50 or distinct_n/total > 0.4 then 'HIGH'
      when distinct_n > 10 then 'MEDIUM' else 'LOW' end as cardinality,
    case when {named(cl.ROLE_ID)} and u > 80 then 'IDENTIFIER'
      when data_type = 'datetime' or {named(cl.ROLE_DATE)} then 'DATE'
      when data_type = 'number' and {named(cl.ROLE_NUMBER_ID)} and u > 50 then 'IDENTIFIER'
      when data_type = 'number' then 'METRIC' when distinct_n <= 20 or distinct_n/total <= 0.15 then 'CATEGORICAL'
      when distinct_n/total <= 0.6 then 'DIMENSION' else 'TEXT' end as semantic_role, 'UNKNOWN' as unit from x""")
def _(t: Tables):
    return cl.schema_sheet(p.profile(t.dirty_customer))


for _table in ("dirty_orders", "dirty_customer", "dirty_events", "orders"):
    query(f"audit_issues_{_table}", f"""with {audit_ctes(_table)} select c as "column", dimension, severity, affected_rows,
      affected_pct, fix, lower_bound as lower, upper_bound as upper from issues""")(
        lambda t, n=_table: q.audit(p.profile(getattr(t, n))).drop("position")
    )
    query(f"quality_score_{_table}", f"""with {audit_ctes(_table)} select score, case when score >= 90 then 'EXCELLENT'
      when score >= 75 then 'GOOD' when score >= 50 then 'NEEDS ATTENTION' else 'CRITICAL ISSUES' end as rating, completeness,
      uniqueness, validity, type_consistency, category_consistency, outlier_health, issues, high, medium, low, duplicate_rows,
      missing_cells, invalid_values, outliers from scored""")(lambda t, n=_table: q.score(p.profile(getattr(t, n))))


@query("quality_explain", f"""with {audit_ctes('dirty_customer')}, r as (
    select 'Completeness' as part, 30 as weight, completeness as score, missing_cells as evidence from scored
    union all select 'Uniqueness', 20, uniqueness, duplicate_rows from scored
    union all select 'Validity', 20, validity, invalid_values from scored
    union all select 'Type Consistency', 10, type_consistency, types from scored
    union all select 'Category Consistency', 10, category_consistency, texts from scored
    union all select 'Outlier Health', 10, outlier_health, outliers from scored)
  select part, weight::bigint as weight, score::double as score, {hu('(100-score)*weight/100')} as penalty, evidence::bigint as evidence
  from r""")
def _(t: Tables):
    return q.explain_score(p.profile(t.dirty_customer))


@query("cleaning_plan", f"""with {audit_ctes('dirty_orders')} select step, dimension, c as "column", severity, fix,
  lower_bound as lower, upper_bound as upper, affected_rows from plan""")
def _(t: Tables):
    return q.cleaning_plan(p.profile(t.dirty_orders))


@query("projected_score", f"""with {audit_ctes('dirty_orders')} select score as current_score,
  least(100.0, {hu('score+(100-score)*0.85')}) as projected_score from scored""")
def _(t: Tables):
    return q.projected_score(p.profile(t.dirty_orders))


@query("column_statistics", f"""with {numeric_ctes('orders', ['o_totalprice'])} select c as "column", n as count, min, max, mean,
  median, stddev from numeric_rows""")
def _(t: Tables):
    return p.numeric_profile(t.orders, ["o_totalprice"]).select("column", "count", "min", "max", "mean", "median", "stddev")


@query("profile_exact_numbers", """with b as (select o_orderkey + 9007199254740992 as big, (o_orderkey + 9007199254740992)::decimal(20,0) as exact from orders)
  select 'big' as "column", count(*) as valid, count(distinct big) as distinct, min(big)::varchar as top_value from b
  union all select 'exact', count(*), count(distinct exact), min(exact)::varchar from b""")
def _(t: Tables):
    """Long and decimal keys above 2**53 are counted apart and shown whole."""
    big = F.col("o_orderkey") + F.lit(2**53)
    rows = t.orders.select(big.alias("big"), big.cast("decimal(20,0)").alias("exact"))
    facts = p.profile(rows).facts()
    return facts.select("column", "valid", "distinct", "top_value")
