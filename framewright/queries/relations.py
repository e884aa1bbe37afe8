"""Keys, relationships, conflicts and reconciliation."""

from pyspark.sql import functions as F

from framewright.operators import classify as cl, joins as j, keys as k, profile as p
from framewright.queries.profile_sql import facts_ctes
from framewright.queries.registry import Tables, hu, query

for _table in ("dirty_customer", "orders"):
    query(f"pk_candidates_{_table}", f"""with {facts_ctes(_table)}, s as (select *, 100.0*distinct_n/valid as u, 100.0*valid/total as f,
        regexp_replace(lower(c), '[^a-z0-9]', '', 'g') as nm from facts),
      w as (select *, case when u = 100 then 45 when u >= 99 then 35 when u >= 90 then 15 end
        + case when f = 100 then 25 when f >= 99 then 15 else -20 end
        + case when regexp_matches(nm, '^id|(id|key|code|sku)$') then 20 else 0 end
        + case when (kind = 'number' and distinct_n = valid) or (code_n = valid and valid > 0) then 10 else 0 end as pts from s),
      z as (select *, coalesce(greatest(0, least(100, pts)), 0)::bigint as conf from w)
      select c as "column", {hu('u', 1)} as uniqueness, {hu('f', 1)} as non_null_pct,
        case when pts is null then 0 else conf end::bigint as confidence, pts is not null and conf >= 60 as is_candidate
      from z""")(lambda t, n=_table: k.primary_keys(p.profile(getattr(t, n))))


# Every flat column of the given tables with its kind: i whole number, d double, s text, t time.
COLUMNS = {
    "region": "r_regionkey i, r_name s", "nation": "n_nationkey i, n_name s, n_regionkey i",
    "customer": "c_custkey i, c_name s, c_nationkey i, c_acctbal d, c_mktsegment s",
    "supplier": "s_suppkey i, s_name s, s_nationkey i, s_acctbal d",
    "part": "p_partkey i, p_name s, p_brand s, p_type s, p_size i, p_retailprice d",
    "orders": "o_orderkey i, o_custkey i, o_orderstatus s, o_totalprice d, o_orderdate t, o_orderpriority s",
    "lineitem": "l_orderkey i, l_partkey i, l_suppkey i, l_linenumber i, l_quantity d, l_extendedprice d, l_discount d, l_tax d, "
                "l_returnflag s, l_linestatus s, l_shipdate t",
    "events": "event_id i, ts t, user_id i, event_type s, value d, props s",
    "documents": "doc_id i, text s, lang s, source s, n_chars i", "embeddings": "vec_id i, label i", "pages": "page_id i, url s, html s",
    "benchmark": "item_id i, text s", "labels": "doc_id i, quality i, toxic i", "conversations": "conv_id i, turn i, role s, text s",
}


def key_tables(t: Tables) -> dict:
    """All tables with all their columns."""
    return {name: getattr(t, name) for name in COLUMNS}


def cell_sql(column: str, kind: str) -> str:
    """The key text of a cell: whole numbers without decimals, text folded, blank as null."""
    if kind == "d":
        return f"case when {column} = floor({column}) and abs({column}) < 9.2e18 then {column}::bigint::varchar else {column}::varchar end"
    return f"nullif(lower(trim({column}::varchar, ' ')), '')"


CELLS = " union all ".join(
    f"select '{t}' as t, '{c}' as c, {int(k == 't')} as fam, {cell_sql(c, k)} as v from {t} where {cell_sql(c, k)} is not null"
    for t, cs in COLUMNS.items() for c, k in (x.split() for x in cs.split(", "))
)
SIMILAR = """case when x = y then 100 when x in (concat(tt, 'id'), concat(tt, 'key')) or y in (concat(st, 'id'), concat(st, 'key'))
  then 95 when contains(x, y) or contains(y, x) then 80 else 20 end"""
DISCOVER = f"""with cells as ({CELLS}), d as (select t, c, fam, v, count(*) as n from cells group by all),
  s as (select t, c, count(*) as dn, sum(n) = count(*) as uq from d group by 1, 2),
  m as (select a.t as st, a.c as sc, b.t as tt, b.c as tc, count(*) as matches from d a join d b on a.v = b.v and a.fam = b.fam
    and a.t <> b.t group by all),
  w as (select m.*, 100.0*matches/x.dn as sp, 100.0*matches/y.dn as tp, x.uq as su, y.uq as tu,
    regexp_replace(sc, '[^a-z0-9]', '', 'g') as x, regexp_replace(tc, '[^a-z0-9]', '', 'g') as y from m join s x on x.t = st and x.c = sc join s y on y.t = tt and y.c = tc),
  z as (select *, ({SIMILAR})::double as sim, case when su and tu then 'ONE_TO_ONE' when su then 'ONE_TO_MANY' when tu
    then 'MANY_TO_ONE' else 'MANY_TO_MANY' end as cardinality from w where greatest(sp, tp) >= 30),
  c as (select *, least(99.0, {hu(f'greatest(sp, tp)*0.6 + ({SIMILAR})*0.25 + case when su or tu then 15 else 0 end')}) as confidence
    from z),
  r as (select *, row_number() over (partition by least(concat(st, '.', sc), concat(tt, '.', tc)),
      greatest(concat(st, '.', sc), concat(tt, '.', tc)) order by confidence desc,
      case when cardinality = 'ONE_TO_MANY' then 1 else 0 end, {hu('sp', 1)} desc, st, sc) as rn from c where confidence >= 55),
  found as (select st as source_table, sc as source_column, tt as target_table, tc as target_column, matches,
    {hu('sp', 1)} as overlap_pct, {hu('tp', 1)} as target_overlap_pct, sim as name_similarity, cardinality, confidence from r
    where rn = 1) """


@query("relationship_discover", DISCOVER + "select * from found")
def _(t: Tables):
    return k.discover_relationships(key_tables(t))


@query("fk_candidates", DISCOVER + "select * from found where cardinality = 'MANY_TO_ONE'")
def _(t: Tables):
    return k.discover_relationships(key_tables(t)).where("cardinality = 'MANY_TO_ONE'")


@query("join_recommend", DISCOVER + """select source_table, source_column, target_table, target_column, overlap_pct,
  case when overlap_pct >= 95 then 'INNER' else 'LEFT' end as join_type from found""")
def _(t: Tables):
    return j.recommend_join(k.discover_relationships(key_tables(t)))


@query("name_similarity", f"""with x as (select a.n_name as sc, b.r_name as tc, 'nation' as st, 'region' as tt,
    regexp_replace(lower(a.n_name), '[^a-z0-9]', '', 'g') as x, regexp_replace(lower(b.r_name), '[^a-z0-9]', '', 'g') as y
    from nation a join region b on a.n_regionkey = b.r_regionkey)
  select sc as a, tc as b, ({SIMILAR})::double as similarity from x""")
def _(t: Tables):
    both = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_name").alias("a"), F.col("r_name").alias("b"), k.name_similarity(
        F.col("n_name"), F.col("r_name"), F.lit("nation"), F.lit("region")).alias("similarity"))


@query("relationship_validate", f"""with l as (select customer_id as k, count(*) as n from dirty_customer group by 1),
  r as (select o_custkey as k, count(*) as m from orders where o_totalprice > 300000 group by 1),
  f as (select k, coalesce(n, 0) as n, coalesce(m, 0) as m from l full join r using (k)),
  a as (select count(*) filter (where m > 0) as source_keys, count(*) filter (where n > 0) as target_keys,
    count(*) filter (where n > 0 and m > 0) as matched_keys, sum(greatest(m-1, 0))::bigint as source_duplicates,
    sum(greatest(n-1, 0))::bigint as target_duplicates from f)
  select *, source_keys-matched_keys as unmatched_source, target_keys-matched_keys as unmatched_target,
    {hu('100.0*matched_keys/source_keys', 1)} as match_pct, 0::bigint as source_nulls, 0::bigint as target_nulls, true as types_fit,
    {hu('100.0*matched_keys/source_keys', 1)} > 15 as is_valid from a""")
def _(t: Tables):
    return k.validate_relationship(t.orders.where("o_totalprice > 300000"), t.dirty_customer, "o_custkey", "customer_id")


def conflict_frames(t: Tables) -> dict:
    """Two tables whose equally named columns disagree on type."""
    left = t.customer.select(F.col("c_custkey").alias("cust_id"), F.col("c_acctbal").alias("Balance"), F.col("c_name").alias("name"))
    right = t.orders.select(F.col("o_custkey").alias("CustId"), F.concat(F.lit("about "), F.col("o_orderpriority")).alias("balance"),
                            F.col("o_orderdate").alias("name"))
    return {"accounts": left, "bookings": right}


@query("schema_conflicts", """select 'accounts' as table_a, column_a, type_a, 'bookings' as table_b, column_b, type_b, severity,
  harmonize_to from (values ('Balance', 'numeric', 'balance', 'categorical', 'HIGH', 'numeric'),
  ('name', (select case when count(distinct c_name) > 0.95*count(*) and min(lower(trim(c_name))) ~ 'id' then 'id'
      when count(distinct c_name) < 0.4*count(*) or count(distinct c_name) <= 25 then 'categorical' else 'text' end from customer),
    'name', 'datetime', 'MEDIUM', 'string')) v(column_a, type_a, column_b, type_b, severity, harmonize_to)""")
def _(t: Tables):
    return k.schema_conflicts({n: p.profile(df) for n, df in conflict_frames(t).items()})


@query("duplicate_entities", """with d as (select segment as v, count(*) as n from dirty_customer group by 1),
  g as (select *, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') as p from d),
  b as (select p, arg_min(v, (-n, v)) as main_value from g group by 1 having count(*) > 1)
  select 'segment' as "column", main_value, v as similar_value, n as rows, 0.95::double as similarity from g join b using (p)
  where v <> main_value""")
def _(t: Tables):
    return k.duplicate_entities(t.dirty_customer, ["segment"])


@query("duplicate_entities_text", """with d as (select text as v, count(*) as n from documents group by 1),
  g as (select *, regexp_replace(lower(v), '[^a-z0-9]', '', 'g') as p from d),
  b as (select p, arg_min(v, (-n, v)) as main_value from g where p <> '' group by 1 having count(*) > 1)
  select 'text' as "column", md5(main_value) as main_value, md5(v) as similar_value, n as rows, 0.95::double as similarity
  from g join b using (p) where v <> main_value""")
def _(t: Tables):
    found = k.duplicate_entities(t.documents, ["text"])
    return found.withColumns({"main_value": F.md5("main_value"), "similar_value": F.md5("similar_value")})


@query("reconcile", f"""with a as (select sum(o_totalprice) as x from orders), b as (select sum(l_extendedprice) as y from lineitem)
  select {hu('x', 2)} as left_total, {hu('y', 2)} as right_total, {hu('x-y', 2)} as difference,
    {hu('100.0*(x-y)/abs(y)', 4)} as difference_pct, case when abs(100.0*(x-y)/abs(y)) <= 0.01 then 'MATCH' else 'DISCREPANCY' end
    as status from a, b""")
def _(t: Tables):
    return k.reconcile(t.orders, "o_totalprice", t.lineitem, "l_extendedprice")


@query("unit_conflicts", """select 'a' as table_a, 'value kg' as column_a, 'WEIGHT' as unit_a, 'b' as table_b,
  'valuekg' as column_b, 'PERCENT' as unit_b from part limit 1""")
def _(t: Tables):
    a = t.part.select(F.col("p_size").alias("value kg"))
    b = t.part.select(F.concat(F.col("p_size").cast("string"), F.lit(" %")).alias("valuekg"))
    return k.unit_conflicts({"a": cl.schema_sheet(p.profile(a)), "b": cl.schema_sheet(p.profile(b))})
