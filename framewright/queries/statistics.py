"""Descriptive statistics, tests, correlation and anomalies."""

from framewright.operators import stats as s
from framewright.queries.profile_sql import number_sql
from framewright.queries.registry import Tables, hu, query
from framewright.session import work_folder
from framewright.sources.files import read_csv_like, write_csv

PI = "3.141592653589793"


def describe_sql(table: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        cis = ", ".join(
            f"{hu(f'avg({c})-{z}*stddev_samp({c})/sqrt(count({c}))', 2)} as ci{lv}_low, "
            f"{hu(f'avg({c})+{z}*stddev_samp({c})/sqrt(count({c}))', 2)} as ci{lv}_high"
            for lv, z in ((90, "1.645"), (95, "1.960"), (99, "2.576"))
        )
        parts.append(f"""select '{c}' as "column", count({c}) as count, count(*)-count({c}) as nulls, {hu(f'avg({c})', 2)} as mean,
          {hu(f'median({c})', 2)} as median, {hu(f'(select {c} from {table} where {c} is not null group by 1 order by count(*) desc, 1 limit 1)', 2)}
          as mode, {hu(f'stddev_samp({c})', 2)} as std_dev, {hu(f'var_samp({c})', 2)} as variance, {hu(f'min({c})', 2)} as min,
          {hu(f'max({c})', 2)} as max, {hu(f'quantile_cont({c}, 0.25)', 2)} as q1, {hu(f'quantile_cont({c}, 0.75)', 2)} as q3,
          {hu(f'max({c})-min({c})', 2)} as range, {hu(f'quantile_cont({c}, 0.75)-quantile_cont({c}, 0.25)', 2)} as iqr,
          {hu(f'skewness({c})', 2)} as skewness, {hu(f'kurtosis({c})', 2)} as kurtosis,
          {hu(f'stddev_samp({c})/sqrt(count({c}))', 3)} as std_error, {cis} from {table}""")
    return " union all ".join(parts)


@query("describe", describe_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def _(t: Tables):
    return s.describe(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("describe_dirty", describe_sql("dirty_events", ["value"]))
def _(t: Tables):
    return s.describe(t.dirty_events, ["value"])


def pair_sql(table: str, group: str, metric: str, first: str, second: str) -> str:
    picks = []
    for tag, name in (("1", first), ("2", second)):
        f = f"filter (where {group} = '{name}')"
        picks.append(f"count({metric}) {f} as n{tag}, avg({metric}) {f} as mean{tag}, var_samp({metric}) {f} as var{tag}, "
                     f"skewness({metric}) {f} as sk{tag}, kurtosis({metric}) {f} as ku{tag}, median({metric}) {f} as med{tag}, "
                     f"quantile_cont({metric}, 0.75) {f} - quantile_cont({metric}, 0.25) {f} as iqr{tag}")
    return f"p as (select {', '.join(picks)} from {table})"


@query("assumptions", f"""with {pair_sql('lineitem', 'l_returnflag', 'l_extendedprice', 'A', 'R')},
  x as (select *, greatest(var1, var2)/least(var1, var2) as sp from p)
  select 'sample_size' as assumption, case when least(n1, n2) >= 30 then 'PASSED' when least(n1, n2) >= 10 then 'WARNING' else
    'VIOLATED' end as status, least(n1, n2)::double as evidence from x
  union all select 'normality', case when abs(sk1) < 1 and abs(sk2) < 1 and abs(ku1) < 2 and abs(ku2) < 2 then 'PASSED' else
    'WARNING' end, {hu('abs(sk1)', 2)} from x
  union all select 'equal_variance', case when sp < 2 then 'PASSED' else 'WARNING' end, {hu('sp', 2)} from x""")
def _(t: Tables):
    return s.assumptions(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R")


def welch_sql(table: str, group: str, metric: str, first: str, second: str, more: str = "") -> str:
    return f"""{pair_sql(table, group, metric, first, second)},
  w as (select *, sqrt(var1/n1+var2/n2) as se, mean1-mean2 as gap,
    greatest(1.0, {hu('pow(var1/n1+var2/n2, 2)/(pow(var1/n1, 2)/(n1-1)+pow(var2/n2, 2)/(n2-1))')}) as df,
    abs(mean1-mean2)/sqrt(((n1-1)*var1+(n2-1)*var2)/(n1+n2-2)) as d from p),
  welch as (select '{first}' as group1, '{second}' as group2, n1, n2, {hu('mean1', 2)} as mean1, {hu('mean2', 2)} as mean2,
    {hu('gap/se', 3)} as t_statistic, df::bigint as df, {hu(f'1-sqrt(1-exp(-2*(gap/se)*(gap/se)/{PI}))', 4)} as p_approx,
    {hu('d', 3)} as cohens_d, case when d >= 0.8 then 'Large' when d >= 0.5 then 'Medium' when d >= 0.2 then 'Small' else
    'Negligible' end as effect, {hu('gap-1.96*se', 2)} as ci_low, {hu('gap+1.96*se', 2)} as ci_high from w)"""


@query("welch_t", f"with {welch_sql('lineitem', 'l_returnflag', 'l_extendedprice', 'A', 'R')} select * from welch")
def _(t: Tables):
    return s.welch_t(t.lineitem, "l_returnflag", "l_extendedprice", "A", "R").drop("p_value", "is_significant", "alpha")


@query("welch_t_exact")
def _(t: Tables):
    return s.welch_t(t.labels.join(t.documents, "doc_id"), "quality", "n_chars", "0", "1")


@query("bonferroni", f"""with {welch_sql('orders', 'o_orderstatus', 'o_totalprice', 'F', 'O')}
  select t_statistic, p_approx, 0.05/3 as alpha, p_approx < 0.05/3 as is_significant from welch""")
def _(t: Tables):
    out = s.welch_t(t.orders, "o_orderstatus", "o_totalprice", "F", "O", comparisons=3)
    return out.select("t_statistic", "p_approx", "alpha", "is_significant")


def anova_sql(table: str, group: str, metric: str) -> str:
    return f"""g as (select {group} as g, count({metric}) as n, avg({metric}) as m, var_samp({metric}) as v from {table}
    group by 1 having count({metric}) >= 2),
  s as (select count(*) as groups, sum(n)::bigint as n, sum(n*pow(m-(select sum(n*m)/sum(n) from g), 2)) as ssb,
    sum(v*(n-1)) as ssw from g),
  f as (select *, (ssb/(groups-1))/(ssw/(n-groups)) as f, (groups-1)::double as d1, (n-groups)::double as d2 from s),
  z as (select *, (pow(f, 1.0/3)*(1-2/(9*d2))-(1-2/(9*d1)))/sqrt(2/(9*d1)+pow(f, 2.0/3)*2/(9*d2)) as z from f),
  anova as (select groups, n, {hu('ssb', 2)} as ss_between, {hu('ssw', 2)} as ss_within, {hu('f', 3)} as f_statistic,
    d1::bigint as df_between, d2::bigint as df_within,
    {hu(f'least(1.0, greatest(0.0, 0.5*(1-sign(z)*sqrt(1-exp(-2*z*z/{PI})))))', 4)} as p_approx,
    {hu('ssb/(ssb+ssw)', 3)} as eta_squared, case when ssb/(ssb+ssw) >= 0.14 then 'Large' when ssb/(ssb+ssw) >= 0.06 then 'Medium'
    else 'Small' end as effect from z)"""


@query("anova", f"with {anova_sql('part', 'p_brand', 'p_retailprice')} select * exclude (ss_within) from anova")
def _(t: Tables):
    return s.anova(t.part, "p_brand", "p_retailprice").drop("p_value", "is_significant", "ss_within")


@query("anova_exact")
def _(t: Tables):
    return s.anova(t.documents, "lang", "n_chars")


def chi_sql(table: str, a: str, b: str) -> str:
    return f"""o as (select {a} as r, {b} as c, count(*) as o from {table} group by 1, 2),
  rs as (select r, sum(o) as rt from o group by 1), cs as (select c, sum(o) as ct from o group by 1),
  e as (select r, c, coalesce(o, 0) as o, rt*ct/(select sum(o) from o) as e from rs cross join cs left join o using (r, c)),
  x as (select sum(pow(o-e, 2)/e) as chi2, (count(distinct r)-1)*(count(distinct c)-1)::double as df, sum(o)::bigint as n,
    least(count(distinct r)-1, count(distinct c)-1) as md, count(*) filter (where e < 5) as small, count(*) as cells from e),
  z as (select *, (pow(chi2/df, 1.0/3)-(1-2/(9*df)))/sqrt(2/(9*df)) as z, sqrt(chi2/(n*md)) as v from x),
  chi as (select {hu('chi2', 3)} as chi_square, df::bigint as df, n,
    {hu(f'least(1.0, greatest(0.0, 0.5*(1-sign(z)*sqrt(1-exp(-2*z*z/{PI})))))', 4)} as p_approx, {hu('v', 3)} as cramers_v,
    case when v >= 0.35 then 'Strong' when v >= 0.15 then 'Moderate' else 'Weak' end as effect, small as small_cells,
    case when small = 0 then 'PASSED' when small/cells < 0.2 then 'WARNING' else 'VIOLATED' end as expected_check from z)"""


@query("chi_square", f"with {chi_sql('orders', 'o_orderstatus', 'o_orderpriority')} select * from chi")
def _(t: Tables):
    return s.chi_square(t.orders, "o_orderstatus", "o_orderpriority").drop("p_value", "is_significant")


@query("chi_square_sparse", f"with {chi_sql('part', 'p_brand', 'p_type')} select * from chi")
def _(t: Tables):
    return s.chi_square(t.part, "p_brand", "p_type").drop("p_value", "is_significant")


@query("chi_square_exact")
def _(t: Tables):
    return s.chi_square(t.documents, "lang", "source")


def ranks_sql(table: str, group: str, metric: str, first: str, second: str) -> str:
    return f"""{pair_sql(table, group, metric, first, second)},
  r as (select {group} as g, rank() over (order by {metric}) + (count(*) over (partition by {metric})-1)/2.0 as rk from {table}
    where {group} in ('{first}', '{second}') and {metric} is not null),
  s as (select sum(rk) filter (where g = '{first}')::double as r1, sum(rk) filter (where g = '{second}')::double as r2 from r),
  u as (select *, least(r1-n1*(n1+1)/2.0, n1::double*n2-(r1-n1*(n1+1)/2.0)) as u, n1::double*n2 as pr from s, p),
  z as (select *, (u-pr/2)/sqrt(pr*(n1+n2+1)/12) as z, 1-2*u/pr as rb from u)
  select n1, n2, {hu('r1', 1)} as rank_sum1, {hu('r2', 1)} as rank_sum2, {hu('u', 1)} as u_statistic, {hu('z', 3)} as z,
    {hu(f'1-sqrt(1-exp(-2*z*z/{PI}))', 4)} as p_approx, 1-sqrt(1-exp(-2*z*z/{PI})) < 0.05 as is_significant,
    {hu('rb', 3)} as rank_biserial, case when abs(rb) >= 0.5 then 'Large' when abs(rb) >= 0.3 then 'Medium' else 'Small' end as effect,
    {hu('med1', 2)} as median1, {hu('med2', 2)} as median2, {hu('iqr1', 2)} as iqr1, {hu('iqr2', 2)} as iqr2 from z"""


@query("mann_whitney", "with " + ranks_sql("lineitem", "l_returnflag", "l_quantity", "A", "R"))
def _(t: Tables):
    return s.mann_whitney(t.lineitem, "l_returnflag", "l_quantity", "A", "R")


@query("mann_whitney_events", "with " + ranks_sql("dirty_events", "event_type", "value", "view", "purchase"))
def _(t: Tables):
    return s.mann_whitney(t.dirty_events, "event_type", "value", "view", "purchase")


STRENGTH = """case when abs(r) >= 0.8 then 'Very Strong' when abs(r) >= 0.6 then 'Strong' when abs(r) >= 0.4 then 'Moderate'
  when abs(r) >= 0.2 then 'Weak' else 'Very Weak' end as strength,
  case when r > 0.05 then 'positive' when r < -0.05 then 'negative' else 'none' end as direction"""


def corr_sql(table: str, pairs: list[tuple[str, str]], fn: str = "corr({a}, {b})") -> str:
    rows = " union all ".join(
        f"select '{a}' as column_a, '{b}' as column_b, {hu(fn.format(a=a, b=b), 3)} as r, "
        f"count(*) filter (where {a} is not null and {b} is not null) as n from {table}" for a, b in pairs
    )
    return f"select column_a, column_b, r, n, {STRENGTH} from ({rows})"


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_PAIRS = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1:]]


@query("corr_pearson", corr_sql("lineitem", LINE_PAIRS))
def _(t: Tables):
    return s.corr_pearson(t.lineitem, LINE).drop("p_value")


DIRTY = f"(select customer_id, age, {number_sql('balance_text')} as balance_text from dirty_customer)"
DIRTY_PAIRS = [("customer_id", "age"), ("customer_id", "balance_text"), ("age", "balance_text")]


@query("corr_pearson_dirty", corr_sql(DIRTY, DIRTY_PAIRS))
def _(t: Tables):
    return s.corr_pearson(t.dirty_customer, ["customer_id", "age", "balance_text"]).drop("p_value")


@query("corr_pearson_exact_p")
def _(t: Tables):
    return s.corr_pearson(t.part, ["p_partkey", "p_size", "p_retailprice"])


PART = ["p_partkey", "p_size", "p_retailprice"]


@query("corr_spearman", " union all ".join(f"""(with r as (select rank() over (order by {a}) + (count(*) over (partition by {a})-1)/2.0 as x,
    rank() over (order by {b}) + (count(*) over (partition by {b})-1)/2.0 as y from part),
  c as (select {hu('corr(x, y)', 3)} as r, count(*) as n from r) select '{a}' as column_a, '{b}' as column_b, r, n, {STRENGTH} from c)"""
  for a, b in (("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice"))))
def _(t: Tables):
    return s.corr_spearman(t.part, PART).drop("p_value")


@query("corr_strong", f"""select * from ({corr_sql('part', [('p_partkey', 'p_size'), ('p_partkey', 'p_retailprice'),
  ('p_size', 'p_retailprice')])}) where abs(r) >= 0.4""")
def _(t: Tables):
    return s.corr_strong(t.part, PART).drop("p_value")


@query("corr_target", corr_sql("lineitem", [(c, "l_extendedprice") for c in LINE if c != "l_extendedprice"]))
def _(t: Tables):
    return s.corr_target(t.lineitem, "l_extendedprice", LINE).drop("p_value")


@query("bivariate_regression", f"""with m as (select avg(p_partkey) as mx, avg(p_retailprice) as my from part)
  select count(*) as n, {hu('corr(p_retailprice, p_partkey)', 3)} as r, {hu('regr_r2(p_retailprice, p_partkey)', 4)} as r2,
    {hu('regr_slope(p_retailprice, p_partkey)', 4)} as slope, {hu('regr_intercept(p_retailprice, p_partkey)', 2)} as intercept,
    count(*) filter (where (p_partkey-mx)*(p_retailprice-my) < 0) as opposite from part, m""")
def _(t: Tables):
    return s.bivariate(t.part, "p_partkey", "p_retailprice")


@query("regression_residuals", f"""with l as (select regr_slope(p_retailprice, p_partkey) as a, regr_intercept(p_retailprice, p_partkey) as b
    from part) select p_partkey, p_partkey::double as x, p_retailprice as y, {hu('a*p_partkey+b', 2)} as predicted,
    {hu('p_retailprice-(a*p_partkey+b)', 2)} as residual from part, l""")
def _(t: Tables):
    return s.fitted(t.part, "p_partkey", "p_retailprice", ["p_partkey"])


ANOMALY = f"""with v as (select order_id, price as value from dirty_orders where price is not null),
  f as (select avg(value) as m, stddev_pop(value) as s, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from v),
  a as (select order_id, 'price' as "column", value, {hu('abs((value-m)/s)', 2)} as score, case when abs((value-m)/s) > 3 then
    'ZSCORE' else 'IQR' end as method, value > q3+3*(q3-q1) or abs((value-m)/s) > 3.5 as is_extreme,
    case when value > q3+1.5*(q3-q1) then 'HIGH' else 'LOW' end as side from v, f
    where value < q1-1.5*(q3-q1) or value > q3+1.5*(q3-q1))"""


@query("anomalies", ANOMALY + ' select * from a order by score desc, "column", order_id limit 30')
def _(t: Tables):
    return s.anomalies(t.dirty_orders.select("order_id", "price"), ["order_id"], top=30)


@query("outlier_table", ANOMALY + " select * from a")
def _(t: Tables):
    return s.anomalies(t.dirty_orders.select("order_id", "price"), ["order_id"], top=None)


TOP2 = "(select c_mktsegment from customer group by 1 order by count(*) desc, 1 limit 1 offset {n})"


@query("compare_largest", f"""with x as (select case c_mktsegment when {TOP2.format(n=0)} then '0' when {TOP2.format(n=1)} then '1' end
    as g, c_acctbal from customer), {welch_sql('x', 'g', 'c_acctbal', '0', '1')}
  select * replace ({TOP2.format(n=0)} as group1, {TOP2.format(n=1)} as group2) from welch""")
def _(t: Tables):
    return s.compare_largest(t.customer, "c_mktsegment", "c_acctbal").drop("p_value", "is_significant", "alpha")


@query("test_by_groups", f"""with {anova_sql('orders', 'o_orderpriority', 'o_totalprice')}
  select 'anova' as test, f_statistic as statistic, p_approx from anova""")
def _(t: Tables):
    return s.test_by_groups(t.orders, "o_orderpriority", "o_totalprice").drop("p_value", "is_significant")


@query("statistics_export", describe_sql("part", ["p_size", "p_retailprice"]))
def _(t: Tables):
    table = s.describe(t.part, ["p_size", "p_retailprice"])
    path = work_folder(t.spark, "statistics")
    write_csv(table, path)
    return read_csv_like(t.spark, path, table)


@query("contingency", """with o as (select o_orderpriority as r, o_orderstatus as c, count(*) as observed from orders group by 1, 2)
  select r, c, observed, sum(observed) over (partition by r)::bigint as row_total, sum(observed) over (partition by c)::bigint as column_total
  from o""")
def _(t: Tables):
    return s.contingency(t.orders, "o_orderpriority", "o_orderstatus")
