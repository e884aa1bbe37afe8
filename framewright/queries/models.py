"""Splits, models and their metrics."""

from pyspark.sql import functions as F

from framewright.functions.numbers import half_up
from framewright.operators import ml, profile as p
from framewright.queries.profile_sql import facts_ctes
from framewright.queries.registry import Tables, hu, query


def hash_sql(key: str, buckets: int = 100) -> str:
    return f"(('0x' || substr(md5(concat('42:', {key}::varchar)), 1, 8))::bigint % {buckets})"


@query("split_hash", f"select p_partkey, {hash_sql('p_partkey')} < 20 as is_test from part")
def _(t: Tables):
    return ml.split(t.part, "p_partkey").select("p_partkey", "is_test")


LINEAR = f"""with s as (select p_partkey, p_partkey::double as a, p_size::double as b, p_retailprice as y,
    {hash_sql('p_partkey')} < 20 as is_test from part),
  f as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(y) as my, stddev_pop(y) as sy,
    corr(a, y) as wa, corr(b, y) as wb from s where not is_test)
  select p_partkey, y, my+sy*(wa*(a-ma)/sa+wb*(b-mb)/sb)/(abs(wa)+abs(wb)) as prediction from s, f where is_test"""


@query("linear_scorer", f"select p_partkey, {hu('prediction', 3)} as prediction from ({LINEAR})")
def _(t: Tables):
    out = ml.linear_scorer(t.part, "p_retailprice", ["p_partkey", "p_size"], "p_partkey")
    return out.select("p_partkey", half_up(F.col("prediction"), 3).alias("prediction"))


@query("regression_metrics", f"""with x as ({LINEAR}), m as (select count(*) as n, avg((y-prediction)*(y-prediction)) as mse,
    avg(abs(y-prediction)) as mae, var_pop(y) as v from x)
  select n as test_rows, {hu('1-mse/v', 4)} as r2, {hu('1-(mse/v)*(n-1)/(n-3)', 4)} as adjusted_r2, {hu('sqrt(mse)', 4)} as rmse,
    {hu('mae', 4)} as mae, {hu('mse', 4)} as mse from m""")
def _(t: Tables):
    return ml.regression_metrics(ml.linear_scorer(t.part, "p_retailprice", ["p_partkey", "p_size"], "p_partkey"), 2)


FEATURES = ["letters", "n_chars", "blanks"]


def texts(t: Tables):
    """Labelled documents with text ratios over the whole text, which are made before the join, so that no text is moved.

    The ratios of an empty text are NaN, as in the SQL.
    """
    size = F.length("text").cast("double")
    share = lambda rest: F.when(size == 0, F.lit(float("nan"))).otherwise(F.length(F.regexp_replace("text", rest, "")) / size)
    rows = t.documents.select("doc_id", "n_chars", "lang", share("[^a-zA-Z]+").alias("letters"), share("[^ ]+").alias("blanks"))
    return rows.join(t.labels, "doc_id").select("doc_id", "quality", "toxic", "n_chars", "lang", "letters", "blanks")


CENTROID = f"""with s as (select d.doc_id, quality::varchar as actual, length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))/length(text)::double as a,
    n_chars::double as b, length(regexp_replace(text, '[^ ]', '', 'g'))/length(text)::double as c,
    {hash_sql('d.doc_id')} < 20 as is_test from documents d join labels l on l.doc_id = d.doc_id),
  f as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb, avg(c) as mc, stddev_pop(c) as sc from s
    where not is_test),
  z as (select doc_id, actual, is_test, (a-ma)/sa as a, (b-mb)/sb as b, (c-mc)/sc as c from s, f),
  m as (select actual as k, avg(a) as a, avg(b) as b, avg(c) as c from z where not is_test group by 1),
  p as (select z.doc_id, z.actual, arg_min(k, (pow(z.a-m.a, 2)+pow(z.b-m.b, 2)+pow(z.c-m.c, 2), k)) as predicted
    from z, m where is_test group by 1, 2)"""


@query("nearest_centroid", CENTROID + " select * from p")
def _(t: Tables):
    return ml.nearest_centroid(texts(t), "quality", FEATURES, "doc_id")


@query("confusion", CENTROID + " select actual, predicted, count(*) as records from p group by 1, 2")
def _(t: Tables):
    return ml.confusion(ml.nearest_centroid(texts(t), "quality", FEATURES, "doc_id"))


CLASSES = """, k as (select distinct actual as class from p), mm as (select class, (select count(*) from p where actual = class) as support,
    (select count(*) from p where predicted = class) as claimed, (select count(*) from p where predicted = class and actual = class) as hits
    from k), r as (select class, coalesce(hits/nullif(claimed, 0), 0) as pr, coalesce(hits/nullif(support, 0), 0) as re, support from mm)"""


@query("class_metrics", CENTROID + CLASSES + f""" select class, {hu('pr', 4)} as precision, {hu('re', 4)} as recall,
  {hu('coalesce(2*pr*re/nullif(pr+re, 0), 0)', 4)} as f1, support from r""")
def _(t: Tables):
    return ml.class_metrics(ml.confusion(ml.nearest_centroid(texts(t), "quality", FEATURES, "doc_id")))


@query("centroid_importance", f"""with s as (select quality as q, length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))/length(text)::double as a,
    n_chars::double as b from documents d join labels l on l.doc_id = d.doc_id),
  f as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from s),
  m as (select q, avg((a-ma)/sa) as a, avg((b-mb)/sb) as b from s, f group by 1)
  select 'letters' as feature, {hu('stddev_pop(a)', 3)} as importance from m union all select 'n_chars', {hu('stddev_pop(b)', 3)} from m""")
def _(t: Tables):
    return ml.centroid_importance(texts(t), "quality", ["letters", "n_chars"])


def scored(t: Tables):
    return texts(t).select(F.col("quality").alias("actual"), F.col("letters").alias("score"))


ROC = """with s as (select quality = 1 as pos, length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))/length(text)::double as score
    from documents d join labels l on l.doc_id = d.doc_id),
  c as (select score, count(*) filter (where pos) as p, count(*) filter (where not pos) as n from s group by 1),
  w as (select *, sum(p) over (order by score desc) as tp, sum(n) over (order by score desc) as fp, sum(p) over () as tp_all,
    sum(n) over () as fp_all from c)"""


@query("roc_points", ROC + f""" select score as threshold, tp::bigint as tp, fp::bigint as fp, {hu('tp/tp_all', 6)} as tpr,
  {hu('fp/fp_all', 6)} as fpr, {hu('tp/(tp+fp)', 6)} as precision, p as pos, n as neg from w""")
def _(t: Tables):
    return ml.roc_points(scored(t), F.col("actual") == 1)


@query("roc_auc", ROC + f""" select {hu('sum(n*(tp-p/2.0))/(max(tp_all)*max(fp_all))', 4)} as roc_auc,
  {hu('sum(p*' + hu('tp/(tp+fp)', 6) + ')/max(tp_all)', 4)} as average_precision from w""")
def _(t: Tables):
    return ml.auc(ml.roc_points(scored(t), F.col("actual") == 1))


@query("ml_readiness", f"""with {facts_ctes('dirty_orders')}, a as (select max(total) as r, count(*) as c, count(*) filter (where null_pct > 30)
    as h, count(*) filter (where type = 'id' or regexp_matches(lower(c), 'id$|_id|^id|uuid|guid|ssn|token|hash')) as l,
    coalesce(arg_min(dominant_pct, position) filter (where type in ('categorical', 'boolean') and distinct_n between 2 and 10), 0) as d
    from facts)
  select 'dataset_size' as "check", case when r >= 100 then 'PASS' when r >= 30 then 'WARN' else 'FAIL' end as status,
    case when r >= 100 then 0 when r >= 30 then 15 else 40 end::bigint as penalty, r::double as evidence from a
  union all select 'feature_breadth', case when c >= 3 then 'PASS' else 'FAIL' end, case when c >= 3 then 0 else 30 end, c::double from a
  union all select 'completeness', case when h = 0 then 'PASS' else 'WARN' end, case when h = 0 then 0 else 10 end, h::double from a
  union all select 'leakage', case when l = 0 then 'PASS' else 'WARN' end, 0, l::double from a
  union all select 'class_balance', case when d >= 80 then 'WARN' else 'PASS' end, case when d >= 80 then 10 else 0 end, d::double from a""")
def _(t: Tables):
    return ml.readiness(p.profile(t.dirty_orders))


@query("ml_targets", f"""with {facts_ctes('dirty_orders')} select c as "column", case when type = 'numeric' then 'regression'
  else 'classification' end as task, distinct_n as classes from facts where (type in ('categorical', 'boolean')
  and distinct_n between 2 and 10) or (type = 'numeric' and distinct_n > 10)""")
def _(t: Tables):
    return ml.target_candidates(p.profile(t.dirty_orders))


PART_FEATURES = ["p_partkey", "p_size", "p_brand"]
for _kind in ml.REGRESSORS:
    query(f"ml_regression_{_kind}")(
        lambda t, kind=_kind: ml.train_regression(t.part, "p_retailprice", PART_FEATURES, "p_partkey", kind).metrics
    )
for _kind in ml.CLASSIFIERS:
    query(f"ml_classification_{_kind}")(
        lambda t, kind=_kind: ml.train_classification(texts(t), "quality", FEATURES, "doc_id", kind).metrics
    )


@query("ml_importances")
def _(t: Tables):
    return ml.train_regression(t.part, "p_retailprice", PART_FEATURES, "p_partkey", "random_forest").importances()


@query("ml_compare")
def _(t: Tables):
    return ml.compare_models(t.part, "p_retailprice", ["p_partkey", "p_size"], "p_partkey")


@query("ml_kfold")
def _(t: Tables):
    return ml.kfold(t.part, "p_retailprice", ["p_partkey", "p_size"], "p_partkey", "ols", 5)


@query("ml_kmeans")
def _(t: Tables):
    return ml.kmeans(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], 3)["sizes"]


@query("ml_kmeans_centres")
def _(t: Tables):
    return ml.kmeans(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], 3)["centres"]


@query("ml_elbow")
def _(t: Tables):
    return ml.elbow(t.part, ["p_size", "p_retailprice"])


# Two-feature least squares by its normal equations, fitted on the training part.
LEAST_SQUARES = f"""with s as (select p_partkey, p_partkey::double as a, p_size::double as b, p_retailprice as y,
    {hash_sql('p_partkey')} < 20 as is_test from part),
  f as (select covar_pop(a, a) as aa, covar_pop(b, b) as bb, covar_pop(a, b) as ab, covar_pop(a, y) as cay, covar_pop(b, y) as cby,
    avg(a) as ma, avg(b) as mb, avg(y) as my from s where not is_test),
  g as (select *, (cay*bb-cby*ab)/(aa*bb-ab*ab) as wa, (cby*aa-cay*ab)/(aa*bb-ab*ab) as wb from f),
  p as (select p_partkey, is_test, y, my+wa*(a-ma)+wb*(b-mb) as prediction from s, g)"""


@query("ml_score", LEAST_SQUARES + f" select p_partkey, {hu('prediction', 4)} as prediction from p")
def _(t: Tables):
    trained = ml.train_regression(t.part, "p_retailprice", ["p_partkey", "p_size"], "p_partkey", "ols")
    scored = ml.score_rows(trained.model, t.part, ["p_partkey", "p_size"], ["p_partkey"])
    return scored.select("p_partkey", half_up(F.col("prediction"), 4).alias("prediction"))


@query("ml_least_squares", LEAST_SQUARES + f""", m as (select count(*) as n, avg((y-prediction)*(y-prediction)) as mse,
    avg(abs(y-prediction)) as mae, var_pop(y) as v from p where is_test)
  select n as test_rows, {hu('1-mse/v', 4)} as r2, {hu('1-(mse/v)*(n-1)/(n-3)', 4)} as adjusted_r2, {hu('sqrt(mse)', 4)} as rmse,
    {hu('mae', 4)} as mae, {hu('mse', 4)} as mse from m""")
def _(t: Tables):
    return ml.train_regression(t.part, "p_retailprice", ["p_partkey", "p_size"], "p_partkey", "ols").metrics


def planted(t: Tables):
    """A class that one feature of few values decides, beside a feature of noise."""
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal", F.when(F.col("c_nationkey") >= 12, "high").otherwise("low").alias("side"))


for _kind in ("decision_tree", "gradient_boosting"):
    query(f"ml_planted_{_kind}", f"""select case when c_nationkey >= 12 then 'high' else 'low' end as actual,
      case when c_nationkey >= 12 then 'high' else 'low' end as predicted, count(*) as records from customer
      where {hash_sql('c_custkey')} < 20 group by all""")(lambda t, kind=_kind: ml.confusion(ml.train_classification(
        planted(t), "side", ["c_nationkey", "c_acctbal"], "c_custkey", kind).predictions))


@query("ml_planted_clusters", """select (c_nationkey % 3)::bigint as planted, count(*) as records, count(*) as in_cluster
  from customer group by 1""")
def _(t: Tables):
    """Three clusters far apart: every one is found whole."""
    rows = t.customer.select("c_custkey", (F.col("c_nationkey") % 3).cast("long").alias("planted"),
                             (F.col("c_nationkey") % 3 * 1e6 + F.col("c_acctbal")).alias("x"),
                             F.when(F.col("c_nationkey") % 3 == 1, 1e6).otherwise(0.0).alias("y"))
    cells = ml.kmeans(rows, ["x", "y"], 3)["assigned"].groupBy("planted", "cluster").agg(F.count("*").alias("n"))
    return cells.groupBy("planted").agg(F.sum("n").alias("records"), F.max("n").alias("in_cluster"))


@query("ml_planted_inertia", f"""with c as (select c_nationkey % 3 as g, c_nationkey % 3 * 1e6 + c_acctbal as x,
    case when c_nationkey % 3 = 1 then 1e6 else 0.0 end as y from customer),
  s as (select var_samp(x) as vx, var_samp(y) as vy from c), w as (select g, count(*) as n, var_pop(x) as x, var_pop(y) as y from c group by 1)
  select 3::bigint as k, {hu('sum(n*x/vx + n*y/vy)', 6)} as inertia from w, s""")
def _(t: Tables):
    rows = t.customer.select((F.col("c_nationkey") % 3 * 1e6 + F.col("c_acctbal")).alias("x"),
                             F.when(F.col("c_nationkey") % 3 == 1, 1e6).otherwise(0.0).alias("y"))
    return ml.kmeans(rows, ["x", "y"], 3)["facts"].select("k", half_up(F.col("inertia"), 6).alias("inertia"))


# One class per product of brand and size: thousands of classes, each with its own mean.
MANY = f"""with s as (select p_partkey, concat(p_brand, '/', p_size) as actual, p_retailprice as a, p_size::double as b,
    {hash_sql('p_partkey')} < 20 as is_test from part),
  f as (select avg(a) as ma, stddev_pop(a) as sa, avg(b) as mb, stddev_pop(b) as sb from s where not is_test),
  z as (select p_partkey, actual, is_test, (a-ma)/sa as a, (b-mb)/sb as b from s, f),
  m as (select actual as k, avg(a) as a, avg(b) as b from z where not is_test group by 1)
  select z.p_partkey, z.actual, arg_min(k, (pow(z.a-m.a, 2)+pow(z.b-m.b, 2), k)) as predicted from z, m where is_test group by 1, 2"""


@query("nearest_of_many_classes", MANY)
def _(t: Tables):
    rows = t.part.withColumn("kind", F.concat("p_brand", F.lit("/"), F.col("p_size").cast("string")))
    return ml.nearest_centroid(rows, "kind", ["p_retailprice", "p_size"], "p_partkey")


@query("ml_readiness_score", f"""with {facts_ctes('dirty_orders')}, a as (select max(total) as r, count(*) as c,
    count(*) filter (where null_pct > 30) as h, coalesce(arg_min(dominant_pct, position)
      filter (where type in ('categorical', 'boolean') and distinct_n between 2 and 10), 0) as d from facts),
  s as (select greatest(20, least(100, 100 - case when r >= 100 then 0 when r >= 30 then 15 else 40 end
    - case when c >= 3 then 0 else 30 end - case when h = 0 then 0 else 10 end - case when d >= 80 then 10 else 0 end))::bigint as score
    from a)
  select score, case when score >= 75 then 'READY' when score >= 50 then 'NEEDS_CLEANING' else 'INSUFFICIENT_DATA' end as status from s""")
def _(t: Tables):
    return ml.readiness_score(p.profile(t.dirty_orders))


@query("ml_classification_multiclass")
def _(t: Tables):
    return ml.train_classification(t.part, "p_brand", ["p_size", "p_retailprice"], "p_partkey", "logistic").metrics
