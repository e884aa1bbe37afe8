"""Sources, sinks, snapshots, HTML tables and text safety."""

from pyspark.sql import functions as F

from framewright.functions.text import UNSAFE_PHRASES, sanitize
from framewright.queries.registry import Tables, query
from framewright.session import work_folder
from framewright.sources import files as fl, html_tables as ht, snapshots as sn

CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


#: Splits that files are cut into at least, once they are large enough for the smallest splits to be more than these.
MANY_SPLITS = 1000


def split_bytes(t: Tables, path: str, smallest: int) -> int:
    """The smallest size, or that of one in ``MANY_SPLITS`` of larger files, so that the tasks' own cost does not grow with the input."""
    total = t.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.sum("length")).first()[0] or 0
    return max(smallest, total // MANY_SPLITS)


def in_small_splits(t: Tables, path: str, read, smallest: int = 64 << 10):
    """The rows that ``read`` gives while the files of a path are cut into many splits, written so that later settings do not matter."""
    names = {"spark.sql.files.maxPartitionBytes": str(split_bytes(t, path, smallest)), "spark.sql.files.openCostInBytes": "1k"}
    before = {n: t.spark.conf.get(n) for n in names}
    try:
        for n, v in names.items():
            t.spark.conf.set(n, v)
        out = work_folder(t.spark, "split-rows")
        read().write.parquet(out)
    finally:
        for n, v in before.items():
            t.spark.conf.set(n, v)
    return t.spark.read.parquet(out)


def customers(t: Tables):
    return t.customer.select(*[c.strip() for c in CUSTOMER.split(",")])


@query("csv_round_trip", f"select {CUSTOMER} from customer")
def _(t: Tables):
    path = work_folder(t.spark, "csv")
    fl.write_csv(customers(t), path)
    return fl.read_csv_like(t.spark, path, t.customer).select(*customers(t).columns)


@query("csv_inferred", f"select {CUSTOMER} from customer")
def _(t: Tables):
    """Padded header names, a blank-named column and all-blank rows come out clean."""
    path = work_folder(t.spark, "tsv")
    rows = customers(t).select([F.col(c).cast("string").alias(f" {c} ") for c in customers(t).columns])
    blank = rows.select([F.lit("").alias(c) for c in rows.columns])
    both = rows.unionByName(blank).withColumn(" ", F.lit(""))
    both.write.option("header", True).option("sep", "\t").option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    back = fl.read_delimited(t.spark, path, sep="\t")
    return back.withColumn("c_custkey", F.col("c_custkey").cast("long"))


DOCUMENTS = "doc_id, nullif(text, '') as text, lang, source, n_chars"


@query("csv_quoted_breaks", f"select {DOCUMENTS} from documents")
def _(t: Tables):
    """Texts with line breaks, separators and quotes inside quoted cells, over many splits and without a given separator."""
    path = work_folder(t.spark, "quoted")
    t.documents.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    types = "doc_id long, text string, lang string, source string, n_chars long"
    return in_small_splits(t, path, lambda: fl.read_delimited(t.spark, path, schema=types))


@query("txt_separator_found", """select conv_id, turn::bigint as turn, role, nullif(trim(text), '') as text from conversations
  where trim(text) <> '' or conv_id is not null""")
def _(t: Tables):
    """Tab-separated text whose cells are full of commas; separator and types come from the data."""
    path = work_folder(t.spark, "tabbed")
    rows = t.conversations.select("conv_id", "turn", "role", F.trim("text").alias("text"))
    rows.write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    back = in_small_splits(t, path, lambda: fl.read_delimited(t.spark, path))
    return back.withColumns({"conv_id": F.col("conv_id").cast(t.conversations.schema["conv_id"].dataType), "turn": F.col("turn").cast("long")})


PAGE = "page_id, url, md5(html) as digest, length(html)::bigint as n"


@query("json_array_splits", f"select {PAGE} from pages")
def _(t: Tables):
    """Arrays of records whose texts are full of braces and quotes, over many splits."""
    path = work_folder(t.spark, "arrays")
    fl.write_json_arrays(t.pages, path)
    back = in_small_splits(t, path, lambda: fl.read_json(t.spark, path, schema="page_id long, url string, html string"))
    return back.select("page_id", "url", F.md5("html").alias("digest"), F.length("html").cast("long").alias("n"))


@query("json_wrapped_array", "select event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events")
def _(t: Tables):
    """``{"meta": [...], "data": [...]}`` with nested objects; the other array and the nested ones are no rows."""
    path = work_folder(t.spark, "wrapped")
    rows = t.events.select("event_id", "event_type", F.from_json("props", "k long").alias("props"))
    fl.write_json_arrays(rows, path, head='{"meta": [{"event_id": -1}, "]}"],\n "data": [', tail="], \"more\": [{}]}")
    back = in_small_splits(t, path, lambda: fl.read_json(t.spark, path))
    return back.select("event_id", "event_type", F.col("props.k").cast("long").alias("k"))


@query("json_data_array", f"select {CUSTOMER} from customer")
def _(t: Tables):
    path = work_folder(t.spark, "json")
    customers(t).select(F.array(F.struct("*")).alias("data")).write.json(path)
    return fl.read_json(t.spark, path, lines=True)


@query("json_sparse", "select event_id, value, event_type from dirty_events")
def _(t: Tables):
    """Records lack the keys of their null cells; the schema is the union over all records."""
    path = work_folder(t.spark, "sparse")
    t.dirty_events.select("event_id", "value", "event_type").write.json(path)
    return fl.read_json(t.spark, path, lines=True).select("event_id", "value", "event_type")


@query("json_path_rows", "select o_orderkey, o_orderstatus, o_totalprice from orders")
def _(t: Tables):
    path = work_folder(t.spark, "payload")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    rows.select(F.struct(F.array(F.struct("*")).alias("items")).alias("result")).write.json(path)
    return fl.read_json(t.spark, path, "result.items", lines=True)


@query("odata_rows", "select n_nationkey::bigint as n_nationkey, n_name from nation")
def _(t: Tables):
    path = work_folder(t.spark, "odata")
    head = '{"@odata.context": "$metadata#Nations", "value": ['
    fl.write_json_arrays(t.nation.select("n_nationkey", "n_name"), path, head, '], "@odata.nextLink": null}')
    return fl.read_odata(t.spark, path)


@query("json_path", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def _(t: Tables):
    return t.events.select("event_id", fl.json_value(F.col("props"), "k").cast("long").alias("k"))


@query("json_text", "select event_id, json_extract_string(props, '$.k')::bigint as k from events")
def _(t: Tables):
    parsed = fl.read_json_text(t.events.select("event_id", "props"), "props", "k long")
    return parsed.select("event_id", "props.k")


@query("preview_rows")
def _(t: Tables):
    return fl.preview(t.lineitem, 100)


@query("snapshot_round_trip", f"""select {CUSTOMER}, 1::bigint as version from customer union all
  select {CUSTOMER}, 2 from customer where c_acctbal > 0 union all select {CUSTOMER}, 3 from customer""")
def _(t: Tables):
    store = sn.Snapshots(t.spark, work_folder(t.spark, "versions"))
    first = store.write(customers(t), "loaded")
    store.write(customers(t).where("c_acctbal > 0"), "removed debts")
    store.restore(first)
    parts = [store.read(v).withColumn("version", F.lit(v).cast("long")) for v in (1, 2, 3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snapshot_log", """select 1::bigint as version, 0::bigint as parent, count(*) as rows, 5::bigint as columns, 'loaded' as step
  from customer union all select 2, 1, count(*), 5, 'removed debts' from customer where c_acctbal > 0
  union all select 3, 1, count(*), 5, 'restored version 1' from customer""")
def _(t: Tables):
    store = sn.Snapshots(t.spark, work_folder(t.spark, "versions"))
    first = store.write(customers(t), "loaded")
    store.write(customers(t).where("c_acctbal > 0"), "removed debts")
    store.restore(first)
    return store.log().drop("score")


@query("html_tables", """select o_orderkey as page_id, 0 as table_ix, 0 as row_ix, o_orderstatus as status, o_orderpriority as col_1
  from orders union all select o_orderkey, 1, 0, null, 'A & B' from orders
  union all select o_orderkey, 1, 1, null, o_orderstatus from orders""")
def _(t: Tables):
    html = F.concat(
        F.lit("<html><p>x</p><table><tr><th>status</th><th> </th></tr><tr><td> "), F.col("o_orderstatus"), F.lit("</td><td><b>"),
        F.col("o_orderpriority"), F.lit("</b></td></tr></table><TABLE><tr><td>1<td>A &amp; B</tr><tr><td>2</td><td>"),
        F.col("o_orderstatus"), F.lit("</td></tr></TABLE></html>"),
    )
    rows = ht.html_tables(t.orders.select(F.col("o_orderkey").alias("page_id"), html.alias("html")))
    return rows.select("page_id", "table_ix", "row_ix", F.col("cells")["status"].alias("status"), F.col("cells")["Col_1"].alias("col_1"))


@query("html_tables_pages", "select page_id, 0 as row_ix, url, length(html)::varchar as size from pages")
def _(t: Tables):
    """All pages with one table of their own facts appended; of each page's tables the one with those heads."""
    facts = F.concat("html", F.lit("</script></style><table><tr><th>page address</th><th>page size</th></tr><tr><td>"), "url",
                     F.lit("</td><td>"), F.length("html").cast("string"), F.lit("</td></tr></table>"))
    rows = ht.html_tables(t.pages.select("page_id", facts.alias("html")))
    own = rows.where(F.col("cells")["page address"].isNotNull())
    return own.select("page_id", "row_ix", F.col("cells")["page address"].alias("url"), F.col("cells")["page size"].alias("size"))


def safe_sql(column: str) -> str:
    out = f"coalesce({column}, '')"
    for phrase, mark in UNSAFE_PHRASES:
        out = f"regexp_replace({out}, '{phrase}', '{mark}', 'gi')"
    return out


@query("sanitize_text", f"select doc_id, md5({safe_sql('text')}) as digest, length({safe_sql('text')}) as n from documents")
def _(t: Tables):
    safe = sanitize(F.col("text"), None)
    return t.documents.select("doc_id", F.md5(safe).alias("digest"), F.length(safe).cast("long").alias("n"))


@query("sanitize_conversations", f"""select conv_id, turn, s as safe
  from (select conv_id, turn, {safe_sql("concat(role, ': ', text)")} as s from conversations)""")
def _(t: Tables):
    return t.conversations.select("conv_id", "turn", sanitize(F.concat("role", F.lit(": "), "text")).alias("safe"))
