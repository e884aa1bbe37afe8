"""Delimited text, JSON and database tables in; CSV out."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framewright.sources import delimited, json_records


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None,
                   encoding: str = "UTF-8") -> DataFrame:
    """CSV, TSV or TXT with a header: trimmed names, blank-named columns and all-blank rows left out.

    Quoted fields may hold line breaks and separators; files are still read in splits. Types are inferred from all cells unless a
    schema is given, and the separator is found from the data unless it is given; on large inputs both save a pass. Text in another
    encoding than UTF-8 goes through the plain reader, one task a file.
    """
    if encoding.upper().replace("_", "-") in ("UTF-8", "UTF8"):
        df = delimited.read_records(spark, path, sep, schema)
    else:
        reader = spark.read.option("header", True).option("sep", sep or ",").option("encoding", encoding).option("multiLine", True)
        df = reader.option("escape", '"').csv(path) if schema is None else reader.option("escape", '"').schema(schema).csv(path)
        kept = [c for i, c in enumerate(df.columns) if c.strip() and c != f"_c{i}"]  # the reader names a blank header by its place
        df = df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in kept])
    if not df.columns:
        return df
    filled = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) != "", F.lit(False)) for c in df.columns]
    df = df.where(reduce(or_, filled))
    return df if schema is not None else delimited.inferred(df)


def rows_at(df: DataFrame, path: str = "") -> DataFrame:
    """Rows at a dotted path: an array gives its elements, one object gives one row, scalars a ``value`` column."""
    column, dtype = (F.col(path), df.select(F.col(path)).schema.fields[0].dataType) if path else (None, None)
    if column is None:
        return df
    if isinstance(dtype, T.ArrayType):
        df, dtype = df.select(F.explode(column).alias("_e")), dtype.elementType
    else:
        df = df.select(column.alias("_e")).where(F.col("_e").isNotNull())
    if isinstance(dtype, T.StructType):
        return df.select("_e.*")
    return df.select(F.col("_e").alias("value"))


def read_json(spark: SparkSession, path: str, rows: str | None = None, schema: T.StructType | str | None = None,
              lines: bool = False) -> DataFrame:
    """A JSON array, ``{"data": [...]}``, one object, or one object per line (``lines`` saves the search for records).

    All keys of all records become columns. ``rows`` names the path of the records, ``data`` is found by itself. Arrays are read in
    splits, however they are laid out; only a path of several keys needs a file to be read by one task.
    """
    if not lines and "." not in (rows or ""):
        found = json_records.records(spark, path, rows or "data")
        if schema is not None:
            return found.select(F.from_json("text", T.StructType.fromDDL(schema).toDDL() if isinstance(schema, str) else
                                            schema.toDDL()).alias("r")).select("r.*")
        records = spark.read.json(json_records.as_lines(found))
        if records.columns:
            return records  # without any object in it, the array holds plain values
    reader = spark.read.option("multiLine", not lines)
    df = reader.schema(schema).json(path) if schema is not None else reader.json(path)
    if rows is None and "data" in df.columns and isinstance(df.schema["data"].dataType, T.ArrayType):
        rows = "data"
    return rows_at(df, rows) if rows else df


def read_json_text(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """JSON held in a text column, parsed with a schema next to the other columns."""
    return df.withColumn(column, F.from_json(F.col(f"`{column}`"), schema))


def read_odata(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A landed OData payload: rows under ``value``."""
    return read_json(spark, path, "value", schema)


def json_value(text, path: str):
    """The value at a dotted path of JSON text, as text."""
    return F.get_json_object(text, "$." + path)


def database_options(url: str, query_or_table: str, properties: dict[str, str] | None = None,
                     partition: tuple[str, int, int, int] | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """JDBC reader options of a table name or a query."""
    options = {"url": url, "fetchsize": str(fetch_size), **(properties or {})}
    text = query_or_table.strip().rstrip(";")
    is_query = text.lower().startswith(("select ", "with "))
    if partition:
        column, lower, upper, parts = partition
        options |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}
        options["dbtable"] = f"({text}) t" if is_query else text
    else:
        options["query" if is_query else "dbtable"] = text
    return options


def read_database(spark: SparkSession, url: str, query_or_table: str, properties: dict[str, str] | None = None,
                  partition: tuple[str, int, int, int] | None = None, fetch_size: int = 10_000) -> DataFrame:
    """A JDBC table or query. ``partition`` = (column, lower, upper, parts) makes it a parallel read."""
    options = database_options(url, query_or_table, properties, partition, fetch_size)
    return spark.read.format("jdbc").options(**options).load()


def list_tables(spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Tables and views of a database from its information schema."""
    text = ("select table_schema, table_name, table_type from information_schema.tables "
            "where table_schema not in ('pg_catalog', 'information_schema', 'sys', 'mysql', 'performance_schema')")
    return read_database(spark, url, text, properties)


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    """The first rows; on a database source the limit is pushed into the query."""
    return df.limit(rows)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cleaned rows or any result table as CSV part files with a header."""
    df.write.mode(mode).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def write_json_arrays(df: DataFrame, path: str, head: str = "[", tail: str = "]") -> None:
    """Rows as JSON, every part file one array (or what ``head`` and ``tail`` wrap it in)."""
    def wrap(batches):
        import pyarrow as pa

        last = None
        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([head if last is None else last + ","])], names=["value"])
                last = text
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last, tail])], names=["value"])

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(wrap, "value string").write.text(path)


def read_csv_like(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a written CSV back with the schema it was written from."""
    return spark.read.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").schema(like.schema).csv(path)
