"""Delimited text with quoted line breaks, read in splits, and the separator found from the data.

A line with quotes is scanned field by field; a quote opens a field only at its start and a doubled quote stays inside, so stray quotes
in plain fields do no harm. A quote that is never closed makes one record of the rest of its file, as in any reader.
"""

from __future__ import annotations

import csv
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from framewright.sources.splits import HEAD, PIECES, TAIL, WHOLE, before, lines_of, pieces, scan, whole_records, with_state

#: Separators looked for, in order of preference.
CANDIDATES = (",", "\t", ";", "|", "\x1e", "\x1f")
INSIDE = re.compile(r'(?:[^"]+|"")*+"')
NUMBER, WHOLE_NUMBER = r"^\s*-?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$", r"^\s*-?\d+\s*$"
DATE, MOMENT = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}"


class Lines:
    """Where a line leads: from the start of a record, or from inside a quoted field, to one of the two."""

    def __init__(self, sep: str):
        s = re.escape(sep)
        self.sep = sep
        self.closed = re.compile(rf'(?:(?:"(?:[^"]+|"")*+"[^{s}]*+|(?!")[^{s}]*+)(?:{s}|$))*+$', re.DOTALL)

    def after(self, line: str, inside: bool) -> bool:
        if not inside and self.closed.fullmatch(line):
            return False
        at = 0
        while True:
            if not inside:
                if not line.startswith('"', at):
                    at = line.find(self.sep, at) + len(self.sep)
                    if at < len(self.sep):
                        return False
                    continue
                at += 1
            end = INSIDE.match(line, at)
            if end is None:
                return True
            inside = False
            at = line.find(self.sep, end.end()) + len(self.sep)
            if at < len(self.sep):
                return False


def find_separator(lines: DataFrame) -> str:
    """The separator that most lines hold equally often, counted over all lines without their quoted parts."""
    plain = F.regexp_replace("value", '"[^"]*"', "")
    counts = F.array(*[F.struct(F.lit(i).alias("i"), F.regexp_count(plain, F.lit(re.escape(c))).alias("n")) for i, c in
                       enumerate(CANDIDATES)])
    found = lines.where(F.trim("value") != "").select(F.inline(counts)).groupBy("i", "n").agg(F.count("*").alias("lines"))
    best = found.where("n > 0").groupBy("i").agg(F.max(F.struct("lines", "n")).alias("m"))
    top = best.orderBy(F.col("m.lines").desc(), F.col("m.n").desc(), "i").select("i").first()
    return CANDIDATES[top["i"]] if top else ","


def records(lines: DataFrame, sep: str) -> DataFrame:
    """(file, block, ordinal, text) of the records of delimited text that are not blank; ordinals count within a split."""
    rule = Lines(sep)

    def ends(parts):
        """Per split: the state after it and whether a record starts in it, for both states it may begin in."""
        key, now, starts = None, [False, True], [False, False]

        def row():
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *now, *starts)],
                                              names=["file", "block", "end0", "end1", "has0", "has1"])

        for at, b, is_first in parts:
            if is_first:
                if key is not None:
                    yield row()
                key, now, starts = at, [False, True], [False, False]
            values = b.column("value")
            quoted = np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))
            for q in quoted:
                line = values[q].as_py()
                for s in (0, 1):
                    starts[s] = starts[s] or not now[s]
                    now[s] = rule.after(line, now[s])
            if not len(quoted) or quoted[-1] < len(values) - 1:
                starts = [a or not n for a, n in zip(starts, now)]
        if key is not None:
            yield row()

    splits = scan(lines, ends, "file string, block long, end0 boolean, end1 boolean, has0 boolean, has1 boolean")
    # a split either fixes the state after it (fixed), keeps it or turns it; turns are counted since the last fixed one
    splits = splits.withColumns({"fixed": F.when(F.col("end0") == F.col("end1"), F.col("end0").cast("int")),
                                 "turn": (F.col("end0") & ~F.col("end1")).cast("int")})
    turns = F.coalesce(before(F.sum("turn")), F.lit(0))
    splits = splits.withColumn("turns", turns)
    known = F.when(F.col("fixed").isNotNull(), F.struct("fixed", F.col("turns").alias("at")))
    since = before(F.last(known, ignorenulls=True))
    inside = (F.coalesce(since["fixed"], F.lit(0)) + F.col("turns") - F.coalesce(since["at"], F.lit(0))) % 2 == 1
    odd = splits.withColumn("inside", inside).where("inside").select("file", "block", "inside")

    def group(parts):
        key, inside, ordinal, held, kind = None, False, 0, [], WHOLE

        def out(rows, text, kind):
            nonlocal ordinal
            if kind != WHOLE or text.strip():
                rows.append((*key, ordinal, kind, text))
                ordinal += 1

        for at, b, is_first in parts:
            rows = []
            if is_first:
                if held:
                    out(rows, "\n".join(held), kind if not inside else TAIL if kind == WHOLE else HEAD)
                    yield pieces(rows)
                    rows = []
                inside = bool(b.column("inside")[0].as_py())
                key, ordinal, held, kind = at, 0, [], HEAD if inside else WHOLE
            values = b.column("value")
            quoted = set(np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False)).tolist())
            if not quoted and not inside and not held:  # nothing but whole lines
                filled = values.filter(pc.not_equal(pc.utf8_trim_whitespace(values), ""))
                n = len(filled)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()),
                     pa.array(np.arange(ordinal, ordinal + n)), pa.array([WHOLE] * n, pa.int32()), filled.cast(pa.string())],
                    names=["file", "block", "ordinal", "kind", "text"])
                ordinal += n
                continue
            for i, line in enumerate(values.to_pylist()):
                held.append(line)
                if i in quoted:
                    inside = rule.after(line, inside)
                if not inside:
                    out(rows, "\n".join(held), kind)
                    held, kind = [], WHOLE
            if rows:
                yield pieces(rows)
        if held:
            rows = []
            out(rows, "\n".join(held), TAIL if kind == WHOLE else HEAD)
            yield pieces(rows)

    found = scan(with_state(lines, odd), group, PIECES)
    return whole_records(found, "\n")


def _names(header: str, sep: str) -> list[str]:
    """Trimmed names of a header record; a repeated name gets its place."""
    names = [n.strip() for n in next(csv.reader([header.lstrip("\ufeff").rstrip("\r")], delimiter=sep), [])]
    return [n if n == "" or names.index(n) == i else f"{n}_{i}" for i, n in enumerate(names)]


def inferred(df: DataFrame) -> DataFrame:
    """Text columns as int, long, double, boolean, date or time where every filled cell of the column is one."""
    def fits(c: str) -> dict:
        v = F.col(f"`{c}`")
        whole = v.rlike(WHOLE_NUMBER)
        return {"n": v.isNotNull(), "int": whole & v.try_cast("int").isNotNull(), "bigint": whole & v.try_cast("bigint").isNotNull(),
                "double": v.rlike(NUMBER), "boolean": F.lower(F.trim(v)).isin("true", "false"),
                "date": v.rlike(DATE) & v.try_cast("date").isNotNull(),
                "timestamp": v.rlike(MOMENT) & v.try_cast("timestamp").isNotNull()}

    tests = [(i, c, fits(c)) for i, c in enumerate(df.columns)]
    if not tests:
        return df
    facts = df.agg(*[F.count_if(t).alias(f"{kind}_{i}") for i, _, f in tests for kind, t in f.items()]).first()
    out = []
    for i, c, kinds in tests:
        n = facts[f"n_{i}"]
        kind = next((k for k in kinds if k != "n" and n and facts[f"{k}_{i}"] == n), None)
        v = F.col(f"`{c}`")
        out.append((F.trim(v).try_cast(kind) if kind else v).alias(c))
    return df.select(*out)


def read_records(spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited UTF-8 text with a header record in every file, one row per record, quoted line breaks kept.

    Without a schema the types are inferred from all cells, which costs a pass; so does finding the separator.
    """
    lines = lines_of(spark, path)
    sep = sep or find_separator(lines)
    found = records(lines, sep).withColumn("text", F.regexp_replace("text", r"\r$", ""))
    top = (F.col("block") == 0) & (F.col("ordinal") == 0)
    if schema is None:  # a given schema names the columns, so no pass is made for the header
        header = found.where(top).orderBy("file").select("text").first()
        names = _names(header["text"], sep) if header else []
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxColumns": "100000"}
    if schema is not None:
        wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    else:
        wanted = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    if not wanted.fields:
        return spark.createDataFrame([], wanted)
    body = found.where(~top).select(F.from_csv("text", wanted.toDDL(), options).alias("r")).select("r.*")
    if schema is not None:
        return body
    kept = body.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n])
    return kept
