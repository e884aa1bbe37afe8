"""The records of JSON arrays of any size and layout, found in file splits.

The text is cut at closing braces. Whether such a brace ends a record depends on the strings and the nesting before it; a task follows
both for the two states a split may begin in (inside a string or not), with depths counted from the start of the split. Prefix
sums over the splits give the true state and depth, and then the braces that close a record.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from framewright.session import work_folder
from framewright.sources.splits import HEAD, PIECES, TAIL, WHOLE, before, lines_of, pieces, scan, whole_records, with_state

ESCAPED = re.compile(r"\\.", re.DOTALL)
TOKEN = re.compile(r'"((?:[^"\\]|\\.)*+)"(\s*:\s*\[)?|[\[\]{}]', re.DOTALL)
CLOSING = re.compile(r'(?:[^"\\]|\\.)*+"', re.DOTALL)
FAR = 1 << 30


def change(text: str, inside: bool) -> tuple[bool, int]:
    """(whether a string is open after the text, change of depth) for text that begins inside a string or not."""
    parts = ESCAPED.sub("", text).split('"')
    plain = parts[1 if inside else 0::2]
    depth = sum(p.count("{") + p.count("[") - p.count("]") - p.count("}") for p in plain)
    return inside ^ (len(parts) % 2 == 0), depth


def tokens(text: str, inside: bool):
    """Structural marks and keys of arrays outside strings: (place, mark or None, key or None); a key brings its bracket along."""
    at = 0
    if inside:
        end = CLOSING.match(text)
        if end is None:
            return
        at = end.end()
    for m in TOKEN.finditer(text, at):
        if m.group(1) is None:
            yield m.start(), m.group(), None
        elif m.group(2):
            yield m.start(), "[", m.group(1)


def _ends(parts):
    """Per split and starting state: the state after it, the change of depth, and its shallowest array key (the last one of those)."""
    key, now, depth, low, name, opens = None, None, None, None, None, None

    def row():
        values = [*key, opens, *now, *depth, *low, *name]
        kinds = [pa.string(), pa.int64(), pa.string(), *[pa.bool_()] * 2, *[pa.int64()] * 4, *[pa.string()] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=NAMES)

    for at, b, is_first in parts:
        if is_first:
            if key is not None:
                yield row()
            key, now, depth, low, name, opens = at, [False, True], [0, 0], [FAR, FAR], [None, None], None
        for text in b.column("value").to_pylist():
            opens = opens or text.lstrip("\ufeff \t\r\n")[:1] or None
            closes = text.count("]")
            for s in (0, 1):
                if depth[s] - closes <= low[s] and ":" in text:
                    d = depth[s]
                    for _, mark, k in tokens(text, now[s]):
                        if k is not None and d <= low[s]:
                            low[s], name[s] = d, k
                        d += 1 if mark in "{[" else -1
                after, by = change(text, now[s])
                now[s], depth[s] = after, depth[s] + by - (not after)
    if key is not None:
        yield row()


NAMES = ["file", "block", "opens", "end0", "end1", "depth0", "depth1", "low0", "low1", "key0", "key1"]
STATES = ("file string, block long, opens string, end0 boolean, end1 boolean, depth0 long, depth1 long, low0 long, low1 long, "
          "key0 string, key1 string")


def _records(wanted: str):
    def group(parts):
        key, ordinal, held, kind, inside, depth, base, name = None, 0, [], WHOLE, False, 0, 0, None

        def flush(rows, kind):
            nonlocal ordinal, held
            rows.append((*key, ordinal, kind, "".join(held)))
            held, ordinal = [], ordinal + 1

        for at, b, is_first in parts:
            rows = []
            if is_first:
                if held:
                    flush(rows, TAIL if kind == WHOLE else HEAD)
                key, ordinal, held = at, 0, []
                inside, depth, base, name = (b.column(c)[0].as_py() for c in ("inside", "depth", "base", "key"))
                is_open = depth > base and (base < 2 or name == wanted)
                kind = HEAD if is_open else WHOLE
            for text in b.column("value").to_pylist():
                start = 0 if is_open else None
                if start is None and depth <= base:  # look for the brace that opens the next record
                    d = depth
                    for place, mark, k in tokens(text, inside):
                        if k is not None and d == 1:
                            name = k
                        if mark == "{" and d == base and (base < 2 or name == wanted):
                            start, is_open = place, True
                            break
                        d += 1 if mark in "{[" else -1
                after, by = change(text, inside)
                inside, depth = after, depth + by - (not after)
                if start is not None:
                    held.append(text[start:] + "}")
                if is_open and depth == base and not inside:
                    flush(rows, kind)
                    kind, is_open = WHOLE, False
            if rows:
                yield pieces(rows)
        if held:
            rows = []
            flush(rows, TAIL if kind == WHOLE else HEAD)
            yield pieces(rows)
    return group


def records(spark: SparkSession, path: str, wanted: str = "data") -> DataFrame:
    """(file, block, ordinal, text) of the objects of a top-level array, of the array under a key of the top-level object, or, where
    neither is there, of the top-level objects themselves. Plain values between the objects of an array are left out."""
    cut = lines_of(spark, path, "}")
    splits = scan(cut, _ends, STATES)
    turn = F.col("end0").cast("int")  # end1 is its opposite: a split turns the string state or keeps it
    splits = splits.withColumn("inside", F.coalesce(before(F.sum(turn)), F.lit(0)) % 2 == 1)
    own = lambda a, b: F.when(F.col("inside"), F.col(b)).otherwise(F.col(a))
    splits = splits.withColumns({"by": own("depth0", "depth1"), "low": own("low0", "low1"), "name": own("key0", "key1")})
    splits = splits.withColumn("depth", F.coalesce(before(F.sum("by")), F.lit(0).cast("long")))
    splits = splits.withColumn("name", F.when(F.col("depth") + F.col("low") == 1, F.col("name")))
    every = Window.partitionBy("file")
    opens = F.first(F.when(F.col("block") == 0, F.col("opens")), ignorenulls=True).over(every)
    under = F.coalesce(F.max(F.col("name") == wanted).over(every), F.lit(False))
    splits = splits.withColumns({"base": F.when(opens == "[", 1).when(under, 2).otherwise(0).cast("long"),
                                 "key": before(F.last("name", ignorenulls=True))})
    found = scan(with_state(cut, splits.select("file", "block", "inside", "depth", "base", "key")), _records(wanted), PIECES)
    return whole_records(found, "")


def as_lines(found: DataFrame) -> str:
    """The records written one per line; the folder they are in."""
    folder = work_folder(found.sparkSession, "json-lines")
    found.select(F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.text(folder)
    return folder
