"""Repeated sentence spans: exact duplicates of passages across and inside documents.

A text is cut into sentences: after words that end in . ! ? and at line ends. Sentences of more than GAP words are cut further by
winnowing: of every GAP consecutive words the last sentence end, or else the word of the smallest hash, is a cut. So no piece has
more than GAP words, and a cut depends on the words around it alone: a passage is cut alike in any surroundings, from the first
cut among its first GAP words to the last one among its last GAP words. From every piece a span runs over the following pieces until it has
MIN_WORDS words; each passage of 2 * GAP + MIN_WORDS words or more holds a whole span wherever it stands. The spans' 128-bit
hashes are joined globally; the document of the smallest id keeps a repeated span, all others (and later repeats in the same document)
lose its pieces. Case and white space do not count.

Hot passages: the first document of a hash is a minimum, summed up before the shuffle; the join back is by hash and can be split.
Edge cases: null and empty texts have no spans; null ids are nobody's first document and left out; rows that repeat an id are
one document; texts with fewer words than a span are never touched; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import slot_filter, written

MIN_WORDS, GAP = 20, 12
WORD = re.compile(r"\S+")
END = re.compile(r"[.!?][\"'\u2019\u201d)\]]*\Z")
MARKS = frozenset(".!?\"'\u2019\u201d)]")


def cuts(keys: np.ndarray) -> np.ndarray:
    """Places of the last smallest key of every GAP consecutive ones, ascending."""
    width = min(GAP, len(keys))
    windows = sliding_window_view(keys[::-1], width)
    return np.unique(len(keys) - 1 - (np.arange(len(windows)) + windows.argmin(axis=1)))


def spans(text: str) -> list[tuple[bytes, int, int]]:
    """(hash, start, end) of the span that starts at each piece; none where too few words follow."""
    at = np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)
    n = len(at)
    if n < MIN_WORDS:
        return []
    found = text.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, n)
    keys = hashes | np.uint64(1)
    keys[[i for i, w in enumerate(found) if w[-1] in MARKS and END.search(w)]] = 0
    lines = np.array([m.start() for m in re.finditer("\n", text)], np.int64)
    if len(lines):
        before = np.searchsorted(at[:, 0], lines) - 1
        keys[before[before >= 0]] = 0
    stops = cuts(keys) + 1
    if stops[-1] < n:
        stops = np.append(stops, n)
    starts = np.concatenate([[0], stops[:-1]])
    last = np.searchsorted(stops, starts + MIN_WORDS)
    last = last[last < len(stops)]
    raw = memoryview(hashes.tobytes())
    return [(xxhash.xxh3_128_digest(raw[8 * i:8 * j]), a, b) for i, j, a, b in zip(
        starts[:len(last)].tolist(), stops[last].tolist(), at[starts[:len(last)], 0].tolist(), at[stops[last] - 1, 1].tolist())]


def span_rows(docs: DataFrame) -> DataFrame:
    """A row per span; ``again`` marks later occurrences in the same document."""

    def run(batches):
        for batch in batches:
            ids, high, low, start, end, again = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                seen = set()
                for digest, a, b in spans(text or ""):
                    ids.append(doc_id)
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
                    start.append(a)
                    end.append(b)
                    again.append(digest in seen)
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()),
                 pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(again, pa.bool_())],
                ["doc_id", "h1", "h2", "start", "stop", "again"])

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, h1 long, h2 long, start int, stop int, again boolean")


def repeated(docs: DataFrame) -> DataFrame:
    """Per document that loses something: its repeated spans (start, stop), sorted; they may overlap."""
    rows = written(span_rows(docs), "spans")
    firsts = rows.where("not again").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    shared = firsts.where("first < last").select("h1", "h2", "first")
    across = rows.where("not again").join(shared, ["h1", "h2"]).where("doc_id > first").select("doc_id", "start", "stop")
    within = rows.where("again").select("doc_id", "start", "stop")
    lost = across.unionByName(within)
    return lost.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))


def merged(cut: list[dict]) -> list[list[int]]:
    """Sorted intervals with overlapping or touching ones joined."""
    out: list[list[int]] = []
    for s in cut:
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, spans, n_removed characters, text) of every document that loses a span; the text is what stays."""
    gone = written(repeated(docs), "repeats")

    def run(batches):
        for batch in batches:
            cuts = [merged(c) for c in batch.column("spans").to_pylist()]
            texts = []
            for text, cut in zip(batch.column("text").to_pylist(), cuts):
                inner = zip([0, *[b for _, b in cut]], [*[a for a, _ in cut], len(text)])
                texts.append("".join(text[a:b] for a, b in inner))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, cuts), pa.int64()),
                 pa.array([",".join(f"{a}:{b}" for a, b in c) for c in cuts], pa.string()),
                 pa.array([sum(b - a for a, b in c) for c in cuts], pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_spans", "spans", "removed_chars", "text"])

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = slot_filter(rows, "doc_id", gone.select("doc_id")).join(gone, "doc_id")
    return joined.mapInArrow(run, "doc_id long, n_spans long, spans string, removed_chars long, text string")
