"""Hard negatives by Kronecker-packed inner products.

Every row is scored against every anchor once for positives (rows of the anchor's label) and once for negatives. The components
are whole numbers. Several candidates are packed into one wide integer: their components are biased to be non-negative and put
into separate bit fields, wide enough for a whole inner product, so one multiplication per anchor component scores all of them and
the fields hold the exact scores. As long as the packed sums stay below 2**53 the wide integer is kept in the mantissa of a
double, where a matrix product is exact in any order of addition; beyond that it is a Python integer of any width.

The anchors are a stated query set, not a join: they are written to the shared folder, and each task reads them block by block
against its own rows, so neither side is broadcast or collected. A task returns at most six candidates for an anchor (five for an
anchor and positive) per block of rows; a ranked limit merges them. Memory: a block of rows, a block of anchors, one tile of scores.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part. A null id is never an anchor; as a
candidate it comes after all ids of its score. Repeated rows each count as a row: an anchor leaves itself out once, its
copies are other rows, and repeated anchors each get their result. Shorter vectors count as padded with zeros, an empty
vector scores 0. A component outside 32 bits counts as the nearest 32-bit number, a score outside 64 bits is returned as the
nearest 64-bit number (the choice is made on the exact one within a block of rows). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.llm.shared import file_batches, folder_of, matrix, ready, written

POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Components held by a task at once, anchors read at once, scores of one tile.
BLOCK_CELLS, ANCHORS, TILE = 1 << 22, 512, 1 << 20
MANTISSA, LONG = 53, (1 << 63) - 1


def packed_scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products (rows x anchors) of whole numbers, several rows to one wide integer."""
    n, dims = rows.shape
    if not (n and dims and len(anchors)):
        return np.zeros((n, len(anchors)), dtype=np.int64)
    low, base = int(rows.min()), int(anchors.min())
    most = dims * (int(rows.max()) - low) * (int(anchors.max()) - base)
    bits = max(1, most.bit_length())
    fields = MANTISSA // bits
    kind = np.float64 if fields else object
    fields = fields or 4
    groups = -(-n // fields)
    wide = np.zeros((groups, dims), dtype=kind)
    for f in range(fields):
        part = (rows[f * groups:(f + 1) * groups] - low).astype(kind)
        wide[:len(part)] += part * (1 << bits * f)
    sums = wide @ (anchors - base).astype(kind).T
    exact = np.int64 if kind is np.float64 else object
    sums, mask = sums.astype(exact), (1 << bits) - 1
    biased = np.concatenate([sums >> bits * f & mask for f in range(fields)])[:n]
    of_rows, of_anchors = rows.astype(exact).sum(axis=1), anchors.astype(exact).sum(axis=1)
    return biased + (base * of_rows)[:, None] + (low * of_anchors - dims * low * base)[None, :]


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties in the given order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        places = np.sort(np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]]))
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places], kind="stable")]


def _blocks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sort key of ids, labels, vectors) of bounded blocks, each in order of label and id, null ids last."""
    held, size = [], 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        gone, plain = t["vec_id"].is_null().to_numpy(), t["vec_id"].fill_null(0).to_numpy()
        ids = np.where(gone, None, plain) if gone.any() else plain
        labels = t["label"].to_numpy()
        order = np.lexsort((plain, gone, labels))
        return ids[order], labels[order], matrix(t["vector"])[order], plain[order], gone[order]

    for b in batches:
        held.append(b)
        size += len(b.column("vector").flatten()) + b.num_rows
        if size >= cells:
            yield block()
            held, size = [], 0
    if held and sum(map(len, held)):
        yield block()


def _fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = max(a.shape[1], b.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, wide - m.shape[1])))
    return pad(a), pad(b)


def _long(score) -> int:
    return max(-LONG - 1, min(LONG, int(score)))


def _positive_task(folder: str, keep: int):
    def task(batches):
        for ids, labels, rows, _, _ in _blocks(batches, BLOCK_CELLS):
            for anchors in file_batches(folder, ["anchor", "label", "vector"], ANCHORS):
                names, of, vectors = anchors["anchor"].to_numpy(), anchors["label"].to_numpy(), matrix(anchors["vector"])
                left, right = _fit(rows, vectors)
                out = ([], [], [])
                for label in np.unique(of):
                    lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
                    if lo == hi:
                        continue
                    mine = np.flatnonzero(of == label)
                    step = max(1, TILE // (hi - lo))
                    for at in range(0, len(mine), step):
                        some = mine[at:at + step]
                        scores = packed_scores(left[lo:hi], right[some])
                        for j, a in enumerate(some):
                            best = first(scores[:, j], keep)
                            out[0].extend([names[a]] * len(best))
                            out[1].extend(_long(s) for s in scores[best, j])
                            out[2].extend(ids[lo + best])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64(), from_pandas=True) for c in out],
                                                 names=["anchor", "score", "vec_id"])
    return task


def _negative_task(folder: str, keep: int, low: int, high: int):
    def task(batches):
        for ids, labels, rows, plain, gone in _blocks(batches, BLOCK_CELLS):
            order = np.lexsort((plain, gone))
            ids, labels, rows = ids[order], labels[order], rows[order]
            step = max(1, TILE // ANCHORS)
            for anchors in file_batches(folder, ["anchor", "label", "vector", "scores"], ANCHORS):
                names, of = anchors["anchor"].to_numpy(), anchors["label"].to_numpy()
                bands = [[(-(-low * s // 100), high * s // 100) for s in each] for each in anchors["scores"].to_pylist()]
                least = np.array([min(lo for lo, _ in b) for b in bands])
                most = np.array([max(hi for _, hi in b) for b in bands])
                left, right = _fit(rows, matrix(anchors["vector"]))
                found = [([], []) for _ in names]
                for at in range(0, len(left), step):
                    scores = packed_scores(left[at:at + step], right)
                    fits = (scores >= least) & (scores <= most) & (labels[at:at + step, None] != of)
                    for j in np.flatnonzero(fits.any(axis=0)):
                        where = np.flatnonzero(fits[:, j])
                        found[j][0].append(where + at)
                        found[j][1].append(scores[where, j])
                out = ([], [], [], [])
                for j, (where, scores) in enumerate(found):
                    if not where:
                        continue
                    where, scores = np.concatenate(where), np.concatenate(scores)
                    for slot, (lo, hi) in enumerate(bands[j]):
                        inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                        best = inside[first(scores[inside], keep)]
                        out[0].extend([names[j]] * len(best))
                        out[1].extend([slot] * len(best))
                        out[2].extend(_long(s) for s in scores[best])
                        out[3].extend(ids[where[best]])
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip(out, kinds)],
                                                 names=["anchor", "slot", "score", "vec_id"])
    return task


def finite_vector(vector: Column) -> Column:
    """Whether a vector and all its components are there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, lambda x: bad(x.cast("double")))


def whole(vector: Column, factor: float) -> Column:
    """floor(factor * x) of every component, within 32 bits."""
    inside = lambda y: F.least(F.greatest(y, F.lit(-2.0**31)), F.lit(2.0**31 - 1))
    return F.transform(vector, lambda x: F.floor(inside(F.lit(factor) * x.cast("double"))).cast("int"))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """The best rows of other labels that score between ``low`` and ``high`` per cent of a positive, for every anchor and positive.

    ``rows`` has vec_id, label and vector (whole numbers, see ``whole``); anchors are the rows where ``is_anchor`` holds. The
    positives of an anchor are the ``positives`` other rows of its label with the highest inner product. Ties go to smaller ids.
    """
    ready(rows.sparkSession)
    rows = written(rows.select("vec_id", F.col("label").cast("long").alias("label"), "vector").where(F.col("label").isNotNull()),
                   "negatives-rows")
    number = F.monotonically_increasing_id().alias("anchor")
    anchors = written(rows.where(is_anchor).sort("label", "vec_id").select(number, "vec_id", "label", "vector"), "negatives-anchors")
    same = rows.mapInArrow(_positive_task(folder_of(anchors), positives + 1), "anchor long, score long, vec_id long")
    at_top = _ranked(same, ["anchor"], positives + 1).groupBy("anchor").agg(
        F.array_sort(F.collect_list(F.struct("rank", "score", "vec_id"))).alias("top"))
    own = F.aggregate("vector", F.lit(0).cast("decimal(38,0)"),
                      lambda s, x: (s + x.cast("decimal(18,0)") * x.cast("decimal(18,0)")).cast("decimal(38,0)"))
    own = F.least(own, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    joined = anchors.withColumn("own", own).join(at_top, "anchor")
    is_self = lambda t: (t["score"] == F.col("own")) & t["vec_id"].eqNullSafe(F.col("vec_id"))
    place = F.array_min(F.transform(F.filter("top", is_self), lambda t: t["rank"]))
    others = F.slice(F.filter("top", lambda t: ~t["rank"].eqNullSafe(place)), 1, positives)
    known = joined.select("anchor", "vec_id", "label", "vector", others.alias("others")).where(F.size("others") > 0)
    known = written(known.select("anchor", F.col("vec_id").alias("anchor_id"), "label", "vector", F.col("others.score").alias("scores"),
                                 F.col("others.vec_id").alias("ids")).sort("anchor"), "negatives-positives")
    found = rows.mapInArrow(_negative_task(folder_of(known), negatives, low, high),
                            "anchor long, slot int, score long, vec_id long")
    best = _ranked(found, ["anchor", "slot"], negatives)
    return best.join(known.drop("label", "vector"), "anchor").select(
        "anchor_id", F.col("ids")[F.col("slot")].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("scores")[F.col("slot")].alias("positive_score"),
        F.col("score").alias("negative_score"))


def mined(embeddings: DataFrame, vector: str = "embedding", every: int = 100, noisy: int = 7, classes: int = 10,
          factor: float = 256.0) -> DataFrame:
    """Hard negatives of an embedding table: components become floor(factor * x), anchors have ids divisible by ``every``, and the
    labels of ids divisible by ``noisy`` move to the next of ``classes`` first."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % noisy == 0, (label + 1) % classes).otherwise(label)
    rows = embeddings.where(finite_vector(F.col(vector)) & F.col("label").isNotNull()).select(
        "vec_id", moved.alias("label"), whole(F.col(vector), factor).alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % every == 0)
