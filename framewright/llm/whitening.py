"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed. One distributed pass takes a block Q of directions and returns Xc' (Xc Q) / n, where Xc are the
rows minus their exact mean; tasks send one small matrix each, eight tasks add them up, the driver sees eight. A sweep
applies a Chebyshev polynomial of that operator by its three-term recurrence, which damps the spectrum below the smallest Ritz value of
the block, then makes the block orthonormal (QR) and takes the Rayleigh-Ritz pairs from one more pass. Sweeps go on until
the residual of every wanted pair certifies it: at rounding level, or no longer falling and below ``ACCEPT``. A sweep that gains
little widens the block, at most to the dimension, where Rayleigh-Ritz is exact.

Entries become whole numbers before anything else, so the sums, the mean and each row's deviation are exact: a row is centred by
subtracting the whole part of the mean in 64-bit integers and its fraction afterwards.

Edge cases: rows whose vector is null or holds null or non-finite entries are left out; shorter vectors count as padded with zero
entries (before the shift). Null and repeated ids and repeated rows each count as a row. Entries outside 2**42 count as the nearest bound.
A deviation that does not fit 64 bits is null. Directions without variance (up to rounding) cannot be whitened and have no rows, so equal
rows, a single row and an empty table give none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.hard_negatives import finite_vector
from framewright.llm.shared import matrix, ready, written

COMPONENTS, FACTOR, SHIFT = 8, 1024.0, 100_000
#: Directions in the block for each wanted one, degree of the filter, tasks that add up partial matrices.
WIDTH, DEGREE, ADDERS, SWEEPS = 4, 8, 8, 60
#: Residuals relative to the largest eigenvalue: certain at once, and good enough when they no longer fall.
CERTAIN, ACCEPT, FLAT = 1e-14, 1e-11, 1e-13
BOUND, LONG = 2.0**42, (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """The mean as whole part and remainder over n, the row count, and the certified eigenpairs."""

    n: int
    whole: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.rest / self.n


def entries(vector: Column, factor: float = FACTOR, shift: int = SHIFT) -> Column:
    """floor(factor * c) + shift of every entry, as long."""
    inside = lambda y: F.least(F.greatest(y, F.lit(-BOUND)), F.lit(BOUND))
    return F.transform(vector, lambda c: F.floor(inside(F.lit(factor) * c.cast("double"))) + F.lit(shift).cast("long"))


def _padded(vectors, dims: int, shift: int) -> np.ndarray:
    """The rows of a list column as a matrix of ``dims`` columns; absent entries are the shift."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    x = matrix(vectors)
    out = np.full((len(x), dims), shift, dtype=np.int64)
    out[:, :x.shape[1]] = x
    lengths = np.diff(vectors.offsets.to_numpy())
    out[np.arange(dims) >= lengths[:, None]] = shift
    return out


def _added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], dims: int, shift: int) -> np.ndarray:
    """Sum over all rows of the matrices that ``part`` gives for a batch of rows."""
    def local(batches):
        total = None
        for b in batches:
            if b.num_rows:
                one = part(_padded(b.column("x"), dims, shift))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches):
        total = None
        for b in batches:
            for m in b.column("m").to_pylist():
                one = np.frombuffer(m)
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    sums = rows.select("x").mapInArrow(local, "m binary").repartition(ADDERS).mapInArrow(add, "m binary").collect()
    return sum(np.frombuffer(r["m"]) for r in sums)


def _mean(rows: DataFrame) -> tuple[int, list[int]]:
    """Row count and exact sum of each dimension (of the entries that are there)."""
    def local(batches):
        n, high, low = 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            x = matrix(b.column("x"))
            wide = max(x.shape[1], len(high))
            high, low = np.pad(high, (0, wide - len(high))), np.pad(low, (0, wide - len(low)))
            high[:x.shape[1]] += (x >> 20).sum(axis=0)
            low[:x.shape[1]] += (x & 0xFFFFF).sum(axis=0)
            n += len(x)
        rows_of = [np.arange(-1, len(high)), np.append(n, high), np.append(0, low)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows_of], names=["i", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c) for c in ("high", "low")]
    sums = {r["i"]: (int(r["high"]) << (20 if r["i"] >= 0 else 0)) + int(r["low"])
            for r in rows.select("x").mapInArrow(local, "i long, high long, low long").groupBy("i").agg(*wide).collect()}
    return sums.get(-1, 0), [sums[i] for i in range(len(sums) - 1)]


def _filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, degree: int, upper: float, top: float) -> np.ndarray:
    """The scaled Chebyshev polynomial of the operator on q: small on [0, upper], one at ``top``."""
    half = upper / 2
    sigma = first = half / (top - half)
    now = (apply(q) - half * q) * (sigma / half)
    before = q
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        now, before = (apply(now) - half * now) * (2 * after / half) - sigma * after * before, now
        sigma = after
    return now


def fit(rows: DataFrame, components: int = COMPONENTS, shift: int = SHIFT, seed: int = 7) -> Fit | None:
    """The certified leading eigenpairs of the covariance of the rows' ``x`` vectors; None without rows or dimensions."""
    n, sums = _mean(rows)
    dims = len(sums)
    if not n or not dims:
        return None
    # entries that shorter rows lack count as the shift
    short = {r["k"]: r["n"] for r in rows.groupBy(F.size("x").alias("k")).agg(F.count("*").alias("n")).collect()}
    sums = [s + shift * sum(c for k, c in short.items() if k <= i) for i, s in enumerate(sums)]
    mean = Fit(n, np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=np.float64), None, None, 0.0)
    centred, squares = mean.centred, lambda x: (mean.centred(x)**2).sum(axis=0)
    trace = float(_added(rows, squares, dims, shift).sum()) / n
    wanted, width, degree = min(components, dims), min(dims, WIDTH * components), DEGREE
    if trace == 0:
        return Fit(n, mean.whole, mean.rest, np.zeros(0), np.zeros((dims, 0)), trace)

    def apply(q: np.ndarray) -> np.ndarray:
        def part(x):
            c = centred(x)
            return (c.T @ (c @ q)).ravel()
        return _added(rows, part, dims, shift).reshape(q.shape) / n

    random = np.random.default_rng(seed)
    q = np.linalg.qr(random.standard_normal((dims, width)))[0]
    last = np.inf
    for _ in range(SWEEPS):
        image = apply(q)
        small = q.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residual = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        if residual <= CERTAIN or (residual <= ACCEPT and residual > last / 4) or q.shape[1] == dims:
            keep = [i for i in range(wanted) if values[i] > FLAT * values[0]]
            vectors = q[:, keep]
            signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(keep))])
            return Fit(n, mean.whole, mean.rest, values[keep], vectors * signs, trace)
        if residual > last / 10:
            q = np.hstack([q, random.standard_normal((dims, min(dims - q.shape[1], q.shape[1])))])
        last, upper = residual, max(values[-1], FLAT * values[0])
        if q.shape[1] < dims:
            q = _filtered(apply, q, degree, upper, values[0])
        q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"not certified after {SWEEPS} sweeps: residual {last:.1e}")


def _deviation(found: Fit, x: np.ndarray) -> list:
    """Sum over dimensions of (n x - S)^2 of each row, exactly; None beyond 64 bits."""
    off, rest = x - found.whole, found.rest.astype(np.int64)
    most = found.n * (int(np.abs(off).max()) + 1) if off.size else 0
    if most * most * x.shape[1] <= LONG:
        return ((found.n * off - rest)**2).sum(axis=1).tolist()
    exact = ((found.n * off.astype(object) - rest.astype(object))**2).sum(axis=1)
    return [int(d) if d <= LONG else None for d in exact]


def whiten(rows: DataFrame, components: int = COMPONENTS, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row (vec_id, x) and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(rows, components, shift)
    if found is None or not len(found.values):
        return rows.sparkSession.createDataFrame([], schema)
    dims, k = found.vectors.shape
    project = lambda x: found.centred(x) @ found.vectors / np.sqrt(found.values)

    def moments(x):
        w = project(x)
        return np.vstack([w.T @ w, w.sum(axis=0)]).ravel()

    total = _added(rows, moments, dims, shift).reshape(k + 1, k) / found.n
    error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    explained = found.values / found.trace

    def task(batches):
        for b in batches:
            x = _padded(b.column("x"), dims, shift)
            at = np.repeat(np.arange(len(x)), k)
            many = len(at)
            cols = [b.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(many, found.n, dtype=np.int64)), pa.array(_deviation(found, x), pa.int64()).take(pa.array(at)),
                    pa.array(project(x).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(many, error))]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained",
                                                          "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(task, schema)


def whitened(embeddings: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The whitened leading components of an embedding table."""
    ready(embeddings.sparkSession)
    rows = embeddings.where(finite_vector(F.col(vector))).select("vec_id", entries(F.col(vector)).alias("x"))
    return whiten(written(rows, "whitening-rows"), components)
