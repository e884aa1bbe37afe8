"""Near duplicates by an LSH forest of MinHash signatures.

A text becomes the set of its distinct word shingles (64-bit hashes) and 128 minimum hashes. Texts with equal sets form one class
at once, however large. The first text of each class enters 16 trees; a tree is a total order of the classes by eight of the
minimum hashes. Range partitioning sorts each order evenly whatever the data look like; similar texts are neighbours, and the
depth that matters adapts to the region: a row is paired with its next three predecessors as long as they share a prefix of
at least ``MIN_DEPTH`` hashes, and with the first row of its region at several depths, so a large dense region gives a few pairs
a row instead of all pairs. Rows at the seams of partitions are paired too. A one-bit sketch of all 128 hashes drops pairs far
below the wanted similarity. What remains is confirmed on the full sets of the whole texts: first the best pair of every class,
then every pair whose ends are not yet connected. Confirmed pairs are the links; components are found by contraction.

The forest is only a fast start. What it leaves apart is settled exactly: two sets of the wanted similarity share at least
``SHARED`` (or all) of their rarest shingles, whatever the order of rarity, as long as the order is one for all. The rarest shingles
of all classes are joined and only pairs of different components are made: the classes of small components by one join of these
shingles with themselves. A component of ``LARGE`` classes and more meets them as one row a shingle; the classes, and members of other
large components, that share enough with it are compared with its members in blocks, on full sets, and no pair is a row.
The likeliest pair of every class is confirmed first, so that a region falls together before its other pairs are looked at.

The order of rarity follows the counts of all shingles in all texts: every batch of texts asks the buckets of the shingles for the
counts of its own, and reads the answers, four bits each, from the shared folder. A shingle that occurs once comes first and is never
joined. With an order from a sample of fixed size nearly all shingles of a larger table stand level, and the rarest of two texts of
a region are then those that all its texts share. The order affects the speed alone.

Edge cases: a null or blank text has an empty set and is linked with nothing; a text of fewer words than a shingle is one shingle;
a null id is linked with nothing, its component is null and it is kept; repeated rows of one id are one document and share its
component; an empty table gives no rows; texts may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.llm.graph import components
from framewright.llm.shared import folder_of, group_rows, removed, slot_filter, written
from framewright.session import work_folder

HASHES, TREES, DEPTH, MIN_DEPTH, NEIGHBOURS = 128, 16, 8, 3, 3
#: Rare shingles two similar sets share at least; classes of a large component; sets of a block, and shingles after which one
#: ends; rounds of likeliest pairs before all others.
SHARED, LARGE, BLOCK_ROWS, BLOCK_ITEMS, ROUNDS = 3, 100, 256, 1 << 16, 2
#: Bytes of a shingle where shingles are counted; shingles after which a batch of texts asks; least bits of a bucket's number.
SHORT, ASKED, BUCKET_BITS = 5, 1 << 20, 8
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RNG = np.random.Generator(np.random.PCG64(20260131))
MULTIPLY = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    found = (text or b"").translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, found), np.uint64, len(found))
    k = min(size, len(h))
    n = len(h) - k + 1
    mix = np.full(n, k, np.uint64)
    for j in range(k):
        mix = (mix ^ h[j:j + n]) * STEP
        mix ^= mix >> np.uint64(29)
    return np.unique(mix)


def signature(items: np.ndarray) -> np.ndarray:
    """128 minimum hashes of a set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), 4096):
        part = items[at:at + 4096]
        low = np.minimum(low, (MULTIPLY[:, None] * part[None, :] + ADD[:, None]).min(axis=1))
    return low


SKETCH = ("doc_id long, n_shingles long, print binary, prefixes binary, bits binary, block long, ids binary, lens binary, items binary")


def sketches(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document: size and 128-bit print of its set, 16-bit hash prefixes of the trees, one-bit sketch.

    The last document of some also has the sets of all of them, with shortened shingles: block, ids, lens, items.
    """

    def run(batches):
        names = [c.split()[0] for c in SKETCH.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SKETCH.split(", ")]
        for batch in batches:
            out, ids, lens, sets, last = [], [], [], [], None

            def end():
                items, named = b"".join(sets), np.array(ids, np.int64).tobytes()
                block = xxhash.xxh3_64_intdigest(named + items) >> 1
                out[last] = (*out[last][:5], block, named, np.array(lens, np.int64).tobytes(), items)
                for held in (ids, lens, sets):
                    held.clear()

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                items = shingles(text, size)
                if not len(items):
                    out.append((doc_id, 0, *[None] * 7))
                    continue
                low = signature(items)
                short = ((low >> np.uint64(16)) & np.uint64(0xFFFF)).astype(">u2").tobytes()
                bits = np.packbits(((low >> np.uint64(36)) & np.uint64(1)).astype(np.uint8)).tobytes()
                out.append((doc_id, len(items), xxhash.xxh3_128_digest(items.tobytes()), short, bits, *[None] * 4))
                if doc_id is not None:
                    last = len(out) - 1
                    ids.append(doc_id)
                    lens.append(len(items))
                    sets.append(_shortened(items))
                    if sum(lens) >= ASKED:
                        end()
            if ids:
                end()
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SKETCH)


def _shortened(items: np.ndarray) -> bytes:
    """The first 40 bits of each hash."""
    return (items >> np.uint64(64 - 8 * SHORT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()


def _dealt(items: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shortened shingles as numbers; their order by bucket; the buckets that occur and where each begins in that order."""
    wide = np.zeros((len(items) // SHORT, 8), np.uint8)
    wide[:, :SHORT] = np.frombuffer(items, np.uint8).reshape(-1, SHORT)
    values = wide.view("<u8").ravel()
    bucket = (values & np.uint64((1 << bits) - 1)).astype(np.uint32)
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return values, order, found, starts


def counted(blocks: DataFrame, bits: int, groups: int) -> str:
    """The folder of how often each shingle of each block occurs in all blocks, as a power of two: group, block, bucket, powers."""

    def ask(batches):
        for batch in batches:
            for block, items in zip(batch.column("block").to_pylist(), batch.column("items").to_pylist()):
                values, order, found, starts = _dealt(items, bits)
                parts = np.split((values[order] >> np.uint64(bits)).astype(np.uint32), starts[1:])
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([block] * n, pa.int64()),
                                                  pa.array([x.tobytes() for x in parts], pa.binary())], ["bucket", "block", "items"])

    def answered(bucket, blocks, asked):
        each = [np.frombuffer(x, np.uint32) for x in asked]
        items = np.concatenate(each)
        _, at, times = np.unique(items, return_inverse=True, return_counts=True)
        power = np.minimum(15, np.log2(times).astype(np.uint8))[at]
        out = []
        for part in np.split(power, np.cumsum([len(x) for x in each])[:-1]):
            part = np.append(part, np.zeros(len(part) % 2, np.uint8))
            out.append((part[::2] | part[1::2] << 4).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([b % groups for b in blocks], pa.int32()), pa.array(blocks, pa.int64()),
                                           pa.array([bucket] * len(blocks), pa.int32()), pa.array(out, pa.binary())],
                                          ["group", "block", "bucket", "powers"])

    def answer(batches):
        at, blocks, asked = None, [], []
        for batch in batches:
            for bucket, block, items in zip(*[batch.column(c).to_pylist() for c in ("bucket", "block", "items")]):
                if blocks and bucket != at:
                    yield answered(at, blocks, asked)
                    blocks, asked = [], []
                at = bucket
                blocks.append(block)
                asked.append(items)
        if blocks:
            yield answered(at, blocks, asked)

    asked = blocks.select("block", "items").mapInArrow(ask, "bucket int, block long, items binary")
    rows = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "group int, block long, bucket int, powers binary")
    path = work_folder(blocks.sparkSession, "shingle-counts")
    rows.repartition("group").write.partitionBy("group").option("compression", "zstd").parquet(path)
    return path


def rare_shingles(sketched: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """A row per class and rare shingle that occurs elsewhere: item, rep and code (twice the set's size, plus one if the shingle is
    also among those that a set of this size shares with one of its size or larger).

    The rarest shingles of a set are so many that every set similar enough shares at least SHARED of them, or all that they share.
    """
    blocks = sketched.where("block is not null").select("block", "ids", "lens", "items")
    groups = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(BUCKET_BITS, groups.bit_length() + 2)
    folder = counted(blocks, bits, groups)

    def run(batches):
        for batch in batches:
            for block, ids, lens, items in zip(*[batch.column(c).to_pylist() for c in ("block", "ids", "lens", "items")]):
                values, order, found, starts = _dealt(items, bits)
                answers = group_rows(folder, "group", block % groups, ["bucket", "powers"], [("block", "=", block)])
                known = dict(zip(answers.column("bucket").to_pylist(), answers.column("powers").to_pylist()))
                power = np.empty(len(values), np.uint64)
                for bucket, at in zip(found.tolist(), np.split(order, starts[1:])):
                    pair = np.frombuffer(known[bucket], np.uint8)
                    power[at] = np.stack([pair & 15, pair >> 4], axis=1).ravel()[:len(at)]
                n = np.frombuffer(lens, np.int64)
                own = np.repeat(np.arange(len(n), dtype=np.uint64), n)
                shift = np.uint64(8 * SHORT)
                ranked = np.sort((own << (shift + np.uint64(4))) | (power << shift) | values)
                pos = np.arange(len(ranked)) - np.repeat(np.cumsum(n) - n, n)
                many = np.repeat(n, n)
                joined = (pos < many + percent * many // -100 + SHARED) & ((ranked >> shift) & np.uint64(15) > 0)
                pos, many, ranked = pos[joined], many[joined], ranked[joined]
                code = 2 * many + (pos < many + 2 * percent * many // -(100 + percent) + SHARED)
                reps = np.frombuffer(ids, np.int64)[(ranked >> (shift + np.uint64(4))).astype(np.int64)]
                item = (ranked & np.uint64((1 << 8 * SHORT) - 1)).astype(np.int64)
                for lo in range(0, len(item), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo:lo + (1 << 16)]) for c in (item, reps, code.astype(np.int32))],
                                                     ["item", "rep", "code"])

    rows = blocks.mapInArrow(run, "item long, rep long, code int").repartition("rep").distinct()
    rare = written(rows.join(reps.select("rep"), "rep", "left_semi").select("item", "rep", "code"), "rare-shingles")
    removed(blocks.sparkSession, folder)
    return rare


PAIR = "a long, b long, score int, tree int, prefix binary, seam int"


def _region_pairs(least_score: int):
    """Pairs inside one sorted stretch of the forest, and its first and last row as seams."""

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        n = table.num_rows
        tree = table.column("tree").to_numpy()
        rep = table.column("rep").to_numpy()
        raw = table.column("prefix").to_pylist()
        prefix = np.frombuffer(b"".join(raw), ">u2").reshape(n, DEPTH)
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint8).reshape(n, HASHES // 8)
        ones = np.array([bin(i).count("1") for i in range(256)], np.uint8)
        at = np.arange(n)
        left, right = [], []
        for back in range(1, min(NEIGHBOURS, n - 1) + 1):
            near = (tree[back:] == tree[:-back]) & (prefix[back:, :MIN_DEPTH] == prefix[:-back, :MIN_DEPTH]).all(axis=1)
            right.append(at[back:][near])
            left.append(at[:-back][near])
        for depth in range(MIN_DEPTH, DEPTH + 1):
            starts = np.ones(n, bool)
            starts[1:] = (tree[1:] != tree[:-1]) | (prefix[1:, :depth] != prefix[:-1, :depth]).any(axis=1)
            pivot = np.maximum.accumulate(np.where(starts, at, 0))
            inside = pivot < at
            right.append(at[inside])
            left.append(pivot[inside])
        i, j = np.concatenate(left), np.concatenate(right)
        keep_a, keep_b, keep_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        for lo in range(0, len(i), 200_000):
            p, q = i[lo:lo + 200_000], j[lo:lo + 200_000]
            score = HASHES - ones[bits[p] ^ bits[q]].sum(axis=1, dtype=np.int32)
            good = score >= least_score
            keep_a.append(np.minimum(rep[p], rep[q])[good])
            keep_b.append(np.maximum(rep[p], rep[q])[good])
            keep_s.append(score[good])
        a, b, s = map(np.concatenate, (keep_a, keep_b, keep_s))
        if len(a):
            _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
            a, b, s = a[first], b[first], s[first]
        m = len(a)
        edge = [0, n - 1]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([a, rep[edge]]), pa.int64()), pa.array(np.concatenate([b, rep[edge]]), pa.int64()),
            pa.array(np.concatenate([s, [0, 0]]).astype(np.int32), pa.int32()),
            pa.array(np.concatenate([np.full(m, -1), tree[edge]]).astype(np.int32), pa.int32()),
            pa.array([None] * m + [raw[0], raw[-1]], pa.binary()),
            pa.array(np.concatenate([np.zeros(m), [1, 1]]).astype(np.int32), pa.int32())],
            ["a", "b", "score", "tree", "prefix", "seam"])

    return run


def candidates(reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of class representatives that the forest finds, with their sketch agreement."""
    expected = (1 + similarity) / 2
    least = int(HASHES * (expected - 2 * (expected * (1 - expected) / HASHES) ** 0.5))
    forest = reps.select("rep", "bits", F.posexplode(F.array(*[
        F.substring("prefixes", 2 * DEPTH * t + 1, 2 * DEPTH) for t in range(TREES)])).alias("tree", "prefix"))
    order = ["tree", "prefix", "rep"]
    ranged = forest.select("tree", "prefix", "rep", "bits").repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(ranged.mapInArrow(_region_pairs(least), PAIR), "forest-pairs")
    # two rows per partition: the only rows that meet in one task
    seams = found.where("seam = 1").select("tree", "prefix", F.col("a").alias("rep"))
    seams = seams.withColumn("before", F.lag("rep").over(Window.orderBy(*order))).where("before <> rep")
    seams = seams.select(F.least("rep", "before").alias("a"), F.greatest("rep", "before").alias("b"), F.lit(0).alias("score"))
    pairs = found.where("seam = 0").select("a", "b", "score").unionByName(seams)
    return written(pairs.groupBy("a", "b").agg(F.max("score").alias("score")), "forest-candidates")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose full shingle sets have at least the similarity (compared in whole per cent)."""
    percent = round(100 * similarity)
    ends = pairs.select("a").union(pairs.select("b"))
    texts = slot_filter(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")), "doc_id", ends)
    both = pairs.select("a", "b").join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches):
        known: dict = {}

        def of(key, text):
            if key not in known:
                if len(known) >= 64:
                    known.clear()
                known[key] = shingles(text, size)
            return known[key]

        for batch in batches:
            keep = []
            columns = [batch.column("a").to_pylist(), batch.column("b").to_pylist(),
                       batch.column("text_a").cast(pa.binary()).to_pylist(), batch.column("text_b").cast(pa.binary()).to_pylist()]
            for a, b, s, t in zip(*columns):
                x, y = of(a, s), of(b, t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _posts(rare: DataFrame, linked: DataFrame) -> DataFrame:
    """The rows of ``rare_shingles`` with the class' component (null: alone) and whether it is large."""
    times = linked.groupBy("component").agg(F.count("*").alias("times"))
    comp = linked.join(times, "component").select(F.col("node").alias("rep"), F.col("component").alias("comp"), (F.col("times") >= LARGE).alias("large"))
    return rare.join(comp, "rep", "left").select("item", "rep", "comp", "code", F.coalesce("large", F.lit(False)).alias("large"))


def missed(rare: DataFrame, reps: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Every pair (a < b) of classes of different small components that can have the similarity, with the agreement of their hashes."""
    small = _posts(rare, linked).where("not large").drop("large")
    met = small.join(small.withColumnsRenamed({"rep": "r", "comp": "c", "code": "k"}), "item").where("rep < r and not coalesce(comp = c, false)")
    n, k = F.expr("code div 2"), F.expr("k div 2")
    near = (100 * F.least(n, k) >= percent * F.greatest(n, k)) & (F.when(n <= k, F.col("code")).otherwise(F.col("k")) % 2 == 1)
    need = F.least(F.lit(SHARED), F.ceil(percent * (n + k) / (100 + percent)))
    pairs = met.where(near).select(F.col("rep").alias("a"), F.col("r").alias("b"), need.cast("byte").alias("need"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("m"), F.min("need").alias("need"))
    pairs = written(pairs.where("m >= need").select("a", "b"), "rare-pairs")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), ">u2").reshape(-1, HASHES) for c in ("x", "y"))
            score = (x == y).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(score)], ["a", "b", "score"])

    hashes = slot_filter(reps, "rep", pairs.select("a").union(pairs.select("b"))).groupBy("rep").agg(F.first("prefixes").alias("p"))
    both = pairs.join(hashes.toDF("a", "x"), "a").join(hashes.toDF("b", "y"), "b")
    return written(both.mapInArrow(run, "a long, b long, score int"), "rare-scored")


def _blocks(rows: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The sets of ``rows`` (rep, comp), with a few hundred of one component to a row: comp, reps, lens, items."""
    texts = slot_filter(docs.select(F.col("doc_id").cast("long").alias("rep"), "text"), "rep", rows.select("rep"))
    salts = rows.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("salts"))
    dealt = rows.join(salts, "comp").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts")).join(texts, "rep")
    dealt = dealt.select("comp", "salt", "rep", "text").repartition("comp", "salt").sortWithinPartitions("comp", "salt")

    def packed(comp, reps, sets):
        lens = np.array([len(x) for x in sets], np.int32)
        row = [comp], [np.array(reps, np.int64).tobytes()], [lens.tobytes()], [np.concatenate(sets).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), *[pa.binary()] * 3))], ["comp", "reps", "lens", "items"])

    def run(batches):
        at, reps, sets, held = None, [], [], 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("comp", "salt", "rep"))
            for comp, salt, rep, text in zip(*columns, batch.column("text").cast(pa.binary()).to_pylist()):
                if reps and (at != (comp, salt) or held >= BLOCK_ITEMS):
                    yield packed(at[0], reps, sets)
                    reps, sets, held = [], [], 0
                at = (comp, salt)
                reps.append(rep)
                sets.append(shingles(text, size))
                held += len(sets[-1])
        if reps:
            yield packed(at[0], reps, sets)

    return dealt.mapInArrow(run, "comp long, reps binary, lens binary, items binary")


def _block_links(percent: int):
    """For each set of one block the first of the other block that has the similarity."""

    def run(batches):
        for batch in batches:
            found = []
            for reps, lens, items, r, k, other in zip(*[batch.column(c).to_pylist() for c in ("reps", "lens", "items", "r", "k", "other")]):
                reps, r = np.frombuffer(reps, np.int64), np.frombuffer(r, np.int64)
                lens, k = np.frombuffer(lens, np.int32).astype(np.int64), np.frombuffer(k, np.int32).astype(np.int64)
                items, other = np.frombuffer(items, np.uint64), np.frombuffer(other, np.uint64)
                order = np.argsort(other, kind="stable")
                held, owner = other[order], np.repeat(np.arange(len(k)), k)[order]
                for one, mine in zip(reps.tolist(), np.split(items, np.cumsum(lens)[:-1])):
                    lo, hi = np.searchsorted(held, mine, "left"), np.searchsorted(held, mine, "right")
                    times = hi - lo
                    at = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
                    common = np.bincount(owner[at], minlength=len(k))
                    good = np.flatnonzero((common > 0) & (100 * common >= percent * (len(mine) + k - common)))
                    if len(good):
                        found.append((min(one, int(r[good[0]])), max(one, int(r[good[0]]))))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def large_links(sketched: DataFrame, reps: DataFrame, linked: DataFrame, docs: DataFrame, size: int, percent: int,
                rare: DataFrame | None = None) -> DataFrame:
    """Links that join classes, and large components, to large components: at least one of each that has any.

    A class is looked at if it shares enough rare shingles with the members of a component taken together; such classes and the
    members meet in blocks, so the rows that are moved are the blocks' pairs, not the classes' pairs.
    """
    posts = _posts(rare_shingles(sketched, reps, percent) if rare is None else rare, linked)
    n, short = F.expr("code div 2"), F.col("code") % 2
    held = posts.where("large").groupBy("item", F.col("comp").alias("c")).agg(F.min(n).alias("lo"), F.max(n).alias("hi"), F.max(short).alias("some"))
    met = posts.join(held, "item").where("not coalesce(comp = c, false) and (not large or comp < c)")
    met = met.where((100 * F.col("hi") >= percent * n) & (100 * n >= percent * F.col("lo")) & (short + F.col("some") > 0))
    need = F.least(F.lit(SHARED), F.ceil(percent * (n + F.greatest("lo", F.ceil(percent * n / 100))) / (100 + percent)))
    near = met.groupBy("rep", F.col("c").alias("comp")).agg(F.count("*").alias("m"), F.min(need).alias("need"))
    near = written(near.where("m >= need").select("rep", "comp"), "near-large")
    members = linked.select(F.col("node").alias("rep"), F.col("component").alias("comp")).join(near.select("comp").distinct(), "comp", "left_semi")
    blocks = _blocks(near, docs, size).join(_blocks(members, docs, size).toDF("comp", "r", "k", "other"), "comp")
    return written(blocks.mapInArrow(_block_links(percent), "a long, b long"), "links")


def _apart(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    ca, cb = linked.toDF("a", "ca"), linked.toDF("b", "cb")
    both = pairs.join(ca, "a", "left").join(cb, "b", "left")
    return both.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select(*pairs.columns)


def _joined(linked: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links."""
    return components(linked.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(links))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest linked doc_id) and kept."""
    percent = round(100 * similarity)
    sketched = written(sketches(docs, size, percent), "sketches")
    full = sketched.where("n_shingles > 0 and doc_id is not null")
    reps = written(full.groupBy("print").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("prefixes", "bits")]), "classes")
    pairs = candidates(reps, similarity)
    best = pairs.groupBy("b").agg(F.max(F.struct("score", -F.col("a"), "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    sure = written(confirmed(best, docs, size, similarity), "links")
    linked = components(sure)
    apart = _apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), linked)
    linked = _joined(linked, written(confirmed(written(apart, "apart"), docs, size, similarity), "links"))
    rare = rare_shingles(full, reps, percent)
    # the shortened shingles are the larger part of what was written, and nothing reads them from here on
    sets = written(sketched.select("doc_id", "n_shingles", "print"), "sets")
    removed(docs.sparkSession, folder_of(sketched))
    if linked.groupBy("component").count().where(F.col("count") >= LARGE).take(1):
        linked = written(_joined(linked, large_links(sets, reps, linked, docs, size, percent, rare)), "linked")
    # the forest's pairs that were looked at and are no links need no second look
    rest = written(_apart(missed(rare, reps, linked, percent).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), linked), "apart")
    for turn in range(ROUNDS + 1):
        if not rest.take(1):
            break
        now = rest.select("a", "b")
        if turn < ROUNDS:
            ends = rest.select(F.col("a").alias("end"), F.col("b").alias("other"), "score").unionByName(
                rest.select(F.col("b").alias("end"), F.col("a").alias("other"), "score"))
            top = ends.groupBy("end").agg(F.max(F.struct("score", "other"))["other"].alias("other"))
            now = written(top.select(F.least("end", "other").alias("a"), F.greatest("end", "other").alias("b")).distinct(), "likeliest")
        linked = _joined(linked, written(confirmed(now, docs, size, similarity), "links"))
        if turn < ROUNDS:
            rest = written(_apart(rest.join(now, ["a", "b"], "left_anti"), linked), "apart")
    home = reps.select("print", "rep").join(linked, F.col("rep") == F.col("node"), "left").select(
        "print", F.coalesce("component", "rep").alias("component_id"))
    out = sets.withColumn("print", F.when(F.col("doc_id").isNotNull(), F.col("print"))).join(home, "print", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last, then the first row.

    Groups are made of rows, not of ids, so one id with two texts is decided for each text, repeated rows and copies without an
    id leave one row, and texts without words all stay. ``docs`` is read more than once and must come in the same order each time, as a
    table that is read does. Rows stand by their number: by a hash of the text every copy of one would meet every copy of the other.
    """
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    found = near_duplicates(numbered.select(F.col("__row").alias("doc_id"), "text"), size, similarity)
    group = written(found.where("n_shingles > 0").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("component")), "groups")
    rows = numbered.select("__row", F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    rows = written(rows.join(group, "__row"), "grouped-rows")
    first = rows.groupBy("component").agg(F.min(F.struct("none", "id", "__row"))["__row"].alias("first"))
    gone = written(rows.join(first, "component").where("__row <> first").select("__row"), "duplicates")
    return numbered.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
