"""Hard negatives, whitening and mixing against plain Python on small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.llm import hard_negatives, mixing, whitening

VECTORS = "vec_id long, embedding array<float>, label int, score string, anchor int, x int, rank int"


def rows_of(seed, n, dims, labels, copies=0):
    r = np.random.default_rng(seed)
    made = [(i, [float(np.float32(x)) for x in r.normal(size=dims) / 4], int(r.integers(labels))) for i in range(n)]
    made += [(n + i, made[3][1], made[3][2]) for i in range(copies)] + [made[0], made[100 % n], made[5]]
    made += [(900, None, 1), (901, [0.5, None], 1), (902, [float("nan"), 1.0], 2), (903, [float("inf")], 2), (904, [0.1] * dims, None),
             (None, made[7][1], 1), (None, made[8][1], 0), (1000, [], 2), (1001, [0.25], 2), (1100, [3e38, -3e38], 1)]
    return [(*row, "s", 1, 2, 3) for row in made]


def clean(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 9), st.integers(1, 6), st.integers(0, 5), st.integers(1, 62), st.randoms(use_true_random=False))
def test_packed_scores_are_exact(n, dims, anchors, bits, rnd):
    draw = lambda k: np.array([[rnd.randrange(-2**bits, 2**bits) for _ in range(dims)] for _ in range(k)],
                              dtype=np.int64).reshape(k, dims)
    a, b = draw(n), draw(anchors)
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    assert [[int(x) for x in row] for row in hard_negatives.packed_scores(a, b)] == want


def brute_negatives(rows):
    v = []
    for i, vector, label, *_ in rows:
        if label is not None and clean(vector):
            whole = [max(-2**31, min(2**31 - 1, math.floor(256 * float(x)))) for x in vector]
            v.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, whole))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    out = Counter()
    for k, (i, label, a) in enumerate(v):
        if i is None or i % 100:
            continue
        scored = [(dot(a, w), j, other) for m, (j, other, w) in enumerate(v) if m != k]
        for ps, pid, _ in sorted((t for t in scored if t[2] == label), key=order)[:5]:
            fits = sorted((t for t in scored if t[2] != label and 80 * ps <= 100 * t[0] <= 100 * ps), key=order)[:5]
            out.update((i, pid, r + 1, t[1], ps, t[0]) for r, t in enumerate(fits))
    return out


@pytest.mark.parametrize("dims,labels,copies", [(8, 3, 0), (3, 2, 200), (16, 1, 5)])
def test_hard_negatives(spark, dims, labels, copies, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_CELLS", 700)
    rows = rows_of(dims, 320, dims, labels, copies)
    got = hard_negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(4))
    assert Counter(tuple(r) for r in got.collect()) == brute_negatives(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_hard_negatives_without_rows(spark):
    assert hard_negatives.mined(spark.createDataFrame([], VECTORS)).count() == 0
    only = [(100, [0.1, 0.2], 1, "s", 1, 2, 3)]
    assert hard_negatives.mined(spark.createDataFrame(only, VECTORS)).count() == 0


def brute_whitening(rows, dims, components=8):
    kept = [(i, v) for i, v, *_ in rows if clean(v)]
    ints = [[math.floor(max(-2.0**42, min(2.0**42, 1024 * float(c)))) + 100_000 for c in v] + [100_000] * (dims - len(v)) for _, v in kept]
    n = len(kept)
    sums = [sum(c) for c in zip(*ints)]
    deviation = [sum((n * x - s)**2 for x, s in zip(row, sums)) for row in ints]
    centred = np.array([[(n * x - s) / n for x, s in zip(row, sums)] for row in ints])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return kept, deviation, centred @ vectors / np.sqrt(values), values / (centred**2).sum() * n, n


@pytest.mark.parametrize("dims,stretch", [(6, 1.0), (40, 1.0), (40, 1.2), (70, 1.0)])
def test_whitening(spark, dims, stretch):
    rows = [r for r in rows_of(dims, 400, dims, 3, 150) if r[0] != 1100]
    rows = [(i, [None if x is None else x * stretch**(j % dims) for j, x in enumerate(v)] if v else v, *rest) for i, v, *rest in rows]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], *rest) for i, v, *rest in rows]
    kept, deviation, white, share, n = brute_whitening(rows, dims)
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    k = min(8, dims)
    assert len(got) == n * k and {r.n for r in got} == {n}
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({(i, d): k * c for (i, d), c in Counter(
        (i, d) for (i, _), d in zip(kept, deviation)).items()})
    assert max(r.identity_error for r in got) < 1e-10
    by = defaultdict(list)
    for r in got:
        by[r.component].append((r.vec_id or -1, r.deviation, r.whitened))
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
    for c, mine in by.items():
        want = sorted((i or -1, d, w) for (i, _), d, w in zip(kept, deviation, white[:, c - 1]))
        a, b = np.array([x[2] for x in sorted(mine)]), np.array([x[2] for x in want])
        flip = sorted((i or -1, d, -w) for (i, _), d, w in zip(kept, deviation, white[:, c - 1]))
        assert min(np.abs(a - b).max(), np.abs(a - np.array([x[2] for x in flip])).max()) < 1e-6


def test_whitening_edges(spark):
    assert whitening.whitened(spark.createDataFrame([], VECTORS)).count() == 0
    same = [(i, [0.5, 0.25], 1, "s", 1, 2, 3) for i in range(9)]
    assert whitening.whitened(spark.createDataFrame(same, VECTORS)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, [], 1, "s", 1, 2, 3)], VECTORS)).count() == 0
    line = [(i, [i / 7, 0.25, -i / 7], 1, "s", 1, 2, 3) for i in range(50)]
    assert {r.component for r in whitening.whitened(spark.createDataFrame(line, VECTORS)).collect()} <= {1, 2}
    huge = [(i, [3e38 if i % 2 else -3e38, 1e6 * i * i], 1, "s", 1, 2, 3) for i in range(2000)]
    got = whitening.whitened(spark.createDataFrame(huge, VECTORS)).collect()
    assert len(got) == 2 * 2000 and {r.deviation for r in got} == {None}


def test_filter_damps_the_lower_spectrum():
    values = np.concatenate([[10.0, 9.0, 8.0], np.linspace(0, 5, 40)])
    out = whitening._filtered(lambda q: values[:, None] * q, np.ones((43, 1)), 8, 5.0, 10.0)[:, 0]
    assert out[0] == pytest.approx(1) and np.abs(out[3:]).max() < 1e-4 < out[2]


# --- mixing ---------------------------------------------------------------------------------------------------------------------


def hashed(*longs):
    h = 42
    for value, width in longs:
        h = xxhash.xxh64_intdigest(int(value).to_bytes(width, "little", signed=True), seed=h)
    return h - (1 << 64) if h >= 1 << 63 else h


def permuted(i, n, seed, source, turn):
    key = [(seed, 4), (source, 8), (turn, 8)]
    for r in range(mixing.ROUNDS):
        partner = (hashed(*key, (r, 8)) % n - i) % n
        i = partner if hashed(*key, (r, 8), (max(i, partner), 8)) & 1 else i
    return i


def text_digest(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


def brute_mix(rows, block, seed):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = [(s, i, len(word.findall(t or "")), text_digest(t)) for i, t, s in rows]
    size = Counter()
    for s, _, n, _ in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - 2 * sum(size[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        more = {s for s in order if weight[s] * level > 2 * size[s]}
        if more <= full:
            break
        full |= more
    target = {s: min(weight[s] * level, 2.0 * size[s]) for s in order}
    out = Counter()
    for no, s in enumerate(order, 1):
        mine = sorted((d for d in docs if d[0] == s), key=lambda d: (d[1] is None, d[1] or 0, d[3], d[2]))
        words = [k for k, d in enumerate(mine) for _ in range(d[2])]
        used, left, n = Counter(), math.floor(target[s] + 0.5), -(-len(words) // block)
        for slot in range(2 * n):
            at = permuted(slot % n, n, seed, no, slot // n) * block
            piece = words[at:at + block][:left]
            used.update(piece)
            left -= len(piece)
        assert left == 0
        out.update((d[1], d[2], size[s], round(target[s], 6), used[k]) for k, d in enumerate(mine))
    return out


def mix_rows():
    r = np.random.default_rng(3)
    names = ["b", "a", "\U0001f600", "�", None, "hot", "A", "tiny", ""]
    rows = [(int(i), " ".join(["w"] * int(r.integers(0, 90))), names[int(r.integers(7)) if i % 3 else 5]) for i in range(200)]
    rows += [(5, "one two\x1fthree four \t\n five", "tiny"), (None, "x y z", None), (None, "x y z", None), (7, None, "a"), (7, None, "a"),
             (900, "", "hot"), (901, "long " * 5000, "b"), (902, None, "")]
    return rows + rows[:3]


def frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return made.selectExpr("*", "1 as size", "2 as target", "'s' as start", "3 as taken", "'x' as block_no").repartition(4)


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mixing(spark, block):
    rows = mix_rows()
    got = mixing.taken(frame(spark, rows), block=block, shards=3)
    found = got.collect()
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found) == brute_mix(rows, block, mixing.SEED)
    assert all(r.taken <= 2 * r["size"] for r in found)
    again = mixing.taken(frame(spark, rows[::-1]), block=block, shards=3).collect()
    assert Counter(tuple(r) for r in again) == Counter(tuple(r) for r in found)


def test_mix_writes_the_words_it_counts(spark):
    rows = mix_rows()
    whole = mixing.mix(frame(spark, rows), block=16, shards=5).collect()
    counted = Counter()
    for r in mixing.taken(frame(spark, rows), block=16, shards=5).collect():
        counted["all"] += r.taken
    assert sum(r.n_words for r in whole) == sum(len(r.text.split(" ")) for r in whole) == counted["all"]
    assert {r.shard for r in whole} == set(range(5)) and max(r.n_words for r in whole) == 16


def test_permutations_and_draws(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 97, 1000):
        p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(1)).alias("p"), "id")
        back = p.select("id", mixing.permuted(F.col("p"), F.lit(n), F.lit(1), back=True).alias("q"), "p").collect()
        assert sorted(r.p for r in back) == list(range(n)) and all(r.id == r.q for r in back)
    sources = spark.createDataFrame([(1, 100_000, 150_000.0), (2, 50_000, 40_000.0)], "source_no long, source_size long, target double")
    counts = {(r.shard, r.source_no): r["count"] for r in mixing.slots(sources, 10, 20, 1).groupBy("shard", "source_no").count().collect()}
    for no, slots in ((1, 15_000), (2, 4_000)):
        mine = [counts[s, no] for s in range(20)]
        assert sum(mine) == slots
        assert 5 < sum((c - slots / 20)**2 / (slots / 20) for c in mine) < 50  # chi-square of 19 degrees


def test_mixing_edges(spark):
    assert mixing.taken(frame(spark, [])).count() == 0
    rows = [(1, None, "a"), (2, " ", None)]
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in mixing.taken(frame(spark, rows)).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.mix(frame(spark, rows)).count() == 0
