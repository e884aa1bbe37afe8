"""Rows of the near-duplicate step do not grow with the square of a group: copies, and texts beside a large component."""

import random

from framewright.llm import near_dup


def counted(monkeypatch, *names):
    """Row counts of what the step writes under these names."""
    rows, plain = {}, near_dup.written

    def spy(df, name):
        out = plain(df, name)
        if name in names:
            rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dup, "written", spy)
    return rows


def test_copies_do_not_meet_each_other(spark, tmp_path, monkeypatch):
    """40 copies each of two near texts are one link, not 1,600."""
    text = " ".join(f"t{i}" for i in range(60))
    spark.createDataFrame([(i, text + " and one more" * (i % 2)) for i in range(80)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    rows = counted(monkeypatch, "links")
    kept = near_dup.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert [r.doc_id for r in kept.collect()] == [0]
    assert sum(rows["links"]) == 1


def test_texts_beside_a_large_component(spark, monkeypatch):
    """150 variants of one text, 40 texts a little too far from all of them, and one that is near to a single variant."""
    rng = random.Random(5)
    centre = [f"w{i}" for i in range(101)]

    def variant(words, name, changes):
        words = list(words)
        for at in rng.sample(range(1, 100, 2), changes):
            words[at] = f"{name}n{at}"
        return words

    texts = [variant(centre, f"x{i}", 2) for i in range(150)] + [variant(centre, f"y{i}", 8) for i in range(40)]
    texts.append(variant(texts[7], "z", 4))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    sets = [set(zip(t, t[1:])) for t in texts]
    group = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b) and group[i] != group[j]:
                lo, hi = sorted((group[i], group[j]))
                group = [lo if g == hi else g for g in group]
    assert group[190] == 0 and sum(g == 0 for g in group) == 151
    rows = counted(monkeypatch, "rare-scored")
    got = near_dup.near_duplicates(docs, 2, 0.8)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == list(enumerate(group))
    assert sum(rows["rare-scored"]) <= 40 * 39 // 2


def test_block_finds_what_the_forest_leaves(spark, monkeypatch):
    """Without the forest's second round the blocks alone link single texts, and two large components, to a large one."""
    left = [[f"l{i}" if i not in (2 * j, 2 * j + 1) else f"l{j}x{i}" for i in range(101)] for j in range(1, 40)]
    right = [[w if i % 25 else f"r{i}" for i, w in enumerate(t)] for t in left]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(left + right)], "doc_id long, text string")
    sketched = near_dup.sketches(docs, 2, 80).where("n_shingles > 0")
    reps = sketched.selectExpr("print", "doc_id as rep", "prefixes", "bits")
    linked = spark.createDataFrame([(i, 0 if i < 39 else 39) for i in range(77)], "node long, component long")
    monkeypatch.setattr(near_dup, "LARGE", 10)
    for size, alone in ((2, 77), (2, 76)):
        got = near_dup.large_links(sketched, reps, linked.where(f"node < {alone}"), docs, size, 80).collect()
        of = lambda d: 0 if d < 39 else 39 if d < alone else d
        pairs = {(i, j) for i in range(78) for j in range(i) for a, b in [(set(zip(x, x[1:])) for x in ((left + right)[i], (left + right)[j]))]
                 if of(i) != of(j) and 100 * len(a & b) >= 80 * len(a | b)}
        met = {tuple(sorted((of(i), of(j)))) for i, j in pairs if min(of(i), of(j)) in (0, 39)}
        assert met and {tuple(sorted((of(r.a), of(r.b)))) for r in got} == met
        assert {(r.b, r.a) for r in got} <= pairs
