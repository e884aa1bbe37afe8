"""The order of rarity follows the whole table, however small a share of it a sample of fixed size would be."""

import random

from framewright.llm import near_dup


def test_region_without_links_gives_few_pairs(spark, monkeypatch):
    """60 variants of one text, all a little too far from each other, one near pair among them, among 400 other texts."""
    rng = random.Random(11)
    frame = [f"w{i}" for i in range(121)]

    def variant(words, name, changes):
        words = list(words)
        for at in rng.sample(range(1, 120, 2), changes):
            words[at] = f"{name}n{at}"
        return words

    texts = [variant(frame, f"v{i}", 12) for i in range(60)]
    texts += [variant(texts[7], "z", 3), *[[f"o{i}x{rng.randrange(900)}" for _ in range(30)] for i in range(400)]]
    sets = [set(zip(t, t[1:])) for t in texts]
    near = [(i, j) for j in range(len(sets)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert near == [(7, 60)]
    monkeypatch.setattr(near_dup, "SAMPLE", 20, raising=False)
    pairs, plain = [], near_dup.written

    def spy(df, name):
        out = plain(df, name)
        if name == "rare-pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "written", spy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs, 2, 0.8).collect()}
    assert got == {i: 7 if i == 60 else i for i in range(len(texts))}
    assert sum(pairs) <= 60


def test_counts_are_those_of_all_texts(spark):
    """Shingles that occur once are left out, the others stand by how often they occur; copies of a text post once."""
    texts = [f"a b c d{i} e{i}" for i in range(9)] + ["a b c d0 e0", "x y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sketched = near_dup.written(near_dup.sketches(docs, 2, 80).where("n_shingles > 0"), "sketches")
    reps = sketched.groupBy("print").agg({"doc_id": "min"}).toDF("print", "rep")
    rows = near_dup.rare_shingles(sketched, reps, 80).collect()
    known = {int(s >> (64 - 8 * near_dup.SHORT)): s for t in texts for s in near_dup.shingles(t.encode(), 2)}
    shared = {int(s >> (64 - 8 * near_dup.SHORT)) for s in near_dup.shingles(b"a b c", 2)}
    twice = {int(s >> (64 - 8 * near_dup.SHORT)) for s in near_dup.shingles(b"c d0 e0", 2)}
    assert shared | twice < set(known) and {r.rep for r in rows} == set(range(9))
    assert {r.item for r in rows} == {min(shared)} | twice  # the three rarest of four, of equally rare ones the smaller hash
    assert len(rows) == len({(r.rep, r.item) for r in rows}) and {r.code // 2 for r in rows} == {4}
    assert twice == {r.item for r in rows if r.rep == 0} - shared
