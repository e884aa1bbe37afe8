"""Archives, placement, spans, decontamination, calibration, learned identifiers and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framewright.llm import archives, decontaminate, graph, personal_data, quality_rules, queries, sentence_spans, sharding

FOLDER = "/root/testdata/sf0.001"


def test_archives(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()]
    big = "ü" * 80
    rows += [(1000, None, big), (-5, "http://a b/\n", big), (1001, "u", None), (1002, "u", ""), (1003, "u", "small"),
             (1004, "u", "small"), (2**62, "u", big), (None, "u", big), (1000, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = Counter(tuple(r) for r in archives.round_trip(pages).collect())
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(p, first.get(h, p))
    want = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and h in first and first[h] != p
        want[(p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None)] += 1
    assert got == want
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_arc_versions():
    for version in (1, 2):
        body = archives.http_block(4, b"x\n\nhttp://fake 1 2 3 4\n")
        data = archives.version_block(version, "f.arc") + archives.arc_record(version, "http://a b c", "f.arc", 9, body) * 2
        found = list(archives.arc_records(data))
        assert found == [("http://a b c", archives.DATE, "text/html", body)] * 2
        with pytest.raises(ValueError):
            list(archives.arc_records(data[:-30]))
    for n in (0, 1, -1, 2**52, 2**63 - 1, -2**63):
        assert archives.page_of(archives.record_id(n, "")) == n
    assert archives.page_of(archives.record_id(None, "s")) is None


def test_sharding(spark):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 1009)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1 and len(share) == 7
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.25 * 1009
    keys = [None, "", "a", "a", "b"] + [str(i) for i in range(500)]
    rows = spark.createDataFrame([(k, 1, 2) for k in keys], "key string, slot int, __shard int")
    got = Counter((r.key, r.placed.slot, r.placed.shard) for r in sharding.place(rows, "key", names, 1009).collect())
    slot = lambda k: int(hashlib.md5((k or "").encode()).hexdigest()[:15], 16) % 1009
    assert got == Counter((k, slot(k), table[slot(k)]) for k in keys)
    for bad in (["a", "a"], []):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, top(x)) for x in list(up)}


def brute_spans(rows):
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        own = set()
        for h, a, b in sentence_spans.spans(t or ""):
            if h in own or seen.setdefault(h, d) != d:
                out.setdefault(d, []).append({"start": a, "stop": b})
            own.add(h)
    return {d: sentence_spans.merged(sorted(c, key=lambda s: (s["start"], s["stop"]))) for d, c in out.items()}


def test_sentence_spans(spark, docs, texts):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n, dots=True: " ".join(word() + ("." if dots and rng.random() < 0.12 else "") for _ in range(n))
    shared, flat = prose(60), prose(70, False)
    own = [(50_000 + i, f"{prose(80)} {p} {prose(80)}") for i, p in enumerate([shared, shared, flat, flat])]
    clean = [(60_000 + i, prose(150)) for i in range(5)]
    rows = [(d, t) for d, t, _ in texts] + own + clean
    rows = list({d: (d, t) for d, t in rows}.values())
    got = {r.doc_id: r for r in sentence_spans.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute_spans(rows)
    assert {d: r.spans for d, r in got.items()} == {d: ",".join(f"{a}:{b}" for a, b in c) for d, c in want.items()}
    assert not any(d >= 60_000 for d in got)
    assert got[50_001].removed_chars > 0.5 * len(shared) and got[50_003].removed_chars > 0.5 * len(flat)
    assert 50_000 not in got and 50_002 not in got
    for d, r in got.items():
        text = dict(rows)[d]
        assert len(r.text) == len(text) - r.removed_chars
    assert sentence_spans.without_repeats(docs.limit(0)).count() == 0


def test_decontamination(spark):
    items = [(1, "A train leaves the old Station at 9 and runs 120 km before Anna meets Bob at the river, how long did it take"),
             (2, "short one here"), (3, None), (4, ""), (None, "nothing to see in this one at all, it has no id"),
             (5, "plain words only make up this question about rivers and lakes and how they flow downhill")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pad = "some other text that has nothing to do with it at all and goes on for a while "
    changed = items[0][1].replace("120", "75.5").replace("Anna", "Clara").replace("Bob", "Dora")
    mixed = "Anna meets Anna and then Anna meets Anna at 5 or 5 and at 5 or 5 they all go home to sleep"
    benchmark = benchmark.unionByName(spark.createDataFrame([(6, "So Anna meets Bob and then Anna meets Bob at 5 or 7 and at 5 or 7 they all go home to sleep")], "item_id long, text string"))
    rows = [(10, pad + items[0][1] + " " + pad), (11, pad + changed), (12, pad), (13, None), (14, ""), (15, "SHORT, one; here!"),
            (16, items[5][1].upper() + "!!"), (17, "So " + mixed.replace("Anna meets Anna and", "Eva meets Udo and")), (18, pad * 400),
            (19, "So Eva meets Udo and then Eva meets Udo at 8 or 9 and at 8 or 9 they all go home to sleep"), (10, pad + items[0][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert got == {(10, 1), (11, 1), (15, 2), (16, 5), (19, 6)}
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {12, 13, 14, 17, 18}
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    small = decontaminate.BROADCAST_ROWS
    try:
        decontaminate.BROADCAST_ROWS = 0
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, benchmark).collect()} == got
    finally:
        decontaminate.BROADCAST_ROWS = small


def test_decontamination_finds_planted(spark):
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    plain = lambda t: re.findall(r"\w+", t.lower())
    first = {r.item_id: plain(r.text) for r in items.collect()}
    want = set()
    for d in docs.collect():
        text = " " + " ".join(plain(d.text)) + " "
        want |= {(d.doc_id, k) for k, w in first.items() if f" {' '.join(w[2:-2])} " in text}
    assert want and want <= got and len(got) <= len(want) + 3


def test_binomial_tail(spark):
    cases = [(k, n) for n in (1, 5, 30, 400, 5000, 200_000) for k in (0, 1, 3, 20, 100, 1500) if k < n * 0.01 or n < 500]
    rows = spark.createDataFrame(cases, "k long, n long")
    for share in (0.01, 0.3):
        for r in rows.withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), share)).collect():
            want = 1.0
            if r.k < r.n * share:
                logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(share)
                        + (r.n - i) * math.log1p(-share) for i in range(r.k + 1)]
                want = min(1.0, sum(math.exp(x) for x in logs))
            assert r.p == pytest.approx(want, rel=1e-6, abs=1e-300), (r, share)


def test_certified_cutoffs(spark):
    """Of 3,000 good and 300 bad documents the noisy bad ones go; good ones with some symbols stay."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, labels = [], []
    for i in range(3300):
        bad = i % 11 == 0
        marks = "$$$" if bad else ""
        text = " ".join(word() + (marks if rng.random() < 0.9 else "") for _ in range(30)) + (" #" if i % 5 == 0 else "")
        rows.append((i, text, "en"))
        labels.append((i, 0 if bad else 1))
    rows += [(9000, "word$$$ " + " ".join(word() + "$$$" for _ in range(30)), "xx")]
    docs, seen = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, seen).collect()}
    assert all(got[i] == (i % 11 != 0) for i in range(3300))
    assert got[9000]  # no labels in its stratum, no cutoff
    assert {r.doc_id for r in quality_rules.keep_good(docs, seen).collect()} == {d for d, k in got.items() if k}


def test_learned_identifiers(spark):
    rng = random.Random(4)
    rows = []
    for i in range(12):
        rows.append((i, f"please write to staff contact {rng.randrange(10**6)}u@mail.example.org today"))
    card = "4000 0000 0000 0002"
    rows += [(20 + i, f"paid by card number {card[:-1]}2 yesterday") for i in range(2)]
    rows += [(40 + i, f"reach me at host {rng.randrange(200)}.{rng.randrange(200)}.3.{i} over there") for i in range(8)]
    rows += [(60, "reach me at host 10.9.300.41 over there"), (61, "version 3.11 was out in 2024 with 17 changes"), (62, None), (63, "")]
    got = {r.doc_id: r for r in personal_data.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[60].n_ip == 0
    assert got[61].n_learned == 0 and got[62].spans == "" and got[63].spans == ""
    assert got[0].n_email == 1 and got[20].n_card == 1 and got[41].n_ip == 1
    unseen = [(i, f"member code: {rng.randrange(200)}.{rng.randrange(200)}.7.{i}") for i in range(100, 130)]
    unseen += [(i, f"member code: {rng.randrange(200)}.{rng.randrange(260, 999)}.7.{i}") for i in range(200, 203)]
    found = {r.doc_id: r for r in personal_data.personal_data(spark.createDataFrame(unseen, "doc_id long, text string")).collect()}
    assert all(found[i].n_ip == 1 and found[i].n_learned == 0 for i in range(100, 130))
    assert sum(found[i].n_learned for i in range(200, 203)) >= 1


def test_pipeline_matches_plain_steps(spark):
    """Every stage keeps the columns and drops what the plain reading drops."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert kept.columns == docs.columns
    facts = {r.doc_id: r for r in queries.op1_quality_rules(spark, folder).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, r in facts.items() if r.kept}
    single = corpus_pipeline.deduplicate(spark, kept, folder)
    texts = Counter(r.text for r in single.collect())
    assert max(texts.values()) == 1
    clean = corpus_pipeline.decontaminated(spark, single, folder)
    bad = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{folder}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    hidden = corpus_pipeline.mask(spark, clean, folder)
    assert hidden.columns == docs.columns
    assert not any(personal_data.emails(r.text or "") for r in hidden.collect())
    packed = corpus_pipeline.pack(spark, hidden, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in hidden.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in run.collect()) == Counter(
        (r.doc_id, r.piece, r.ids_crc32) for r in packed.collect())
