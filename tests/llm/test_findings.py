"""Cases of the review that were lost before."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from framewright.llm import near_dup, tokenizing


def test_star_of_variants_is_one_component(spark):
    """1,000 variants, each 0.82 similar to a text in the middle of the id order and less to each other."""
    rng = random.Random(3)
    centre = [f"w{i}" for i in range(101)]
    rows = [(500, " ".join(centre))]
    for i in range(1000):
        words = list(centre)
        for at in rng.sample(range(1, 100, 2), 5):
            words[at] = f"x{i}n{at}"
        rows.append((i if i < 500 else i + 1, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = near_dup.near_duplicates(docs, 2, 0.8).select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]


def test_word_ids_follow_the_normalizer_of_the_file():
    """Capital final sigma, decomposed Hangul and letters that NFC changes, alone, in words and before a mark."""
    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["\u039f\u0394\u039f\u03a3", "\u1112\u1161\u11ab\u1100\u116e\u11a8\u110b\u1165", "\u0958\u0915", "\u09dc", "\uf900\ufa10",
             "Stra\u00dfe", "\u0130stanbul", "PLAIN", "Word.", "e\u0301t\u00e9"]
    words += [w + "," for w in words]
    library = Tokenizer.from_file(path)
    got = [np.frombuffer(b, "<u4").tolist() for b in tokenizing.WordIds(path).batch([*words, " ".join(words)])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in [*words, " ".join(words)]]


def test_archives_from_elsewhere(spark, tmp_path):
    """Hand-written ARC 1 and 2 files: dns, bare line feeds, Latin-1, a blank in an address, short dates, equal payloads, a cut-off record."""
    import gzip

    from framewright.llm import archives

    page = b"<html>" + b"x" * 200 + b"</html>"
    crlf = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(page) + page
    bare = b"HTTP/1.0 200 OK\nServer: a\nContent-Length: %d\n\n" % len(page) + page
    dns = b"20010102030405\nexample.org. 10 IN A 1.2.3.4\n"
    body = b"1 0 old\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://old.arc 0.0.0.0 20010102030405 text/plain %d\n" % len(body) + body + b"\n"
    one += b"dns:example.org 1.2.3.4 20010102030405 text/dns %d\n" % len(dns) + dns + b"\n"
    one += b"http://example.org/a b\xe9 1.2.3.4 20010102 text/html %d\n" % len(crlf) + crlf + b"\n"
    one += b"http://example.org/lf 1.2.3.4 20010102030405 text/html %d\n" % len(bare) + bare + b"\n"
    body2 = b"2 0 old\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://new.arc 0.0.0.0 20010102030405 text/plain 200 - - 0 new.arc %d\n" % len(body2) + body2 + b"\n"
    two += b"http://example.org/cut 1.2.3.4 20010102030405 text/html 200 - - 99 new.arc 5000\n" + crlf
    (tmp_path / "arcs").mkdir()
    (tmp_path / "arcs" / "old.arc.gz").write_bytes(gzip.compress(one[:400]) + gzip.compress(one[400:]))
    (tmp_path / "arcs" / "new.arc.gz").write_bytes(gzip.compress(two))
    assert archives.convert(spark, str(tmp_path / "arcs"), str(tmp_path / "warcs")).count() == 2
    got = archives.read_warcs(spark, str(tmp_path / "warcs")).collect()
    assert sorted(r.record_type for r in got) == ["resource", "response", "revisit", "revisit"]
    same = [r for r in got if r.record_type != "resource"]
    assert {r.payload_bytes for r in same} == {len(page)} and len({r.payload_digest for r in same}) == 1
    least = min(r.page_id for r in same)
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {least} and least < 0
    data = archives.unpacked((tmp_path / "warcs" / "old.warc.gz").read_bytes())
    heads = [h for h, _ in archives.warc_records(data)]
    assert [h["WARC-Date"] for h in heads][1:3] == ["2001-01-02T03:04:05Z", "2001-01-02T00:00:00Z"]
    assert heads[2]["WARC-Target-URI"] == "http://example.org/a b\xe9" and heads[1]["Content-Type"] == "text/dns"
    assert b"WARC-Truncated" in archives.unpacked((tmp_path / "warcs" / "new.warc.gz").read_bytes())


def test_members_are_unpacked_in_slices():
    from framewright.llm import archives

    rows = [bytes([i % 251]) * (i * 37 % 50_000) for i in range(200)]
    assert archives.unpacked(b"".join(map(archives.member, rows))) == b"".join(rows)
    assert archives.unpacked(b"") == b""


def test_every_character_is_cut_as_the_library_cuts(spark):
    """All code points in the contexts aXb and X's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from framewright.llm import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x40000 or 0xE0000 <= i < 0xE0200 or i % 997 == 0)]
    rows = [(lo + k, "".join(f"a{x}b" if k else f"{x}'s" for x in points[lo:lo + 64])) for lo in range(0, len(points), 64) for k in (0, 1)]
    rows += [(10**7 + i, f"{x}'s a{x}1") for i, x in enumerate("\U0001e6c0ͰԱऄ")]
    tk = Tokenizer.from_file(path)
    want = {i: len(e.ids) for (i, _), e in zip(rows, tk.encode_batch([t for _, t in rows], add_special_tokens=False))}
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), path)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == want


def test_letters_beyond_ascii_cost_as_little_as_others():
    """Two million letters beyond ASCII, none of them classed differently, in far less than the minute that a pattern takes."""
    import time

    import public_tokenizers

    from framewright.llm import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    unlike = tokenizing.unlike(path)
    block = token_counts.Block(path, unlike)
    start = time.process_time()
    for i in range(200):
        block.add(i, "\u0436\u00e9\u4e2d " * 2500)
    assert time.process_time() - start < 10 and all(known == 0 for _, _, known in block.rows)
    block.add(200, f"a{unlike[-1]}b")
    assert block.rows[-1][2] > 0


def test_sums_of_many_blocks_are_bounded():
    """One word in 5,000 blocks: the task's memory stays far below the 1.3 GB that a sum per block would take."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    import public_tokenizers

    from framewright.llm import token_counts

    class Rows:
        select = lambda self, *names: self
        mapInArrow = lambda self, task, schema: task

    entry = pa.array([bytes([7, 0, 3])] * 1000, pa.binary())
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + 1000)), pa.array(["zzqx"] * 1000), entry], ["slot", "piece", "list"])
               for lo in range(0, 5000, 1000)]
    tracemalloc.start()
    out = [(b.column("slot")[0].as_py(), np.frombuffer(b.column("sums")[0].as_py(), "<u4").tolist())
           for b in token_counts._parts(Rows(), public_tokenizers.path("byte_bpe_50k.json"))(iter(batches))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(s for s, _ in out) == list(range(5000)) and len({tuple(v) for _, v in out}) == 1
    assert peak < 100 << 20


def test_copies_are_one_draw(spark):
    """60 good and 20 bad documents certify nothing, however often their rows or texts are repeated."""
    from pyspark.sql import functions as F

    from framewright.llm import quality_rules

    good = [(i, " ".join(f"word{i}x{k}" for k in range(30)), "en") for i in range(60)]
    bad = [(100 + i, " ".join(f"bad{i}x{k}!!!!" for k in range(30)), "en") for i in range(20)]
    labels = spark.createDataFrame([(d, int(d < 100)) for d, *_ in good + bad], "doc_id long, quality int")
    once = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    many = spark.createDataFrame([r for r in good + bad for _ in range(40)], once.schema)
    copies = [(1000 * (k + 1) + d, t, x) for d, t, x in good + bad for k in range(40)]
    more = labels.unionByName(spark.createDataFrame([(d, int(d % 1000 < 100)) for d, *_ in copies], labels.schema))
    renamed = once.unionByName(spark.createDataFrame(copies, once.schema))
    for docs, marks in ((once, labels), (many, labels), (renamed, more)):
        out = quality_rules.quality_rules(docs, marks)
        assert out.where(~F.col("kept") & ~F.col("base_failed")).count() == 0
        assert quality_rules.keep_good(docs, marks).count() == out.where("kept").count()


def test_one_row_of_each_text_stays(spark, tmp_path):
    """Repeated rows, one id with two texts, copies without an id, and texts without words."""
    from framewright.llm import near_dup

    t, u, v = (" ".join(f"{w}{i}" for i in range(60)) for w in "tuv")
    near = t + " and one more"
    rows = [(1, t), (1, t), (2, t), (2, u), (None, t), (None, v), (None, v), (3, near), (4, ""), (4, ""), (5, None), (None, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as component", "'x' as hash", "2 as first").write.parquet(str(tmp_path / "d"))
    kept = near_dup.keep_one(spark.read.parquet(str(tmp_path / "d")))
    assert kept.columns == ["doc_id", "text", "component", "hash", "first"]
    got = sorted(((r.doc_id or -1, r.text or "") for r in kept.collect()))
    assert got == sorted([(1, t), (2, u), (-1, v), (4, ""), (4, ""), (5, ""), (-1, " ")])
    assert near_dup.keep_one(spark.read.parquet(str(tmp_path / "d")).limit(0)).count() == 0
