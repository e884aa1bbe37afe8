"""The registered queries' operators against plain Python on the same rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framewright.llm import near_dup, packing, personal_data, quality_rules, token_counts, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def byte_ids(texts):
    tk = Tokenizer.from_file(BYTE)
    return {(d, t): tk.encode(t or "", add_special_tokens=False).ids for d, t, _ in texts}


def test_quality_base(docs, texts, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = Counter(tuple(r) for r in quality_rules.quality_rules(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    want = Counter()
    for d, t, _ in texts:
        w = WORD.findall(t or "")
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        times = Counter(windows)
        inside = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        want[(d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(inside),
              failed, not failed)] += 1
    assert got == want


def test_personal_data_base(docs, texts):
    forms = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, s):
        n = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 16 <= len(n) <= 19 and sum((int(c) * 2 - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(n[::-1])) % 10 == 0
        return kind != "phone" or 8 <= len(n) <= 15

    got = {(r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in personal_data.personal_data(docs).collect()}
    for d, t, _ in texts:
        spans = {k: [] for k in forms}
        if t and not re.search(r"[0-9]{20000}|x{20000}", t):
            spans = {k: [m.span() for m in re.finditer(f, t) if fine(k, m[0])] for k, f in forms.items()}
        elif t and "@" in t:
            spans["email"] = [(0, len(t))]
        listed = ",".join(f"{k}:{a}:{b}" for k in forms for a, b in spans[k])
        key = (d, hashlib.sha256(listed.encode()).hexdigest(), *[len(spans[k]) for k in forms])
        assert any(g[:6] == key and g[6].startswith(listed) for g in got), (d, key, [g for g in got if g[0] == d])


def test_packing(docs, texts, byte_ids):
    rows = packing.pack(docs, BYTE, 1024).collect()
    by_doc, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, n in sorted(found):
            assert offset == at
            at += n
        assert at <= 1024
    for d, t, _ in texts:
        ids = byte_ids[d, t] + [2]
        copies = sum(1 for x in texts if x[0] == d)
        cut = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]})
        assert len(by_doc[d]) == copies * len(cut)
        assert [c[0] for c in cut] == list(range(len(cut))) and sum(c[2] for c in cut) == len(ids)
        for p, start, n, crc in cut:
            assert zlib.crc32(np.array(ids[start:start + n], "<u4").tobytes()) == crc
            assert n == 1024 or p == 0
    total = sum(r.length for r in rows)
    assert len(places) <= 1.03 * -(-total // 1024) + 1


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_plan_keeps_every_capacity(rule):
    rng = np.random.default_rng(5)
    counts = Counter(int(x) for x in rng.integers(1, 600, 3000))
    patterns = packing.plan(dict(counts), 1024, 4, 500_000.0, (1.0, 0.5, 0.5), rule)
    used = Counter()
    for times, order in patterns:
        assert sum(order) <= 1024 and len(order) <= 4 and sum(n * n for n in order) <= 500_000
        for n in order:
            used[n] += times
    assert used == counts
    with pytest.raises(ValueError):
        packing.plan({900: 1}, 1024, 4, 500_000.0)


def test_token_files(docs, texts):
    tk = Tokenizer.from_file(WORDS)
    got = sorted(tuple(r) for r in token_files.round_trip(docs, WORDS).collect())
    at, want = 0, []
    for d, t, _ in sorted(texts, key=lambda x: x[0]):
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_direct_access():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**32, 2000), [0, 255, 256, 2**32 - 1]]).astype(np.uint32)
    rng.shuffle(ids)
    file = token_files.Reader(token_files.encode(ids, [7, None], np.array([0, 9])))
    assert [file[i] for i in range(len(ids))] == ids.tolist()
    for a, b in [(0, len(ids)), (3, 4), (511, 1025), (8, 8), (4000, 5004)]:
        assert (file.slice(a, b) == ids[a:b]).all()
    assert file.doc_ids == [7, None] and file.document(1) == (9, len(ids))
    with pytest.raises(IndexError):
        file[len(ids)]


def test_near_duplicates(docs, texts):
    got = {tuple(r) for r in near_dup.near_duplicates(docs, 2, 0.8).collect()}
    sets = {}
    for d, t, _ in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    assert got == {(d, len(s), top(d), top(d) == d) for d, s in sets.items()}
    assert any(not r[3] for r in got)


def test_token_counts(docs, texts, byte_ids):
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, BYTE).collect())
    assert got == Counter((d, len((t or "").encode()), len(byte_ids[d, t])) for d, t, _ in texts)


def test_vocabulary_pieces_are_one_token():
    from framewright.llm import tokenizing

    tk, found = Tokenizer.from_file(BYTE), []
    for token in tokenizing.byte_level(BYTE)._mergeable_ranks:
        try:
            found.append(token.decode())
        except UnicodeDecodeError:
            continue
    pre = token_counts._pattern()
    whole = [t for t in found if pre.findall(t) == [t]]
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in tk.encode_batch(whole, add_special_tokens=False))


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert personal_data.personal_data(empty).count() == 0
    assert personal_data.masked(empty).count() == 0
    assert packing.pack(empty, BYTE).count() == 0
    assert token_files.round_trip(empty, WORDS).count() == 0
    assert near_dup.near_duplicates(empty, 2).count() == 0
    assert token_counts.token_counts(empty, BYTE).count() == 0


def test_null_ids_and_clashing_columns(spark):
    rows = [(None, "one two three four five six seven eight nine c@d.org", "x", 1, "y"), (None, None, None, None, None),
            (3, "mail a@b.org now and then some more words to reach ten of them", "en", 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int, spans string")
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    assert quality_rules.quality_rules(docs, labels).count() == 3
    assert sorted(quality_rules.keep_good(docs, labels).columns) == sorted(docs.columns)
    assert near_dup.near_duplicates(docs, 2).where(F.col("kept")).count() == 3
    assert near_dup.keep_one(docs).columns == docs.columns
    masked = personal_data.masked(docs)
    assert masked.columns == docs.columns
    assert masked.where("doc_id = 3").first().text.startswith("mail [email] now")
    assert masked.where("doc_id is null and text like '%nine [email]'").count() == 1
    assert masked.where("doc_id is null").count() == 2
    assert packing.pack(docs, BYTE).count() == 3
    assert token_files.round_trip(docs, WORDS).count() == 3
    assert token_counts.token_counts(docs, BYTE).count() == 3
