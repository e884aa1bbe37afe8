"""Spans and templates against plain readings of their rules, and what they must find."""

import random
import re

import xxhash

from framewright.llm import decontaminate, sentence_spans


def plain_spans(text):
    """The rule of the spans word by word: (words, start, end) of each span."""
    at = [(m.start(), m.end()) for m in re.finditer(r"\S+", text or "")]
    words = [text[a:b].lower() for a, b in at]
    n, gap = len(words), sentence_spans.GAP
    if n < sentence_spans.MIN_WORDS:
        return []
    key = []
    for i, w in enumerate(words):
        after = text[at[i][1]:at[i + 1][0] if i + 1 < n else len(text)]
        ends = re.fullmatch(r".*[.!?][\"'’”)\]]*", w, re.S) or "\n" in after
        key.append(0 if ends else xxhash.xxh3_64_intdigest(w) | 1)
    stops = {n}
    for lo in range(max(1, n - gap + 1)):
        window = range(lo, min(n, lo + gap))
        low = min(key[i] for i in window)
        stops.add(max(i for i in window if key[i] == low) + 1)
    stops = sorted(stops)
    out = []
    for i in [0, *stops[:-1]]:
        far = [s for s in stops if s >= i + sentence_spans.MIN_WORDS]
        if far:
            out.append((tuple(words[i:far[0]]), at[i][0], at[far[0] - 1][1]))
    return out


def test_spans_follow_the_plain_rule(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "bb.", "so", "the", "Über", "İx", "end?", 'said."', "(x)", *[f"w{i}" for i in range(60)]])
    prose = lambda n: "".join(word() + rng.choice([" "] * 12 + ["\n", "  ", "\t"]) for _ in range(n))
    shared = [prose(k) for k in (25, 51, 90)]
    rows = [(i, prose(rng.randrange(70)) + rng.choice(["", *shared]) + prose(rng.randrange(70))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "a " * 500), (103, prose(40) * 2), (104, rows[3][1]), (105, prose(30_000) + shared[1]), (3, rows[3][1])]
    seen, want = {}, {}
    for d, t in sorted({r for r in rows}, key=lambda r: r[0]):
        own, lost = set(), []
        for h, a, b in plain_spans(t):
            if h in own or seen.setdefault(h, d) != d:
                lost.append((a, b))
            own.add(h)
        if lost:
            whole = []
            for a, b in sorted(lost):
                if whole and a <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], b)
                else:
                    whole.append([a, b])
            want[d] = ",".join(f"{a}:{b}" for a, b in whole)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, spans int, start int").repartition(5)
    assert {r.doc_id: r.spans for r in sentence_spans.without_repeats(table).collect()} == want


def test_passages_in_any_surroundings():
    """51 words are found, and mostly removed, wherever they stand; 44 are always found."""
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(5000)}" + ("." if rng.random() < 0.08 else "") for _ in range(n)]
    for length in (44, 51, 80):
        for _ in range(300):
            passage, before = prose(length), prose(rng.randrange(60))
            one = {h for h, _, _ in sentence_spans.spans(" ".join(prose(rng.randrange(60)) + passage + prose(rng.randrange(60))))}
            hits = [(a, b) for h, a, b in sentence_spans.spans(" ".join([*before, *passage, *prose(rng.randrange(60))])) if h in one]
            cut = sentence_spans.merged([{"start": a, "stop": b} for a, b in hits])
            assert cut and (length < 51 or sum(b - a for a, b in cut) > 0.5 * len(" ".join(passage)))


ITEM = ("Tom has 3 apples and buys 5 more. Tom gives 2 apples to Anna. How many apples does Tom have now, "
        "if Anna eats 1 of them on the way home?")


def test_templates_in_any_form(spark):
    renamed = ITEM.replace("Tom", "Sam").replace("Anna", "Lisa")
    forms = {1: ITEM, 2: renamed, 3: ITEM.lower(), 4: ITEM.upper(), 5: ITEM.replace(" ", "\n"), 6: f'"{renamed}"', 7: f"({renamed.replace(' ', '  ')})",
             8: ITEM.replace("3", "31").replace("5", "44"), 9: ITEM.replace("Tom gives", "Sam gives", 1).replace("does Tom", "does Max"),
             10: ITEM.replace("Tom gives", "Sam gives", 1).replace("does Tom", "does Max") + " " + ITEM,
             11: ITEM.replace("apples to Anna.", "apples to Anna, who is quite a good friend of old. "), 12: renamed + " " + ITEM.replace("Tom", "Max")}
    numbers = " ".join(str(i) for i in range(20))
    zeros = "0 " * 40
    rows = [(i, "and so it goes: " + t + " That is all.") for i, t in forms.items()]
    rows += [(20, " ".join(str(7 * i + 1) for i in range(4000))), (21, "see " + numbers), (22, "0 " * 3000), (23, None), (24, ""), (None, renamed),
             (25, "The Quick Brown Fox Jumps Over The Lazy Dog Again And Again"), (26, "word " * 50_000), (1, "another text of this id")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, band int, digest string, item_id int")
    items = spark.createDataFrame([(1, ITEM, 5), (2, numbers, 5), (3, zeros, 5), (4, "A Slow Green Cat Sits Under The Busy Man Time After Time", 5),
                                   (1, ITEM, 5)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(i, 1) for i in forms if i != 9} | {(21, 2), (22, 3)}
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, (r.text or "")[:7]) for r in kept.collect()) == sorted(
        [(9, "and so "), (20, "1 8 15 "), (23, ""), (24, ""), (25, "The Qui"), (26, "word wo"), (1, "another")])


def plain_tokens(text):
    import regex

    t = regex.sub(r"[\s\p{Z}]+", " ", text)
    out = []
    for m in regex.finditer(r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}]+", t):
        w = m[0]
        kind = "9" if w[0].isdigit() else "N" if regex.match(r"\p{Lu}+\p{Ll}", w) else ""
        glued = bool(out) and m.start() > 0 and out[-1][0] == "9" and out[-1][2] == m.start()
        behind = bool(out) and out[-1][0] == "9" and out[-1][2] == m.start() - 1 and t[m.start() - 1] == " "
        if not kind == "9" and (glued or (behind and w.lower() in decontaminate.UNITS)):
            kind = "U"
        out.append((kind, w.lower(), m.end()))
    return [(k, w) for k, w, _ in out]


def test_templates_follow_the_plain_rule(spark):
    """Which texts hold half of an item's windows on one alignment, by nested loops."""
    rng = random.Random(2)
    word = lambda: rng.choice(["Anna", "Bob", "Clara", "12", "7.5", "30 km", "5kg", *[f"w{c}" for c in "abcdefghijklmnopqrstuvwxyz"]])
    items = {i: " ".join(word() for _ in range(rng.choice([4, 8, 20, 30]))) for i in range(12)}
    swap = {"Anna": "Eva", "Bob": "Udo", "Clara": "Ina", "12": "13", "7.5": "8", "30": "31"}
    docs = {}
    for d in range(60):
        words = items[rng.randrange(12)].split()
        if d % 3 == 1:
            words = [swap.get(w, w) for w in words]
        if d % 3 == 2:
            words = [rng.choice(["Max", "99", w]) if w in swap and rng.random() < 0.5 else w for w in words]
        docs[d] = " ".join([word() for _ in range(rng.randrange(9))] + words[:rng.randrange(3, 40)] + [word() for _ in range(9)])

    def forms(toks, size):
        out = []
        for i in range(len(toks) - size + 1):
            part = toks[i:i + size]
            pair = set()
            for typed in (True, False):
                marked = [k and (typed or k != "N") for k, _ in part]
                low = (size - sum(map(bool, marked))) * 8 < decontaminate.PLAIN * size
                pair.add(tuple(w if low or not m else "\0" + k for (k, w), m in zip(part, marked)))
            out.append(pair)
        return out

    want = set()
    for i, item in items.items():
        ours = plain_tokens(item)
        size = min(8, len(ours))
        wins = forms(ours, size)
        half = -(-len(ours) // 2)
        for d, text in docs.items():
            theirs = plain_tokens(text)
            hits = [(x, p - x) for x, a in enumerate(wins) for p, b in enumerate(forms(theirs, size)) if a & b]
            for band in {s // half - j for _, s in hits for j in (0, 1)}:
                inside = [(x, s) for x, s in hits if s // half - band in (0, 1)]
                if len({x for x, _ in inside}) * 2 < len(wins):
                    continue
                count = {}
                for x, s in {(x + j, s) for x, s in inside for j in range(size)}:
                    if ours[x][0]:
                        own = count.setdefault(ours[x][1], {})
                        own[theirs[x + s][1]] = own.get(theirs[x + s][1], 0) + 1
                if sum(max(c.values()) for c in count.values()) >= 0.9 * sum(sum(c.values()) for c in count.values()):
                    want.add((d, i))
    tables = [spark.createDataFrame(list(rows.items()), f"{k} long, text string") for rows, k in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(*tables).collect()}
    assert got == want and want
