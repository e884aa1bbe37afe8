"""Personal data: fixed forms as seeds, contextual patterns learned from them.

Seeds are e-mail addresses, IP addresses, card numbers and phone numbers found by fixed forms. Every other token with a digit or
an at sign is a candidate. Each occurrence of a seed or candidate yields lexical patterns: the form of the token together with
the word to the left, with the two words to the left, and with the word to the right; and, for tokens like ``key=value``, the key.
Patterns and identifiers form a bipartite graph. Spark scores it in a few rounds: a pattern's confidence is the mean confidence
of its distinct identifiers (seeds are sure, smoothed by one doubtful one), an identifier's is one minus the product of its trusted
patterns' doubts. A pattern counts only with at least MIN_SEEDS identifiers that are sure so far and a confidence of at
least TRUST; an identifier with a confidence of at least TRUST is accepted and can support further patterns in the next round. The
accepted candidates are the learned spans, of kind "learned"; the fixed spans always stay.

The graph is aggregated to (pattern, identifier) counts before any shuffle by one of them, so a phrase in a third of all
documents is one edge. Edge cases: null and empty texts have no spans; null ids and repeated rows are searched like any row (rows of a null id get
no learned spans); ties are broken by the order of the kinds, then the start; all forms take time linear in the text.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SEEDS, TRUST = 3, 3, 0.75
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
#: The fixed forms; look-behinds and possessive counts only keep them linear.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
DIGITS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: for each at sign the local part reaches back to the last match at most."""
    out, done, sign = [], 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, sign + 1) if start < sign else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        sign = text.find("@", max(sign + 1, done))
    return out


def fixed_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of the fixed forms by kind, in code points, end exclusive."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    out["ip"] = [m.span() for m in IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def form(token: str) -> str:
    """The form of a token: runs of digits, of letters, and other signs as they are; lengths count only for runs of
    more than three digits."""
    out, at = [], 0
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|[\W_]", token[:200]):
        x = m[0]
        kind = "9" if x[0].isdigit() else "a" if x[0].isalpha() else x
        out.append(kind + (str(len(x)) if kind == "9" and len(x) > 3 else ""))
        at += 1
        if at == 12:
            break
    return "".join(out)


def _plain(word: str) -> str:
    return word.strip("\"'.,;:!?()[]{}<>*#$%&|").lower()[:40]


def contexts(text: str, start: int, stop: int) -> list[str]:
    """The lexical patterns of the token at a place: one line is looked at, 120 code points on either side at most."""
    left = text[max(0, start - 120):start].rsplit("\n", 1)[-1].split()
    right = text[stop:stop + 120].split("\n", 1)[0].split()
    shape = form(text[start:stop])
    words = [_plain(w) for w in left[-2:]]
    out = []
    if words and words[-1]:
        out.append(f"L {words[-1]} {shape}")
        if len(words) == 2 and words[0]:
            out.append(f"LL {words[0]} {words[1]} {shape}")
    if right and _plain(right[0]):
        out.append(f"R {shape} {_plain(right[0])}")
    key = re.match(r"[^\W\d_]{2,30}[=:]", text[start:stop])
    if key:
        out.append(f"K {key[0].lower()}")
    return out


FOUND = """doc_id long, row string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string,
    marks array<struct<start:int,stop:int,seed:boolean,thing:string,patterns:array<string>>>"""


def found(docs: DataFrame) -> DataFrame:
    """Per document the fixed spans, and every seed and candidate with its patterns. ``row`` tells rows of one id apart."""

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                spans = fixed_spans(text)
                listed = ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])
                taken = sorted(s for k in KINDS for s in spans[k])
                marks = [{"start": a, "stop": b, "seed": True, "thing": text[a:b][:200], "patterns": contexts(text, a, b)} for a, b in taken]
                i = 0
                for m in CANDIDATE.finditer(text):
                    a, b = m.span()
                    while a < b and not text[a].isalnum() and text[a] not in "+@":
                        a += 1
                    while b > a and not text[b - 1].isalnum():
                        b -= 1
                    while i < len(taken) and taken[i][1] <= a:
                        i += 1
                    if b - a > 3 and (i == len(taken) or taken[i][0] >= b):
                        marks.append({"start": a, "stop": b, "seed": False, "thing": text[a:b][:200], "patterns": contexts(text, a, b)})
                print_ = hashlib.md5(text.encode()).hexdigest()
                out.append((doc_id, print_, *[len(spans[k]) for k in KINDS], hashlib.sha256(listed.encode()).hexdigest(), listed, marks))
            cols = list(zip(*out)) or [[]] * 9
            mark = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("seed", pa.bool_()), ("thing", pa.string()),
                                       ("patterns", pa.list_(pa.string()))]))
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "row", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "marks"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FOUND)


def learned_things(marks: DataFrame) -> DataFrame:
    """(thing) of the candidates that the rounds accept, from rows (thing, seed, pattern)."""
    edges = written(marks.groupBy("pattern", "thing").agg(F.max(F.col("seed").cast("double")).alias("seed")), "pattern-edges")
    sure = edges.groupBy("thing").agg(F.max("seed").alias("trust"))
    for _ in range(ROUNDS):
        scored = edges.join(sure, "thing")
        patterns = scored.groupBy("pattern").agg(
            (F.sum("trust") / (F.count("*") + 1)).alias("trust"), F.sum((F.col("trust") >= TRUST).cast("int")).alias("n"))
        good = patterns.where((F.col("n") >= MIN_SEEDS) & (F.col("trust") >= TRUST)).select(
            "pattern", F.log(1 - F.least("trust", F.lit(0.999999))).alias("doubt"))
        reached = edges.join(good, "pattern").groupBy("thing").agg((1 - F.exp(F.round(F.sum("doubt"), 9))).alias("reached"))
        base = edges.groupBy("thing").agg(F.max("seed").alias("seed"))
        sure = written(base.join(reached, "thing", "left").select(
            "thing", F.greatest("seed", F.coalesce("reached", F.lit(0.0))).alias("trust")), "pattern-trust")
    base = edges.groupBy("thing").agg(F.max("seed").alias("seed")).where("seed < 1").select("thing")
    return sure.where(F.col("trust") >= TRUST).join(base, "thing", "left_semi").select("thing")


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts and digest of the fixed spans, n_learned and all spans."""
    rows = written(found(docs), "personal-data")
    flat = rows.select("doc_id", "row", F.explode("marks").alias("m")).select("doc_id", "row", "m.*")
    learned = learned_things(flat.select("thing", "seed", F.explode("patterns").alias("pattern")))
    hits = flat.where("not seed and doc_id is not null").join(learned, "thing", "left_semi")
    extra = hits.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("x"))
    texts = F.array_join(F.transform("x", lambda s: F.concat_ws(":", F.lit("learned"), s["start"], s["stop"])), ",")
    joined = rows.drop("marks").join(extra, ["doc_id", "row"], "left")
    return joined.select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_learned"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("x") > 0, texts)).alias("spans"), "row")


def masked(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, all columns otherwise unchanged."""
    found_spans = written(personal_data(docs).where("spans <> ''").select("doc_id", "row", "spans").distinct(), "personal-spans")

    def run(batches):
        for batch in batches:
            texts = []
            for text, listed in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist()):
                if not listed:
                    texts.append(text)
                    continue
                cut = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in listed.split(",")))
                parts, at = [], 0
                for a, b, kind in cut:
                    if a >= at:
                        parts += [text[at:a], f"[{kind}]"]
                    else:  # overlaps the one before, which is widened
                        b = max(at, b)
                    at = b
                texts.append("".join([*parts, text[at:]]))
            names = [n for n in batch.schema.names if n not in ("text", "__spans")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.string())], [*names, "text"])

    rest = [c for c in docs.columns if c != "text"]
    marked = found_spans.toDF("__id", "__row", "__spans")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("__rest"), F.col("text"),
                       F.col("doc_id").cast("long").alias("__doc")).withColumn(
        "__md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    joined = rows.join(marked, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__md5") == F.col("__row")), "left")
    kind = rows.schema["__rest"].dataType.simpleString()
    out = joined.select("__rest", "text", "__spans").mapInArrow(run, f"__rest {kind}, text string")
    return out.select(*[F.col("text") if c == "text" else F.col(f"__rest.`{c}`") for c in docs.columns])
