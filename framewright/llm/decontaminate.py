"""Benchmark decontamination by canonical templates.

Numbers, units behind numbers and names (words that begin with a capital and go on in lower case, wherever they stand) become typed
placeholders; the rest is lower-case words, white space and punctuation do not count. Windows of eight words are hashed on both sides
in two forms: one with all placeholders, so that a question whose numbers or names were exchanged still matches, and one
with names as lower-case words, so that a copy matches in any case. A window with fewer than three plain words in eight is hashed with
its values, so tables of numbers and headings match exact copies only.

First the distinct hashes of each document meet those of the items; documents with at least half of an item's windows are
read again. Their hits are dealt to alignments: a band of shifts (place in the document less place in the item) as wide as the
item is long, so words put in or taken out leave a copy in one band and two copies never share one. Every band that holds half of the
item's windows is judged on the placeholders inside its matched windows: the document is contaminated if in nine of ten places each value
of the item stands for one value of the document.

Only DataFrame functions are used. The windows of the documents stream through the join; a benchmark of at most BROADCAST_ROWS
windows is broadcast, a larger one is joined by a shuffle, with the same result. Texts are told apart by digest, so copies are judged once.
Edge cases: null or empty texts and items without words match nothing; an item of fewer than eight words is one window of
all its words; null item ids are left out; repeated rows count once; documents without an id are left out of the pairs, but their
texts are judged and ``keep_clean`` drops them; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import once, settled, slot_filter, written

WINDOW = 8
SHARE, AGREE = 0.5, 0.9
#: Plain words that a window hashed by its types has at least, in eighths of its size.
PLAIN = 3
BROADCAST_ROWS = 500_000
#: Units that count as such behind a number and a blank; letters that follow a number directly always do.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years",
         "miles", "feet", "inches", "pounds", "dollars", "euros", "percent", "meters", "metres", "liters", "litres", "kilometers",
         "horas", "minutos", "segundos", "días", "años", "metros", "litros", "kilómetros", "heures", "secondes", "jours", "ans",
         "mètres", "kilomètres", "stunden", "minuten", "sekunden", "tage", "jahre", "meter", "liter", "kilometer", "euro", "prozent")
NUMBER, NAME, UNIT = "\x01", "\x02", "\x03"


def tokens(text: Column) -> Column:
    """The words of a text; placeholders keep their value behind a mark of their type."""
    # each pattern begins with what it looks for, so that it passes over all else quickly; single blanks are left alone
    blank = r"\s\p{Z}\x01-\x03"
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{blank}&&[^ ]][{blank}]*| [{blank}]+", " ")
    t = F.regexp_replace(t, r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Lu}*\p{Ll}", NAME + "$0")
    t = F.regexp_replace(t, r"[0-9](?<![\p{L}\p{N}][0-9])[0-9]*(?:[.,][0-9]+)*", NUMBER + "$0")
    t = F.regexp_replace(F.lower(t), rf"({NUMBER}[0-9.,]*[0-9])(?: {NAME}?({'|'.join(UNITS)})|(\p{{L}}{{1,12}}))(?![\p{{L}}\p{{N}}])",
                         f"$1 {UNIT}$2$3")
    gaps = r"(?:[^\p{L}\p{N}\x01-\x03.,]|[.,](?![0-9])|(?<![0-9])[.,])+"
    return F.filter(F.split(t, gaps), lambda w: w != "")


def _value(word: Column) -> Column:
    return F.when(word < "\x04", F.substring(word, 2, 1 << 30)).otherwise(word)


def _runs(items: Column, size: int, join) -> Column:
    """``join`` of every ``size`` consecutive elements; eight are joined by halves."""
    if size == 8:
        for step in (1, 2, 4):
            items = once(items, _paired(step, join))
        return items
    return once(items, lambda x: F.transform(F.sequence(F.lit(0), F.size(x) - size), lambda i: _folded([F.get(x, i + j) for j in range(size)], join)))


def _paired(step: int, join):
    """A function that joins each element with the one ``step`` places on."""
    def body(x: Column) -> Column:
        rest = F.greatest(F.size(x) - step, F.lit(0))
        return F.zip_with(F.slice(x, 1, rest), F.slice(x, 1 + step, rest), join)
    return body


def _folded(parts: list[Column], join) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = join(out, p)
    return out


def windows(toks: Column, size: int) -> Column:
    """The hashes of all windows by types (t), and with names as words (n, null for a window without names); null where the text is
    shorter than a window."""
    def made(t: Column) -> Column:
        kind = F.transform(t, lambda w: F.when(w >= "\x04", 0).when(w.startswith(NAME), 17).otherwise(1))
        mark = lambda w: F.xxhash64(F.substring(w, 1, 1))
        typed = F.transform(t, lambda w: F.when(w >= "\x04", F.xxhash64(w)).otherwise(mark(w)))
        named = F.transform(t, lambda w: F.when(w >= "\x04", F.xxhash64(w)).when(w.startswith(NAME), F.xxhash64(_value(w))).otherwise(mark(w)))
        whole = F.transform(t, lambda w: F.xxhash64(_value(w)))
        few = lambda s: (size - s % 16) * 8 < PLAIN * size
        few_named = lambda s: (size - s % 16 + F.floor(s / 16)) * 8 < PLAIN * size
        add, mix = (lambda a, b: a + b), (lambda a, b: F.xxhash64(a, b))
        # sums of marks and hashes of values are needed only where so many marks stand within one window
        need = size * (8 - PLAIN) // 8 + 1
        spots = F.filter(F.transform(t, lambda w, i: F.when(w < "\x04", i)), lambda i: i.isNotNull())
        dense = F.coalesce(once(spots, lambda p: F.exists(F.transform(
            p, lambda x, j: F.coalesce(F.get(p, j + need - 1) - x < size, F.lit(False))), lambda d: d)), F.lit(False))
        return once(F.struct(F.when(dense, F.struct(_runs(kind, size, add).alias("s"), _runs(whole, size, mix).alias("v"))).alias("m"),
                             _runs(typed, size, mix).alias("t"), _runs(named, size, mix).alias("n")),
                    lambda x: F.when(x["m"].isNull(), F.struct(x["t"].alias("t"), F.transform(
                        x["n"], lambda h, i: F.when(h != F.get(x["t"], i), h)).alias("n"))).otherwise(F.struct(
                            F.transform(x["t"], lambda h, i: F.when(few(F.get(x["m"]["s"], i)), F.get(x["m"]["v"], i)).otherwise(h)).alias("t"),
                            F.transform(x["n"], lambda h, i: F.when(F.get(x["m"]["s"], i) >= 16, F.when(
                                few_named(F.get(x["m"]["s"], i)), F.get(x["m"]["v"], i)).otherwise(h))).alias("n"))))
    return once(toks, lambda t: F.when(F.size(t) >= size, made(t)))


def _both(wins: Column) -> Column:
    """Per window an array of its two hashes."""
    return F.transform(wins["t"], lambda h, i: F.array(h, F.get(wins["n"], i)))


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """A row per item: its tokens, window size, and the hashes of its windows."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", tokens(F.col("text")).alias("item"))
    rows = rows.where(F.size("item") > 0).withColumn("size", F.least(F.size("item"), F.lit(WINDOW)))
    sized = F.lit(None).cast("struct<t:array<bigint>,n:array<bigint>>")
    for n in range(1, WINDOW + 1):
        sized = F.when(F.col("size") == n, windows(F.col("item"), n)).otherwise(sized)
    return rows.select("item_id", "item", "size", once(sized, _both).alias("wins")).dropDuplicates(["item_id", "item"])


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(digest, item_id, n_windows, item_windows, n_slots, n_changed_slots) of the contaminated texts, by the MD5 of the text."""
    items = written(_item_windows(benchmark).withColumn("item_key", F.xxhash64("item_id", "item")), "benchmark-windows")
    flat = items.select("item_key", "size", F.posexplode("wins").alias("ipos", "hs")).select("item_key", "size", "ipos", F.explode("hs").alias("h")).where("h is not null").distinct()
    facts = {r["size"]: r["count"] for r in flat.groupBy("size").count().collect()}  # at most eight rows
    rows = docs.where(F.col("text").isNotNull()).select(F.md5(F.col("text").cast("binary")).alias("digest"), "text")

    def met(wins: DataFrame, size: int) -> DataFrame:
        side = flat.where(F.col("size") == size).drop("size")
        return wins.join(F.broadcast(side) if facts[size] <= BROADCAST_ROWS else side, "h").drop("h")

    def every(found: list[DataFrame], empty: str) -> DataFrame:
        out = docs.sparkSession.createDataFrame([], empty)
        for f in found:
            out = out.unionByName(f)
        return out

    sizes = sorted(facts)
    # the windows are made once, outside the generator that deals them out; an outer one gets no filter that makes them again
    own = {n: settled(rows, ["digest"], hs=windows(tokens(F.col("text")), n)) for n in sizes}
    found = [met(own[n].select("digest", F.explode_outer(F.array_distinct(F.concat("hs.t", "hs.n"))).alias("h")), n) for n in sizes]
    hits = written(every(found, "digest string, item_key long, ipos int").distinct(), "benchmark-hits")
    total = items.select("item_key", F.size("wins").alias("item_windows"), F.size("item").alias("words"))
    counts = hits.groupBy("digest", "item_key").agg(F.count("*").alias("n")).join(total, "item_key")
    likely = written(counts.where(F.col("n") >= share * F.col("item_windows")).drop("n"), "benchmark-likely")
    texts = slot_filter(rows, "digest", likely.select("digest")).join(likely.select("digest").distinct(), "digest", "left_semi")
    texts = written(settled(texts.groupBy("digest").agg(F.first("text").alias("text")), ["digest"], toks=tokens(F.col("text"))), "benchmark-texts")
    placed = [met(texts.select("digest", F.posexplode(once(windows(F.col("toks"), n), _both)).alias("pos", "hs")).select(
        "digest", "pos", F.explode("hs").alias("h")), n) for n in sizes]
    placed = every(placed, "digest string, pos int, item_key long, ipos int").distinct().join(likely, ["digest", "item_key"])
    half = F.ceil(F.col("words") / 2).cast("long")
    shift = F.col("pos") - F.col("ipos")
    band = F.floor(shift / half)
    banded = placed.select("digest", "item_key", "item_windows", F.explode(F.array(band, band - 1)).alias("band"), "ipos", shift.alias("shift"))
    groups = banded.groupBy("digest", "item_key", "band").agg(
        F.max("item_windows").alias("item_windows"), F.collect_set(F.struct("ipos", "shift")).alias("hits"))
    groups = groups.withColumn("n_windows", F.size(F.array_distinct("hits.ipos")).cast("long"))
    groups = groups.where(F.col("n_windows") >= share * F.col("item_windows"))
    read = groups.join(texts, "digest").join(items.select("item_key", "item", "size"), "item_key")
    places = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.transform(
        F.sequence(x["ipos"], x["ipos"] + F.col("size") - 1), lambda i: F.struct(i.alias("at"), x["shift"].alias("shift"))))))
    slots = F.transform(F.filter(places, lambda p: F.get("item", p["at"]) < "\x04"), lambda p: F.struct(
        p["at"].alias("at"), p["shift"].alias("shift"), _value(F.get("item", p["at"])).alias("ours"),
        _value(F.get("toks", p["at"] + p["shift"])).alias("theirs")))
    keys = ["digest", "item_key", "band", "n_windows", "item_windows"]
    judged = settled(read, keys, slots=slots)
    pairs = judged.select(*keys, F.explode_outer("slots").alias("s")).groupBy(*keys, "s.ours", "s.theirs").agg(F.count("s").alias("c"))
    values = pairs.groupBy(*keys, "ours").agg(F.sum("c").alias("c"), F.max("c").alias("most"),
                                              F.sum(F.when(F.col("ours") != F.col("theirs"), F.col("c")).otherwise(0)).alias("changed"))
    bands = values.groupBy(*keys).agg(F.sum("c").alias("n_slots"), F.sum("most").alias("most"), F.sum("changed").alias("n_changed_slots"))
    good = bands.where(F.col("most") >= AGREE * F.col("n_slots"))
    best = good.groupBy("digest", "item_key").agg(F.max(F.struct(
        "n_windows", -F.col("n_changed_slots"), "n_slots", "n_changed_slots", F.col("item_windows").cast("long").alias("item_windows"))).alias("b"))
    return best.join(items.select("item_key", "item_id"), "item_key").select(
        "digest", "item_id", *[f"b.{c}" for c in ("n_windows", "item_windows", "n_slots", "n_changed_slots")])


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """Pairs (doc_id, item_id) of contaminated documents with the windows found, the item's windows and its slots."""
    bad = written(contaminated_texts(docs, benchmark, share), "benchmark-bad")
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    numbers = ("n_windows", "item_windows", "n_slots", "n_changed_slots")
    both = slot_filter(ids, "digest", bad.select("digest")).distinct().join(bad, "digest")
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct(*numbers)).alias("b"))
    return best.select("doc_id", "item_id", *[f"b.{c}" for c in numbers])


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that no item contaminates, all columns unchanged."""
    bad = written(contaminated_texts(docs, benchmark, share).select(F.col("digest").alias("__digest")).distinct(), "benchmark-bad")
    return docs.join(bad, F.md5(F.col("text").cast("binary")) == F.col("__digest"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
