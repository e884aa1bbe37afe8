"""Quality rules with certified cutoffs.

Each rule rejects a document when a score exceeds a cutoff. The cutoffs are not guessed: labelled documents are a holdout on
which, per stratum and rule, the cutoffs of a fixed ladder are tested from the loosest to the strictest. A cutoff passes if the
exact binomial tail P(X <= k | n, share) of its k false rejections among n good documents is at most delta / (strata x rules).
That is Bonferroni over strata and rules and a fixed sequence inside a ladder (testing stops at the first failure), so with
probability 1 - delta every rule wrongly rejects at most risk / rules of the good documents of every stratum, and all rules
together at most ``risk``. Among the cutoffs that pass, the one that rejects most bad documents is used, the loosest on ties;
a rule that catches no bad document, or a stratum with too few labels, gets none.

Only DataFrame functions are used. Edge cases: a null or blank text has no words and fails the base rule; a null or unknown
stratum belongs to "other"; a document with several labels counts as bad if one says so; labels of unknown documents and null
labels are ignored; without labels only the base rule rejects; repeated rows are judged alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from framewright.llm.shared import once, settled, slot_filter, words, written

SYMBOLS = "#*$%&|<>"
#: Fixed ladders, loosest first; a score above the cutoff rejects.
LADDERS = {
    "symbols_per_word": (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "shouts_per_word": (2.0, 1.0, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05),
    "capital_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "repeat_share": (0.18, 0.15, 0.12, 0.1, 0.08, 0.06, 0.04, 0.02),
    "dup_line_share": (0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1),
}
STRATA = ("en", "de", "fr", "es")
WINDOW = 5
TAIL_STEPS = 4000


def _gone(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _repeated(hashes: Column) -> Column:
    """Words inside five-word windows that occur at least twice."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(WINDOW)]),
    )

    def covered(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = once(pairs, lambda p: F.filter(
            p, lambda x, j: (F.get(p, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(p, j - 1)["h"] == x["h"]))))
        places = F.array_sort(F.transform(F.filter(again, lambda x: x.isNotNull()), lambda x: x["i"]))
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(a["end"], x)).alias("n"), (x + WINDOW).alias("end")),
            lambda a: a["n"])

    counted = once(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))
    return F.when(F.size(hashes) <= WINDOW, F.lit(0)).otherwise(counted).cast("long")


def features(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",), stratum: str = "lang", strata=STRATA) -> DataFrame:
    """The kept columns with the word facts, the base verdict, the stratum and the score of every rule, in one pass."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        *keep, F.coalesce(F.when(F.col(stratum).isin(*strata), F.col(stratum)), F.lit("other")).alias("stratum"),
        F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("__h"),
        F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _gone(t, SYMBOLS).cast("long").alias("n_symbols"), _gone(t, "!").alias("__shouts"),
        _gone(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("__capitals"),
        F.filter(F.split(t, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "").alias("__lines"),
    )
    rows = rows.select(
        *keep, "stratum", "word_chars", "n_symbols", "__shouts", "__capitals",
        F.size("__h").cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").alias("__n_lines"), _repeated(F.col("__h")).alias("n_repeat_words"),
    )
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    rows = settled(rows, [*keep, "stratum"], **{c: F.col(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "__shouts", "__capitals", "__n_lines")})
    return rows.select(
        *keep, "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        per("n_symbols", "n_words").alias("symbols_per_word"), per("__shouts", "n_words").alias("shouts_per_word"),
        per("__capitals", "word_chars").alias("capital_share"), per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_dup_lines", "__n_lines").alias("dup_line_share"),
    )


def _log_factorial(n: Column) -> Column:
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) of a binomial with n draws: the term of k, then downwards; what is left after TAIL_STEPS terms is bounded
    from above by a geometric series, so the result is never too small. 1 where k is not below the mean."""
    odds = (1 - share) / share
    top = (_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
           + k * math.log(share) + (n - k) * math.log1p(-share))
    ratio = lambda i: i * odds / (n - i + 1)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        term = a["term"] * ratio(k - j)
        return F.struct(term.alias("term"), (a["sum"] + term).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), F.least(k - 1, F.lit(TAIL_STEPS).cast("long"))))
    steps = F.coalesce(steps, F.array().cast("array<long>"))
    rest = once(ratio(F.greatest(k - TAIL_STEPS, F.lit(0))), lambda r: r / (1 - r))
    total = F.aggregate(steps, start, step, lambda a: a["sum"] + a["term"] * rest)
    return F.when((n > 0) & (k < n * share), F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def certified_cutoffs(scored: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, strata=STRATA,
                      ladders=LADDERS) -> DataFrame:
    """One row per stratum with labels: the cutoff of every rule, or null. At most len(strata) + 1 rows.

    A draw is a labelled text: a repeated id counts once (its text of the smallest digest), equal texts count once, good only if all
    their labels say so. Otherwise copies would pass as independent draws and certify too early. Only ``quality`` decides.
    """
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.min("quality") > 0).alias("good"))
    facts = F.struct("stratum", *ladders)
    drawn = scored.where(~F.col("base_failed")).join(good, "doc_id")
    drawn = drawn.groupBy("doc_id").agg(F.min("good").alias("good"), F.min(F.struct("digest", facts.alias("f"))).alias("d"))
    held = drawn.groupBy("d.digest").agg(F.min("good").alias("good"), F.min("d.f").alias("f")).select("good", "f.*")
    hits = [F.sum((F.col(r) > c).cast("long") * (F.col("good") == g).cast("long")).alias(f"{r}_{i}_{int(g)}")
            for r, ladder in ladders.items() for i, c in enumerate(ladder) for g in (True, False)]
    sums = held.groupBy("stratum").agg(F.sum(F.col("good").cast("long")).alias("n"), *hits)
    flat = sums.select("stratum", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("rung"), F.lit(float(c)).alias("cutoff"),
                 F.col(f"{r}_{i}_1").alias("wrong"), F.col(f"{r}_{i}_0").alias("caught"))
        for r, ladder in ladders.items() for i, c in enumerate(ladder)])).alias("x")).select("stratum", "n", "x.*")
    level = delta / ((len(strata) + 1) * len(ladders))
    tested = flat.withColumn("passes", binomial_tail(F.col("wrong"), F.col("n"), risk / len(ladders)) <= level)
    ladder = Window.partitionBy("stratum", "rule").orderBy("rung").rowsBetween(Window.unboundedPreceding, 0)
    sure = tested.withColumn("sure", F.min("passes").over(ladder)).where(F.col("sure") & (F.col("caught") > 0))
    best = sure.groupBy("stratum", "rule").agg(F.max(F.struct("caught", -F.col("rung"), "cutoff")).alias("b"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("b.cutoff"))).alias(f"cut_{r}") for r in ladders])


def judged(scored: DataFrame, cutoffs: DataFrame, ladders=LADDERS) -> DataFrame:
    """The scored rows with ``kept``: not failed by the base rule, and no certified rule of the stratum fires."""
    fires = F.lit(False)
    for r in ladders:
        fires = fires | F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))
    cuts = F.broadcast(cutoffs.withColumnRenamed("stratum", "__stratum"))
    rows = scored.join(cuts, F.col("stratum") == F.col("__stratum"), "left")
    return rows.withColumn("kept", ~(F.col("base_failed") | fires)).drop("__stratum", *[f"cut_{r}" for r in ladders])


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """Facts, scores and verdict of every document; the scores are written once and serve calibration and verdict."""
    scored = written(features(docs.withColumn("digest", digest(F.col("text"))), keep=("doc_id", "digest")), "quality-scores")
    return judged(scored, written(certified_cutoffs(scored, labels, risk, delta), "quality-cutoffs"))


def digest(text: Column) -> Column:
    """A digest of a text; equal texts are one draw."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05) -> DataFrame:
    """The documents that pass, all columns unchanged. Labelled documents are scored first, then every document in place.

    The cutoffs need the labelled documents only, so the others are left out before they are scored: by hash slots of bounded
    size, which move no text, then exactly on the scores.
    """
    ids = F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")
    known = labels.where(F.col("quality").isNotNull()).select(ids).distinct()
    texts = slot_filter(docs.select("doc_id", "text", "lang"), "doc_id", known).withColumn("digest", digest(F.col("text")))
    scored = written(features(texts, keep=("doc_id", "digest")), "quality-scores")
    cutoffs = written(certified_cutoffs(scored.join(known, "doc_id", "left_semi"), labels, risk, delta), "quality-cutoffs")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text", "lang")
    return judged(features(boxed, keep=("__row",)), cutoffs).where("kept").select("__row.*")
