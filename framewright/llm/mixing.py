"""Mixing sources to target weights: fixed-length blocks, multinomial draws per shard, index permutations.

* Targets: sources in order share ``share`` of all words by repeating weights; what exceeds ``most`` times a source is shared
  again among the others until none is above (a few one-row aggregates over the table of sources).
* Blocks: the words of a source, in order of the documents' ids, are cut into blocks of ``block`` words. A block is only an index: a
  document covers a range of blocks, found from its running offset.
* Draws: every slot that fills a source's target draws its output shard by a seeded hash, so the counts of a source over the shards
  are one multinomial draw, and a shard's counts of sources are multinomial given the totals of the sources. The totals stay
  fixed: every source meets its target to the word (the last slot takes a part of its block), no document comes more than ``most`` times.
* Permutation: slot i of pass e over a source reads block ``permuted(i)``. The permutation is a swap-or-not network keyed by seed,
  source and pass: one rule for any number of blocks, nothing stored, and its own inverse when the rounds run backwards.
* Slots and pieces of documents meet by (source, block index), which is unique among blocks, so a hot source spreads evenly.

Bounds: a table of one row per source; slots are made by runs of ``RUN``, as many tasks as the slots need.

Edge cases: null text is empty; documents without words are taken 0 times; a null source is a source of its own, the last one. Null
and repeated ids and repeated rows are documents of their own. An empty table, or one without words, takes nothing. Reruns agree: order, draws
and permutations depend on the rows and the seed alone. Other columns are ignored unless named in ``keep``; names clash with nothing, as kept
columns travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.llm.shared import WORD_GAP, ready, words, written
from framewright.operators.scale import join_keys, join_small, number_rows, running_total

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
BLOCK, SHARDS, SEED = 256, 64, 20_240
ROUNDS, RUN, TASK_SLOTS, MOST_TASKS = 24, 4096, 1 << 17, 100_000
WORD = "[^" + WORD_GAP[1:]


def permuted(index: Column, count: Column, *key: Column, back: bool = False) -> Column:
    """``index`` under a keyed permutation of 0 .. count-1: in each round two indices that add up to a round key may swap."""
    def turn(x: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, r), count) - x, count)
        return F.when(F.xxhash64(*key, r, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r).cast("long") for r in rounds]), index.cast("long"), turn)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Sources (source, source_size) with their number in order of code points (null last) and their target of words."""
    numbered = number_rows(sources, [F.col("source").asc_nulls_last()], "source_no")
    weight = F.array(*[F.lit(w) for w in weights])[F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int")]
    rows = written(numbered.withColumn("weight", weight.cast("double")), "mix-sources")
    whole = rows.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    if not whole["n"]:
        return rows.withColumn("target", F.lit(0.0))
    above = lambda level: F.col("weight") * level > F.col("source_size") * most
    level, full = share * whole["n"] / whole["w"], -1
    while True:
        r = rows.agg(F.count_if(above(level)).alias("k"), F.sum(F.when(above(level), F.col("source_size"))).alias("n"),
                     F.sum(F.when(~above(level), F.col("weight"))).alias("w")).first()
        if r["k"] == full or not r["w"]:
            break
        full, level = r["k"], (share * whole["n"] - most * (r["n"] or 0)) / r["w"]
    return rows.withColumn("target", F.least(F.col("weight") * level, F.col("source_size") * float(most)))


def _schedule(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """Sources with what their slots need: blocks, words of the last block, whole passes, slots, and the words of the last slot."""
    size, length = F.col("source_size"), F.lit(block).cast("long")
    s = sources.where(F.col("target") >= 0.5).withColumns({
        "quota": F.floor(F.col("target") + 0.5), "blocks": F.floor((size + length - 1) / length)})
    s = s.withColumns({"tail": size - (F.col("blocks") - 1) * length, "passes": F.floor(F.col("quota") / size)})
    s = s.withColumn("left", F.col("quota") - F.col("passes") * size)
    # where the pass that is not finished meets the short last block
    s = s.withColumn("at", permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("source_no"), F.col("passes"), back=True))
    before = F.col("at") * length
    later = F.col("left") - F.col("tail")
    s = s.withColumns({
        "whole": F.when(F.col("left") <= before, F.floor(F.col("left") / length))
                  .when(F.col("left") < before + F.col("tail"), F.col("at")).otherwise(F.floor(later / length) + 1),
        "part": F.when(F.col("left") <= before, F.col("left") % length)
                 .when(F.col("left") < before + F.col("tail"), F.col("left") - before).otherwise(later % length)})
    return s.withColumn("slots", F.col("passes") * F.col("blocks") + F.col("whole") + (F.col("part") > 0).cast("long"))


def slots(sources: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per slot of the mix: shard, source_no, slot, block_no and ``take``, the words that it takes of the block."""
    plan = written(_schedule(sources, block, seed), "mix-plan")
    many = plan.agg(F.sum("slots").alias("n")).first()["n"] or 0
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / RUN)))
    facts = ["source_no", "blocks", "tail", "slots", "part"]
    runs = plan.where("slots > 0").select(*facts, run.alias("run"))
    runs = runs.repartition(min(1 + many // TASK_SLOTS, MOST_TASKS), "source_no", "run")
    start = F.col("run") * RUN
    end = F.least(F.col("slots"), start + RUN) - 1
    s = runs.select(*facts, F.explode(F.sequence(start, end)).alias("slot"))
    turn, index = F.floor(F.col("slot") / F.col("blocks")), F.pmod("slot", "blocks")
    s = s.withColumn("block_no", permuted(index, F.col("blocks"), F.lit(seed), F.col("source_no"), turn))
    full = F.when(F.col("block_no") == F.col("blocks") - 1, F.col("tail")).otherwise(F.lit(block).cast("long"))
    last = (F.col("slot") == F.col("slots") - 1) & (F.col("part") > 0)
    shard = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), F.col("source_no"), F.col("slot")), F.lit(shards)).cast("int")
    return s.select(shard.alias("shard"), "source_no", "slot", "block_no", F.when(last, F.col("part")).otherwise(full).alias("take"))


def laid_out(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents as (source, doc, size, start, digest): ``doc`` holds the kept columns, ``start`` counts the words before it in its source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("source", F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]).alias("doc"), F.col("doc_id").alias("id"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("digest"))
    order = [F.col("id").asc_nulls_last(), F.col("digest"), F.col("size")]
    laid = running_total(written(rows, "mix-sizes"), ["source"], order, F.col("size"), "end")
    return laid.select("source", "doc", "size", (F.col("end") - F.col("size")).alias("start"))


def mixture(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK, shards: int = SHARDS, seed: int = SEED,
            weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their source's target, slots of the mix, pieces of documents by block).

    A piece says that words ``begin`` to ``begin + n - 1`` of a document are the words from ``at`` on of block ``block_no``.
    """
    laid = written(laid_out(docs, keep), "mix-documents")
    sources = written(targets(laid.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    placed = join_small(laid, sources.select("source", "source_no", "source_size", "target"), ["source"])
    length = F.lit(block).cast("long")
    covered = F.sequence(F.floor(F.col("start") / length), F.floor((F.col("start") + F.col("size") - 1) / length))
    pieces = placed.where("size > 0").select("*", F.explode(covered).alias("block_no"))
    begin = F.greatest(F.col("block_no") * length - F.col("start"), F.lit(0).cast("long"))
    end = F.least(F.col("size"), (F.col("block_no") + 1) * length - F.col("start"))
    pieces = pieces.withColumns({"begin": begin, "n": end - begin, "at": F.col("start") + begin - F.col("block_no") * length})
    return placed, slots(sources, block, shards, seed), pieces


def taken(docs: DataFrame, **how) -> DataFrame:
    """Documents (doc_id, size, source_size, target) with ``taken``, the words of theirs in the mix, repeats counted."""
    ready(docs.sparkSession)
    placed, drawn, pieces = mixture(docs, ("doc_id",), **how)
    used = F.when(F.col("take") > F.col("at"), F.least(F.col("n"), F.col("take") - F.col("at"))).otherwise(F.lit(0))
    # the plan's estimate of the slots is that of the few rows they are made from: without the hint they would be broadcast
    counted = pieces.join(drawn.select("source_no", "block_no", "take").hint("merge"), ["source_no", "block_no"], "left")
    facts = [F.max(c).alias(c) for c in ("doc", "size", "source_size", "target")]
    sums = counted.groupBy("source_no", "start").agg(*facts, F.coalesce(F.sum(used), F.lit(0)).cast("long").alias("taken"))
    empty = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = [F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", "taken"]
    return sums.select(*cols).unionByName(empty.select(*cols))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: (shard, place, source, block_no, n_words, text) of every slot, places pseudo-random within a shard."""
    ready(docs.sparkSession)
    placed, drawn, pieces = mixture(docs, ("text",), **how)
    cut = pieces.select("source", "source_no", "block_no", "at", F.slice(words(F.col("doc.text")), F.col("begin").cast("int") + 1,
                                                                        F.col("n").cast("int")).alias("words"))
    blocks = cut.groupBy("source_no", "block_no").agg(
        F.first("source").alias("source"), F.flatten(F.array_sort(F.collect_list(F.struct("at", "words")))["words"]).alias("words"))
    joined = drawn.hint("merge").join(blocks, ["source_no", "block_no"])
    part = F.slice("words", 1, F.col("take").cast("int"))
    return joined.select("shard", F.xxhash64("shard", "source_no", "slot").alias("place"), "source", "block_no",
                         F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("text"))
