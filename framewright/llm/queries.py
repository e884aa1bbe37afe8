"""The registered queries of this folder: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import (archives, decontaminate, hard_negatives, mixing, near_dup, packing, personal_data, quality_rules,
                             sentence_spans, sharding, token_counts, token_files, whitening)
from framewright.llm.shared import table

BYTE_BPE, WORD_BPE, TOKENS, SHARDS = "byte_bpe_50k.json", "word_bpe_49k.json", 1024, 64


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data(table(spark, folder, "documents")).drop("row")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), TOKENS)


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), size=2, similarity=0.8)


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKENS)


def op7_archives(spark: SparkSession, folder: str) -> DataFrame:
    return archives.round_trip(table(spark, folder, "pages"))


def op8_sharding(spark: SparkSession, folder: str) -> DataFrame:
    names = [f"shard-{i:04d}" for i in range(SHARDS)]
    placed = sharding.place(table(spark, folder, "documents").select("doc_id"), "doc_id", names)
    return placed.select("doc_id", "placed.slot", "placed.shard")


def op9_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_spans.without_repeats(table(spark, folder, "documents"))


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mined(table(spark, folder, "embeddings"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_personal_data, op3_packing, op4_token_files, op5_near_duplicates,
                                   op6_token_counts, op7_archives, op8_sharding, op9_sentence_spans, op10_decontaminate,
                                   op11_hard_negatives, op12_whitening, op13_mixing)}

ORACLE = {
    "op7_archives": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
             d as (select page_id, octet_length(payload) as n, sha256(payload) as digest from p),
             f as (select *, min(page_id) over (partition by digest, n) as first from d)
        select page_id, n::bigint as payload_bytes, digest as payload_digest,
          case when n >= 100 and first <> page_id then 'revisit' else 'response' end as record_type,
          case when n >= 100 and first <> page_id then first end as refers_to
        from f""",
    "op11_hard_negatives": """
        with v as (
          select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            [floor(256 * x::double) for x in embedding] as c
          from embeddings
          where label is not null and embedding is not null
            and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        a as (select * from v where vec_id % 100 = 0),
        s as (
          select a.vec_id as anchor_id, v.vec_id, a.label = v.label as same, list_inner_product(a.c, v.c)::bigint as score
          from a join v on a.vec_id <> v.vec_id),
        p as (
          select anchor_id, vec_id as positive_id, score as positive_score from s where same
          qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
        select p.anchor_id, p.positive_id,
          (row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id))::int as rank,
          s.vec_id as negative_id, p.positive_score, s.score as negative_score
        from p join s on s.anchor_id = p.anchor_id
        where not s.same and 80 * p.positive_score <= 100 * s.score and s.score <= p.positive_score
        qualify rank <= 5""",
}
