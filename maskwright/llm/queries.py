"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, conversations, decontaminate, lm_score, packing, quality, records, sharding, simhash, token_counts, topk, toxicity, warc
from ..session import shared_folder
from .common import table

SHARDS = 24


def op1_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.scores(table(spark, folder, "documents"), order=3)


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"), "doc_id", "text", words=3, distance=2)
    return found.withColumn("fingerprint", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")))


def op3_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", every=20, k=20)


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def _rehearsed_fault(page: int | None, data: bytes) -> bytes:
    """Every 101st page's record gets one byte changed in the copy."""
    if page is None or page % 101 != 7:
        return data
    at = len(data) // 2
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def op5_warc_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as WARC volumes, a replica with rehearsed faults, and the audit that finds them."""
    first, second = shared_folder(spark, "warc"), shared_folder(spark, "warc-copy")
    index = warc.write(table(spark, folder, "pages"), first)
    warc.replicate(index, first, second, _rehearsed_fault)
    found = warc.audit(warc.leaves(index, first), warc.leaves(index, second))
    return found.select("page_id", "fault")


def op6_record_files(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the record files and their index, and reads the files back."""
    path = shared_folder(spark, "records")
    records.write(table(spark, folder, "documents"), "doc_id", "text", path)
    return records.read(spark, path)


def op7_token_attribution(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document, from one encoding of the whole text."""
    return token_counts.counts(table(spark, folder, "documents"), rule="first")


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), "doc_id", "text")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_jump_sharding(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.placed(table(spark, folder, "documents"), "doc_id", "text", SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op11_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.classified(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Damaged conversations, their faults, the cheapest repair and the digest of the repaired rows."""
    original = table(spark, folder, "conversations")
    repair = conversations.Repair(conversations.damaged(original))
    report = repair.report().withColumnRenamed("conv_id", "_found")
    digests = conversations.digests(repair.repaired()).withColumnRenamed("conv_id", "_hashed")
    every = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("_found")), "left")
    out = out.join(digests, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(table(spark, folder, "documents"), "doc_id", "text")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_simhash, op3_exact_topk, op4_decontamination, op5_warc_audit, op6_record_files, op7_token_attribution, op8_best_fit_packing, op9_quality, op10_jump_sharding, op11_toxicity, op12_conversation_repair, op13_token_alignment, pipeline)}
CHECKS: dict[str, str] = {
    "op5_warc_audit": "select page_id, 'changed' as fault from pages where page_id % 101 = 7",
    "op3_exact_topk": """
        with v as (
            select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                   list_inner_product(q.v::double[], c.v::double[])::bigint as score
            from v q join v c on c.vec_id <> q.vec_id and len(c.v) = len(q.v)
            where q.vec_id % 20 = 0
        )
        select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank,
               vec_id, score
        from scored
        qualify rank <= 20
    """,
}
if corpus_pipeline.ORACLE_SQL is not None:
    CHECKS["pipeline"] = corpus_pipeline.ORACLE_SQL
