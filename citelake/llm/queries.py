"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm import (
    bpe,
    chat_format,
    divergence,
    hard_negatives,
    jaccard_join,
    lm_scoring,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    sharding,
    token_counts,
    topk,
)

PIECES, WORD_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.read_pieces(PIECES)
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), pieces)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    spans = F.col("spans")

    def of(*kinds):
        return F.filter(spans, lambda s: s["kind"].isin(*kinds))

    base = of(*[r.kind for r in secret_scan.BASE_RULES])
    return found.select(
        "doc_id",
        *[F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in secret_scan.BASE_RULES],
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(spans).alias("spans"),
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(_read(spark, sf_dir, "documents"), SHARDS, "doc_id")
    return placed.select("doc_id", "slot", "shard")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_read(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(_read(spark, sf_dir, "documents"), WORD_BPE)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    more = [
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), said.alias("text"))
        for k, r in enumerate(("user", "assistant"))
    ]
    rows = rows.union(spark.range(1).select(F.inline(F.array(*more))))
    chats = chat_format.format_chat(chat_format.gather_turns(rows))
    turns = chat_format.read_back(F.col("formatted"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_mask"))
    read = chats.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.array_join(lines, "").alias("turns"), loss.alias("loss"), "formatted")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), WORD_BPE)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_read(spark, sf_dir, "documents"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_sharding": op4_sharding,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_bpe": op7_bpe,
    "op8_chat_format": op8_chat_format,
    "op9_packing": op9_packing,
    "op10_topk": op10_topk,
    "op11_source_divergence": op11_source_divergence,
    "op12_source_mixing": op12_source_mixing,
    "op13_hard_negatives": op13_hard_negatives,
}
