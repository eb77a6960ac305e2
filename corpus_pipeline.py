"""A training corpus from ``documents``: quality rules, near-duplicates, secrets, packing."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.llm import jaccard_join, packing, quality_rules, secret_scan
from citelake.llm.common import discard
from citelake.storage import only, ship_package

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; lines above the limit leave the others, but stay in
    their first document, so that one copy of a group is there for the next stage. A text
    isn't bad for being short: those without any word go, and packing takes the others."""
    kept = quality_rules.keep_good(docs.select(*COLUMNS), min_words=1, keep_first=True, by_text=True)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, that of the smallest id; texts link by four
    fifths of their 5-word shingles."""
    ship_package(spark)
    return jaccard_join.keep_one(docs, width=5, num=80, den=100).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets give way to a mark."""
    found = secret_scan.scan_columns(docs, COLUMNS)
    text = secret_scan.redact(F.col("text"), F.col("spans"))
    clean = found.withColumn("text", text).drop("spans")
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", pack),
]

#: BPE and packing have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = only(spark, functools.partial(stage, spark, docs, sf_dir), name)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
