"""Language-model scoring where some keys are in every block of a long corpus."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelake.llm import lm_scoring

SCHEMA = "doc_id long, text string"


def corpus_of(spark, n):
    """Texts of the same frequent words and pairs, and of rare ones of their own."""
    rng = random.Random(1)
    rows = [(k, " ".join(["of the and of the"] * 4 + [f"w{rng.randrange(20 * n)}" for _ in range(15)])) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def bucket_entries(spark, docs, hot):
    """Entries of the fullest bucket, and blocks, where a batch of eight rows makes a block."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        rows = docs.select("doc_id", "text", lm_scoring._part("doc_id").cast("int").alias("part"))
        schema = "block long, part int, ids array<long>, lens array<long>, uniq binary, tokens binary, n_tokens long"
        blocks = rows.mapInArrow(lambda batches: lm_scoring._encode(batches, 100), schema).cache()
        n = blocks.count()
        found = lm_scoring.find_hot(blocks, n) if hot else lm_scoring.Hot([np.zeros(0, np.uint64)] * 2)
        buckets = max(1, rows.count() // 100)
        sent = blocks.mapInArrow(lambda batches: lm_scoring._send(batches, buckets, found), lm_scoring._SENT)
        sums = sent.groupBy("bucket", "kind").agg(F.sum(F.length("keys") / 8).alias("n"))
        return sums.agg(F.max("n")).first()[0], n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_buckets_stay_as_full_as_they_are_however_many_blocks(spark):
    few, n_few = bucket_entries(spark, corpus_of(spark, 1000), True)
    many, n_many = bucket_entries(spark, corpus_of(spark, 6000), True)
    unsplit, _ = bucket_entries(spark, corpus_of(spark, 6000), False)
    assert n_many > 4 * n_few > 200
    assert many < 1.5 * few and unsplit > 2 * many


@pytest.mark.parametrize("share", [8, 10**9])
def test_scores_are_the_same_with_and_without_hot_keys(spark, monkeypatch, share):
    docs = corpus_of(spark, 300)
    monkeypatch.setattr(lm_scoring, "_HOT_SHARE", 10**9)
    monkeypatch.setattr(lm_scoring, "_SAMPLE_BLOCKS", 0)
    plain = {r["doc_id"]: r for r in lm_scoring.score(docs, block_tokens=200).collect()}
    monkeypatch.setattr(lm_scoring, "_HOT_SHARE", share)
    monkeypatch.setattr(lm_scoring, "_SAMPLE_BLOCKS", 64)
    for r in lm_scoring.score(docs, block_tokens=200).collect():
        p = plain[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (p["n_tokens"], p["n_known"], p["train_tokens"])
        assert abs(r["score"] - p["score"]) < 1e-9 and abs(r["base_score"] - p["base_score"]) < 1e-9
