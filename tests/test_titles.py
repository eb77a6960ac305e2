"""Titles and records: cases with their answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citelake.functions import records, titles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cited", "found", "same"),
    [
        ("A torn discoid lateral meniscus impacts alignment: surgical treatment", "A Torn Discoid Lateral Meniscus Impacts Alignment", True),
        ("The adaptive change of meniscus plasty: an observational study", "The adaptive change of meniscus plasty", True),
        ("Cox proportional hazards regression model. Regression modeling strategies", "Regression Modeling Strategies: With Applications", True),
        ("Short title: one", "Short title: other", False),
        ("A short title: one", "A short title: other", True),
        ("Discoid meniscus", "Identifying younger women at risk", False),
        ("", "", False),
        (None, "A title", False),
    ],
)
def test_titles_align_up_to_a_subtitle(spark, cited, found, same):
    lit = [F.lit(t).cast("string") for t in (cited, found)]
    assert one(spark, titles.titles_align(*lit)) is same
    if same:
        assert one(spark, titles.clean_title_similarity(*lit)) == 1.0


@pytest.mark.parametrize(
    ("broken", "whole"),
    [
        ("R ´enyi divergence", "Renyi divergence"),
        ("V oicebox and VQ-V AE", "Voicebox and VQ-VAE"),
        ("c ^2m^3 merging", "c^2m^3 merging"),
        ("rates forβ-mixing", "rates for beta -mixing"),
        ("a cat and I", "a cat and I"),
    ],
)
def test_fragments_join(spark, broken, whole):
    assert one(spark, titles.join_fragments(F.lit(broken))) == whole


def test_cleaning(spark):
    assert one(spark, titles.clean_title(F.lit('"jailbreak- ing  models" (2023) [J]'))) == 'jailbreaking models"'
    assert one(spark, titles.clean_title(F.lit(None).cast("string"))) == ""
    assert one(spark, titles.without_meeting(F.lit("Trees (ICML Workshop on X) grow. In Proceedings of Y"))) == "Trees grow."
    assert one(spark, titles.without_year(F.lit("1999. A study (2001) of 2020"))) == "A study of"


def test_spaces_lost(spark):
    assert one(spark, titles.spaces_lost(F.lit("Attentionisallyouneed"), F.lit("Attention is all you need")))
    assert not one(spark, titles.spaces_lost(F.lit("Attention is all"), F.lit("Attention is all you need")))


def test_pages(spark):
    none = F.lit(None).cast("string")
    assert one(spark, titles.page_is_about(F.lit("Spark user guide"), F.lit("A guide to other things"), F.lit("api of x"))) is True
    assert one(spark, titles.page_is_about(F.lit("Quantum field theory basics"), F.lit("Cooking for many people"), none)) is False
    assert one(spark, titles.terms_covered(F.lit("deep learning theory"), F.lit("All about learning theory"))) is True


def test_records(spark):
    assert one(spark, records.clean_unicode(F.lit("cafÃ©\x07 naïve\t日本"))) == "café naïve\t日本"
    assert one(spark, records.clean_unicode(F.lit("cafÃ©\x07"))) == "café"
    assert one(spark, records.json_or(F.lit('{"a": 1}'), "map<string,int>", F.create_map().cast("map<string,int>"))) == {"a": 1}
    assert one(spark, records.json_or(F.lit("{"), "map<string,int>", F.create_map().cast("map<string,int>"))) == {}
    assert one(spark, records.timestamp_of(F.lit("2024-02-30 00:00:00"))) is None
    import hashlib
    import hmac

    for secret in (b"k", b"long " * 30):
        want = hmac.new(secret, "x@y".encode(), hashlib.sha256).hexdigest()[:32]
        assert one(spark, records.keyed_hash(F.lit(" x@y "), secret)) == want
    assert one(spark, records.keyed_hash(F.lit("  "), b"k")) is None


def test_passages_of_any_length(spark):
    from citelake.operators.passages import holders

    docs = [(1, "one two three four five six seven eight nine"), (2, "xtwo three fourth"), (3, "a\nb"), (4, None), (5, "")]
    items = [(1, "two three four"), (2, "four five six seven eight nine"), (3, "hree"), (4, "e t"), (5, ""), (6, None), (7, "three four five six seven eight ni"), (8, "b"), (9, "two three")]
    found = holders(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item string"))
    want = {(i, d) for i, item in items for d, t in docs if item is not None and t is not None and item in t}
    assert set(map(tuple, found.collect())) == want
    empty = holders(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, item string"))
    assert empty.count() == 0
