"""Records: cases with their answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citelake.functions import records, text, titles


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("dirty", "clean"),
    [
        ("cafe\u0301", "café"),
        ("caf\u00c3\u00a9 and naïve", "café and naïve"),
        ("日本 caf\u00c3\u00a9 o\u0308", "日本 café ö"),
        ("Ã alone, Â too", "Ã alone, Â too"),
        ("a\x00b\x1f\tc\n", "ab\tc\n"),
        ("q\u0307 has no composed form", "q\u0307 has no composed form"),
        ("", ""),
        (None, None),
    ],
)
def test_clean_unicode(spark, dirty, clean):
    assert one(spark, records.clean_unicode(F.lit(dirty).cast("string"))) == clean


def test_nulls_go_at_every_depth(spark):
    kind = "map<string,map<string,array<struct<a:array<int>,b:int>>>>"
    value = {"x": {"y": [(([1, None]), None), None], "z": None}, "w": None}
    df = spark.createDataFrame([(value,), (None,)], f"v {kind}")
    got = [r["v"] for r in df.select(records.without_nulls(F.col("v"), kind).alias("v")).collect()]
    assert got[1] is None and set(got[0]) == {"x"} and set(got[0]["x"]) == {"y"}
    assert [(r["a"], r["b"]) for r in got[0]["x"]["y"]] == [([1], None)]


@pytest.mark.parametrize(
    ("given", "found"),
    [
        ("https://arxiv.org/abs/2101.00001v3", "2101.00001"),
        ("2101.00001", "2101.00001"),
        ("10.48550/arXiv.2101.00001", "2101.00001"),
        ("10.1016/1234.56789", None),
        ("arXiv:math.GT/0309136", "math.gt/0309136"),
        ("pages 1234.5678 of a book", None),
        (None, None),
    ],
)
def test_arxiv_ids(spark, given, found):
    assert one(spark, text.arxiv_id(F.lit(given).cast("string"))) == found


def test_titles_lose_addresses(spark):
    assert one(spark, titles.clean_title(F.lit("A study https://x.org/a.pdf"))) == "A study"
    assert one(spark, titles.clean_title(F.lit("A study (http://x.org) of things."))) == "A study of things"
