"""Issues that a style explains, and those that stay."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citelake.functions import styles

SAME = [
    ("title", "Déjà vu: a {\\em study}", "Deja Vu - A Study"),
    ("year", "(2019)", "2019"),
    ("venue", "J Bone Joint Surg", "Journal of Bone and Joint Surgery"),
    ("doi", "https://doi.org/10.1234/AB", "10.1234/ab"),
    ("pages", "pp. 012--19", "12-19"),
    ("authors", "Smith J, Lee A", "John Smith; Ann Lee; Bo Chen"),
]
OTHER = [
    ("title", "A study of cats", "A study of dogs"),
    ("year", "2019", "2020"),
    ("venue", "arXiv", "Nature"),
    ("doi", "10.1234/ab", "10.1234/ac"),
    ("pages", "12-19", "12-20"),
    ("authors", "Jane Doe", "John Smith; Ann Lee"),
    ("unknown", "a", "a"),
    ("title", None, "a"),
    (None, "a", "a"),
]


def _left(spark, issues, style):
    shape = "issues array<struct<kind:string,cited:string,actual:string,n_cited:int,n_actual:int>>, style string"
    df = spark.createDataFrame([([(*i, *([None] * (5 - len(i)))) for i in issues], style)], shape)
    return [i["kind"] for i in df.select(styles.issues_for_style(F.col("issues"), F.col("style")).alias("i")).first()["i"]]


def test_only_differences_of_content_stay(spark):
    assert _left(spark, SAME + OTHER, None) == [k for k, *_ in OTHER]


@pytest.mark.parametrize(("style", "stays"), [("mla", False), ("chicago", True), ("bibtex", True), ("apa", True), (None, True)])
def test_a_short_list_of_authors_is_right_in_some_styles(spark, style, stays):
    issue = ("author_count", None, None, 1, 3)
    assert bool(_left(spark, [issue], style)) == stays


def test_no_issues(spark):
    df = spark.sql("select cast(null as array<struct<kind:string,cited:string,actual:string,n_cited:int,n_actual:int>>) i")
    assert df.select(styles.issues_for_style(F.col("i"), F.lit("mla")).alias("i")).first()["i"] is None
