from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citelake.functions import scoring, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("title", "key"),
    [
        ("<i>l</i><sub>2</sub> Norms", "l2norms"),
        ("Review: BERT: Pre-training", "pretraining"),
        (r"\textbf{Schr{\"o}dinger} équation", "schrodingerequation"),
        ("", ""),
        (None, None),
    ],
)
def test_title_key_full(spark, title, key):
    assert one(spark, text.title_key_full(F.lit(title).cast("string"))) == key


@pytest.mark.parametrize(
    ("a", "b", "least", "most"),
    [
        ("Attention Is All You Need", "attention is all you need, 2017", 1.0, 1.0),
        ("Multi-modal learning", "multimodal learning", 1.0, 1.0),
        ("Deep Learning", "Deep Learning Second Edition", 1.0, 1.0),
        ("Rust programming", "Rust programming language for systems", 0.7, 0.7),
        ("Graph networks for molecules", "Cooking with garlic", 0.0, 0.1),
        ("", "x", 0.0, 0.0),
    ],
)
def test_title_similarity(spark, a, b, least, most):
    assert least <= one(spark, text.title_similarity(F.lit(a), F.lit(b))) <= most


@pytest.mark.parametrize(
    ("doi", "want"),
    [
        ("https://doi.org/10.1000/ABC.1#s", "10.1000/abc.1"),
        ("doi: 10.1000/x.", "10.1000/x"),
        ("not a doi", None),
        (None, None),
    ],
)
def test_normalize_doi(spark, doi, want):
    assert one(spark, text.normalize_doi(F.lit(doi).cast("string"))) == want


def test_doi_prefix_agreement(spark):
    assert one(spark, text.dois_agree(F.lit("10.1000/abc"), F.lit("10.1000/abc.v2")))
    assert not one(spark, text.dois_agree(F.lit("10.1000/abc"), F.lit("10.1000/abcd")))


def test_authors(spark):
    assert one(spark, text.same_author(F.lit("Émile Borel"), F.lit("Borel, E.")))
    assert one(spark, text.same_author(F.lit("Borel"), F.lit("Borel, E.")))
    assert not one(spark, text.same_author(F.lit("Max Born"), F.lit("Borel, E.")))
    cited, found = F.array(F.lit("A Xu"), F.lit("B Yi")), F.array(F.lit("Xu, A."), F.lit("C Zhu"))
    assert one(spark, text.author_overlap(cited, found)) is None  # one of two says nothing
    three = F.array(F.lit("A Xu"), F.lit("B Yi"), F.lit("C Zhu"))
    assert one(spark, text.author_overlap(three, found)) == 2 / 3


def test_markers(spark):
    assert one(spark, text.expand_marker(F.lit("[2, 5–7; 9-8]"))) == [2, 5, 6, 7]


def test_health(spark):
    args = [F.lit(x) for x in (10, 9, 1, 2, 0)]
    assert one(spark, scoring.health_score(*args)) == 89
    assert one(spark, scoring.health_score(*[F.lit(0)] * 5)) is None


def test_identity_keys(spark):
    none = F.lit(None).cast("string")
    no_year = F.lit(None).cast("int")
    authors = F.array(F.lit("Ada Lovelace"))
    key = lambda t, y, d=none, a=none: one(spark, scoring.identity_key(F.lit(t).cast("string"), authors, y, d, a))
    assert key("Any", F.lit(2000), F.lit("10.1000/X1")) == "doi:10.1000/x1"
    assert key("Any", F.lit(2000), none, F.lit("arXiv:1706.03762v2")) == "arxiv:1706.03762"
    assert key("Some Title!", F.lit(2001)) == "title:some title:2001"
    assert key("A long enough title", no_year) == "title:a long enough title:_:lovelace"
    assert key("Short", no_year).startswith("hash:")


def test_combined_bands(spark):
    bands = lambda *b: one(spark, scoring.combine_bands(F.array(*map(F.lit, b))))
    assert bands("high", "medium") == "medium"
    assert bands("high", "odd") == "inconclusive"


def test_classify_order(spark):
    schema = "array<struct<severity:string,type:string,details:string>>"
    status = lambda js: one(spark, scoring.classify(F.from_json(F.lit(js), schema)))
    assert status('[{"severity":"error","type":"unverified","details":""}]') == "unverified"
    assert status('[{"severity":"error","type":"unverified","details":""},{"severity":"error","type":"url","details":"URL references paper"}]') == "verified"
    assert status('[{"severity":"warning","type":"year","details":""},{"severity":"error","type":"title","details":""}]') == "error"
    assert status("[]") == "verified"


@pytest.mark.parametrize(
    ("a", "b", "differ"),
    [
        ("Proc. Natl. Acad. Sci.", "Proceedings of the National Academy of Science", False),
        ("Journal of Machine Learning Research", "JMLR", False),
        ("arXiv preprint", "Nature", False),
        ("Nature", "Cell", True),
        (None, "Cell", False),
        ("NeurIPS 2020", "NeurIPS", False),
    ],
)
def test_venues(spark, a, b, differ):
    from citelake.functions.names import venues_differ

    assert one(spark, venues_differ(F.lit(a).cast("string"), F.lit(b))) is differ


def test_word_diff(spark):
    from citelake.functions.names import word_diff

    df = spark.createDataFrame([(1, "a b c d", "a x c"), (2, None, "n"), (3, "", "")], "id int, a string, b string")
    rows = [tuple(r) for r in word_diff(df, "id", "a", "b").orderBy("id", "n").collect()]
    assert rows == [(1, 0, "eq", "a"), (1, 1, "add", "x"), (1, 2, "del", "b"), (1, 3, "eq", "c"), (1, 4, "del", "d"), (2, 0, "add", "n")]


def test_citation_audit(spark):
    from citelake.operators import citations

    docs = spark.createDataFrame([(1, "a [2] b [1] c [3-5] d [9] [1]"), (2, "x [1]")], "d int, t string")
    refs = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4, 4, 5, 7)] + [(2, 1)], "d int, n int")
    marks = citations.markers(docs, "d", F.col("t"))
    row = {r["d"]: r for r in citations.audit(marks, refs, "d", "n").collect()}
    assert row[1]["undefined"] == [9] and row[1]["duplicate"] == [4] and row[1]["gap"] == [6]
    assert row[1]["uncited"] == [7] and row[1]["out_of_order"] == [1] and not row[1]["abstains"] and row[2]["abstains"]
    dense = citations.dense_numbers(marks.where("d = 1"), "d").select("number", "new_number").distinct().collect()
    assert dict(map(tuple, dense)) == {2: 1, 1: 2, 3: 3, 4: 4, 5: 5, 9: 6}
    found = citations.contexts(docs, "d", F.col("t"), 4).where("number = 9").first()["context"]
    assert found == "5] d [9] [1]"[3:8] + " " or "[9]" in found


def test_result_buckets(spark):
    from citelake.operators import results

    schema = "c int, i int, s int, fab boolean, issues array<struct<severity: string, type: string, details: string>>"
    err, warn, unv = ("error", "title", ""), ("warning", "year", ""), ("error", "unverified", "")
    rows = [(1, 0, 0, False, [err]), (1, 0, 1, False, [warn]), (1, 1, 0, True, [err]), (1, 2, 0, False, [unv]), (1, 3, 0, False, None)]
    row = results.buckets(spark.createDataFrame(rows, schema), "c", "i", "s", "issues", "fab").first()
    assert (row["total"], row["n_warning"], row["n_hallucination"], row["n_unverified"], row["n_verified"], row["errors"], row["warnings"]) == (4, 1, 1, 1, 1, 0, 1)
    old = spark.createDataFrame([(1, "verified"), (2, "pending"), (3, "error")], "k int, st string")
    new = spark.createDataFrame([(1, "pending"), (2, "error")], "k int, st string")
    assert sorted(map(tuple, results.merge_progress(old, new, "k", "st").collect())) == [(1, "verified"), (2, "error"), (3, "error")]
