"""What meets is bounded: repeated keys, repeated titles, tables that look small."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from citelake.functions import text
from citelake.operators import caches, citations, matching


def test_cached_entries_are_those_of_comparing_all(spark):
    rng = random.Random(4)
    title, years, dois = ["A study of red bolts", "a Study of: red bolts!", "short"], [None, 2000, 2001, 2002, 2003], [None, "10.1/a", "10.1/A", "10.1/b", ""]
    refs = [(k, rng.choice(title), rng.choice(["lee", "kim", "", None]), rng.choice(years), rng.choice(dois)) for k in range(150)]
    cache = [(k, rng.choice(title), rng.choice(["lee", "kim", "", None]), rng.choice(years), rng.choice(dois), rng.choice([None, "x"]), rng.choice(["verified", "error", None])) for k in range(60)]
    want = {}
    for r, t, who, year, doi in refs:
        scored = []
        for e, u, whose, found, other, arxiv, status in cache:
            if t == "short" or u == "short" or not who or who != whose or (doi is not None and other is not None and doi.lower() != other.lower()):
                continue
            if (year is None) != (found is None) and other is None and arxiv is None:
                continue
            gap = None if year is None or found is None else abs(year - found)
            if gap is None or gap <= 1:
                scored.append((-(1 + (0 if gap is None else 2 - gap) + (status == "verified")), e))
        if scored:
            want[r] = (min(scored)[1], -min(scored)[0])
    a = spark.createDataFrame(refs, "ref long, title string, surname string, year int, doi string")
    b = spark.createDataFrame(cache, "entry long, title string, surname string, year int, doi string, arxiv string, status string")
    found = caches.fuzzy_cached(a, b, "ref", "entry")
    assert {r["ref"]: (r["entry"], r["score"]) for r in found.collect()} == want and len(want) > 30
    # one entry of those that can't be told apart: grouped before the two sides meet
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate", plan.index("Join"))


def test_a_reference_meets_one_corpus_row_of_a_key(spark):
    refs, corpus = spark.range(100).withColumn("k", F.lit("same")), spark.range(1000).select(F.col("id").alias("w"), F.lit("same").alias("k"))
    found = matching.key_cascade(refs, "id", corpus, "w", [F.col("k")], [F.col("k")])
    assert {tuple(r) for r in found.collect()} == {(k, 0, 0) for k in range(100)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate", plan.index("Join"))


def test_years_are_not_met_through_the_driver(spark, tmp_path):
    spark.range(50).selectExpr("id as own", "id as work", "'b' as block", "cast(id % 9 as int) as year").write.parquet(str(tmp_path / "works"))
    works = spark.read.parquet(str(tmp_path / "works"))
    found = matching.best_within_years(works, works, "own", "work", "block", "year")
    assert found.count() == 50
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_index_is_made_in_the_row(spark):
    words = [["b", "a", "b", "é", "A", "b"], ["x"], ["w"] * 500 + ["v"]]
    rows = spark.createDataFrame([(w,) for w in words], "w array<string>").select("w", text.inverted_index(F.col("w")).alias("i"))
    for r in rows.collect():
        want = {}
        for k, w in enumerate(r["w"]):
            want.setdefault(w, []).append(k)
        assert r["i"] == want
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_dense_numbers_stay_with_their_document(spark):
    rows = [("x", 7, 3), ("x", 5, 1), ("x", 7, 0), ("x", 9, 1), ("y", 2, 4), ("y", None, 1), (None, 1, 1)]
    marks = spark.createDataFrame(rows, "d string, number int, at int").repartition(5, "d")
    found = citations.dense_numbers(marks, "d")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["d"], r["number"], r["new_number"]) for r in found.collect()} == {("x", 7, 1), ("x", 5, 2), ("x", 9, 3), ("y", 2, 1)}
