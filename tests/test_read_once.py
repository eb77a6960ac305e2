"""Texts and lists of references meet in one row: nothing else is moved or written."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.operators import markers


def test_documents_dealt_by_their_key_are_not_moved_again(spark):
    docs = spark.createDataFrame([(1, "a [1] b [2] c [3]"), (2, "As [Knu97] and [Gra81] and [Cod70] say.")], "d int, text string").repartition(5, "d")
    rows = [(1, k, [f"Ann {n}"], 1990) for k, n in enumerate(("Ek", "Poe", "Lee"), 1)] + [(2, k, [n], y) for k, (n, y) in enumerate((("Knuth", 1997), ("Gray", 1981), ("Codd", 1970)), 1)]
    refs = spark.createDataFrame(rows, "d int, number int, authors array<string>, year int").repartition(5, "d")
    named = (docs, refs, "d", "text", "number", "authors", "year")
    found = {
        "audit": markers.audit(*named),
        "resolved": markers.resolved(*named),
        "renumbered": markers.renumbered(docs.withColumn("at", F.lit(2)), refs, "d", "text", "number", "at"),
    }
    for name, df in found.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and "Scan parquet" not in plan, name
        # a text is searched once
        assert plan.count(markers.FORMS["bracket"][:20]) <= 1, name
    assert sorted(map(tuple, found["resolved"].select("d", "number").collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]


def test_numbers_of_any_size_and_a_heading_at_the_start(spark):
    docs = spark.createDataFrame([(1, "a [1] b [2] c [3] d [4]\n\nREFERENCES :\n[9] x"), (2, "References\n[1] a [2] b [3] c")], "d int, text string")
    refs = spark.createDataFrame([(d, n, ["Ann Ek"], 1990) for d in (1, 2) for n in (1, 2, 3, 3_000_000_000)], "d int, number long, authors array<string>, year int")
    got = {r["d"]: r for r in markers.audit(docs, refs, "d", "text", "number", "authors", "year").collect()}
    assert (got[1]["style"], got[1]["undefined"], got[1]["uncited"]) == ("bracket", ["4"], ["3000000000"])
    assert got[2]["style"] is None and got[2]["abstains"]
