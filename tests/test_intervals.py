"""Intervals: which cover what, against brute force."""

from __future__ import annotations

import random

import pytest

from citelake.operators import sequence


@pytest.mark.parametrize("seed", range(2))
def test_covering_ids_are_those_of_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(120):
        s = rng.randrange(60)
        rows.append((rng.randrange(3), k, s, s + rng.choice([0, 1, 2, 5, 9])))
    df = spark.createDataFrame(rows, "g int, id long, s int, e int").repartition(3)
    want = []
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        points = sorted({p for _, _, s, e in own for p in (s, e)})
        for a, b in zip(points, points[1:]):
            ids = sorted(i for _, i, s, e in own if s <= a and e >= b)
            if ids:
                want.append((g, a, b, ids))
    assert sorted(map(tuple, sequence.covered_segments(df, "g", "s", "e", "id").collect())) == sorted(want)
    merged = sequence.merge_intervals(df, "g", "s", "e", "id").collect()
    assert sorted(i for r in merged for i in r["ids"]) == list(range(120))
    for r in merged:
        inside = sorted(i for g, i, s, e in rows if g == r["g"] and r["s"] <= s and e <= r["e"])
        assert r["ids"] == inside and r["n"] == len(inside)


def test_no_intervals(spark):
    none = spark.createDataFrame([], "g int, id long, s int, e int")
    assert sequence.covered_segments(none, "g", "s", "e", "id").count() == 0
    odd = spark.createDataFrame([(1, 1, 5, 3), (1, 2, None, 4), (None, 3, 1, 2), (1, 4, 7, 7)], "g int, id long, s int, e int")
    assert [tuple(r) for r in sequence.covered_segments(odd, "g", "s", "e", "id").collect()] == [(None, 1, 2, [3])]


def test_covered_segments_are_no_fold_over_an_island(spark):
    """Rows are what the result lists, however long an island is: no array grows point by point."""
    df = spark.createDataFrame([("g", 0, 5, 1), ("g", 5, 9, 2), ("g", 3, 3, 3), (None, 1, 2, 4)], "g string, s int, e int, id long")
    found = sequence.covered_segments(df, "g", "s", "e", "id")
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {("g", 0, 3, (1,)), ("g", 3, 5, (1,)), ("g", 5, 9, (2,)), (None, 1, 2, (4,))}
    assert {(r["g"], r["s"], r["e"], tuple(r["ids"])) for r in found.collect()} == want
