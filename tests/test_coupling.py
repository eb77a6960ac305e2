"""Coupling of every work with every other one: wide works, missing ends, what is moved."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from citelake.operators import graph


def brute(rows):
    cites, n = defaultdict(set), Counter()
    for o, p in set(rows):
        if o is not None:
            n[o] += 1
            cites[o] |= {p} - {None}
    return {(a, b, len(cites[a] & cites[b]), n[a], n[b]) for a in cites for b in cites if a != b and cites[a] & cites[b]}


@pytest.mark.parametrize("wide", [1, 4, 64])
def test_wide_works_missing_ends_and_repeated_edges(spark, monkeypatch, wide):
    monkeypatch.setattr(graph, "BLOCK", 3)
    monkeypatch.setattr(graph, "WIDE", wide)
    rng = random.Random(3)
    rows = [(o, p) for o in range(24) for p in rng.sample(range(12), rng.choice((1, 2, 4, 9)))]
    rows += [*rows[:20], (1, None), (2, None), (2, None), (None, 3), (None, None)]
    got = graph.coupled(spark.createDataFrame(rows, "o long, p long"), None, "o", "p").collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert {(r["source"], r["o"], r["overlap"], r["pct"], r["jaccard"]) for r in got} == {(a, b, n, round(100 * n / da + 1e-9, 2), round(n / (da + db - n) + 1e-12, 6)) for a, b, n, da, db in want}


def test_bibliographies_move_not_lists_of_citing_works(spark, tmp_path):
    """Works of two references each, 300 that cite one work: an edge moves with one reference
    more, and nothing is moved to the citing works."""
    rows = [(o, p) for o in range(300) for p in (0, 1 + o)]
    spark.createDataFrame(rows, "o long, p long").write.parquet(str(tmp_path / "e"))
    found = graph.coupled(spark.read.parquet(str(tmp_path / "e")), None, "o", "p")
    assert len(found.collect()) == 300 * 299
    plan = found._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert "hashpartitioning(source" not in plan
