from __future__ import annotations

import random
from collections import Counter, defaultdict

from citelake.operators import graph
from citelake.plans import graphs


def test_every_work_is_a_source(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    edges = [(o, p) for o in range(40) for p in {0, *rng.choices(range(1, 25), k=5)}]  # all cite part 0
    lines = spark.createDataFrame(edges + edges[:30], "l_orderkey long, l_partkey long")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(graph, "BLOCK", 7)
    cites, cited = defaultdict(set), defaultdict(set)
    for o, p in edges:
        cites[o].add(p)
        cited[p].add(o)
    together = {(a, b, len(cited[a] & cited[b])) for a in cited for b in cited if a != b}
    got = graphs.co_citation_counts_all(spark, str(tmp_path)).select("source", "l_partkey", "shared")
    assert Counter(map(tuple, got.collect())) == Counter(t for t in together if t[2] >= 2)
    overlap = {(a, b): len(cites[a] & cites[b]) for a in cites for b in cites if a != b}
    got = graphs.jaccard_overlap_all(spark, str(tmp_path)).collect()
    assert len(got) == len(overlap)  # part 0 is in all
    for r in got:
        a, b, n = r["source"], r["l_orderkey"], overlap[r["source"], r["l_orderkey"]]
        assert r["overlap"] == n and abs(r["pct"] - 100 * n / len(cites[a])) < 0.006
        assert abs(r["jaccard"] - n / len(cites[a] | cites[b])) < 1e-6
    shared = Counter()
    for (_, b), n in overlap.items():
        shared[b] += n
    pct = {b: max(r["pct"] for r in got if r["l_orderkey"] == b) for b in cites}
    most = {b: max(n for (_, c), n in overlap.items() if c == b) for b in cites}
    want = sorted(cites, key=lambda b: (-pct[b], -most[b], -shared[b], b))[:20]
    assert [r["l_orderkey"] for r in graphs.reranked_candidates_all(spark, str(tmp_path)).collect()] == want


def test_pairs_are_counted_where_they_come_up(spark, monkeypatch):
    """Lists move, pairs don't: nothing is exchanged above what makes pairs of lists."""
    monkeypatch.setattr(graph, "BLOCK", 3)
    rng = random.Random(5)
    rows = [(o, p) for o in range(30) for p in {0, *rng.choices(range(1, 9), k=3)}]
    edges = spark.createDataFrame(rows, "o long, p long")
    some = spark.createDataFrame([(1,), (7,)], "o long")
    cites = {o: {p for x, p in rows if x == o} for o in range(30)}
    for sources, asked in ((None, range(30)), (some, (1, 7))):
        found = graph.coupled(edges, sources, "o", "p")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.index("arrays_zip") < plan.index("Exchange")
        got = {(r["source"], r["o"]): r["overlap"] for r in found.collect()}
        assert got == {(a, b): len(cites[a] & cites[b]) for a in asked for b in cites if a != b}
    plan = graph.reranked(edges, 2, "o", "p")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "arrays_zip" not in plan
