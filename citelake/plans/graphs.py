"""Citation graph: ``lineitem`` gives edges, an order citing a part. Every work is a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.operators import graph
from citelake.plans.tables import table
from citelake.registry import register

_E = "e AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")


_COCITED = f"""
    WITH {_E} SELECT m.l_partkey AS source, e.l_partkey, count(*) AS shared FROM e m JOIN e USING (l_orderkey) WHERE m.l_partkey <> e.l_partkey GROUP BY 1, 2 HAVING count(*) >= 2"""
_SHARED = f"""
    WITH {_E}, d AS (SELECT l_orderkey, count(*) AS n FROM e GROUP BY 1),
    x AS (SELECT m.l_orderkey AS source, e.l_orderkey, count(*) AS overlap FROM e m JOIN e USING (l_partkey) WHERE m.l_orderkey <> e.l_orderkey GROUP BY 1, 2)"""
_COUPLED = (
    _SHARED
    + """
    SELECT source, x.l_orderkey, overlap, round(100.0 * overlap / a.n, 2) AS pct, round(overlap / (a.n + b.n - overlap), 6) AS jaccard
    FROM x JOIN d a ON a.l_orderkey = source JOIN d b ON b.l_orderkey = x.l_orderkey"""
)
_RERANKED = (
    _SHARED
    + """,
    c AS (SELECT l_orderkey, CAST(sum(overlap) AS BIGINT) AS shared, max(overlap) AS overlap, max(round(100.0 * overlap / n, 2)) AS pct
          FROM x JOIN (SELECT l_orderkey AS source, n FROM d) USING (source) GROUP BY 1),
    p AS (SELECT * FROM c ORDER BY shared DESC, l_orderkey LIMIT 60)
    SELECT * FROM p ORDER BY pct DESC, overlap DESC, shared DESC, l_orderkey LIMIT 20"""
)


@register(_COCITED)
def co_citation_counts(spark, sf_dir):
    return graph.cocited(_edges(spark, sf_dir), None, "l_orderkey", "l_partkey")


@register(_COUPLED)
def jaccard_overlap(spark, sf_dir):
    return graph.coupled(_edges(spark, sf_dir), None, "l_orderkey", "l_partkey")


@register(_COCITED)
def co_citation_counts_all(spark, sf_dir):
    return co_citation_counts(spark, sf_dir)


@register(_COUPLED)
def jaccard_overlap_all(spark, sf_dir):
    return jaccard_overlap(spark, sf_dir)


@register(
    f"""
    WITH {_E}, own AS (SELECT p_partkey FROM part WHERE p_size <= 25),
    t AS (SELECT * FROM e WHERE l_orderkey IN (SELECT p_partkey FROM own))
    SELECT l_partkey, count(*) AS n FROM t WHERE l_partkey NOT IN (SELECT p_partkey FROM own) GROUP BY 1 HAVING count(*) >= 2
    ORDER BY n DESC, l_partkey LIMIT 10"""
)
def gap_finder(spark, sf_dir):
    own = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return graph.gaps(_edges(spark, sf_dir), own, "l_orderkey", "l_partkey")


@register(
    f"""WITH {_E}, w AS (SELECT p_partkey FROM part WHERE p_size <= 25)
    SELECT * FROM e WHERE l_orderkey IN (SELECT p_partkey FROM w) AND l_partkey IN (SELECT p_partkey FROM w) AND l_orderkey <> l_partkey"""
)
def internal_edges(spark, sf_dir):
    works = table(spark, sf_dir, "part").where("p_size <= 25").select("p_partkey")
    return graph.internal_edges(_edges(spark, sf_dir), works, "l_orderkey", "l_partkey", "p_partkey")


_CLIQUES = """
    WITH k AS (SELECT p_partkey, p_name || '|' || p_brand AS key, 1.0 AS w FROM part UNION ALL SELECT p_partkey, p_type || '|' || p_size, 0.4 FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY key, w ORDER BY p_partkey) AS rn FROM k),
    f AS (SELECT * FROM r WHERE rn <= 40),
    p AS (SELECT x.p_partkey AS a, y.p_partkey AS b, x.w, count(*) * x.w AS weight FROM f x JOIN f y ON x.key = y.key AND x.w = y.w AND x.p_partkey < y.p_partkey GROUP BY 1, 2, 3)"""


@register(_CLIQUES + " SELECT a, b, CAST(round(sum(weight), 6) AS DOUBLE) AS weight FROM p GROUP BY 1, 2 ORDER BY weight DESC, a, b LIMIT 4000")
def clique_edges(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    by_name = graph.attribute_edges(parts, "p_partkey", F.concat_ws("|", "p_name", "p_brand"), 1.0)
    by_type = graph.attribute_edges(parts, "p_partkey", F.concat_ws("|", "p_type", "p_size"), 0.4)
    edges = by_name.union(by_type).groupBy("a", "b").agg(F.round(F.sum("weight"), 6).alias("weight"))
    return graph.cull_edges(edges, 4000)


@register(_RERANKED)
def reranked_candidates(spark, sf_dir):
    return graph.reranked(_edges(spark, sf_dir), 20, "l_orderkey", "l_partkey")


@register(_RERANKED)
def reranked_candidates_all(spark, sf_dir):
    return reranked_candidates(spark, sf_dir)
