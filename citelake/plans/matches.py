"""Matching: ``part`` plays cited works and venues, ``benchmark`` a verified corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import scoring, text
from citelake.operators import deltas, matching, rollup, similarity
from citelake.plans.tables import table
from citelake.registry import register

_K = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_C = "regexp_replace(lower({0}), '[^a-z0-9]', '', 'g')"
_FULL = (
    "regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({0}, '<[^>]+>', '', 'g')), "
    "'^(" + "|".join(text.TITLE_LABELS) + r")\s*', ''), '^[a-z0-9-]+:\s+', ''), '[^a-z0-9]', '', 'g')"
)


@register(
    f"""
    SELECT p_partkey, {_C.format("p_brand || ' ' || p_name")} AS compact, {_K.format("p_brand || ' ' || p_name")} AS spaced,
           {_FULL.format("'Review: ' || p_brand || ' ' || p_name")} AS full_key,
           regexp_replace(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
    FROM part"""
)
def title_key_normalize(spark, sf_dir):
    title = F.concat_ws(" ", "p_brand", "p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.title_key_compact(title).alias("compact"),
        text.title_key_spaced(title).alias("spaced"),
        text.title_key_full(F.concat(F.lit("Review: "), title)).alias("full_key"),
        text.title_slug(title).alias("slug"),
    )


@register(
    """
    SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""
)
def exact_title_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # the hash of the key carries the text through the shuffle as 32 bytes
    keyed = docs.select("doc_id", "source", F.sha2(F.lower(F.btrim("text", F.lit(" "))), 256).alias("k"))
    return rollup.first_seen_order(keyed, F.col("k"), "doc_id").drop("k")


@register(
    f"""
    WITH w AS (SELECT *, {_K.format("p_brand || ' ' || p_name || ' ' || p_type")} AS k0, {_C.format("p_brand || p_name")} AS k1, lower(p_name) AS k2 FROM part),
    r AS (SELECT p_partkey AS ref, unnest([0, 1, 2]) AS s, unnest([k0, k1, k2]) AS k FROM w WHERE p_size <= 25),
    c AS (SELECT p_partkey, unnest([0, 1, 2]) AS s, unnest([k0, k1, k2]) AS k FROM w WHERE p_size > 25),
    h AS (SELECT ref, s, p_partkey, row_number() OVER (PARTITION BY ref ORDER BY s, p_partkey) AS rn FROM r JOIN c USING (s, k) WHERE k <> '')
    SELECT ref, p_partkey, CAST(s AS INT) AS strategy FROM h WHERE rn = 1"""
)
def key_lookup_cascade(spark, sf_dir):
    keys = [
        text.title_key_spaced(F.concat_ws(" ", "p_brand", "p_name", "p_type")),
        text.title_key_compact(F.concat("p_brand", "p_name")),
        F.lower("p_name"),
    ]
    parts = table(spark, sf_dir, "part")
    refs = parts.where("p_size <= 25").withColumn("ref", F.col("p_partkey"))
    return matching.key_cascade(refs, "ref", parts.where("p_size > 25"), "p_partkey", keys, keys)


@register(
    """
    WITH n AS (SELECT DISTINCT p_brand AS k, left(p_brand, 5) AS b FROM part)
    SELECT x.k AS k_a, y.k AS k_b, CAST(levenshtein(x.k, y.k) AS INT) AS edits FROM n x JOIN n y ON x.b = y.b AND x.k < y.k
    WHERE levenshtein(x.k, y.k) <= least(3, greatest(1, greatest(length(x.k), length(y.k)) // 25))"""
)
def typo_match(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k")).distinct()
    pairs = matching.blocked_pairs(names, "k", F.substring("k", 1, 5), [])
    hit = pairs.where(text.titles_match_but_typos(F.col("k_a"), F.col("k_b")))
    return hit.withColumn("edits", F.levenshtein("k_a", "k_b"))


@register(
    """
    WITH w AS (SELECT *, trim(regexp_replace(lower(p_brand || ' ' || p_name), '[^a-z0-9]+', ' ', 'g')) AS k FROM part),
    f AS (SELECT k, min(p_partkey) AS first FROM w GROUP BY 1)
    SELECT y.p_partkey, f.first,
           array_to_string(list_filter([CASE WHEN x.p_type <> y.p_type THEN 'p_type' END, CASE WHEN x.p_size <> y.p_size THEN 'p_size' END], lambda v: v IS NOT NULL), ',') AS differs
    FROM w y JOIN f USING (k) JOIN part x ON x.p_partkey = f.first AND y.p_partkey <> f.first
    WHERE x.p_type <> y.p_type OR x.p_size <> y.p_size"""
)
def discrepancy_pairs(spark, sf_dir):
    """Parts of one name and brand against the first of them."""
    parts = table(spark, sf_dir, "part").withColumn("title", F.concat_ws(" ", "p_brand", "p_name"))
    found = similarity.discrepancies(parts, "p_partkey", "title", ["p_type", "p_size"])
    return found.select("p_partkey", "first", F.array_join("differs", ",").alias("differs"))


@register(
    """
    WITH w AS (SELECT p_partkey, p_name, p_brand, p_size FROM part),
    p AS (SELECT x.p_partkey, y.p_name AS name_b, y.p_partkey AS key_b, least(1.0, greatest(0.0, 0.8 + CASE abs(x.p_size - y.p_size)
             WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 WHEN 2 THEN 0.0 WHEN 3 THEN 0.0 WHEN 4 THEN -0.25 WHEN 5 THEN -0.25 ELSE -0.45 END)) AS score
          FROM w x JOIN w y ON x.p_brand = y.p_brand AND split_part(x.p_name, ' ', 1) = split_part(y.p_name, ' ', 1) AND x.p_partkey <> y.p_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, key_b) AS rn FROM p WHERE score >= 0.8)
    SELECT p_partkey, key_b, CAST(round(score, 6) AS DOUBLE) AS score FROM r WHERE rn = 1"""
)
def year_scored_best_match(spark, sf_dir):
    block = F.concat_ws("|", "p_brand", F.split_part("p_name", F.lit(" "), F.lit(1))).alias("b")
    works = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("key_b"), block, "p_size")
    best = matching.best_within_years(works, works, "p_partkey", "key_b", "b", "p_size")
    return best.select("p_partkey", "key_b", F.round("score", 6).alias("score"))


@register(
    """
    SELECT o_orderkey, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN p_size > 40 THEN 'retracted' ELSE 'clean' END AS state
    FROM orders LEFT JOIN part ON p_partkey = o_orderkey"""
)
def retraction_left_join(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("o_orderkey"), (F.col("p_size") > 40).alias("retracted"))
    state = F.when(F.col("retracted").isNull(), "unknown").when(F.col("retracted"), "retracted").otherwise("clean")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(known, "o_orderkey", "left").select("o_orderkey", state.alias("state"))


@register(
    """
    WITH c AS (SELECT c_nationkey AS k, 'customer' AS src, CAST(1 AS BIGINT) AS shared, c_name AS name, 0 AS pr, c_custkey AS id FROM customer
               UNION ALL SELECT s_nationkey, 'supplier', 2, s_name, 1, s_suppkey FROM supplier)
    SELECT k AS key, CAST(sum(shared) AS BIGINT) AS shared, array_to_string(list_sort(list_distinct(list(src))), ',') AS sources,
           arg_min(name, pr * 1000000000 + id) AS name FROM c GROUP BY 1"""
)
def candidate_merge_union(spark, sf_dir):
    def side(name, prefix, rank, shared):
        key = {"customer": "custkey", "supplier": "suppkey"}[name]
        return table(spark, sf_dir, name).select(
            F.col(f"{prefix}_nationkey").alias("k"),
            F.lit(name).alias("src"),
            F.lit(shared).cast("long").alias("shared_n"),
            F.col(f"{prefix}_name").alias("name"),
            (F.lit(rank * 1_000_000_000) + F.col(f"{prefix}_{key}")).alias("seq"),
        )

    rows = side("customer", "c", 0, 1).union(side("supplier", "s", 1, 2))
    out = matching.merge_candidates(rows, F.col("k"), "src", "shared_n", ["name"], "seq")
    return out.withColumn("sources", F.array_join("sources", ","))


@register(
    """
    WITH n AS (SELECT s_nationkey AS k, s_suppkey AS id FROM supplier),
    u AS (SELECT k FROM n GROUP BY 1 HAVING count(*) = 1) SELECT k, id FROM n WHERE k IN (SELECT k FROM u)"""
)
def unique_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("id"))
    return matching.unique_matches(rows, "k")


@register(
    """
    WITH c AS (SELECT l_orderkey AS ref, l_shipdate, CASE l_returnflag WHEN 'R' THEN 'crossref' WHEN 'A' THEN 'openalex' ELSE 'dblp' END AS src FROM lineitem),
    g AS (SELECT ref, src, max(l_shipdate) AS at FROM c GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY CASE src WHEN 'crossref' THEN 1 WHEN 'openalex' THEN 2 ELSE 3 END) AS rn FROM g)
    SELECT ref, src, at AS seen FROM r WHERE rn = 1""".replace(" AS at", " AS pt").replace("src, at ", "src, pt ")
)
def source_priority(spark, sf_dir):
    flag = F.col("l_returnflag")
    src = F.when(flag == "R", "crossref").when(flag == "A", "openalex").otherwise("dblp")
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ref"), src.alias("src")).agg(F.max("l_shipdate").alias("seen"))
    return matching.source_priority(rows, "ref", "src", ["crossref", "openalex", "dblp"])


@register(
    """
    SELECT p_partkey, 'title:' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ':' || (1990 + p_size) AS identity,
           sha256('4' || chr(0) || lower(trim(p_name)) || chr(0) || lower(trim(p_brand)) || chr(0) || CAST(p_size AS VARCHAR)) AS cache
    FROM part"""
)
def sha_cache_key(spark, sf_dir):
    none = F.lit(None).cast("string")
    key = scoring.identity_key(F.col("p_name"), F.array("p_brand"), 1990 + F.col("p_size"), none, none)
    cache = scoring.cache_key(4, F.col("p_name"), F.col("p_brand"), F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("identity"), cache.alias("cache"))


@register(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
    SELECT user_id, event_type, event_id, ts, value FROM r WHERE rn = 1"""
)
def latest_wins_dedup(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return deltas.latest_wins(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])


@register(
    """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def apply_delete_diff(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return deltas.delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_orderkey"])


@register(
    """
    WITH d AS (SELECT l_orderkey AS k, l_extendedprice AS v, row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
               FROM lineitem WHERE l_returnflag = 'R'),
    f AS (SELECT k, v FROM d WHERE rn = 1)
    SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey NOT IN (SELECT k FROM f) UNION ALL SELECT k, v FROM f"""
)
def upsert_last_writer(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    seq = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq")
    delta = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"), seq
    )
    return deltas.upsert(base, delta, ["k"], "seq")


@register(
    """
    SELECT user_id, count(*) AS times_seen, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(event_type, event_id) AS event_type,
           arg_max(value, event_id) FILTER (WHERE value IS NOT NULL) AS value FROM events GROUP BY 1"""
)
def identity_upsert_counts(spark, sf_dir):
    return deltas.count_seen(table(spark, sf_dir, "events"), "user_id", "event_id", "ts", ["event_type"], ["value"])


@register(
    """
    WITH u AS (SELECT s_nationkey AS k, 'supplier' AS corpus, 0 AS r, min(s_name) AS name FROM supplier GROUP BY 1
               UNION ALL SELECT n_nationkey, 'nation', 1, n_name FROM nation WHERE n_nationkey % 2 = 0),
    w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY r DESC) AS rn FROM u) SELECT k, corpus, name FROM w WHERE rn = 1"""
)
def corpora_union_priority(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name"))
    b = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return deltas.union_by_priority({"supplier": a, "nation": b}, F.col("k").cast("string")).select("k", "corpus", "name")


@register(
    """
    WITH o AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
    w AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT coalesce(o.k, w.k) AS k, coalesce(w.n, 0) - coalesce(o.n, 0) AS n FROM o FULL JOIN w ON o.k = w.k
    WHERE coalesce(w.n, 0) <> coalesce(o.n, 0)"""
)
def counter_deltas(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    old, new = (orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")) for s in "FO")
    return deltas.changed_counters(old, new, "k", ["n"])


@register(
    """
    WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_discount, l_tax FROM lineitem),
    g AS (SELECT l_orderkey, bool_or(l_discount > 0.08) AS e, bool_or(l_tax > 0.06) AS w, bool_or(l_returnflag = 'R') AS u FROM i GROUP BY 1)
    SELECT l_orderkey, CASE WHEN e THEN 'error' WHEN w THEN 'warning' WHEN u THEN 'unverified' ELSE 'verified' END AS status FROM g"""
)
def status_classification(spark, sf_dir):
    def issue(severity, kind):
        return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit("").alias("details"))

    each = F.array_compact(
        F.array(
            F.when(F.col("l_discount") > 0.08, issue("error", "year")),
            F.when(F.col("l_tax") > 0.06, issue("warning", "venue")),
            F.when(F.col("l_returnflag") == "R", issue("error", "unverified")),
        )
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", each.alias("issues"))
    grouped = rows.groupBy("l_orderkey").agg(F.flatten(F.collect_list("issues")).alias("issues"))
    return grouped.select("l_orderkey", scoring.classify(F.col("issues")).alias("status"))


@register(
    """
    WITH d AS (SELECT l.doc_id, CASE WHEN quality = 1 THEN 'low' ELSE 'high' END AS a, CASE WHEN toxic = 1 THEN 'high' ELSE 'low' END AS b,
                      CASE WHEN n_chars >= 3000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'low' END AS c
               FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
    SELECT count(*) AS docs, count(*) FILTER (WHERE a = b AND b = c) AS unanimous, count(*) FILTER (WHERE a = b) AS ab,
           count(*) FILTER (WHERE a = c) AS ac, count(*) FILTER (WHERE b = c) AS bc,
           count(*) FILTER (WHERE a = 'high' AND b = 'high' AND c = 'high') AS all_high FROM d"""
)
def detector_agreement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    a = F.when(F.col("quality") == 1, "low").otherwise("high").alias("a")
    b = F.when(F.col("toxic") == 1, "high").otherwise("low").alias("b")
    c = scoring.band(F.col("n_chars"), 3000, 1000).alias("c")
    d = table(spark, sf_dir, "labels").join(docs, "doc_id").select(a, b, c)
    same = {"ab": ("a", "b"), "ac": ("a", "c"), "bc": ("b", "c")}
    return d.agg(
        F.count("*").alias("docs"),
        F.count_if((F.col("a") == F.col("b")) & (F.col("b") == F.col("c"))).alias("unanimous"),
        *[F.count_if(F.col(x) == F.col(y)).alias(n) for n, (x, y) in same.items()],
        F.count_if(scoring.combine_bands(F.array("a", "b", "c")) == "high").alias("all_high"),
    )
