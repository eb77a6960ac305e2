"""Records, caches and merged sources on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citelake.functions import records
from citelake.operators import caches, duplicates
from citelake.plans.tables import table
from citelake.registry import register

_STAMPS = "['2024-01-02T03:04:05Z', '2024-01-02 03:04:05.123456', '2024-13-02 03:04:05', '', '2023-02-28 23:59:59']"


@register(
    f"""
    WITH s AS (SELECT event_id, {_STAMPS}[event_id % 5 + 1] AS t FROM events)
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN TIMESTAMP '2024-01-02 03:04:05' WHEN 1 THEN TIMESTAMP '2024-01-02 03:04:05.123456' WHEN 4 THEN TIMESTAMP '2023-02-28 23:59:59' END AS at FROM s"""
)
def parsed_timestamps(spark, sf_dir):
    stamps = F.expr(_STAMPS.replace("[", "array(").replace("]", ")"))
    stamp = F.get(stamps, (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", records.timestamp_of(stamp).alias("at"))


@register(
    """
    WITH e AS (SELECT event_id, [props, '', '{broken', '[1,2]'][event_id % 4 + 1] AS p FROM events)
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(len(json_keys(p)) AS INT) ELSE 0 END AS n_keys FROM e"""
)
def json_with_default(spark, sf_dir):
    text = F.get(F.array(F.col("props"), F.lit(""), F.lit("{broken"), F.lit("[1,2]")), (F.col("event_id") % 4).cast("int"))
    none = F.create_map().cast("map<string,string>")
    parsed = records.json_or(text, "map<string,string>", none)
    return table(spark, sf_dir, "events").select("event_id", F.size(parsed).alias("n_keys"))


@register(
    """
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '10.1/' || o_orderkey END AS doi, CASE WHEN o_orderkey % 3 = 0 THEN '' || o_orderkey END AS corpus,
           CAST((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT AS INT) AS n_back FROM orders"""
)
def flattened_ids(spark, sf_dir):
    key = F.col("o_orderkey")
    doi = F.when(key % 2 == 0, F.concat(F.lit("10.1/"), key.cast("string")))
    corpus = F.when(key % 3 == 0, key.cast("string"))
    ids = F.map_filter(F.create_map(F.lit("DOI"), doi, F.lit("CorpusId"), corpus), lambda _, v: v.isNotNull())
    flat = table(spark, sf_dir, "orders").select("o_orderkey", *records.flat_ids(ids))
    return flat.select("o_orderkey", F.col("externalIds_DOI").alias("doi"), F.col("externalIds_CorpusId").alias("corpus"), F.size(records.ids_map()).alias("n_back"))


@register(
    """
    SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 2 = 0 THEN 'a:1' END, CASE WHEN event_id % 5 <> 0 THEN 'b:2' END, 'c:' || (event_id % 3 > 0)::INT], lambda x: x IS NOT NULL)), ',') AS kept FROM events"""
)
def compacted_records(spark, sf_dir):
    key = F.col("event_id")
    one, gone = F.lit(1), F.lit(None).cast("int")
    value = F.create_map(
        F.lit("a"), F.when(key % 2 == 0, F.array(one, gone)), F.lit("b"), F.when(key % 5 != 0, F.array(one, gone, one)), F.lit("c"), F.array(F.when(key % 3 > 0, one))
    )
    sizes = F.transform(F.map_entries(records.without_nulls(value, "map<string,array<int>>")), lambda e: F.concat_ws(":", e["key"], F.size(e["value"]).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(sizes), ",").alias("kept"))


_SECRET = b"not a secret"


def _padded(pad: int) -> str:
    return "'" + "".join(f"\\x{b ^ pad:02X}" for b in _SECRET.ljust(64, b"\0")) + "'::BLOB"


@register(
    f"""
    SELECT c_custkey, left(sha256({_padded(0x5C)} || unhex(sha256({_padded(0x36)} || encode(c_name)))), 32) AS hash FROM customer"""
)
def keyed_hashes(spark, sf_dir):
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", records.keyed_hash(padded, _SECRET).alias("hash"))


@register("SELECT o_orderkey FROM orders WHERE o_orderkey % 6 >= 4")
def current_cached_results(spark, sf_dir):
    version = F.when(F.col("o_orderkey") % 6 > 0, (F.col("o_orderkey") % 6).cast("int"))
    return table(spark, sf_dir, "orders").where(records.current(version)).select("o_orderkey")


@register("SELECT p_partkey, CAST(greatest(p_size, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END) AS BIGINT) AS citations FROM part")
def richest_counts(spark, sf_dir):
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise("n/a")
    return table(spark, sf_dir, "part").select("p_partkey", records.richest(F.col("p_size"), other).alias("citations"))


@register(
    """
    WITH c AS (SELECT l_orderkey, l_linenumber, l_discount * 10 AS s FROM lineitem),
    r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, l_linenumber) AS k FROM c WHERE s >= 0.3)
    SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY k) AS best FROM r WHERE k <= 3 GROUP BY 1"""
)
def best_concepts_per_order(spark, sf_dir):
    concept = F.struct(F.col("l_linenumber").alias("name"), (F.col("l_discount") * 10).alias("score"))
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(concept).alias("c"))
    best = records.best_concepts(F.col("c"))
    return per.where(F.size(best) > 0).select("l_orderkey", F.array_join(best, ",").alias("best"))


@register(
    """
    WITH a AS (SELECT o_orderkey AS ref, 'the ' || p_name || ' ' || p_type || ' study' AS title, p_brand AS surname, 2000 + p_size + o_orderkey % 4 - 1 AS year, CASE WHEN o_orderkey % 5 = 0 THEN '10.1/' || (p_partkey + o_orderkey % 2) END AS doi
               FROM orders JOIN part ON p_partkey = o_orderkey),
    c AS (SELECT p_partkey AS entry, 'The ' || upper(p_name) || ': ' || p_type || ' study' AS title, p_brand AS surname, CASE WHEN p_partkey % 9 <> 0 THEN 2000 + p_size END AS year,
                 CASE WHEN p_partkey % 2 = 0 THEN '10.1/' || p_partkey END AS doi, CASE WHEN p_partkey % 3 = 0 THEN 'verified' ELSE 'error' END AS status FROM part),
    x AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k FROM a), y AS (SELECT *, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS k FROM c),
    m AS (SELECT ref, entry, 1 + CASE abs(x.year - y.year) WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN status = 'verified' THEN 1 ELSE 0 END AS score
          FROM x JOIN y ON x.surname = y.surname AND left(x.k, CASE WHEN length(x.k) >= 100 THEN 80 ELSE 60 END) = left(y.k, CASE WHEN length(x.k) >= 100 THEN 80 ELSE 60 END)
          WHERE length(x.k) >= 12 AND coalesce(abs(x.year - y.year), 0) <= 1 AND (y.year IS NOT NULL OR y.doi IS NOT NULL) AND (x.doi IS NULL OR y.doi IS NULL OR x.doi = y.doi))
    SELECT ref, entry, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY score DESC, entry) AS rn FROM m) WHERE rn = 1"""
)
def fuzzy_cache_hits(spark, sf_dir):
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    refs = table(spark, sf_dir, "orders").join(parts, F.col("o_orderkey") == key)
    order = F.col("o_orderkey")
    refs = refs.select(
        order.alias("ref"),
        F.concat(F.lit("the "), "p_name", F.lit(" "), "p_type", F.lit(" study")).alias("title"),
        F.col("p_brand").alias("surname"),
        (2000 + F.col("p_size") + (order % 4).cast("int") - 1).alias("year"),
        F.when(order % 5 == 0, F.concat(F.lit("10.1/"), (key + order % 2).cast("string"))).alias("doi"),
    )
    cache = parts.select(
        key.alias("entry"),
        F.concat(F.lit("The "), F.upper("p_name"), F.lit(": "), "p_type", F.lit(" study")).alias("title"),
        F.col("p_brand").alias("surname"),
        F.when(key % 9 != 0, 2000 + F.col("p_size")).alias("year"),
        F.when(key % 2 == 0, F.concat(F.lit("10.1/"), key.cast("string"))).alias("doi"),
        F.lit(None).cast("string").alias("arxiv"),
        F.when(key % 3 == 0, "verified").otherwise("error").alias("status"),
    )
    return caches.fuzzy_cached(refs, cache, "ref", "entry")


@register(
    """
    SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'error' WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 0 THEN 'verified' WHEN p_partkey % 3 > 0 THEN 'unverified' ELSE 'unknown' END AS verified_status,
           CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE 0 END AS INT) AS times_seen
    FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25"""
)
def most_cited_with_status(spark, sf_dir):
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    papers = parts.select(
        "p_partkey",
        F.when(key % 3 > 0, key).alias("paper_id"),
        F.when(key % 2 == 0, "10.1/x").alias("doi"),
        F.lit(None).cast("string").alias("arxiv"),
        F.col("p_retailprice").alias("citations"),
    )
    seen = parts.where(key % 4 == 0).select("p_partkey", F.lit("error").alias("status"), F.col("p_size").alias("times_seen"))
    return caches.with_cached_status(papers, seen, "p_partkey", 25).select("p_partkey", "verified_status", "times_seen")


@register(
    """
    WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS h, CASE WHEN c_custkey % 3 = 0 THEN 'o' || c_custkey END AS orcid FROM customer WHERE c_custkey % 5 <> 0),
    b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 90 END AS h, 'x' || c_custkey AS orcid FROM customer WHERE c_custkey % 4 <> 0)
    SELECT coalesce(a.k, b.k) AS c_custkey, coalesce(a.orcid, b.orcid) AS orcid, CAST(coalesce(a.h, b.h) AS INT) AS h_index,
           CASE WHEN a.k IS NULL OR (a.h IS NULL AND b.h IS NOT NULL) THEN 'other' ELSE 'primary' END AS metrics_source
    FROM a FULL JOIN b ON a.k = b.k"""
)
def merged_author_profiles(spark, sf_dir):
    rows, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    primary = rows.where(key % 5 != 0).select(
        "c_custkey", F.when(key % 3 == 0, F.concat(F.lit("o"), key.cast("string"))).alias("orcid"), F.when(key % 2 == 0, F.col("c_nationkey")).alias("h_index")
    )
    other = rows.where(key % 4 != 0).select(
        "c_custkey", F.concat(F.lit("x"), key.cast("string")).alias("orcid"), F.when(key % 7 != 0, (key % 90).cast("int")).alias("h_index")
    )
    return caches.merged_profiles(primary, other, "c_custkey", ("orcid",), ("h_index",))


@register(
    """
    WITH a AS (SELECT p_partkey AS k, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN '10.1/a' END AS doi, ['', 'ArXiv preprint', 'Nature'][p_partkey % 3 + 1] AS cited FROM part),
    b AS (SELECT p_partkey AS k, 's' || p_partkey AS pid, '10.2/b' AS doi, ['NeurIPS', 'arXiv.org', '', 'ICML'][p_partkey % 4 + 1] AS venue FROM part WHERE p_partkey % 5 <> 0)
    SELECT a.k AS p_partkey, title, pid AS paper_id, coalesce(a.doi, b.doi) AS doi, CASE WHEN cited <> 'Nature' AND venue IN ('NeurIPS', 'ICML') THEN venue END AS venue,
           CASE WHEN cited <> 'Nature' AND venue IN ('NeurIPS', 'ICML') THEN 'published at ' || venue END AS warning
    FROM a LEFT JOIN b ON a.k = b.k"""
)
def merged_preprint_records(spark, sf_dir):
    parts, key = table(spark, sf_dir, "part"), F.col("p_partkey")

    def pick(n, *values):
        return F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))

    first = parts.select("p_partkey", F.col("p_name").alias("title"), F.when(key % 2 == 0, "10.1/a").alias("doi"), pick(3, "", "ArXiv preprint", "Nature").alias("cited_venue"))
    second = parts.where(key % 5 != 0).select(
        "p_partkey", F.concat(F.lit("s"), key.cast("string")).alias("paper_id"), F.lit("10.2/b").alias("doi"), pick(4, "NeurIPS", "arXiv.org", "", "ICML").alias("venue")
    )
    return caches.merged_sources(first, second, "p_partkey")


@register(
    """
    WITH c AS (SELECT l_orderkey AS ref, p_name AS title, CASE WHEN l_linenumber % 2 = 0 THEN '10.1/' || (l_partkey % 3) END AS doi, CAST(l_quantity AS INT) % 7 AS overlap FROM lineitem JOIN part ON p_partkey = l_partkey),
    o AS (SELECT ref, coalesce(lower(doi), left(lower(title), 80)) AS k, -overlap AS o, title FROM c),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref, k ORDER BY o, title) AS rn FROM o) WHERE rn = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY o, title, k) AS rank FROM d)
    SELECT ref, CAST(rank AS INT) AS rank, title, -o AS overlap, rank = 1 AND o < 0 AS winner FROM r WHERE rank <= 8"""
)
def alternative_suggestions(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    rows = table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    doi = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("10.1/"), (F.col("l_partkey") % 3).cast("string")))
    candidates = rows.select(F.col("l_orderkey").alias("ref"), "title", doi.alias("doi"), (F.col("l_quantity").cast("int") % 7).alias("overlap"))
    return caches.ranked_suggestions(candidates, "ref", "title", "doi", "overlap")


@register(
    """
    WITH RECURSIVE r AS (SELECT l_orderkey AS list, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i,
                  CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name ELSE 'on the ' || p_name || ' of ' || p_type END AS title, 'a' || l_suppkey % 3 AS authors
           FROM lineitem JOIN part ON l_partkey = p_partkey),
    s(list, i, kept) AS (
        SELECT list, i, [{'i': i, 't': lower(title), 'a': authors}] FROM r WHERE i = 1
        UNION ALL
        SELECT r.list, r.i, CASE WHEN len(list_filter(s.kept, lambda k: k.t = lower(title) OR (k.a = authors AND (contains(k.t, lower(title)) OR contains(lower(title), k.t))))) > 0
                                 THEN s.kept ELSE list_append(s.kept, {'i': r.i, 't': lower(title), 'a': authors}) END
        FROM s JOIN r ON r.list = s.list AND r.i = s.i + 1),
    fin AS (SELECT list, arg_max(kept, i) AS kept FROM s GROUP BY list)
    SELECT r.list AS l_orderkey, CAST(count(*) AS BIGINT) AS n_references, CAST(count(*) FILTER (WHERE NOT list_contains(list_transform(kept, lambda k: k.i), r.i)) AS BIGINT) AS n_repeated,
           CAST(sum(i) FILTER (WHERE NOT list_contains(list_transform(kept, lambda k: k.i), r.i)) AS BIGINT) AS places
    FROM r JOIN fin USING (list) GROUP BY 1"""
)
def repeated_references(spark, sf_dir):
    """Orders as lists of references: the lines' parts as titles, in capitals or inside others."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(parts, "l_partkey")
    longer = F.concat(F.lit("on the "), "p_name", F.lit(" of "), "p_type")
    title = F.when(F.col("l_linenumber") % 3 == 0, F.upper("p_name")).when(F.col("l_linenumber") % 3 == 1, F.col("p_name")).otherwise(longer)
    titled = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", title.alias("title"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    authors = F.concat(F.lit("a"), (F.col("l_suppkey") % 3).cast("string"))
    placed = titled.withColumn("i", place)  # authors are made where the lines of an order are: they don't move
    refs = placed.select("l_orderkey", F.struct("l_orderkey", "i").alias("ref"), "title", authors.alias("authors"), F.lit("").alias("venue"))
    lists = duplicates.repeated_by_list(refs, "ref", "l_orderkey")
    places = F.when(F.size("gone") > 0, F.aggregate("gone", F.lit(0).cast("long"), lambda n, g: n + g["own"]["i"]))
    return lists.groupBy("l_orderkey").agg(F.sum("n").alias("n_references"), F.sum(F.size("gone").cast("long")).alias("n_repeated"), F.sum(places).alias("places"))


@register("SELECT doc_id, text IS NOT NULL AND regexp_matches(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]') AS dirty, replace(coalesce(text, ''), chr(1), '') = coalesce(text, '') AS same FROM documents WHERE doc_id >= 0")
def cleaned_unicode(spark, sf_dir):
    """``same``: a control character put in front of a text is all that cleaning takes away."""
    docs = table(spark, sf_dir, "documents").where("doc_id >= 0")
    t = F.coalesce("text", F.lit(""))
    clean = records.clean_unicode(F.concat(F.lit("\x01"), t))
    dirty = F.coalesce(F.col("text").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), F.lit(False))
    return docs.select("doc_id", dirty.alias("dirty"), (clean == records.clean_unicode(t)).alias("same"))
