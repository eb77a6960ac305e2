"""Audits of citations and results: an order is a check, its lines are reference results."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import names, scoring, text
from citelake.operators import citations, deltas, markers, results, similarity
from citelake.plans.tables import spread, table
from citelake.registry import register

_LINES = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)"


def _issue(severity, kind):
    return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), F.lit("").alias("details"))


def _results(spark, sf_dir):
    """Reference results: index = line number, the last by sequence counts."""
    issues = F.array_compact(
        F.array(
            F.when(F.col("l_discount") > 0.08, _issue("error", "title")),
            F.when(F.col("l_tax") > 0.06, _issue("warning", "year")),
            F.when(F.col("l_returnflag") == "R", _issue("error", "unverified")),
        )
    )
    seq = F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("c"), F.col("l_linenumber").alias("i"), seq.alias("seq"), issues.alias("issues"), (F.col("l_quantity") >= 49).alias("fab")
    )


@register(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem),
    k AS (SELECT l_orderkey AS c, l_quantity >= 49 AS fab, l_discount > 0.08 AS e, l_tax > 0.06 AS w, l_returnflag = 'R' AS u FROM r WHERE rn = 1),
    s AS (SELECT *, CASE WHEN fab THEN 'hallucination' WHEN e THEN 'error' WHEN w THEN 'warning' WHEN u THEN 'unverified' ELSE 'verified' END AS st FROM k)
    SELECT c, count(*) AS total, count(*) FILTER (WHERE st = 'verified') AS n_verified, count(*) FILTER (WHERE st = 'error') AS n_error,
           count(*) FILTER (WHERE st = 'warning') AS n_warning, count(*) FILTER (WHERE st = 'suggestion') AS n_suggestion,
           count(*) FILTER (WHERE st = 'unverified') AS n_unverified, count(*) FILTER (WHERE st = 'hallucination') AS n_hallucination,
           count(*) FILTER (WHERE e AND NOT fab) AS errors, count(*) FILTER (WHERE w AND NOT fab) AS warnings FROM s GROUP BY c"""
)
def result_buckets(spark, sf_dir):
    return results.buckets(_results(spark, sf_dir), "c", "i", "seq", "issues", "fab")


@register(
    """
    SELECT 'error:title' AS key, count(*) AS count FROM lineitem WHERE l_discount > 0.08
    UNION ALL SELECT 'warning:year', count(*) FROM lineitem WHERE l_tax > 0.06
    UNION ALL SELECT 'error:unverified', count(*) FROM lineitem WHERE l_returnflag = 'R'"""
)
def result_issue_histogram(spark, sf_dir):
    return results.issue_histogram(_results(spark, sf_dir), "issues")


@register(
    """
    WITH m AS (SELECT l_orderkey AS d, CAST(l_quantity AS INT) % 9 + 1 AS number, l_linenumber * 1000 + l_suppkey % 1000 AS pos FROM lineitem),
    c AS (SELECT d, number, min(pos) AS first FROM m GROUP BY 1, 2),
    r AS (SELECT l_orderkey AS d, l_linenumber AS number, count(*) AS times FROM lineitem GROUP BY 1, 2),
    b AS (SELECT d, number, first, times FROM c FULL JOIN r USING (d, number)),
    o AS (SELECT *, max(CASE WHEN first IS NOT NULL THEN number END) OVER (PARTITION BY d ORDER BY first NULLS FIRST, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
    p AS (SELECT d, count(first) AS nc, count(times) AS nl, count(*) FILTER (WHERE first IS NOT NULL AND times IS NOT NULL) AS nb,
                 list_sort(list(number) FILTER (WHERE times IS NULL)) AS undefined, list_sort(list(number) FILTER (WHERE times > 1)) AS duplicate,
                 list_sort(list(number) FILTER (WHERE first IS NULL)) AS uncited, list_sort(list(number) FILTER (WHERE first IS NOT NULL AND number < before)) AS late,
                 list(number) FILTER (WHERE times IS NOT NULL) AS listed, max(number) FILTER (WHERE times IS NOT NULL) AS top FROM o GROUP BY 1)
    SELECT d, (nc < 3 OR coalesce(len(undefined), 0) > 0.3 * nc) AS abstains, coalesce(array_to_string(undefined, ','), '') AS undefined, coalesce(array_to_string(duplicate, ','), '') AS duplicate,
           array_to_string(list_filter(range(1, coalesce(top, 0) + 1), lambda x: NOT list_contains(listed, x)), ',') AS gap,
           CASE WHEN nb >= 0.5 * nl THEN coalesce(array_to_string(uncited, ','), '') ELSE '' END AS uncited, coalesce(array_to_string(late, ','), '') AS out_of_order FROM p"""
)
def citation_audit(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    marks = lines.select(
        F.col("l_orderkey").alias("d"),
        (F.col("l_quantity").cast("int") % 9 + 1).alias("number"),
        (F.col("l_linenumber") * 1000 + F.col("l_suppkey") % 1000).alias("at"),
    )
    refs = lines.select(F.col("l_orderkey").alias("d"), F.col("l_linenumber").alias("n"))
    out = citations.audit(marks, refs, "d", "n")
    lists = ("undefined", "duplicate", "gap", "uncited", "out_of_order")
    return out.select("d", "abstains", *[F.array_join(c, ",").alias(c) for c in lists])


_CITING = """w AS (SELECT l_orderkey AS d, l_orderkey % 3 AS s, l_linenumber AS number, split_part(p_name, ' ', 2) AS noun, 1990 + p_size AS y, CAST(l_quantity AS INT) % 9 + 1 AS q,
             l_discount > 0.09 AS bad, l_returnflag = 'R' AS lost, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos
      FROM lineitem JOIN part ON l_partkey = p_partkey),
    k AS (SELECT d, greatest(max(number), count(*)) AS cap, count(*) AS total FROM w GROUP BY 1),
    st AS (SELECT d, CASE WHEN any_value(s) = 0 AND count(*) FILTER (WHERE bad OR q <= cap) >= 3 THEN 'bracket'
                          WHEN any_value(s) = 1 AND count(DISTINCT CASE WHEN lost THEN 'qx97' ELSE left(noun, 3) || y END) >= 3 THEN 'alpha-key'
                          WHEN any_value(s) = 2 AND count(DISTINCT noun || y) >= 3 THEN 'author-year' END AS style FROM w JOIN k USING (d) GROUP BY 1)"""


def _citing(spark, sf_dir):
    """Orders as papers: a line is a reference (its number; the noun of the part's name as
    author; 1990 and the size as year) and a sentence that cites: by numbers, alpha keys or
    author and year, as the order's number has it."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("noun"), (1990 + F.col("p_size")).alias("year"))
    q = F.col("l_quantity").cast("int") % 9 + 1
    lines = table(spark, sf_dir, "lineitem")
    cites = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", q.alias("q"), (F.col("l_discount") > 0.09).alias("bad"), (F.col("l_returnflag") == "R").alias("lost"))
    cites = spread(cites.join(parts, "l_partkey"), "l_orderkey", like=lines)
    number = F.when(F.col("bad"), F.format_string("[%d–%d]", F.col("q") + 2, "q")).otherwise(F.format_string("[%d]", "q"))
    alpha = F.when(F.col("lost"), "[Qx97]").otherwise(F.concat(F.lit("["), F.left("noun", F.lit(3)), F.right(F.col("year").cast("string"), F.lit(2)), F.lit("]")))
    dated = F.concat(F.lit("("), "noun", F.lit(" et al., "), F.col("year").cast("string"), F.lit(")"))
    kind = F.col("l_orderkey") % 3
    sentence = F.concat(F.lit("It is known that all of this holds "), F.when(kind == 0, number).when(kind == 1, alpha).otherwise(dated), F.lit(" in most cases."))
    # texts and lists are made of one exchange: each has all of its columns
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", sentence.alias("s"), "noun", "year")
    works = cites.groupBy(F.col("l_orderkey").alias("d")).agg(F.sort_array(F.collect_list(at)).alias("cites"))
    bibliography = F.lit("\nReferences\n[1] Someone, 1999. [2] Someone else, 2001. [3] Nobody, 2002.")
    docs = works.select("d", F.concat(F.array_join(F.transform("cites", lambda x: x["s"]), "\n"), bibliography).alias("text"))
    refs = works.select("d", F.inline("cites")).select("d", F.col("l_linenumber").alias("number"), F.array("noun").alias("authors"), "year")
    return docs, refs


@register(
    f"""
    WITH {_CITING},
    c AS (SELECT d, q AS number, min(pos) AS fst FROM w WHERE s = 0 AND NOT bad GROUP BY 1, 2),
    r AS (SELECT d, number, count(*) AS times FROM w WHERE s = 0 GROUP BY 1, 2),
    b AS (SELECT d, number, fst, times, cap, total, fst IS NOT NULL AND number <= cap AS inside FROM c FULL JOIN r USING (d, number) JOIN k USING (d) JOIN st USING (d) WHERE style = 'bracket'),
    o AS (SELECT *, max(CASE WHEN inside THEN number END) OVER v AS high, CASE WHEN inside THEN last_value(CASE WHEN inside THEN number END IGNORE NULLS) OVER v END AS prev
          FROM b WINDOW v AS (PARTITION BY d ORDER BY fst NULLS FIRST, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT d, count(*) >= 3 AND count(DISTINCT noun) >= greatest(3, floor(0.5 * count(*))) AND count(*) FILTER (WHERE noun <= nxt) >= 0.8 * count(nxt) AS by_author
          FROM (SELECT d, noun, lead(noun) OVER (PARTITION BY d ORDER BY number, noun) AS nxt FROM w) GROUP BY 1),
    p AS (SELECT d, count(*) FILTER (WHERE inside) AS n_in, count(*) FILTER (WHERE fst IS NOT NULL AND NOT inside) AS n_out, count(*) FILTER (WHERE inside AND times > 0) AS n_both, any_value(total) AS total,
                 list(number ORDER BY number) FILTER (WHERE fst IS NOT NULL AND times IS NULL) AS undefined, list(number ORDER BY number) FILTER (WHERE times > 1) AS dup,
                 list(number ORDER BY number) FILTER (WHERE fst IS NULL) AS unc, list(number ORDER BY number) FILTER (WHERE inside AND number < high) AS late,
                 count(prev) AS steps, count(*) FILTER (WHERE prev >= number) AS falls,
                 min(number) FILTER (WHERE inside AND times > 0) AS low, max(number) FILTER (WHERE inside AND times > 0) AS top FROM o GROUP BY 1),
    e AS (SELECT d, list_sort(list(DISTINCT 'reversed ' || (q + 2) || ' ' || q)) AS errors FROM w WHERE s = 0 AND bad GROUP BY 1),
    n AS (SELECT d, n_in < 3 OR n_out > 0.3 * (n_in + n_out) AS abstains, undefined, errors, dup,
                 CASE WHEN n_both >= 0.5 * total AND n_both > 0 THEN list_filter(unc, lambda x: x BETWEEN low AND top) END AS gap, CASE WHEN n_both >= 0.5 * total AND n_both > 0 THEN list_filter(unc, lambda x: x NOT BETWEEN low AND top) END AS uncited,
                 CASE WHEN NOT (by_author OR (steps >= 3 AND falls = steps)) THEN late END AS late FROM p JOIN a USING (d) LEFT JOIN e USING (d)),
    ac AS (SELECT DISTINCT d, CASE WHEN lost THEN 'qx' ELSE left(noun, 3) END AS key, CASE WHEN lost THEN '97' ELSE CAST(y % 100 AS VARCHAR) END AS yy FROM w JOIN st USING (d) WHERE style = 'alpha-key'),
    ar AS (SELECT d, number, left(noun, 3) AS key, y, lpad(CAST(y % 100 AS VARCHAR), 2, '0') AS yy FROM w JOIN st USING (d) WHERE style = 'alpha-key'),
    am AS (SELECT ac.d, ac.key, lpad(ac.yy, 2, '0') AS yy, number FROM ac LEFT JOIN ar ON ar.d = ac.d AND ar.key = ac.key AND ar.yy = lpad(ac.yy, 2, '0')),
    ak AS (SELECT d, key || yy AS name, count(DISTINCT number) AS n FROM am GROUP BY d, key, yy),
    al AS (SELECT d, count(*) AS n_keys, list(name ORDER BY name) FILTER (WHERE n = 0) AS undefined, list(name ORDER BY name) FILTER (WHERE n > 1) AS dup FROM ak GROUP BY 1),
    au AS (SELECT d, count(*) AS der, count(*) FILTER (WHERE c) AS nc, list(number ORDER BY number) FILTER (WHERE NOT c) AS unc
           FROM (SELECT d, number, (d, number) IN (SELECT (d, number) FROM am WHERE number IS NOT NULL) AS c FROM (SELECT DISTINCT d, number FROM ar)) GROUP BY 1),
    an AS (SELECT d, n_keys < 3 OR der < greatest(3, 0.5 * total) OR coalesce(len(undefined), 0) > 0.5 * n_keys AS abstains, undefined, dup, CASE WHEN nc >= 0.5 * der THEN unc END AS unc FROM al JOIN au USING (d) JOIN k USING (d)),
    f AS (SELECT d, style, coalesce(n.abstains, an.abstains, true) AS abstains, coalesce(CAST(n.undefined AS VARCHAR[]), an.undefined) AS undefined, errors AS range_errors,
                 coalesce(CAST(n.dup AS VARCHAR[]), an.dup) AS duplicate, CAST(gap AS VARCHAR[]) AS gap, CAST(coalesce(uncited, unc) AS VARCHAR[]) AS uncited, CAST(late AS VARCHAR[]) AS out_of_order
          FROM st LEFT JOIN n USING (d) LEFT JOIN an USING (d))
    SELECT d, style, abstains, {", ".join(f"CASE WHEN abstains THEN '' ELSE coalesce(array_to_string({c}, ','), '') END AS {c}" for c in ("undefined", "range_errors", "duplicate", "gap", "uncited", "out_of_order"))} FROM f"""
)
def text_citation_audit(spark, sf_dir):
    docs, refs = _citing(spark, sf_dir)
    found = markers.audit(docs, refs, "d", "text", "number", "authors", "year")
    lists = ("undefined", "range_errors", "duplicate", "gap", "uncited", "out_of_order")
    return found.select("d", "style", "abstains", *[F.array_join(c, ",").alias(c) for c in lists])


@register(
    f"""
    WITH {_CITING},
    m AS (SELECT w.d, q AS number FROM w JOIN st USING (d) WHERE style = 'bracket' AND NOT bad AND (d, q) IN (SELECT (d, number) FROM w)
          UNION ALL
          SELECT c.d, r.number FROM (SELECT w.d, left(noun, 3) AS key, y % 100 AS yy FROM w JOIN st USING (d) WHERE style = 'alpha-key' AND NOT lost) c
          JOIN (SELECT d, left(noun, 3) AS key, y % 100 AS yy, min(number) AS number FROM w GROUP BY 1, 2, 3 HAVING count(DISTINCT number) = 1) r USING (d, key, yy)
          UNION ALL
          SELECT c.d, r.number FROM (SELECT w.d, noun, y FROM w JOIN st USING (d) WHERE style = 'author-year') c
          JOIN (SELECT d, noun, y, min(number) AS number FROM w GROUP BY 1, 2, 3 HAVING count(*) = 1) r USING (d, noun, y))
    SELECT d, number, count(*) AS times FROM m GROUP BY 1, 2"""
)
def marker_references(spark, sf_dir):
    docs, refs = _citing(spark, sf_dir)
    found = markers.resolved(docs, refs, "d", "text", "number", "authors", "year")
    return found.groupBy("d", "number").agg(F.count("*").alias("times"))


@register(
    f"""
    WITH {_CITING}
    SELECT d, CASE WHEN bad THEN '[' || (q + 2) || '–' || q || ']' ELSE '[' || q || ']' END AS marker,
           CASE WHEN bad THEN '[' || (q + 2 + CAST(q + 2 >= 3 AS INT)) || '–' || (q + CAST(q >= 3 AS INT)) || ']' ELSE '[' || (q + 1) || ']' END AS new_marker, count(*) AS times
    FROM w JOIN st USING (d) WHERE style = 'bracket' AND (q >= 3 OR bad) GROUP BY 1, 2, 3"""
)
def renumbered_markers(spark, sf_dir):
    """What a reference inserted as the third changes in the texts."""
    docs, refs = _citing(spark, sf_dir)
    return markers.renumbered(docs.withColumn("third", F.lit(3)), refs, "d", "text", "number", "third")


@register(
    f"""
    WITH {_LINES}, f AS (SELECT l_orderkey, l_partkey, min(seq) AS first FROM l GROUP BY 1, 2),
    k AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS new_number FROM f)
    SELECT l_orderkey AS d, k.l_partkey AS number, CAST(new_number AS INT) AS new_number, count(*) AS mentions
    FROM l JOIN k USING (l_orderkey, l_partkey) GROUP BY 1, 2, 3"""
)
def dense_renumbering(spark, sf_dir):
    at = F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey")
    marks = lines.select(F.col("l_orderkey").alias("d"), F.col("l_partkey").alias("number"), at.alias("at"))
    return citations.dense_numbers(marks, "d").groupBy("d", "number", "new_number").agg(F.count("*").alias("mentions"))


@register(
    """
    SELECT o_orderkey FROM orders WHERE (o_orderdate <= TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 180 SECOND OR o_orderkey % 10 >= 9)
      AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')"""
)
def stale_checks(spark, sf_dir):
    checks = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", (F.col("o_orderkey") % 10).alias("done"), F.lit(9).alias("total")
    )
    active = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    as_of = F.to_timestamp_ntz(F.lit("2001-08-01 00:00:00"))
    return results.stale(checks, active, "o_orderkey", "done", "total", "o_orderdate", as_of).select("o_orderkey")


@register(
    """
    WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS st FROM orders),
    n AS (SELECT l_orderkey AS k, CASE WHEN max(l_linestatus) = 'O' THEN 'pending' ELSE 'done' END AS st FROM lineitem GROUP BY 1)
    SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NULL OR (o.k IS NOT NULL AND n.st = 'pending' AND o.st <> 'pending') THEN o.st ELSE n.st END AS st
    FROM o FULL JOIN n ON o.k = n.k"""
)
def progress_never_regresses(spark, sf_dir):
    status = F.col("o_orderstatus")
    old = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(status == "P", "pending").otherwise(status).alias("st"))
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("s"))
    new = last.select("k", F.when(F.col("s") == "O", "pending").otherwise("done").alias("st"))
    return results.merge_progress(old, new, "k", "st")


@register(
    """
    SELECT doc_id, CAST(length(t) AS INT) AS chars, md5(t) AS digest FROM (
        SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(text, 'ß', 'ss'))), '[^a-z0-9_\\s'']', '', 'g'), '\\s+', ' ', 'g')) AS t FROM documents)"""
)
def normalized_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("t"))
    return rows.select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@register(
    """
    SELECT p_partkey, lower('10.' || (1000 + p_partkey) || '/' || replace(p_name, ' ', '.')) AS doi, (p_size % 2 = 0) AS agrees FROM part"""
)
def doi_normalization(spark, sf_dir):
    bare = F.concat(F.lit("10."), (1000 + F.col("p_partkey")).cast("string"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(".")))
    cited = F.concat(F.lit("https://doi.org/"), F.upper(bare), F.lit("#abstract"))
    other = F.concat(bare, F.when(F.col("p_size") % 2 == 0, ".v2").otherwise("x"))
    doi = text.normalize_doi(cited)
    return table(spark, sf_dir, "part").select("p_partkey", doi.alias("doi"), text.dois_agree(cited, other).alias("agrees"))


@register(
    """
    SELECT count(DISTINCT CASE WHEN user_id % 3 = 0 THEN 'k:' || event_type WHEN user_id % 3 = 1 THEN 't:' || event_type ELSE 'c:' || event_id END) AS papers FROM events"""
)
def distinct_papers(spark, sf_dir):
    kind, own = F.col("user_id") % 3, F.upper("event_type")
    key = scoring.paper_group(F.when(kind == 0, own), F.when(kind == 1, own).otherwise("untitled"), F.col("event_id"))
    return table(spark, sf_dir, "events").agg(F.count_distinct(key).alias("papers"))


@register(
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'skip' WHEN o_totalprice / 500000 < CASE WHEN o_orderstatus = 'F' THEN 0.6 ELSE 0.4 END THEN 'needs_look'
           ELSE 'resolved' END AS triage FROM orders"""
)
def doubt_triage(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", F.when(F.col("o_orderpriority") == "1-URGENT", "verified").otherwise("unverified")).otherwise("verified")
    overlap = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice") / 500000)
    return table(spark, sf_dir, "orders").select("o_orderkey", scoring.triage(status, overlap).alias("triage"))


_WORD_SETS = "list_filter(list_distinct(string_split({0}, ' ')), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "], w))"


@register(
    f"""
    WITH r AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' ' || p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')) AS t FROM part),
    d AS (SELECT t, {_WORD_SETS.format("t")} AS w, string_split(t, ' ') AS k FROM (SELECT DISTINCT t FROM r)),
    p AS (SELECT x.t AS a, y.t AS b, x.k AS ka, len(list_intersect(x.w, y.w)) AS s, len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)) AS u, least(len(x.w), len(y.w)) AS m,
                 CASE WHEN length(x.t) < length(y.t) THEN x.t ELSE y.t END AS short, CASE WHEN length(x.t) < length(y.t) THEN y.t ELSE x.t END AS long
          FROM d x JOIN d y ON x.t < y.t AND (len(list_intersect(x.w, y.w)) >= 2 OR contains(x.t, y.t) OR contains(y.t, x.t) OR replace(x.t, ' ', '') = replace(y.t, ' ', ''))),
    q AS (SELECT a, b, CASE WHEN replace(a, ' ', '') = replace(b, ' ', '') THEN 1.0
                  WHEN contains(long, short) THEN CASE WHEN length(short) >= 0.8 * length(long) THEN 0.95 ELSE 0.7 END
                  WHEN s >= 0.9 * m AND s / u >= 0.7 THEN greatest(0.85, s / u)
                  ELSE least(1.0, 0.7 * (s / u) + 0.3 * (len(list_filter(range(1, len(ka)), lambda i: contains(b, ka[i] || ' ' || ka[i + 1]))) / (len(ka) - 1))) END AS score FROM p),
    e AS (SELECT a AS t, b AS u, score FROM q WHERE score >= 0.65 UNION ALL SELECT b, a, score FROM q WHERE score >= 0.65
          UNION ALL SELECT t, t, 1.0 FROM d),
    c AS (SELECT x.p_partkey, y.p_partkey AS other, score FROM r x JOIN e USING (t) JOIN r y ON y.t = e.u AND x.p_partkey <> y.p_partkey),
    w AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, other) AS n FROM c)
    SELECT p_partkey, other, round(CAST(score AS DOUBLE), 6) AS score FROM w WHERE n = 1"""
)
def title_similarity_matches(spark, sf_dir):
    """The most similar other title of each part, of all parts, at 0.65 or more."""
    title = F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("t")
    best = similarity.best_similar(table(spark, sf_dir, "part").select("p_partkey", title), "p_partkey", "t", 0.65)
    return best.select("p_partkey", "other", F.round("score", 6).alias("score"))


@register()
def venue_differences(spark, sf_dir):
    """Pairs of brands as venues, of which different numbers differ."""
    brands = table(spark, sf_dir, "part").select(F.concat(F.lit("Journal of "), F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("v"), "p_type").distinct()
    pairs = brands.join(brands.withColumnRenamed("v", "w"), "p_type")
    return pairs.groupBy("v").agg(F.count_if(names.venues_differ(F.col("v"), F.col("w"))).alias("n"))


@register(
    """
    SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_nationkey <> c_nationkey"""
)
def cited_against_truth(spark, sf_dir):
    from citelake.operators.matching import cited_against_truth as compare

    cited = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"))
    truth = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("nation"))
    found = compare(cited, truth, "k", ["nation"]).where(F.size("wrong") > 0)
    return found.select(F.col("k").alias("s_suppkey"), F.col("k").alias("c_custkey"))


@register(
    """SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT s_suppkey, min(s_name) FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1"""
)
def insert_missing(spark, sf_dir):
    base = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    return deltas.insert_missing(base, rows, ["k"])
