"""Payloads of several sources, and issues under a style, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.functions import enrichment, styles
from citelake.plans.tables import spread, table
from citelake.registry import register


def _payload() -> Column:
    """A part as one of four sources would return it: an open graph of works, a registry of
    identifiers, a scholar's index, and a page without anything."""
    key, size = F.col("p_partkey"), F.col("p_size")
    doi = F.concat(F.lit("10.1/"), key.cast("string"))
    work = F.struct(
        F.concat(F.lit("https://openalex.org/W"), key.cast("string")).alias("id"),
        F.lower("p_type").alias("type"),
        size.alias("cited_by_count"),
        (size * 2).cast("string").alias("citationCount"),
        F.struct(F.struct(F.col("p_brand").alias("display_name")).alias("source")).alias("primary_location"),
        F.format_string("20%02d-02-03", size).alias("publication_date"),
        F.array(F.struct(F.struct(F.col("p_name").alias("display_name")).alias("author"))).alias("authorships"),
        F.struct(F.concat(F.lit("https://doi.org/"), doi).alias("doi")).alias("ids"),
    )
    registered = F.struct(
        F.lit("posted-content").alias("type"),
        size.alias("is-referenced-by-count"),
        F.array(F.col("p_brand"), F.lit("other")).alias("container-title"),
        F.struct(F.array(F.array(2000 + size, F.lit(12), F.lit(25))).alias("date-parts")).alias("issued"),
        F.array(
            F.struct(F.split("p_name", " ")[0].alias("given"), F.split("p_name", " ")[1].alias("family")),
            F.struct(F.lit("").alias("given"), F.lit("Last").alias("family")),
        ).alias("author"),
        doi.alias("DOI"),
    )
    scholar = F.struct(
        (-size).alias("citationCount"),
        F.lit(" ").alias("venue"),
        F.col("p_brand").alias("journal"),
        (2000 + size).alias("year"),
        F.array(F.struct(F.col("p_name").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"),
        F.struct(F.concat(F.lit("doi:"), doi).alias("DOI")).alias("externalIds"),
    )
    kind = key % 4
    return F.when(kind == 0, F.to_json(work)).when(kind == 1, F.to_json(registered)).when(kind == 2, F.to_json(scholar)).otherwise("[broken")


@register(
    """
    WITH p AS (SELECT *, p_partkey % 4 AS k FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN lower(p_type) WHEN 1 THEN 'posted-content' END AS kind,
           CASE k WHEN 0 THEN CAST(2 * p_size AS BIGINT) WHEN 1 THEN CAST(p_size AS BIGINT) END AS cited_by,
           CASE WHEN k < 3 THEN p_brand END AS venue,
           CASE k WHEN 0 THEN strftime(make_date(2000 + p_size, 2, 3), '%b %-d, %Y') WHEN 1 THEN strftime(make_date(2000 + p_size, 12, 25), '%b %-d, %Y')
                  WHEN 2 THEN CAST(2000 + p_size AS VARCHAR) END AS published,
           CASE k WHEN 1 THEN concat_ws(' ', split_part(p_name, ' ', 1), nullif(split_part(p_name, ' ', 2), '')) || ';Last' WHEN 3 THEN NULL ELSE p_name END AS authors,
           CASE WHEN k < 3 THEN '10.1/' || p_partkey END AS doi, CASE WHEN k = 0 THEN 'W' || p_partkey END AS openalex_id,
           CASE k WHEN 0 THEN 'doi,libkey,openalex,worldcat' WHEN 3 THEN '' ELSE 'doi,libkey,worldcat' END AS links
    FROM p"""
)
def enriched_records(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", enrichment.enrichment(_payload()).alias("e"))
    names = F.transform(F.col("e.authors"), lambda a: a["name"])
    kinds = F.array_sort(F.map_keys(F.coalesce(enrichment.links(F.col("e")), F.create_map().cast("map<string,string>"))))
    return rows.select(
        "p_partkey",
        F.col("e.publication_type").alias("kind"),
        F.col("e.cited_by_count").alias("cited_by"),
        F.col("e.venue").alias("venue"),
        F.col("e.publication_date").alias("published"),
        F.array_join(names, ";").alias("authors"),
        F.col("e.doi").alias("doi"),
        F.col("e.openalex_id").alias("openalex_id"),
        F.array_join(kinds, ",").alias("links"),
    )


@register(
    """
    WITH w AS (SELECT l_partkey AS k, max(CAST(l_quantity AS BIGINT)) AS n FROM lineitem GROUP BY 1)
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce(n, 0) WHEN p_partkey % 3 = 1 THEN CAST(p_size AS BIGINT) ELSE n END AS cited_by,
           CASE WHEN p_partkey % 3 = 1 THEN p_name WHEN n IS NOT NULL THEN 'line ' || n END AS abstract
    FROM part LEFT JOIN w ON k = p_partkey"""
)
def backfilled_records(spark, sf_dir):
    """Counts of 0 and missing fields are filled by DOI from what another source has."""
    key = F.col("p_partkey")
    doi = F.concat(F.lit("10.1/"), key.cast("string"))
    count = F.when(key % 3 == 0, 0).when(key % 3 == 1, F.col("p_size"))
    own = F.to_json(F.struct(doi.alias("doi"), count.alias("citationCount"), F.when(key % 3 == 1, F.col("p_name")).alias("abstract")))
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", enrichment.enrichment(own).alias("e"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.col("l_quantity").cast("bigint")).alias("n"))
    other = F.to_json(
        F.struct(
            F.concat(F.lit("https://doi.org/10.1/"), F.col("l_partkey").cast("string")).alias("doi"),
            F.col("n").alias("cited_by_count"),
            F.concat(F.lit("<p>line  "), F.col("n").cast("string"), F.lit("</p>")).alias("abstract"),
        )
    )
    found = lines.select(enrichment.enrichment(other).alias("other"))
    out = enrichment.backfill(rows, found, "e", "other")
    return out.select("p_partkey", F.col("e.cited_by_count").alias("cited_by"), F.col("e.abstract").alias("abstract"))


@register(
    """
    WITH o AS (SELECT l_orderkey, CAST(count(*) AS INT) AS n, min(l_linenumber) AS one FROM lineitem GROUP BY 1),
    s AS (SELECT l_orderkey, n, ['mla', 'chicago', 'ieee', 'bibtex'][l_orderkey % 4 + 1] AS style FROM o)
    SELECT l_orderkey, style,
           CASE WHEN (style = 'mla' AND n >= 3) OR (style = 'chicago' AND n >= 4) OR (style = 'ieee' AND n >= 7) THEN '' ELSE 'author_count,' END
           || CASE WHEN n % 2 = 0 THEN 'year,' ELSE '' END || 'pages' AS left_over FROM s"""
)
def issues_left_by_style(spark, sf_dir):
    """An order's lines as the authors of a reference that names one of them."""
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    style = F.get(F.array(*map(F.lit, ("mla", "chicago", "ieee", "bibtex"))), (F.col("l_orderkey") % 4).cast("int"))
    none, key = F.lit(None), F.col("l_orderkey").cast("string")

    def issue(kind, cited, actual, n_cited=none, n_actual=none):
        return F.struct(
            F.lit(kind).alias("kind"), cited.cast("string").alias("cited"), actual.cast("string").alias("actual"),
            n_cited.cast("int").alias("n_cited"), n_actual.cast("int").alias("n_actual"),
        )

    issues = F.array(
        issue("author_count", none, none, F.lit(1), F.col("n")),
        issue("year", F.lit("(2019)"), 2019 + (F.col("n") + 1) % 2),
        issue("title", F.concat(F.lit("Déjà vu: "), key), F.concat(F.lit("Deja Vu - "), key)),
        issue("pages", F.concat(F.lit("pp. "), key, F.lit("--"), key), F.concat(key, F.lit("-"), key, F.lit("1"))),
    )
    left = F.transform(styles.issues_for_style(issues, style), lambda i: i["kind"])
    return orders.select("l_orderkey", style.alias("style"), F.array_join(left, ",").alias("left_over"))
