"""Repairs of parsed references on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import repairs
from citelake.plans.tables import table
from citelake.registry import register

_VENUES = {
    "p_name": "p_name",
    "'Tian, \"' || p_name || '\" in ' || p_brand || ' Journal, 2026, notes'": "p_brand || ' Journal'",
    "'“' || p_name || '” ICLR 2024'": "'ICLR 2024'",
    "'\"' || p_name || '\".'": "''",
}


@register(
    f"SELECT p_partkey, [{', '.join(_VENUES.values())}][p_partkey % {len(_VENUES)} + 1] AS venue FROM part"
)
def venues_without_tails(spark, sf_dir):
    written = F.get(F.array(*map(F.expr, _VENUES)), (F.col("p_partkey") % len(_VENUES)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", repairs.venue_without_tail(written).alias("venue"))


@register(
    """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_type WHEN 1 THEN p_name || ' as a title' WHEN 2 THEN '' ELSE p_name END AS title,
           CASE WHEN p_partkey % 4 = 3 THEN p_type ELSE 'Proceedings of the ' || p_brand END AS venue, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 0 END AS INT) AS n_authors FROM part"""
)
def swapped_fields(spark, sf_dir):
    key, none = F.col("p_partkey") % 4, F.array().cast("array<string>")
    title = F.when(key == 3, F.col("p_name")).otherwise(F.concat(F.lit("Proceedings of the "), F.col("p_brand")))
    authors = F.when(key == 0, F.array("p_name", "p_type")).when(key == 3, F.array(F.lit("A B"))).otherwise(none)
    venue = F.when(key == 1, F.concat(F.col("p_name"), F.lit(" as a title"))).when(key == 3, F.col("p_type")).otherwise("x")
    fixed = repairs.fixed_fields(title, authors, venue)
    rows = table(spark, sf_dir, "part").select("p_partkey", fixed.alias("f"))
    return rows.select("p_partkey", "f.title", "f.venue", F.size("f.authors").alias("n_authors"))


@register(
    """
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '|et al.' ELSE p_name END AS people,
           CASE p_partkey % 3 WHEN 0 THEN '10.48550/arxiv.2101.' || lpad(CAST(p_partkey % 100000 AS VARCHAR), 5, '0') ELSE '10.48550/arXiv.2101' END AS doi FROM part"""
)
def restored_references(spark, sf_dir):
    key = F.col("p_partkey")
    number = F.lpad((key % 100000).cast("string"), 5, "0")
    doi = F.concat(F.lit("10.48550/arXiv.2101."), number)
    source = F.when(key % 3 == 0, F.concat(F.upper("p_name"), F.lit(",\n et  al. A title. "), doi)).otherwise(
        F.concat(F.col("p_name"), F.lit(", Bo Chen. A title. "), doi, F.lit(" 10.48550/arXiv.2101.99998 and 10.48550/arXiv.2101.99999"))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array("p_name").alias("a"), source.alias("s"))
    people = repairs.with_et_al(F.col("a"), F.col("s"))
    return rows.select("p_partkey", F.array_join(people, "|").alias("people"), repairs.whole_doi(F.lit("10.48550/arXiv.2101"), F.col("s")).alias("doi"))


@register(
    """
    SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AS as_cited FROM part"""
)
def references_found_as_cited(spark, sf_dir):
    key = F.col("p_partkey")
    verdict = F.when(key % 2 == 0, "LIKELY").otherwise("UNLIKELY")
    found = F.when(key % 3 == 0, F.concat(F.col("p_name"), F.lit(" x"))).otherwise(F.upper("p_name"))
    year = F.when(key % 5 == 0, "1999").otherwise("published 2001")
    people = F.array(F.lit("Ann Lee")), F.array(F.lit("Lee, A."))
    hit = repairs.found_as_cited(verdict, F.lit("http://x"), F.col("p_name"), people[0], F.lit(2001), found, people[1], year)
    return table(spark, sf_dir, "part").select("p_partkey", hit.alias("as_cited"))


@register(
    r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z][A-Za-z''-]*')) AS n, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS w FROM t)
    SELECT doc_id, n < 300 OR len(w) = 0 OR 1 - len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]+[.,;:!?]?'))) / len(w) > 0.40 AS abstains FROM w"""
)
def abstaining_texts(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", repairs.abstains(text).alias("abstains"))


@register(
    """
    SELECT p_partkey, '1=' || p_name || ';2=' || p_type || ' more' AS entries, '(Lee, 2001)=inproceedings=2001;[x]=article=-1' AS natbib FROM part"""
)
def bibliography_entries(spark, sf_dir):
    bbl = F.concat(F.lit("intro\n[2] "), F.col("p_type"), F.lit("\n more\n]\n[1] "), F.col("p_name"), F.lit("\nAppendix\n[x] not"))
    tex = F.concat(F.lit("\\bibitem[(Lee, 2001)]{k} In Proceedings of "), F.col("p_name"), F.lit(", 2001.\n\\bibitem[[x]]{l} Journal of "), F.col("p_type"), F.lit("\n\\end{thebibliography} rest"))
    rows = F.transform(repairs.numbered_bbl_entries(bbl), lambda r: F.concat_ws("=", r["n"].cast("string"), r["entry"]))
    labels = F.transform(repairs.natbib_entries(tex), lambda r: F.concat_ws("=", r["label"], r["kind"], F.coalesce(r["year"], F.lit(-1)).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(rows, ";").alias("entries"), F.array_join(labels, ";").alias("natbib"))
