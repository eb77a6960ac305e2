"""Text functions over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.operators.passages import holders
from citelake.functions import text
from citelake.plans.tables import table
from citelake.registry import register


@register(
    r"""
    SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h1,
           regexp_extract(lower(url), '^[a-z]+://(?:www\.)?([^/:?#]+)', 1) AS host,
           regexp_replace(regexp_replace(trim(url), '#.*$', ''), '[?&](?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g') AS clean
    FROM pages"""
)
def page_title_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("h1"),
        text.url_host(F.col("url")).alias("host"),
        text.clean_url(F.col("url")).alias("clean"),
    )


@register(
    r"""
    SELECT page_id, CAST(length(trim(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '\s+', ' ', 'g'))) AS INT) AS chars
    FROM pages"""
)
def page_text_length(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.strip_html(F.col("html"))).alias("chars"))


@register(
    r"""
    SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS BIGINT) AS words,
           TRY_CAST(nullif(regexp_extract(text, '\b((?:19|20)[0-9]{2})\b', 1), '') AS INT) AS year,
           CAST(length(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS INT) AS key_chars FROM documents"""
)
def document_text_features(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.count_words(t).alias("words"), text.year_in(t).alias("year"), F.length(text.title_key_spaced(t)).alias("key_chars")
    )


@register(
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, true AS same, md5(array_to_string(w, ' ')) AS digest FROM w WHERE len(w) > 0"""
)
def inverted_index_rebuild(spark, sf_dir):
    """Each document's words as a map to positions and back: ``same`` is true for all."""
    words = F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    held = docs.where(F.size("w") > 0).withColumn("index", text.inverted_index(F.col("w")))
    rebuilt = held.select("doc_id", "w", F.explode(F.array(text.text_of_inverted_index(F.col("index")))).alias("text"))
    return rebuilt.select("doc_id", (F.col("text") == F.array_join("w", " ")).alias("same"), F.md5("text").alias("digest"))


@register(
    r"""SELECT doc_id, CASE WHEN length(text) > 400 THEN regexp_replace(substr(text, 1, 400), '\s+\S*\z', '') || '…' ELSE text END AS quote FROM documents"""
)
def short_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.short_quote(F.col("text")).alias("quote"))


@register(
    """SELECT item_id, count(*) AS docs FROM (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) GROUP BY 1"""
)
def quoted_passages(spark, sf_dir):
    """Documents that hold a benchmark item, whatever its length."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return holders(docs, items).groupBy("item_id").agg(F.count("*").alias("docs"))
