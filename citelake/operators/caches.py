"""Cached and merged records: fuzzy look-ups, sources side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import title_key_spaced

#: Openings of notes on a work, which are not the work.
NOTES = (
    "correction to",
    "erratum",
    "retraction",
    "retracted",
    "withdrawn",
    "author correction",
    "publisher correction",
    "reply to",
    "comment on",
    "response to",
    "addendum",
)


def title_prefix(title: Column) -> Column:
    """80 characters of a spaced key of 100 or more, 60 of others; null below 12 and for notes."""
    key = title_key_spaced(title)
    note = key.rlike("^(?:" + "|".join(NOTES) + ")")
    return F.when((F.length(key) >= 12) & ~note, F.left(key, F.when(F.length(key) >= 100, 80).otherwise(60)))


def fuzzy_cached(refs: DataFrame, cache: DataFrame, ref: str, entry: str) -> DataFrame:
    """The best cached entry of each reference: titles agree in their prefix (both sides
    normalised), surnames are equal, DOIs agree where both have one, years are at most one
    apart; 1, and 2 for the same year or 1 for the next, and 1 for a verified entry. A year
    on one side alone needs an entry with an identifier. Ties go to the smaller entry.

    Both sides have ``title, surname, year, doi``; entries also ``arxiv, status``. An entry
    meets references under either length of prefix, by equality. Of the entries that a
    reference can't tell apart (prefix, surname, year, DOI as far as it counts) one can win,
    a verified one before others: a reference meets eight of these at most.
    """

    def slot(kind, year=None, points=None):
        out = [F.lit(kind).alias("kind"), F.coalesce(year if year is not None else F.lit(None), F.lit(0)).cast("long").alias("at")]
        more = [] if points is None else [F.lit(points).alias("points")]
        return F.struct(*out, *more).cast("struct<kind: string, at: bigint" + (", points: int>" if more else ">"))

    def by_doi(kind, doi=None):
        return F.struct(F.lit(kind).alias("doi_kind"), F.lit("").alias("doi") if doi is None else F.lower(doi).alias("doi")).cast("struct<doi_kind: string, doi: string>")

    year, doi = F.col("_year"), F.col("_doi")
    asks = refs.select(ref, title_prefix(F.col("title")).alias("p"), *[F.col(c).alias(f"_{c}") for c in ("surname", "year", "doi")])
    dated = F.array(slot("at", year, 2), slot("at", year - 1, 1), slot("at", year + 1, 1), slot("undated, anchored", None, 0))
    # 2 for the same year: two missing years are no same year
    undated = F.array(slot("dated, anchored", None, 0), slot("undated", None, 0))
    asks = asks.where("p is not null and _surname <> ''").select(
        ref, "p", "_surname", F.explode(F.when(year.isNotNull(), dated).otherwise(undated)).alias("slot"), F.when(doi.isNull(), F.array(by_doi("all"))).otherwise(F.array(by_doi("none"), by_doi("same", doi))).alias("dois")
    )
    asks = asks.select(ref, "p", "_surname", "slot.*", F.explode("dois").alias("d")).select(ref, "p", "_surname", "kind", "at", "points", "d.*")

    key = title_key_spaced(F.col("title"))
    both = F.array_distinct(F.array(F.left(key, F.lit(60)), F.left(key, F.lit(80))))
    anchored = F.col("doi").isNotNull() | F.col("arxiv").isNotNull()
    has_year = F.col("year").isNotNull()
    slots = F.array_compact(
        F.array(
            F.when(has_year, slot("at", F.col("year"))),
            F.when(has_year & anchored, slot("dated, anchored")),
            F.when(~has_year, slot("undated")),
            F.when(~has_year & anchored, slot("undated, anchored")),
        )
    )
    dois = F.array(by_doi("all"), F.when(F.col("doi").isNull(), by_doi("none")).otherwise(by_doi("same", F.col("doi"))))
    worth = F.struct(F.when(F.col("status") == "verified", -1).otherwise(0).alias("v"), entry).alias("w")
    have = cache.select(F.explode(both).alias("p"), F.col("surname").alias("_surname"), slots.alias("slots"), dois.alias("dois"), worth)
    have = have.select("p", "_surname", F.explode("slots").alias("slot"), "dois", "w").select("p", "_surname", "slot.*", F.explode("dois").alias("d"), "w")
    same = ["p", "_surname", "kind", "at", "doi_kind", "doi"]
    first = have.select("p", "_surname", "kind", "at", "d.*", "w").groupBy(*same).agg(F.min("w").alias("w"))
    scored = asks.join(first, same).select(ref, F.col(f"w.{entry}").alias(entry), (1 + F.col("points") - F.col("w.v")).alias("score"))
    best = scored.groupBy(ref).agg(F.min(F.struct((-F.col("score")).alias("s"), entry)).alias("b"))
    return best.select(ref, F.col(f"b.{entry}").alias(entry), (-F.col("b.s")).cast("int").alias("score"))


def with_cached_status(papers: DataFrame, cache: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """Papers with the cached status; without one, verified for a paper id and another id,
    unverified for a paper id alone, else unknown. The ``most`` most cited, ties by key."""
    seen = cache.select(key, F.col("status").alias("_s"), "times_seen")
    status = (
        F.when(F.col("_s").isNotNull(), F.col("_s"))
        .when(F.col("paper_id").isNotNull() & F.coalesce("doi", "arxiv").isNotNull(), "verified")
        .when(F.col("paper_id").isNotNull(), "unverified")
        .otherwise("unknown")
    )
    out = papers.join(seen, key, "left").withColumns({"verified_status": status, "times_seen": F.coalesce("times_seen", F.lit(0))}).drop("_s")
    return out if most is None else out.orderBy(F.desc("citations"), key).limit(most)


def merged_profiles(primary: DataFrame, other: DataFrame, key: str, gaps: tuple[str, ...], metrics: tuple[str, ...]) -> DataFrame:
    """Profiles of the primary source with ``gaps`` and ``metrics`` filled from the other one;
    ``metrics_source`` names it where a metric came from there. Rows of either side stay."""
    a = primary.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"_{c}") for c in gaps + metrics])
    b = other.select(key, F.lit(True).alias("_b"), *gaps, *metrics)
    filled = F.lit(False)
    for c in metrics:
        filled = filled | (F.col(f"_{c}").isNull() & F.col(c).isNotNull())
    source = F.when(F.col("_a").isNull() | filled, "other").otherwise("primary")
    return a.join(b, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in gaps + metrics], source.alias("metrics_source"))


#: Venues that say no more than that a text is a preprint.
PREPRINT_VENUES = ("arxiv", "arxiv preprint", "arxiv.org", "preprint")


def merged_sources(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Records of a preprint server with what an index adds: its paper id, a DOI where there
    is none, and, where the citation names no venue but the server, the venue of publication,
    with a warning. ``first``: title, doi, cited_venue; ``second``: paper_id, doi, venue."""
    add = second.select(key, "paper_id", F.col("doi").alias("_doi"), F.col("venue").alias("_venue"))
    cited = F.lower(F.trim(F.coalesce("cited_venue", F.lit(""))))
    real = F.lower(F.trim(F.coalesce("_venue", F.lit(""))))
    published = ((cited == "") | cited.isin(*PREPRINT_VENUES)) & (real != "") & (real != "preprint") & ~F.startswith(real, F.lit("arxiv"))
    return first.join(add, key, "left").select(
        key,
        "title",
        "paper_id",
        F.coalesce("doi", "_doi").alias("doi"),
        F.when(published, F.col("_venue")).alias("venue"),
        F.when(published, F.concat(F.lit("published at "), F.col("_venue"))).alias("warning"),
    )


def ranked_suggestions(candidates: DataFrame, ref: str, title: str, doi: str, overlap: str, most: int = 8) -> DataFrame:
    """Per reference the ``most`` candidates with the largest overlap, one of each DOI or, without
    one, title (80 characters); the first is the winner where it overlaps at all."""
    from pyspark.sql import Window

    key = F.coalesce(F.lower(doi), F.left(F.lower(title), F.lit(80)))
    one = candidates.withColumn("_k", key).groupBy(ref, "_k").agg(F.min(F.struct((-F.col(overlap)).alias("o"), F.col(title).alias("t"))).alias("b"))
    order = Window.partitionBy(ref).orderBy("b.o", "b.t", "_k")
    ranked = one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    win = (F.col("rank") == 1) & (F.col("b.o") < 0)
    return ranked.select(ref, "rank", F.col("b.t").alias(title), (-F.col("b.o")).alias(overlap), win.alias("winner"))
