"""Column functions: identity keys, statuses, bands and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.functions.text import arxiv_id, normalize_doi, surname, title_key_spaced


def rate(part: Column, whole: Column, places: int = 2) -> Column:
    """Percent; null for no whole."""
    return F.when(whole != 0, F.round(part * 100.0 / whole, places))


def safe_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def health_score(total: Column, verified: Column, errors: Column, warnings: Column, fabricated: Column) -> Column:
    """0 to 100, null without references: 70 for the verified share, 30 for the clean share,
    less 5 for the warned share and less 8 and 4 a fabricated one (20 at most)."""
    clean = F.greatest(F.lit(0.0), (total - errors - fabricated) / total)
    raw = verified / total * 70 + clean * 30 - warnings / total * 5
    penalty = F.when(fabricated > 0, F.least(F.lit(20), 8 + fabricated * 4)).otherwise(0)
    return F.when(total > 0, F.greatest(F.lit(0), F.least(F.lit(100), F.bround(raw - penalty))).cast("int"))


def health_grade(score: Column) -> Column:
    return (
        F.when(score.isNull(), "n/a")
        .when(score >= 90, "Excellent")
        .when(score >= 70, "Good")
        .when(score >= 50, "Fair")
        .when(score >= 30, "Poor")
        .otherwise("Critical")
    )


def band(score: Column, high: float = 0.85, medium: float = 0.30) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "low")


BANDS = ("low", "medium", "high")


def combine_bands(bands: Column) -> Column:
    """The lowest band of an array; inconclusive when one is missing or unknown."""
    ranks = F.transform(bands, lambda b: F.when(b == "low", 0).when(b == "medium", 1).when(b == "high", 2))
    known = F.forall(ranks, lambda r: r.isNotNull()) & (F.size(bands) > 0)
    names = F.array(*map(F.lit, BANDS))
    return F.when(known, F.get(names, F.array_min(ranks))).otherwise("inconclusive")


def year_gap_score(cited: Column, found: Column, first_author_agrees: Column | None = None) -> Column:
    """+0.1 for equal years, +0.05 for one apart, 0 to three, -0.25 to five, -0.45 beyond;
    +0.2 where the first author agrees and the gap is three at most."""
    gap = F.abs(cited - found)
    score = F.when(gap == 0, 0.1).when(gap == 1, 0.05).when(gap <= 3, 0.0).when(gap <= 5, -0.25).when(gap > 5, -0.45)
    score = F.coalesce(score, F.lit(0.0))
    if first_author_agrees is not None:
        score = score + F.when(first_author_agrees & (F.coalesce(gap, F.lit(0)) <= 3), 0.2).otherwise(0.0)
    return score


def identity_key(title: Column, authors: Column, year: Column, doi: Column, arxiv: Column) -> Column:
    """doi, else arXiv id, else title and year, else a title of 12 or more characters with
    the first surname, else a hash of what there is; null for nothing."""
    doi, arxiv = normalize_doi(doi), arxiv_id(arxiv)
    key, year = F.nullif(title_key_spaced(title), F.lit("")), F.nullif(year, F.lit(0))
    first = F.coalesce(surname(F.get(authors, F.lit(0))), F.lit(""))
    bits = F.concat_ws("|", F.substring(title, 1, 200), F.get(authors, F.lit(0)), year.cast("string"))
    return (
        F.when(doi.isNotNull(), F.concat(F.lit("doi:"), doi))
        .when(arxiv.isNotNull(), F.concat(F.lit("arxiv:"), arxiv))
        .when(key.isNotNull() & year.isNotNull(), F.concat_ws(":", F.lit("title"), key, year.cast("string")))
        .when(F.length(key) >= 12, F.concat_ws(":", F.lit("title"), key, F.lit("_"), F.nullif(first, F.lit(""))))
        .when(bits != "", F.concat(F.lit("hash:"), F.substring(F.sha1(bits.cast("binary")), 1, 16)))
    )


def paper_key(arxiv: Column, doi: Column, title: Column, url: Column) -> Column:
    return F.coalesce(
        F.concat(F.lit("arxiv:"), arxiv_id(arxiv)),
        F.concat(F.lit("doi:"), normalize_doi(doi)),
        F.concat(F.lit("title:"), F.nullif(title_key_spaced(title), F.lit(""))),
        F.concat(F.lit("url:"), F.nullif(F.lower(F.trim(url)), F.lit(""))),
    )


def paper_group(key: Column, title: Column, row_id: Column) -> Column:
    """The identity that history rows of one paper share: its key, else its title, else the
    row itself."""
    real = F.nullif(F.lower(F.trim(key)), F.lit(""))
    named = F.lower(F.trim(title))
    named = F.when(~named.isin("", "unknown", "untitled", "unknown title"), named)
    return (
        F.when(real.isNotNull(), F.concat(F.lit("k:"), real))
        .when(named.isNotNull(), F.concat(F.lit("t:"), named))
        .otherwise(F.concat(F.lit("c:"), row_id.cast("string")))
    )


def cache_key(version: int, *parts: Column) -> Column:
    """SHA-256 over the logic version and the parts, with a separator no text holds."""
    values = [F.coalesce(F.lower(F.trim(p.cast("string"))), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\x00", F.lit(str(version)), *values), 256)


def classify(issues: Column) -> Column:
    """error > warning > suggestion > verified by its URL > unverified > verified, of an array
    of ``struct<severity, type, details>``."""

    def any_of(severity):
        return F.exists(
            issues,
            lambda i: (i["severity"] == severity)
            & (i["type"] != "unverified")
            & ~((i["type"] == "url") & F.contains(F.lower(i["details"]), F.lit("url references paper"))),
        )

    unverified = F.exists(issues, lambda i: i["type"] == "unverified")
    by_url = F.exists(issues, lambda i: F.contains(F.lower(i["details"]), F.lit("url references paper")))
    return (
        F.when(F.coalesce(F.size(issues), F.lit(0)) <= 0, "verified")
        .when(any_of("error"), "error")
        .when(any_of("warning"), "warning")
        .when(any_of("suggestion"), "suggestion")
        .when(unverified & by_url, "verified")
        .when(unverified, "unverified")
        .otherwise("verified")
    )


def triage(status: Column, overlap: Column) -> Column:
    """Whether a reference's existence is in doubt: skip, resolved or needs a look, from its
    status and the share of authors that agree with the best match."""
    low = F.when(status == "unverified", 0.6).otherwise(0.4)
    return (
        F.when(status.isin("verified", "suggestion", "warning") & overlap.isNull(), "skip")
        .when(overlap.isNull(), "needs_look")
        .when(overlap < low, "needs_look")
        .otherwise("resolved")
    )


def model_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """US dollars at rates a million tokens, 1 and 4 where unknown."""
    return (tokens_in * F.coalesce(rate_in, F.lit(1.0)) + tokens_out * F.coalesce(rate_out, F.lit(4.0))) / 1e6


def visible(owner: Column, team: Column, user: int | None, teams: list | None = None) -> Column:
    """Rows a user may read: their own and those of their teams; all without a user."""
    if user is None:
        return F.lit(True)
    own = owner == user
    return F.coalesce(own | team.isin(*teams) if teams else own, F.lit(False))


def cancelled(status: Column, wanted: Column, final: tuple[str, ...]) -> Column:
    """``cancelled`` for wanted rows that aren't in a final status."""
    return F.when(wanted & ~status.isin(*final), "cancelled").otherwise(status)
