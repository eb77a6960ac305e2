"""Reference results of checks: buckets, counters, filters, orderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.scoring import classify
from citelake.operators.deltas import latest_wins

FINAL = ("verified", "error", "warning", "suggestion", "unverified", "hallucination")


def effective_status(status: Column, pending: Column, assessed: Column, found_as_cited: Column, has: dict[str, Column], complete: Column) -> Column:
    """What a reference counts as: an open assessment is still checking, as is an unverified
    reference that none has been made of while the check runs; what a search found as cited
    is verified, or a suggestion where there is one; then a fabrication stays one, issues of a
    kind decide over the stored status, and a stored kind without its issues is verified.
    Anything unfinished is unchecked once the check is complete."""
    low = F.lower(F.trim(status))
    return (
        F.when(pending & ~assessed, "checking")
        .when((low == "unverified") & ~assessed & ~complete, "checking")
        .when((low == "hallucination") & found_as_cited, "verified")
        .when(low == "hallucination", "hallucination")
        .when(found_as_cited, F.when(has["suggestion"], "suggestion").otherwise("verified"))
        .when(has["error"], "error")
        .when(has["warning"], "warning")
        .when(has["suggestion"], "suggestion")
        .when(low.isin("error", "warning", "suggestion"), "verified")
        .when(low.isin(*FINAL), low)
        .when(complete, "unchecked")
        .when(low == "pending", "pending")
        .otherwise("checking")
    )


def buckets(results: DataFrame, check: str, index: str, seq: str, issues: str, fabricated: str) -> DataFrame:
    """Counters per check: of each index the last result counts; fabricated references add
    no errors or warnings."""
    last = latest_wins(results, [check, index], [F.col(seq)])
    status = F.when(F.col(fabricated), "hallucination").otherwise(classify(F.col(issues)))

    def of(severity):
        one = F.size(F.filter(issues, lambda i: (i["severity"] == severity) & (i["type"] != "unverified")))
        return F.coalesce(F.sum(F.when(F.col(fabricated), 0).otherwise(F.greatest(one, F.lit(0)))), F.lit(0))

    rows = last.withColumn("_s", status)
    return rows.groupBy(check).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("_s") == s).alias(f"n_{s}") for s in FINAL],
        of("error").alias("errors"),
        of("warning").alias("warnings"),
    )


def issue_histogram(results: DataFrame, issues: str) -> DataFrame:
    """``severity:type`` counts over all issues."""
    each = results.select(F.explode(issues).alias("i"))
    return each.groupBy(F.concat_ws(":", "i.severity", "i.type").alias("key")).agg(F.count("*").alias("count"))


def sorted_issues(issues: Column) -> Column:
    """Warnings, errors, then the rest; stable."""
    rank = lambda i: F.when(i["severity"] == "warning", 0).when(i["severity"] == "error", 1).otherwise(2)
    ranked = F.transform(issues, lambda i, k: F.struct(rank(i).alias("r"), k.alias("k"), i.alias("i")))
    return F.transform(F.array_sort(ranked), lambda x: x["i"])


def stale(checks: DataFrame, active: DataFrame, check: str, done: str, total: str, last: str, as_of: Column, after_seconds: int = 180) -> DataFrame:
    """Open checks that are finished or idle, other than the active ones."""
    idle = F.timestamp_diff("SECOND", F.col(last), as_of) >= after_seconds
    finished = (F.col(total) > 0) & (F.col(done) >= F.col(total))
    return checks.where(finished | idle).join(active.select(check), check, "left_anti")


def wrong_paper(anchored: Column, shared_surnames: Column, cited_tokens: Column, found_tokens: Column, year_gap: Column, venue_differs: Column) -> Column:
    """Whether a match is another paper: never for one found by identifier."""
    strange = (shared_surnames == 0) & ((year_gap >= 5) | (cited_tokens <= 3) | ((year_gap >= 2) & venue_differs))
    short = (cited_tokens <= 3) & (found_tokens >= 3 * cited_tokens) & venue_differs
    return ~anchored & F.coalesce(strange | short, F.lit(False))


def trustworthy(verified: Column, sources: Column, shared: Column) -> Column:
    return verified | (F.size(sources) >= 2) | (shared >= 2) | ~(F.array_join(sources, ",") == "llm")


def body_lines(text: Column, least_words: int = 300) -> Column:
    """Without licence, copyright, mail and DOI lines, if enough words are left; else as it is."""
    noise = r"(?i)\b(?:licen[cs]ed? under|copyright|all rights reserved|©)|\S+@\S+\.\S+|\bdoi:?\s*10\.|https?://doi\.org"
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(noise)), "\n")
    return F.when(F.regexp_count(kept, F.lit(r"\S+")) >= least_words, kept).otherwise(text)


def merge_progress(existing: DataFrame, incoming: DataFrame, key: str, status: str) -> DataFrame:
    """Incoming rows, but a row that has left ``pending`` never goes back to it; rows that
    only the existing side has stay."""
    old = existing.select(key, F.struct(*existing.columns).alias("_old"))
    new = incoming.select(key, F.struct(*existing.columns).alias("_new"))
    both = old.join(new, key, "full")
    keep_old = F.col("_new").isNull() | (F.col("_old").isNotNull() & (F.col(f"_new.{status}") == "pending") & (F.col(f"_old.{status}") != "pending"))
    return both.select(F.when(keep_old, F.col("_old")).otherwise(F.col("_new")).alias("r")).select("r.*")


def ordered_references(refs: DataFrame, mode: str, index: str = "index") -> DataFrame:
    """citation, alphabetical (by the first author's surname), year or -year order."""
    from citelake.functions.text import surname

    keys = {
        "citation": [F.col(index).asc_nulls_last()],
        "alphabetical": [surname(F.get("authors", F.lit(0))).asc_nulls_last(), F.col(index).asc_nulls_last()],
        "year": [F.col("year").asc_nulls_last(), F.col(index).asc_nulls_last()],
        "-year": [F.col("year").desc_nulls_last(), F.col(index).asc_nulls_last()],
    }
    return refs.orderBy(*keys[mode])


def explained_by_versions(issues: DataFrame, versions: DataFrame, work: str, field: str, cited: str) -> DataFrame:
    """Issues whose cited value is that of an older version of the work become warnings
    that name both versions. ``versions``: (work, field, version, value)."""
    latest = versions.groupBy(work).agg(F.max("version").alias("_latest"))
    old = versions.groupBy(work, field, F.col("value").alias(cited)).agg(F.max("version").alias("_version"))
    joined = issues.join(old, [work, field, cited], "left").join(latest, work, "left")
    explained = F.col("_version") < F.col("_latest")
    note = F.concat(F.lit("v"), F.col("_version").cast("string"), F.lit(" vs v"), F.col("_latest").cast("string"), F.lit(" update"))
    return joined.withColumns(
        {
            "severity": F.when(explained, "warning").otherwise(F.col("severity")),
            "details": F.when(explained, note).otherwise(F.col("details")),
        }
    ).drop("_version", "_latest")


def better_of(first: DataFrame, second: DataFrame, key: str, issues: str) -> DataFrame:
    """Per key the second attempt where it has fewer issues, else the first."""
    a = first.select(key, F.struct(*first.columns).alias("_a"))
    b = second.select(key, F.struct(*first.columns).alias("_b"))
    both = a.join(b, key, "left")
    fewer = F.coalesce(F.size(f"_b.{issues}") < F.size(f"_a.{issues}"), F.lit(False)) & F.col("_b").isNotNull()
    return both.select(F.when(fewer, F.col("_b")).otherwise(F.col("_a")).alias("r")).select("r.*")
