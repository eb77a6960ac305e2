"""Issues of references that a citation style explains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citelake.functions.names import venue_words, venues_differ
from citelake.functions.text import fold_diacritics, normalize_doi, same_author, strip_latex, title_key_spaced, year_in

#: Authors that a style names at most, and the number of authors from which it
#: shortens a list. The other known styles, ``bibtex`` and ``plaintext``, name all.
ET_AL = {"apa": (20, 21), "mla": (1, 3), "chicago": (1, 4), "ieee": (6, 7), "vancouver": (6, 7), "bibitem": (6, 7)}
_PREPRINT = r"(?i)arxiv|biorxiv|medrxiv|ssrn|preprint|\bcorr\b"


def shortened_by_style(n_cited: Column, n_actual: Column, style: Column, rules: dict[str, tuple[int, int]] = ET_AL) -> Column:
    """Whether a list of ``n_cited`` of ``n_actual`` authors is as the style has it; further
    styles come in ``rules``, an unknown style explains nothing."""
    if not rules:
        return F.lit(False)
    named = F.create_map(*[x for s, (most, _) in rules.items() for x in (F.lit(s), F.lit(most))])
    start = F.create_map(*[x for s, (_, least) in rules.items() for x in (F.lit(s), F.lit(least))])
    fits = (n_cited <= F.try_element_at(named, style)) & (n_actual >= F.try_element_at(start, style))
    return F.coalesce(fits, F.lit(False))


def _people(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?i)[;,]\s*(?:and\s+)?|\s+and\s+"), F.trim)
    return F.filter(parts, lambda p: p != "")


def _same_people(cited: Column, actual: Column) -> Column:
    """Each person of the shorter list is one of the longer."""
    a, b = _people(cited), _people(actual)

    def within(few, many):
        return (F.size(few) > 0) & F.forall(few, lambda p: F.exists(many, lambda q: same_author(p, q)))

    return F.when(F.size(a) <= F.size(b), within(a, b)).otherwise(within(b, a))


def _pages(text: Column) -> Column:
    numbers = F.slice(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), 1, 2)
    return F.transform(numbers, lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))


def _title(text: Column) -> Column:
    return title_key_spaced(fold_diacritics(strip_latex(text)))


def cosmetic(kind: Column, cited: Column, actual: Column) -> Column:
    """Whether two values of a field say the same in another form; false for kinds of issues
    that aren't known and where either value is missing."""
    preprint = cited.rlike(_PREPRINT) | actual.rlike(_PREPRINT)
    words = venue_words(cited)
    same_venue = (F.size(words) > 0) & ((words == venue_words(actual)) | (~preprint & (F.size(venue_words(actual)) > 0) & ~venues_differ(cited, actual)))
    same = (
        F.when(kind == "title", _title(cited) == _title(actual))
        .when(kind == "year", year_in(cited) == year_in(actual))
        .when(kind.isin("venue", "journal", "booktitle"), same_venue)
        .when(kind == "doi", normalize_doi(cited) == normalize_doi(actual))
        .when(kind.isin("page", "pages", "page_range"), _pages(cited) == _pages(actual))
        .when(kind.isin("author", "authors"), _same_people(cited, actual))
    )
    return F.coalesce(same, F.lit(False))


def issues_for_style(issues: Column, style: Column, rules: dict[str, tuple[int, int]] = ET_AL) -> Column:
    """An array of ``struct<kind, cited, actual, n_cited, n_actual>`` without the issues that
    the style makes or that are of form alone. Counts of authors may be null: they are then
    counted from the values. A null array stays null."""

    def stays(i):
        kind = F.lower(F.coalesce(i["kind"], F.lit("")))
        n_cited = F.coalesce(i["n_cited"], F.size(_people(i["cited"])))
        n_actual = F.coalesce(i["n_actual"], F.size(_people(i["actual"])))
        short = kind.isin("author", "authors", "author_count") & shortened_by_style(n_cited, n_actual, style, rules)
        return ~(short | cosmetic(kind, i["cited"], i["actual"]))

    return F.filter(issues, stays)
