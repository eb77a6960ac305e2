"""What a record of any source says, in one shape.

Payloads are JSON texts as services return them, each service with its own field names, and
some merged from several. A table of paths per field says where a field may be; the payload
is parsed once to a variant, and a field is the first path that holds something, the largest
of all (counts), or pooled over all (funders).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import let, text_of_inverted_index

#: Where sources keep a field, in order of trust.
COUNTS = {
    "cited_by_count": ("cited_by_count", "citationCount", "is-referenced-by-count", "citation_count", "numCitedBy"),
    "reference_count": ("referenceCount", "references-count", "reference_count", "numReferences"),
}
TEXTS = {
    "publication_type": ("type", "publicationVenue.type"),
    "venue": (
        "publicationVenue.name",
        "publicationVenue.display_name",
        "primary_location.source.display_name",
        "primary_location.source.name",
        "journal.name",
        "journal.display_name",
        "journal",
        "venue",
        "container-title",
        "journal-title",
        "journalName",
        "short-container-title",
    ),
    "tldr": ("tldr.text", "tldr"),
    "source_label": ("_matched_database", "_matched_checker", "source"),
}
IDS = {
    "openalex_id": ("ids.openalex", "id"),
    "venue_id": ("primary_location.source.id",),
    "pubmed_id": ("ids.pmid", "externalIds.PubMed"),
    "pmc_id": ("ids.pmcid", "externalIds.PubMedCentral"),
    "mag_id": ("ids.mag", "externalIds.MAG"),
}
DOIS = ("doi", "DOI", "ids.doi", "externalIds.DOI")
PDFS = ("openAccessPdf.url", "open_access.oa_url", "primary_location.pdf_url")
DATES = ("publication_date", "publicationDate")
YEARS = ("publication_year", "year")
AUTHORS = ("authorships", "author", "authors")
FUNDERS = ("grants", "funders", "funder")
FUNDER_NAMES = ("funder_display_name", "name", "funder", "award_id")
PREPRINTS = ("preprint", "posted-content")
#: The most fields, funders, institutions and characters of an abstract shown.
MOST_FIELDS, MOST_FUNDERS, MOST_INSTITUTIONS, MOST_ABSTRACT = 3, 5, 3, 1500


def _path(dotted: str) -> str:
    return "$" + "".join(f"['{step}']" for step in dotted.split("."))


def _string(v: Column, path: str) -> Column:
    """The trimmed string there, null for any other kind of value and for blanks."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = F.trim(F.try_variant_get(v, path, "string"))
    return F.when((kind == "STRING") & (text != ""), text)


def _scalar(v: Column, path: str) -> Column:
    """A string or whole number there, as text."""
    kind = F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    text = F.trim(F.try_variant_get(v, path, "string"))
    return F.when(kind.isin("STRING", "BIGINT") & (text != ""), text)


def _first_text(v: Column, paths: tuple[str, ...]) -> Column:
    """The first path with a string, or a list that a string begins."""
    return F.coalesce(*[x for p in paths for x in (_string(v, _path(p)), _string(v, _path(p) + "[0]"))])


def _first_scalar(v: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[_scalar(v, _path(p)) for p in paths])


def _list(v: Column, path: str) -> Column:
    none = F.array().cast("array<variant>")
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), none)


def _largest(v: Column, paths: tuple[str, ...], *more: Column) -> Column:
    """The largest count that any path gives as a number or a number's text."""

    def count(p):
        kind = F.schema_of_variant(F.try_variant_get(v, _path(p), "variant"))
        number = F.when(kind != "BOOLEAN", F.try_variant_get(v, _path(p), "string").try_cast("double"))
        return F.when((number >= 0) & (number < 2.0**63), number.cast("bigint"))

    return F.array_max(F.array(*map(count, paths), *more))


def short_id(address: Column) -> Column:
    """What stands behind the last slash of an identifier's address; null for a bare host."""
    bare = F.rtrim(address, F.lit("/"))
    host = F.lower(bare).rlike(r"(?:openalex\.org|orcid\.org|doi\.org)$")
    tail = F.element_at(F.split(bare, "/"), -1)
    return F.when(~host & (tail != ""), tail)


def bare_doi(doi: Column) -> Column:
    return F.regexp_replace(doi, "^(?:https?://doi\\.org/|doi:)", "")


def _person(a: Column) -> Column:
    whole = F.concat_ws(" ", _string(a, "$.given"), _string(a, "$.family"))
    name = F.coalesce(
        _string(a, "$.author.display_name"), _string(a, "$.author.name"), F.when(whole != "", whole), _string(a, "$.name")
    )
    orcid = F.coalesce(*[_string(a, p) for p in ("$.author.orcid", "$.ORCID", "$.orcid")])
    places = F.transform(_list(a, "$.institutions"), lambda i: _string(i, "$.display_name"))
    return F.struct(
        name.alias("name"),
        F.regexp_replace(orcid, r"^(?:https?://)?orcid\.org/", "").alias("orcid"),
        short_id(_scalar(a, "$.author.id")).alias("openalex_id"),
        _scalar(a, "$.authorId").alias("s2_id"),
        F.slice(F.array_compact(places), 1, MOST_INSTITUTIONS).alias("institutions"),
    )


def _authors(v: Column) -> Column:
    """The longest of the lists of authors, of equal ones that with more identifiers, of
    those the first; null where no list names anyone."""

    def entry(k, key):
        people = F.filter(F.transform(_list(v, _path(key)), _person), lambda p: p["name"].isNotNull())
        known = lambda p: p["orcid"].isNotNull() | p["openalex_id"].isNotNull()
        return let(
            people,
            lambda ps: F.struct(F.size(ps).alias("n"), F.size(F.filter(ps, known)).alias("ids"), F.lit(-k).alias("k"), ps.alias("people")),
        )

    best = F.array_max(F.array(*[entry(k, key) for k, key in enumerate(AUTHORS)]))
    return let(best, lambda b: F.when(b["n"] > 0, b["people"]))


def _fields_of_study(v: Column) -> Column:
    """Of scored concepts the best, else plain fields, else categories."""
    scored = F.transform(
        _list(v, "$.concepts"),
        lambda c, i: F.struct(
            (-F.try_variant_get(c, "$.score", "double")).alias("less"), i.alias("i"), _string(c, "$.display_name").alias("name")
        ),
    )
    fit = F.slice(F.array_sort(F.filter(scored, lambda c: c["less"] <= -0.3)), 1, MOST_FIELDS)
    plain = F.transform(_list(v, "$.fieldsOfStudy"), lambda x: _string(x, "$"))
    category = F.transform(_list(v, "$.s2FieldsOfStudy"), lambda x: F.coalesce(_string(x, "$.category"), _string(x, "$")))
    options = [F.transform(fit, lambda c: c["name"]), plain, F.array_distinct(category)]
    named = [F.slice(F.array_compact(x), 1, MOST_FIELDS) for x in options]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in named])


def _funders(v: Column) -> Column:
    def names(key):
        return F.transform(
            _list(v, _path(key)), lambda g: F.coalesce(*[_scalar(g, _path(n)) for n in FUNDER_NAMES], _string(g, "$"))
        )

    pooled = F.array_distinct(F.array_compact(F.concat(*map(names, FUNDERS))))
    return F.when(F.size(pooled) > 0, F.slice(pooled, 1, MOST_FUNDERS))


def abstract_of(v: Column, most: int = MOST_ABSTRACT) -> Column:
    """The start of a plain abstract without tags, else of one rebuilt from the places of its
    words."""
    plain = _string(v, "$.abstract")
    tagless = F.trim(F.regexp_replace(F.regexp_replace(plain, "<[^>]+>", " "), r"\s+", " "))
    plain = F.when(plain.contains("<") & plain.contains(">"), tagless).otherwise(plain)
    index = F.try_variant_get(v, "$.abstract_inverted_index", "map<string,array<int>>")
    rebuilt = F.trim(text_of_inverted_index(F.transform_values(index, lambda _, at: F.filter(at, lambda i: i >= 0))))
    text = F.coalesce(F.when(plain != "", plain), F.when(rebuilt != "", rebuilt))
    return F.left(text, F.lit(most))


def _date(v: Column) -> Column:
    """``Oct 1, 2021``, or what a source gives in place of a whole date, or the year."""
    given = _first_text(v, DATES)
    given = F.when(F.length(given) >= 4, given)
    day = F.left(given, F.lit(10)).try_cast("date")
    parts = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.get(_list(v, "$.issued['date-parts'][0]"), i))
    parts = F.transform(parts, lambda p: F.try_variant_get(p, "$", "int"))
    whole = let(parts, lambda p: F.concat_ws("-", F.lpad(p[0].cast("string"), 4, "0"), p[1].cast("string"), p[2].cast("string")))
    issued = F.when(whole.rlike("^[0-9]+-[0-9]+-[0-9]+$"), whole.try_cast("date"))
    alone = F.when(~whole.rlike("^[0-9]+-[0-9]+-[0-9]+$"), F.get(parts, F.lit(0)).cast("string"))

    def shown(d):
        return F.date_format(d, "MMM d, yyyy")

    return F.coalesce(F.when(day.isNotNull(), shown(day)).otherwise(given), shown(issued), alone, _first_scalar(v, YEARS))


def _biblio(v: Column) -> Column:
    page = _scalar(v, "$.page")
    ends = F.transform(F.split(page, "[-–—]", 2), lambda p: F.nullif(F.trim(p), F.lit("")))
    own = F.struct(*[_scalar(v, f"$.biblio.{n}").alias(n) for n in ("volume", "issue", "first_page", "last_page")])
    flat = F.struct(
        _scalar(v, "$.volume").alias("volume"),
        _scalar(v, "$.issue").alias("issue"),
        F.get(ends, F.lit(0)).alias("first_page"),
        F.get(ends, F.lit(1)).alias("last_page"),
    )
    nested = F.try_variant_get(v, "$.biblio", "map<string,variant>").isNotNull()
    return F.when(nested, own).otherwise(flat)


def _patents(v: Column) -> Column:
    years = F.transform(_list(v, "$.counts_by_year"), lambda y: F.coalesce(F.try_variant_get(y, "$.citing_patents", "bigint"), F.lit(0)))
    total = F.aggregate(years, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return F.when(total > 0, total)


def _projected(v: Column) -> Column:
    cited = F.try_variant_get(v, "$.referenced_works", "array<variant>")
    listed = F.when(cited.isNotNull(), F.size(cited).cast("bigint"))
    fields = {name: _largest(v, paths, *([listed] if name == "reference_count" else [])) for name, paths in COUNTS.items()}
    fields["citing_patents_count"] = _patents(v)
    fields |= {name: _first_text(v, paths) for name, paths in TEXTS.items()}
    fields |= {name: short_id(_first_scalar(v, paths)) for name, paths in IDS.items()}
    fields["doi"] = bare_doi(_first_text(v, DOIS))
    pdfs = [_string(v, _path(p)) for p in PDFS]
    fields["oa_pdf_url"] = F.coalesce(*[F.when(F.startswith(p, F.lit("http")), p) for p in pdfs])
    fields["is_open_access"] = F.when(
        F.schema_of_variant(F.try_variant_get(v, "$.open_access.is_oa", "variant")) == "BOOLEAN",
        F.try_variant_get(v, "$.open_access.is_oa", "boolean"),
    )
    fields["is_preprint"] = F.lower(fields["publication_type"]).isin(*PREPRINTS)
    fields["publication_date"] = _date(v)
    fields["fields_of_study"] = _fields_of_study(v)
    fields["authors"] = _authors(v)
    fields["funders"] = _funders(v)
    fields["abstract"] = abstract_of(v)
    fields["biblio"] = _biblio(v)
    by = F.array_compact(F.transform(_list(v, "$._verified_by"), lambda x: _string(x, "$")))
    label = fields["source_label"]
    fields["verified_by"] = F.when(F.size(by) > 0, by).otherwise(F.when(label.isNotNull(), F.array(label)))
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def enrichment(payload: Column) -> Column:
    """One struct of all fields from a payload's JSON text; fields that no source gives are
    null, never made up. A text that is no JSON, or no object, gives null."""
    return let(
        F.try_parse_json(payload),
        lambda v: F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), _projected(v)),
    )


def links(e: Column) -> Column:
    """Addresses that an ``enrichment`` leads to, by their kind."""
    doi = e["doi"]
    kinds = {
        "doi": F.concat(F.lit("https://doi.org/"), doi),
        "libkey": F.concat(F.lit("https://libkey.io/"), doi),
        "worldcat": F.concat(F.lit("https://www.worldcat.org/search?q="), F.replace(F.url_encode(doi), F.lit("+"), F.lit("%20"))),
        "openalex": F.concat(F.lit("https://openalex.org/"), e["openalex_id"]),
        "oa_pdf": e["oa_pdf_url"],
    }
    every = F.create_map(*[x for k, url in kinds.items() for x in (F.lit(k), url)])
    return F.map_filter(every, lambda _, url: url.isNotNull())


#: Fields that another source may fill.
FILLABLE = ("cited_by_count", "reference_count", "abstract", "tldr", "funders")


def filled(e: Column, *others: Column, names: tuple[str, ...] = FILLABLE) -> Column:
    """An ``enrichment`` whose missing fields are those of others, in their order; what is
    there stays, but for counts of 0, which any real count replaces."""

    def fill(s):
        def one(name):
            own = F.nullif(s["own"][name], F.lit(0)) if name.endswith("_count") else s["own"][name]
            return F.coalesce(own, *[s[f"_{k}"][name] for k in range(len(others))], s["own"][name])

        return reduce(lambda out, name: out.withField(name, one(name)), names, s["own"])

    return let(F.struct(e.alias("own"), *[o.alias(f"_{k}") for k, o in enumerate(others)]), fill)


def backfill(rows: DataFrame, found: DataFrame, own: str = "e", other: str = "other") -> DataFrame:
    """``rows`` with what their enrichment lacks from ``found``'s of the same DOI.

    Rows that lack nothing, or have no DOI, have a null key and meet none. Where several of
    ``found`` have a DOI, each field is the first of theirs by most citations (ties: by the
    record itself); an aggregation with map-side partials keeps the best of each DOI.
    """
    gaps = reduce(lambda a, b: a | b, [F.col(own)[n].isNull() | (F.col(own)[n].cast("string") == "0") for n in FILLABLE])
    key = F.when(gaps, F.lower(F.col(own)["doi"]))
    fields = F.struct(*[F.col(other)[n].alias(n) for n in FILLABLE])
    best = (
        found.select(F.lower(F.col(other)["doi"]).alias("_doi"), fields.alias("_fields"))
        .where("_doi is not null")
        .groupBy("_doi")
        .agg(F.struct(*[_best(n).alias(n) for n in FILLABLE]).alias("_best"))
    )
    joined = rows.withColumn("_doi", key).join(best, "_doi", "left")
    return joined.withColumn(own, filled(F.col(own), F.col("_best"))).drop("_doi", "_best")


def _best(name: str) -> Column:
    """The field of the record that has it and the most citations."""
    value = F.col("_fields")[name]
    rank = F.struct(F.coalesce(F.col("_fields")["cited_by_count"], F.lit(-1)), F.col("_fields"))
    return F.max_by(value, F.when(value.isNotNull(), rank))
