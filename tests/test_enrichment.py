"""Payloads of four sources in one shape."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from citelake.functions import enrichment

WORK = {
    "id": "https://openalex.org/W12",
    "type": "article",
    "cited_by_count": 0,
    "citationCount": "182.0",
    "referenced_works": [],
    "references-count": 7,
    "counts_by_year": [{"year": 2020, "citing_patents": 2}, {"citing_patents": 1}, {"year": 2021}],
    "open_access": {"is_oa": True, "oa_url": "https://x.org/a.pdf"},
    "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/99", "mag": 123, "doi": "https://doi.org/10.1/a&b"},
    "primary_location": {"source": {"display_name": " Journal A ", "id": "https://openalex.org/S5"}},
    "publication_date": "2021-10-01",
    "concepts": [{"display_name": "low", "score": 0.1}, {"display_name": "B", "score": 0.5}, {"display_name": "A", "score": 0.9}],
    "authorships": [
        {"author": {"display_name": "Ann Lee", "orcid": "https://orcid.org/0000-1", "id": "https://openalex.org/A7"}, "institutions": [{"display_name": "U"}, {}]},
        {"author": {}},
    ],
    "authors": [{"name": "A. Lee", "authorId": "44"}],
    "grants": [{"funder_display_name": "F1"}, {"funder": "F2"}, {"funder_display_name": "F1"}],
    "abstract_inverted_index": {"the": [0, 2], "end": [3], "of": [1]},
    "biblio": {"volume": "3", "first_page": "1", "last_page": "9"},
    "_matched_database": "OpenAlex",
}
REGISTERED = {
    "type": "posted-content",
    "is-referenced-by-count": 4,
    "container-title": ["Journal C", "other"],
    "issued": {"date-parts": [[2019, 3, 4]]},
    "author": [{"given": "Bo", "family": "Chen", "ORCID": "http://orcid.org/0000-2"}, {"family": "Diaz"}],
    "funder": ["F9"],
    "abstract": "<jats:p>Some  <b>text</b></jats:p>",
    "volume": 8,
    "page": "10–12",
    "DOI": "10.2/c",
    "source": "Registry",
    "_verified_by": ["x", "", "y"],
}
SCHOLAR = {
    "citationCount": 3,
    "numCitedBy": True,
    "venue": "",
    "journal": "Plain Journal",
    "year": 2018,
    "authors": [{"name": "Cy Fu", "authorId": 5}, {"name": ""}],
    "author": "a string",
    "s2FieldsOfStudy": [{"category": "Math"}, {"category": "Math"}, "Art"],
    "tldr": {"model": "m", "text": " short "},
    "externalIds": {"DOI": "doi:10.3/d", "PubMed": "7"},
    "openAccessPdf": {"url": "ftp://no"},
    "cited_by_count": -1,
}
EMPTY = {"publicationVenue": {"type": "journal"}, "issued": {"date-parts": [[2001]]}, "concepts": None, "authors": []}


@pytest.fixture(scope="module")
def found(spark):
    rows = [("work", json.dumps(WORK)), ("registered", json.dumps(REGISTERED)), ("scholar", json.dumps(SCHOLAR)), ("empty", json.dumps(EMPTY))]
    rows += [("broken", "{no"), ("list", "[1]"), ("null", None), ("none", "{}")]
    df = spark.createDataFrame(rows, "k string, payload string").select("k", enrichment.enrichment(F.col("payload")).alias("e"))
    out = df.select("k", "e", enrichment.links(F.col("e")).alias("links")).collect()
    return {r["k"]: (r["e"].asDict(True) if r["e"] else None, r["links"]) for r in out}


def test_a_merged_work(found):
    e, links = found["work"]
    assert (e["cited_by_count"], e["reference_count"], e["citing_patents_count"]) == (182, 7, 3)
    assert (e["openalex_id"], e["venue_id"], e["pubmed_id"], e["mag_id"], e["doi"]) == ("W12", "S5", "99", "123", "10.1/a&b")
    assert (e["venue"], e["publication_date"], e["abstract"], e["source_label"]) == ("Journal A", "Oct 1, 2021", "the of the end", "OpenAlex")
    assert e["fields_of_study"] == ["A", "B"] and e["funders"] == ["F1", "F2"] and e["verified_by"] == ["OpenAlex"]
    assert e["authors"] == [{"name": "Ann Lee", "orcid": "0000-1", "openalex_id": "A7", "s2_id": None, "institutions": ["U"]}]
    assert e["biblio"] == {"volume": "3", "issue": None, "first_page": "1", "last_page": "9"} and e["is_open_access"] and not e["is_preprint"]
    assert set(links) == {"doi", "libkey", "worldcat", "openalex", "oa_pdf"} and links["worldcat"].endswith("10.1%2Fa%26b")


def test_other_shapes(found):
    e, links = found["registered"]
    assert (e["cited_by_count"], e["venue"], e["publication_date"], e["abstract"]) == (4, "Journal C", "Mar 4, 2019", "Some text")
    assert [(a["name"], a["orcid"]) for a in e["authors"]] == [("Bo Chen", "0000-2"), ("Diaz", None)]
    assert e["is_preprint"] and e["funders"] == ["F9"] and e["verified_by"] == ["x", "y"] and "openalex" not in links
    assert e["biblio"] == {"volume": "8", "issue": None, "first_page": "10", "last_page": "12"}
    e, links = found["scholar"]
    assert (e["cited_by_count"], e["venue"], e["publication_date"], e["tldr"], e["doi"]) == (3, "Plain Journal", "2018", "short", "10.3/d")
    assert e["fields_of_study"] == ["Math", "Art"] and e["oa_pdf_url"] is None and e["pubmed_id"] == "7"
    assert [(a["name"], a["s2_id"]) for a in e["authors"]] == [("Cy Fu", "5")]


def test_what_no_source_gives_is_null(found):
    e, links = found["empty"]
    assert (e["publication_type"], e["publication_date"]) == ("journal", "2001") and e["authors"] is None and links == {}
    assert all(found[k][0] is None for k in ("broken", "list", "null"))
    assert {v for k, v in found["none"][0].items() if k != "biblio"} == {None}


def test_filling_keeps_what_is_there(spark):
    rows = [('{"citationCount": 0, "abstract": "own"}', '{"citationCount": 5, "abstract": "other", "tldr": "t"}'), ('{"citationCount": 2}', None)]
    df = spark.createDataFrame(rows, "a string, b string")
    a, b = (enrichment.enrichment(F.col(c)) for c in "ab")
    got = df.select(enrichment.filled(a, b).alias("e")).select("e.cited_by_count", "e.abstract", "e.tldr").collect()
    assert [tuple(r) for r in got] == [(5, "own", "t"), (2, None, None)]


def test_backfill_meets_by_doi_alone(spark):
    rows = [(1, '{"doi": "10.1/A", "citationCount": 0}'), (2, '{"citationCount": 0}'), (3, '{"DOI": "10.1/b", "tldr": "own"}'), (4, None)]
    other = ['{"doi": "https://doi.org/10.1/a", "citationCount": 3, "tldr": "few"}', '{"doi": "10.1/a", "citationCount": 9}', '{"doi": "10.1/b", "tldr": "no"}', '{"tldr": "none"}']
    left = spark.createDataFrame(rows, "k int, p string").select("k", enrichment.enrichment(F.col("p")).alias("e"))
    right = spark.createDataFrame([(o,) for o in other], "p string").select(enrichment.enrichment(F.col("p")).alias("other"))
    out = enrichment.backfill(left, right).select("k", "e.cited_by_count", "e.tldr").collect()
    assert sorted(map(tuple, out)) == [(1, 9, "few"), (2, 0, None), (3, None, "own"), (4, None, None)]
