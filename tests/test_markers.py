"""In-text citations: styles, audits, what markers mean, renumbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.operators import markers

PEOPLE = ["Knuth", "Aho", "Gray", "Liskov", "Hoare", "Dijkstra", "Codd"]


def papers(spark, rows):
    """``rows``: (text, references), a reference being (number, authors, year)."""
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "d int, text string")
    refs = spark.createDataFrame([(k, *r) for k, (_, rs) in enumerate(rows) for r in rs], "d int, number int, authors array<string>, year int")
    return docs, refs


def numbered(*numbers):
    return [(n, [f"Ann {PEOPLE[n % 7]}"], 1990 + n) for n in numbers]


def audit(spark, text, refs):
    docs, listed = papers(spark, [(text, refs)])
    return markers.audit(docs, listed, "d", "text", "number", "authors", "year").first()


def test_numeric_audit(spark):
    r = audit(spark, "One [1] and two [2, 3].\nThen [5-4] and [9] but [6] before [5].\nReferences\n[4] not cited here", numbered(1, 2, 3, 4, 5, 6, 6, 7, 8, 10))
    assert r["style"] == "bracket" and not r["abstains"]
    assert r["undefined"] == ["9"] and r["range_errors"] == ["reversed 5 4"] and r["duplicate"] == ["6"]
    assert (r["gap"], r["uncited"], r["out_of_order"]) == (["4"], ["7", "8", "10"], ["5", "6"])


def test_ranges_in_two_brackets_and_wide_ones(spark):
    r = audit(spark, "Shown in [1]–[4] and later [5] and [6]; see [2–90].", numbered(*range(1, 7)))
    assert (r["gap"], r["uncited"], r["out_of_order"], r["range_errors"]) == ([], [], [], ["too wide 2 90"])


STYLES = [
    ("First¹ then² and again³ here.", "superscript"),
    ("An area of 3 cm² and x² and 10⁶ and y³.", None),
    ("a (1) b (2) c (3) d (4) e (5) words", "paren"),
    ("a (1) b (2) c (3) words", None),
    ("See Eq. (1), Fig. (2), Table (3), Section (4), Eqs. (5).", None),
    ("(1) We show this. (2) We prove that. (3) We release it. (4) We ask. (5) We close.", None),
    ("[1] Scaling is hard.\n[2] Memory is small.\n[3] Time is short.", None),
    ("All scores lie in [0, 1] or [0, 5] or [0, 9].", None),
    ("As in [Knu97] and [AHU74; Gra81] it is.", "alpha-key"),
    ("Knuth (1997) and (Aho et al., 1974) and [Gray and Liskov, 1981] say.", "author-year"),
    ("a [1] b [2] c [3] and [Knu97] and [AHU74] and [Gra81].", "mixed"),
    ("a [1] b [2] c [3] d¹ e² word¹ word² word³", "mixed"),
    ("nothing is cited", None),
    (None, None),
]


def test_styles(spark):
    docs, refs = papers(spark, [(t, numbered(*range(1, 8))) for t, _ in STYLES])
    got = {r["d"]: r["style"] for r in markers.audit(docs, refs, "d", "text", "number", "authors", "year").collect()}
    assert [(t, got[k]) for k, (t, _) in enumerate(STYLES)] == STYLES


def test_lists_by_author_and_texts_from_the_highest_down(spark):
    by_author = [(k + 1, [f"Ann {n}"], 1990) for k, n in enumerate(sorted(PEOPLE))]
    assert audit(spark, "a [3] b [1] c [7] d [2] e [4] f [5]", by_author)["out_of_order"] == []
    shuffled = [(k + 1, [f"Ann {n}"], 1990) for k, n in enumerate(PEOPLE)]
    assert audit(spark, "a [3] b [1] c [7] d [2] e [4] f [5]", shuffled)["out_of_order"] == ["1", "2", "4", "5"]
    assert audit(spark, "a [7] b [6] c [4] d [2] e [1]", shuffled)["out_of_order"] == []


def test_short_lists_abstain(spark):
    r = audit(spark, "a [1] b [2] c [8] d [9] e [3] f [7]", numbered(1, 2, 3))
    assert r["abstains"] and r["undefined"] == []
    assert audit(spark, "a [1] b [1] c [2]", numbered(1, 2, 3))["abstains"]


ALPHA = [(1, ["Donald Knuth"], 1997), (2, ["A. Aho", "J. Hopcroft", "J. Ullman"], 1974), (3, ["Jim Gray"], 1981), (4, ["B. Liskov"], 1987), (5, ["Liskov, B."], 1987), (6, ["C. Codd"], 1970)]


def test_alpha_keys(spark):
    r = audit(spark, "As [Knu97] and [AHU74] and [Gra81, Lis87] but [Xyz99] say.", ALPHA)
    assert (r["style"], r["abstains"], r["undefined"], r["duplicate"], r["uncited"]) == ("alpha-key", False, ["xyz99"], ["lis87"], ["6"])
    assert audit(spark, "As [Knu97] and [Abc99] and [Def98] and [Ghi97] say.", ALPHA)["abstains"]


def meant(spark, text, refs):
    docs, listed = papers(spark, [(text, refs)])
    rows = markers.resolved(docs, listed, "d", "text", "number", "authors", "year").orderBy("at", "number").collect()
    return [(r["marker"], r["number"]) for r in rows]


def test_what_markers_mean(spark):
    assert meant(spark, "a [1, 3-4] b [2] c [9] d [3]", numbered(1, 2, 3, 4)) == [("[1, 3-4]", 1), ("[1, 3-4]", 3), ("[1, 3-4]", 4), ("[2]", 2), ("[3]", 3)]
    assert meant(spark, "As [Knu97] and [AHU74] and [Gra81, Lis87] say.", ALPHA) == [("[Knu97]", 1), ("[AHU74]", 2), ("[Gra81, Lis87]", 3)]


def test_authors_and_years(spark):
    refs = [(1, ["Kurt Müller"], 1999), (2, ["Ann Ek"], 2001), (3, ["A. Ek", "Bo Quist"], 2001), (4, ["Cy Diaz"], 2003), (5, ["Cy Diaz"], 2004)]
    text = "(Müller et al., 1999) or Diaz (2003) or [Diaz and Moe, 2004; Ek, 2001b]. Here Ek (2001) is either, (Nobody, 1950) none."
    assert [n for _, n in meant(spark, text, refs)] == [1, 4, 5, 3]


def test_renumbering(spark):
    docs, refs = papers(spark, [("a [1] b [2, 3–4] c [3] d [3] e [1]", numbered(1, 2, 3, 4)), ("x¹ word² word³ word⁹", numbered(1, 2, 3, 9)), ("(Ek, 2001) (Ek, 2002) (Ek, 2003)", numbered(1, 2, 3))])
    rows = markers.renumbered(docs.withColumn("k", F.lit(3)), refs, "d", "text", "number", "k").collect()
    assert sorted(map(tuple, rows)) == [(0, "[2, 3–4]", "[2, 4–5]", 1), (0, "[3]", "[4]", 2), (1, "³", "⁴", 1), (1, "⁹", "¹⁰", 1)]


def test_no_references_and_empty_tables(spark):
    docs, refs = papers(spark, [("a [1] b [2] c [3]", numbered(1, 2, 3))])
    assert markers.audit(docs, refs.limit(0), "d", "text", "number", "authors", "year").count() == 0
    assert markers.audit(docs.limit(0), refs.limit(0), "d", "text", "number", "authors", "year").count() == 0
