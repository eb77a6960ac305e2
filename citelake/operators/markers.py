"""In-text citations of any style: markers, what they refer to, audits, renumbering.

A text is read once, in its own row: its lines before the bibliography, without table rows and
running heads, each with the markers of every style. A document's style is a vote of its
markers. Numbers, alpha keys (``[Knu97]``) and author-year marks are then three ways to a
name in the reference list; a name that several references share decides nothing.

A document meets its reference list in one row, by a join on the document alone; nothing else
is moved, and where both sides come dealt by document, nothing is. Patterns run behind plainer
tests that all of their matches pass. Nothing is filtered by what a text gives: Spark would
evaluate it again for the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import let, surname

#: Headings that end a body.
_HEADINGS = ("references", "bibliography", r"literature\s+cited", r"cited\s+literature", r"works\s+cited", r"reference\s+list")
#: Words before a number in brackets that is no citation.
_POINTERS = "eqn?s?|equations?|figs?|figures?|sects?|sections?|secs?|tables?|appendix|appendices|chapters?|steps?|items?|lines?|rows?|cols?|columns?|refs?|references?|notes?|panels?|parts?"
_SUPER = "⁰¹²³⁴⁵⁶⁷⁸⁹"
_LIST = r"\s*[0-9]{1,3}(?:\s*[-–—~,;]\s*[0-9]{1,3})*\s*"
_SURNAME = r"[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'-]+"
_OTHERS = rf"(?:\s+et\s+al\.?|\s+(?:and|&|und|et|y)\s+{_SURNAME})?"
_KEY = r"[A-Z][A-Za-z]{0,3}\+?[0-9]{2}[a-z]?"
#: Forms of markers, by style.
FORMS = {
    "bracket": rf"\[{_LIST}\]",
    "paren": rf"(?<![\w.])\({_LIST}\)(?!:)",
    "superscript": rf"(?<=\p{{L}}{{2}})[{_SUPER}]+(?:[·,‐‑–—-][{_SUPER}]+)*",
    "alpha-key": rf"\[\s*{_KEY}(?:\s*[,;]\s*{_KEY})*\s*\]",
    "author-year": rf"{_SURNAME}{_OTHERS}[\s,]*[(\[]?(?:19|20)[0-9]{{2}}[a-z]?(?=\s*[)\];,])",
}
NUMERIC = ("bracket", "paren", "superscript")
LEAST, WIDEST = 3, 50


def body(text: Column) -> Column:
    """A text up to a line that is a bibliography's heading."""
    heading = r"[\n\r\u0085\u2028\u2029]\s*(?i:" + "|".join(_HEADINGS) + r")\s*[:.]?\s*(?m:$)(?s:.*)"
    return F.coalesce(F.substring(F.regexp_replace(F.concat(F.lit("\n"), text), heading, ""), F.lit(2), F.length(text)), F.lit(""))


def _prose(line: Column) -> Column:
    """Neither a running head nor a row of a table."""

    def count(characters):
        return F.length(line) - F.length(F.regexp_replace(line, f"[{characters}]+", ""))

    def tabular(digits):
        named = (digits > 12) & line.rlike(r"(?i)\b(?:table|fig(?:ure)?|appendix|supplementary)\s*[0-9]")
        cells = (digits > 1) & (F.regexp_count(line, F.lit(r"[0-9]+\s*\(\s*[0-9]")) + F.regexp_count(line, F.lit(r"\[\s*[0-9]+\s*[,–-]")) >= 3)
        dense = let(count("A-Za-z"), lambda letters: (letters > 0) & (digits > 0.32 * (digits + letters)))
        return (digits > 0) & (dense | named | cells)

    table = (F.length(line) >= 40) & let(count("0-9"), tabular)
    maybe = F.contains(F.lower(line), F.lit("page")) | F.contains(F.lower(line), F.lit("doi"))
    head = (F.length(line) >= 12) & maybe & line.rlike(r"(?i)(?:^|[\s,;:])page\s+[0-9]+\s+of\s+[0-9]+|\bdoi\s*[:\s]\s*10\.[0-9]{3,}/\S+")
    return ~head & ~table


def numbers_of(marker: Column) -> Column:
    """``array<struct<number, error>>`` of a numeric marker: its numbers, ranges spelled out;
    a reversed range, or one wider than 50, is an error and no number, but the ends of a range
    in two brackets are."""
    parts = F.split(F.translate(marker, ";[]() \t\n\x0b\f\r", ","), ",")

    def struct(n, e):
        return F.struct(n.cast("long").alias("number"), e.cast("string").alias("error"))

    def spelled(p, low, high):
        null = F.lit(None)
        wrong = F.when(high < low, "reversed").when(high - low > WIDEST, "too wide")
        ends_of_two = F.when(F.contains(p, F.lit("~")), F.array(struct(low, null), struct(high, null))).otherwise(F.array().cast("array<struct<number:bigint,error:string>>"))
        return F.when((high < low) | (high - low > WIDEST), F.concat(F.array(struct(null, F.concat_ws(" ", wrong, low, high))), ends_of_two)).otherwise(
            F.transform(F.sequence(low, F.greatest(low, high)), lambda n: struct(n, null))
        )

    def read(p):
        ends = F.transform(F.split(F.translate(p, "–—~", "---"), "-"), lambda e: e.try_cast("int"))
        return let(ends, lambda e: spelled(p, e[0], F.coalesce(F.get(e, F.lit(1)), e[0])))

    single = F.regexp_extract(marker, r"^[\[(]?([0-9]{1,3})[\])]?$", 1)  # as most are
    return let(single, lambda n: F.when(n != "", F.array(struct(n.cast("int"), F.lit(None)))).otherwise(F.flatten(F.transform(parts, read))))


def marks(text: Column) -> Column:
    """``array<struct<style, at, marker, numbers, names>>``: every marker of every style of a
    body, ``at`` in order of reading; what a numeric one counts, null where that can't be read,
    and how alpha keys and author-year marks name their references. A range with a bracket
    around each end is one marker, joined by ``~``."""
    numeral = r"\(\s*[0-9]"

    def plain(line):
        out = F.when(line.rlike(numeral), F.regexp_replace(line, rf"(?i)\b(?:{_POINTERS})\.?\s*\({_LIST}\)", " ")).otherwise(line)
        out = F.regexp_replace(out, r"\[\s*([0-9]{1,3})\s*\]\s*[-‐‑‒–—―−]\s*\[\s*([0-9]{1,3})\s*\]", "[$1~$2]")
        return F.regexp_replace(out, r"\(\s*([0-9]{1,3})\s*\)\s*[-‐‑‒–—―−]\s*\(\s*([0-9]{1,3})\s*\)", "($1~$2)")

    def alpha(marker):
        stems = F.regexp_extract_all(marker, F.lit(r"([A-Z][A-Za-z]{0,3})\+?[0-9]{2}[a-z]?"), F.lit(1))
        years = F.regexp_extract_all(marker, F.lit(r"[A-Z][A-Za-z]{0,3}\+?([0-9]{2})[a-z]?"), F.lit(1))
        return F.zip_with(stems, years, lambda s, y: F.concat(F.lower(s), y))

    def dated(marker):
        return F.array(F.concat(surname(F.regexp_extract(marker, rf"^({_SURNAME})", 1)), F.regexp_extract(marker, r"((?:19|20)[0-9]{2}[a-z]?)\P{N}*$", 1)))

    def arabic(marker):
        return F.translate(marker, _SUPER + "·‐‑", "0123456789,--")

    bracket = lambda line: F.contains(line, F.lit("["))
    tests = {
        "bracket": bracket,
        "paren": lambda line: line.rlike(numeral),
        "superscript": lambda line: (F.octet_length(line) > F.length(line)) & line.rlike(f"[{_SUPER}]"),
        "alpha-key": bracket,
        "author-year": lambda line: F.contains(line, F.lit("19")) | F.contains(line, F.lit("20")),
    }
    none = F.array().cast("array<struct<style:string,at:struct<n:int,k:int>,marker:string,numbers:array<struct<number:bigint,error:string>>,names:array<string>>>")

    def found(line, n, style):
        def mark(m, k):
            marker = arabic(m) if style == "superscript" else m
            numbers = numbers_of(marker) if style in NUMERIC else F.lit(None).cast("array<struct<number:bigint,error:string>>")
            names = alpha(m) if style == "alpha-key" else dated(m) if style == "author-year" else F.lit(None).cast("array<string>")
            at = F.struct(n.alias("n"), k.alias("k"))
            return F.struct(F.lit(style).alias("style"), at.alias("at"), marker.alias("marker"), numbers.alias("numbers"), names.alias("names"))

        every = F.transform(F.regexp_extract_all(line, F.lit(FORMS[style]), F.lit(0)), mark)
        if style in ("bracket", "paren"):  # indices begin at 1: a marker with a 0 is an interval
            every = F.filter(every, lambda x: ~(F.contains(x["marker"], F.lit("0")) & x["marker"].rlike(r"(?<![0-9.])0(?![0-9.])")))
        return F.when(tests[style](line), every).otherwise(none)

    def read(line, n):
        some = bracket(line) | F.contains(line, F.lit("(")) | tests["author-year"](line) | (F.octet_length(line) > F.length(line))
        return F.when(some & _prose(line), let(plain(line), lambda t: F.concat(*[found(t, n, s) for s in FORMS]))).otherwise(none)

    return F.flatten(F.transform(F.split(text, "\n"), read))


def _enumerates(text: Column, opening: str, closing: str) -> Column:
    """Single numbers that are an itemised list: 1 to k in order of appearance, three at least,
    most of them before a capital at the start of a sentence or line."""
    number = rf"\{opening}\s*([0-9]{{1,3}})\s*\{closing}"
    seen = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(number), F.lit(1)), lambda n: n.cast("int")))
    first = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"(?:^|[\n.:;])[ \t]*{number}\s*(?=\p{{Lu}})"), F.lit(1)), lambda n: n.cast("int")))
    return let(seen, lambda s: (F.size(s) >= 3) & (s == F.sequence(F.lit(1), F.greatest(F.size(s), F.lit(1)))) & (F.size(F.array_intersect(s, first)) >= 0.6 * F.size(s)))


def style_of(found: Column, cap: Column, text: Column) -> Column:
    """The style of a body by its ``marks``, ``mixed`` where two compete, null where markers are
    too few or itemise a list; ``cap`` is the largest number that can be a reference's. A vote
    is a marker whose numbers are all within it, a distinct author and year, or a distinct key."""

    def of(style):
        return F.filter(found, lambda m: m["style"] == style)

    def inside(m):
        return F.coalesce(F.forall(m["numbers"], lambda x: x["number"].isNull() | x["number"].between(1, cap)), F.lit(False))

    def distinct(style, names):
        return F.size(F.array_distinct(F.flatten(F.transform(of(style), names))))

    counts = {s: F.size(F.filter(of(s), inside)) for s in NUMERIC}
    counts["alpha-key"] = distinct("alpha-key", lambda m: F.transform(F.regexp_extract_all(m["marker"], F.lit(f"({_KEY})"), F.lit(1)), lambda k: F.lower(k)))
    counts["author-year"] = distinct("author-year", lambda m: F.transform(m["names"], lambda x: F.regexp_extract(x, "^[a-z]*[0-9]{4}", 0)))

    def choose(n):
        families = [F.struct(n[s].alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(("bracket", "superscript", "paren"))]
        return let(F.reverse(F.array_sort(F.array(*families))), lambda ordered: chosen(n, ordered[0], ordered[1]["n"]))

    def chosen(n, top, second):
        total, year, alpha = n["bracket"] + n["superscript"] + n["paren"], n["author-year"], n["alpha-key"]
        rival = F.greatest(total, year)
        return (
            F.when((total < LEAST) & (year < LEAST) & (alpha < LEAST), None)
            .when(alpha >= LEAST, F.when(alpha >= 2 * rival, "alpha-key").otherwise("mixed"))
            .when((year >= LEAST) & (total < LEAST), "author-year")
            .when((top["n"] >= LEAST) & ((second >= F.greatest(F.lit(LEAST), 0.4 * top["n"])) | (year >= LEAST)), "mixed")
            .when(top["s"] == "paren", F.when((top["n"] >= 5) & (top["n"] >= 3 * second) & ~_enumerates(text, "(", ")"), "paren"))
            .when((top["n"] >= LEAST) & ~((top["s"] == "bracket") & _enumerates(text, "[", "]")), top["s"])
        )

    return let(F.struct(*[c.alias(s) for s, c in counts.items()]), choose)


def alpha_stems(authors: Column) -> Column:
    """What an alpha key of these authors can begin with: up to three letters of the first
    surname, all of it, or the first letters of up to three surnames."""

    def stems(names):
        first = F.get(names, F.lit(0))
        initials = F.when(F.size(names) > 1, F.array_join(F.transform(F.slice(names, 1, 3), lambda s: F.left(s, F.lit(1))), ""))
        return F.array_distinct(F.array_compact(F.array(*[F.left(first, F.lit(n)) for n in (3, 2, 1)], first, initials)))

    return let(F.filter(F.transform(authors, surname), lambda s: s != ""), stems)


def _read(docs: DataFrame, references: DataFrame, doc: str, text: str, number: str, authors: str | None, year: str | None, also: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, *also, refs, cap, marks, style)``: a row for each document that has references."""
    one = [F.col(number).cast("long").alias("number")]
    if authors is not None:
        one += [F.col(authors).alias("authors"), F.col(year).cast("string").alias("year")]
    listed = references.groupBy(doc).agg(F.collect_list(F.struct(*one)).alias("refs"), F.greatest(F.max(number), F.count("*")).cast("long").alias("cap"))
    rows = docs.join(listed, doc).select(doc, *also, "refs", "cap", body(F.col(text)).alias("_body"))
    rows = rows.select(doc, *also, "refs", "cap", "_body", marks(F.col("_body")).alias("marks"))
    return rows.select(doc, *also, "refs", "cap", "marks", style_of(F.col("marks"), F.col("cap"), F.col("_body")).alias("style"))


def _own(found: Column, style: Column) -> Column:
    return F.filter(found, lambda m: m["style"] == style)


def _numbers(mark: Column) -> Column:
    return F.coalesce(mark["numbers"], F.array().cast("array<struct<number:bigint,error:string>>"))


def _alpha_names(refs: Column) -> Column:
    """``array<struct<name, number>>``: every alpha key that a reference answers to, once each."""

    def named(r):
        names = F.when(r["year"].rlike("^[0-9]{4}$") & (surname(F.get(r["authors"], F.lit(0))) != ""), alpha_stems(r["authors"]))
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda s: F.struct(F.concat(s, F.right(r["year"], F.lit(2))).alias("name"), r["number"].alias("number")))

    return F.array_distinct(F.flatten(F.transform(refs, named)))


def _dated_names(refs: Column) -> Column:
    """``array<struct<name, number>>``: author and year. References of one first author and year
    are told apart by letters, in order, and answer without one where they are alone."""
    each = F.transform(refs, lambda r: F.when(r["year"].rlike("^[0-9]{4}$"), F.struct(surname(F.get(r["authors"], F.lit(0))).alias("key"), r["year"].alias("y"), r["number"].alias("number"))))
    known = F.array_sort(F.filter(each, lambda r: F.coalesce(r["key"] != "", F.lit(False))))

    def lettered(t):
        def name(r, i):
            bare = F.concat(r["key"], r["y"])
            rank = i - F.array_position(t["names"], bare).cast("int") + 2
            alone = (rank == 1) & ~F.coalesce(F.get(t["names"], i + 1) == bare, F.lit(False))
            own = F.struct(F.concat(bare, F.char(F.lit(96) + F.least(rank, F.lit(26)))).alias("name"), r["number"].alias("number"))
            return F.when(alone, F.array(F.struct(bare.alias("name"), r["number"].alias("number")), own)).otherwise(F.array(own))

        return F.flatten(F.transform(t["known"], name))

    return let(known, lambda k: let(F.struct(k.alias("known"), F.transform(k, lambda r: F.concat(r["key"], r["y"])).alias("names")), lettered))


def _shared(ordered: Column) -> Column:
    """What an array in order holds more than once."""
    return F.array_distinct(F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i - 1) == x, F.lit(False))))


def resolved(docs: DataFrame, references: DataFrame, doc: str, text: str, number: str, authors: str, year: str) -> DataFrame:
    """``(doc, at, marker, number)``: the reference that each marker of a document's style
    means, one row for each number of a marker. Keys that several references answer to, and
    markers without a reference, have no row."""
    rows = _read(docs, references, doc, text, number, authors, year)
    refs, own = F.col("refs"), _own(F.col("marks"), F.col("style"))
    none = F.array().cast("array<struct<at:struct<n:int,k:int>,marker:string,number:bigint>>")

    def entries(m, numbers):
        return F.transform(numbers, lambda n: F.struct(m["at"].alias("at"), m["marker"].alias("marker"), n.alias("number")))

    def by_number(listed):
        cited = lambda m: F.transform(F.filter(m["numbers"], lambda x: F.array_contains(listed, x["number"])), lambda x: x["number"])
        return F.flatten(F.transform(own, lambda m: F.coalesce(entries(m, cited(m)), none)))

    def alone(known):
        names = F.transform(F.array_sort(F.array_distinct(F.filter(known, lambda x: x["number"].isNotNull()))), lambda x: x["name"])
        return let(let(names, _shared), lambda many: F.filter(known, lambda x: x["number"].isNotNull() & ~F.array_contains(many, x["name"])))

    def by_name(known):
        def lists(a):
            return F.struct(F.transform(a, lambda x: x["name"]).alias("names"), F.transform(a, lambda x: x["number"]).alias("numbers"))

        def look(t):
            def meant(m):
                at = F.transform(m["names"], lambda s: F.array_position(t["names"], s).cast("int"))
                return F.transform(F.filter(at, lambda p: p > 0), lambda p: F.get(t["numbers"], p - 1))

            return F.flatten(F.transform(own, lambda m: entries(m, meant(m))))

        return let(let(alone(known), lists), look)

    listed = F.array_distinct(F.array_compact(F.transform(refs, lambda r: r["number"])))
    every = (
        F.when(F.col("style").isin(*NUMERIC), let(listed, by_number))
        .when(F.col("style") == "alpha-key", let(_alpha_names(refs), by_name))
        .when(F.col("style") == "author-year", let(_dated_names(refs), by_name))
        .otherwise(none)
    )
    return rows.select(doc, F.inline(every)).withColumn("number", F.col("number").cast(references.schema[number].dataType))


def audit(docs: DataFrame, references: DataFrame, doc: str, text: str, number: str, authors: str, year: str) -> DataFrame:
    """One row a document with references: its ``style``, whether the audit ``abstains``, and
    sorted lists: ``undefined`` (cited, not listed), ``range_errors``, ``duplicate`` (numbers
    listed twice; cited keys of several references), ``gap`` and ``uncited`` (listed, never
    cited, within the cited run or outside it; only when half of the list is cited), and
    ``out_of_order`` (first cited after a higher number; not for lists by author, nor for
    texts that cite from the highest down).

    It abstains for other styles than numbers and alpha keys, for fewer than three cited,
    when over 30 % of the numbers or half of the keys are undefined, and when under three
    references, or under half of them, have a key. Abstaining rows have empty lists.
    """
    rows = _read(docs, references, doc, text, number, authors, year)
    refs, own, total = F.col("refs"), _own(F.col("marks"), F.col("style")), F.size("refs")
    lists = "undefined", "range_errors", "duplicate", "gap", "uncited", "out_of_order"
    none = F.array().cast("array<string>")
    words = lambda c: F.transform(c, lambda x: x.cast("string"))

    def told(abstains, **found):
        return F.struct(abstains.alias("abstains"), *[found.get(c, none).alias(c) for c in lists])

    def by_author():
        family = F.transform(refs, lambda r: F.struct(r["number"].alias("number"), surname(F.get(r["authors"], F.lit(0))).alias("s")))
        ordered = F.transform(F.array_sort(F.filter(family, lambda r: F.coalesce(r["s"] != "", F.lit(False)))), lambda r: r["s"])

        def test(s):
            n = F.size(s)
            rising = F.size(F.filter(s, lambda x, i: F.coalesce(x <= F.get(s, i + 1), F.lit(False))))
            return (n >= 3) & (F.size(F.array_distinct(s)) >= F.greatest(F.lit(3), F.floor(0.5 * n))) & (rising >= 0.8 * (n - 1))

        return let(ordered, test)

    def numbers(t):
        # numbers in order of first mention; those of one marker in their own order
        cited, listed = t["cited"], F.array_distinct(t["listed"])
        inside = F.filter(cited, lambda x: x <= F.col("cap"))
        parts = {
            "inside": inside,
            "both": F.array_intersect(inside, listed),
            "uncited": F.array_sort(F.array_except(listed, cited)),
            "undefined": F.array_sort(F.array_except(cited, listed)),
            "duplicate": _shared(t["listed"]),
            "n": F.size(cited),
        }
        return let(F.struct(*[c.alias(k) for k, c in parts.items()]), judge)

    def judge(p):
        inside = p["inside"]
        n_in, steps = F.size(inside), F.greatest(F.size(inside) - 1, F.lit(0))
        abstains = (n_in < LEAST) | (p["n"] - n_in > 0.3 * p["n"])
        low, top = F.array_min(p["both"]), F.array_max(p["both"])
        covered = (F.size(p["both"]) >= 0.5 * total) & (F.size(p["both"]) > 0)
        falls = F.size(F.filter(inside, lambda x, i: F.coalesce(F.get(inside, i - 1) >= x, F.lit(False))))
        # numbers have three digits at most
        late = F.array_sort(F.filter(inside, lambda x, i: F.coalesce(x < F.array_max(F.slice(inside, F.lit(1), i)), F.lit(False))))
        errors = F.flatten(F.transform(own, lambda m: F.transform(F.filter(_numbers(m), lambda x: x["error"].isNotNull()), lambda x: x["error"])))
        return told(
            abstains,
            undefined=words(p["undefined"]),
            range_errors=F.array_sort(F.array_distinct(errors)),
            duplicate=words(p["duplicate"]),
            gap=F.when(covered, words(F.filter(p["uncited"], lambda x: x.between(low, top)))).otherwise(none),
            uncited=F.when(covered, words(F.filter(p["uncited"], lambda x: ~x.between(low, top)))).otherwise(none),
            out_of_order=F.when(((steps >= 3) & (falls == steps)) | by_author(), none).otherwise(words(late)),
        )

    def keys(t):
        said, known = t["said"], t["known"]
        numbered = F.transform(F.array_sort(F.filter(known, lambda x: x["number"].isNotNull())), lambda x: x["name"])
        reached = F.array_distinct(F.transform(F.filter(known, lambda x: x["number"].isNotNull() & F.array_contains(said, x["name"])), lambda x: x["number"]))
        derived = F.array_distinct(F.transform(known, lambda x: x["number"]))
        parts = {
            "undefined": F.array_sort(F.array_except(said, numbered)),
            "duplicate": F.array_sort(F.array_intersect(said, let(numbered, _shared))),
            "uncited": F.array_sort(F.array_compact(F.array_except(derived, reached))),
            "reached": F.size(reached),
            "derived": F.size(derived),
            "n": F.size(said),
        }
        return let(F.struct(*[c.alias(k) for k, c in parts.items()]), judge_keys)

    def judge_keys(p):
        few = (p["n"] < LEAST) | (p["derived"] < F.greatest(F.lit(LEAST), 0.5 * total)) | (F.size(p["undefined"]) > 0.5 * p["n"])
        return told(few, undefined=p["undefined"], duplicate=p["duplicate"], uncited=F.when(p["reached"] >= 0.5 * p["derived"], words(p["uncited"])).otherwise(none))

    read = F.flatten(F.transform(own, lambda m: F.transform(F.filter(_numbers(m), lambda x: x["number"].isNotNull()), lambda x: F.struct(m["at"].alias("at"), x["number"].alias("number")))))
    cited = F.array_distinct(F.transform(F.array_sort(read), lambda x: x["number"]))
    listed = F.array_sort(F.array_compact(F.transform(refs, lambda r: r["number"])))
    said = F.array_distinct(F.flatten(F.transform(own, lambda m: m["names"])))
    found = (
        F.when(F.col("style").isin(*NUMERIC), let(F.struct(cited.alias("cited"), listed.alias("listed")), numbers))
        .when(F.col("style") == "alpha-key", let(F.struct(said.alias("said"), _alpha_names(refs).alias("known")), keys))
        .otherwise(told(F.lit(True)))
    )
    out = rows.select(doc, "style", found.alias("r"))
    return out.select(doc, "style", "r.abstains", *[F.when(F.col("r.abstains"), none).otherwise(F.col(f"r.{c}")).alias(c) for c in lists])


def renumbered_marker(marker: Column, inserted: Column) -> Column:
    """A numeric marker after a reference is inserted at a number: those from it on go up by
    one, everything else stands as it was; superscripts stay superscripts."""
    plain = F.translate(marker, _SUPER, "0123456789")

    def raised(p):
        return let(p.try_cast("int"), lambda n: F.coalesce((n + F.when(n >= inserted, 1).otherwise(0)).cast("string"), p))

    # a cast that fails is dear
    parts = F.transform(F.regexp_extract_all(plain, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.between("0", ":"), raised(p)).otherwise(p))
    new = F.array_join(parts, "")
    return F.when(plain == marker, new).otherwise(F.translate(new, "0123456789", _SUPER))


def renumbered(docs: DataFrame, references: DataFrame, doc: str, text: str, number: str, inserted: str) -> DataFrame:
    """``(doc, marker, new_marker, times)`` of the markers that a reference inserted at the
    document's number ``inserted`` changes. Documents whose style is not numeric have no row;
    the text itself is not touched."""
    rows = _read(docs, references, doc, text, number, None, None, (inserted,))
    style = F.col("style")

    def changed(m):
        shown = F.when(style == "superscript", F.translate(m["marker"], "0123456789", _SUPER)).otherwise(m["marker"])
        return let(shown, lambda s: F.struct(s.alias("marker"), renumbered_marker(s, F.col(inserted)).alias("new_marker")))

    every = F.filter(F.transform(_own(F.col("marks"), style), changed), lambda x: x["marker"] != x["new_marker"])
    none = F.array().cast("array<struct<marker:string,new_marker:string>>")
    found = rows.select(doc, F.inline(F.when(style.isin(*NUMERIC), every).otherwise(none)))
    return found.groupBy(doc, "marker", "new_marker").agg(F.count("*").alias("times"))
