"""Column functions: normalisation of titles, names, identifiers and running text."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that journals put in front of a title.
TITLE_LABELS = (
    "original contribution:",
    "original article:",
    "research article:",
    "technical note:",
    "brief communication:",
    "review:",
    "editorial:",
    "commentary:",
)
#: Words that carry no meaning in a title.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by")
#: Code points written for an apostrophe. The acute accent U+00B4 is none: in
#: extracted text it is a mark that belongs to a letter.
APOSTROPHES = "\u2019\u2018\u02bc\u02c8\u0060"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once: a lambda over a one-element array
    binds it, where a plain column would be inlined at each use."""
    return F.transform(F.array(value), body)[0]


def _folds() -> dict[str, str]:
    """Letters of the Latin blocks whose decomposition is one ASCII letter and marks."""
    out = {}
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            out[chr(code)] = base
    return out | {"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ı": "i"}


_FOLD = _folds()


def fold_diacritics(text: Column) -> Column:
    """Latin letters without their marks; ß, æ and œ as two letters."""
    out = F.translate(text, "".join(_FOLD), "".join(_FOLD.values()))
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "Ae"), ("œ", "oe"), ("Œ", "Oe")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def straight_apostrophes(text: Column) -> Column:
    return F.translate(text, APOSTROPHES, "'" * len(APOSTROPHES))


def one_blank(text: Column) -> Column:
    """White space collapsed; single blanks, as nearly all are, are not replaced."""
    return F.trim(F.regexp_replace(text, r"\s{2,}|[^\S ]", " "))


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def strip_html(text: Column) -> Column:
    """Tags and character references out, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), "&[a-zA-Z#0-9]+;", " ")
    return one_blank(F.when(text.rlike("[<&]"), bare).otherwise(text))


def strip_latex(text: Column) -> Column:
    """One-argument commands give their argument, from the inside out three levels deep;
    other commands, math marks and braces go."""
    out = text
    for _ in range(3):
        out = F.regexp_replace(out, r"\\[a-zA-Z]+\*?\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"\\[\"'`^~=.]\{?([a-zA-Z])\}?", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\\[a-zA-Z]+\*?|\\.", " "), r"[{}$]", "")
    return F.when(text.rlike(r"[\\{}$]"), out).otherwise(text)


def title_key_compact(title: Column) -> Column:
    """Lower-cased letters and digits alone."""
    return F.regexp_replace(F.lower(title), "[^a-z0-9]", "")


def title_key_full(title: Column) -> Column:
    """Without markup, marks, a leading label and a leading ``name:``, then compact."""
    out = F.lower(fold_diacritics(strip_latex(F.regexp_replace(title, "<[^>]+>", ""))))
    out = F.regexp_replace(out, "^(" + "|".join(TITLE_LABELS) + r")\s*", "")
    return F.regexp_replace(F.regexp_replace(out, r"^[a-z0-9-]+:\s+", ""), "[^a-z0-9]", "")


def title_key_spaced(title: Column) -> Column:
    """Lower-cased runs of letters and digits with one blank between."""
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def title_slug(title: Column, most: int = 200) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(~slug.isin("", "unknown", "untitled", "n-a"), slug), 1, most)


def normalize_text(text: Column) -> Column:
    """Folded, lower case, without punctuation but apostrophes, single blanks."""
    out = F.lower(fold_diacritics(straight_apostrophes(text)))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9_\s']", ""), r"\s+", " "))


def year_in(text: Column) -> Column:
    """The first year from 1900 to 2099 that stands alone, or null."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")).cast("int")


def normalize_doi(doi: Column) -> Column:
    """Lower case without resolver prefix, fragment and closing punctuation; else null."""
    out = F.regexp_replace(F.lower(F.trim(doi)), r"^(?:https?://)?(?:dx\.)?doi\.org/|^doi:\s*", "")
    out = F.regexp_replace(F.regexp_replace(out, "#.*$", ""), r"[.,;:)\]}\s]+$", "")
    return F.when(out.rlike(r"^10\.[0-9]{4,9}/\S+$"), out)


def dois_agree(a: Column, b: Column) -> Column:
    """Equal, or one of 7 or more characters is the other's prefix up to a ``/`` or ``.``."""
    x, y = normalize_doi(a), normalize_doi(b)
    short, full = F.when(F.length(x) <= F.length(y), x).otherwise(y), F.when(F.length(x) <= F.length(y), y).otherwise(x)
    after = F.substring(full, F.length(short) + 1, F.lit(1))
    return (x == y) | ((F.length(short) >= 7) & F.startswith(full, short) & after.isin("/", "."))


def arxiv_id(text: Column) -> Column:
    """An arXiv identifier of either style, without its version. A new one counts where it
    stands alone or the text speaks of arXiv: other numbers look the same."""
    alone = text.rlike(r"^\s*[0-9]{4}\.[0-9]{4,5}(?:v[0-9]+)?\s*$") | F.contains(F.lower(text), F.lit("arxiv"))
    new = F.when(text.rlike(r"[0-9]{4}\.[0-9]{4}") & alone, F.regexp_extract(text, r"(?<![0-9])([0-9]{4}\.[0-9]{4,5})(?:v[0-9]+)?(?![0-9])", 1))
    old = F.when(text.rlike("/[0-9]{7}"), F.regexp_extract(F.lower(text), r"(?<![a-z-])([a-z-]+(?:\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?(?![0-9])", 1))
    return F.coalesce(F.nullif(new, F.lit("")), F.nullif(old, F.lit("")))


def email_domain(email: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(email, "^[^@]*@(.+)$", 1)), F.lit(""))


def url_host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1), F.lit(""))


def clean_url(url: Column) -> Column:
    """Without tracking parameters, fragment and closing punctuation."""
    out = F.regexp_replace(F.trim(url), "#.*$", "")
    out = F.regexp_replace(out, r"[?&](?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    return F.regexp_replace(out, r"[.,;)\]]+$", "")


def count_words(text: Column) -> Column:
    """Tokens that start with a letter."""
    return F.regexp_count(text, F.lit(r"[A-Za-z][A-Za-z'-]*")).cast("long")


def non_prose_share(text: Column) -> Column:
    """1 - letters-only tokens / tokens, 1 for no token."""
    tokens = F.filter(F.split(text, r"[ \t-\r]+"), lambda t: t != "")
    prose = F.filter(tokens, lambda t: t.rlike(r"^[A-Za-z]+[.,;:!?]?$"))
    return F.when(F.size(tokens) > 0, 1 - F.size(prose) / F.size(tokens)).otherwise(1.0)


def sentences(text: Column, most: int = 40, least: int = 40, longest: int = 320) -> Column:
    """Distinct sentences of fitting length in order of first appearance, ``most`` at most."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    fit = F.filter(parts, lambda s: (F.length(s) >= least) & (F.length(s) <= longest))
    return F.slice(F.array_distinct(fit), 1, most)


def short_quote(text: Column, most: int = 400) -> Column:
    """Cut at the last blank before ``most`` characters, with an ellipsis."""
    cut = F.regexp_replace(F.substring(text, 1, most), r"\s+\S*\z", "")
    return F.when(F.length(text) > most, F.concat(cut, F.lit("…"))).otherwise(text)


def inverted_index(words: Column) -> Column:
    """A map from each word to its places, from 0: the words are sorted with their places, and
    runs of equal ones are cut out, within the row that holds the text."""
    placed = F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))

    def cut(s):
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1)["word"] != x["word"]), i)), lambda i: i.isNotNull())
        return let(starts, lambda a: runs(s, a))

    def runs(s, starts):
        return F.map_from_entries(
            F.transform(
                starts,
                lambda a, k: F.struct(
                    F.get(s, a)["word"].alias("word"),
                    F.transform(F.slice(s, a + 1, F.coalesce(F.get(starts, k + 1), F.size(s)) - a), lambda x: x["at"]).alias("at"),
                ),
            )
        )

    return let(placed, cut)


def text_of_inverted_index(index: Column, most: int | None = None) -> Column:
    """The text of a map from words to their positions; of an abstract, say, its first
    ``most`` characters."""
    pairs = F.flatten(
        F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("w"))))
    )
    whole = F.array_join(F.transform(F.array_sort(pairs), lambda p: p["w"]), " ")
    return whole if most is None else F.left(whole, F.lit(most))


def expand_marker(marker: Column, widest: int = 50) -> Column:
    """Numbers a citation marker stands for: ``[2, 5-7]`` is 2, 5, 6, 7. Reversed ranges and
    ranges over ``widest`` give nothing."""
    parts = F.split(F.regexp_replace(F.translate(marker, "–—[]()", "--"), r"\s", ""), "[,;]")

    def numbers(p):
        a = F.regexp_extract(p, "^([0-9]+)(?:-([0-9]+))?$", 1).try_cast("int")
        b = F.coalesce(F.regexp_extract(p, "^([0-9]+)(?:-([0-9]+))?$", 2).try_cast("int"), a)
        none = F.array().cast("array<int>")
        return F.when((a <= b) & (b - a <= widest), F.sequence(a, b)).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(parts, numbers)))


def citation_family(text: Column) -> Column:
    """Which marker family dominates: numeric, author-year, alpha, or mixed / none."""
    numeric = F.regexp_count(text, F.lit(r"\[[0-9]+(?:\s*[,;–-]\s*[0-9]+)*\]"))
    year = F.regexp_count(text, F.lit(r"\([A-Z][A-Za-z-]+(?: et al\.?)?,? (?:19|20)[0-9]{2}[a-z]?\)"))
    alpha = F.regexp_count(text, F.lit(r"\[[A-Z][A-Za-z+]{1,4}[0-9]{2}[a-z]?\]"))
    total = numeric + year + alpha
    return (
        F.when(total == 0, "none")
        .when(numeric >= 0.7 * total, "numeric")
        .when(year >= 0.7 * total, "author-year")
        .when(alpha >= 0.7 * total, "alpha")
        .otherwise("mixed")
    )


#: Small words that belong to a surname, and what may follow a name.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "el", "bin", "ibn", "ter", "ten")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv")


def name_parts(author: Column) -> Column:
    """``struct<family, last, spelled, initials, words, own, short, turned>`` of ``First M.
    Last``, ``Last, First M.`` and ``Last FM``: the surname with and without its particles,
    letters alone, and as it is spelled with ae, oe, ue for umlauts; the initials in order; all
    words, sorted; the surname's words; whether the given names are initials alone; and, of a
    name without comma, its first word and the initials of the others, for names written
    family first. A name of one word has no initials."""
    plain = straight_apostrophes(F.trim(author))
    ascii_ = F.replace(F.trim(author), F.lit("`"), F.lit("'"))
    for mark, two in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue")):
        plain = F.replace(plain, F.lit(mark), F.lit(two + "\u0001"))
    # the second letter of a spelled umlaut carries a mark: without both letters it is the folded form
    plain = F.when(beyond_ascii(author), plain).otherwise(ascii_)
    return let(plain, lambda p: _name_parts(F.when(F.contains(p, F.lit("\u0001")), F.regexp_replace(p, "e\u0001", "")).otherwise(p), F.replace(p, F.lit("\u0001"), F.lit(""))))


def _name_parts(folded: Column, spelled: Column) -> Column:
    def flatten(t):
        return let(t, lambda x: F.translate(F.when(beyond_ascii(x), fold_diacritics(x)).otherwise(x), ".\u00b4", "  "))

    flat = flatten(folded)
    bare = F.trim(F.regexp_replace(flat, r"(?i)[,\s]+(?:" + "|".join(SUFFIXES) + r")\s*$", ""))

    def tokens(t):
        return F.filter(F.split(F.regexp_replace(t, "[^A-Za-z'\\s-]", " "), r"[\s-]+"), lambda w: w != "")

    letters = r"^[A-Z]{1,3}$"

    def letters_of(w):
        return F.regexp_replace(F.lower(F.array_join(w, "")), "[^a-z]", "")

    # each step binds what the next one uses more than once
    def split(x):
        comma, every = x["comma"], x["every"]
        n = F.size(every)
        tail = F.size(F.filter(every, lambda w: w.rlike(letters)))
        # Last FM: capitals at the end, after a longer word
        short_last = ~comma & (n >= 2) & F.get(every, n - 1).rlike(letters) & ~F.get(every, F.lit(0)).rlike(letters)
        at = F.array_position(F.transform(every, lambda w: F.lower(w).isin(*PARTICLES)), F.lit(True))
        first_of_family = let(at, lambda at: F.when((at > 1) & (at < n), at - 1).otherwise(n - 1))
        places = F.struct(n.alias("n"), tail.alias("tail"), short_last.alias("short_last"), first_of_family.alias("first"))
        return let(places, lambda p: by_place(x, p))

    def by_place(x, p):
        comma, every, n = x["comma"], x["every"], p["n"]
        family = (
            F.when(comma, tokens(F.split_part(x["t"], F.lit(","), F.lit(1))))
            .when(p["short_last"], F.slice(every, F.lit(1), F.greatest(n - p["tail"], F.lit(1))))
            .otherwise(F.slice(every, F.greatest(p["first"], F.lit(0)) + 1, F.greatest(n, F.lit(1))))
        )
        given = (
            F.when(comma, tokens(F.split_part(x["t"], F.lit(","), F.lit(2))))
            .when(p["short_last"], F.slice(every, F.greatest(n - p["tail"], F.lit(1)) + 1, F.greatest(p["tail"], F.lit(1))))
            .otherwise(F.slice(every, F.lit(1), F.greatest(p["first"], F.lit(0))))
        )
        own = let(family, lambda f: let(F.filter(f, lambda w: ~F.lower(w).isin(*PARTICLES)), lambda o: F.when(F.size(o) > 0, o).otherwise(f)))
        return let(F.struct(family.alias("family"), given.alias("given"), own.alias("own")), lambda names: parts(x, n, names))

    def parts(x, n, names):
        comma, every, family, given, own = x["comma"], x["every"], names["family"], names["given"], names["own"]
        initials = F.transform(given, lambda w: F.when(w.rlike(letters), w).otherwise(F.substring(w, 1, 1)))
        # the surname's place among the words is that of the folded name's
        as_spelled = F.slice(x["spelled"], F.greatest(F.array_position(every, F.get(own, F.lit(0))).cast("int"), F.lit(1)), F.greatest(F.size(own), F.lit(1)))
        turned = F.when(~comma & (n >= 3), F.struct(letters_of(F.slice(every, 1, 1)).alias("last"), F.lower(F.array_join(F.transform(F.slice(every, F.lit(2), F.greatest(n - 1, F.lit(1))), lambda w: F.substring(w, 1, 1)), "")).alias("initials")))
        return F.struct(
            letters_of(family).alias("family"),
            letters_of(own).alias("last"),
            letters_of(as_spelled).alias("spelled"),
            F.lower(F.array_join(initials, "")).alias("initials"),
            F.array_sort(F.transform(every, lambda w: F.lower(w))).alias("words"),
            F.transform(own, lambda w: F.lower(w)).alias("own"),
            ((F.size(given) > 0) & F.forall(given, lambda w: w.rlike(letters))).alias("short"),
            turned.alias("turned"),
        )

    return let(bare, lambda b: let(F.struct(b.alias("t"), F.contains(b, F.lit(",")).alias("comma"), tokens(b).alias("every"), tokens(flatten(spelled)).alias("spelled")), split))


def surname(author: Column) -> Column:
    """Of ``First Last`` and ``Last, First``, folded, letters alone."""
    last = F.when(author.contains(","), F.split_part(author, F.lit(","), F.lit(1))).otherwise(
        F.regexp_extract(F.trim(author), r"(\S+)$", 1)
    )
    folded = let(last, lambda t: F.when(beyond_ascii(t), fold_diacritics(t)).otherwise(t))
    return F.regexp_replace(F.lower(folded), "[^a-z]", "")


def _short_of_compound(x: Column, y: Column) -> Column:
    """``x``, a surname and initials, is a short form of ``y``: its surname's words are all among
    those of ``y``, and each initial begins another of them (``Silva DO`` and ``de Oliveira SD``
    of ``Danilo de Oliveira Silva``)."""
    others = F.filter(y["words"], lambda w: ~F.array_contains(x["own"], w) & ~w.isin(*PARTICLES))
    letters = F.split(x["initials"], "")
    begun = F.forall(letters, lambda c: F.exists(others, lambda w: F.startswith(w, c)))
    within = F.forall(x["own"], lambda w: F.array_contains(y["words"], w) & (F.length(w) > 1))
    return x["short"] & ~y["short"] & (F.size(y["own"]) > 1) & within & begun & (F.length(x["initials"]) <= F.size(others))


def same_parts(x: Column, y: Column) -> Column:
    """Whether two ``name_parts`` may be one person's: the same words in any order, or surnames
    that agree, particles and the spelling of umlauts aside, and initials of which one side's
    open the other's; a short form of a name with several surnames; a name written family
    first against one whose initials are all its others. A bare surname agrees with any
    initials."""
    family = (x["last"] != "") & ((x["last"] == y["last"]) | (x["family"] == y["family"]) | (x["spelled"] == y["last"]) | (x["last"] == y["spelled"]))
    opens = F.startswith(x["initials"], y["initials"]) | F.startswith(y["initials"], x["initials"])

    def turned(a, b):
        return F.coalesce((a["turned"]["last"] == b["last"]) & (a["turned"]["initials"] == b["initials"]) & b["short"], F.lit(False))

    return (
        ((F.size(x["words"]) > 1) & (x["words"] == y["words"]))
        | (family & opens)
        | turned(x, y)
        | turned(y, x)
        | _short_of_compound(x, y)
        | _short_of_compound(y, x)
    )


def same_author(a: Column, b: Column) -> Column:
    return let(F.struct(name_parts(a).alias("x"), name_parts(b).alias("y")), lambda t: same_parts(t["x"], t["y"]))


def _parts_of(authors: Column) -> Column:
    return F.transform(authors, name_parts)


def author_overlap(cited: Column, found: Column) -> Column:
    """Share of the first ten cited authors that the work has; null below two on a side. Of
    two cited authors, one found says nothing: null."""
    lists = F.struct(_parts_of(F.slice(cited, 1, 10)).alias("c"), _parts_of(found).alias("f"))
    hits = let(lists, lambda t: F.size(F.filter(t["c"], lambda a: F.exists(t["f"], lambda b: same_parts(a, b)))))
    n = F.least(F.size(cited), F.lit(10))
    share = let(hits, lambda h: F.when((n <= 2) & (h >= 1) & (h < n), None).otherwise(h / n))
    return F.when((F.size(cited) >= 2) & (F.size(found) >= 2), share)


def _title_words(t: Column) -> Column:
    every = F.array_distinct(F.split(t, " "))
    kept = F.array_except(every, F.array(*map(F.lit, STOP_WORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def comparable_title(t: Column) -> Column:
    """A title as ``title_similarity`` compares it: without markup and a closing year, lower
    case, words with one blank between; '' for null."""
    year = r"[,\s]*\b(?:19|20)[0-9]{2}\b\s*$"
    low = let(strip_html(t), lambda x: F.trim(F.regexp_replace(F.trim(F.lower(strip_latex(x))), year, "")))
    return F.coalesce(one_blank(F.regexp_replace(low, r"[^\w\s]", " ")), F.lit(""))


def without_edition(t: Column) -> Column:
    return F.regexp_replace(t, r"\s+(?:second|third|fourth|fifth|revised|updated|new|latest|[0-9]+(?:st|nd|rd|th))\s+edition$", "")


def title_similarity(a: Column, b: Column) -> Column:
    """From 0 to 1: equal after normalising (also compact, and without an edition) is 1;
    one inside the other 0.95 from four fifths of its length, else 0.7; otherwise the
    Jaccard share of words that are no stop words, at least 0.85 where nine tenths of the
    smaller set and seven tenths of the union agree, and 0.7 of it plus 0.3 for agreement
    of word pairs in order below that. A null or empty title is like nothing."""
    return let(F.struct(comparable_title(a).alias("x"), comparable_title(b).alias("y")), lambda t: comparable_similarity(t["x"], t["y"]))


def comparable_similarity(x: Column, y: Column) -> Column:
    """``title_similarity`` of two comparable titles."""
    longer = F.length(x) < F.length(y)
    short, full = F.when(longer, x).otherwise(y), F.when(longer, y).otherwise(x)

    def by_words(w):
        shared, union = F.size(F.array_intersect(w["x"], w["y"])), F.size(F.array_union(w["x"], w["y"]))
        jaccard = shared / union
        tokens = F.split(x, " ")
        pairs = F.zip_with(tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(1))), lambda p, q: F.concat_ws(" ", p, q))
        pairs = F.slice(pairs, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1)))
        ordered = F.size(F.filter(pairs, lambda p: F.contains(y, p))) / F.size(pairs)
        near = (shared >= 0.9 * F.least(F.size(w["x"]), F.size(w["y"]))) & (jaccard >= 0.7)
        return F.when(near, F.greatest(F.lit(0.85), jaccard)).otherwise(F.least(F.lit(1.0), jaccard * 0.7 + ordered * 0.3))

    words = F.struct(_title_words(x).alias("x"), _title_words(y).alias("y"))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(F.replace(x, F.lit(" "), F.lit("")) == F.replace(y, F.lit(" "), F.lit("")), 1.0)
        .when(without_edition(x) == without_edition(y), 1.0)
        .when(F.contains(full, short), F.when(F.length(short) >= 0.8 * F.length(full), 0.95).otherwise(0.7))
        .otherwise(let(words, by_words))
    )


def typo_distance_allowed(a: Column, b: Column) -> Column:
    return F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.greatest(F.length(a), F.length(b)) / 25).cast("int")))


def titles_match_but_typos(a: Column, b: Column) -> Column:
    """Edit distance of the spaced keys within 1 to 3, by length; the built-in stops early."""
    x, y = title_key_spaced(a), title_key_spaced(b)
    return (x != "") & (y != "") & F.levenshtein(x, y, 3).between(0, typo_distance_allowed(x, y))
