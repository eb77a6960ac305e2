"""Similar titles without blocks: candidates meet at rare words, growth follows the titles.

Titles of one comparable form are one title. Two titles can only reach the score when their
sets of words overlap by a known share, so in an order of rising frequency they agree in one
of their first words (prefix filter); titles equal but for blanks or an edition meet by that
key; a title inside another one meets it at its rarest inner word, which stands whole in the
other, or, with one or two words, at its rarest three letters. Each pair that meets is
scored once, where the whole sets do. What is known of frequencies, a bounded list, changes how many meet, never the
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import STOP_WORDS, comparable_similarity, comparable_title, without_edition
from citelake.storage import materialize

_KNOWN = 4096  # frequent words, and frequent triples of letters, that are told apart


def _by_frequency(rows: DataFrame, own: list[str], items: str) -> DataFrame:
    """``own`` with the distinct ``items`` of its array in rising order of frequency: those
    outside the most frequent ``_KNOWN`` ones first."""
    each = rows.select(*own, F.explode(F.array_distinct(items)).alias("w"))
    known = each.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(_KNOWN)
    counted = each.join(F.broadcast(known), "w", "left").select(*own, F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.xxhash64("w").alias("h"), "w").alias("s"))
    return counted.groupBy(*own).agg(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["w"]).alias(items))


def _triples(text):
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1)))
    return F.transform(at, lambda i: F.substring(text, i, 3))


def contained_pairs(rows: DataFrame, own: str, text: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``(inner, outer)``: values of ``own`` whose text stands inside another, longer one with
    equal ``within`` columns. Texts are compared as they are; those under three characters, and
    null ones, are inside nothing."""
    base = rows.select(own, *within, F.col(text).alias("t"), F.split(text, " ").alias("tokens")).where("length(t) > 2")
    inner_words = F.slice("tokens", 2, F.greatest(F.size("tokens") - 2, F.lit(1)))
    met = []
    for long_enough, items, own_items in ((F.size("tokens") > 2, F.col("tokens"), inner_words), (F.size("tokens") <= 2, _triples(F.col("t")), _triples(F.col("t")))):
        every = base.select(own, *within, "t", items.alias("items"))
        ordered = _by_frequency(base.where(long_enough).select(own, own_items.alias("own_items"), items.alias("items")), [own, "own_items"], "items")
        rarest = ordered.select(F.col(own).alias("inner"), F.array_intersect("items", "own_items")[0].alias("w"))
        small = rarest.join(base.select(F.col(own).alias("inner"), *within, F.col("t").alias("short")), "inner")
        large = every.select(F.col(own).alias("outer"), *within, "t", F.explode(F.array_distinct("items")).alias("w"))
        pairs = small.join(large, ["w", *within]).where((F.length("short") < F.length("t")) & F.contains("t", F.col("short")))
        met.append(pairs.select("inner", "outer"))
    return met[0].union(met[1])


def word_candidates(titles: DataFrame, title: str, share: float) -> DataFrame:
    """``(a, b)``, a < b: comparable titles whose sets of words, stop words aside, overlap by
    ``share`` of their union."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    tokens = F.array_distinct(F.split(title, " "))
    kept = F.when(F.size(F.array_except(tokens, stop)) > 0, F.array_except(tokens, stop)).otherwise(tokens)
    sets = _by_frequency(titles.select(title, kept.alias("words")), [title], "words")
    n = F.size("words")
    sides = sets.select(title, "words", (n - F.ceil(F.lit(share) * n - 1e-9).cast("int") + 1).alias("first"))
    first = F.explode(F.slice("words", F.lit(1), F.col("first"))).alias("w")
    left, right = (sides.select(first, *[F.col(c).alias(f"{c}_{s}") for c in (title, "words", "first")]) for s in "ab")
    met = left.join(right, "w").where(F.col(f"{title}_a") < F.col(f"{title}_b"))
    least, most = F.least(F.size("words_a"), F.size("words_b")), F.greatest(F.size("words_a"), F.size("words_b"))
    firsts = [F.slice(f"words_{s}", F.lit(1), F.col(f"first_{s}")) for s in "ab"]
    once = F.array_intersect(*firsts)[0] == F.col("w")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    enough = shared >= F.lit(share - 1e-9) * (least + most - shared)
    met = met.where((least >= F.lit(share - 1e-9) * most) & once & enough)
    return met.select(F.col(f"{title}_a").alias("a"), F.col(f"{title}_b").alias("b"))


def similar_titles(titles: DataFrame, title: str, least: float = 0.5) -> DataFrame:
    """``(a, b, score)``, a < b: comparable titles of a table of distinct ones whose
    ``title_similarity`` is at least ``least``, which must be over 0.3. Titles under three
    characters are similar by equality alone."""
    if not 0.3 < least <= 1:
        raise ValueError("least must be over 0.3 and at most 1")
    share = (least - 0.3) / 0.7
    words = word_candidates(titles, title, min(share, 0.7) if least <= 0.85 else share)
    keys = F.array_distinct(F.array(F.replace(title, F.lit(" "), F.lit("")), without_edition(F.col(title))))
    left, right = (titles.select(F.explode(keys).alias("key"), F.col(title).alias(s)) for s in "ab")
    equal = left.join(right, "key").where("a < b").select("a", "b")
    inside = contained_pairs(titles.withColumn("_own", F.col(title)), "_own", title)
    if least > 0.7:
        inside = inside.where(F.length("inner") >= 0.8 * F.length("outer"))
    inside = inside.select(F.least("inner", "outer").alias("a"), F.greatest("inner", "outer").alias("b"))
    met = words.union(equal).union(inside).distinct()
    score = F.array(comparable_similarity(F.col("a"), F.col("b")))  # in an array: a filter on a column computes it anew
    return met.select("a", "b", F.explode(F.filter(score, lambda s: s >= least)).alias("score"))


def best_similar(rows: DataFrame, own: str, title: str, least: float = 0.5) -> DataFrame:
    """``(own, other, score)``: for each row the row of the most similar title, at ``least`` or
    over, ties to the smaller ``other``. Equal titles score 1; empty ones match nothing."""
    named = materialize(rows.select(own, comparable_title(F.col(title)).alias("t")).where("t <> ''"), "titles")
    first = named.groupBy("t").agg(F.min(own).alias("first"))
    second = named.join(first, "t").where(F.col(own) != F.col("first")).groupBy("t").agg(F.min(own).alias("second"))
    pairs = similar_titles(first.select("t"), "t", least)
    near = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("t"), F.col("b").alias("u")), F.struct(F.col("b").alias("t"), F.col("a").alias("u")))).alias("s"), "score")
    near = near.select("s.t", "s.u", "score").join(first.select(F.col("t").alias("u"), F.col("first").alias("other")), "u")
    best = near.groupBy("t").agg(F.min(F.struct((-F.col("score")).alias("s"), "other")).alias("best"))
    known = named.join(first, "t").join(second, "t", "left").join(best, "t", "left")
    twin = F.when(F.col("first") != F.col(own), F.col("first")).otherwise(F.col("second"))
    same = F.when(twin.isNotNull(), F.struct(F.lit(-1.0).alias("s"), twin.alias("other")))
    return known.withColumn("m", F.least(same, F.col("best"))).where("m is not null").select(own, F.col("m.other").alias("other"), (-F.col("m.s")).alias("score"))


def discrepancies(rows: DataFrame, own: str, title: str, fields: list[str], prefix: int = 80) -> DataFrame:
    """``(own, first, differs)``: rows that share the first ``prefix`` characters of their
    comparable title with an earlier row, and the fields in which both have values that
    differ from that of the earliest. One comparison a row, however many share a title."""
    key = F.left(comparable_title(F.col(title)), F.lit(prefix))
    keyed = rows.select(own, key.alias("k"), *fields).where("k <> ''")
    first = keyed.groupBy("k").agg(F.min_by(F.struct(F.col(own).alias("first"), *fields), own).alias("f"))
    met = keyed.join(first, "k").where(F.col(own) != F.col("f.first"))
    differs = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"f.{c}"), F.lit(c)) for c in fields]))
    return met.select(own, "f.first", differs.alias("differs")).where(F.size("differs") > 0)
