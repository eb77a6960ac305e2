"""Titles whose words an extraction broke or ran together, repaired by a vocabulary.

The vocabulary is counted from a corpus. What a title might hold is looked up in one join:
its words, neighbours run together and neighbours with a hyphen. A fold over the words then
decides each line-end hyphen and each stray blank. A word that the vocabulary doesn't know is
cut where its pieces are most probable: dynamic programming over its places, as a fold whose
state is the best cost up to each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import let

_WORD = r"[a-z]+(?:-[a-z]+)*"


def vocabulary(texts: DataFrame, text: str, least: int = 2) -> DataFrame:
    """``(word, n)``: words of letters, with inner hyphens, that occur at least ``least`` times."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def word_breaks(words: DataFrame, word: str, known: DataFrame, longest: int = 24) -> DataFrame:
    """``(word, pieces)``: of distinct words, the cut into known words whose product of shares
    is largest, as ``array<struct<start, length>>``; a word that can't be cut has no row. A
    piece has at most ``longest`` letters."""
    total = known.agg(F.sum("n").alias("total"))
    n = F.length(word)
    starts = words.select(word, F.explode(F.sequence(F.lit(0), n - 1)).alias("start")).where(n > 0)
    ends = F.explode(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + longest))).alias("end")
    spans = starts.select(word, "start", ends)
    spans = spans.select("*", F.substring(F.col(word), F.col("start") + 1, F.col("end") - F.col("start")).alias("piece"))
    priced = spans.join(known.select(F.col("word").alias("piece"), "n"), "piece").crossJoin(F.broadcast(total))  # one row
    edges = priced.groupBy(word).agg(F.collect_list(F.struct("end", "start", (F.log("total") - F.log("n")).alias("cost"))).alias("edges"))

    def best(path, place):
        open_ = F.filter("edges", lambda e: (e["end"] == place) & (F.get(path, e["start"])["cost"] < never))
        costs = F.transform(open_, lambda e: F.struct((F.get(path, e["start"])["cost"] + e["cost"]).alias("cost"), e["start"].alias("start")))
        return F.array_append(path, F.coalesce(F.array_min(costs), F.struct(never.alias("cost"), F.lit(0).alias("start"))))

    never = F.lit(float("inf"))
    none = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("start")))
    path = F.aggregate(F.sequence(F.lit(1), n), none, best)
    empty = F.array().cast("array<struct<start:int,length:int>>")

    def back(state, _):
        start = F.get(F.col("path"), state["at"])["start"]
        piece = F.struct(start.alias("start"), (state["at"] - start).alias("length"))
        return F.when(state["at"] > 0, F.struct(start.alias("at"), F.concat(F.array(piece), state["pieces"]).alias("pieces"))).otherwise(state)

    found = edges.withColumn("path", path).where(F.get("path", n)["cost"] < never)
    cut = F.aggregate(F.sequence(F.lit(1), n), F.struct(n.alias("at"), empty.alias("pieces")), back)["pieces"]
    return found.select(word, cut.alias("pieces"))


def _joined(tokens: Column, count) -> Column:
    """Words with line-end hyphens and stray blanks settled."""

    def letters(t):
        return F.regexp_extract(F.lower(t), "([a-z]+)-?$", 1)

    def step(done, token):
        last = F.get(done, F.size(done) - 1)
        a, b = letters(last), F.regexp_extract(F.lower(token), "^([a-z]+)", 1)
        glued, hyphened = count(F.concat(a, b)), count(F.concat(a, F.lit("-"), b))
        some = (a != "") & (b != "")
        at_hyphen = F.coalesce(last.rlike("[A-Za-z]-$") & some, F.lit(False))
        word = F.when((glued > 0) | (hyphened > 0), glued >= hyphened).otherwise((count(a) == 0) | (count(b) == 0))
        whole = F.coalesce(last.rlike("^[A-Za-z]+$") & token.rlike("^[A-Za-z]+[.,;:!?]?$") & some, F.lit(False))
        stray = whole & (glued > 0) & ((count(a) == 0) | (count(b) == 0))
        merged = (
            F.when(at_hyphen & word, F.concat(F.regexp_replace(last, "-$", ""), token))
            .when(at_hyphen, F.concat(last, token))
            .when(stray, F.concat(last, token))
        )
        return F.when(merged.isNotNull(), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged))).otherwise(F.array_append(done, token))

    return F.aggregate(tokens, F.array().cast("array<string>"), step)


def repaired_titles(titles: DataFrame, own: str, title: str, known: DataFrame, least_glued: int = 8) -> DataFrame:
    """``(own, title)`` with whole words. At a hyphen before a blank the parts become one word
    or a compound, whichever the vocabulary has more of; if it has neither, one word when a
    part is no word by itself. Two neighbours become one word if that is known and one of them
    isn't. An unknown word of ``least_glued`` letters or more is cut into known ones, if it
    can be. ``own`` is unique; a null title stays null.
    """
    tokens = F.filter(F.split(F.col(title), r"\s+"), lambda t: t != "")
    rows = titles.select(own, tokens.alias("tokens"))
    bare = F.transform("tokens", lambda t: F.regexp_extract(F.lower(t), "([a-z]+)[^a-z]*$", 1))
    opening = F.transform("tokens", lambda t: F.regexp_extract(F.lower(t), "^([a-z]+)", 1))
    following = F.slice(opening, F.lit(2), F.greatest(F.size("tokens") - 1, F.lit(0)))
    both = F.filter(F.arrays_zip(bare.alias("a"), following.alias("b")), lambda z: z["b"].isNotNull())
    pairs = F.flatten(F.transform(both, lambda z: F.array(F.concat(z["a"], z["b"]), F.concat(z["a"], F.lit("-"), z["b"]))))
    asked = rows.select(own, F.explode(F.array_distinct(F.concat(bare, opening, pairs))).alias("word")).where("word <> ''")
    counts = asked.join(known, "word").groupBy(own).agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("counts"))
    looked = rows.join(counts, own, "left")

    def count(word):
        return F.coalesce(F.try_element_at("counts", word), F.lit(0))

    joined = looked.select(own, _joined(F.col("tokens"), count).alias("tokens"))
    each = joined.select(own, F.posexplode_outer("tokens").alias("at", "token"))
    core = F.regexp_extract("token", "^[^A-Za-z]*([A-Za-z]+)[^A-Za-z]*$", 1)
    each = each.withColumn("core", F.when(F.length(core) >= least_glued, F.lower(core)))
    unknown = each.where("core is not null").select("core").distinct().join(known.select(F.col("word").alias("core")), "core", "left_anti")
    cuts = word_breaks(unknown, "core", known).where(F.size("pieces") > 1)
    met = each.join(cuts, "core", "left")
    before, inner = F.regexp_extract("token", "^([^A-Za-z]*)", 1), core
    after = F.substring(F.col("token"), F.length(before) + F.length(inner) + 1, F.length("token"))
    pieces = F.array_join(F.transform("pieces", lambda p: F.substring(inner, p["start"] + 1, p["length"])), " ")
    word = F.when(F.col("pieces").isNotNull(), F.concat(before, pieces, after)).otherwise(F.col("token"))
    lists = met.groupBy(own).agg(F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", word.alias("w"))))).alias("words"))
    made = lists.select(own, F.array_join(F.transform("words", lambda w: w["w"]), " ").alias("made"))
    return titles.select(own, F.col(title).isNull().alias("_null")).join(made, own).select(own, F.when(~F.col("_null"), F.col("made")).alias(title))
