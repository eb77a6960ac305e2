"""Repeated references of a list, as reading it in order and keeping the first of each finds.

Two references say the same when their titles are equal; when their authors are and one
title stands inside the other; or when one has an arXiv number for a title, the other a real
one, and both venues give the same number or half of the shorter list of authors agrees. A
reference goes when it says the same as an earlier one *that stays*, so one that goes takes
no other with it. A list of up to ``_AT_ONCE`` references is read so where its rows meet, in
one shuffle. Over longer lists the rule is settled in rounds: each round decides the
references before which none that says the same is open. Equal titles are never paired
there: they meet in minima of their title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.names import parse_authors
from citelake.functions.text import let
from citelake.operators.similarity import contained_pairs
from citelake.storage import discard, materialize

_ARXIV_TITLE = r"arxiv\s*preprint\s*arxiv:[0-9]{4}\.[0-9]{4,5}"
_ARXIV_NUMBER = r"arxiv:[0-9]{4}\.[0-9]{4,5}"
_AT_ONCE = 256  # references of a list that are read in one row


def _number(venue: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(venue), _ARXIV_NUMBER, 0), F.lit(""))


def _people(authors: Column) -> Column:
    names = F.transform(parse_authors(F.replace(authors, F.lit("*"), F.lit(";"))), lambda a: F.lower(F.trim(a)))
    return F.array_except(F.array_distinct(names), F.array(F.lit("et al"), F.lit("others"), F.lit("")))


def _texts(refs: DataFrame, ref: str, group: Column) -> DataFrame:
    text = [F.coalesce(F.lower(F.trim(c)), F.lit("")).alias(n) for c, n in (("title", "t"), ("authors", "authors"), ("venue", "venue"))]
    return refs.select(F.col(ref).alias("own"), group.alias("list"), *text)


def _same(x: Column, y: Column) -> Column:
    """The rule for two references of a row."""
    written = (x["authors"] != "") & (x["authors"] == y["authors"]) & (F.least(F.length(x["t"]), F.length(y["t"])) > 2)
    inside = F.contains(x["t"], y["t"]) | F.contains(y["t"], x["t"])
    both = F.size(F.array_intersect(x["people"], y["people"]))
    work = (x["number"] == y["number"]) | ((both > 0) & (both >= 0.5 * F.least(F.size(x["people"]), F.size(y["people"]))))
    return (x["t"] == y["t"]) | (written & inside) | ((x["is_number"] != y["is_number"]) & F.coalesce(work, F.lit(False)))


def _gone(items: Column, mixed: Column) -> Column:
    """``own, kept`` of those that go of a sorted array: each is held against those before it
    that stay. Numbers and people are taken apart only where ``mixed``: a title is a number."""
    full = F.transform(
        items,
        lambda x: F.struct(
            x["own"].alias("own"), x["t"].alias("t"), x["authors"].alias("authors"), x["is_number"].alias("is_number"),
            F.when(mixed, _number(x["venue"])).alias("number"), F.when(mixed, _people(x["authors"])).alias("people"), x["own"].alias("kept"),
        ),
    )

    def read(done, x):
        first = F.get(F.filter(done, lambda k: (k["kept"] == k["own"]) & _same(k, x)), 0)
        return F.array_append(done, x.withField("kept", F.coalesce(first["own"], x["own"])))

    done = let(full, lambda f: F.aggregate(f, F.slice(f, 1, 0), read))
    return F.transform(F.filter(done, lambda k: k["kept"] != k["own"]), lambda k: F.struct(k["own"].alias("own"), k["kept"].alias("kept")))


def _same_authors(records: DataFrame) -> DataFrame:
    """Pairs with equal authors of which one title stands inside the other one."""
    found = contained_pairs(records.select("r", "list", "authors", "t").where("authors <> ''"), "r", "t", ("list", "authors"))
    return found.select(F.least("inner", "outer").alias("a"), F.greatest("inner", "outer").alias("b"))


def _arxiv_titles(records: DataFrame) -> DataFrame:
    """Pairs of an arXiv number for a title and a real title of one work."""
    rows = records.select("r", "list", F.col("t").rlike(_ARXIV_TITLE).alias("is_number"), _number(F.col("venue")).alias("number"), _people(F.col("authors")).alias("people"))
    number_rows, real = (rows.where(c).select("list", "number", "people", F.col("r").alias(s)) for c, s in (("is_number", "x"), ("not is_number", "y")))
    by_number = number_rows.select("list", "number", "x").join(real.select("list", "number", "y"), ["list", "number"]).select("x", "y")
    left, right = (f.select("list", k, F.size("people").alias(f"n_{k}"), F.explode("people").alias("person")) for f, k in ((number_rows, "x"), (real, "y")))
    shared = left.join(right, ["list", "person"]).groupBy("x", "y", "n_x", "n_y").agg(F.count("*").alias("n"))
    by_people = shared.where("n >= 0.5 * least(n_x, n_y)").select("x", "y")
    return by_number.union(by_people).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _settled(rows: DataFrame, most_rounds: int) -> DataFrame:
    """``(list, own, kept)`` of those that go, whatever the size of a list.

    References equal in all of their texts are one record. Rounds go on while something is
    open; each is a join on the pairs and an aggregation by title, written to the shared folder.
    """
    rows = materialize(rows.where("t <> ''"), "references")
    records = materialize(rows.groupBy("list", "t", "authors", "venue").agg(F.min("own").alias("r")), "records")
    pairs = materialize(_same_authors(records).union(_arxiv_titles(records)).distinct(), "pairs")
    # kept is null while a record is open, then the record that stays for it; a title is named by its first record
    titles = records.groupBy("list", "t").agg(F.min("r").alias("title"))
    state = materialize(records.join(titles, ["list", "t"]).select("r", "title", F.lit(None).cast(rows.schema["own"].dataType).alias("kept")), "state")
    for _ in range(most_rounds):
        stays, open_ = F.when(F.col("kept") == F.col("r"), F.col("r")), F.when(F.col("kept").isNull(), F.col("r"))
        by_title = state.groupBy("title").agg(F.min(stays).alias("stays"), F.min(open_).alias("open"))
        of_pair = pairs.join(state.select(F.col("r").alias("a"), "kept"), "a")
        by_pair = of_pair.groupBy(F.col("b").alias("r")).agg(
            F.min(F.when(F.col("kept") == F.col("a"), F.col("a"))).alias("pair_stays"), F.min(F.when(F.col("kept").isNull(), F.col("a"))).alias("pair_open")
        )
        both = state.join(by_title, "title").join(by_pair, "r", "left")
        earlier = F.when(F.col("stays") < F.col("r"), F.col("stays"))
        first = F.least(earlier, F.col("pair_stays"))
        waits = (F.col("open") < F.col("r")) | F.col("pair_open").isNotNull()
        decided = F.coalesce("kept", F.when(~F.coalesce(waits, F.lit(False)), F.coalesce(first, F.col("r"))))
        before, state = state, materialize(both.select("r", "title", decided.alias("kept")), "state")
        discard(before)
        if state.where("kept is null").isEmpty():
            break
    else:
        raise RuntimeError("repeated references did not settle")
    known = rows.join(records, ["list", "t", "authors", "venue"]).join(state.select("r", "kept"), "r")
    gone = materialize(known.where("own <> kept").select("list", "own", "kept"), "gone")
    discard(rows, records, pairs, state)
    return gone


def repeated_by_list(refs: DataFrame, ref: str, list_of: str, most_rounds: int = 1000, at_once: int = _AT_ONCE) -> DataFrame:
    """``(list_of, n, gone)``: numbers of references and arrays of ``own, kept`` of those that
    go, as ``repeated`` finds them, to be added up by list: one row for a list of up to
    ``at_once`` references, several for a longer one. Those without a list are left out.

    A longer list is written in runs of ``at_once`` and settled in rounds with the others.
    """
    rows = _texts(refs.where(F.col(list_of).isNotNull()), ref, F.col(list_of))
    order = Window.partitionBy("list").orderBy("own")
    size = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = rows.withColumn("is_number", F.col("t").rlike(_ARXIV_TITLE)).withColumn("place", F.row_number().over(order)).withColumn("long", size > at_once)
    run = F.when(F.col("long"), F.floor((F.col("place") - 1) / F.lit(at_once))).otherwise(F.lit(0))
    named = F.when(F.col("t") != "", F.struct("own", "t", "authors", "venue", "is_number"))
    runs = placed.groupBy("list", "long", run.alias("run")).agg(F.count("*").alias("n"), F.max("is_number").alias("mixed"), F.sort_array(F.collect_list(named)).alias("items"))
    kind = rows.schema["own"].dataType.simpleString()
    none = F.array().cast(f"array<struct<own:{kind},kept:{kind}>>")
    gone = F.when(~F.col("long") & (F.size("items") > 1), _gone(F.col("items"), F.col("mixed"))).otherwise(none)
    found = materialize(runs.select("list", "n", gone.alias("gone"), "long", F.when(F.col("long"), F.col("items")).alias("items")), "lists")
    rows_of = found.select(F.col("list").alias(list_of), "n", "gone")
    if found.where("long").isEmpty():
        return rows_of
    long_rows = found.where("long").select("list", F.explode("items").alias("x")).select("x.own", "list", "x.t", "x.authors", "x.venue")
    more = _settled(long_rows, most_rounds).select(F.col("list").alias(list_of), F.lit(0).cast("long").alias("n"), F.array(F.struct("own", "kept")).alias("gone"))
    return rows_of.union(more)


def repeated(refs: DataFrame, ref: str, list_of: str | None = None, most_rounds: int = 1000, at_once: int = _AT_ONCE) -> DataFrame:
    """``(ref, kept)`` of the references that go, with the first one that stays and says the
    same. ``ref`` is unique and orders them; ``list_of`` names a list's column, where there are
    several. Needs ``title, authors, venue``. Null or empty titles, and titles in lower case
    under three characters beside longer ones, repeat nothing but their equals."""
    if list_of is None:
        return _settled(_texts(refs, ref, F.lit(0)), most_rounds).select(F.col("own").alias(ref), "kept")
    gone = repeated_by_list(refs, ref, list_of, most_rounds, at_once).select(F.explode("gone").alias("g"))
    return gone.select(F.col("g.own").alias(ref), "g.kept")
