"""Broken and glued words against plain dynamic programming and cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from citelake.functions import titles, verdicts
from citelake.operators import wordbreaks

COUNTS = {"attention": 40, "is": 300, "all": 200, "you": 150, "need": 60, "a": 500, "at": 90, "ten": 5, "neural": 30, "networks": 25, "continuous": 12, "state": 20, "of": 400, "the": 500, "art": 9, "state-of-the-art": 7, "self-attention": 6, "self": 10, "ion": 2, "deep": 30, "learning": 40, "on": 100, "robust": 8}


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(list(COUNTS.items()), "word string, n long")


@pytest.mark.parametrize(
    ("broken", "whole"),
    [
        ("Attentionisallyouneed", "Attention is all you need"),
        ("Neu- ral networks", "Neural networks"),
        ("Contin-\n uous learning", "Continuous learning"),
        ("On self- attention", "On self-attention"),
        ("State- of- the- art networks", "State-of-the-art networks"),
        ("deep- state networks", "deep-state networks"),
        ("Ro bust learning", "Robust learning"),
        ("at ten networks", "at ten networks"),
        ("(neuralnetworks), deep", "(neural networks), deep"),
        ("unknownwordxyz stays", "unknownwordxyz stays"),
        ("xyzq- abcd stays", "xyzqabcd stays"),
        ("", ""),
        (None, None),
    ],
)
def test_repaired(spark, known, broken, whole):
    rows = spark.createDataFrame([(1, broken), (2, "deep learning")], "id int, t string")
    got = {r["id"]: r["t"] for r in wordbreaks.repaired_titles(rows, "id", "t", known).collect()}
    assert got == {1: whole, 2: "deep learning"}


def plain_break(word):
    total = sum(COUNTS.values())
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + math.log(total) - math.log(COUNTS[word[s:end]]), s) for s in range(end) if best[s] and word[s:end] in COUNTS]
        if options:
            cost, s = min(options)
            best[end] = cost, [*best[s][1], (s, end - s)]
    return best[-1] and best[-1][1]


def test_breaks_are_those_of_plain_dynamic_programming(spark, known):
    rng = random.Random(4)
    words = {"".join(rng.choices([w for w in COUNTS if "-" not in w], k=rng.randint(1, 5))) for _ in range(60)} | {"zzz", "atx", "q"}
    got = {r["w"]: [tuple(p) for p in r["pieces"]] for r in wordbreaks.word_breaks(spark.createDataFrame([(w,) for w in words], "w string"), "w", known).collect()}
    assert got == {w: plain_break(w) for w in words if plain_break(w)}


def test_vocabulary_counts_words(spark):
    rows = spark.createDataFrame([("A self-made man, a MAN.",), (None,), ("man-",)], "t string")
    assert {r["word"]: r["n"] for r in wordbreaks.vocabulary(rows, "t").collect()} == {"a": 2, "man": 3}


@pytest.mark.parametrize(
    ("title", "split", "glued"),
    [
        ("Improving mutual information estimatio n with bounds", True, False),
        ("A ro bust effect", True, False),
        ("Contin- uous bounds", True, False),
        ("Asystematicreviewofmethods", False, True),
        ("Anaigeneratedtextdetector of AI-generated text", False, True),
        ("A plain title of words", False, False),
        ("Internationalization of things", False, False),
        (None, False, False),
    ],
)
def test_split_and_glued_words(spark, title, split, glued):
    t = F.lit(title).cast("string")
    row = spark.range(1).select(verdicts.has_split_words(t).alias("s"), verdicts.has_glued_words(t).alias("g")).first()
    assert tuple(row) == (split, glued)


def test_spaces_lost_and_pages_without_titles(spark):
    none = F.lit(None).cast("string")
    row = spark.range(1).select(titles.spaces_lost(none, F.lit("a")).alias("a"), titles.page_is_about(none, none, none).alias("b"), titles.join_fragments(none).alias("c")).first()
    assert tuple(row) == (False, False, None)
