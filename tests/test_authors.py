"""Names and author lists: cases with their answers."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citelake.functions import names, text

NAMES = [
    ("P. Wawrzy'nski", "Pawel Wawrzynski", True),
    ("J. García", "José García", True),
    ("José García", "J. Garcia", True),
    ("F. Müller", "François Müller", True),
    ("François Müller", "F. Muller", True),
    ("Müller, K.", "K. Mueller", True),
    ("K. Mueller", "Müller, K.", True),
    ("Jörg Öztürk", "Oeztuerk J", True),
    ("Bauer, A.", "A. Baur", False),
    ("M. O'Connor", "Michael OConnor", True),
    ("S. D'Angelo", "Sofia DAngelo", True),
    ("M. Bowling.", "Michael Bowling", True),
    ("P. Smith", "John Doe", False),
    ("A. Garcia", "B. Martinez", False),
    ("M. Johnson", "Sarah Jackson", False),
    ("", "John Doe", False),
    ("John Doe", "", False),
    ("A", "A", True),
    ("P.", "Pawel", False),
    ("Jose M. Buades-Rubio", "Jose Maria Buades Rubio", True),
    ("Manuela González-González", "Manuela Gonz'alez-Gonz'alez", True),
    ("Sidney D'Mello", "S. D’Mello", True),
    ("Erran Li Li", "Li Erran Li", True),
    ("Li Fei-Fei", "F.-F. Li", True),
    ("F.-F. Li", "Li Fei-Fei", True),
    ("de Oliveira SD", "Danilo de Oliveira Silva", True),
    ("de Oliveira S", "Danilo de Oliveira Silva", True),
    ("Silva DO", "Danilo de Oliveira Silva", True),
    ("van der Berg JK", "Jan Klaas van der Berg", True),
    ("de Oliveira XY", "Danilo de Oliveira Silva", False),
    ("Smith AB", "Danilo de Oliveira Silva", False),
    ("Silva DO", "Danilo de Oliveira Souza", False),
    ("de Oliveira K", "Danilo de Oliveira Silva", False),
    ("Maria Santos", "Joao Pereira Costa", False),
]


def test_same_authors(spark):
    rows = spark.createDataFrame(NAMES, "a string, b string, same boolean")
    got = rows.select("a", "b", "same", text.same_author(F.col("a"), F.col("b")).alias("got")).collect()
    assert [(r["a"], r["b"]) for r in got if r["got"] != r["same"]] == []


LISTS = [
    (["D. Dittrich", "E. Kenneally"], ["Erin E. Kenneally", "D. Dittrich"], True, "order"),
    (["Yann LeCun", "Yoshua Bengio", "Geoffrey Hinton"], ["Geoffrey Hinton", "Yann LeCun", "Yoshua Bengio"], True, "order"),
    (["D. Dittrich", "E. Kenneally"], ["D. Dittrich", "Erin E. Kenneally"], True, ""),
    (["A. Smith", "E. Kenneally"], ["Erin E. Kenneally", "D. Dittrich"], False, "first"),
    (["J. Smith", "J. Smith"], ["John Smith", "Jane Doe"], False, "position 2"),
    (["D. Dittrich"], ["Erin E. Kenneally", "D. Dittrich"], False, "count"),
    (["Sidney D'Mello"], ["S. D’Mello"], True, ""),
    (["Manling Li", "Tony Lee", "Erran Li Li", "Ruohan Zhang", "et al"], ["Manling Li", "Tony Lee", "Li Erran Li", "Ruohan Zhang", "Weiyu Liu"], True, ""),
    (["Ann Ek", "Bo Quist", "et al."], ["Ann Ek", "Cy Diaz"], False, "not found: Bo Quist"),
    (["Ann Ek", "Bo Quist", "Cy Diaz"], ["Ann Ek", "Cy Diaz", "Bo Quist", "Di Moe"], True, "one omitted"),
    (["Ann Ek", "Bo Quist"], ["Ann Ek", "Cy Diaz", "Bo Quist"], False, "count"),
    (["Ann Ek", "Ann Ek", "Cy Diaz"], ["Ann Ek", "Cy Diaz", "Bo Quist", "Di Moe"], False, "count"),
    (["Ann Ek", "Bo Quist", "Cy Diaz"], ["Ann Ek"], True, "record is shorter"),
    (["Ann Ek", "Bo Quist"], ["Ann Ek", "et al"], True, ""),
    (["Cy Diaz", "Bo Quist"], ["Ann Ek et al."], False, "not found: Ann Ek"),
    (["Gemini Team"], ["Gemini Team", "Rohan Anil", "Sebastian Borgeaud"], True, "group"),
    (["Flevas DA", "Brenneis M", "TKAF Consortium"], ["Dimitrios A. Flevas", "Marco Brenneis", "Ann Ek", "Bo Quist"], True, "group"),
    (["Flevas DA", "Zed Xu", "TKAF Consortium"], ["Dimitrios A. Flevas", "Marco Brenneis", "Ann Ek", "Bo Quist"], False, "count"),
    (["Ann Ek"], ["Ann Ek", "Ann Ek", "klassbo@liv Maria", "Se ; L", ""], True, ""),
    (["Zed Xu"], ["Ann Ek"], False, "none"),
    (["et al."], ["Ann Ek"], True, ""),
    ([], ["Ann Ek"], True, ""),
    (["Ann Ek"], [], True, ""),
    ([None, "[1]Ann Ek"], ["Ann Ek", None], True, ""),
    (["A One", "B Two", "C Three", "D Four", "E Five", "F Six"], ["A One", "B Two", "C Three", "D Four", "E Five", "G Seven"], True, ""),
]


def test_author_verdicts(spark):
    rows = spark.createDataFrame(LISTS, "cited array<string>, found array<string>, match boolean, note string")
    got = rows.select("*", names.author_verdict(F.col("cited"), F.col("found")).alias("v")).collect()
    assert [(r["cited"], r["found"], tuple(r["v"])) for r in got if tuple(r["v"]) != (r["match"], r["note"])] == []


def test_distinct_pairing_is_the_greedy_one(spark):
    rng = random.Random(2)
    people = ["Ann Ek", "A. Ek", "Anna B. Ek", "Bo Ek", "B. Ek", "Cy Diaz", "C. Diaz"]
    rows = [(rng.choices(people, k=rng.randint(0, 4)), rng.choices(people, k=rng.randint(0, 5))) for _ in range(150)]
    pairs = [(a, b) for a in people for b in people]
    same = {(r["a"], r["b"]): r["s"] for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.same_author(F.col("b"), F.col("a")).alias("s")).collect()}

    def greedy(one, other):
        taken = set()
        for a in one:
            free = [k for k, b in enumerate(other) if k not in taken and same[a, b]]
            if not free:
                return False
            taken.add(free[0])
        return True

    df = spark.createDataFrame(rows, "one array<string>, other array<string>")
    paired = names.distinct_pairing(names.agreement(F.transform("one", text.name_parts), F.transform("other", text.name_parts)))
    got = df.select("one", "other", paired.alias("p")).collect()
    assert [r["p"] for r in got] == [greedy(r["one"], r["other"]) for r in got]
