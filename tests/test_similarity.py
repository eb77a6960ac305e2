"""Similar titles and repeated references against all pairs and a sequential pass."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from citelake.functions.text import comparable_title, title_similarity
from citelake.operators import similarity

SYLLABLES = ["an", "be", "cor", "du", "el", "fi", "go", "hu", "in", "ka", "lo", "me", "nu", "or", "pa", "qui"]


def made_titles(n: int, seed: int, words: int = 120) -> list[str]:
    """Titles over a Zipf vocabulary, with near copies, parts of titles, editions and joins."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    out = []
    for k in range(n):
        t = rng.choices(vocabulary, weights, k=rng.randint(1, 9))
        if k > 20 and rng.random() < 0.4:
            t = out[rng.randrange(len(out))].split(" ")
            kind = rng.randrange(6)
            if kind == 0:
                t = t[: max(1, len(t) - 1)]
            elif kind == 1:
                t = [*t, "second", "edition"]
            elif kind == 2:
                t = ["".join(t[:2]), *t[2:]]
            elif kind == 3:
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            elif kind == 4:
                t = ["the", *t[1:], "of"]
            else:
                t[0] = t[0][1:] or "x"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("least", [0.45, 0.5, 0.7, 0.8, 0.86, 0.95, 1.0])
def test_similar_titles_are_those_of_all_pairs(spark, least):
    titles = sorted({t for t in made_titles(220, 3) if len(t) > 2})
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select(comparable_title(F.col("t")).alias("t")).distinct().cache()
    every = rows.select(F.col("t").alias("a")).join(rows.select(F.col("t").alias("b")), F.col("a") < F.col("b"))
    want = every.withColumn("score", title_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    got = similarity.similar_titles(rows, "t", least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() > 3


def test_known_words_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in {t for t in made_titles(150, 5) if len(t) > 2}], "t string").cache()
    first = sorted(map(tuple, similarity.similar_titles(rows, "t", 0.6).collect()))
    monkeypatch.setattr(similarity, "_KNOWN", 3)
    assert sorted(map(tuple, similarity.similar_titles(rows, "t", 0.6).collect())) == first


def test_candidates_grow_with_the_titles(spark):
    """Titles of a corpus: a Zipf vocabulary that grows with them, one in five a near copy of
    another. Four times the titles meet in about four times the pairs."""

    def met(n):
        rng = random.Random(n)
        words = ["".join(rng.choices(SYLLABLES, k=4)) + str(k) for k in range(4 * n)]
        weights = [1 / (k + 1) for k in range(4 * n)]
        titles = [rng.choices(words, weights, k=rng.randint(5, 10)) for _ in range(n)]
        copies = [[*t[:-1], rng.choice(words)] for t in titles[: n // 5]]
        rows = spark.createDataFrame([(" ".join(t),) for t in titles + copies], "t string").distinct()
        return similarity.word_candidates(rows, "t", 0.714).count()

    few, many = met(800), met(3200)
    assert few >= 100 and many < 6 * few


def test_best_similar_of_equal_and_empty_titles(spark):
    rows = [(1, "Deep Learning"), (2, "deep learning!"), (3, "Deep  learning 2015"), (4, None), (5, ""), (6, "Deep learning, second edition"), (7, "Nothing alike"), (8, "ab"), (9, "AB")]
    got = similarity.best_similar(spark.createDataFrame(rows, "id long, title string"), "id", "title")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0), (6, 1, 1.0), (8, 9, 1.0), (9, 8, 1.0)]


def test_similarity_asks_for_a_bound(spark):
    with pytest.raises(ValueError, match="least"):
        similarity.similar_titles(spark.createDataFrame([("a",)], "t string"), "t", 0.3)


def test_discrepancies_compare_with_the_earliest(spark):
    rows = [(5, "A title", 2001, "x"), (2, "a  Title.", 2000, "x"), (9, "A title", None, "y"), (7, "Other", 1, "z"), (8, None, 1, "z")]
    got = similarity.discrepancies(spark.createDataFrame(rows, "id long, title string, year int, venue string"), "id", "title", ["year", "venue"])
    assert sorted(map(tuple, got.collect())) == [(5, 2, ["year"]), (9, 2, ["venue"])]


def test_contained_pairs_within_a_key(spark):
    rows = [(1, "x", "a study of stars"), (2, "x", "on a study of stars again"), (3, "y", "a study of stars and more"), (4, "x", "tars ag"), (5, "x", None), (6, "x", "of")]
    df = spark.createDataFrame(rows, "id long, who string, t string")
    got = similarity.contained_pairs(df, "id", "t", ("who",))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (4, 2)]


def says_the_same(x, y):
    """The rule by itself, on plain values."""
    import re

    (t, a, v), (u, b, w) = x, y
    if not t or not u:
        return False
    if t == u:
        return True
    number = r"arxiv\s*preprint\s*arxiv:[0-9]{4}\.[0-9]{4,5}"
    if bool(re.search(number, t)) != bool(re.search(number, u)):
        one, two = (re.findall(r"arxiv:[0-9]{4}\.[0-9]{4,5}", s) for s in (v, w))
        if one and two and one[0] == two[0]:
            return True
        p, q = ({n.strip() for n in s.split(";")} - {"", "et al"} for s in (a, b))
        if p and q and len(p & q) / min(len(p), len(q)) >= 0.5:
            return True
    return bool(a) and a == b and min(len(t), len(u)) > 2 and (t in u or u in t)


@pytest.mark.parametrize("seed", range(3))
def test_repeated_references_are_those_of_reading_in_order(spark, seed):
    from citelake.operators import duplicates

    rng = random.Random(seed)
    base = ["deep nets", "on deep nets", "deep nets, again: a study", "graphs", "on graphs", "on graphs and deep nets", "ArXiv preprint arXiv:2101.00001", "arxiv preprint arxiv:2202.12345", "étude", "une étude", "", None]
    people = ["Ann Ek; Bo Quist", "ann ek; bo quist", "Ann Ek; Cy Diaz; Di Moe", "Cy Diaz; et al", "", None]
    venues = ["arXiv:2101.00001", "CoRR arXiv:2202.12345", "NeurIPS", None]
    rows = [(k, rng.randrange(4), rng.choice(base), rng.choice(people), rng.choice(venues)) for k in range(160)]
    want = {}
    for which in range(4):
        stay = []
        for k, _, *values in (r for r in rows if r[1] == which):
            own = tuple((v or "").strip().lower() for v in values)
            said = [i for i, other in stay if says_the_same(own, other)]
            if said:
                want[k] = said[0]
            else:
                stay.append((k, own))
    df = spark.createDataFrame(rows, "ref long, list int, title string, authors string, venue string").repartition(3)
    assert {r["ref"]: r["kept"] for r in duplicates.repeated(df, "ref", "list").collect()} == want


def test_a_reference_that_goes_takes_no_other_with_it(spark):
    from citelake.operators import duplicates

    rows = [(1, "deep nets and graphs", "a", ""), (2, "deep nets", "a", ""), (3, "deep nets", "b", ""), (4, "nets", "b", "")]
    df = spark.createDataFrame(rows, "ref long, title string, authors string, venue string")
    assert sorted(map(tuple, duplicates.repeated(df, "ref").collect())) == [(2, 1), (4, 3)]
    assert duplicates.repeated(df.limit(0), "ref").count() == 0


def read_in_order(rows):
    """Reading each list in its order, each reference against those that stay."""
    gone, stay = {}, {}
    for k, which, *values in sorted(rows, key=lambda r: r[0]):
        own = tuple((v or "").strip().lower() for v in values)
        said = [i for i, other in stay.get(which, []) if says_the_same(own, other)]
        if which is not None and said:
            gone[k] = said[0]
        else:
            stay.setdefault(which, []).append((k, own))
    return gone


def mixed_lists(seed):
    rng = random.Random(seed)
    base = ["deep nets", "on deep nets", "c++", "learning c++ fast", "???", "what???", "it", "it is", "a  b c", "x a  b c y", "arXiv preprint arXiv:2101.00001", "étude", "une étude", "", None]
    people = ["Ann Ek; Bo Quist", "Ann Ek; Cy Diaz; Di Moe", "Cy Diaz", "", None]
    sizes = {0: 1, 1: 2, 2: 4, 3: 5, 4: 9, 5: 40, None: 6}
    lists = [which for which, n in sizes.items() for _ in range(n)]
    rng.shuffle(lists)
    return [(k, which, rng.choice(base), rng.choice(people), rng.choice(["arXiv:2101.00001", "NeurIPS", None])) for k, which in enumerate(lists)]


@pytest.mark.parametrize("at_once", [4, 256])
def test_lists_of_any_size_give_what_reading_in_order_gives(spark, at_once):
    from citelake.operators import duplicates

    rows = mixed_lists(7)
    want = read_in_order(rows)
    df = spark.createDataFrame(rows, "ref long, list int, title string, authors string, venue string").repartition(3)
    assert {r["ref"]: r["kept"] for r in duplicates.repeated(df, "ref", "list", at_once=at_once).collect()} == want and len(want) > 20
    added = {}
    for r in duplicates.repeated_by_list(df, "ref", "list", at_once=at_once).collect():
        n, gone = added.get(r["list"], (0, []))
        added[r["list"]] = (n + r["n"], gone + [g["own"] for g in r["gone"]])
    which = {r[0]: r[1] for r in rows}
    sizes = {k: sum(r[1] == k for r in rows) for k in range(6)}
    assert {k: (n, sorted(gone)) for k, (n, gone) in added.items()} == {k: (sizes[k], sorted(g for g in want if which[g] == k)) for k in sizes}


def test_lists_move_once(spark, tmp_path, monkeypatch):
    """Words of titles met by a join before, texts moved many times over and were written again."""
    from citelake.operators import duplicates

    rows = spark.range(4000).selectExpr("id as ref", "id div 4 as list", "concat('a study of things ', id % 50) as title", "'ann' as authors", "'' as venue")
    rows.write.parquet(str(tmp_path / "refs"))
    written, write = [], duplicates.materialize
    monkeypatch.setattr(duplicates, "materialize", lambda df, name: written.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    found = duplicates.repeated(spark.read.parquet(str(tmp_path / "refs")), "ref", "list")
    assert len(written) == 1 and written[0].count("Exchange") == 1 and "Join" not in written[0]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0


def test_orders_of_over_a_thousand_lines(spark, tmp_path):
    """Lines are told apart whatever their number; the order's list is settled in rounds."""
    import __spark_entry__ as lake

    spark.range(3).selectExpr("id as p_partkey", "element_at(array('red bolt', 'old ring', 'hot nut'), int(id) + 1) as p_name", "'SMALL' as p_type").write.parquet(str(tmp_path / "part.parquet"))
    lines = spark.range(1203).selectExpr("if(id < 1201, 5L, 6L) as l_orderkey", "int(id % 6) as l_linenumber", "id % 3 as l_partkey", "id % 5 as l_suppkey")
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    names = ["red bolt", "old ring", "hot nut"]
    want = {}
    for order, ids in ((5, range(1201)), (6, range(1201, 1203))):
        stay, gone = [], []
        for i, (line, part, supplier) in enumerate(sorted((k % 6, k % 3, k % 5) for k in ids), 1):
            t, who = (f"on the {names[part]} of small" if line % 3 == 2 else names[part]), supplier % 3
            if any(t == u or (who == other and (t in u or u in t)) for u, other in stay):
                gone.append(i)
            else:
                stay.append((t, who))
        want[order] = (i, len(gone), sum(gone) if gone else None)
    found = lake.queries()["repeated_references"](spark, str(tmp_path)).collect()
    assert {r["l_orderkey"]: (r["n_references"], r["n_repeated"], r["places"]) for r in found} == want


def test_signs_count_in_a_title(spark):
    """Three characters are enough, whatever they are; two are not, also where letters agree."""
    from citelake.operators import duplicates

    rows = [(1, 1, "learning c++ fast", "a", ""), (2, 1, "c++", "a", ""), (3, 2, "c++", "a", ""), (4, 2, "c", "a", ""), (5, 2, "c+", "a", "")]
    df = spark.createDataFrame(rows, "ref long, list int, title string, authors string, venue string")
    for at_once in (1, 256):
        assert sorted(map(tuple, duplicates.repeated(df, "ref", "list", 1000, at_once).collect())) == [(2, 1)]
    assert sorted(map(tuple, duplicates.repeated(df.where("list = 2"), "ref").collect())) == []
    assert sorted(map(tuple, duplicates.repeated(df.where("list = 1"), "ref").collect())) == [(2, 1)]
