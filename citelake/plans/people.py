"""Authors' names and lists: words of ``part`` names play people."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import names, text
from citelake.plans.tables import spread, table
from citelake.registry import register

_AB = "SELECT p_partkey, upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) AS a, upper(left(split_part(p_name, ' ', 2), 1)) || substr(split_part(p_name, ' ', 2), 2) AS b FROM part"


def _pair(spark, sf_dir):
    """Parts with two capitalised words of their names."""

    def word(k):
        w = F.split_part("p_name", F.lit(" "), F.lit(k))
        return F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))

    return spread(table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", word(1).alias("a"), word(2).alias("b"))


def _of(key, *choices):
    return F.get(F.array(*choices), (key % len(choices)).cast("int"))


def _text(pattern):
    """A pattern with {a} and {b} for the two words."""
    out = [F.lit("")]
    for piece in pattern.replace("{", "\0").replace("}", "\0").split("\0"):
        out.append(F.col(piece) if piece in ("a", "b") else F.lit(piece))
    return F.concat(*out)


def _sql(pattern):
    return "'" + pattern.replace("{a}", "' || a || '").replace("{b}", "' || b || '") + "'"


_LISTS = {
    "{a}, A. and {b}, B. C.": "{a}, A.|{b}, B. C.",
    "{a} A; {b} B": "{a} A|{b} B",
    "{a}, A., {b}, B. C.": "{a}, A.|{b}, B. C.",
    "Ann {a}, Bo {b} and Cy Diaz": "Ann {a}|Bo {b}|Cy Diaz",
    "{a} A, {b} BC, et al.": "{a} A|{b} BC|et al",
    "Ann {a} and Bo {b} and others": "Ann {a}|Bo {b}|et al",
    "Ann {a} & Bo {b}": "Ann {a}|Bo {b}",
    "et al.": "",
}


@register(f"WITH w AS ({_AB}) SELECT p_partkey, [{', '.join(_sql(v) for v in _LISTS.values())}][p_partkey % {len(_LISTS)} + 1] AS people FROM w")
def parsed_author_lists(spark, sf_dir):
    written = _of(F.col("p_partkey"), *map(_text, _LISTS))
    return _pair(spark, sf_dir).select("p_partkey", F.array_join(names.parse_authors(written), "|").alias("people"))


_CLEAN = {
    "Prof. {a} {b}1,2*": "{a} {b},",
    "A . {b} (MIT)": "A. {b}",
    "{a}~{b} [3] x@y.org": "{a} {b}",
    "{a} {b}.": "{a} {b}",
    "{a} {b} Jr.": "{a} {b} Jr.",
    "Mrinmaya {b} R.": "Mrinmaya {b} R.",
}


@register(f"WITH w AS ({_AB}) SELECT p_partkey, [{', '.join(_sql(v) for v in _CLEAN.values())}][p_partkey % {len(_CLEAN)} + 1] AS name FROM w")
def cleaned_author_names(spark, sf_dir):
    dirty = _of(F.col("p_partkey"), *map(_text, _CLEAN))
    return _pair(spark, sf_dir).select("p_partkey", names.clean_author(dirty).alias("name"))


#: Two ways to write a name, and whether they may be one person.
_SAME = [
    ("Ann {a}", "{a}, A.", True),
    ("Ann Bea {a}", "{a} AB", True),
    ("Ann {a}", "{a} Ann", True),
    ("Jean-Paul {a}", "J.-P. {a}", True),
    ("Ann van {a}", "A. {a}", True),
    ("Ann {a} Jr.", "{a}, A", True),
    ("Ann {a}", "Bo {a}", False),
    ("Ann {a}", "Ann Q{b}x", False),
    ("A. B. {a}", "A. C. {a}", False),
    ("{a}", "Cy {a}", True),
    ("Müller{a}, K.", "K. Mueller{a}", True),
    ("Li{a} Fei-Fei", "F.-F. Li{a}", True),
    ("Silva{a} DO", "Danilo de Oliveira Silva{a}", True),
    ("de Oliveira{a} XY", "Danilo de Oliveira{a} Silva", False),
]


@register(f"SELECT p_partkey, [{', '.join(str(s).lower() for *_, s in _SAME)}][p_partkey % {len(_SAME)} + 1] AS same FROM part")
def same_person_names(spark, sf_dir):
    key = F.col("p_partkey")
    same = text.same_author(_of(key, *[_text(x) for x, *_ in _SAME]), _of(key, *[_text(y) for _, y, _ in _SAME]))
    return _pair(spark, sf_dir).select("p_partkey", same.alias("same"))


@register(
    """
    WITH l AS (SELECT l_orderkey, l_returnflag, l_suppkey, l_linenumber, l_partkey, p_name AS name, left(p_name, 1) || split_part(p_name, ' ', 2) AS k
               FROM lineitem JOIN part ON l_partkey = p_partkey),
    f AS (SELECT l_orderkey, list(k ORDER BY pos, name) AS fk FROM (SELECT l_orderkey, name, any_value(k) AS k, min(l_linenumber) AS pos FROM l GROUP BY l_orderkey, name) GROUP BY 1),
    c AS (SELECT l_orderkey, list(k ORDER BY l_suppkey, l_linenumber, name) AS ck FROM l WHERE l_returnflag <> 'R' GROUP BY 1),
    b AS (SELECT l_orderkey, fk, ck, len(ck) AS n, len(fk) AS m, len(list_filter(ck, lambda x: list_contains(fk, x))) AS met,
                 len(list_filter(fk, lambda x: NOT list_contains(ck, x))) AS uncited,
                 len(list_filter(list_distinct(ck), lambda x: len(list_filter(ck, lambda y: y = x)) > len(list_filter(fk, lambda y: y = x)))) = 0 AS paired,
                 list_filter(range(1, least(len(ck), len(fk)) + 1), lambda i: ck[i] <> fk[i]) AS off
          FROM f JOIN c USING (l_orderkey)),
    v AS (SELECT l_orderkey, CASE WHEN met = 0 THEN 'none' WHEN m - n = 1 AND n >= 3 AND paired THEN 'one omitted' WHEN n > m AND uncited = 0 THEN 'record is shorter'
                 WHEN n <> m THEN 'count' WHEN ck[1] <> fk[1] THEN CASE WHEN paired THEN 'order' ELSE 'first' END
                 WHEN n <= 5 AND len(off) > 0 THEN 'position ' || off[1] ELSE '' END AS note FROM b)
    SELECT l_orderkey, note NOT IN ('none', 'count', 'first') AND NOT starts_with(note, 'position') AS match, note FROM v"""
)
def compared_author_lists(spark, sf_dir):
    """Orders as works: the parts of all lines are the record's authors, ``red bolt``; those of
    the lines that were not returned are cited, by supplier, as ``R. Bolt``."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    lines = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_returnflag", "l_suppkey", "l_linenumber", "l_partkey").join(parts, "l_partkey")
    person = F.initcap("name")
    short = F.concat(F.left(person, F.lit(1)), F.lit(". "), F.split_part(person, F.lit(" "), F.lit(2)))
    lists = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", person.alias("name")))).alias("record"),
        F.sort_array(F.collect_list(F.when(F.col("l_returnflag") != "R", F.struct("l_suppkey", "l_linenumber", "name", short.alias("short"))))).alias("cited"),
    )
    verdict = names.author_verdict(F.col("cited.short"), F.col("record.name"))
    return lists.where(F.size("cited") > 0).select("l_orderkey", F.explode(F.array(verdict)).alias("v")).select("l_orderkey", "v.match", "v.note")


@register("SELECT p_partkey, CAST([0.5, NULL, 1.0, 0.0][p_partkey % 4 + 1] AS DOUBLE) AS overlap FROM part")
def author_overlaps(spark, sf_dir):
    """One of two beside two: undefined for two cited ones; half of four; all; none."""
    cited = [["Ann {a}", "Bo {a}", "Zed Quist", "Yan Pol"], ["Ann {a}", "Zed Quist"], ["Ann {a}", "Bo {a}"], ["Zed Quist", "Yan Pol", "Xi Ro"]]
    found = F.array(_text("{a}, A."), _text("Bo {a}"))
    share = text.author_overlap(_of(F.col("p_partkey"), *[F.array(*map(_text, c)) for c in cited]), found)
    return _pair(spark, sf_dir).select("p_partkey", share.cast("double").alias("overlap"))


@register(
    f"""
    WITH w AS ({_AB}) SELECT p_partkey, 'B. ' || a AS shown, 'Author mismatch:' || chr(10) || '       cited:  ' || a || chr(10) || '       actual: ' || b AS note FROM w"""
)
def displayed_names(spark, sf_dir):
    return _pair(spark, sf_dir).select(
        "p_partkey", names.display_name(_text("{a}, B.")).alias("shown"), names.mismatch_text("Author", F.col("a"), F.col("b")).alias("note")
    )


@register(
    f"""
    WITH w AS ({_AB}), s AS (SELECT p_partkey, unnest([{{'n': 0, 'k': 'eq', 'w': a}}, {{'n': 1, 'k': 'add', 'w': 'zz'}}, {{'n': 2, 'k': 'del', 'w': 'xx yy'}}, {{'n': 3, 'k': 'eq', 'w': b || ' end'}}]) AS r FROM w)
    SELECT p_partkey, CAST(r.n AS INT) AS n, r.k AS kind, r.w AS words FROM s"""
)
def word_differences(spark, sf_dir):
    rows = _pair(spark, sf_dir).select("p_partkey", _text("{a} xx yy {b} end").alias("x"), _text("{a}  zz {b} end").alias("y"))
    return names.word_diff(rows, "p_partkey", "x", "y")


#: Two ways to write a venue, and whether they are two venues.
_VENUES = [
    ("Proc. Int. Conf. on {a} Sci.", "Proceedings of the 12th International Conference on {a} Science", False),
    ("J. {a} Lett.", "Journal of {a} Letters", False),
    ("arXiv preprint arXiv:2101.00001", "{a} Letters", False),
    ("{a} Letters 2020", "{a} Letters", False),
    ("", "{a} Letters", False),
    ("{a} Letters", "{b}x Transactions", True),
    ("Annals of {a}", "Annals of Q{b}x", True),
    ("JMLR", "Journal of Machine Learning Research", False),
]


@register(f"SELECT p_partkey, [{', '.join(str(d).lower() for *_, d in _VENUES)}][p_partkey % {len(_VENUES)} + 1] AS differ FROM part")
def venue_pairs(spark, sf_dir):
    key = F.col("p_partkey")
    differ = names.venues_differ(_of(key, *[_text(v) for v, *_ in _VENUES]), _of(key, *[_text(w) for _, w, _ in _VENUES]))
    return _pair(spark, sf_dir).select("p_partkey", differ.alias("differ"))
