"""Citation-graph operators over edges ``(citing, cited)``.

Pairs come from joins on a shared endpoint after edges are made distinct. A work cited by a
large part of the corpus makes a square of pairs. Pair counts can be asked for a set of
``sources``: the joins then grow with the sources' edges. Without one every work is a source;
a shared endpoint of many edges is dealt over blocks, so that no task has its whole square.

What moves is not pairs but, for each edge of a source, the list of the works at its other
end, ``BLOCK`` at most in a row: pairs come up where they are counted, and are not shuffled.
Where every work is coupled with every other one, each edge has its work's references instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.storage import materialize

BLOCK = 1000
#: References up to which a work's list moves with each of its edges.
WIDE = 64
_TASK_EDGES = 100_000


def _tasks(edges: DataFrame) -> int:
    """Partitions that grow with the edges, so that what one task counts doesn't."""
    return max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // _TASK_EDGES))


def _met(mine: DataFrame, e: DataFrame, key: str, other: str, also: list[str], both: bool, tasks: int) -> DataFrame:
    """``(source, other, *also, *own)`` for each ``key`` that a source shares with another work,
    all rows of a source in one partition. ``also``: columns of ``e``; ``own``: those of ``mine``
    beside source and key. Unless ``both``, a pair comes once, from its smaller work.

    Both the sources and the works of a key are in blocks of ``BLOCK``."""
    blocks = e.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    blocks = F.broadcast(blocks.where("_blocks > 1"))  # a row for every BLOCK edges at most

    def dealt(rows, work):
        n = F.coalesce("_blocks", F.lit(1))
        return rows.join(blocks, key, "left").withColumns({"_n": n, "_block": F.pmod(F.xxhash64(work), n).cast("int")}).drop("_blocks")

    sides = dealt(e, other).groupBy(key, "_n", F.col("_block").alias("_part")).agg(F.sort_array(F.collect_list(F.struct(other, *also))).alias("_w"))
    # a column each: structs take more room in an array
    lists = [F.col(f"_w.{c}").alias(f"_{c}") for c in (other, *also)]
    sides = sides.select(key, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_block"), *lists)
    met = dealt(mine, "source").drop("_n").join(sides, [key, "_block"]).drop(key, "_block")
    if not both:
        met = met.where(F.element_at(f"_{other}", -1) > F.col("source"))
    moved = met.repartition(tasks, "source")
    own = [c for c in mine.columns if c != key]
    pairs = moved.select(*own, F.inline(F.arrays_zip(*[F.col(f"_{c}").alias(c) for c in (other, *also)])))
    return pairs.where(F.col(other) > F.col("source") if not both else F.col(other) != F.col("source"))


def _mine(e: DataFrame, sources: DataFrame | None, own: str, *others: str) -> DataFrame:
    rows = e.select(F.col(own).alias("source"), *others)
    return rows if sources is None else rows.join(sources.select(F.col(own).alias("source")).distinct(), "source")


def _each_way(one: str, two: str, *columns: tuple[Column, Column, str], where: Column | None = None, back: Column | None = None) -> Column:
    """Both directions of a pair: columns as ``one`` and as ``two`` sees them. Without those
    that are not ``where`` asked, and without the second one unless ``back``."""
    there = F.struct(F.col(one).alias("source"), F.col(two).alias(two), *[x.alias(n) for x, _, n in columns])
    again = F.struct(F.col(two).alias("source"), F.col(one).alias(two), *[y.alias(n) for _, y, n in columns])
    both = F.array(there, again)
    if back is not None:
        both = F.when(back, both).otherwise(F.array(there))
    return F.inline(both if where is None else F.when(where, both))


def cocited(edges: DataFrame, sources: DataFrame | None, citing: str, cited: str, least: int = 2) -> DataFrame:
    """Works cited together with each source work by ``least`` or more citing works."""
    e = edges.select(citing, cited).distinct()
    pairs = _met(_mine(e, sources, cited, citing), e, citing, cited, [], sources is not None, _tasks(edges))
    counts = pairs.groupBy("source", cited).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    if sources is not None:
        return counts
    return counts.select(_each_way("source", cited, (F.col("shared"), F.col("shared"), "shared")))


def _with_degree(edges: DataFrame, citing: str, cited: str) -> DataFrame:
    e = edges.select(citing, cited).distinct()
    return e.join(e.groupBy(citing).agg(F.count("*").cast("int").alias("degree")), citing)


def _bibliographies(edges: DataFrame, citing: str, cited: str, tasks: int) -> DataFrame:
    """``(source, degree, refs)``: each work's references, once each, in one row, or, over
    ``WIDE`` of them, in rows of ``BLOCK`` at most."""
    own = Window.partitionBy("source")
    e = edges.select(F.col(citing).alias("source"), cited).where("source is not null").repartition(tasks, "source").distinct()
    e = e.withColumns({"degree": F.count("*").over(own).cast("int"), "_rn": F.row_number().over(own.orderBy(cited))})
    part = F.when(F.col("degree") > WIDE, F.floor(F.col("_rn") / BLOCK)).otherwise(0)
    return e.groupBy("source", "degree", part.alias("_part")).agg(F.sort_array(F.collect_list(cited)).alias("refs")).drop("_part")


def _shares(n: Column, da: Column, db: Column) -> tuple:
    """What ``_each_way`` gives of a pair: overlap, its share of either, Jaccard index."""
    ways = [F.round(100.0 * n / d, 2) for d in (da, db)]
    jaccard = F.round(n / (da + db - n), 6)
    return (n, n, "overlap"), (*ways, "pct"), (jaccard, jaccard, "jaccard")


def _coupled_narrow(lists: DataFrame, citing: str, cited: str, tasks: int) -> DataFrame:
    """Both ways of each pair of ``lists`` that shares a reference. An edge moves with the other
    references of its work to the cited one. There two works are compared, and the smallest
    reference that they share has the pair: neither pairs nor counts move. A much cited work
    has its edges in blocks of ``BLOCK``; each meets itself, and the others by a join."""
    at = Window.partitionBy(cited)
    edge = lists.select("source", "degree", "refs", F.explode("refs").alias(cited)).select(cited, "source", "degree", F.array_remove("refs", F.col(cited)).alias("others"))
    edge = edge.where(F.col(cited).isNotNull())  # as the join below has it, so that both read one exchange
    edge = edge.repartition(tasks, cited).withColumn("_block", F.floor((F.row_number().over(at.orderBy("source")) - 1) / BLOCK).cast("int"))

    def blocks(rows, *also):
        works = F.sort_array(F.collect_list(F.struct("source", "degree", "others"))).alias("_w")
        return rows.groupBy(cited, "_block", *also).agg(works).select(cited, "_block", *also, *[F.col(f"_w.{c}").alias(f"_{c}") for c in ("source", "degree", "others")])

    def compared(rows, mine, first):
        """Each work of the lists ``mine`` with those of the other lists from ``first`` on."""
        rest = F.arrays_zip(*[F.slice(f"_{c}", first, F.size(f"_{c}")).alias(n) for c, n in (("source", citing), ("degree", "db"), ("others", "_theirs"))])
        one = rows.select("*", F.posexplode(f"{mine}_source").alias("_i", "source"))
        pairs = one.select(cited, "source", F.get(f"{mine}_degree", "_i").alias("da"), F.get(f"{mine}_others", "_i").alias("_own"), F.inline(rest))
        # not filtered: Spark would intersect once more for that
        pairs = pairs.select(cited, "source", citing, "da", "db", F.array_intersect("_own", "_theirs").alias("_more"))
        here = F.coalesce(F.array_min("_more") > F.col(cited), F.lit(True))
        columns = _shares((F.size("_more") + 1).cast("long"), F.col("da"), F.col("db"))
        pairs = pairs.select("source", citing, here.alias("_here"), *[c.alias(f"_{n}_{k}") for *ways, n in columns for k, c in enumerate(ways)])
        return pairs.select(_each_way("source", citing, *[(F.col(f"_{n}_0"), F.col(f"_{n}_1"), n) for *_, n in columns], where=F.col("_here")))

    within = compared(blocks(edge), "", F.col("_i") + 2)
    n = F.ceil(F.count("*").over(at) / BLOCK).cast("int")
    hot = blocks(edge.withColumn("_n", n).where("_n > 1"), "_n")
    left = hot.where("_block < _n - 1").select(cited, F.col("_block").alias("_at"), F.explode(F.expr("sequence(_block + 1, _n - 1)")).alias("_block"), *[F.col(f"_{c}").alias(f"_m_{c}") for c in ("source", "degree", "others")])
    right = hot.where("_block > 0").select(cited, F.explode(F.expr("sequence(0, _block - 1)")).alias("_at"), "_block", "_source", "_degree", "_others")
    return within.union(compared(left.join(right, [cited, "_at", "_block"]), "_m", F.lit(1)))


def _coupled_wide(lists: DataFrame, citing: str, cited: str, tasks: int) -> DataFrame:
    """Both ways of each pair with a work of over ``WIDE`` references: pairs are counted where
    the works that cite a reference have moved to the wide one."""
    e = lists.select(F.col("source").alias(citing), F.explode("refs").alias(cited), "degree")
    mine = e.where(F.col("degree") > WIDE).select(F.col(citing).alias("source"), cited, F.col("degree").alias("da"))
    pairs = _met(mine, e, cited, citing, ["degree"], True, tasks)
    shared = pairs.groupBy("source", citing).agg(F.count("*").alias("n"), F.any_value("da").alias("da"), F.any_value("degree").alias("db"))
    return shared.select(_each_way("source", citing, *_shares(F.col("n"), F.col("da"), F.col("db")), back=F.col("db") <= WIDE))


def coupled(edges: DataFrame, sources: DataFrame | None, citing: str, cited: str) -> DataFrame:
    """Works that share references with each source work: overlap, its share of the source's
    references in percent, Jaccard index.

    Where every work is a source, bibliographies are written to the shared folder once, and
    what is moved grows with the squares of their lengths, up to ``WIDE``, not with the pairs."""
    tasks = _tasks(edges)
    if sources is None:
        lists = materialize(_bibliographies(edges, citing, cited, tasks), "bibliographies")
        wide = F.col("degree") > WIDE
        narrow = _coupled_narrow(lists.where(~wide), citing, cited, tasks)
        return narrow if lists.where(wide).isEmpty() else narrow.union(_coupled_wide(lists, citing, cited, tasks))
    e = _with_degree(edges, citing, cited)
    mine = _mine(e, sources, citing, cited, F.col("degree").alias("da"))
    pairs = _met(mine, e, cited, citing, ["degree"], True, tasks)
    shared = pairs.groupBy("source", citing).agg(F.count("*").alias("overlap"), F.any_value("da").alias("da"), F.any_value("degree").alias("db"))
    (n, _, _), (pct, _, _), (jaccard, _, _) = _shares(F.col("overlap"), F.col("da"), F.col("db"))
    return shared.select("source", citing, n, pct.alias("pct"), jaccard.alias("jaccard"))


def gaps(edges: DataFrame, bibliography: DataFrame, citing: str, cited: str, least: int = 2, top: int = 10) -> DataFrame:
    """Works that the bibliography's works cite ``least`` times or more and that it lacks:
    the ``top`` by count, then id."""
    own = bibliography.select(F.col(cited)).distinct()
    theirs = edges.join(own.select(F.col(cited).alias(citing)), citing, "left_semi").select(citing, cited).distinct()
    counts = theirs.join(own, cited, "left_anti").groupBy(cited).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), cited).limit(top)


def internal_edges(edges: DataFrame, works: DataFrame, citing: str, cited: str, work: str) -> DataFrame:
    """Distinct edges between two of the works, no loops."""
    own = works.select(work).distinct()
    inside = edges.join(own.withColumnRenamed(work, citing), citing, "left_semi")
    inside = inside.join(own.withColumnRenamed(work, cited), cited, "left_semi")
    return inside.where(F.col(citing) != F.col(cited)).select(citing, cited).distinct()


def attribute_edges(rows: DataFrame, own: str, attribute: Column, weight: float, members: int = 40) -> DataFrame:
    """Pairs that share an attribute, among its first ``members`` rows by id: the cap is the
    graph's drawing rule, a feature. The window keeps the square at ``members`` a key."""
    w = Window.partitionBy("_key").orderBy(own)
    keyed = rows.select(F.col(own), attribute.alias("_key")).where("_key is not null and _key <> ''").distinct()
    first = keyed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= members)
    a, b = first.select("_key", F.col(own).alias("a")), first.select("_key", F.col(own).alias("b"))
    pairs = a.join(b, "_key").where("a < b")
    return pairs.groupBy("a", "b").agg((F.count("*") * F.lit(weight)).alias("weight"))


def cull_edges(edges: DataFrame, most: int) -> DataFrame:
    return edges.orderBy(F.desc("weight"), "a", "b").limit(most)


def reranked(edges: DataFrame, limit: int, citing: str, cited: str) -> DataFrame:
    """``(citing, shared, overlap, pct)``: of the max(3 * limit, 15) works that share most
    references with all others, the ``limit`` first by ``pct``, the largest share of another
    work's references in percent, then by overlap, shared and id.

    What a work shares with all others is the sum, over its references, of the others that
    cite them: the pool is known without a pair, and only its works meet theirs."""
    e = _with_degree(edges, citing, cited)
    others = e.groupBy(cited).agg((F.count("*") - 1).alias("others"))
    pool = e.join(others, cited).groupBy(citing).agg(F.sum("others").alias("shared")).where("shared > 0")
    pool = pool.orderBy(F.desc("shared"), citing).limit(max(3 * limit, 15))
    mine = e.join(F.broadcast(pool), citing).select(F.col(citing).alias("source"), cited, "shared")
    theirs = e.select(F.col(citing).alias("other"), cited, "degree")
    met = theirs.join(F.broadcast(mine), cited).where("source <> other")
    pairs = met.groupBy("source", "other").agg(F.count("*").alias("n"), F.any_value("shared").alias("shared"), F.any_value("degree").alias("degree"))
    pct = F.max(F.round(100.0 * F.col("n") / F.col("degree"), 2))
    best = pairs.groupBy(F.col("source").alias(citing)).agg(F.any_value("shared").alias("shared"), F.max("n").alias("overlap"), pct.alias("pct"))
    return best.orderBy(F.desc("pct"), F.desc("overlap"), F.desc("shared"), citing).limit(limit)
