"""Mixing sources to target weights by pivotal dependent rounding.

A source's target gives each of its documents the same expected number of copies. The whole
part is taken at once; the fractions are rounded in pairs: words move at random from one
document of a pair to the other, by chances that keep every document's expectation, until
one of the two is taken a whole number of times. Words are what moves, so a pair's total
stays, and the other document goes on to meet the next, in order of falling size, so that
what is left in the end is small.

A node of the tree does that to at most about ``_FAN`` documents in one task and hands one
open document up. The leaves are hash buckets of a source; their open documents meet in the
source's nodes, and the sources' last ones in nodes over all sources, so that the total stays
too. One draw rounds the last of all. A source's words then differ from its target by less
than the size of one of its documents.

Texts are read once, for their number of words. Draws come from the content of a node, so
reruns agree however the rows are dealt.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citelake.llm.common import discard, materialize

_FAN = 4096
_CHUNK = 256
_WEIGHTS = (5, 2, 1)
_LEAST = 1e-9


def word_count(text):
    """Maximal runs without ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weighted(sources: DataFrame, weights=_WEIGHTS) -> DataFrame:
    """``sources`` with ``weight``: the weights in turn by code points of ``source``, null
    last. Ranks come from range partitions and their sizes, not from one task."""
    order = F.col("source").asc_nulls_last()
    ranged = materialize(sources.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    first, offsets = 0, []
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():
        offsets += [F.lit(r["_range"]), F.lit(first)]
        first += r["count"]
    before = F.create_map(*offsets)[F.col("_range")] if offsets else F.lit(0)
    rank = before + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    turn = F.array(*map(F.lit, weights))
    return ranged.withColumn("weight", F.get(turn, (rank % len(weights)).cast("int"))).drop("_range")


def with_targets(sources: DataFrame, percent: int = 150, most: int = 2) -> DataFrame:
    """``sources`` (``source_size``, ``weight``) with ``target``: ``percent`` of all sizes by
    weight, none above ``most`` times its source's size, the excess shared by the others.

    A level is a weight's share; the sources that it would lift over their limit are set to
    it, which raises the level for the others, until no more are. Each step is one
    aggregation, and exact: shares are compared as whole numbers.
    """
    cap = (F.col("source_size") * most).cast("decimal(38,0)")
    size, rest = (int(x or 0) for x in sources.agg(F.sum("source_size"), F.sum("weight")).first())
    full = 0
    while True:
        left = percent * size - 100 * full  # hundredths
        above = F.col("weight").cast("decimal(38,0)") * F.lit(left).cast("decimal(38,0)") > cap * (100 * rest)
        row = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        now = int(row[0] or 0), int(row[1] or 0)
        if now == (full, rest) or not now[1]:
            break
        full, rest = now
    share = F.col("weight") * F.lit(left / 100.0) / F.lit(float(max(rest, 1)))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share))


def settle(sizes: np.ndarray, parts: np.ndarray, draws: np.ndarray) -> int | None:
    """Round ``parts`` in place, in order; the place of the one that stays open, if any."""
    held = None
    for k in range(len(sizes)):
        if not 0 < parts[k] < 1:
            continue
        if held is None:
            held = k
            continue
        a, b, x, y = sizes[held], sizes[k], parts[held], parts[k]
        up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))
        if draws[k] * (up + down) < down:
            x, y = (1.0, y - up / b) if up == a * (1 - x) else (x + up / a, 0.0)
        else:
            x, y = (0.0, y + down / b) if down == a * x else (x - down / a, 1.0)
        parts[held], parts[k] = (v if _LEAST < v < 1 - _LEAST else round(v) for v in (x, y))
        held = held if 0 < parts[held] < 1 else k if 0 < parts[k] < 1 else None
    return held


def _node(level: int, last: bool, names: list[str]):
    """Rows of one node, each for ``n`` equal documents, with their copies so far and the
    fraction still to be rounded; afterwards one row a document, fractions null but one."""

    def run(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        at = np.repeat(np.arange(len(n)), n)
        size, part, mark = (table.column(c).to_numpy()[at] for c in ("size", "part", "mark"))
        order = np.lexsort((mark, -size))
        at, size, part = at[order], size[order].astype(float), part[order].copy()
        seed = [level, len(size), int(mark.view(np.uint64).sum(dtype=np.uint64)), int(size.sum())]
        draws = np.random.Generator(np.random.Philox(np.random.SeedSequence(seed))).random(len(size) + 1)
        part[size == 0] = 0
        held = settle(size, part, draws)
        if last and held is not None:
            part[held] = float(draws[-1] < part[held])
            held = None
        open_ = np.zeros(len(size), bool)
        if held is not None:
            open_[held] = True
        out = table.take(pa.array(at)).select(names)
        copies = out.column("copies").to_numpy() + np.where(open_, 0, part).astype(np.int64)
        new = {"n": np.ones(len(size), np.int64), "copies": copies, "part": pa.array(part, mask=~open_)}
        return pa.table([new[c] if c in new else out.column(c) for c in names], names=names)

    return run


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=_WEIGHTS,
    percent: int = 150,
    most: int = 2,
    fan: int = _FAN,
) -> DataFrame:
    """``(id, size, source_size, target, taken)``, one row per row of ``docs``: ``taken`` is
    the size times the copies that the mix takes of the document.

    Null texts have no words; null sources are one source, last in order; ids may be null or
    repeat. Equal rows are rounded each. Documents without words are taken no time. Other
    columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    # equal rows as one row with their number, in runs: however many there are, they are dealt out
    same = materialize(rows.groupBy("id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    sources = same.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sources = materialize(with_targets(weighted(sources, weights), percent, most), "sources")
    most_docs, n_sources = sources.agg(F.coalesce(F.max("docs"), F.lit(0)), F.count("*")).first()

    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    runs = F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_CHUNK}"))
    joined = same.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    joined = joined.select("id", "d.source", "size", "n", "source_size", "target", "docs", share.alias("share"), F.explode(runs).alias("run"))
    whole = F.when(F.col("size") > 0, F.floor("share")).otherwise(0).cast("long")
    open_ = joined.select(
        "id", "source", "size", "source_size", "target", "docs",
        F.least(F.lit(_CHUNK), F.col("n") - F.col("run") * _CHUNK).cast("long").alias("n"),
        F.xxhash64("id", "source", "size", "run").alias("mark"),
        whole.alias("copies"),
        (F.col("share") - F.floor("share")).alias("part"),
    )
    schema, names = open_.schema, open_.columns

    levels, nodes = [], F.ceil(F.col("docs") / fan)
    most_nodes = -(-most_docs // fan)
    while True:  # a level: the nodes of each source, until each has one
        bucket = F.pmod(F.xxhash64("mark", F.lit(len(levels))), nodes)
        levels.append(([F.col("source"), bucket], False))
        if most_nodes <= 1:
            break
        nodes, most_nodes = F.ceil(nodes / fan), -(-most_nodes // fan)
    most_nodes = -(-max(n_sources, 1) // fan)
    while True:  # then nodes over all sources, until there is one
        levels.append(([F.pmod(F.xxhash64("mark", F.lit(len(levels))), F.lit(most_nodes))], most_nodes == 1))
        if most_nodes == 1:
            break
        most_nodes = -(-most_nodes // fan)
    settled = []
    for k, (keys, last) in enumerate(levels):
        keyed = open_.withColumns({f"_key{i}": c for i, c in enumerate(keys)})
        done = keyed.groupBy(*[f"_key{i}" for i in range(len(keys))]).applyInArrow(_node(k, last, names), schema)
        done = materialize(done, "level")
        settled.append(done.where("part is null"))
        open_ = done.where("part is not null")
    discard(same, sources)
    out = functools.reduce(DataFrame.union, settled)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
