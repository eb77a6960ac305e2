"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.storage import discard, materialize

__all__ = ["connected_components", "discard", "join_back", "kept", "let", "materialize", "prefix_sums", "tidy", "with_roots"]


_LOADED: dict[str, tuple[bytes, object]] = {}


def kept(name: tuple[str, bytes], make):
    """One per worker process, kind and content, kept across tasks; a new content of a kind
    takes the place of the last one."""
    kind, content = name
    mark = hashlib.sha256(content).digest()
    if kind not in _LOADED or _LOADED[kind][0] != mark:
        _LOADED[kind] = mark, make()
    return _LOADED[kind][1]


def tidy(run):
    """``run``, a function of a ``mapInArrow``, that gives free memory back at its end: workers
    live on, and what an allocator keeps for a stage that is over counts against the next."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda over a one-element array binds the value, where a plain column expression
    would be inlined at each use.
    """
    return F.transform(F.array(value), body)[0]


def prefix_sums(lens: Column) -> Column:
    """Sums of all elements before each one, by blocks of 128."""

    def total(x):
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def sums(x):
        blocks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(128)), lambda b: total(F.slice(x, b + 1, 128)))
        return let(
            blocks,
            lambda bs: F.transform(
                x,
                lambda _, i: total(F.slice(bs, F.lit(1), (i / 128).cast("int")))
                + total(F.slice(x, (i / 128).cast("int") * 128 + 1, i % 128)),
            ),
        )

    return let(lens, sums)


def join_back(rows: DataFrame, aggregate: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of an aggregate by the long ``key``.

    Above an aggregation Spark reuses its partitioning and can't split a hot key's rows. The
    join is on the key's complement, so both sides are dealt anew and it can.
    """
    other = F.bitwise_not(F.col(key))
    return rows.withColumn("_other", other).join(aggregate.withColumn("_other", other).drop(key), "_other").drop("_other")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Alternating large-star / small-star over ``(a, b)`` long edges.

    Returns ``(node, root)`` for every node that has an edge to another one, root being
    the smallest node of its component. Each round is two joins on node keys, written
    to the shared folder; hot nodes meet map-side minima and splittable joins. No link
    list reaches the driver, only a count and a checksum per round.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = materialize(e, "links")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = join_back(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            join_back(large, low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        before, e = e, materialize(small, "links")
        discard(before)
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("connected components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def with_roots(star: DataFrame) -> DataFrame:
    """Members and roots of ``connected_components`` in one ``(node, root)`` table."""
    return star.union(star.select(F.col("root").alias("node"), "root").distinct())
