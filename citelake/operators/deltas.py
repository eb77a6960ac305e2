"""Upserts, deletes and unions of corpora as whole-table transformations.

Each is idempotent: applying the same delta twice gives the same table, unlike a counter
that each replay raises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the last by ``order``; rows of a null key are left out."""
    named = rows.dropna(subset=key)
    newest = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_r")
    return named.groupBy(*key).agg(newest).select("_r.*")


def upsert(table: DataFrame, delta: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Rows of the delta replace those of their key; within the delta the last ``seq`` wins."""
    fresh = latest_wins(delta, key, [F.col(seq)]).drop(seq)
    return table.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def delete(table: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return table.join(keys.select(*key).distinct(), key, "left_anti")


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    return table.unionByName(rows.join(table.select(*key), key, "left_anti").dropDuplicates(key))


def count_seen(sightings: DataFrame, key: str, seq: str, ts: str, keep_first: list[str], keep_last: list[str]) -> DataFrame:
    """Identity table of sightings: how often, first and last time; some fields as first
    seen, others as last seen with a value."""
    return sightings.groupBy(key).agg(
        F.count("*").alias("times_seen"),
        F.min(ts).alias("first_seen"),
        F.max(ts).alias("last_seen"),
        *[F.min_by(c, seq).alias(c) for c in keep_first],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in keep_last],
    )


def union_by_priority(corpora: dict[str, DataFrame], key: Column) -> DataFrame:
    """Rows with a key of every corpus; a later corpus replaces an earlier one's row."""
    tagged = [df.withColumns({"corpus": F.lit(name), "_rank": F.lit(k)}) for k, (name, df) in enumerate(corpora.items())]
    rows = reduce(DataFrame.unionByName, tagged).withColumn("_key", key).where("_key is not null and _key <> ''")
    w = Window.partitionBy("_key").orderBy(F.desc("_rank"))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_rank")


def changed_counters(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New minus old of each counter, for keys of either side where any differs."""
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    both = new.select(key, *columns).join(o, key, "full")
    deltas = [(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns]
    out = both.select(key, *deltas)
    return out.where(reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns]))
