"""Shard placement by a permutation-filled lookup table.

Each shard has its own preference order over the slots of a table of prime size: start at
``offset`` and go on by ``skip``, both from a hash of the shard's name. Shards take turns
claiming their first free slot until the table is full, so that slot counts differ by one
at most and a shard that goes leaves nearly all other slots where they were. Rows find
their shard by a hash of their key, modulo the table size, and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 65_537


def _hash(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The index in ``shards`` that holds each slot. ``size`` is a prime over len(shards)."""
    if not 0 < len(set(shards)) == len(shards) < size:
        raise ValueError("shards must be distinct, at least one and fewer than slots")
    if any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table size must be a prime")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
            if not left:
                break
    return table


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """60 bits of the key text's MD5, modulo the table size; a null key counts as empty."""
    bits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
    return F.pmod(bits.cast("long"), F.lit(size)).cast("int")


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``(slot, shard)``, one row per slot: ``size`` rows whatever the data."""
    slots = F.lit(",".join(map(str, fill_table(shards, size))))
    names = F.array(*map(F.lit, shards))
    filled = spark.range(1).select(F.posexplode(F.split(slots, ",")).alias("slot", "k"))
    return filled.select("slot", F.get(names, F.col("k").cast("int")).alias("shard"))


def assign_shards(
    rows: DataFrame, shards: list[str], key: str, size: int = TABLE_SIZE, salt: list[str] | None = None
) -> DataFrame:
    """Rows with ``slot`` and ``shard`` in place of any columns of those names.

    No row moves: the table, of a fixed size, is broadcast. Null keys take the slot of the
    empty text. Rows of one key share a shard; where one key may hold a large part of the
    rows, ``salt`` names columns that spread it (they then place rows together with the
    key). Empty tables give empty ones, repeated rows stay.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (salt or [])]
    value = F.concat_ws("\x1f", F.coalesce(F.col(key).cast("string"), F.lit("")), *parts) if parts else F.col(key)
    placed = rows.drop("slot", "shard") if key not in ("slot", "shard") else rows
    placed = placed.withColumn("slot", key_slot(value, size))
    return placed.join(F.broadcast(table_frame(rows.sparkSession, shards, size)), "slot")
