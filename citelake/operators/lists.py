"""Orders of reference lists and of what is shown of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def alphabetical(refs: DataFrame, group: str, index: str, surname: str) -> DataFrame:
    """Per list whether it goes by surname: three entries or more, at least three and half of
    them different, four fifths of neighbours not descending. Entries without surname don't
    count."""
    order = Window.partitionBy(group).orderBy(index)
    rows = refs.where(F.coalesce(F.col(surname), F.lit("")) != "").withColumn("_b", F.lag(surname).over(order))
    n, distinct = F.count("*"), F.count_distinct(surname)
    rising = F.count_if(F.col("_b") <= F.col(surname)) / F.greatest(F.lit(1), n - 1)
    fits = (n >= 3) & (distinct >= F.greatest(F.lit(3), F.floor(n / 2))) & (rising >= 0.8)
    return rows.groupBy(group).agg(fits.alias("alphabetical"))


def conventions(marks: DataFrame, alphabetical_lists: DataFrame, doc: str, at: str, number: str) -> DataFrame:
    """Per document the convention its first mentions follow, and whether they do so without
    exception. ``reverse-appearance`` for numbers that only fall, ``alphabetical`` for a list
    by surname whose numbers don't only rise, ``appearance`` for rising ones (consistent from
    999 in 1,000 neighbours, not below, from 6 in 10), else ``ambiguous``; so below four."""
    order = Window.partitionBy(doc).orderBy(at)
    rows = marks.withColumn("_b", F.lag(number).over(order))
    n, b = F.count("*"), F.col("_b")
    pairs = F.greatest(F.count("_b"), F.lit(1))
    per = rows.groupBy(doc).agg(
        n.alias("n"), (F.count_if(b <= F.col(number)) / pairs).alias("up"), (F.count_if(b >= F.col(number)) / pairs).alias("down")
    )
    per = per.join(alphabetical_lists, doc, "left").withColumn("alphabetical", F.coalesce("alphabetical", F.lit(False)))
    some, by_name = F.col("n") >= 4, F.col("alphabetical")
    strong = some & (F.col("up") >= 0.999)
    reverse = some & ~by_name & ~strong & (F.col("down") >= 0.999)
    appears = some & ~by_name & (F.col("up") >= 0.6)
    convention = F.when(reverse, "reverse-appearance").when(by_name & ~strong, "alphabetical").when(appears, "appearance").otherwise("ambiguous")
    consistent = F.when(reverse | (by_name & ~strong), True).when(appears, strong)
    return per.withColumns({"convention": convention, "consistent": consistent})


#: What a graph shows first.
STATUS_ORDER = ("error", "warning", "unverified", "verified")


def first_nodes(nodes: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` nodes by status, then how often they were seen, with their place."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    order = [F.when(rank > 0, rank).otherwise(len(STATUS_ORDER) + 1), F.desc("times_seen"), F.col(key)]
    # the window orders what the limit leaves, not all nodes
    some = nodes.orderBy(*order).limit(most)
    return some.select(key, F.row_number().over(Window.orderBy(*order)).alias("place"))
