"""Ordered-sequence operators: sessions, running maxima, windows of text, intervals.

Each works within a partition key; a window sorts one key's rows, so keys (users, papers)
must not hold an unbounded share of the rows. Where one may, filter or split it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.text import let


def sessions(rows: DataFrame, user: str, start: Column, end: Column, seq: str, gap_minutes: int = 30, batch: Column | None = None) -> DataFrame:
    """Rows with ``session``, a number per user from 1.

    A row starts a session when it begins more than ``gap_minutes`` after the latest end so
    far, unless it is in the same batch as the row before it.
    """
    w = Window.partitionBy(user).orderBy(start, seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    far = start > F.max(end).over(before) + F.make_dt_interval(mins=F.lit(gap_minutes))
    if batch is not None:
        far = far & ~F.coalesce(batch == F.lag(batch).over(w), F.lit(False))
    new = F.coalesce(far, F.lit(False)).cast("long")
    return rows.withColumn("_new", new).withColumn("session", 1 + F.sum("_new").over(w)).drop("_new")


def session_summary(rows: DataFrame, user: str, start: Column, end: Column) -> DataFrame:
    """Per session: rows, begin, end, seconds (null if negative)."""
    out = rows.groupBy(user, "session").agg(F.count("*").alias("checks"), F.min(start).alias("begin"), F.max(end).alias("end"))
    seconds = F.timestamp_diff("SECOND", F.col("begin"), F.col("end"))
    return out.withColumn("seconds", F.when(seconds >= 0, seconds))


def out_of_order(rows: DataFrame, group: str, order: list[str], number: str) -> DataFrame:
    """Rows whose number is below the largest before them."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("largest_before", F.max(number).over(w)).where(F.col(number) < F.col("largest_before"))


def adjacent_order(rows: DataFrame, group: str, order: list[str], number: str, least: int = 4) -> DataFrame:
    """Per group with ``least`` rows: shares of adjacent pairs that don't fall and don't rise."""
    w = Window.partitionBy(group).orderBy(*order)
    pairs = rows.withColumn("_p", F.lag(number).over(w))
    up, down = (F.avg(F.when(c, 1.0).otherwise(0.0)) for c in (F.col("_p") <= F.col(number), F.col("_p") >= F.col(number)))
    held = pairs.groupBy(group).agg(F.count("*").alias("n"))
    shares = pairs.where("_p is not null").groupBy(group).agg(up.alias("up"), down.alias("down"))
    return held.where(F.col("n") >= least).join(shares, group)


def text_windows(words: Column, size: int = 350, floor: int = 300) -> Column:
    """Overlapping windows by half of an array of words, as an array of arrays.

    A last window shorter than ``size`` stands if it has ``floor`` words, else it joins the
    one before where both stay within one and a half sizes, else it goes. A text of one
    window stands if it has ``floor`` words.
    """
    return let(words, lambda w: _windows(w, size, floor))


def _windows(words: Column, size: int, floor: int) -> Column:
    step = max(1, size // 2)
    n = F.size(words)
    full = F.greatest(F.lit(1), F.ceil((n - size) / step).cast("int") + 1)
    last_at = (full - 1) * step
    tail = n - last_at
    whole = F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.slice(words, i * step + 1, F.lit(size)))
    none = F.slice(whole, 1, 0)
    merged = F.concat(
        F.slice(whole, 1, F.greatest(full - 2, F.lit(0))),
        F.array(F.concat(F.get(whole, full - 2), F.get(whole, full - 1))),
    )
    return (
        F.when(n <= size, F.when(n >= floor, F.array(words)).otherwise(none))
        .when((tail >= size) | (tail >= floor), whole)
        .when(size + tail <= int(size * 1.5), merged)
        .otherwise(F.slice(whole, 1, full - 1))
    )


def corroborated(rows: DataFrame, doc: str, at: str, score: str, high: float = 0.85) -> DataFrame:
    """High windows with a high neighbour directly before or after."""
    w = Window.partitionBy(doc).orderBy(at)

    def near(f):
        return F.coalesce((F.abs(f(at).over(w) - F.col(at)) == 1) & (f(score).over(w) >= high), F.lit(False))

    return rows.withColumn("_near", near(F.lag) | near(F.lead)).where((F.col(score) >= high) & F.col("_near")).drop("_near")


def _with_islands(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Rows with ``_island``, a number for each run of intervals that overlap or touch."""
    w = Window.partitionBy(group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w)).drop("_new")


def merge_intervals(rows: DataFrame, group: str, start: str, end: str, own: str | None = None) -> DataFrame:
    """Islands of intervals that overlap or touch: ``start``, ``end``, ``n``, and with ``own`` the
    sorted ``ids`` of the intervals that each is made of."""
    found = [F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")]
    if own is not None:
        found.append(F.sort_array(F.collect_list(own)).alias("ids"))
    return _with_islands(rows, group, start, end).groupBy(group, "_island").agg(*found).drop("_island")


def covered_segments(rows: DataFrame, group: str, start: str, end: str, own: str) -> DataFrame:
    """``(group, start, end, ids)``: maximal segments between neighbouring endpoints and the
    intervals over each (not none), sorted. Endpoints are numbered in their group, an interval
    is over the segments from its first to its last number: rows are what the result lists.
    ``own`` is unique in a group; an interval of no length covers nothing."""
    ends = F.array(F.col(start), F.col(end))
    events = rows.where(F.col(start) <= F.col(end)).select(group, F.col(own).alias("_id"), F.explode(ends).alias("_at"))
    placed = events.withColumn("_n", F.dense_rank().over(Window.partitionBy(group).orderBy("_at")))
    after = F.min("_at").over(Window.partitionBy(group).orderBy("_n").rangeBetween(1, 1))
    placed = placed.withColumn("_after", after)
    points = placed.select(group, "_n", F.col("_at").alias(start), F.col("_after").alias(end), F.lit(None).cast(rows.schema[own].dataType).alias("_id")).distinct()
    spans = placed.groupBy(group, "_id").agg(F.min("_n").alias("a"), F.max("_n").alias("b")).where("a < b")
    over = spans.select(group, F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("_n"), "_id")
    both = points.unionByName(over, allowMissingColumns=True)
    found = both.groupBy(group, "_n").agg(F.max(start).alias(start), F.max(end).alias(end), F.sort_array(F.collect_list("_id")).alias("ids"))
    return found.where(F.size("ids") > 0).select(group, start, end, "ids")


def interval_segments(rows: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """Maximal segments between neighbouring endpoints with the number of intervals over
    each (not none). A running sum of +1 and -1 replaces the join of points and intervals."""
    steps = rows.select(group, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    points = steps.select(group, "e.*").groupBy(group, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(group).orderBy("at")
    out = points.select(group, F.col("at").alias(start), F.lead("at").over(w).alias(end), F.sum("d").over(w).cast("long").alias("covering"))
    return out.where(F.col(end).isNotNull() & (F.col("covering") > 0))


def entry_slices(rows: DataFrame, doc: str, text: str, starts: Column) -> DataFrame:
    """Text from each start offset (from 1) to the next one."""
    at = rows.select(doc, text, F.posexplode(starts).alias("i", "at"), starts.alias("_all"))
    stop = F.coalesce(F.get("_all", F.col("i") + 1), F.length(text) + 1)
    return at.select(doc, "i", F.substring(F.col(text), F.col("at"), stop - F.col("at")).alias("entry"))


def chunk_text(text: Column, size: int = 8000, overlap: int = 200) -> Column:
    """Overlapping pieces of at most ``size`` characters."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
