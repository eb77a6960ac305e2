"""Rollups over check history: totals, series, breakdowns, per-user and per-paper tables.

Every function is one or two aggregations with map-side partials; what is joined is an
aggregate or a dimension, never the fact table with itself. Sums and counts are hash
aggregations; the latest row of a group (``max_by`` of a struct) is a sort aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.scoring import model_cost, rate


def within(rows: DataFrame, ts: str, as_of: Column, days: int | None) -> DataFrame:
    """Rows of the last ``days`` days; all rows for None or no positive number."""
    return rows if not days or days <= 0 else rows.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def totals(rows: DataFrame, sums: dict[str, Column], counts: dict[str, Column], distincts: dict[str, Column]) -> DataFrame:
    """One row: ``checks``, sums (0 for none), conditional counts, distinct counts."""
    return rows.agg(
        F.count("*").alias("checks"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
        *[F.count_if(c).alias(n) for n, c in counts.items()],
        *[F.count_distinct(c).alias(n) for n, c in distincts.items()],
    )


def daily_series(rows: DataFrame, ts: str, user: str, sums: dict[str, Column]) -> DataFrame:
    return rows.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("checks"),
        F.count_distinct(user).alias("users"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
    )


def breakdown(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The ``top`` most frequent values, ties by name; null and '' don't count."""
    named = rows.where(F.col(column).isNotNull() & (F.col(column) != ""))
    counts = named.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "name").limit(top)


def latest_per_group(rows: DataFrame, group: Column, order: list[Column], aggregates: list[Column], keep: list[str]) -> DataFrame:
    """Per group the aggregates and the columns ``keep`` of its latest row.

    ``max_by`` in the same aggregation: no window sort, no self-join.
    """
    newest = F.max_by(F.struct(*keep), F.struct(*order)).alias("_newest")
    return rows.groupBy(group.alias("grp")).agg(*aggregates, newest).select("*", *[F.col(f"_newest.{c}").alias(f"latest_{c}") for c in keep]).drop("_newest")


def user_rollup(users: DataFrame, rows: DataFrame, user: str, aggregates: list[Column], lifetime: list[Column], in_window: Column) -> DataFrame:
    """Users with aggregates of their rows in the window and over their lifetime; users
    without rows stay, with nulls, which the caller fills. One pass over the rows."""
    per = rows.withColumn("_in", in_window).groupBy(user).agg(*aggregates, *lifetime)
    return users.join(per, user, "left")


def status_pivot(rows: DataFrame, group: Column | str, status: str, values: list[str], sums: dict[str, Column]) -> DataFrame:
    return rows.groupBy(group).agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(status) == v).alias(f"n_{v.lower()}") for v in values],
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()],
    )


def histogram(rows: DataFrame, key: Column) -> DataFrame:
    return rows.groupBy(key.alias("key")).agg(F.count("*").alias("count"))


def paper_rollups(records: DataFrame, paper: str, severity: str, kind: str) -> DataFrame:
    """Per paper: issues, flagged ones, the worst severity and a map of kinds to counts."""
    rank = (
        F.when(F.col(severity) == "high", 3).when(F.col(severity) == "medium", 2).when(F.col(severity) == "low", 1).otherwise(0)
    )
    by_kind = records.groupBy(paper, kind).agg(
        F.count("*").alias("n"), F.count_if(rank > 0).alias("f"), F.max(rank).alias("r")
    )
    names = F.array(*map(F.lit, ("none", "low", "medium", "high")))
    return by_kind.groupBy(paper).agg(
        F.sum("n").alias("issues"),
        F.sum("f").alias("flagged"),
        F.get(names, F.max("r")).alias("worst"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("kinds"),
    )


def usage_summary(events: DataFrame, user: str, kind: str, value: str) -> DataFrame:
    return events.groupBy(kind).agg(
        F.count("*").alias("n"),
        F.count_distinct(user).alias("users"),
        F.round(F.avg(F.when(F.col(value) > 0, F.col(value))), 6).alias("avg_value"),
    )


def growth(rows: DataFrame, ts: str, as_of: Column) -> DataFrame:
    return rows.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(ts) > as_of - F.make_dt_interval(F.lit(1))).alias("last_day"),
        F.count_if(F.col(ts) > as_of - F.make_dt_interval(F.lit(7))).alias("last_week"),
    )


def share_of_total(rows: DataFrame, group: str, amount: Column) -> DataFrame:
    """Sums per group with their percent of all; the total is one row joined back."""
    per = rows.groupBy(group).agg(F.sum(amount).alias("amount"))
    whole = per.agg(F.sum("amount").alias("whole"))
    return per.crossJoin(F.broadcast(whole)).select(group, "amount", rate(F.col("amount"), F.col("whole")).alias("share"))


def usage_costs(usage: DataFrame, rates: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Costs by model name; the rate is that of the longest key the name contains. Names
    meet keys by equality with their substrings, so no table of rates is too large."""
    names = usage.groupBy(model).agg(F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.count("*").alias("calls"))
    low, n = F.lower(F.col(model)), F.length(F.col(model))
    parts = F.transform(
        F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(low, i, k))
    )
    keyed = names.where(n > 0).select(model, F.explode(F.array_distinct(F.flatten(parts))).alias("rate_key"))
    best = keyed.join(rates, "rate_key").groupBy(model).agg(
        F.max_by(F.struct("rate_in", "rate_out"), F.length("rate_key")).alias("_rate")
    )
    cost = model_cost(F.col("tokens_in"), F.col("tokens_out"), F.col("_rate.rate_in"), F.col("_rate.rate_out"))
    return names.join(best, model, "left").select(model, "calls", "tokens_in", "tokens_out", cost.alias("cost"))


def first_seen_order(rows: DataFrame, key: Column, seq: str) -> DataFrame:
    """Order-preserving distinct: per key the row of the smallest ``seq``; null keys all
    stay. An aggregation with map-side partials, so a hot key is no hot task."""
    keyed = rows.withColumn("_key", key)
    first = keyed.where("_key is not null").groupBy("_key").agg(F.min_by(F.struct(*rows.columns), seq).alias("_r"))
    return first.select("_r.*").union(keyed.where("_key is null").drop("_key"))


def window_start(ts: str, day: str | None) -> Column:
    """Rows from a day on; all rows for None."""
    return F.lit(True) if day is None else F.col(ts) >= F.lit(day).cast("timestamp_ntz")


def unattributed(rows: DataFrame, user: str, sums: list[str], in_window: Column) -> DataFrame:
    """One row of totals over the rows that belong to no user."""
    return totals(rows.where(F.col(user).isNull() & in_window), {c: F.col(c) for c in sums}, {}, {})


def lifetime_usage(calls: DataFrame, rates: DataFrame, model: str) -> DataFrame:
    """Calls, tokens and cost of each model, and of all (``total``). Rates are for 1,000 tokens;
    a model without a rate has no cost, and then the total has none."""
    per = calls.groupBy(model).agg(
        F.count("*").alias("calls"), F.sum("tokens_in").alias("input_tokens"), F.sum("tokens_out").alias("output_tokens")
    )
    cost = F.col("input_tokens") / 1000.0 * F.col("rate_in") + F.col("output_tokens") / 1000.0 * F.col("rate_out")
    priced = per.join(rates, model, "left").select(model, "calls", "input_tokens", "output_tokens", cost.alias("cost"))
    known = F.when(F.bool_and(F.col("cost").isNotNull()), F.sum("cost"))
    total = priced.agg(*[F.sum(c).alias(c) for c in ("calls", "input_tokens", "output_tokens")], known.alias("cost"))
    return priced.union(total.select(F.lit("total").alias(model), *total.columns))


def bulk(papers: DataFrame, group: str, sums: list[str], with_any: list[str], flags: list[str]) -> DataFrame:
    """Per run its papers, sums, the papers that have any of something, and whether any paper
    has a flag."""
    return papers.groupBy(group).agg(
        F.count("*").alias("papers"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums],
        *[F.count_if(F.col(c) > 0).alias(f"papers_with_{c}") for c in with_any],
        *[F.bool_or(c).alias(c) for c in flags],
    )


def source_counts(rows: DataFrame, sources: str, name: str) -> DataFrame:
    """How many rows name each source; a row that names one twice counts twice."""
    return rows.select(F.explode(sources).alias("source")).groupBy("source").agg(F.count("*").alias(name))


def page_bands(scores: DataFrame, doc: str, at: str, score: str, pages: int, high: float = 0.85, medium: float = 0.30) -> DataFrame:
    """Per document and page (``pages`` equal parts of its windows) the windows, their mean score
    and the shares in each band."""
    from pyspark.sql import Window

    order = Window.partitionBy(doc).orderBy(at)
    share = (F.row_number().over(order) - 1) / F.count("*").over(Window.partitionBy(doc))
    page = F.least(F.lit(pages - 1), F.floor(share * pages)).cast("int")
    s = F.col(score)
    bands = {"high": s >= high, "medium": (s >= medium) & (s < high), "low": s < medium}
    return scores.withColumn("page", page).groupBy(doc, "page").agg(
        F.count("*").alias("windows"), F.avg(s).alias("mean"), *[F.avg(F.when(b, 1.0).otherwise(0.0)).alias(n) for n, b in bands.items()]
    )


def clamped(rows: DataFrame, limit: int, *order, least: int = 1, most: int = 500) -> DataFrame:
    """The first ``limit`` rows, between ``least`` and ``most``, and whether there may be more:
    ``truncated`` where the limit is reached."""
    n = max(least, min(most, limit))
    first = rows.orderBy(*order).limit(n)
    reached = rows.limit(n).agg((F.count("*") >= n).alias("truncated"))
    return first.crossJoin(F.broadcast(reached)).orderBy(*order)
