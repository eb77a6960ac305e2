"""Totals of the web view and of bulk runs: ``orders`` play checks, ``events`` model calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import scoring
from citelake.operators import lists, rollup
from citelake.plans.tables import table
from citelake.registry import register


@register(
    """
    SELECT count(*) AS checks, CAST(coalesce(sum(o_orderkey % 50), 0) AS BIGINT) AS total_refs, CAST(coalesce(sum(o_orderkey % 3), 0) AS BIGINT) AS fabricated
    FROM orders WHERE o_custkey % 4 = 0 AND o_orderdate >= TIMESTAMP '1996-01-01'"""
)
def unattributed_totals(spark, sf_dir):
    owner = F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey"))
    checks = table(spark, sf_dir, "orders").select(
        owner.alias("owner"), "o_orderdate", (F.col("o_orderkey") % 50).alias("total_refs"), (F.col("o_orderkey") % 3).alias("fabricated")
    )
    return rollup.unattributed(checks, "owner", ["total_refs", "fabricated"], rollup.window_start("o_orderdate", "1996-01-01"))


@register(
    """
    WITH e AS (SELECT event_type AS model, event_id % 900 AS tin, event_id % 70 AS tout FROM events),
    r AS (SELECT * FROM (VALUES ('click', 0.5, 1.5), ('view', 0.1, 0.2), ('purchase', 3.0, 9.0)) AS t(model, rin, rout)),
    m AS (SELECT model, count(*) AS calls, CAST(sum(tin) AS BIGINT) AS input_tokens, CAST(sum(tout) AS BIGINT) AS output_tokens FROM e GROUP BY 1),
    c AS (SELECT m.*, input_tokens / 1000.0 * rin + output_tokens / 1000.0 * rout AS cost FROM m LEFT JOIN r USING (model))
    SELECT model, calls, input_tokens, output_tokens, CAST(round(cost, 6) AS DOUBLE) AS cost FROM c
    UNION ALL SELECT 'total', CAST(sum(calls) AS BIGINT), CAST(sum(input_tokens) AS BIGINT), CAST(sum(output_tokens) AS BIGINT),
              CASE WHEN count(*) = count(cost) THEN CAST(round(sum(cost), 6) AS DOUBLE) END FROM c"""
)
def usage_totals(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("model"), (F.col("event_id") % 900).alias("tokens_in"), (F.col("event_id") % 70).alias("tokens_out")
    )
    rates = spark.createDataFrame([("click", 0.5, 1.5), ("view", 0.1, 0.2), ("purchase", 3.0, 9.0)], "model string, rate_in double, rate_out double")
    out = rollup.lifetime_usage(calls, rates, "model")
    return out.withColumn("cost", F.round("cost", 6))


@register(
    """
    SELECT o_orderstatus AS batch, count(*) AS papers, CAST(sum(o_orderkey % 40) AS BIGINT) AS refs, CAST(sum(o_orderkey % 3) AS BIGINT) AS errors,
           count_if(o_orderkey % 3 > 0) AS papers_with_errors, bool_or(o_orderkey % 101 = 0) AS unreliable FROM orders GROUP BY 1"""
)
def bulk_totals(spark, sf_dir):
    key = F.col("o_orderkey")
    papers = table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("batch"), (key % 40).alias("refs"), (key % 3).alias("errors"), (key % 101 == 0).alias("unreliable")
    )
    return rollup.bulk(papers, "batch", ["refs", "errors"], ["errors"], ["unreliable"])


@register(
    """
    WITH s AS (SELECT unnest(string_split(p_name, ' ')) AS source FROM part) SELECT source, count(*) AS papers FROM s GROUP BY 1"""
)
def source_counts(spark, sf_dir):
    return rollup.source_counts(table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("sources")), "sources", "papers")


@register(
    """
    WITH w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, value / 500.0 AS p FROM events)
    SELECT user_id, CAST(least(3, floor(i / n * 4)) AS INT) AS page, count(*) AS windows, CAST(round(avg(p), 6) AS DOUBLE) AS mean,
           CAST(round(avg(CASE WHEN p >= 0.85 THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS high, CAST(round(avg(CASE WHEN p >= 0.3 AND p < 0.85 THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS medium,
           CAST(round(avg(CASE WHEN p < 0.3 THEN 1.0 ELSE 0.0 END), 6) AS DOUBLE) AS low FROM w GROUP BY 1, 2"""
)
def page_band_shares(spark, sf_dir):
    scores = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 500.0).alias("p"))
    out = rollup.page_bands(scores, "user_id", "event_id", "p", 4)
    return out.select("user_id", "page", "windows", *[F.round(c, 6).alias(c) for c in ("mean", "high", "medium", "low")])


@register(
    """
    WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_brand < 'Brand#3' THEN p_brand || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE split_part(p_name, ' ', 1) END AS s FROM part),
    l AS (SELECT p_brand, s, lag(s) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM p)
    SELECT p_brand, count(*) >= 3 AND count(DISTINCT s) >= greatest(3, count(*) // 2) AND count_if(b <= s) / greatest(1, count(*) - 1) >= 0.8 AS alphabetical FROM l GROUP BY 1"""
)
def alphabetical_lists(spark, sf_dir):
    key = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    surname = F.when(F.col("p_brand") < "Brand#3", F.concat("p_brand", key)).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    refs = table(spark, sf_dir, "part").select("p_brand", "p_partkey", surname.alias("surname"))
    return lists.alphabetical(refs, "p_brand", "p_partkey", "surname")


@register(
    """
    WITH m AS (SELECT user_id AS d, event_id AS i, CASE user_id % 4 WHEN 0 THEN event_id WHEN 1 THEN -event_id WHEN 2 THEN event_id % 97 ELSE event_id + CASE WHEN event_id % 5 = 0 THEN 100000 ELSE 0 END END AS n FROM events),
    l AS (SELECT d, n, lag(n) OVER (PARTITION BY d ORDER BY i) AS b, count(*) OVER (PARTITION BY d) AS k FROM m),
    r AS (SELECT d, max(k) AS k, count_if(b <= n) / greatest(count(b), 1) AS up, count_if(b >= n) / greatest(count(b), 1) AS down FROM l GROUP BY 1)
    SELECT d AS user_id, CASE WHEN k < 4 THEN 'ambiguous' WHEN up < 0.999 AND down >= 0.999 THEN 'reverse-appearance' WHEN d % 6 = 0 AND up < 0.999 THEN 'alphabetical'
           WHEN d % 6 <> 0 AND up >= 0.999 THEN 'appearance' WHEN d % 6 <> 0 AND up >= 0.6 THEN 'appearance' ELSE 'ambiguous' END AS convention,
           CASE WHEN k < 4 THEN NULL WHEN up < 0.999 AND down >= 0.999 THEN d % 6 <> 0 OR NULL WHEN d % 6 = 0 AND up < 0.999 THEN true WHEN d % 6 <> 0 AND up >= 0.999 THEN true
                WHEN d % 6 <> 0 AND up >= 0.6 THEN false END AS consistent FROM r WHERE NOT (d % 6 = 0 AND k < 4) AND NOT (d % 6 = 0 AND down >= 0.999)"""
)
def ordering_conventions(spark, sf_dir):
    at, key = F.col("event_id"), F.col("user_id")
    number = F.when(key % 4 == 0, at).when(key % 4 == 1, -at).when(key % 4 == 2, at % 97).otherwise(at + F.when(at % 5 == 0, 100000).otherwise(0))
    marks = table(spark, sf_dir, "events").select("user_id", at.alias("at"), number.alias("number"))
    alphabetical = table(spark, sf_dir, "events").select("user_id", (key % 6 == 0).alias("alphabetical")).distinct()
    out = lists.conventions(marks, alphabetical, "user_id", "at", "number")
    return out.where(~(F.col("alphabetical") & (F.col("convention").isin("reverse-appearance") | (F.col("n") < 4) | (F.col("down") >= 0.999)))).select(
        "user_id", "convention", "consistent"
    )


@register(
    """
    WITH u AS (SELECT o_custkey AS user_id, count(*) AS checks FROM orders GROUP BY 1)
    SELECT user_id, checks, (SELECT count(*) FROM u) >= 500 AS truncated FROM u ORDER BY checks DESC, user_id LIMIT 500"""
)
def busiest_users(spark, sf_dir):
    users = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("checks"))
    return rollup.clamped(users, 10_000, F.desc("checks"), "user_id")


@register(
    """
    SELECT event_id FROM events WHERE user_id = (SELECT min(user_id) FROM events) ORDER BY ts, event_id LIMIT 2000"""
)
def oldest_session_checks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    first = events.agg(F.min("user_id").alias("user_id"))
    return rollup.clamped(events.join(first, "user_id"), 2000, "ts", "event_id", most=2000).select("event_id")


@register("SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def visible_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.where(scoring.visible(F.col("o_custkey"), F.col("o_orderpriority"), 7, ["1-URGENT", "3-MEDIUM"])).select("o_orderkey")


@register(
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT' AND o_orderstatus <> 'F' THEN 'cancelled' ELSE o_orderstatus END AS status FROM orders"""
)
def cancelled_batches(spark, sf_dir):
    status = scoring.cancelled(F.col("o_orderstatus"), F.col("o_orderpriority") == "1-URGENT", ("F", "P"))
    return table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@register("SELECT count(*) AS n, count(*) >= 1000 AS looks_full, count(*) > 0 AS some FROM lineitem")
def snapshot_size(spark, sf_dir):
    """Row count, of which Parquet needs the footers alone."""
    n = table(spark, sf_dir, "lineitem").agg(F.count("*").alias("n"))
    return n.select("n", (F.col("n") >= 1000).alias("looks_full"), (F.col("n") > 0).alias("some"))


@register(
    """
    SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END, p_retailprice DESC, p_partkey) AS INT) AS place
    FROM part WHERE p_size >= 40 ORDER BY place LIMIT 50"""
)
def graph_nodes_in_order(spark, sf_dir):
    status = F.get(F.array(*[F.lit(s) for s in ("error", "warning", "unverified", "verified")]), F.col("p_size") % 4)
    rows = table(spark, sf_dir, "part").where("p_size >= 40").select("p_partkey", status.alias("status"), F.col("p_retailprice").alias("times_seen"))
    return lists.first_nodes(rows, "p_partkey", 50)
