"""Rollups: ``orders`` stand for checks, ``customer`` for users, ``events`` for usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.functions import scoring
from citelake.operators import rollup
from citelake.plans.tables import table
from citelake.registry import register

AS_OF = "2001-08-02 00:00:00"


@register(
    """
    WITH g AS (SELECT o_custkey, count(*) AS checks, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed,
                      min(o_orderdate) AS first_at, max(o_orderdate) AS last_at FROM orders GROUP BY o_custkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
    SELECT g.o_custkey AS grp, checks, failed, first_at, last_at, o_orderkey AS latest_o_orderkey,
           o_orderstatus AS latest_o_orderstatus, o_totalprice AS latest_o_totalprice
    FROM g JOIN r USING (o_custkey) WHERE rn = 1 ORDER BY checks DESC, grp LIMIT 100"""
)
def latest_check_per_group(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return (
        rollup.latest_per_group(
            orders,
            F.col("o_custkey"),
            [F.col("o_orderdate"), F.col("o_orderkey")],
            [
                F.count("*").alias("checks"),
                F.count_if(F.col("o_orderstatus") == "F").alias("failed"),
                F.min("o_orderdate").alias("first_at"),
                F.max("o_orderdate").alias("last_at"),
            ],
            ["o_orderkey", "o_orderstatus", "o_totalprice"],
        )
        .orderBy(F.desc("checks"), "grp")
        .limit(100)
    )


@register(
    """
    SELECT count(*) AS checks, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
           count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
           count(DISTINCT o_custkey) AS users,
           round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / count(*), 2) AS failed_rate,
           CAST(floor(avg(CASE WHEN o_totalprice > 0 THEN CAST(round(o_totalprice) AS BIGINT) END)) AS BIGINT) AS avg_price
    FROM orders WHERE o_orderdate >= TIMESTAMP '2001-08-02' - INTERVAL 365 DAY"""
)
def overview_totals(spark, sf_dir):
    rows = rollup.within(table(spark, sf_dir, "orders"), "o_orderdate", F.to_timestamp_ntz(F.lit(AS_OF)), 365)
    price = F.round("o_totalprice").cast("long")
    out = rollup.totals(
        rows,
        {"cents": F.round(F.col("o_totalprice") * 100).cast("long"), "_p": F.when(F.col("o_totalprice") > 0, price)},
        {"failed": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O", "_n": F.col("o_totalprice") > 0},
        {"users": F.col("o_custkey")},
    )
    return out.withColumns(
        {
            "failed_rate": scoring.rate(F.col("failed"), F.col("checks")),
            "avg_price": F.floor(F.col("_p") / F.col("_n")),
        }
    ).drop("_p", "_n")


@register(
    """
    SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS checks, count(DISTINCT user_id) AS users,
           CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS references_checked
    FROM events GROUP BY 1"""
)
def daily_series(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return rollup.daily_series(table(spark, sf_dir, "events"), "ts", "user_id", {"references_checked": k})


@register(
    """SELECT p_name AS name, count(*) AS count FROM part WHERE p_name IS NOT NULL AND p_name <> ''
       GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
)
def breakdown_top10(spark, sf_dir):
    return rollup.breakdown(table(spark, sf_dir, "part"), "p_name")


@register(
    """
    WITH w AS (SELECT o_custkey, count(*) AS lifetime, max(o_orderdate) AS last_at,
                 count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-05-04') AS checks,
                 CAST(coalesce(sum(CASE WHEN o_orderdate >= TIMESTAMP '2001-05-04'
                      THEN CAST(round(o_totalprice) AS BIGINT) END), 0) AS BIGINT) AS amount
               FROM orders GROUP BY 1)
    SELECT c_custkey, c_mktsegment, coalesce(checks, 0) AS checks, coalesce(amount, 0) AS amount,
           coalesce(lifetime, 0) AS lifetime, last_at
    FROM customer LEFT JOIN w ON c_custkey = o_custkey
    ORDER BY checks DESC, lifetime DESC, c_custkey LIMIT 100"""
)
def user_rollup_left_join(spark, sf_dir):
    recent = F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("2001-05-04 00:00:00"))
    price = F.round("o_totalprice").cast("long")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = rollup.user_rollup(
        table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"),
        orders,
        "c_custkey",
        [F.count_if("_in").alias("checks"), F.coalesce(F.sum(F.when(F.col("_in"), price)), F.lit(0)).alias("amount")],
        [F.count("*").alias("lifetime"), F.max("o_orderdate").alias("last_at")],
        recent,
    )
    return out.fillna(0, ["checks", "amount", "lifetime"]).orderBy(F.desc("checks"), F.desc("lifetime"), "c_custkey").limit(100)


@register(
    """
    WITH u AS (SELECT c_custkey, count(o_orderkey) AS lifetime,
                      count(o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-05-04') AS recent
               FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)
    SELECT count(*) AS total, count(*) FILTER (WHERE recent > 0) AS active, count(*) FILTER (WHERE lifetime = 0) AS never,
           greatest(count(*) - count(*) FILTER (WHERE recent > 0) - count(*) FILTER (WHERE lifetime = 0), 0) AS idle FROM u"""
)
def idle_user_counts(spark, sf_dir):
    users = user_counts(spark, sf_dir)
    out = users.agg(
        F.count("*").alias("total"), F.count_if(F.col("recent") > 0).alias("active"), F.count_if(F.col("lifetime") == 0).alias("never")
    )
    return out.withColumn("idle", F.greatest(F.col("total") - F.col("active") - F.col("never"), F.lit(0)))


def user_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("lifetime"),
        F.count_if(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("2001-05-04 00:00:00"))).alias("recent"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left").fillna(0, ["lifetime", "recent"])


@register(
    """
    SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_o,
           count(*) FILTER (WHERE o_orderstatus = 'P') AS n_p, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_f,
           CAST(sum(CAST(round(o_totalprice) AS BIGINT)) AS BIGINT) AS amount FROM orders GROUP BY 1"""
)
def batch_status_pivot(spark, sf_dir):
    return rollup.status_pivot(
        table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["O", "P", "F"], {"amount": F.round("o_totalprice").cast("long")}
    )


@register(
    """SELECT event_type || ':' || CASE WHEN k >= 75 THEN 'error' WHEN k >= 50 THEN 'warning' ELSE 'status' END AS key,
              count(*) AS count
       FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1"""
)
def issue_histogram(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    kind = F.when(k >= 75, "error").when(k >= 50, "warning").otherwise("status")
    return rollup.histogram(table(spark, sf_dir, "events"), F.concat_ws(":", "event_type", kind))


@register(
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users,
              round(avg(CASE WHEN value > 0 THEN value END), 6) AS avg_value FROM events GROUP BY 1"""
)
def usage_summary(spark, sf_dir):
    return rollup.usage_summary(table(spark, sf_dir, "events"), "user_id", "event_type", "value")


@register(
    """SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds,
              CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS refs
       FROM events GROUP BY 1 ORDER BY events DESC, refs DESC, user_id LIMIT 10"""
)
def usage_summary_top_users(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.sum(k).alias("refs")
    )
    return rows.orderBy(F.desc("events"), F.desc("refs"), "user_id").limit(10)


@register(
    """SELECT count(*) AS total, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-30') AS last_day,
              count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-24') AS last_week FROM events"""
)
def recent_growth(spark, sf_dir):
    return rollup.growth(table(spark, sf_dir, "events"), "ts", F.to_timestamp_ntz(F.lit("2024-01-31 00:00:00")))


@register(
    """
    WITH r AS (SELECT l_orderkey, l_returnflag AS kind, CASE WHEN l_discount >= 0.08 THEN 3 WHEN l_discount >= 0.05 THEN 2
               WHEN l_discount >= 0.03 THEN 1 ELSE 0 END AS rk FROM lineitem)
    SELECT l_orderkey, count(*) AS issues, count(*) FILTER (WHERE rk > 0) AS flagged,
           (['none', 'low', 'medium', 'high'])[max(rk) + 1] AS worst FROM r GROUP BY 1"""
)
def paper_severity_rollup(spark, sf_dir):
    d = F.col("l_discount")
    severity = F.when(d >= 0.08, "high").when(d >= 0.05, "medium").when(d >= 0.03, "low").otherwise("none")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", severity.alias("severity"))
    return rollup.paper_rollups(rows, "l_orderkey", "severity", "l_returnflag").drop("kinds")


@register(
    """
    WITH g AS (SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS verified,
                 count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS errors,
                 count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS warnings,
                 count(*) FILTER (WHERE o_totalprice > 490000) AS fabricated FROM orders GROUP BY 1),
    s AS (SELECT *, CAST(greatest(0, least(100, round_even(verified / total * 70 + greatest(0, (total - errors - fabricated) / total) * 30
            - warnings / total * 5 - CASE WHEN fabricated > 0 THEN least(20, 8 + fabricated * 4) ELSE 0 END, 0))) AS INT) AS score FROM g)
    SELECT o_custkey, score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 70 THEN 'Good' WHEN score >= 50 THEN 'Fair'
           WHEN score >= 30 THEN 'Poor' ELSE 'Critical' END AS grade FROM s"""
)
def health_score(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("o_orderstatus") == "F").alias("verified"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("errors"),
        F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("warnings"),
        F.count_if(F.col("o_totalprice") > 490000).alias("fabricated"),
    )
    score = scoring.health_score(*[F.col(c) for c in ("total", "verified", "errors", "warnings", "fabricated")])
    return rows.select("o_custkey", score.alias("score"), scoring.health_grade(score).alias("grade"))


@register(
    """
    WITH s AS (SELECT n_regionkey, count(*) AS amount FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
    SELECT n_regionkey, amount, round(amount * 100.0 / (SELECT sum(amount) FROM s), 2) AS share FROM s"""
)
def share_of_total(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"
    )
    return rollup.share_of_total(customers, "n_regionkey", F.lit(1))


@register(
    """
    WITH u AS (SELECT p_type || '/' || p_brand AS model, p_size AS i, p_size * 2 AS o FROM part),
    r AS (SELECT * FROM (VALUES ('economy', 2.0, 8.0), ('economy/brand#1', 3.0, 15.0), ('promo', 0.5, 1.5)) t(k, ri, ro)),
    g AS (SELECT model, count(*) AS calls, CAST(sum(i) AS BIGINT) AS tokens_in, CAST(sum(o) AS BIGINT) AS tokens_out FROM u GROUP BY 1),
    b AS (SELECT g.*, ri, ro, row_number() OVER (PARTITION BY model ORDER BY length(k) DESC NULLS LAST) AS rn
          FROM g LEFT JOIN r ON contains(lower(model), k))
    SELECT model, calls, tokens_in, tokens_out,
           (tokens_in * coalesce(ri, 1.0) + tokens_out * coalesce(ro, 4.0)) / 1e6 AS cost FROM b WHERE rn = 1"""
)
def model_costs(spark, sf_dir):
    rates = spark.createDataFrame(
        [("economy", 2.0, 8.0), ("economy/brand#1", 3.0, 15.0), ("promo", 0.5, 1.5)], "rate_key string, rate_in double, rate_out double"
    )
    usage = table(spark, sf_dir, "part").select(
        F.concat_ws("/", "p_type", "p_brand").alias("model"), F.col("p_size").cast("long").alias("i"), (F.col("p_size") * 2).cast("long").alias("o")
    )
    return rollup.usage_costs(usage, rates, "model", "i", "o")


@register(
    """SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping_id(o_orderstatus, o_orderpriority) AS g
       FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"""
)
def status_cube(spark, sf_dir):
    cubed = table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority")
    return cubed.agg(F.count("*").alias("n"), F.grouping_id().alias("g"))


@register(
    """SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 100"""
)
def latest_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where(F.col("event_type") == "error").select("event_id", "ts", "user_id", "event_type")
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@register(
    """SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), '#7')
       OR contains(lower(p_type), 'promo') ORDER BY p_partkey DESC LIMIT 50 OFFSET 20"""
)
def paged_search(spark, sf_dir):
    asked = {"p_name": "ring", "p_brand": "#7", "p_type": "promo"}
    hit = F.lit(False)
    for column, term in asked.items():
        hit = hit | F.contains(F.lower(column), F.lit(term))
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_name", "p_brand").orderBy(F.desc("p_partkey")).offset(20).limit(50)


@register(
    """SELECT s_nationkey, n_name, r_name, count(*) AS members FROM supplier JOIN nation ON s_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3"""
)
def team_members(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    teams = nation.join(region, nation.n_regionkey == region.r_regionkey)
    rows = table(spark, sf_dir, "supplier").join(teams, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("s_nationkey", "n_name", "r_name").agg(F.count("*").alias("members"))
