"""Yearly releases of customers, made of ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from citelake.plans.tables import table
from citelake.registry import register
from citelake.storage import new_path
from citelake.streaming import releases

_SCHEMA = "o_custkey long, o_orderkey long, total double, seq string"


@register(
    """
    WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_orderdate) AS d, bool_or(o_orderkey % 10 = 0) AS gone,
                      arg_max({'k': o_orderkey, 't': o_totalprice}, {'d': o_orderdate, 'k': o_orderkey}) AS last FROM orders WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2),
    z AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y DESC) AS rn FROM y)
    SELECT o_custkey, last.k AS o_orderkey, last.t AS total FROM z WHERE rn = 1 AND NOT gone"""
)
def releases_applied(spark, sf_dir):
    """A customer's last order of each year is an update; who has an order whose number divides
    by ten is deleted with that year's release."""
    root, path = new_path(spark, "releases"), new_path(spark, "customers")
    year = F.year("o_orderdate").alias("y")
    seq = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    orders = table(spark, sf_dir, "orders").where("o_custkey is not null and o_orderdate is not null")
    orders.select(year, "o_custkey", "o_orderkey", F.col("o_totalprice").alias("total"), seq.alias("seq")).write.partitionBy("y").json(f"{root}/updates")
    orders.where("o_orderkey % 10 = 0").select(year, "o_custkey").write.partitionBy("y").json(f"{root}/deletes")
    years = [r["y"] for r in orders.groupBy(year).agg(F.count_if(F.expr("o_orderkey % 10 = 0")).alias("n")).where("n > 0").collect()]  # one row a year
    every = [r["y"] for r in orders.select(year).distinct().collect()]
    releases.create(spark, path, _SCHEMA, ["o_custkey"], parts=8)
    steps = [(str(y), f"{root}/updates/y={y}", f"{root}/deletes/y={y}" if y in years else None) for y in every]
    releases.apply_releases(spark, path, steps, _SCHEMA, ["o_custkey"], "seq", parts=8)
    return releases.current(spark, path, _SCHEMA).select("o_custkey", "o_orderkey", "total")
