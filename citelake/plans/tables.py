"""Reading the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str, each: int = 50_000, like: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt over the tasks by ``key``: a small file is read by one task, which is too
    few where a row takes long. Tasks grow with the rows, ``each`` at most of evenly dealt ones;
    counted are those of ``like``, where ``rows`` are made of a table and no more than its own."""
    return rows.repartition(tasks(rows if like is None else like, each), key)


def tasks(rows: DataFrame, each: int = 50_000) -> int:
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))
