"""Releases of a corpus: files of updates and deletions, applied oldest first, with a ledger.

A release is one step: its files are all read before the table is touched, and one that can't
be read keeps the whole release out. The watermark moves only past releases that came in
without a gap; what comes behind a gap is applied, noted as ``ahead`` and applied again by the
next run. Rows carry their release and deletions stay as marks, so that a release that comes
twice, or after a later one, changes nothing that it shouldn't.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.operators.deltas import latest_wins
from citelake.storage import discard, materialize
from citelake.streaming.events import deal_by_key

#: Spark's names for what a file can be blamed for. Any other failure, a full disk say, ends the run.
UNREADABLE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "MALFORMED_RECORD")
LEDGER = "release string, status string, updated long, deleted long, error string"


def create(spark: SparkSession, path: str, schema: str, key: list[str], parts: int = 64) -> None:
    """An empty table at ``path``: ``schema`` and where a row comes from."""
    empty = deal_by_key(spark.createDataFrame([], schema), key, parts)
    empty.withColumns({"_release": F.lit(""), "_gone": F.lit(False)}).write.partitionBy("_part").parquet(path)
    spark.createDataFrame([], LEDGER).write.parquet(f"{path}__ledger")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    full = spark.createDataFrame([], schema).withColumns({"_release": F.lit(""), "_gone": F.lit(False), "_part": F.lit(0)}).schema
    return spark.read.schema(full).parquet(path)


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the table as they are now."""
    table = _stored(spark, path, schema)
    return table.where(~F.col("_gone")).drop("_release", "_gone", "_part")


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per attempt: release, applied / ahead / failed, numbers of rows, the error."""
    return spark.read.schema(LEDGER).parquet(f"{path}__ledger")


def watermark(spark: SparkSession, path: str) -> str | None:
    return ledger(spark, path).where("status = 'applied'").agg(F.max("release")).first()[0]


def _read(spark: SparkSession, folder: str | None, schema) -> DataFrame:
    """The JSON lines of a folder; a line that isn't one fails the read."""
    if folder is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(folder)


def _changes(spark: SparkSession, path: str, release: str, updates: str | None, deletes: str | None, schema: str, key: list[str], seq: str, parts: int) -> DataFrame:
    new = _read(spark, updates, schema).withColumn("_gone", F.lit(False))
    whole = spark.createDataFrame([], schema).schema
    gone = _read(spark, deletes, whole.__class__([whole[k] for k in key])).withColumn("_gone", F.lit(True))
    both = new.unionByName(gone, allowMissingColumns=True).withColumn("_release", F.lit(release))
    last = latest_wins(both.where(" and ".join(f"`{k}` is not null" for k in key)), key, [F.col("_gone"), F.col(seq)])
    return materialize(deal_by_key(last, key, parts), "release")


def _merge(spark: SparkSession, path: str, changes: DataFrame, schema: str, key: list[str], seq: str) -> None:
    touched = [r[0] for r in changes.select("_part").distinct().collect()]  # ``parts`` at most
    if not touched:
        return
    old = _stored(spark, path, schema).where(F.col("_part").isin(touched))
    fresh = materialize(latest_wins(old.unionByName(changes), key, [F.col("_release"), F.col("_gone"), F.col(seq)]), "merged")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
    discard(fresh)


def apply_releases(spark: SparkSession, path: str, releases: list[tuple[str, str | None, str | None]], schema: str, key: list[str], seq: str, parts: int = 64) -> str | None:
    """Bring in all releases past the watermark, oldest first, and return the new watermark.

    ``releases``: name, folder of updates and folder of deletions (either may be None) of JSON
    lines; names sort by age. Of a key's updates in a release the last by ``seq`` counts, and a
    deletion over all of them. ``parts`` is that of ``create``. Rows without a key are dropped.
    """
    done = watermark(spark, path)
    gap = False
    for release, updates, deletes in sorted(releases):
        if done is not None and release <= done:
            continue
        updated = deleted = 0
        changes = error = None
        try:
            changes = _changes(spark, path, release, updates, deletes, schema, key, seq, parts)
        except (PySparkException, Py4JJavaError) as failure:
            reason = next((line for line in str(failure).split("\n") if any(u in line for u in UNREADABLE)), None)
            if reason is None:
                raise
            gap, error = True, reason[:500]
        if changes is not None:
            _merge(spark, path, changes, schema, key, seq)
            updated, deleted = changes.agg(F.count_if(~F.col("_gone")), F.count_if("_gone")).first()
            discard(changes)
        status = "failed" if changes is None else "ahead" if gap else "applied"
        spark.createDataFrame([(release, status, updated, deleted, error)], LEDGER).coalesce(1).write.mode("append").parquet(f"{path}__ledger")
    return watermark(spark, path)
