"""Streams of usage events: windows, sessions, totals, deduplication, deltas.

State is keyed by window or user and dropped behind the watermark; where ``late`` is None
there is none, rows of any age count and state stays. Batch functions of the
same name semantics are in ``citelake.operators``; tests hold streams against them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.storage import new_path


def read_events(spark: SparkSession, folder: str, name: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The table ``name``, one file or a folder of them: the glob fits its name alone."""
    return (
        spark.readStream.schema(schema)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    )


def window_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def session_counts(events: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    timed = timed if late is None else timed.withWatermark(ts, late)
    out = timed.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("checks"), F.max(ts).alias("end"))
    return out.select(user, F.col("w.start").alias("begin"), "end", "checks")


def running_totals(events: DataFrame, key: str, value: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def deduplicated(events: DataFrame, ts: str, key: list[str], late: str | None = "10 minutes") -> DataFrame:
    if late is None:
        return events.dropDuplicates(key)
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def run_to_end(stream: DataFrame, mode: str = "complete", name: str = "stream") -> DataFrame:
    """Process all there is now and return the result as a table in the shared folder.

    ``complete`` keeps the last batch's table; ``append`` and ``update`` keep every batch.
    The checkpoint makes a restart go on where it stopped; a batch that runs twice writes
    the same folder again.
    """
    spark = stream.sparkSession
    out = new_path(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table" if mode == "complete" else f"{out}/table/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table").select(*stream.columns)


def deal_by_key(table: DataFrame, key: list[str], parts: int) -> DataFrame:
    """Rows with ``_part``, the folder of ``apply_deltas`` that their key belongs to."""
    return table.withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int"))


def apply_deltas(stream: DataFrame, path: str, key: list[str], seq: str, parts: int = 64) -> None:
    """Upsert micro-batches into the table at ``path``, which is written by ``deal_by_key``
    with the same ``parts`` and partitioned by ``_part``. A batch rewrites the parts that its
    keys fall into, no others. A batch that comes twice gives the same table."""
    from citelake.operators.deltas import upsert
    from citelake.storage import discard, materialize

    spark = stream.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        rows = deal_by_key(batch, key, parts)
        touched = [r[0] for r in rows.select("_part").distinct().collect()]  # ``parts`` at most
        if not touched:
            return
        old = spark.read.parquet(path).where(F.col("_part").isin(touched))
        fresh = materialize(upsert(old.select(*[c for c in rows.columns if c != seq]), rows, key, seq), "delta")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(path)
        discard(fresh)

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}__state").trigger(availableNow=True).start().awaitTermination()
