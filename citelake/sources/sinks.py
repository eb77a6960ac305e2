"""Writers: reports, reference exports, manifests, staged swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bibtex_entry(key: Column, kind: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column) -> Column:
    def field(name, value):
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"  {name} = {{"), value, F.lit("}")))

    body = F.array_compact(
        F.array(
            field("title", title),
            field("author", F.array_join(authors, " and ")),
            field("year", year.cast("string")),
            field("journal", venue),
            field("doi", doi),
        )
    )
    return F.concat(F.lit("@"), F.coalesce(kind, F.lit("misc")), F.lit("{"), key, F.lit(",\n"), F.array_join(body, ",\n"), F.lit("\n}"))


def ris_entry(title: Column, authors: Column, year: Column, venue: Column, doi: Column) -> Column:
    def line(tag, value):
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{tag}  - "), value))

    names = F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a))
    head = F.array(F.lit("TY  - JOUR"), line("TI", title))
    tail = F.array(line("PY", year.cast("string")), line("JO", venue), line("DO", doi), F.lit("ER  - "))
    return F.array_join(F.array_compact(F.concat(head, names, tail)), "\n")


def plain_entry(title: Column, authors: Column, year: Column, venue: Column) -> Column:
    return F.concat_ws(". ", F.nullif(F.array_join(authors, ", "), F.lit("")), F.concat(title, F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit(""))), venue)


def markdown_entry(title: Column, authors: Column, year: Column, url: Column) -> Column:
    linked = F.when(url.isNotNull(), F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")"))).otherwise(title)
    return F.concat(F.lit("- "), F.concat_ws(", ", linked, F.nullif(F.array_join(authors, ", "), F.lit("")), year.cast("string")))


def write_report(records: DataFrame, path: str, kind: str) -> None:
    """csv, json lines or text; nested columns go as JSON into csv and text."""
    if kind == "json":
        records.write.mode("overwrite").json(path)
        return
    flat = records.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in records.dtypes])
    if kind == "csv":
        flat.write.mode("overwrite").option("header", True).csv(path)
    elif kind == "text":
        lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in flat.columns]
        flat.select(F.concat_ws("\n", *lines, F.lit("")).alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown report kind {kind!r}")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def swap_in(df: DataFrame, path: str, keep: int = 2) -> None:
    """Write a new version of the table below ``path`` and let it be the current one.

    A version is complete once Spark has put its ``_SUCCESS`` file beside the data, and
    ``current`` reads the latest complete one: at each moment readers find the old table or
    the new one, also after a crash. The last ``keep`` versions stay for readers under way.
    """
    spark = df.sparkSession
    found = _versions(spark, path)
    number = max((n for n, _ in found), default=0) + 1
    df.write.parquet(f"{path}/v{number:012d}")
    done = [n for n, complete in found if complete]
    for n, complete in found:
        if not complete or n in done[: len(done) - keep + 1]:
            at, files = _files(spark, f"{path}/v{n:012d}")
            files.delete(at, True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    """Versions, oldest first, and whether they are complete."""
    at, files = _files(spark, f"{path}/v*")
    paths = [x.getPath() for x in files.globStatus(at) or []]
    success = spark._jvm.org.apache.hadoop.fs.Path
    return sorted((int(p.getName()[1:]), files.exists(success(p, "_SUCCESS"))) for p in paths)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``swap_in`` wrote last."""
    number = max(n for n, complete in _versions(spark, path) if complete)
    return spark.read.parquet(f"{path}/v{number:012d}")


def unprocessed(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (path, size, modification time) the manifest lacks."""
    return files.join(manifest.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def cacheable(results: DataFrame, status: str, details: str) -> DataFrame:
    """Results worth keeping: final, and not for a time-out."""
    open_states = ("error", "cancelled", "timeout", "checking", "pending")
    late = F.coalesce(F.contains(F.lower(details), F.lit("timed out")), F.lit(False))
    return results.where(~F.col(status).isin(*open_states) & ~late)
