"""Corpus dumps as one ``papers`` table.

All readers take explicit schemas: nothing is inferred, a malformed record is counted and
left out, and columns that aren't asked for aren't parsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citelake.functions.text import arxiv_id

PAPERS = (
    "paper_id string, title string, venue string, year int, doi string, arxiv_id string, authors array<string>, "
    "source_url string, title_key string"
)
#: OpenAlex work types that are citable texts.
WORK_TYPES = ("article", "book-chapter", "preprint", "review", "dissertation")
#: Publication elements of the DBLP dump.
DBLP_TAGS = ("article", "inproceedings", "proceedings", "book", "incollection", "phdthesis", "mastersthesis")

_S2 = (
    "paperId string, corpusid bigint, title string, venue string, year int, "
    "externalIds struct<DOI: string, ArXiv: string>, authors array<struct<name: string>>, url string, _corrupt string"
)
_OPENALEX = (
    "id string, display_name string, type string, publication_year int, doi string, "
    "authorships array<struct<author: struct<display_name: string>>>, "
    "primary_location struct<source: struct<display_name: string>>, updated_date date"
)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Plain or gzip JSON lines with malformed lines in ``_corrupt``. Gzip files don't split:
    where the path names such files, rows are dealt anew, one task for 32 MB of gzip, so that
    a large file isn't one task's; others are split by the scan."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    if not path.endswith(".gz"):
        return rows
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []
    parts = sum(-(-f.getLen() // (32 << 20)) for f in found)
    return rows.repartition(int(parts)) if parts > len(found) else rows


def usable(rows: DataFrame, most_malformed: int | None = None) -> DataFrame:
    """Rows without malformed ones. With ``most_malformed`` it fails when more are malformed
    and none is usable: a wrong file, not a few bad lines."""
    good = rows.where("_corrupt is null").drop("_corrupt")
    if most_malformed is not None:
        bad = F.col("_corrupt").isNotNull()
        # a query of the corrupt column alone is refused: it needs a parsed one beside it
        parsed = next(c for c in rows.columns if c != "_corrupt")
        seen = rows.agg(F.count_if(bad).alias("bad"), F.count_if(~bad).alias("ok"), F.count(parsed)).first()
        if seen["bad"] > most_malformed and not seen["ok"]:
            raise ValueError(f"{seen['bad']} malformed lines and no usable record")
    return good


def _papers(rows: DataFrame, **columns: Column) -> DataFrame:
    from citelake.functions.text import title_key_compact

    out = rows.select(*[c.alias(n) for n, c in columns.items()])
    return out.withColumn("title_key", title_key_compact(F.col("title")))


def semantic_scholar(spark: SparkSession, path: str) -> DataFrame:
    rows = usable(read_json_lines(spark, path, _S2))
    own = F.coalesce("paperId", F.col("corpusid").cast("string"))
    return _papers(
        rows.where(own.isNotNull()),
        paper_id=own,
        title=F.col("title"),
        venue=F.col("venue"),
        year=F.col("year"),
        doi=F.col("externalIds.DOI"),
        arxiv_id=F.col("externalIds.ArXiv"),
        authors=F.transform(F.coalesce("authors", F.array()), lambda a: a["name"]),
        source_url=F.col("url"),
    )


def openalex(spark: SparkSession, path: str, min_year: int | None = None, since: str | None = None) -> DataFrame:
    """Citable works with a title. ``since`` keeps partitions of a later ``updated_date``,
    a partition filter; a failed partition isn't passed over, since the read fails whole."""
    rows = spark.read.schema(_OPENALEX).option("mode", "DROPMALFORMED").json(path)
    if since is not None:
        rows = rows.where(F.col("updated_date") > F.lit(since).cast("date"))
    rows = rows.where(F.col("type").isin(*WORK_TYPES) & (F.trim("display_name") != ""))
    if min_year is not None:
        rows = rows.where(F.col("publication_year") >= min_year)
    names = F.transform(F.coalesce("authorships", F.array()), lambda a: a["author"]["display_name"])
    return _papers(
        rows,
        paper_id=F.regexp_replace("id", "^.*/W|^W", ""),
        title=F.col("display_name"),
        venue=F.col("primary_location.source.display_name"),
        year=F.col("publication_year"),
        doi=F.regexp_replace("doi", "^https?://doi.org/", ""),
        arxiv_id=F.lit(None).cast("string"),
        authors=F.filter(names, lambda n: n.isNotNull()),
        source_url=F.col("id"),
    )


def dblp(spark: SparkSession, path: str) -> DataFrame:
    """The seven publication elements; authors, else editors; the first venue field."""
    schema = (
        "_key string, author array<string>, editor array<string>, title string, journal string, booktitle string, "
        "school array<string>, publisher array<string>, year int, ee array<string>"
    )
    out = None
    for tag in DBLP_TAGS:
        rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        doi = F.filter("ee", lambda u: F.contains(u, F.lit("doi.org/")))
        arxiv = F.filter("ee", lambda u: F.contains(u, F.lit("arxiv.org/")))
        part = _papers(
            rows.where("_key is not null"),
            paper_id=F.col("_key"),
            title=F.regexp_replace("title", r"\.$", ""),
            venue=F.coalesce("journal", "booktitle", F.get("school", F.lit(0)), F.get("publisher", F.lit(0))),
            year=F.col("year"),
            doi=F.regexp_extract(F.get(doi, F.lit(0)), r"doi\.org/(.+)$", 1),
            arxiv_id=arxiv_id(F.get(arxiv, F.lit(0))),
            authors=F.coalesce("author", "editor", F.array().cast("array<string>")),
            source_url=F.concat(F.lit("https://dblp.org/rec/"), F.col("_key")),
        )
        out = part if out is None else out.unionByName(part)
    return out


def acl(spark: SparkSession, path: str) -> DataFrame:
    """Volumes with papers that inherit the volume's title and year; paper 0 is front matter."""
    schema = (
        "_id string, meta struct<booktitle: string, year: int>, "
        "paper array<struct<_id: int, title: string, author: array<struct<first: string, last: string>>, doi: string, url: string>>"
    )
    volumes = spark.read.format("xml").option("rowTag", "volume").schema(schema).load(path)
    rows = volumes.select("_id", "meta", F.explode("paper").alias("p")).where("p._id > 0")
    return _papers(
        rows,
        paper_id=F.concat_ws(".", "_id", F.col("p._id").cast("string")),
        title=F.col("p.title"),
        venue=F.col("meta.booktitle"),
        year=F.col("meta.year"),
        doi=F.col("p.doi"),
        arxiv_id=F.lit(None).cast("string"),
        authors=F.transform(F.coalesce("p.author", F.array()), lambda a: F.concat_ws(" ", a["first"], a["last"])),
        source_url=F.col("p.url"),
    )


def crossref_from(papers: DataFrame) -> DataFrame:
    """Rows with DOI and title under DOI identities."""
    doi = F.lower(F.trim("doi"))
    rows = papers.where((doi != "") & (F.trim("title") != ""))
    return rows.withColumns(
        {
            "paper_id": F.concat(F.lit("crossref:"), doi),
            "source_url": F.coalesce(F.nullif("source_url", F.lit("")), F.concat(F.lit("https://doi.org/"), doi)),
        }
    )


def usage_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def paper_list(spark: SparkSession, path: str) -> DataFrame:
    """One specification a line; blank lines and comments are left out."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("spec")).where("spec <> '' and not startswith(spec, '#')")


def checkpoint(spark: SparkSession, path: str, schema: str, specs: DataFrame) -> DataFrame:
    """Finished records whose (index, spec) is still asked for; a later line wins."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    kept = rows.select("*", at.alias("_at")).join(specs.select("index", "spec"), ["index", "spec"])
    columns = [c for c in kept.columns if c != "_at"]
    return kept.groupBy("index").agg(F.max_by(F.struct(*columns), "_at").alias("r")).select("r.*")


def cached_responses(lookups: DataFrame, cache: DataFrame, service: str, method: str, query: str) -> DataFrame:
    """Lookups with their cached response; null where there is none yet."""
    key = F.sha2(F.concat_ws("\x00", F.col(service), F.col(method), F.col(query)), 256)
    return lookups.withColumn("cache_key", key).join(cache.select("cache_key", "response"), "cache_key", "left")
