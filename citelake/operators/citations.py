"""Audits of in-text citations against a reference list.

Texts become marker rows (document, order, number) once; every check is an aggregation or a
window over a document's markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.text import expand_marker

MARKER = r"\[[0-9]+(?:\s*[,;–—-]\s*[0-9]+)*\]"


def markers(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """``(doc, at, number)``: numbers of bracketed markers in order of appearance."""
    found = docs.select(doc, F.posexplode(F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))).alias("at", "marker"))
    each = found.select(doc, "at", F.posexplode(expand_marker(F.col("marker"))).alias("k", "number"))
    return each.select(doc, (F.col("at") * 1000 + F.col("k")).alias("at"), "number")


def audit(marks: DataFrame, references: DataFrame, doc: str, number: str, most_undefined: float = 0.3, least: int = 3) -> DataFrame:
    """Per document: numbers cited but not listed, listed twice, missing in the list's run,
    listed but never cited (only when half of the list is cited), and first mentions out of
    order. Documents of too few markers, or too many undefined ones, abstain.
    """
    listed = references.groupBy(doc, F.col(number).alias("number")).agg(F.count("*").alias("times"))
    cited = marks.groupBy(doc, "number").agg(F.min("at").alias("first"), F.count("*").alias("mentions"))
    both = cited.join(listed, [doc, "number"], "full")
    order = Window.partitionBy(doc).orderBy("first", "number").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("first").isNotNull() & (F.col("number") < F.max(F.when(F.col("first").isNotNull(), F.col("number"))).over(order))
    rows = both.withColumn("late", F.coalesce(late, F.lit(False)))

    def numbers(condition):
        return F.array_sort(F.collect_set(F.when(condition, F.col("number"))))

    is_cited, is_listed = F.col("first").isNotNull(), F.col("times").isNotNull()
    per = rows.groupBy(doc).agg(
        F.count_if(is_cited).alias("n_cited"),
        F.count_if(is_listed).alias("n_listed"),
        F.count_if(is_cited & is_listed).alias("n_both"),
        numbers(is_cited & ~is_listed).alias("undefined"),
        numbers(F.col("times") > 1).alias("duplicate"),
        numbers(is_listed & ~is_cited).alias("uncited"),
        numbers(F.col("late")).alias("out_of_order"),
        F.max(F.when(is_listed, F.col("number"))).alias("top"),
        F.array_sort(F.collect_set(F.when(is_listed, F.col("number")))).alias("listed"),
    )
    run = F.when(F.col("top") > 0, F.sequence(F.lit(1), F.col("top"))).otherwise(F.array().cast("array<int>"))
    covered = F.col("n_both") >= 0.5 * F.col("n_listed")
    none = F.array().cast("array<int>")
    abstains = (F.col("n_cited") < least) | (F.size("undefined") > most_undefined * F.col("n_cited"))
    return per.select(
        doc,
        abstains.alias("abstains"),
        "undefined",
        "duplicate",
        F.array_except(run, F.col("listed")).alias("gap"),
        F.when(covered, F.col("uncited")).otherwise(none).alias("uncited"),
        "out_of_order",
    )


def contexts(docs: DataFrame, doc: str, text: Column, width: int = 120) -> DataFrame:
    """``(doc, number, context)``: the text around each marker."""
    gaps = F.split(text, MARKER, -1)
    found = F.regexp_extract_all(text, F.lit(MARKER), F.lit(0))
    rows = docs.select(doc, gaps.alias("g"), F.posexplode(found).alias("at", "marker"))
    before, after = F.get("g", F.col("at")), F.get("g", F.col("at") + 1)
    around = F.concat(F.right(before, F.lit(width)), F.col("marker"), F.left(after, F.lit(width)))
    return rows.select(doc, F.explode(expand_marker(F.col("marker"))).alias("number"), around.alias("context"))


def dense_numbers(marks: DataFrame, doc: str) -> DataFrame:
    """Numbers by order of first mention."""
    first = F.min("at").over(Window.partitionBy(doc, "number"))
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy("_first", "number"))
    # windows within a document: rows dealt by document stay where they are
    known = marks.where(F.col(doc).isNotNull() & F.col("number").isNotNull())
    return known.withColumn("_first", first).withColumn("new_number", rank).drop("_first")
