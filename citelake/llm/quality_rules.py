"""Quality rules: per-text counts and cross-document line frequency.

A document fails the base rules when it is short or mostly repeats itself. Lines of all
documents are normalised (trimmed, white space runs as one blank, lower case, digits as 0)
and hashed with their host, and the distinct documents that hold a line are counted. A line
is above the limit when more than ``min_docs`` documents of the host hold it, however many
the host has. Exact copies are documents too; with ``by_text`` documents of equal text count
once. Lines above the limit are removed, and a document is rejected as depleted when fewer
than ``min_left`` of its words are left. With ``keep_first`` a line stays in the first of its
documents (the smallest id of the host), so one copy of whatever is repeated survives.

All of it is DataFrame expressions. Lines move as hashes and counts; ``keep_good`` moves the
documents once, by id and text hash, to where their removed lines are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import discard, join_back, let, materialize

BLANKS = " \t\n\x0b\f\r"
SPLIT = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT))


def repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: windows are hashed, sorted,
    and the positions of equal neighbours merged."""

    def windows(w):
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )

    def positions(g):
        at = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            at,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda e, k: F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False))
                        | F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False)),
                    ),
                    lambda e: e["i"],
                )
            ),
        )

    def covered(p):
        steps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def count(g):
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(positions(g), covered))

    return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(windows(ws), count)).cast("long")


def _let_stats(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def stats(ws):
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(ws).alias("n_repeat_words"),
        )

    return let(words(text), stats)


def normal_line(line: Column) -> Column:
    one = F.regexp_replace(F.btrim(line, F.lit(BLANKS)), SPLIT, " ")
    return F.regexp_replace(F.lower(one), "[0-9]", "0")


def _lines(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """``(_id, _text, at, line, n)``: a document's lines by place, hashed with the host, and
    their words."""
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"),
        F.xxhash64(text_col).alias("_text"),
        F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "raw"),
    ).where(F.btrim("raw", F.lit(BLANKS)) != "")
    normal = let(
        normal_line(F.col("raw")),
        lambda x: F.struct(F.xxhash64("_host", x).alias("line"), F.size(F.split(x, " ")).alias("n")),
    )
    return rows.select("_id", "_text", "at", normal.alias("_l")).select("_id", "_text", "at", "_l.*")


def frequent_lines(lines: DataFrame, min_docs: int = 20, by_text: bool = False) -> DataFrame:
    """``(line, first)``: lines above the limit and the smallest id that has them. Rows of
    one id and text are one document; ``by_text`` counts distinct texts in place of those."""
    document = ["_text"] if by_text else ["_id", "_text"]
    held = lines.withColumn("first", F.col("_id")).groupBy("line", *document).agg(F.min("first").alias("first"))
    counts = held.groupBy("line").agg(F.count("*").alias("n_docs"), F.min("first").alias("first"))
    return counts.where(F.col("n_docs") > min_docs).select("line", "first")


def _judged(docs: DataFrame, columns: list[str], id_col, text_col, host_col, min_docs, min_left, min_words, keep_first, by_text) -> DataFrame:
    """``columns`` with the counts, verdicts and the places of the lines to remove."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.struct(*columns).alias("_row"), F.col(id_col).alias("_doc"), F.xxhash64(text_col).alias("_hash"), _let_stats(text).alias("_s")
    )
    lines = materialize(_lines(docs, id_col, text_col, host_col), "lines")  # hashes; read twice
    # a line that a third of all documents have is dealt over many tasks
    found = join_back(lines, frequent_lines(lines, min_docs, by_text), "line")
    if keep_first:
        found = found.where(~F.col("_id").eqNullSafe(F.col("first")))
    gone = (
        found.select("_id", "_text", "at", "n")
        .distinct()
        .groupBy("_id", "_text")
        .agg(F.sum("n").alias("_n"), F.collect_list("at").alias("_at"))
    )
    gone = materialize(gone, "gone")
    discard(lines)
    n, repeats = F.col("_s.n_words"), F.col("_s.n_repeat_words")
    failed = (n < min_words) | (100 * repeats > 50 * n)
    left = n - F.coalesce("_n", F.lit(0))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    return base.join(gone, same, "left").select(
        "_row",
        "_s",
        "_at",
        failed.alias("_failed"),
        F.coalesce("_n", F.lit(0)).cast("long").alias("_gone"),
        (~failed & (F.col("_n").isNull() | (left >= n * min_left))).alias("_kept"),
    )


def verdicts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 20,
    min_left: float = 0.2,
    min_words: int = 50,
    keep_first: bool = False,
    by_text: bool = False,
) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``kept``, ``n_removed_words``.

    A null text has no words and fails the base rules; a null host is the host ''. Rows are
    told apart by (id, text): exactly repeated rows share one verdict, as do rows of a null
    id and equal text. Other columns are not read. Empty tables give empty ones.
    """
    judged = _judged(docs, [id_col], id_col, text_col, host_col, min_docs, min_left, min_words, keep_first, by_text)
    return judged.select(
        F.col("_row")[id_col].alias(id_col),
        "_s.*",
        F.col("_failed").alias("base_failed"),
        F.col("_kept").alias("kept"),
        F.col("_gone").alias("n_removed_words"),
    )


def keep_good(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = 20,
    min_left: float = 0.2,
    min_words: int = 50,
    keep_first: bool = False,
    by_text: bool = False,
) -> DataFrame:
    """The documents that are kept, all columns, their texts without the removed lines."""
    judged = _judged(docs, docs.columns, id_col, text_col, host_col, min_docs, min_left, min_words, keep_first, by_text)
    kept = judged.where("_kept").select("_row.*", F.col("_at").alias("_gone_at"))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains("_gone_at", i))
    text = F.when(F.col("_gone_at").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return kept.withColumn(text_col, text).drop("_gone_at")
