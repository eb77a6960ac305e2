"""Matching references to corpora: key cascades, blocked fuzzy joins, merges.

No join here is a product: candidates meet on an equality (a title key, an identifier, a
blocking prefix, a surname) and are then scored; the best is picked by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelake.functions.scoring import year_gap_score
from citelake.functions.text import fold_diacritics, title_key_spaced


def key_cascade(refs: DataFrame, ref_id: str, corpus: DataFrame, corpus_id: str, ref_keys: list[Column], corpus_keys: list[Column]) -> DataFrame:
    """Per reference the corpus row that its first matching key strategy finds, smallest id
    first: ``(ref_id, corpus_id, strategy)``. Null and '' keys match nothing.

    All strategies are one equi-join on (strategy, key), not a join for each. Of the corpus
    rows of one key only the smallest can win: a reference meets one row for each strategy,
    however many share its keys.
    """

    def keyed(rows, own, keys):
        each = F.array(*[F.struct(F.lit(k).alias("strategy"), c.alias("key")) for k, c in enumerate(keys)])
        return rows.select(F.col(own), F.explode(each).alias("k")).select(own, "k.strategy", "k.key").where("key <> ''")

    first = keyed(corpus, corpus_id, corpus_keys).groupBy("strategy", "key").agg(F.min(corpus_id).alias(corpus_id))
    hits = keyed(refs, ref_id, ref_keys).join(first, ["strategy", "key"])
    best = hits.groupBy(ref_id).agg(F.min(F.struct("strategy", corpus_id)).alias("b"))
    return best.select(ref_id, F.col(f"b.{corpus_id}").alias(corpus_id), F.col("b.strategy").alias("strategy"))


def best_match(pairs: DataFrame, ref_id: str, score: Column, title: str, threshold: float = 0.8) -> DataFrame:
    """The candidate of the highest score at the threshold or over; ties by title."""
    w = Window.partitionBy(ref_id).orderBy(F.desc("score"), title)
    scored = pairs.withColumn("score", score).where(F.col("score") >= threshold)
    return scored.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def blocked_pairs(rows: DataFrame, own: str, block: Column, columns: list[str]) -> DataFrame:
    """Pairs ``a.own < b.own`` inside a block, for blocks that the key keeps small."""
    keyed = rows.withColumn("_block", block).where("_block is not null and _block <> ''")
    a = keyed.select("_block", *[F.col(c).alias(f"{c}_a") for c in [own, *columns]])
    b = keyed.select("_block", *[F.col(c).alias(f"{c}_b") for c in [own, *columns]])
    return a.join(b, "_block").where(F.col(f"{own}_a") < F.col(f"{own}_b")).drop("_block")


def differences(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs with the names of the columns in which both have values that differ."""
    diffs = F.array_compact(F.array(*[F.when(F.col(f"{c}_a") != F.col(f"{c}_b"), F.lit(c)) for c in columns]))
    return pairs.withColumn("differs", diffs).where(F.size("differs") > 0)


def cited_against_truth(cited: DataFrame, truth: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per matched row the fields that differ (letters folded) and that the citation lacks."""

    def fold(c):
        return title_key_spaced(fold_diacritics(c.cast("string")))

    t = truth.select(key, *[F.col(c).alias(f"true_{c}") for c in columns])
    joined = cited.join(t, key)
    wrong = F.array_compact(
        F.array(*[F.when(fold(F.col(c)) != fold(F.col(f"true_{c}")), F.lit(c)) for c in columns])
    )
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"true_{c}").isNotNull(), F.lit(c)) for c in columns]))
    return joined.select(key, wrong.alias("wrong"), missing.alias("missing"))


def year_scored(pairs: DataFrame, cited: Column, found: Column, base: Column) -> DataFrame:
    return pairs.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + year_gap_score(cited, found))))


def merge_candidates(candidates: DataFrame, key: Column, source: str, shared: str, fields: list[str], seq: str) -> DataFrame:
    """Candidates of several sources as one row a key: summed shares, the set of sources and
    the first value of each field by ``seq`` that isn't null."""
    firsts = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    return candidates.groupBy(key.alias("key")).agg(
        F.sum(shared).alias("shared"), F.array_sort(F.collect_set(source)).alias("sources"), *firsts
    )


def unique_matches(pairs: DataFrame, work: str) -> DataFrame:
    """Rows of works that matched once; ambiguous works abstain."""
    counts = pairs.groupBy(work).agg(F.count("*").alias("_n")).where("_n = 1")
    return pairs.join(counts.select(work), work, "left_semi")


def source_priority(candidates: DataFrame, ref_id: str, source: str, order: list[str]) -> DataFrame:
    """Per reference the candidate of the source that comes first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(source))
    ranked = candidates.where(rank > 0).withColumn("_rank", rank)
    w = Window.partitionBy(ref_id).orderBy("_rank")
    return ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_rank")


def best_within_years(refs: DataFrame, works: DataFrame, ref: str, work: str, block: str, year: str, base: float = 0.8, widest: int = 3) -> DataFrame:
    """``(ref, work, score)``: each reference's best work of its block, other than the one of
    its own number, at most ``widest`` years apart: ``base`` and the year-gap score, ties to the
    smaller work. Of each block and year the two smallest works can win, so a reference meets
    those of ``2 * widest + 1`` years and not its whole block."""
    order = Window.partitionBy(block, year).orderBy(work)
    first = works.select(block, year, work).distinct().withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    two = first.groupBy(block, year).agg(F.min(work).alias("_a"), F.max(work).alias("_b"))
    gaps = F.explode(F.sequence(F.lit(-widest), F.lit(widest))).alias("_gap")
    asks = refs.select(ref, block, F.col(year).alias("_year"), gaps).withColumn(year, F.col("_year") + F.col("_gap"))
    other = F.when(F.col("_a") != F.col(ref), F.col("_a")).when(F.col("_b") != F.col(ref), F.col("_b"))
    score = F.lit(base) + year_gap_score(F.col("_year"), F.col(year))
    # merged: both sides look small enough to broadcast by their file, and may be more than a driver holds
    met = asks.join(two.hint("merge"), [block, year]).select(ref, other.alias(work), score.alias("score")).where(F.col(work).isNotNull() & (F.col("score") >= base))
    best = met.groupBy(ref).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(work).alias("w"))).alias("b"))
    return best.select(ref, F.col("b.w").alias(work), (-F.col("b.s")).alias("score"))
