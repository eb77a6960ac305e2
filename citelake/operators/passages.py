"""Which texts hold which passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.functions.text import let

_WORDS = 6
_CHARACTERS = 3


def _word_pieces(text: Column, width: int) -> Column:
    def hashes(w):
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    return let(F.split(text, " "), hashes)


def _character_pieces(text: Column, width: int) -> Column:
    def hashes(t):
        at = F.sequence(F.lit(1), F.greatest(F.length(t) - width + 1, F.lit(1)))
        return F.transform(at, lambda i: F.xxhash64(F.substring(t, i, F.lit(width))))

    return let(text, hashes)


def holders(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct ``(item_id, doc_id)`` where the document's text holds the item's.

    Of an item of three words or more, all but the first and last are whole words of any text
    that holds it: the second to seventh are its probe. The probe of a shorter item is its
    first three characters. A document is cut into pieces of the probes' widths alone, which
    move as hashes; texts are fetched for what met, and compared in full. Null texts hold
    nothing, and a null item is held by nothing; the empty item is held by every text.
    """
    items = items.where(F.col("item").isNotNull())
    inner = F.least(F.size(F.split("item", " ")) - 2, F.lit(_WORDS))
    wide = F.least(F.length("item"), F.lit(_CHARACTERS))
    probes = items.select("item_id", "item", F.when(inner > 0, inner).otherwise(-wide).alias("width"))
    met = None
    # at most nine widths
    for (width,) in probes.select("width").distinct().collect():
        if width > 0:
            key, each = F.get(_word_pieces(F.col("item"), width), F.lit(1)), _word_pieces(F.col("text"), width)
        else:
            key, each = F.get(_character_pieces(F.col("item"), -width), F.lit(0)), _character_pieces(F.col("text"), -width)
        own = probes.where(F.col("width") == width).select("item_id", key.alias("h"))
        pieces = docs.where(F.col("text").isNotNull()).select("doc_id", F.explode(F.array_distinct(each)).alias("h"))
        part = pieces.join(own, "h").select("doc_id", "item_id")
        met = part if met is None else met.union(part)
    if met is None:
        return docs.join(items, F.lit(False)).select("item_id", "doc_id")
    full = met.distinct().join(items, "item_id").join(docs, "doc_id").where(F.contains("text", F.col("item")))
    return full.select("item_id", "doc_id").distinct()
