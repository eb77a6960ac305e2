"""Column functions: timestamps, JSON and the maps and arrays of records."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: results of older logic than this are checked again.
LOGIC_VERSION = 4
#: Identifier kinds that a record's columns are named after.
ID_KINDS = ("ArXiv", "DOI", "MAG", "ACL", "PubMed", "DBLP", "CorpusId")


def timestamp_of(text: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` with or without fraction, a T and a closing Z; else null."""
    clean = F.regexp_replace(F.replace(F.trim(text), F.lit("T"), F.lit(" ")), "Z$", "")
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?$"
    return F.when(clean.rlike(shape), clean.try_cast("timestamp_ntz"))


def json_or(text: Column, schema: str, default: Column) -> Column:
    """Parsed JSON; ``default`` where the text is null, empty or no JSON of that schema."""
    wrapped = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), f"v {schema}", {"mode": "PERMISSIVE"})
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", default).otherwise(F.coalesce(wrapped["v"], default))


def flat_ids(ids: Column) -> list[Column]:
    """One ``externalIds_X`` column per identifier kind from a map of them."""
    return [F.try_element_at(ids, F.lit(k)).alias(f"externalIds_{k}") for k in ID_KINDS]


def ids_map(kinds: tuple[str, ...] = ID_KINDS) -> Column:
    """The map back from the columns; empty ones are left out."""
    pairs = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(f"externalIds_{k}"))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def without_nulls(value: Column, kind: T.DataType | str) -> Column:
    """A value of type ``kind`` without null entries of maps and null elements of arrays, at
    every depth; a struct keeps its fields, with what they hold cleaned."""
    kind = T.DataType.fromDDL(kind) if isinstance(kind, str) else kind
    if isinstance(kind, T.MapType):
        kept = F.map_filter(value, lambda _, v: v.isNotNull())
        return F.transform_values(kept, lambda _, v: without_nulls(v, kind.valueType))
    if isinstance(kind, T.ArrayType):
        return F.transform(F.array_compact(value), lambda v: without_nulls(v, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[without_nulls(value[f.name], f.dataType).alias(f.name) for f in kind])
        return F.when(value.isNotNull(), fields)
    return value


def current(version: Column, least: int = LOGIC_VERSION) -> Column:
    """Whether a cached result is of the current logic; a null version is not."""
    return F.coalesce(version >= least, F.lit(False))


def keyed_hash(value: Column, secret: bytes) -> Column:
    """HMAC-SHA-256 of a trimmed text, its first 32 hex digits; null for null or blank.

    The two padded keys are constants, so two built-in digests make it, with no Python.
    """
    import hashlib

    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    text = F.encode(F.trim(value), "UTF-8")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)
    return F.when(F.trim(value) != "", F.left(digest, F.lit(32)))


def richest(*counts: Column) -> Column:
    """The largest of the counts that sources give, null where none gives one."""
    return F.greatest(*[c.try_cast("bigint") for c in counts]) if len(counts) > 1 else counts[0].try_cast("bigint")


def best_concepts(concepts: Column, least: float = 0.3, most: int = 3) -> Column:
    """Names of an array of ``struct<name, score>``, the best first, from a score on."""
    fit = F.filter(concepts, lambda c: c["score"] >= least)
    ranked = F.array_sort(F.transform(fit, lambda c: F.struct((-c["score"]).alias("s"), c["name"].alias("name"))))
    return F.slice(F.transform(ranked, lambda c: c["name"]), 1, most)


def _compositions() -> dict[str, str]:
    """A letter and its mark, as two code points and as one, of the Latin blocks."""
    codes = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    return {d: chr(c) for c in codes if len(d := unicodedata.normalize("NFD", chr(c))) == 2 and unicodedata.combining(d[1])}


_COMPOSED = _compositions()


def _each_replaced(text: Column, pattern: str, by) -> Column:
    """Every distinct match of ``pattern`` replaced by ``by(match)``, where that isn't null."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.aggregate(found, text, lambda t, m: F.replace(t, m, F.coalesce(by(m), m)))


def clean_unicode(text: Column) -> Column:
    """Composed form of Latin letters with one mark, runs of UTF-8 that were read as Latin-1 set
    right, beside whatever else the text holds, without control characters other than tab and
    line ends."""
    # lead bytes and their continuation bytes, each as one Latin-1 character
    broken = r"(?:[Â-ß][\u0080-¿]|[à-ï][\u0080-¿]{2})+"
    fixed = _each_replaced(text, broken, lambda m: F.try_validate_utf8(F.encode(m, "ISO-8859-1").cast("string")))
    table = F.create_map(*[F.lit(x) for pair in _COMPOSED.items() for x in pair])
    composed = _each_replaced(fixed, r"\p{L}[\u0300-\u036f]", lambda m: F.try_element_at(table, m))
    out = F.when(fixed.rlike(r"[\u0300-\u036f]"), composed).otherwise(fixed)
    return F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
