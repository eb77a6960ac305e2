"""Reference lists out of running text.

Splitters are column expressions. BibTeX nests braces, which no regular expression counts:
it is read by a small Python table function over Arrow batches, a file's text at a time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HEADING = r"(?im)^\s*(?:[0-9]+\.?\s*)?(?:references|bibliography|works cited|literature cited)\s*:?\s*$"
_AFTER = r"(?im)^\s*(?:appendix|appendices|supplementary material|acknowledge?ments?)\b.*$"


def bibliography_section(text: Column) -> Column:
    """What follows the last heading of a reference list, up to an appendix; null without."""
    parts = F.split(text, _HEADING, -1)
    last = F.get(parts, F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.trim(F.get(F.split(last, _AFTER, 2), F.lit(0))))


def _after_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def numbered_entries(section: Column) -> Column:
    """Entries after ``[n]`` heads at line starts: at least three heads, the smallest 1 or 2."""
    heads = F.transform(F.regexp_extract_all(section, F.lit(r"(?m)^\s*\[([0-9]+)\]"), F.lit(1)), lambda h: h.try_cast("int"))
    bodies = F.slice(F.split(section, r"(?m)^\s*\[[0-9]+\]", -1), F.lit(2), F.greatest(F.size(heads), F.lit(0)))
    rows = F.transform(F.arrays_zip(heads.alias("n"), bodies.alias("t")), lambda z: F.struct(z["n"].alias("n"), F.trim(F.regexp_replace(z["t"], r"\s+", " ")).alias("entry")))
    none = F.expr("cast(array() as array<struct<n:int,entry:string>>)")
    return F.when((F.size(heads) >= 3) & (F.array_min(heads) <= 2), rows).otherwise(none)


def vancouver_entries(section: Column) -> Column:
    """Entries after ``n.`` heads: two or more, three fifths with a year; short ones go and
    labels are made dense."""
    bodies = _after_first(F.split(section, r"(?m)^\s*[0-9]{1,3}\.\s+", -1))
    entries = F.filter(F.transform(bodies, lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: F.length(t) >= 30)
    dated = F.size(F.filter(entries, lambda t: t.rlike(r"\b(?:19|20)[0-9]{2}\b")))
    rows = F.transform(entries, lambda t, i: F.struct((i + 1).alias("n"), t.alias("entry")))
    none = F.expr("cast(array() as array<struct<n:int,entry:string>>)")
    return F.when((F.size(entries) >= 2) & (dated >= 0.6 * F.size(entries)), rows).otherwise(none)


def bibitems(tex: Column) -> Column:
    """``(key, body)`` of each ``\\bibitem``; an optional label in brackets is skipped."""
    head = r"\\bibitem(?:\[[^\]]*\])?\{([^}]*)\}"
    inside = F.regexp_replace(tex, r"(?s)\\end\{thebibliography\}.*", "")
    keys = F.regexp_extract_all(inside, F.lit(head), F.lit(1))
    bodies = _after_first(F.split(inside, head, -1))
    return F.transform(
        F.arrays_zip(keys.alias("key"), bodies.alias("body")),
        lambda z: F.struct(z["key"].alias("key"), F.trim(F.regexp_replace(z["body"], r"\s+", " ")).alias("body")),
    )


def cited_keys(tex: Column) -> Column:
    """Distinct keys of all ``\\cite``-like commands, sorted."""
    lists = F.regexp_extract_all(tex, F.lit(r"\\(?:no)?[cC]ite[a-zA-Z]*\*?(?:\[[^\]]*\]){0,2}\{([^}]*)\}"), F.lit(1))
    keys = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda k: F.trim(k))))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != "")))


def text_format(text: Column) -> Column:
    return (
        F.when(text.rlike(r"@[a-zA-Z]+\s*\{\s*[^,\s]+\s*,"), "bibtex")
        .when(F.contains(text, F.lit("\\bibitem[")) & text.rlike(r"\\bibitem\[[^\]]*\([0-9]{4}"), "natbib")
        .when(F.contains(text, F.lit("\\bibitem")), "latex")
        .when(text.rlike(r"(?m)^\s*\[1\]"), "numbered")
        .otherwise("plain")
    )


def parse_bibtex(text: str) -> list[dict]:
    """Entries with balanced braces: ``kind, key, fields``."""
    out = []
    for start in re.finditer(r"@([a-zA-Z]+)\s*\{", text):
        depth, at = 1, start.end()
        while at < len(text) and depth:
            depth += (text[at] == "{") - (text[at] == "}")
            at += 1
        kind = start[1].lower()
        if depth or kind in ("comment", "string", "preamble"):
            continue
        key, _, body = text[start.end() : at - 1].partition(",")
        out.append({"kind": kind, "key": key.strip(), "fields": _fields(body)})
    return out


def _fields(body: str) -> dict[str, str]:
    fields, at = {}, 0
    name = re.compile(r"\s*,?\s*([a-zA-Z_-]+)\s*=\s*")
    while m := name.match(body, at):
        at, depth, begun = m.end(), 0, m.end()
        quoted = body[at : at + 1] == '"'
        at += quoted
        while at < len(body):
            c = body[at]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            elif depth == 0 and (c == '"' if quoted else c == ","):
                break
            at += 1
        value = body[begun + quoted : at].strip()
        at += quoted
        if value.startswith("{") and value.endswith("}"):
            value = value[1:-1]
        fields[m[1].lower()] = re.sub(r"\s+", " ", value).strip()
    return fields


def bibtex_references(files: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """References of BibTeX texts: one row an entry, in order."""
    schema = f"{id_col} {files.schema[id_col].dataType.simpleString()}, n int, kind string, key string, fields map<string,string>"

    def run(batches):
        for batch in batches:
            rows, n, kinds, keys, fields = [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for k, entry in enumerate(parse_bibtex(text or "")):
                    rows.append(row)
                    n.append(k)
                    kinds.append(entry["kind"])
                    keys.append(entry["key"])
                    fields.append(list(entry["fields"].items()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(n, pa.int32()),
                    pa.array(kinds, pa.string()),
                    pa.array(keys, pa.string()),
                    pa.array(fields, pa.map_(pa.string(), pa.string())),
                ],
                names=[id_col, "n", "kind", "key", "fields"],
            )

    return files.select(id_col, text_col).mapInArrow(run, schema)


def reference_columns(parsed: DataFrame) -> DataFrame:
    """BibTeX fields as a reference: title, authors, year, venue, url, doi."""
    from citelake.functions.text import normalize_doi

    f = F.col("fields")
    authors = F.filter(F.transform(F.split(f["author"], r"\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "")
    return parsed.select(
        *[c for c in parsed.columns if c not in ("fields", "kind")],
        F.regexp_replace(f["title"], "[{}]", "").alias("title"),
        F.coalesce(authors, F.array().cast("array<string>")).alias("authors"),
        f["year"].try_cast("int").alias("year"),
        F.coalesce(f["journal"], f["booktitle"], f["publisher"]).alias("venue"),
        f["url"].alias("url"),
        normalize_doi(f["doi"]).alias("doi"),
        F.col("kind").alias("type"),
    )


def quality_gate(refs: DataFrame, group: str, share: float = 0.7) -> DataFrame:
    """Groups of references of which enough have a title and a year in range."""
    valid = (F.length(F.trim("title")) >= 3) & (F.col("year").isNull() | F.col("year").between(1900, 2030))
    rates = refs.groupBy(group).agg(F.avg(F.when(valid, 1.0).otherwise(0.0)).alias("_r"))
    return refs.join(rates.where(F.col("_r") >= share).select(group), group, "left_semi")
