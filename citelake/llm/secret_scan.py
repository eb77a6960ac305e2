"""Secret scans through a trigram inverted index.

Every rule is a regular expression. ``trigram_query`` derives from its syntax tree which
lower-cased trigrams a match must hold, as an AND of clauses, each an OR of alternatives,
each an AND of trigrams. The index has a posting (trigram, document) for the trigrams that
some rule asks for; a join with the queries and three small aggregations intersect the
postings into the rules a document may match, and only those rules' regexes run on its
text. Rules without mandatory trigrams (a run of hex digits) scan every text.

All of it is DataFrame expressions. A span's kind is its rule's name; offsets are code
points, end exclusive.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citelake.llm.common import let, prefix_sums


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the same spans as [0-9a-f]+ of 32 or more
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{20,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    # a scheme's length is bounded, so that a long word is passed over in linear time
    Rule("login", r"\b[a-z][a-z0-9+]{0,30}://[^\s:@/]+:[^\s:@/]+@"),
)
RULES = BASE_RULES + MORE_RULES

_MOST_STRINGS = 24
_MOST_GRAMS = 60  # of an alternative; fewer ask for less, never for too much


def trigram_query(pattern: str) -> list[list[tuple[str, ...]]]:
    """Clauses (all hold) of alternatives (one holds) of trigrams (all there); [] if none
    is mandatory."""
    clauses: list[list[tuple[str, ...]]] = []
    run = {""}

    def flush() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            least = [g for g in grams if not any(h < g for h in grams)]
            clauses.append(sorted(tuple(sorted(g))[:_MOST_GRAMS] for g in least))
        run = {""}

    def cross(tails: set[str]) -> None:
        nonlocal run
        if len(run) * len(tails) > _MOST_STRINGS:
            flush()
        run = {a + b for a in run for b in tails}

    def exact(items) -> set[str] | None:
        """All strings the items match, lower-cased, if these are few."""
        out = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                tails = {chr(arg).lower()}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                tails = {chr(a).lower() for _, a in arg}
            elif op is sre.SUBPATTERN:
                tails = exact(arg[-1])
            elif op is sre.BRANCH:
                each = [exact(x) for x in arg[1]]
                tails = None if None in each else set().union(*each)
            elif op is sre.MAX_REPEAT and arg[1] <= 8:
                once = exact(arg[2])
                tails = None if once is None else set()
                for n in range(arg[0], arg[1] + 1) if once is not None else ():
                    power = {""}
                    for _ in range(n):
                        power = {a + b for a in power for b in once}
                        if len(power) > _MOST_STRINGS:
                            return None
                    tails |= power
            elif op is sre.AT:
                tails = {""}
            else:
                tails = None
            if tails is None or len(out) * len(tails) > _MOST_STRINGS:
                return None
            out = {a + b for a in out for b in tails}
        return out

    def walk(items) -> None:
        for item in items:
            op, arg = item
            tails = exact([item])
            if tails is not None:
                cross(tails)
            elif op is sre.SUBPATTERN:
                walk(arg[-1])
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                flush()
                walk(arg[2])
                flush()
            else:
                flush()

    walk(sre_parser.parse(pattern))
    flush()
    return clauses


def _queries(rules: tuple[Rule, ...]) -> list[tuple[str, int, int, int, str, int, int]]:
    """(rule, clauses, clause, alternative, trigram, its bit, the alternative's bits)."""
    rows = []
    for rule in rules:
        clauses = trigram_query(rule.pattern)
        for c, alternatives in enumerate(clauses):
            for a, grams in enumerate(alternatives):
                for g, gram in enumerate(grams):
                    rows.append((rule.kind, (1 << len(clauses)) - 1, 1 << c, a, gram, 1 << g, (1 << len(grams)) - 1))
    return rows


def candidates(docs: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, rules)``: the indexed rules whose trigram query a document satisfies."""
    rows = _queries(rules)
    grams = sorted({r[4] for r in rows})
    low = docs.select(key, F.lower(F.col(text)).alias("_low"))
    held = F.array_compact(F.array(*[F.when(F.contains("_low", F.lit(g)), F.lit(g)) for g in grams]))
    postings = low.select(key, F.explode(held).alias("gram"))
    names = ("rule", "clauses", "clause", "alternative", "gram", "bit", "bits")
    lits = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    queries = docs.sparkSession.range(1).select(F.inline(F.array(*lits)))  # as many rows as the rules need
    met = (
        postings.join(F.broadcast(queries), "gram")
        .groupBy(key, "rule", "clauses", "clause", "alternative", "bits")
        .agg(F.bit_or("bit").alias("has"))
        .where("has = bits")
        .groupBy(key, "rule", "clauses")
        .agg(F.bit_or("clause").alias("held"))
        .where("held = clauses")
    )
    return met.groupBy(key).agg(F.collect_set("rule").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Sorted array of (start, ord, end, kind), leftmost and non-overlapping."""
    pattern = F.lit(rule.pattern)
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    held = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    zipped = F.arrays_zip(
        found.alias("found"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)).alias("gap"), held.alias("held")
    )

    def place(rows):
        steps = F.transform(rows, lambda r: F.length(r["gap"]) + F.length(r["found"]))
        return F.transform(
            F.arrays_zip(rows.alias("r"), prefix_sums(steps).alias("before")),
            lambda z: F.struct(
                (z["before"] + F.length(z["r"]["gap"])).alias("start"),
                F.lit(order).alias("ord"),
                (z["before"] + F.length(z["r"]["gap"]) + F.length(z["r"]["found"])).alias("end"),
                F.lit(rule.kind).alias("kind"),
                F.length(z["r"]["held"]).alias("size"),
            ),
        )

    kept = F.filter(let(zipped, place), lambda s: s["size"] >= rule.least)
    bare = F.transform(kept, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))
    return F.when(F.rlike(text, pattern), bare).otherwise(none)


def scan_columns(
    docs: DataFrame,
    columns: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """``columns`` and ``spans`` (in place of a column of that name); see ``scan``."""
    row = F.struct(*[F.col(c) for c in columns if c != "spans"]).alias("_row")
    base = docs.select(row, F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_key"))
    found = candidates(base, "_key", "_text", rules).withColumnRenamed("rules", "_rules")
    text = F.coalesce("_text", F.lit(""))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string>>)")
    parts = []
    for k, rule in enumerate(rules):
        spans = _spans(text, rule, k)
        if trigram_query(rule.pattern):
            spans = F.when(F.array_contains("_rules", rule.kind), spans).otherwise(none)
        parts.append(spans)
    joined = base.join(found.hint("shuffle_hash"), "_key", "left")
    return joined.select("_row.*", F.sort_array(F.concat(*parts)).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row ``(id_col, spans)`` per document, spans sorted by start and rule.

    A null text is scanned as an empty one. Rows are told apart by (id, text), so null and
    repeated ids and repeated rows keep their own right spans. Other columns are not read.
    An empty table gives an empty one. The index join moves each text once, by its own key:
    no key is hotter than its number of exactly repeated rows.
    """
    return scan_columns(docs, [id_col], id_col, text_col, rules)


def spans_text(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out")
        )

    whole = F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, whole).otherwise(text)
