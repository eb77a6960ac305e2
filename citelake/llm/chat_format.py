"""Chat formatting by schema fingerprint.

A record's fingerprint is the hash of its nested field paths, at any depth, that hold
something. Each known layout (messages, conversations, prompt and response, instruction and
output, ...) declares its paths and how they become canonical turns ``(role, text)``; the
fingerprint selects the declaration, row by row, so one table may mix layouts. A record whose
fingerprint is no layout's own takes the layout with the most paths of those it holds whole,
else the first one that it holds any path of, else the first whose array has elements. Known
fields beside the layout taken are not part of the chat. A layout of single fields gives no
turn for those that a record lacks.

Template: every turn is ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and
texts are escaped: ``\\`` doubles, and a ``\\`` goes behind the first character of a control
string. So ``</s>`` ends turns only, and taking out each ``\\`` gives the text back. The loss
mask lists the spans of assistant texts, in code points of the formatted string.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citelake.llm.common import let, prefix_sums

_BOS, _EOS, _OPEN, _CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = r"(<)(/?s>)|(\[)(/?INST\])"
_SAME_ROLE = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """``each``: (array, role field, text field), with dots for nested ones; ``fixed``: (role,
    path...) in order, the paths of a turn joined by a blank line."""

    name: str
    each: tuple[str, str, str] | None = None
    fixed: tuple[tuple[str, ...], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if self.each:
            array, *fields = self.each
            return tuple(sorted(f"{array}[].{f}" for f in fields))
        return tuple(sorted(path for turn in self.fixed for path in turn[1:]))


LAYOUTS = (
    Layout("messages", each=("messages", "role", "content")),
    Layout("conversations", each=("conversations", "from", "value")),
    Layout("export", each=("mapping", "message.author.role", "message.content.text")),
    Layout("prompt-response", fixed=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt-completion", fixed=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question-answer", fixed=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", fixed=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input", fixed=(("user", "instruction", "input"), ("assistant", "output"))),
    Layout("system-prompt", fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
)


def _leaves(kind: T.DataType, path: str = "") -> list[str]:
    """The paths of a type that hold values; an array's elements are ``[]``."""
    if isinstance(kind, T.ArrayType):
        return _leaves(kind.elementType, f"{path}[]")
    if isinstance(kind, T.StructType):
        return [leaf for f in kind.fields for leaf in _leaves(f.dataType, f"{path}.{f.name}" if path else f.name)]
    return [path]


def _column(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


def _field(value: Column, path: str) -> Column:
    for name in path.split("."):
        value = value[name]
    return value


def _held(path: str) -> Column:
    """Whether a record has a value at a path; of an array, in any element."""
    array, _, field = path.partition("[].")
    if not field:
        return _column(path).isNotNull()
    return F.coalesce(F.exists(_column(array), lambda m: _field(m, field).isNotNull()), F.lit(False))


def _hash(paths) -> Column:
    return F.xxhash64(F.lit(",".join(sorted(paths))))


def _known(schema: T.StructType, layouts: tuple[Layout, ...]) -> list[str]:
    there = set(_leaves(schema))
    return sorted({p for layout in layouts for p in layout.paths if p in there})


def fingerprint(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of the paths that hold a value, among those that some layout knows."""
    held = [F.when(_held(p), p) for p in _known(schema, layouts)]
    return F.xxhash64(F.array_join(F.array_compact(F.array(*held)), ",")) if held else _hash(())


def _turns(layout: Layout, there: set[str]) -> Column:
    def turn(role, text):
        role = F.coalesce(role, F.lit(""))
        for name, same in _SAME_ROLE.items() if layout.name == "conversations" else ():
            role = F.when(role == name, same).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    if layout.each:
        array, role, text = layout.each

        def of(m, field):
            return _field(m, field).cast("string") if f"{array}[].{field}" in there else F.lit(None).cast("string")

        return F.transform(_column(array), lambda m: turn(of(m, role), of(m, text)))
    turns = []
    for role, *paths in layout.fixed:
        parts = [_column(p).cast("string") for p in paths if p in there]
        if parts:
            turns.append(F.when(F.coalesce(*parts).isNotNull(), turn(F.lit(role), F.concat_ws("\n\n", *parts))))
    return F.array_compact(F.array(*turns))


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> tuple[Column, Column]:
    """(layout, turns) of each record; one that holds no known path has no layout and no turns."""
    there = set(_known(records.schema, layouts))
    some = [x for x in layouts if there.intersection(x.paths)]
    mark = fingerprint(records.schema, layouts)
    held = {p: _held(p) for p in there}
    whole = sorted((x for x in some if there.issuperset(x.paths)), key=lambda x: -len(x.paths))
    rules = [(x, mark == _hash(x.paths)) for x in whole]
    rules += [(x, functools.reduce(lambda a, b: a & b, (held[p] for p in x.paths))) for x in whole]
    rules += [(x, functools.reduce(lambda a, b: a | b, (held[p] for p in x.paths if p in there))) for x in some]
    rules += [(x, F.coalesce(F.size(_column(x.each[0])) > 0, F.lit(False))) for x in some if x.each]
    name = F.lit(None).cast("string")
    for layout, match in reversed(rules):
        name = F.when(match, layout.name).otherwise(name)

    def turns(chosen):
        out = F.expr("cast(array() as array<struct<role:string,text:string>>)")
        for layout in some:
            out = F.when(chosen == layout.name, _turns(layout, there)).otherwise(out)
        return out

    return name, turns(F.col("_layout"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(records: DataFrame, id_col: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """One row ``(id_col, layout, n_turns, formatted, loss_mask)`` per record.

    Null roles and texts of listed turns are empty ones. Records without a listed turn or a
    value in any known path format to the empty string. Repeated rows and null ids are records of their own; columns that no
    layout knows are ignored, and so are known ones beside a layout that is whole. An empty
    table gives an empty one.
    """
    name, turns = canonical(records, layouts)
    records = records.withColumn("_layout", name)
    marked = F.transform(
        turns,
        lambda t: F.struct(
            (t["role"] == "assistant").alias("learn"),
            F.concat(F.lit(_BOS + _OPEN), escape(t["role"]), F.lit(_CLOSE)).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )

    def build(ts):
        sizes = F.transform(ts, lambda t: F.length(t["head"]) + F.length(t["body"]) + len(_EOS))
        spans = F.transform(
            F.arrays_zip(ts.alias("t"), prefix_sums(sizes).alias("at")),
            lambda z: F.struct(
                z["t"]["learn"].alias("learn"),
                (z["at"] + F.length(z["t"]["head"])).alias("start"),
                (z["at"] + F.length(z["t"]["head"]) + F.length(z["t"]["body"])).alias("end"),
            ),
        )
        return F.struct(
            F.size(ts).cast("long").alias("n_turns"),
            F.array_join(F.transform(ts, lambda t: F.concat(t["head"], t["body"], F.lit(_EOS))), "").alias("formatted"),
            F.transform(
                F.filter(spans, lambda s: s["learn"]), lambda s: F.struct(s["start"], s["end"])
            ).alias("loss_mask"),
        )

    none = F.struct(
        F.lit(0).cast("long").alias("n_turns"),
        F.lit("").alias("formatted"),
        F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("loss_mask"),
    )
    built = let(marked, lambda ts: F.when(F.size(ts) > 0, build(ts)).otherwise(none))
    return records.select(id_col, F.col("_layout").alias("layout"), built.alias("_b")).select(id_col, "layout", "_b.*")


def read_back(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted string."""
    parts = F.filter(F.split(formatted, _EOS, -1), lambda p: p != "")
    head = len(_BOS + _OPEN)

    def turn(p):
        close = F.locate(_CLOSE, p) if isinstance(p, str) else F.instr(p, _CLOSE)
        return F.struct(
            unescape(F.substring(p, F.lit(head + 1), close - (head + 1))).alias("role"),
            unescape(F.substring(p, close + len(_CLOSE), F.length(p))).alias("text"),
        )

    return F.transform(parts, turn)


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )


def gather_turns(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Rows by turn as records of the messages layout, a conversation's turns in order of
    turn, role and text, nulls first. Rows of a null id are one conversation. A conversation
    is one record, however long: its formatted string is one value."""
    message = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("content"),
    )
    grouped = rows.groupBy(id_col).agg(F.sort_array(F.collect_list(message)).alias("messages"))
    return grouped.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"], m["content"])))
