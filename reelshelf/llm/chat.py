"""Chat formatting: rows of any known layout to canonical turns, turns to one marked text, and back.

A row's layout is told by the nested field paths that hold a value. A declarative table names for each layout the
paths that it needs and the turns that they make; the most specific layout whose paths all hold a value is taken,
and its fingerprint, the hash of its paths, stands in the row. Fields that no mapping names don't matter. The template
marks turns and escapes its control strings inside texts, so that reading the text back gives the same
turns. Built-in functions only.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from reelshelf.llm.runtime import let

#: The template: a turn is OPEN, role, BETWEEN, text, CLOSE.
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
#: What is written for a control string inside a text, in this order; a backslash of the output always begins one of these marks.
ESCAPES = [("\\", "\\-"), ("###", "\\h"), ("</turn>", "\\t")]
#: Roles escape this as well.
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]

#: Turns of a layout: (role, text). A role that begins with = is a literal, others and texts are paths. Fields are joined
#: by dots, [] goes into an array: the first one of a text path goes over messages, and the role is a field
#: of the same message; further ones go over the parts of a text, which are joined.
LAYOUTS: list[list[tuple[str, str]]] = [
    [("messages[].role", "messages[].content")],
    [("messages[].role", "messages[].content[].text")],
    [("conversations[].from", "conversations[].value")],
    [("=user", "prompt"), ("=assistant", "completion")],
    [("=user", "prompt"), ("=assistant", "response")],
    [("=system", "system"), ("=user", "prompt"), ("=assistant", "response")],
    [("=user", "data.prompt"), ("=assistant", "data.completion")],
    [("=user", "instruction"), ("=assistant", "output")],
    [("=user", "instruction"), ("=user", "input"), ("=assistant", "output")],
    [("=user", "question"), ("=assistant", "answer")],
]
#: Names under which canonical roles appear.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _steps(path: str) -> list[str]:
    """Fields and [] on the way: a.b[].c -> a, b, [], c."""
    return [x for field in path.split(".") for x in (field.removesuffix("[]"), "[]" if field.endswith("[]") else "") if x]


def _fits(kind: DataType, steps: list[str]) -> bool:
    """Whether a schema has a text at the end of a path."""
    for step in steps:
        if step == "[]":
            if not isinstance(kind, ArrayType):
                return False
            kind = kind.elementType
        elif isinstance(kind, StructType) and step in kind.names:
            kind = kind[step].dataType
        else:
            return False
    return isinstance(kind, StringType)


def _holds(value: Column, steps: list[str]) -> Column:
    """Whether some value stands at the end of a path."""
    if not steps:
        return value.isNotNull()
    if steps[0] == "[]":
        return F.coalesce(F.exists(value, lambda x: _holds(x, steps[1:])), F.lit(False))
    return _holds(value[steps[0]], steps[1:])


def _text(value: Column, steps: list[str]) -> Column:
    """The text at the end of a path, parts of an array joined; null where there is none."""
    if not steps:
        return value
    if steps[0] == "[]":
        parts = F.filter(F.transform(value, lambda x: _text(x, steps[1:])), lambda x: x.isNotNull())
        return F.when(value.isNotNull(), F.array_join(parts, ""))
    return _text(value[steps[0]], steps[1:])


def _needs(mapping: list[tuple[str, str]]) -> list[str]:
    """The text paths of a mapping."""
    return sorted({text for _, text in mapping})


def _mapped(mapping: list[tuple[str, str]], kind: DataType) -> bool:
    paths = [text for _, text in mapping] + [role for role, _ in mapping if role[0] != "="]
    return all(_fits(kind, _steps(path)) for path in paths)


def fingerprint(paths: list[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(sorted(paths))))


def _said(role: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, role), role, F.lit("user"))


def _turns(mapping: list[tuple[str, str]], record: Column) -> Column:
    """array<struct<role, text>> of one layout."""
    if len(mapping) == 1 and "[]" in mapping[0][1]:
        role, text = (_steps(path) for path in mapping[0])
        cut = text.index("[]")
        if role[: cut + 1] != text[: cut + 1]:
            raise ValueError(f"role and text lie in different arrays: {mapping[0]}")
        messages = record
        for step in text[:cut]:
            messages = messages[step]
        found = F.filter(messages, lambda m: m.isNotNull())
        return F.transform(
            found, lambda m: F.struct(_said(_text(m, role[cut + 1 :])).alias("role"), F.coalesce(_text(m, text[cut + 1 :]), F.lit("")).alias("text"))
        )
    turns = [
        F.struct((F.lit(role[1:]) if role[0] == "=" else _said(_text(record, _steps(role)))).alias("role"), _text(record, _steps(text)).alias("text"))
        for role, text in mapping
    ]
    return F.array(*turns)


def canonical_turns(records: DataFrame, column: str, layouts: list | None = None) -> DataFrame:
    """records with layout (the fingerprint) and turns array<struct<role, text>> instead of the struct column.

    A row to which no layout of the table fits, and a null row, stay, with null turns and the fingerprint of the paths
    that hold a value; ``unknown_layouts`` counts them. In an array of messages a null message makes no turn,
    a null text the empty text, a null role the role user. Of layouts that need equally many paths the first in the table is taken.
    """
    kind: StructType = records.schema[column].dataType
    record = F.col(column)
    fitting = sorted((m for m in (LAYOUTS if layouts is None else layouts) if _mapped(m, kind)), key=lambda m: -len(_needs(m)))
    known = sorted({path for m in fitting for path in _needs(m)})
    holds = {path: _holds(record, _steps(path)) for path in known}
    some = F.concat_ws("\n", *(F.when(there, F.lit(path)) for path, there in holds.items())) if known else F.lit("")
    layout, turns = F.xxhash64(some), F.lit(None).cast("array<struct<role:string,text:string>>")
    for mapping in reversed(fitting):
        fits = reduce(and_, (holds[path] for path in _needs(mapping)))
        layout, turns = F.when(fits, fingerprint(_needs(mapping))).otherwise(layout), F.when(fits, _turns(mapping, record)).otherwise(turns)
    rest = [f"`{c}`" for c in records.columns if c not in ("layout", "turns", column)]
    return records.select(*rest, layout.alias("layout"), turns.alias("turns"))


def unknown_layouts(records: DataFrame, column: str, layouts: list | None = None) -> DataFrame:
    """layout and rows: how many rows no mapping fits, by the fingerprint of the known paths that hold a value in them."""
    rest = canonical_turns(records, column, layouts).filter(F.col("turns").isNull())
    return rest.groupBy("layout").agg(F.count("*").alias("rows"))


def messages_of(rows: DataFrame) -> DataFrame:
    """conv_id and record, a struct in the layout of messages, from rows (conv_id, turn, role, text).

    Turns come by number; equal numbers, and equal rows, by role and text; a null number first. Rows with
    a null conv_id form one conversation. A conversation is one row from here on, as its text is.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    whole = rows.select("conv_id", turn.alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    plain = F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return whole.select("conv_id", F.struct(plain.alias("messages")).alias("record"))


def _escaped(text: Column, marks: list[tuple[str, str]]) -> Column:
    for plain, mark in marks:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def _unescaped(text: Column, marks: list[tuple[str, str]]) -> Column:
    for plain, mark in reversed(marks):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def format_turns(turns: Column) -> Column:
    """A struct of formatted (the text) and loss_mask.

    loss_mask has for each turn the start (in code points after the turn's begin) and the length of what is
    learnt: an assistant's text as it was escaped, or length 0.
    """
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _escaped(t["role"], ROLE_ESCAPES), F.lit(BETWEEN)).alias("head"),
            _escaped(t["text"], ESCAPES).alias("body"), (t["role"] == "assistant").alias("learn"),
        ),
    )
    return let(
        pieces,
        lambda p: F.struct(
            F.array_join(F.transform(p, lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
            F.transform(
                p, lambda x: F.struct(F.length(x["head"]).alias("start"), F.when(x["learn"], F.length(x["body"])).otherwise(0).alias("length"))
            ).alias("loss_mask"),
        ),
    )


def _parts(formatted: Column) -> Column:
    return F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""

    def turn(x: Column) -> Column:
        cut = F.instr(x, BETWEEN)
        role = F.substr(x, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        return F.struct(_unescaped(role, ROLE_ESCAPES).alias("role"), _unescaped(F.substr(x, cut + len(BETWEEN)), ESCAPES).alias("text"))

    return F.transform(_parts(formatted), turn)


def read_loss(formatted: Column, loss_mask: Column) -> Column:
    """The text under the loss mask, unescaped, nothing between the spans."""
    spans = F.zip_with(
        _parts(formatted), loss_mask, lambda x, m: F.when(m["length"] > 0, _unescaped(F.substr(x, m["start"] + 1, m["length"]), ESCAPES))
    )
    return F.array_join(spans, "")


def format_records(records: DataFrame, column: str, layouts: list | None = None) -> DataFrame:
    """records with layout, turns, formatted and loss_mask instead of the struct column; these three null where no layout fits. Odd cases as canonical_turns has them."""
    turns = canonical_turns(records, column, layouts)
    rest = [f"`{c}`" for c in turns.columns if c not in ("formatted", "loss_mask", "f")]
    return turns.select(*rest, format_turns(F.col("turns")).alias("f")).select(*rest, "f.formatted", "f.loss_mask")


def chat_digests(rows: DataFrame) -> DataFrame:
    """Per conversation the measures of what is read back from its formatted text.

    conv_id, n_turns, turns_sha256 (of role, line feed, text, line feed per turn), loss_chars and loss_sha256
    (of all text under the loss mask), formatted_chars. A null text is empty, a null role is user, a null turn comes
    first, equal turns go by role and text, rows that repeat are turns of their own, rows with a null conv_id are one
    conversation. An empty table gives no rows; other columns are not read.
    """
    record = canonical_turns(messages_of(rows), "record")

    def measures(f: Column) -> Column:
        back = F.transform(read_turns(f["formatted"]), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
        both = F.struct(back.alias("turns"), read_loss(f["formatted"], f["loss_mask"]).alias("loss"))
        return let(
            both,
            lambda m: F.struct(
                F.size(m["turns"]).cast("long").alias("n_turns"),
                F.sha2(F.array_join(m["turns"], ""), 256).alias("turns_sha256"),
                F.length(m["loss"]).cast("long").alias("loss_chars"),
                F.sha2(m["loss"], 256).alias("loss_sha256"),
                F.length(f["formatted"]).cast("long").alias("formatted_chars"),
            ),
        )

    return record.select("conv_id", let(format_turns(F.col("turns")), measures).alias("d")).select("conv_id", "d.*")
