"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record's layout is the set of its nested field paths.  Its hash selects a declarative mapping to
canonical turns, each a struct of role and text:

* ``Rows``: the table has a row for each turn;
* ``Messages``: a record holds a list of turns;
* ``Fields``: a record holds turns in separate fields, such as prompt and completion.

The format of a turn is ``<turn FLAG ROLE>TEXT</turn>`` and a line feed; FLAG is ``+`` where the
loss mask covers TEXT, else ``-``.  In ROLE and TEXT a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and
``>`` becomes ``\\g``, so that no control string can occur inside a turn and the escapes can be undone.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import packed, passing, unpacked

TURNS = "array<struct<role:string,text:string>>"
OPEN, CLOSE = "<turn ", "</turn>\n"
#: What stands for each control character, undone in reverse order.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
TRAINED = ("assistant",)


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths, sorted; ``[]`` marks the elements of a list."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(field_paths: Sequence[str]) -> int:
    return zlib.crc32("\n".join(sorted(field_paths)).encode())


@dataclass(frozen=True)
class Rows:
    """A row for each turn: the columns that name the conversation, the order, the role and the text."""

    conversation: str
    order: str
    role: str
    text: str

    def paths(self) -> list[str]:
        return [self.conversation, self.order, self.role, self.text]


@dataclass(frozen=True)
class Messages:
    """A list of turns; ``roles`` renames roles, others stay."""

    items: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        return [f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"]

    def turns(self, record: Column) -> Column:
        def turn(m: Column) -> Column:
            role = m[self.role].cast("string")
            for old, new in self.roles:
                role = F.when(m[self.role] == old, F.lit(new)).otherwise(role)
            return F.struct(role.alias("role"), m[self.text].cast("string").alias("text"))

        return F.transform(_get(record, self.items), turn)


@dataclass(frozen=True)
class Fields:
    """Turns in fields of their own: pairs of a role and the fields whose texts, joined by a line feed, make the turn.

    A turn whose fields are all null or empty is left out."""

    parts: tuple[tuple[str, tuple[str, ...]], ...]

    def paths(self) -> list[str]:
        return [f for _, fields in self.parts for f in fields]

    def turns(self, record: Column) -> Column:
        made = []
        for role, fields in self.parts:
            texts = F.filter(F.array(*[_get(record, f).cast("string") for f in fields]), lambda x: x.isNotNull() & (x != ""))
            made.append(F.struct(F.lit(role).alias("role"), F.array_join(texts, "\n").alias("text")))
        return F.filter(F.array(*made), lambda t: t["text"] != "")


Mapping = Rows | Messages | Fields

#: Layouts in common use.
MAPPINGS: tuple[Mapping, ...] = (
    Rows("conv_id", "turn", "role", "text"),
    Messages("messages", "role", "content"),
    Messages("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))),
    Fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    Fields((("user", ("prompt",)), ("assistant", ("response",)))),
    Fields((("user", ("instruction",)), ("assistant", ("output",)))),
    Fields((("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Fields((("user", ("question",)), ("assistant", ("answer",)))),
)


def registry(mappings: Sequence[Mapping] = MAPPINGS) -> dict[int, Mapping]:
    return {fingerprint(m.paths()): m for m in mappings}


def _get(record: Column, path: str) -> Column:
    for name in path.split("."):
        record = record[name]
    return record


def select_mapping(schema: T.DataType, mappings: Sequence[Mapping] = MAPPINGS) -> Mapping | None:
    """The mapping with the schema's fingerprint, or else the one of most paths that the schema has all of.

    The second rule lets tables have extra columns.  Nothing fits: None."""
    own = paths(schema)
    if found := registry(mappings).get(fingerprint(own)):
        return found
    fits = [m for m in mappings if set(m.paths()) <= set(own)]
    return max(fits, key=lambda m: len(m.paths()), default=None)


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def format_turn(role: Column, text: Column, trained: Sequence[str] = TRAINED) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    flag = F.when(role.isin(*trained), F.lit("+ ")).otherwise(F.lit("- "))
    return F.concat(F.lit(OPEN), flag, escape(role), F.lit(">"), escape(text), F.lit(CLOSE))


def format_rows(df: DataFrame, mapping: Rows, trained: Sequence[str] = TRAINED) -> DataFrame:
    """Conversation and ``formatted`` for tables of turns.

    Turns are formatted row by row before they meet; a conversation is joined in one task, as its
    text is one value.  Turns of one number are ordered by role and text; null texts and roles are
    empty, rows of a null conversation make one conversation.  Equal rows stay, each a turn."""
    turn = F.struct(
        F.col(mapping.order).alias("at"), F.coalesce(F.col(mapping.role), F.lit("")).alias("role"), F.coalesce(F.col(mapping.text), F.lit("")).alias("text"),
        format_turn(F.col(mapping.role), F.col(mapping.text), trained).alias("out"),
    )
    return (
        df.select(F.col(mapping.conversation).alias("conv_id"), turn.alias("turn"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select("conv_id", F.array_join(F.transform("turns", lambda t: t["out"]), "").alias("formatted"))
    )


def format_records(df: DataFrame, mappings: Sequence[Mapping] = MAPPINGS, trained: Sequence[str] = TRAINED, column: str | None = None) -> DataFrame:
    """Adds ``formatted`` to a table with a record in each row, whose layout its schema shows; unknown: ValueError.

    ``column``: the struct that holds the record; None: the row itself."""
    schema = df.schema[column].dataType if column else df.schema
    found = select_mapping(schema, mappings)
    if found is None or isinstance(found, Rows):
        raise ValueError(f"no mapping for a record of {paths(schema)}")
    record = F.col(column) if column else F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn("formatted", _joined(found.turns(record), trained))


def json_paths(text: Column) -> Column:
    """Paths of the leaves of a JSON text, sorted, such as ``messages[].role``: of its fields, of theirs, and of the items of lists, to a depth of four."""
    value = F.try_parse_json(text)
    shape = F.schema_of_variant(value)
    # the printed schema, cut at its brackets, colons and commas: a stack of prefixes follows it
    tokens = F.regexp_extract_all(shape, F.lit(r"(OBJECT<|ARRAY<|>|[^\s<>,:]+: |[^\s<>,:]+)"), 1)
    first = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("found"))
    top = lambda s: F.element_at(s["stack"], -1)
    as_state = lambda stack, name, found: F.struct(stack.alias("stack"), name.alias("name"), found.alias("found"))
    here = lambda s: F.concat(top(s), s["name"])

    def step(s: Column, t: Column) -> Column:
        opened = lambda suffix: as_state(F.concat(s["stack"], F.array(F.concat(here(s), F.lit(suffix)))), F.lit(""), s["found"])
        inside = F.when(here(s) == "", F.lit("")).otherwise(F.concat(here(s), F.lit(".")))
        return (
            F.when(t == "OBJECT<", as_state(F.concat(s["stack"], F.array(inside)), F.lit(""), s["found"]))
            .when(t == "ARRAY<", opened("[]"))
            .when(t == ">", as_state(F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(1))), F.lit(""), s["found"]))
            .when(t.endswith(": "), as_state(s["stack"], F.regexp_replace(t, "^`|`?: $", ""), s["found"]))
            .otherwise(as_state(s["stack"], F.lit(""), F.concat(s["found"], F.array(here(s)))))
        )

    return F.array_sort(F.array_distinct(F.filter(F.aggregate(tokens, first, step, lambda s: s["found"]), lambda p: p != "")))


def format_json(df: DataFrame, column: str, mappings: Sequence[Mapping] = MAPPINGS, trained: Sequence[str] = TRAINED) -> DataFrame:
    """Adds ``layout`` and ``formatted`` for JSON records of mixed layouts.

    Each record's nested field paths are read from its own schema, and their hash selects the mapping, or else
    the one of most paths that the record has all of.  An empty list of turns gives an empty text.  Other layouts, and texts that are no JSON, get a null ``formatted``."""
    own = json_paths(F.col(column))
    layout = F.crc32(F.array_join(own, "\n"))
    exact = within = F.lit(None).cast("string")
    # the last condition that holds decides: the largest mapping, of equal ones the first
    for m in sorted(reversed([m for m in mappings if not isinstance(m, Rows)]), key=lambda m: len(m.paths())):
        names = sorted(m.paths())
        schema = f"{m.items} array<struct<`{m.role}`:string,`{m.text}`:string>>" if isinstance(m, Messages) else ", ".join(f"`{f}` string" for f in m.paths())
        key = zlib.crc32("\n".join(names).encode())
        made = _joined(m.turns(F.from_json(F.col(column), schema)), trained)
        fits = F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.col("__own"))) == 0
        if isinstance(m, Messages):  # an empty list shows no fields
            fits = fits | (F.get_json_object(F.col(column), f"$.{m.items}") == "[]")
        exact = F.when(F.col("layout") == key, made).otherwise(exact)
        within = F.when(fits, made).otherwise(within)
    known = df.withColumn("__own", own).withColumn("layout", layout)
    return known.withColumn("formatted", F.coalesce(exact, within)).drop("__own")


def _joined(turns: Column, trained: Sequence[str]) -> Column:
    return F.array_join(F.transform(turns, lambda t: format_turn(t["role"], t["text"], trained)), "")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, with ``trained``: whether the loss mask covers the text."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        head = F.substring_index(p, ">", 1)
        return F.struct(
            unescape(F.substring(head, len(OPEN) + 3, 1 << 30)).alias("role"),
            unescape(F.substring_index(p, ">", -1)).alias("text"),
            (F.substring(head, len(OPEN) + 1, 1) == "+").alias("trained"),
        )

    return F.transform(pieces, turn)


def loss_spans(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """A row for each trained turn: the columns of ``df`` but ``formatted``, with ``start`` and ``length`` in code points of it.

    For trainers that take offsets; the flags in the format carry the same mask.  Offsets are summed within the row, so equal rows
    give equal spans.  Columns named ``start`` and ``length`` are replaced.  Null: no rows."""
    keep = passing(df, (formatted, "start", "length"))
    pieces = F.split(F.col(f"`{formatted}`"), CLOSE, -1)
    head = lambda p: F.length(F.substring_index(p, ">", 1)) + 1
    none = F.array().cast("array<struct<start:int,length:int,trained:boolean>>")
    place = lambda s, p: F.struct((s["at"] + head(p)).alias("start"), (F.length(p) - head(p)).alias("length"), (F.substring(p, len(OPEN) + 1, 1) == "+").alias("trained"))
    step = lambda s, p: F.struct((s["at"] + F.length(p) + len(CLOSE)).alias("at"), F.concat(s["out"], F.array(place(s, p))).alias("out"))
    found = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: F.filter(s["out"], lambda x: x["trained"]))
    return unpacked(df.select(packed(keep), F.explode(found).alias("span")), keep, F.col("span.start").alias("start"), F.col("span.length").alias("length"))
