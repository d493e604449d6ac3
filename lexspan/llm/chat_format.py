"""Chat records of mixed layouts to canonical turns, and turns to one formatted text, with column functions alone.

Every record is told by a schema fingerprint: the digest of the nested field paths that it
fills, among the paths that any declared layout knows.  The fingerprint selects a layout,
which says declaratively where the turns stand; other columns of whatever name take no part.

A template marks each turn.  A control string inside a text or role gets a backslash after
its first character, and one more where it has some already, so that no text can open or
close a turn and every text comes back exactly.

Defined cases: null text or role: empty; a record of no known layout: a null layout and no
turns; records that fill no text: turns as far as they are listed; very long texts are kept
whole; repeated records come back as often as they came; an empty table gives an empty
result.  In `conversations`, rows of equal turn stand in the order of role and text, repeated
rows are turns each, and rows without conv_id are one conversation.  A conversation is one
value (its digest is of all turns in order), so one of very many rows meets in one task.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

TURNS = "array<struct<role:string,text:string>>"
#: Names of speakers in some layouts, and the role that each stands for; all others stand for themselves.
SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record stand.

    fixed: (role, fields) in order; the fields that are filled make one turn's text, joined by
    an empty line.  each: (list field, role field, text field) of turns that follow them.
    The fields in `needs` must be filled, the others may be.
    """

    name: str
    needs: tuple[str, ...]
    fixed: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: tuple[str, str, str] | None = None
    speakers: dict = field(default_factory=dict)

    def paths(self) -> list[str]:
        nested = [self.each[0], *(f"{self.each[0]}[].{f}" for f in self.each[1:])] if self.each else []
        return sorted({*self.needs, *nested, *(f for _, fields in self.fixed for f in fields)})


def _listed(name: str, column: str, role: str, text: str, needs: tuple[str, ...] = (), speakers: dict | None = None) -> Layout:
    return Layout(name, (column, *needs), (("system", ("system",)),), (column, role, text), speakers or {})


LAYOUTS = (
    _listed("messages", "messages", "role", "content"),
    _listed("messages from", "messages", "from", "value", ("messages[].from",), SPEAKERS),
    _listed("conversations", "conversations", "from", "value", (), SPEAKERS),
    _listed("dialogue", "dialogue", "speaker", "text", (), SPEAKERS),
    Layout("instruction", ("instruction",), (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("prompt response", ("prompt",), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt completion", ("prompt", "completion"), (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question", ("question", "answer"), (("system", ("system",)), ("user", ("context", "question")), ("assistant", ("answer",)))),
)


def fingerprint_of(paths) -> str:
    """The digest of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def known_fingerprints(layouts=LAYOUTS) -> dict[str, int]:
    """The number of the layout for each fingerprint; of layouts that fill the same paths the first."""
    out: dict[str, int] = {}
    for n, layout in enumerate(layouts):
        more = [p for p in layout.paths() if p not in layout.needs]
        for k in range(len(more) + 1):
            for chosen in combinations(more, k):
                out.setdefault(fingerprint_of({*layout.needs, *chosen}), n)
    return out


def _has(schema: T.StructType, path: str) -> bool:
    """Whether the schema holds a path as text, or as a list where the path is one of a list."""
    top, _, nested = path.partition("[].")
    if top not in schema.names:
        return False
    kind = schema[top].dataType
    inner = kind.elementType if isinstance(kind, T.ArrayType) else None
    if not nested:
        return isinstance(kind, T.StringType) or isinstance(inner, T.StructType)
    return isinstance(inner, T.StructType) and nested in inner.names and isinstance(inner[nested].dataType, T.StringType)


def fingerprint(schema: T.StructType, layouts=LAYOUTS) -> Column:
    """The fingerprint of a record: of the known paths that it fills, in order of their names."""
    paths = [p for p in sorted({p for x in layouts for p in x.paths()}) if _has(schema, p)]

    def filled(path: str) -> Column:
        top, _, nested = path.partition("[].")
        return F.exists(top, lambda x: x[nested].isNotNull()) if nested else F.col(top).isNotNull()

    # concat_ws leaves out what is null.
    return F.sha2(F.concat_ws("\n", *(F.when(filled(p), F.lit(p)) for p in paths)), 256)


def _turns(layout: Layout, schema: T.StructType) -> Column:
    there = lambda p: _has(schema, p)
    turn = lambda role, text: F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    fixed = []
    for role, fields in layout.fixed:
        held = [F.col(f) for f in fields if there(f)]
        if held:
            text = F.when(F.coalesce(*held).isNotNull(), F.concat_ws("\n\n", *held))
            fixed.append(F.when(text.isNotNull(), turn(F.lit(role), text)))
    out = F.filter(F.array(*fixed), lambda t: t.isNotNull()).cast(TURNS) if fixed else F.array().cast(TURNS)
    if layout.each and there(layout.each[0]):
        top, role, text = layout.each
        get = lambda x, name: x[name] if there(f"{top}[].{name}") else F.lit(None).cast("string")
        said = F.create_map(*(F.lit(v) for pair in layout.speakers.items() for v in pair)) if layout.speakers else None
        named = lambda x: F.coalesce(F.try_element_at(said, get(x, role)), get(x, role)) if said is not None else get(x, role)
        out = F.concat(out, F.transform(top, lambda x: turn(named(x), get(x, text))).cast(TURNS))
    return out


def canonical_turns(records: DataFrame, keys: list[str], layouts=LAYOUTS) -> DataFrame:
    """keys, fingerprint, layout (its name or null), turns of records, one row each; a key is not a field."""
    schema = T.StructType([f for f in records.schema if f.name not in keys])
    numbers = known_fingerprints(layouts)
    by_fingerprint = F.create_map(*(F.lit(v) for pair in numbers.items() for v in pair))
    told = records.withColumn("_fingerprint", fingerprint(schema, layouts))
    told = told.withColumn("_layout", F.try_element_at(by_fingerprint, F.col("_fingerprint")))
    turns, name = F.array().cast(TURNS), F.lit(None).cast("string")
    for n, layout in enumerate(layouts):
        if all(_has(schema, p) for p in layout.needs):
            turns = F.when(F.col("_layout") == n, _turns(layout, schema)).otherwise(turns)
            name = F.when(F.col("_layout") == n, layout.name).otherwise(name)
    return told.select(*keys, F.col("_fingerprint").alias("fingerprint"), name.alias("layout"), turns.alias("turns"))


@dataclass(frozen=True)
class Template:
    """Marks of a turn, `control` strings besides them that no text may hold, and the roles to learn from."""

    begin: str = "<|turn|>"
    middle: str = "<|text|>"
    end: str = "<|end|>"
    control: tuple[str, ...] = ("<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        first = {s[0] for s in self.strings()}
        if any(c in s[1:] for s in self.strings() for c in first | {"\\"}) or any(len(s) < 2 or s[0] == "\\" for s in self.strings()):
            raise ValueError("no control string may hold another's first character, or a backslash, after its own first one")

    def strings(self) -> list[str]:
        return list(dict.fromkeys((self.begin, self.middle, self.end, *self.control)))

    def _after(self, look: str) -> str:
        """A pattern of the place after the first character of a control string, backslashes between or not."""
        rest: dict[str, list[str]] = {}
        for s in self.strings():
            rest.setdefault(s[0], []).append(_quoted(s[1:]))
        return "|".join(rf"(?<={_quoted(c)}){look}(?=\\*(?:{'|'.join(r)}))" for c, r in rest.items())

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._after(""), r"\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._after(r"\\"), "")

    def format_turn(self, turn: Column) -> Column:
        return F.concat(F.lit(self.begin), self.escape(turn["role"]), F.lit(self.middle), self.escape(turn["text"]), F.lit(self.end))


def _quoted(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", s)


def format_turns(rows: DataFrame, keys: list[str], template: Template = Template()) -> DataFrame:
    """keys, formatted, loss_mask of rows (keys, turns).

    loss_mask: struct(turn, start, length) of each turn to learn from, in order: turn numbers from
    0, code points within the turn's own piece of the output, its text without marks.
    """
    piece = rows.select(*keys, "turns", F.transform("turns", template.format_turn).alias("pieces"))
    span = F.transform("turns", lambda t, i: F.when(t["role"].isin(*template.learned), F.struct(
        i.alias("turn"), (F.length(template.escape(t["role"])) + len(template.begin) + len(template.middle)).alias("start"), F.length(template.escape(t["text"])).alias("length"))))
    return piece.select(*keys, F.array_join("pieces", "").alias("formatted"), F.filter(span, lambda s: s.isNotNull()).alias("loss_mask"))


def read_back(rows: DataFrame, keys: list[str], template: Template = Template()) -> DataFrame:
    """keys, turns, learned_text of rows (keys, formatted, loss_mask): what the output says, and all text under its mask."""
    # Each piece stands without the mark that began it; the first is what stands before any turn.
    pieces = F.slice(F.split("formatted", _quoted(template.begin), -1), 2, 2**31 - 1)
    parts = rows.select(*keys, "loss_mask", pieces.alias("pieces"))
    cut = lambda p: F.split(p, f"{_quoted(template.middle)}|{_quoted(template.end)}", -1)
    turn = lambda c: F.struct(template.unescape(c[0]).alias("role"), template.unescape(c[1]).alias("text"))
    under = F.transform("loss_mask", lambda s: template.unescape(F.substring(F.get("pieces", s["turn"]), s["start"] - len(template.begin) + 1, s["length"])))
    return parts.select(*keys, F.transform(F.transform("pieces", cut), turn).alias("turns"), F.array_join(under, "").alias("learned_text"))


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id, messages of rows by turn (conv_id, turn, role, text)."""
    ordered = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    return rows.groupBy("conv_id").agg(messages.alias("messages"))


def chat_digests(records: DataFrame, key: str, template: Template = Template()) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, layout, read back from the formatted records."""
    keys = [key, "layout"]
    done = format_turns(canonical_turns(records, [key]), keys, template).withColumn("formatted_chars", F.length("formatted").cast("long"))
    back = read_back(done, [*keys, "formatted_chars"], template)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned_text").cast("long").alias("loss_chars"),
        F.sha2("learned_text", 256).alias("loss_sha256"), "formatted_chars", "layout",
    )


#: The conversation that is added to the table, as a record of another layout.
ADDED_ID, ADDED_TEXT = -7, "</s>[INST] ok [/INST]"


def op12_chat_format(spark, sf_dir):
    """All conversations, and one that speaks in control strings, formatted and read back from the output."""
    told = conversation_records(common.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    added = spark.range(1).select(F.lit(ADDED_ID).cast("long").alias("conv_id"), F.lit(ADDED_TEXT).alias("prompt"), F.lit(ADDED_TEXT).alias("response"))
    return chat_digests(told.unionByName(added, allowMissingColumns=True), "conv_id")


def _escaped_length_sql(text: str, template: Template = Template()) -> str:
    """DuckDB: code points of an escaped text: its own and one for each control string in it."""
    shape = "|".join(_quoted(s[0]) + r"\\*" + _quoted(s[1:]) for s in template.strings())
    return f"length({text}) + len(regexp_extract_all({text}, '{shape}'))"


def op12_sql(template: Template = Template()) -> str:
    marks = len(template.begin) + len(template.middle) + len(template.end)
    return f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') role, coalesce(text, '') text FROM conversations
  UNION ALL SELECT {ADDED_ID}, * FROM (VALUES (0, 'user', '{ADDED_TEXT}'), (1, 'assistant', '{ADDED_TEXT}'))
)
SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) loss_sha256,
  sum({_escaped_length_sql('role', template)} + {_escaped_length_sql('text', template)} + {marks})::BIGINT formatted_chars,
  CASE WHEN conv_id = {ADDED_ID} THEN 'prompt response' ELSE 'messages' END layout
FROM told GROUP BY conv_id"""


OP12_SQL = op12_sql()
