"""Chat formatting, with DataFrame functions only.

A layout is recognised by its fingerprint: the hash of its nested field names, sorted. The fingerprint selects a
declarative mapping that turns the layout into canonical turns, array<struct<role, text>>. Columns are fingerprinted by
their schema, JSON texts row by row.

Turns are written as `### role: text</turn>` lines. Inside roles and texts a backslash becomes \\b, `</turn>` \\e,
`### ` \\m and (in roles) a colon \\c, so no text can open or close a turn and every text comes back exactly. The loss
mask has the places of the assistant's texts in the formatted text, in code points.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "### ", "</turn>"
TURNS = "array<struct<role:string,text:string>>"
#: Further names of roles in layouts with messages or with from and value. Turns by rows keep their roles as they stand.
ROLES = (("human", "user"), ("prompter", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"), ("ai", "assistant"))
#: Longer conversations stay in their struct instead of a JSON text, whose fingerprint is limited to texts of 20 million characters.
JSON_CHARS = 4_000_000


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: a list with a role and a text field, or single fields with fixed roles.

    A field of `alternatives` is a further name for the same place; empty optional fields give no turn."""

    name: str
    ddl: str  # the layout
    turns: tuple[str, str, str] | None = None  # list field ('' for the column itself), role field, text field
    fields: tuple[tuple[str, str], ...] = ()  # (role, field); fields of one role that follow each other are joined by a blank line
    roles: tuple[tuple[str, str], ...] = ()  # the layout's own names of roles; others are taken as they stand


MAPPINGS = (
    Mapping("turn_rows", "turns array<struct<turn:bigint,role:string,text:string>>", ("turns", "role", "text")),
    Mapping("turns", "turns array<struct<role:string,text:string>>", ("turns", "role", "text")),
    Mapping("messages", "messages array<struct<role:string,content:string>>", ("messages", "role", "content"), roles=ROLES),
    Mapping("conversations", "conversations array<struct<from:string,value:string>>", ("conversations", "from", "value"), roles=ROLES),
    Mapping("prompt_completion", "prompt string, completion string", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_response", "prompt string, response string", fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("question_answer", "question string, answer string", fields=(("user", "question"), ("assistant", "answer"))),
    Mapping("system_question_response", "system_prompt string, question string, response string", fields=(("system", "system_prompt"), ("user", "question"), ("assistant", "response"))),
    Mapping("instruction_output", "instruction string, output string", fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input_output", "instruction string, input string, output string", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)


def _paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in _paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return _paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(kind: T.DataType) -> str:
    """Hash of the nested field paths, sorted; the types of the leaves don't count."""
    return hashlib.sha256("\n".join(sorted(_paths(kind))).encode()).hexdigest()


def _shape(kind: T.DataType) -> str:
    """The same nesting as json_shape() writes it."""
    if isinstance(kind, T.StructType):
        return "OBJECT<" + ", ".join(f"{f.name}: {_shape(f.dataType)}" for f in sorted(kind, key=lambda f: f.name)) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_shape(kind.elementType)}>"
    return "x"


def json_fingerprint(text: Column) -> Column:
    """Hash of a JSON text's nested field names; null where it isn't JSON. Leaves' types don't count."""
    kind = F.schema_of_variant(F.try_parse_json(text))
    return F.sha2(F.regexp_replace(kind, r"\b(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|FLOAT|DATE|TIMESTAMP|DECIMAL\([0-9,]*\)|VARIANT)(?=[,>]|$)", "x").cast("binary"), 256)


def _schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def role_of(role: Column, names: tuple[tuple[str, str], ...] = ()) -> Column:
    """A layout's own names of roles in the common form; others as they are; null as empty."""
    for own, common in names:
        role = F.when(role == own, common).otherwise(role)
    return F.coalesce(role, F.lit(""))


def turns_by(mapping: Mapping, record: Column) -> Column:
    """Canonical turns of a struct of the mapping's layout. Null texts are empty; fields without text give no turn."""
    if mapping.turns:
        where, role, text = mapping.turns
        one = lambda t: F.struct(role_of(t[role], mapping.roles).alias("role"), F.coalesce(t[text], F.lit("")).alias("text"))
        return F.transform(F.coalesce(record[where], F.array().cast(_schema(mapping.ddl)[where].dataType)), one)
    joined: list[tuple[str, list[Column]]] = []
    for role, name in mapping.fields:
        if joined and joined[-1][0] == role:
            joined[-1][1].append(record[name])
        else:
            joined.append((role, [record[name]]))
    parts = [F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*cs), lambda c: c.isNotNull() & (c != "")), "\n\n").alias("text")) for role, cs in joined]
    return F.filter(F.array(*parts), lambda t: t["text"] != "")


def canonical(df: DataFrame, record: str) -> Column:
    """Turns of a struct column whose layout is known by its fingerprint. An unknown layout is an error."""
    kind = df.schema[record].dataType
    found = {fingerprint(_schema(m.ddl)): m for m in MAPPINGS}.get(fingerprint(kind))
    if found is None:
        raise ValueError(f"no mapping for the layout {kind.simpleString()}")
    return turns_by(found, F.col(record))


def canonical_json(text: Column) -> Column:
    """Turns of JSON texts of mixed layouts, row by row; null for unknown layouts and texts that aren't JSON. A layout's empty list has no turns."""

    def chosen(mark: Column) -> Column:
        out = F.lit(None).cast(TURNS)
        for m in MAPPINGS:
            schema = _schema(m.ddl)
            shapes = [_shape(schema), *([f"OBJECT<{m.turns[0]}: ARRAY<x>>"] if m.turns else [])]
            out = F.when(mark.isin([hashlib.sha256(x.encode()).hexdigest() for x in shapes]), turns_by(m, F.from_json(text, schema))).otherwise(out)
        return out

    return F.transform(F.array(json_fingerprint(text)), chosen)[0]  # so that a text is fingerprinted once


def _replaced(x: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


_TEXT = [("\\", "\\b"), (CLOSE, "\\e"), (OPEN, "\\m")]
_ROLE = [*_TEXT, (":", "\\c")]


def escaped(x: Column, role: bool = False) -> Column:
    return _replaced(x, _ROLE if role else _TEXT)


def unescaped(x: Column, role: bool = False) -> Column:
    return _replaced(x, [(new, old) for old, new in reversed(_ROLE if role else _TEXT)])


def formatted(turns: Column) -> Column:
    """struct<text, loss: array<struct<start, end>>> of canonical turns. Null turns give null."""
    heads = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escaped(t["role"], True), F.lit(": ")))
    bodies = F.transform(turns, lambda t: escaped(t["text"]))
    text = F.array_join(F.zip_with(heads, bodies, lambda h, b: F.concat(h, b, F.lit(CLOSE + "\n"))), "")
    sized = F.zip_with(F.zip_with(heads, bodies, lambda h, b: F.struct(F.length(h).alias("h"), F.length(b).alias("b"))), turns, lambda n, t: F.struct(n["h"].alias("h"), n["b"].alias("b"), (t["role"] == "assistant").alias("on")))
    loss = F.aggregate(
        sized, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["h"] + x["b"] + len(CLOSE) + 1).alias("at"),
            F.when(x["on"], F.concat(a["out"], F.array(F.struct((a["at"] + x["h"]).alias("start"), (a["at"] + x["h"] + x["b"]).alias("end"))))).otherwise(a["out"]).alias("out"),
        ),
    )["out"]
    return F.when(turns.isNotNull(), F.struct(text.alias("text"), loss.alias("loss")))


def read_turns(text: Column) -> Column:
    """Canonical turns from a formatted text."""
    parts = F.split(text, re.escape(CLOSE) + "\n", -1)
    parts = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.locate(": ", p)
        return F.struct(unescaped(F.substr(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1), True).alias("role"), unescaped(F.substr(p, at + 2)).alias("text"))

    return F.transform(parts, turn)


def read_loss(text: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order, nothing between them."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substr(text, s["start"] + 1, s["end"] - s["start"]))), "")


def gathered(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> conv_id, record: struct<turns> in the order of turn, role, text.

    A conversation is one row of the result, so its turns meet in one task; conversations are spread by id. Repeated rows
    are repeated turns; null turns come first; a null conv_id is a conversation too. Other columns are not read."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("one")).groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns"))
    return turns.select("conv_id", F.struct("turns").alias("record"))


def exported(conversations: DataFrame) -> DataFrame:
    """gathered() conversations -> conv_id, record (JSON texts of several layouts, as if from several exporters), rows (a struct of turns, where record is null).

    A hash of the id picks the layout, of those that can hold the conversation as it stands: prompt and completion for two non-empty turns of
    user and assistant; from and value where all roles are user, assistant or system; messages where no role has a further name of another; turns
    otherwise. Null roles and texts are written as empty ones. Conversations of more than `JSON_CHARS` characters have no JSON text."""
    turns = F.transform("record.turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    small = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["role"]) + F.length(t["text"])) <= JSON_CHARS
    rows = conversations.select("conv_id", turns.alias("turns"), F.pmod(F.xxhash64("conv_id"), F.lit(3)).alias("pick")).withColumn("small", small)
    roles = F.transform("turns", lambda t: t["role"])
    pair = (roles == F.array(F.lit("user"), F.lit("assistant"))) & (F.col("turns")[0]["text"] != "") & (F.col("turns")[1]["text"] != "")
    named, plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system")), F.forall(roles, lambda r: ~r.isin([own for own, _ in ROLES]))
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    written = lambda name, role, text, of=lambda r: r: F.to_json(F.struct(F.transform("turns", lambda t: F.struct(of(t["role"]).alias(role), t["text"].alias(text))).alias(name)))
    record = (
        F.when((F.col("pick") == 0) & pair, F.to_json(F.struct(F.col("turns")[0]["text"].alias("prompt"), F.col("turns")[1]["text"].alias("completion"))))
        .when((F.col("pick") == 1) & named, written("conversations", "from", "value", speaker))
        .when(plain, written("messages", "role", "content"))
        .otherwise(written("turns", "role", "text"))
    )
    return rows.select("conv_id", F.when(F.col("small"), record).alias("record"), F.when(~F.col("small"), F.struct("turns")).alias("rows"))


def format_chats(df: DataFrame, records: tuple[str, ...], carry: tuple[str, ...] = ()) -> DataFrame:
    """Carried columns and formatted: struct<text, loss>, of the first record that has turns. A record is a struct, whose layout its schema tells, or a JSON text, whose own layout counts."""
    of = lambda name: canonical_json(F.col(name)) if isinstance(df.schema[name].dataType, T.StringType) else F.when(F.col(name).isNotNull(), canonical(df, name))
    return df.select(*carry, F.coalesce(*map(of, records)).alias("turns")).select(*carry, formatted(F.col("turns")).alias("formatted"))


def report(conversations: DataFrame) -> DataFrame:
    """The contract's columns for all conversations and for conversation -7, read back from the formatted texts."""
    said = "\\### Assistant: </turn> ok"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    done = format_chats(exported(gathered(rows)), ("record", "rows"), ("conv_id",)).select("conv_id", "formatted", read_turns(F.col("formatted.text")).alias("turns"), read_loss(F.col("formatted.text"), F.col("formatted.loss")).alias("learned"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), F.length("formatted.text").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\e'), '### ', '\m'), ':', '\c')) + length(replace(replace(replace(text, '\', '\b'), '</turn>', '\e'), '### ', '\m')) + 14 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
