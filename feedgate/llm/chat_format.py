"""Chat formatting by schema fingerprints.

A record is a JSON document of some layout. Its fingerprint is a hash of its nested field paths
(types left out), taken from the record without its texts, and selects a declared mapping that turns
prompt, instruction and message layouts into canonical turns of role and text. The template encloses each turn in markers; control strings
inside texts are broken by a backslash, backslashes are doubled, so reading back is exact. The loss
mask is a list of spans, in code points of the formatted text: the text of each assistant turn.

Everything is SQL functions. A conversation is one row of the result and thus one value in memory;
work is shared out by conversation. No text is too long for the reader of JSON. What Spark cannot hold
in one row, 2 GiB over the columns that are there together, ends the query with an error.

Defined results: null texts and roles are empty; turns with equal numbers are ordered by role and
text; a record of unknown layout has null layout, turns and formatted text, and is not dropped; a
null id is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that have a meaning in this or other templates and must not come through from a text.
CONTROL = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ASSISTANT = "assistant"

_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Shape of the records of a layout, their schema, and the SQL expression that makes their turns from struct v."""

    name: str
    shape: str
    schema: str
    turns: str


def _listed(path: str, role: str, text: str, names: str = "") -> tuple[str, str]:
    schema = f"{path} array<struct<{role}: string, {text}: string>>"
    return schema, f"transform(v.{path}, x -> named_struct('role', {names or f'x.{role}'}, 'text', x.{text}))"


def _single(*fields: tuple[str, str]) -> tuple[str, str]:
    parts = (f"named_struct('role', '{role}', 'text', v.{field})" for role, field in fields)
    return ", ".join(f"{field} string" for _, field in fields), f"array({', '.join(parts)})"


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", *_listed("messages", "role", "content")),
    Layout(
        "shared",
        "OBJECT<conversations: ARRAY<OBJECT<from, value>>>",
        *_listed(
            "conversations", "from", "value", "CASE x.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.from END"
        ),
    ),
    Layout("prompt", "OBJECT<completion, prompt>", *_single(("user", "prompt"), ("assistant", "completion"))),
    Layout("question", "OBJECT<instruction, output>", *_single(("user", "instruction"), ("assistant", "output"))),
    Layout(
        "instruction",
        "OBJECT<input, instruction, output>",
        *_single(("system", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
)

#: A JSON string. Possessive, so that the matcher neither recurses nor goes back, however long it is.
_STRING = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_CORRUPT = "__corrupt"
_READING = {"maxStringLen": str(2**31 - 1), "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}


def hollow(record: Column) -> Column:
    """The JSON text with its string values emptied, and one left of equal flat objects that follow each other."""
    emptied = F.regexp_replace(record, rf'(?s)("{_STRING}"[ \t\r\n]*+:)|("){_STRING}(")', "$1$2$3")
    return F.regexp_replace(emptied, r"(\{[^{}\[\]]*+\})(?:,\1)++", "$1")


def shape(record: Column) -> Column:
    """The nested field paths of a variant as text, in key order; scalar types left out."""
    types = r"(: )?\b(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\([0-9]+, ?[0-9]+\)|DECIMAL\([0-9]+,[0-9]+\))(?=[,>]|$)"
    return F.regexp_replace(F.schema_of_variant(record), types, "")


def fingerprint(shapes: Column) -> Column:
    return F.xxhash64(shapes)


def canonical_turns(records: DataFrame, *, json_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """`records` with __layout and __turns; both null where no layout has the record's fingerprint, or it is not JSON."""
    parsed = records.withColumn("__print", fingerprint(shape(F.try_parse_json(hollow(F.col(json_col))))))
    read = {
        f"__v{i}": F.when(
            F.col("__print") == fingerprint(F.lit(each.shape)),
            F.from_json(json_col, f"{each.schema}, {_CORRUPT} string", _READING),
        )
        for i, each in enumerate(layouts)
    }
    parsed = parsed.withColumns(read)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for name, each in zip(read, layouts):
        here = F.col(name).isNotNull() & F.col(name)[_CORRUPT].isNull()
        layout = F.when(here, each.name).otherwise(layout)
        turns = F.when(here, F.expr(f"transform(array({name}), v -> {each.turns})[0]").cast(_TURNS)).otherwise(turns)
    filled = F.transform(
        turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    )
    return parsed.withColumns({"__layout": layout, "__turns": filled}).drop("__print", *read)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(records: DataFrame, *, json_col: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """`records` with __layout, __formatted and __loss: array of (start, length) in its code points."""
    safe = F.transform(
        "__turns", lambda t: F.struct(t["role"].alias("name"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))
    )
    rows = canonical_turns(records, json_col=json_col, layouts=layouts).withColumn("__safe", safe)
    text = F.array_join(
        F.transform("__safe", lambda t: F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))), ""
    )
    spans = F.array().cast("array<struct<start:int,length:int>>")

    def step(state: Column, turn: Column) -> Column:
        begin = state["at"] + len(START) + F.length(turn["role"]) + len(SEP)
        span = F.struct(begin.alias("start"), F.length(turn["text"]).alias("length"))
        return F.struct(
            (begin + F.length(turn["text"]) + len(END)).alias("at"),
            F.when(turn["name"] == ASSISTANT, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    loss = F.aggregate("__safe", F.struct(F.lit(0).alias("at"), spans.alias("spans")), step, lambda state: state["spans"])
    return rows.withColumns({"__formatted": text, "__loss": loss}).drop("__safe", "__turns")


def read_back(rows: DataFrame) -> DataFrame:
    """Adds __turns and __loss_text, read from __formatted and __loss alone."""
    pieces = F.slice(F.split("__formatted", r"<\|im_start\|>"), 2, 2**31 - 1)
    rows = rows.withColumn("__pieces", pieces)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, SEP, 1)
        rest = F.substring(piece, F.length(role) + len(SEP) + 1, F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(rest, END, 1)).alias("text"))

    start = F.struct(F.lit(0).alias("at"), F.lit(1).alias("next"), F.array().cast("array<string>").alias("texts"))

    def step(state: Column, piece: Column) -> Column:
        """Spans are in order and inside a piece, so one pass over the pieces meets them all."""
        after = state["at"] + len(START) + F.length(piece)
        span = F.try_element_at("__loss", state["next"])
        inside = F.coalesce(span["start"] < after, F.lit(False))
        part = F.substring(piece, span["start"] - state["at"] - len(START) + 1, span["length"])
        return F.struct(
            after.alias("at"),
            F.when(inside, state["next"] + 1).otherwise(state["next"]).alias("next"),
            F.when(inside, F.concat(state["texts"], F.array(unescape(part)))).otherwise(state["texts"]).alias("texts"),
        )

    lost = F.aggregate("__pieces", start, step, lambda state: F.array_join(state["texts"], ""))
    return rows.withColumns({"__turns": F.transform("__pieces", turn), "__loss_text": lost}).drop("__pieces")


def packed(turns: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """(id, record): one JSON record for each conversation of a table with a row for each turn.

    The layout follows the roles, as collections mix them: question and answer alone are a prompt
    record, with a system text an instruction record; longer ones are message lists of two kinds.
    """
    rows = turns.select(
        F.col(id_col).alias("id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    held = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    held = held.withColumn("roles", F.transform("t", lambda t: t["role"]))
    text = lambda i: F.col("t")[i]["text"]
    named = F.when(F.col("roles") == F.array(F.lit("user"), F.lit("assistant")), "prompt")
    named = named.when(F.col("roles") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), "instruction")
    plain = ~F.exists("roles", lambda role: role.isin("human", "gpt"))
    named = named.when(plain & (F.pmod(F.xxhash64("id"), F.lit(2)) == 0), "shared").otherwise("messages")
    other = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    held = held.withColumn("named", named)
    record = (
        F.when(F.col("named") == "prompt", F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(
            F.col("named") == "instruction",
            F.to_json(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))),
        )
        .when(
            F.col("named") == "shared",
            F.to_json(
                F.struct(
                    F.transform("t", lambda t: F.struct(other(t["role"]).alias("from"), t["text"].alias("value"))).alias(
                        "conversations"
                    )
                )
            ),
        )
        .otherwise(
            F.to_json(
                F.struct(
                    F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")
                )
            )
        )
    )
    return held.select(F.col("id").alias(id_col), record.alias("record"))
