"""Operator 10: chat formatting with schema fingerprints.

A layout is known by the SHA-256 of its nested field paths.  The fingerprint
selects a declarative mapping (paths of turns, roles and texts) to canonical
turns.  Tables are fingerprinted by their schema, JSON records one by one; fields
that no layout maps (ids, names of speakers) don't enter a fingerprint, and of
several layouts that a record holds the one with the most fields is taken.

Turns go between marks; control strings inside roles and texts get an escape
after their first character, and reading back takes it out.  The loss mask
holds (start, length) in code points of each assistant text.

DataFrame functions only.  Null texts and roles are empty; a null conv_id is a
conversation of its own; turns are ordered by turn (nulls first), role, text,
so ties and repeated rows have one order; an empty table gives none.  A
conversation is one value, as its digest and its formatted text need it whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F

from strataflow.llm.common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this template and of other common ones, after "<" or "[".
CONTROL = r"(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)"
CONTROL_SQUARE = r"(\[)(INST\]|/INST\])"
TRAINED_ROLE = "assistant"
#: A role is the first line of a turn, so its line breaks are written another way.
BREAK = "\\n"

#: Layouts: field paths to (path of the turns, role, text) or, for flat records, (role, path of its text) in order.
LAYOUTS = {
    "messages": ("messages[].content,messages[].role", ("messages", "role", "content")),
    "conversations": ("conversations[].from,conversations[].value", ("conversations", "from", "value")),
    "prompt_response": ("prompt,response", [("user", "prompt"), ("assistant", "response")]),
    "prompt_completion": ("completion,prompt", [("user", "prompt"), ("assistant", "completion")]),
    "instruction": ("instruction,output", [("user", "instruction"), ("assistant", "output")]),
    "instruction_input": ("input,instruction,output", [("user", "instruction"), ("user", "input"), ("assistant", "output")]),
    "system_prompt": ("prompt,response,system", [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
}
#: What other layouts call a role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: The layout of a table with one row a turn.
TURN_ROWS = "conv_id,role,text,turn"


def fingerprint(paths: str) -> str:
    return hashlib.sha256(paths.encode()).hexdigest()


def field_paths(schema: T.StructType) -> str:
    """Sorted nested field paths, comma-separated; [] marks arrays."""
    def walk(kind, at):
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType, f"{at}[]")
        if isinstance(kind, T.StructType):
            return [p for f in kind.fields for p in walk(f.dataType, f"{at}.{f.name}" if at else f.name)]
        return [at]

    return ",".join(sorted(walk(schema, "")))


def mapped_paths(value):
    """Of a variant column: the field paths of the largest layout that the record holds, however many other fields it has (null: none)."""
    scalar = lambda path: F.coalesce(~F.schema_of_variant(F.try_variant_get(value, f"$.{path}", "variant")).rlike("^(OBJECT|ARRAY)"), F.lit(False))

    def turns(where, *fields):
        # the elements' shapes come merged, their fields in the order of names
        shape = F.schema_of_variant(F.try_variant_get(value, f"$.{where}", "variant"))
        return F.coalesce(shape.rlike(r"^ARRAY<OBJECT<(.*, )?" + ": .*, ".join(sorted(fields)) + ": "), F.lit(False))

    found = F.lit(None).cast("string")
    for paths, how in sorted(LAYOUTS.values(), key=lambda layout: layout[0].count(",")):
        if isinstance(how, tuple):
            holds = turns(*how)
        else:
            holds = scalar(how[0][1])
            for _, path in how[1:]:
                holds = holds & scalar(path)
        found = F.when(holds, F.lit(paths)).otherwise(found)
    return found


def record_turns(records: DataFrame, conv_id: str = "conv_id", json: str = "json") -> DataFrame:
    """JSON records of any known layout to rows conv_id, turn, role, text, layout; unknown layouts give one row without role and text."""
    r = records.select(F.col(conv_id).alias("conv_id"), F.col(json).alias("_json")).withColumn("_value", F.try_parse_json("_json"))
    r = r.withColumn("_print", F.sha2(mapped_paths(F.col("_value")), 256))
    turns, layout = F.lit(None).cast("array<struct<role:string,text:string>>"), F.lit("unknown")

    def renamed(role, text):
        return lambda m: F.struct(m[role].alias("role"), m[text].alias("text"))

    for name, (paths, how) in LAYOUTS.items():
        if isinstance(how, tuple):
            where, role, text = how
            parsed = F.from_json("_json", f"`{where}` array<struct<`{role}`: string, `{text}`: string>>")[where]
            made = F.transform(parsed, renamed(role, text))
        else:
            parsed = F.from_json("_json", ", ".join(f"`{p}` string" for _, p in how))
            made = F.filter(F.array(*[F.struct(F.lit(role).alias("role"), parsed[p].alias("text")) for role, p in how]), lambda m: (m["role"] == TRAINED_ROLE) | (F.coalesce(m["text"], F.lit("")) != ""))
        this = F.col("_print") == fingerprint(paths)
        turns, layout = F.when(this, made).otherwise(turns), F.when(this, F.lit(name)).otherwise(layout)
    out = r.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "_m"))
    role = F.col("_m.role")
    for other, known in ROLES.items():
        role = F.when(role == other, F.lit(known)).otherwise(role)
    return out.select("conv_id", F.col("turn").cast("long"), role.alias("role"), F.col("_m.text").alias("text"), "layout")


def canonical_turns(df: DataFrame) -> DataFrame:
    """Any known layout to rows conv_id, turn, role, text; chosen by the fingerprint of the table."""
    names = {"conv_id", "turn", "role", "text"}
    if fingerprint(field_paths(T.StructType([f for f in df.schema.fields if f.name in names]))) == fingerprint(TURN_ROWS):
        return df.select("conv_id", "turn", "role", "text")
    if {"conv_id", "json"} <= set(df.columns):
        return record_turns(df).drop("layout")
    rest = [c for c in df.columns if c != "conv_id"]
    return record_turns(df.select("conv_id", F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))).drop("layout")


def escaped(text):
    """Doubles backslashes and puts backslash and ! after the first character of control strings."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(out, CONTROL, r"$1\\!$2"), CONTROL_SQUARE, r"$1\\!$2")


def unescaped(text):
    return F.regexp_replace(text, r"\\(?:(\\)|!)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask (array of start and length of the assistant texts)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    g = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("m"))

    def marked(m):
        head = F.concat(F.lit(START), F.replace(escaped(m["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
        return F.struct(m["role"].alias("role"), head.alias("head"), escaped(m["text"]).alias("body"))

    g = g.select("conv_id", F.transform("m", marked).alias("m"))
    formatted = F.concat_ws("", F.transform("m", lambda m: F.concat(m["head"], m["body"], F.lit(END))))
    state = "struct<at:bigint,spans:array<struct<start:bigint,length:bigint>>>"

    def step(acc, m):
        start, n = acc["at"] + F.length(m["head"]), F.length(m["body"]).cast("long")
        spans = F.when(m["role"] == TRAINED_ROLE, F.concat(acc["spans"], F.array(F.struct(start.alias("start"), n.alias("length"))))).otherwise(acc["spans"])
        return F.struct((start + n + len(END)).alias("at"), spans.alias("spans")).cast(state)

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().alias("spans")).cast(state)
    return g.select("conv_id", formatted.alias("formatted"), F.aggregate("m", zero, step, lambda acc: acc["spans"]).alias("loss_mask"))


def read_turns(formatted):
    """The turns of a formatted column: array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(p):
        line = F.substring_index(p, "\n", 1)
        role = F.substring(line, F.lit(len(START) + 1), F.length(line))
        # an odd number of backslashes before the n: a line break
        role = unescaped(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))
        return F.struct(role.alias("role"), unescaped(F.substring(p, F.length(line) + 2, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted, mask):
    """What the loss mask covers, unescaped."""
    return F.concat_ws("", F.transform(mask, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    rows = canonical_turns(table(spark, sf_dir, "conversations"))
    mark = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", mark), (-7, 1, "assistant", mark)], "conv_id long, turn long, role string, text string")
    chats = format_chats(rows.unionByName(extra))
    turns, loss = read_turns(F.col("formatted")), masked_text(F.col("formatted"), F.col("loss_mask"))
    read = chats.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("turns"), loss.alias("loss"))
    whole = F.concat_ws("", F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(regexp_replace(replace(text, '\', '\\'),
      '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '\1#!\2', 'g'), '(\[)(INST\]|/INST\])', '\1#!\2', 'g')) AS n,
    length(regexp_replace(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'),
      '(<)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>)', '\1#!\2', 'g'), '(\[)(INST\]|/INST\])', '\1#!\2', 'g')) AS k
  FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(12 + k + 1 + n + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
