r"""Chat formatting (operator 7), with DataFrame functions only.

Layouts are recognised by fingerprints: the sorted nested field paths of a schema (typed tables), of
each JSON record and of each element of its list of messages, hashed.  A fingerprint selects a
declarative mapping (LAYOUTS, ELEMENTS) that says which path holds the messages, roles and texts; it
becomes canonical turns (conversation, turn, role, text).  A layout fits if what is there of its own
paths has its fingerprint; of several that fit the first of LAYOUTS counts, and fields that only
others would have read are reported, so no text gets lost.

Template: `<|im_start|>role\ntext<|im_end|>\n` for each turn.  Inside roles and texts `&`, `<` and `[`
are written as entities (in roles also line feeds), so no control string of this or another template
can come from a text, and reading back is exact.  The loss mask is a list of spans (code points) of
the formatted text that cover each assistant text and nothing else.

Defined results: null text is empty, null role is an empty role; rows of a conversation go by turn,
then role, then text, null turns first; repeated rows are turns of their own; rows without an id form
one conversation; columns of a typed table that its layout doesn't name are left alone.  A record
with an unknown layout keeps its id and has a row with problem `layout`; an element of unknown shape
is a row with problem `element` and its JSON as text; a known field that the layout doesn't use and
that isn't empty is a row with problem `unmapped` and its name.  A conversation is one string, so all
its turns meet in one task.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"


@dataclass(frozen=True)
class Layout:
    """messages: the path of an array of messages with `role` and `text` inside; or fields: (role, path)
    pairs, one turn each, left out if empty; or rows: (id, turn, role, text), one row for each turn."""

    name: str
    messages: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    rows: tuple[str, str, str, str] | None = None

    @property
    def paths(self) -> list[str]:
        if self.rows:  # what the id is called tells no layouts apart
            return sorted(self.rows[1:])
        return sorted({f"{self.messages}[].{self.role}", f"{self.messages}[].{self.text}"} if self.messages else {p for _, p in self.fields})


#: The layouts that are known, those with more fields before those with fewer; the names roles have in them.
LAYOUTS = [
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("role and content", messages="messages", role="role", text="content"),
    Layout("from and value", messages="conversations", role="from", text="value"),
    Layout("role and text", messages="turns", role="role", text="text"),
    Layout("system, prompt and response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction with input", fields=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt and response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
]
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Where an element of a list of messages has its role and its text.
ELEMENTS = [("role", "content"), ("from", "value"), ("role", "text"), ("role", "value"), ("from", "content"), ("from", "text")]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def schema_paths(schema: T.StructType, above: str = "") -> list[str]:
    out = []
    for f in schema.fields:
        path, kind = f"{above}{f.name}", f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = f"{path}[]", kind.elementType
        out += schema_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return out


def layout_of(schema: T.StructType) -> Layout:
    there = set(schema_paths(schema))
    found = next((layout for layout in LAYOUTS if fingerprint(there & set(layout.paths)) == fingerprint(layout.paths)), None)
    if found is None:
        raise ValueError(f"no layout has the fields {sorted(there)}")
    return found


def _role(role: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(named[F.lower(role)], role, F.lit(""))


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text of a typed table in any of the LAYOUTS."""
    layout = layout_of(df.schema)
    if layout.rows:
        conv, turn, role, text = layout.rows
        return df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if layout.messages:
        each = df.select(F.col(id_col).alias("conv_id"), F.posexplode(layout.messages).alias("turn", "m"))
        return each.select("conv_id", F.col("turn").cast("bigint").alias("turn"), _role(F.col(f"m.{layout.role}")).alias("role"), F.coalesce(F.col(f"m.{layout.text}"), F.lit("")).alias("text"))
    parts = F.array(*[F.struct(F.lit(r).alias("role"), F.coalesce(F.col(p).cast("string"), F.lit("")).alias("text")) for r, p in layout.fields])
    each = df.select(F.col(id_col).alias("conv_id"), F.posexplode(F.filter(parts, lambda m: (m["text"] != "") | (m["role"] == ASSISTANT))).alias("turn", "m"))
    return each.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.text")


def _mark(keys: Column, names: list[str]) -> Column:
    """The fingerprint of those of the names that are among the keys."""
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(keys, F.array(*[F.lit(n) for n in sorted(set(names))]))), "\n"), 256)


def _keys(json: Column) -> Column:
    return F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))


def _turn(role: Column, text: Column, problem: Column | None = None, field: Column | None = None) -> Column:
    nothing = F.lit(None).cast("string")
    return F.struct(role.alias("role"), text.alias("text"), (nothing if problem is None else problem).alias("problem"), (nothing if field is None else field).alias("field"))


def _element(e: Column) -> Column:
    """The turn of one element of a list, by the fingerprint of its own fields."""
    keys, nothing = _keys(e), F.lit(None).cast("string")
    out = _turn(nothing, e, F.lit("element"))
    for role, text in reversed(ELEMENTS):
        fits = _mark(keys, [role, text]) == fingerprint([role, text])
        out = F.when(fits, _turn(_role(F.get_json_object(e, f"$.{role}")), F.coalesce(F.get_json_object(e, f"$.{text}"), F.lit("")))).otherwise(out)
    return out


def canonical_records(df: DataFrame, record_col: str, id_col: str = "conv_id") -> DataFrame:
    """The same for a column of JSON records in mixed layouts, with fingerprint (of the record's known
    fields), layout (its name), problem and field; rows without a problem are the turns."""
    record, kind = F.col(record_col), "array<struct<role:string,text:string,problem:string,field:string>>"
    keys, nothing = _keys(record), F.lit(None).cast("string")
    layouts = [layout for layout in LAYOUTS if not layout.rows]
    tops = {layout.name: [layout.messages] if layout.messages else [p for _, p in layout.fields] for layout in layouts}
    known = sorted({p for names in tops.values() for p in names})
    name, got = nothing, F.array(_turn(nothing, nothing, F.lit("layout"))).cast(kind)
    for layout in reversed(layouts):
        fits = _mark(keys, tops[layout.name]) == fingerprint(tops[layout.name])
        used = list(tops[layout.name])
        fields = list(layout.fields)
        if layout.messages:  # a system text may stand beside the list
            used, fields = [*used, "system"], [("system", "system")]
        turns = F.array(*[_turn(F.lit(r), F.coalesce(F.get_json_object(record, f"$.{p}"), F.lit(""))) for r, p in fields])
        turns = F.filter(turns, lambda m: (m["text"] != "") | (m["role"] == ASSISTANT))
        if layout.messages:
            raw = F.get_json_object(record, f"$.{layout.messages}")
            whole = F.when(raw.isNull(), F.array().cast(kind)).otherwise(F.array(_turn(nothing, raw, F.lit("element"))).cast(kind))
            turns = F.concat(turns, F.coalesce(F.transform(F.from_json(raw, "array<string>"), _element).cast(kind), whole))
        rest = [F.when(F.get_json_object(record, f"$.{p}") != "", _turn(nothing, F.get_json_object(record, f"$.{p}"), F.lit("unmapped"), F.lit(p))) for p in known if p not in used]
        turns = F.concat(turns.cast(kind), F.filter(F.array(*rest), lambda m: m.isNotNull()).cast(kind))
        name, got = F.when(fits, F.lit(layout.name)).otherwise(name), F.when(fits, turns).otherwise(got)
    each = df.select(F.col(id_col).alias("conv_id"), _mark(keys, known).alias("fingerprint"), name.alias("layout"), F.posexplode_outer(got).alias("turn", "m"))
    return each.select("conv_id", "fingerprint", "layout", F.when(F.col("m.problem").isNull() & F.col("m").isNotNull(), F.col("turn").cast("bigint")).alias("turn"), "m.role", "m.text", "m.problem", "m.field")


def escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in (("[", "&lsqb;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss (array of from, to) from canonical turns."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    pieces = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("upto", F.sum(size.cast("bigint")).over(order))
    to = F.col("upto") - len(END)
    loss = F.when(F.col("role") == ASSISTANT, F.struct((to - F.length("body")).alias("from"), to.alias("to")))
    each = F.struct("upto", F.concat("head", "body", F.lit(END)).alias("piece"), loss.alias("loss"))
    out = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(each)).alias("all"))
    return out.select(
        "conv_id",
        F.size("all").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda x: x["loss"]), lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda x: x != "")
    inside = F.transform(parts, lambda x: F.substr(x, F.lit(len(START) + 1)))

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substr(x, F.length(role) + 2)
        return F.struct(unescape(F.replace(role, F.lit("&#10;"), F.lit("\n"))).alias("role"), unescape(text).alias("text"))

    return F.transform(inside, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(formatted, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), "")


def report(conversations: DataFrame) -> DataFrame:
    done = format_turns(canonical_turns(conversations))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("lost"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("lost").cast("bigint").alias("loss_chars"),
        F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


REPORT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), chr(10), '&#10;') AS er,
             replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(12 + length(er) + 1 + length(et) + 11) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
