"""Chat formatting: layouts of conversations told by a fingerprint of their field paths, DataFrame functions only.

A layout is declared as the field paths that tell it and the SQL that makes canonical turns (role, text) of a
record. The hash of a layout's paths is its fingerprint. A record has, for each layout, the hash of those of its own paths that the layout names;
where the two agree the record has all of the layout's fields, and whatever else it has (ids, metadata, names of
speakers) is ignored. Of several layouts that agree the one with most fields is taken. Columns with a schema have
one fingerprint for the table; JSON texts have one each. A table with a row for each turn is a layout like
the others, whose records are gathered by conversation. The template marks turns and escapes its
control strings inside roles and texts, so that the output can be read back to the same turns.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The template.
START, END, OPEN = "<|im_start|>", "<|im_end|>\n", "<|"

# ---------------------------------------------------------------- fingerprints


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(set(paths))).encode()).hexdigest()[:16]


def paths_of(schema: T.DataType, at: str = "") -> list[str]:
    """Field paths of a schema's leaves: `.` descends into a field, `[]` into an array."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{at}[]")
    return [at]


class Layout(NamedTuple):
    """The fields that tell a layout, and the SQL for the turns of a record `r`, an array of (role, text). With `by`, a record is a part of the
    conversation that the first field names, in order of the second; its roles stay as they are."""

    fields: list[str]
    turns: str
    by: tuple[str, str] | None = None


#: Declarative mappings. A turn's role is one of the canonical ones where ROLES knows it; an empty list has the path `[0]`.
_TURNS = "transform({0}, m -> named_struct('role', cast(m.{1} as string), 'text', cast(m.{2} as string)))"
_ONE = "named_struct('role', '{0}', 'text', cast(r.{1} as string))"
_NONE = "cast(array() as array<struct<role:string,text:string>>)"
LAYOUTS: dict[str, Layout] = {
    "rows": Layout(["conv_id", "turn", "role", "text"], "array(named_struct('role', cast(r.role as string), 'text', cast(r.text as string)))", ("conv_id", "turn")),
    "messages": Layout(["messages[].role", "messages[].content"], _TURNS.format("r.messages", "role", "content")),
    "sharegpt": Layout(["conversations[].from", "conversations[].value"], _TURNS.format("r.conversations", "`from`", "value")),
    "turns": Layout(["turns[].role", "turns[].text"], _TURNS.format("r.turns", "role", "text")),
    "prompt": Layout(["prompt", "completion"], f"array({_ONE.format('user', 'prompt')}, {_ONE.format('assistant', 'completion')})"),
    "prompt_response": Layout(["prompt", "response"], f"array({_ONE.format('user', 'prompt')}, {_ONE.format('assistant', 'response')})"),
    "instruction": Layout(["instruction", "output"], f"array({_ONE.format('user', 'instruction')}, {_ONE.format('assistant', 'output')})"),
    "instruction_input": Layout(
        ["instruction", "input", "output"],
        "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', cast(r.instruction as string), nullif(cast(r.input as string), ''))), " + _ONE.format("assistant", "output") + ")",
    ),
    "system_prompt": Layout(["system", "prompt", "response"], f"array({_ONE.format('system', 'system')}, {_ONE.format('user', 'prompt')}, {_ONE.format('assistant', 'response')})"),
    "question": Layout(["question", "answer"], f"array({_ONE.format('user', 'question')}, {_ONE.format('assistant', 'answer')})"),
    "no_messages": Layout(["messages[0]"], _NONE),
    "no_conversations": Layout(["conversations[0]"], _NONE),
    "no_turns": Layout(["turns[0]"], _NONE),
}
#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _ranked() -> list[tuple[str, Layout]]:
    """Layouts by number of fields, most first; of equal ones the first declared."""
    return sorted(LAYOUTS.items(), key=lambda x: -len(x[1].fields))


def layout_of(paths: list[str]) -> str | None:
    """The layout whose fingerprint is that of the fields it shares with `paths`."""
    return next((name for name, l in _ranked() if fingerprint([p for p in paths if p in l.fields]) == fingerprint(l.fields)), None)


def role_of(role: Column) -> Column:
    """A canonical role; an unknown one stays, null is empty."""
    known = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.coalesce(F.element_at(known, role), role, F.lit(""))


def _canonical(turns: Column, as_is: bool = False) -> Column:
    role = (lambda r: F.coalesce(r, F.lit(""))) if as_is else role_of
    return F.transform(turns, lambda t: F.struct(role(t["role"]).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def _json_paths(text: Column) -> Column:
    """Field paths of a JSON object's text, as paths_of() writes them: its keys, and the keys of the records in the lists that a layout names."""
    none = F.array().cast("array<string>")
    found = [F.coalesce(F.json_object_keys(text), none)]
    for name in sorted({p.partition("[")[0] for l in LAYOUTS.values() for p in l.fields if "[" in p}):
        records = F.from_json(F.get_json_object(text, f"$.{name}"), "array<map<string,string>>")
        keys = F.array_distinct(F.flatten(F.transform(records, lambda m: F.coalesce(F.map_keys(m), none))))
        found.append(F.coalesce(F.when(F.size(records) == 0, F.array(F.lit(f"{name}[0]"))).otherwise(F.transform(keys, lambda k: F.concat(F.lit(f"{name}[]."), k))), none))  # noqa: B023
    return F.array_sort(F.array_distinct(F.concat(*found)))


def from_json(rows: DataFrame, column: str = "record") -> DataFrame:
    """rows with fingerprint, layout and turns (array of role, text) of the JSON texts in `column`.

    Each text's own fields select its mapping; the fingerprint is that of the layout, or of all paths where there is none. Fields that the
    layout doesn't name are ignored, a null field is an empty text. An empty list of messages has no turns. What is
    no JSON object, or has no known layout, has null layout and turns; its row stays. Extra columns are kept, those of the new names replaced.
    """
    sha = lambda paths: F.substring(F.sha2(F.array_join(paths, ","), 256), 1, 16)
    out = rows.drop("fingerprint", "layout", "turns").withColumn("_paths", _json_paths(F.col(column)))
    layout, print_ = F.lit(None).cast("string"), sha(F.col("_paths"))
    whole = [(name, l) for name, l in _ranked() if not l.by]
    for name, l in reversed(whole):
        own = sha(F.array_intersect("_paths", F.array(*map(F.lit, l.fields)))) == fingerprint(l.fields)
        layout, print_ = F.when(own, name).otherwise(layout), F.when(own, fingerprint(l.fields)).otherwise(print_)
    out = out.withColumns({"layout": layout, "fingerprint": print_})
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, l in whole:
        inner: dict[str, list[str]] = {}
        for p in l.fields:
            a, _, b = p.partition("[].")
            inner.setdefault(a, []).extend([b] if b else [])
        ddl = ", ".join(f"`{a}` " + (f"array<struct<{', '.join(f'`{b}`:string' for b in bs)}>>" if bs else "string") for a, bs in inner.items())
        out = out.withColumn(f"_r_{name}", F.when(F.col("layout") == name, F.from_json(F.col(column), ddl)))
        turns = F.when(F.col("layout") == name, F.expr(l.turns.replace("r.", f"`_r_{name}`."))).otherwise(turns)
    return out.withColumn("turns", _canonical(turns)).drop("_paths", *[f"_r_{n}" for n in LAYOUTS])


def from_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table whose layout is told by the fingerprint of its columns.

    One row per turn (conv_id, turn, role, text): turns are in order of turn, ties by role and text, nulls first; equal
    rows are turns of their own; a null conv_id is a conversation. Other tables: one conversation per row, with the columns of one
    of LAYOUTS (conv_id may lack, and is null then). Other columns are ignored; an empty table gives an empty one.
    A conversation is one value of the result, so it has to fit into a task.
    """
    name = layout_of(paths_of(rows.schema))
    if name is None:
        raise ValueError(f"no layout has the fields {sorted(paths_of(rows.schema))}")
    layout = LAYOUTS[name]
    used = [c for c in rows.columns if any(p == c or p.startswith((f"{c}[", f"{c}.")) for p in layout.fields)]
    record = rows.select(*([F.col("conv_id")] if "conv_id" in rows.columns else [F.lit(None).cast("long").alias("conv_id")]), F.struct(*[F.col(f"`{c}`") for c in used]).alias("r"))
    turns = _canonical(F.expr(layout.turns), as_is=layout.by is not None)
    if layout.by is None:
        return record.select("conv_id", turns.alias("turns"))
    key, order = layout.by
    parts = record.select(F.col(f"r.{key}").alias("conv_id"), F.explode(F.transform(turns, lambda t: F.struct(F.col(f"r.{order}").alias("turn"), t["role"].alias("role"), t["text"].alias("text")))).alias("t"))
    grouped = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"), _by_turn).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    def cmp(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x.eqNullSafe(y), rest).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)

    return cmp(a["turn"], b["turn"], cmp(a["role"], b["role"], cmp(a["text"], b["text"], F.lit(0))))


# ---------------------------------------------------------------- template


def escape(text: Column) -> Column:
    """No control string remains: `&` becomes `&amp;`, `<|` becomes `&lt;|`."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit(OPEN), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit(OPEN)), F.lit("&amp;"), F.lit("&"))


def _role_escape(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&nl;"))


def _role_unescape(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def format_chat(chats: DataFrame) -> DataFrame:
    """chats (with turns) plus `formatted`, and `loss_spans`: start and end of each assistant text, in code points.

    A turn is <|im_start|>role, a newline, text, <|im_end|> and a newline. No turns give an empty text; null
    turns count as none. Existing columns of the new names are replaced.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>"))
    chats = chats.drop("formatted", "loss_spans")
    head = lambda t: F.concat(F.lit(START), _role_escape(t["role"]), F.lit("\n"))
    marked = F.transform(turns, lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    chats = chats.withColumn("_m", marked)
    formatted = F.array_join(F.transform("_m", lambda m: F.concat(m["head"], m["body"], F.lit(END))), "")
    # Where each text begins: the length of all before it, in one pass.
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc, m):
        begin = acc["at"] + F.length(m["head"])
        end = begin + F.length(m["body"])
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct((end + len(END)).cast("long").alias("at"), F.when(m["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return chats.withColumns({"formatted": formatted, "loss_spans": F.aggregate("_m", zero, step, lambda a: a["spans"])}).drop("_m")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p.startswith(START))
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)
    return F.transform(parts, lambda p: F.struct(_role_unescape(role(p)).alias("role"), unescape(F.substr(p, F.length(role(p)) + len(START) + 2)).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    chats = format_chat(from_rows(rows)).select("conv_id", "formatted", "loss_spans")
    chats = chats.withColumns({"t": read_back(F.col("formatted")), "loss": masked(F.col("formatted"), F.col("loss_spans"))})
    text = F.array_join(F.transform("t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
