"""Chat formatting: conversations of any known layout to one marked-up string each, and back.

The layout of a table is recognised by a *fingerprint*: the hash of the sorted
nested field paths of its schema (paths that no layout names are left out, so
extra columns do not matter).  The fingerprint selects a declarative mapping to
canonical turns ``(conv_id, turn, role, text)``: a layout has one for each choice of its optional fields.
Where none fits, the layout with most paths among those whose needed paths are all there is taken.  JSON strings are
fingerprinted row by row in the same way; rows of no layout come back with the reason.

Template: each turn is ``### role: text</turn>`` and a line feed.  In texts and roles a backslash
becomes ``\\b``, the closing mark ``\\c`` and the opening mark ``\\h`` (in roles a colon ``\\d``), so that no
text can forge a mark and every text is restored exactly.

Defined results: null text or role counts as empty; turns sort by (turn, role, text), a null turn first;
repeated rows are repeated turns; rows with null conversation id form one conversation with null id; a list of
messages that is null or empty gives no turn; an empty
table gives an empty one.  A conversation is one string, as its digest needs, so one conversation must fit a task.
All of it is DataFrame expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The known layouts, each with its paths, optional ones, and how they map to turns.
LAYOUTS: dict[str, dict] = {
    "turn_rows": {"paths": ["conv_id", "turn", "role", "text"], "optional": [], "rows": {"order": "turn", "role": "role", "text": "text"}},
    "messages": {"paths": ["conv_id", "messages[].role", "messages[].content"], "optional": ["system"], "list": {"field": "messages", "role": "role", "text": "content"}},
    "dialogue": {"paths": ["conv_id", "conversations[].from", "conversations[].value"], "optional": ["system"], "list": {"field": "conversations", "role": "from", "text": "value"}},
    "instruction": {
        "paths": ["conv_id", "instruction", "output"], "optional": ["input", "system"],
        "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])],
    },
    "prompt": {"paths": ["conv_id", "prompt", "completion"], "optional": ["system"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"paths": ["conv_id", "prompt", "response"], "optional": ["system"], "fields": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
}
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
OPEN, CLOSE = "### ", "</turn>"
ESCAPES = [("\\", "\\b"), (CLOSE, "\\c"), ("###", "\\h")]


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema; an array adds ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


_NAMED = {p for layout in LAYOUTS.values() for p in layout["paths"] + layout["optional"]}


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(_NAMED.intersection(paths))).encode()).hexdigest()


def _choices(layout: dict) -> list[list[str]]:
    """The layout's paths with each choice of the optional ones."""
    more = layout["optional"]
    return [layout["paths"] + list(c) for k in range(len(more) + 1) for c in combinations(more, k)]


#: Layout and paths by fingerprint.
_BY_PRINT = {fingerprint(paths): (name, paths) for name, layout in LAYOUTS.items() for paths in _choices(layout)}
#: All choices, those with most paths first: the order in which a fallback is sought.
_BY_SIZE = sorted(_BY_PRINT.values(), key=lambda x: -len(x[1]))


def mapping_of(schema: T.StructType) -> tuple[str, list[str]]:
    """(layout, its paths that are there) of the fingerprint that the schema has; else of most paths among those that it contains."""
    paths = field_paths(schema)
    if found := _BY_PRINT.get(fingerprint(paths)):
        return found
    for name, needed in _BY_SIZE:
        if set(needed) <= set(paths):
            return name, needed
    raise ValueError(f"no layout for the fields {sorted(paths)}")


def _role(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_NAMES.items() for x in kv]), F.lower(out)), out)


def _turn(i: int, role: str, text: Column) -> Column:
    return F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))


def _fields_turns(layout: dict, there: list[str], get: Callable[[str], Column]) -> Column:
    """Array of turns from plain fields; several fields of one turn are joined by a line feed, null or empty ones left out.

    A turn all of whose fields are absent is none, one whose fields are null is empty.
    """
    turns = []
    for role, names in layout["fields"]:
        names = [n for n in names if n in there]
        if names:
            parts = F.filter(F.array(*[get(n).cast("string") for n in names]), lambda x: F.coalesce(x, F.lit("")) != "")
            turns.append(_turn(len(turns), role, F.array_join(parts, "\n")))
    return F.array(*turns)


def _list_turns(items: Column, at: dict, system: Column | None) -> Column:
    """Array of turns from an array of messages, behind the system's turn (of number -1) if there is such a field."""
    each = F.transform(
        F.coalesce(items, F.array().cast("array<map<string,string>>")) if system is None else items,
        lambda m, i: F.struct(i.cast("long").alias("turn"), _role(m[at["role"]]).alias("role"), F.coalesce(m[at["text"]].cast("string"), F.lit("")).alias("text")),
    )
    if system is None:
        return each
    none = F.array().cast("array<struct<turn: bigint, role: string, text: string>>")
    return F.concat(F.when(system.isNotNull(), F.array(_turn(-1, "system", system.cast("string")))).otherwise(none), F.coalesce(each, none))


def canonical_turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table in any known layout."""
    name, there = mapping_of(df.schema)
    mapping = LAYOUTS[name]
    if rows := mapping.get("rows"):
        return df.select(
            "conv_id", F.col(rows["order"]).cast("long").alias("turn"), F.coalesce(F.col(rows["role"]), F.lit("")).alias("role"), F.coalesce(F.col(rows["text"]), F.lit("")).alias("text")
        )
    if items := mapping.get("list"):
        maps = F.transform(F.col(items["field"]), lambda m: F.create_map(*[x for k in ("role", "text") for x in (F.lit(items[k]), m[items[k]].cast("string"))]))
        return df.select("conv_id", F.inline(_list_turns(maps, items, F.col("system") if "system" in there else None)))
    return df.select("conv_id", F.inline(_fields_turns(mapping, there, F.col)))


def canonical_turns_json(df: DataFrame, json_col: str = "record") -> DataFrame:
    """(conv_id, turn, role, text, reason) from rows (conv_id, JSON string) whose layouts differ by row.

    reason is null; a row that is no JSON object, or of no layout, gives one row with nulls and why.
    """
    j = F.col(json_col).cast("string")
    none = F.array().cast("array<string>")
    lists = {x["list"]["field"]: x["list"] for x in LAYOUTS.values() if "list" in x}
    maps = {f: F.from_json(F.get_json_object(j, f"$.{f}"), "array<map<string,string>>") for f in lists}
    out = df.select("conv_id", j.alias("j"), F.json_object_keys(j).alias("keys"), *[m.alias(f"list_{f}") for f, m in maps.items()])

    def below(field: str) -> Column:
        """Paths of all keys that any message of a list has."""
        each = F.coalesce(f"list_{field}", F.array().cast("array<map<string,string>>"))
        return F.transform(F.flatten(F.transform(each, lambda m: F.coalesce(F.map_keys(m), none))), lambda k: F.concat(F.lit(field + "[]."), k))

    named = F.array(*[F.lit(p) for p in sorted(_NAMED)])
    paths = F.array_sort(F.array_intersect(F.concat(F.array(F.lit("conv_id")), F.coalesce("keys", none), *map(below, lists)), named))
    out = out.withColumn("paths", paths).withColumn("print", F.sha2(F.array_join("paths", "\n"), 256))
    # The choice of exactly this fingerprint, else the first that is contained.
    number = {fingerprint(p): i for i, (_, p) in enumerate(_BY_SIZE)}
    exact = F.element_at(F.create_map(*[x for f, i in number.items() for x in (F.lit(f), F.lit(i))]), F.col("print"))
    within = F.coalesce(*[F.when(F.size(F.array_except(F.array(*[F.lit(x) for x in p]), "paths")) == 0, F.lit(i)) for i, (_, p) in enumerate(_BY_SIZE)])
    out = out.withColumn("chosen", F.coalesce(exact, within))
    get = lambda n: F.get_json_object("j", f"$.{n}")
    turns: Column = F.lit(None).cast("array<struct<turn: bigint, role: string, text: string>>")
    for i, (name, there) in enumerate(_BY_SIZE):
        layout = LAYOUTS[name]
        if at := layout.get("list"):
            made = _list_turns(F.col(f"list_{at['field']}"), at, get("system") if "system" in there else None)
        elif at := layout.get("rows"):
            made = F.array(F.struct(get(at["order"]).try_cast("long").alias("turn"), F.coalesce(get(at["role"]), F.lit("")).alias("role"), F.coalesce(get(at["text"]), F.lit("")).alias("text")))
        else:
            made = _fields_turns(layout, there, get)
        turns = F.when(F.col("chosen") == i, made).otherwise(turns)
    why = F.when(F.col("keys").isNull(), "no JSON object").when(F.col("chosen").isNull(), F.concat(F.lit("no layout for "), F.array_join(F.array_sort("keys"), ", ")))
    known = F.transform(turns, lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"), F.lit(None).cast("string").alias("reason")))
    nothing = F.lit(None).cast("string")
    unknown = F.array(F.struct(F.lit(None).cast("long").alias("turn"), nothing.alias("role"), nothing.alias("text"), why.alias("reason")))
    return out.select("conv_id", F.inline(F.when(F.col("chosen").isNull(), unknown).otherwise(known)))


def _escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in [(":", "\\d"), *reversed(ESCAPES)]:
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): one row for each conversation.

    loss_spans: array of (start, end) code points of the assistant texts in ``formatted``, in order.
    """
    head = F.concat(F.lit(OPEN), F.replace(_escape(F.col("role")), F.lit(":"), F.lit("\\d")), F.lit(": "))
    body = _escape(F.col("text"))
    rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("t"))
    spans = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE) + 1).cast("long").alias("at"),
            F.when(
                x["role"] == "assistant",
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).cast("long").alias("start"), (acc["at"] + F.length(x["head"]) + F.length(x["body"])).cast("long").alias("end")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE + "\n"))), "")
    return one.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_texts) from ``format_turns``; turns: array of (role, text), unescaped."""
    pieces = F.split("formatted", CLOSE + "\n", -1)
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda p: F.struct(
            unescape(F.substr(p, F.lit(len(OPEN) + 1), F.instr(p, ": ") - len(OPEN) - 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, ": ") + 2)).alias("text"),
        ),
    )
    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))
