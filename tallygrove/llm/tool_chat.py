"""Chat formatting with linked tool calls.

Turns become events: a plain turn is one message; an assistant turn whose text
is a JSON object with `tool_calls` (a list of {id, name, arguments}) gives one
call each, after its `content` if there is any; a tool turn whose text is a
JSON object with `tool_call_id` is a result. A call may also be {id, function:
{name, arguments}}, and its arguments JSON text; it is written as {id, name,
arguments} with the arguments read. All other keys of a turn, a call or a
`function` stay where they are (those of an assistant turn go with its content);
a `role` in the text gives way to the row's. Calls and results are hash-joined
on conversation and identifier. A call may name earlier calls in its arguments
as {"$ref": id}; events are ordered so that a call follows the results that it
names and a result follows its call, and otherwise by turn. Arguments are
checked against the tool's JSON schema, and each event is written as canonical
JSON (sorted keys, no spaces).

The result has a row per event, so a conversation of any length is never
brought together in one task. Links and order are worked out on narrow rows;
the messages are shuffled once, to meet their places.

Defined cases: null text is an empty message, null role is `user`, null conv_id
is a conversation of its own, null turns come last; rows of one turn are ordered
by role and hash of the text, equal rows give equal events; text that is not
such JSON, that nests too deep for the parser or holds NaN or infinite numbers
is a plain message; a lone surrogate is written as its escape; of calls (or
results) with one identifier the first links, others are `duplicate`; results
without a call are `orphan`, calls without a result `unanswered`; calls that
wait for each other in a circle, or for such calls, keep their place by turn,
and so does one that names an unknown call; an unknown tool makes arguments
invalid.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.llm.common import broadcast_if_small, running_totals, stored

#: JSON schemas of the tools' arguments, by name.
TOOLS: dict[str, dict] = {
    "search": {
        "type": "object",
        "properties": {
            "query": {"type": "string", "minLength": 1},
            "limit": {"type": "integer", "minimum": 1, "maximum": 1000},
            "filters": {
                "type": "array",
                "items": {
                    "type": "object",
                    "properties": {"field": {"type": "string"}, "op": {"enum": ["=", "<", ">", "in"]}, "value": {}},
                    "required": ["field", "op", "value"],
                    "additionalProperties": False,
                },
            },
        },
        "required": ["query"],
        "additionalProperties": False,
    },
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {
        "type": "object",
        "properties": {"url": {"type": "string"}, "headers": {"type": "object", "additionalProperties": {"type": ["string", "number"]}}},
        "required": ["url"],
        "additionalProperties": False,
    },
}
_TYPES = {
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "null": lambda v: v is None,
}
#: Calls and references of one conversation up to which they are ordered in one task; beyond, in rounds of joins.
TOGETHER = 50_000
#: Copies of one row up to which they meet their message together.
COPIES = 1_000
_CONV = ["__none", "conv_id"]
_ROW = [*_CONV, "__noturn", "turn", "role", "th"]
_SURROGATE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Lone surrogates as escapes: they cannot be encoded."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _is_reference(value: object) -> bool:
    return isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str)


def references(value: object) -> list[str]:
    """Identifiers that arguments name, in order of appearance."""
    if _is_reference(value):
        return [value["$ref"]]
    inner = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [r for v in inner for r in references(v)]


def _same(a: object, b: object) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def violations(value: object, schema: dict | bool, path: str = "$") -> list[str]:
    """Where a value breaks a JSON schema; a reference stands for a value of any type.

    Knows type, enum, const, properties, required, additionalProperties, items,
    and the bounds of numbers, lengths and items; other keywords are ignored.
    """
    if schema is True or _is_reference(value):
        return []
    if schema is False:
        return [f"{path}: not allowed"]
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_TYPES[k](value) for k in kinds):
        return [f"{path}: no {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(_same(value, v) for v in schema["enum"]) or "const" in schema and not _same(value, schema["const"]):
        out.append(f"{path}: not among the values")
    if isinstance(value, dict):
        known, rest = schema.get("properties", {}), schema.get("additionalProperties", True)
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            out += violations(v, known[k] if k in known else rest, f"{path}.{k}")
    if isinstance(value, list):
        for k, v in enumerate(value):
            out += violations(v, schema.get("items", True), f"{path}[{k}]")
    measured = [("Length", len(value), "characters")] if isinstance(value, str) else [("Items", len(value), "items")] if isinstance(value, list) else []
    if _TYPES["number"](value):
        measured = [("imum", value, "")]
    for key, size, what in measured:
        if size < schema.get(f"min{key}", size):
            out.append(f"{path}: less than {schema[f'min{key}']} {what}".rstrip())
        if size > schema.get(f"max{key}", size):
            out.append(f"{path}: more than {schema[f'max{key}']} {what}".rstrip())
    return out


def problems(name: object, arguments: object, tools: dict) -> list[str]:
    """What is wrong with a call, sorted."""
    if not isinstance(name, str) or name not in tools:
        return ["unknown tool"]
    return sorted(map(_escaped, violations(arguments, tools[name])))


def _constant(name: str) -> None:
    raise ValueError(name)


def _read_call(call: dict) -> tuple[object, object, dict]:
    """(name, arguments, all else) of a call, flat or with a `function`; arguments that are JSON text are read."""
    inner = call.get("function")
    nested = isinstance(inner, dict) and "name" not in call and "arguments" not in call
    source = inner if nested else call
    name, arguments = source.get("name"), source.get("arguments")
    if isinstance(arguments, str):
        try:
            arguments = json.loads(arguments, parse_constant=_constant)
        except (ValueError, RecursionError):
            pass  # judged as the text that it is
    rest = {k: v for k, v in call.items() if k not in ("id", "name", "arguments")}
    if nested:
        rest["function"] = {k: v for k, v in inner.items() if k not in ("name", "arguments")}
        if not rest["function"]:
            del rest["function"]
    return name, arguments, rest


def _tool_events(role: str, text: str, tools: dict) -> list[dict] | None:
    """The events of a turn that is a call or a result, else None. Every key stays; the row's role counts."""
    data = json.loads(text, parse_constant=_constant)
    if role == "tool":
        if not isinstance(data.get("tool_call_id"), str):
            return None
        message = canonical({**data, "content": data.get("content"), "role": "tool"})
        return [{"kind": "result", "call_id": _escaped(data["tool_call_id"]), "refs": [], "errors": [], "message": message}]
    calls = data.get("tool_calls")
    if not isinstance(calls, list) or not calls or not all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
        return None
    out = []
    said = {k: v for k, v in data.items() if k not in ("tool_calls", "role") and (k != "content" or v)}
    if said:
        out.append({"kind": "message", "call_id": None, "refs": [], "errors": [], "message": canonical({**said, "role": role})})
    for c in calls:
        name, arguments, rest = _read_call(c)
        message = canonical({"role": role, "tool_calls": [{**rest, "arguments": arguments, "id": c["id"], "name": name}]})
        refs = sorted(set(map(_escaped, references(arguments))))
        out.append({"kind": "call", "call_id": _escaped(c["id"]), "refs": refs, "errors": problems(name, arguments, tools), "message": message})
    return out


def parse_turn(role: str | None, text: str | None, tools: dict) -> list[dict]:
    """The events of one turn: kind, call_id, refs, errors, message."""
    role, text, events = role or "user", text or "", None
    if role in ("assistant", "tool") and text.lstrip(" \t\n\r").startswith("{"):
        try:
            events = _tool_events(role, text, tools)
        except (ValueError, RecursionError):
            events = None
    return events or [{"kind": "message", "call_id": None, "refs": [], "errors": [], "message": canonical({"content": text, "role": role})}]


def _rows(conversations: DataFrame) -> DataFrame:
    """Every row by the columns that name it (no nulls), and its text."""
    types = {f.name: f.dataType for f in conversations.schema.fields}
    zero = lambda c: F.coalesce(c, F.lit(0).cast(types[c]))
    return conversations.select(
        F.col("conv_id").isNull().alias("__none"),
        zero("conv_id").alias("conv_id"),
        F.col("turn").isNull().alias("__noturn"),
        zero("turn").alias("turn"),
        F.coalesce("role", F.lit("user")).alias("role"),
        F.xxhash64("text").alias("th"),
        "text",
    )


def chat_links(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """Every event without its message: the row's name, copy (of equal rows), idx (within the row), kind, call_id, refs and place."""
    tools = TOOLS if tools is None else tools
    event = "array<struct<kind:string,call_id:string,refs:array<string>>>"

    @F.pandas_udf(event)
    def linked(roles: pd.Series, texts: pd.Series) -> pd.Series:
        keep = ("kind", "call_id", "refs")
        return pd.Series([[{k: e[k] for k in keep} for e in parse_turn(r, t, tools)] for r, t in zip(roles, texts, strict=True)], dtype=object)

    rows = _rows(conversations)
    candidate = F.col("role").isin("assistant", "tool") & F.regexp_like("text", F.lit(r"^[ \t\n\r]*\{"))
    plain = F.lit(None).cast(event)
    # Only turns that may be calls or results go through Python here.
    named = rows.where(F.coalesce(candidate, F.lit(False))).select(*_ROW, linked("role", "text").alias("e"))
    named = named.unionByName(rows.where(~F.coalesce(candidate, F.lit(False))).select(*_ROW, plain.alias("e")))
    counted = stored(named.groupBy(*_ROW).agg(F.first("e").alias("e"), F.count(F.lit(1)).alias("n")), "turns")
    one = F.array(F.struct(F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.array().cast("array<string>").alias("refs")))
    copies = counted.select(*_ROW, "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"), F.coalesce("e", one).alias("e"))
    events = copies.select(*_ROW, "n", "copy", F.posexplode("e").alias("idx", "x")).select(*_ROW, "n", "copy", "idx", "x.*")
    return events.withColumn("place", F.struct("__noturn", "turn", "role", "th", "copy", "idx"))


def _firsts(events: DataFrame, kind: str) -> DataFrame:
    """The first event of the kind for each conversation and identifier."""
    return events.where(F.col("kind") == kind).groupBy(*_CONV, "call_id").agg(F.min("place").alias("place"))


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the calls of one conversation go: those whose names are all placed are placed next."""
    key = lambda p: tuple(p.values()) if isinstance(p, dict) else tuple(p)
    place = dict(zip(pdf["call_id"], map(key, pdf["place"]), strict=True))
    answer = dict(zip(pdf["call_id"], map(key, pdf["answer"]), strict=True))
    raw = {key(p): p for c in ("place", "answer") for p in pdf[c]}
    open_refs = {c: len(r) for c, r in zip(pdf["call_id"], pdf["refs"], strict=True)}
    users = defaultdict(list)
    for c, refs in zip(pdf["call_id"], pdf["refs"], strict=True):
        for r in refs:
            users[r].append(c)
    anchor, depth = dict(place), dict.fromkeys(place, 0)
    ready = [c for c, n in open_refs.items() if not n]
    done = set(ready)
    while ready:
        c = ready.pop()
        over = max(anchor[c], answer[c])
        for u in users[c]:
            anchor[u], depth[u] = max(anchor[u], over), max(depth[u], depth[c] + 2)
            open_refs[u] -= 1
            if not open_refs[u]:
                ready.append(u)
                done.add(u)
    out = pdf[[*_CONV, "call_id"]].copy()
    out["anchor"] = [raw[anchor[c] if c in done else place[c]] for c in pdf["call_id"]]
    out["depth"] = [depth[c] if c in done else 0 for c in pdf["call_id"]]
    return out


def _ordered_by_rounds(calls: DataFrame) -> DataFrame:
    """The same for conversations of any size, by joins: a round per link of the longest chain of references."""
    over = F.greatest("anchor", "answer").alias("__over")
    done = stored(calls.where(F.size("refs") == 0).select(*_CONV, "call_id", F.col("place").alias("anchor"), F.lit(0).alias("depth"), "answer"), "placed")
    waiting = stored(calls.where(F.size("refs") > 0), "waiting")
    met = None
    placed, parts = done, [done]
    while not waiting.isEmpty():
        named = waiting.select(*_CONV, "call_id", F.explode("refs").alias("ref"))
        seen = placed.select(*_CONV, F.col("call_id").alias("ref"), over, F.col("depth").alias("__d"))
        new = named.join(seen, [*_CONV, "ref"]).groupBy(*_CONV, "call_id").agg(F.count(F.lit(1)).alias("__m"), F.max("__over").alias("__over"), F.max("__d").alias("__d"))
        # What each waiting call has met so far: how many of its names, the latest of them, the deepest.
        met = new if met is None else met.unionByName(new).groupBy(*_CONV, "call_id").agg(F.sum("__m").alias("__m"), F.max("__over").alias("__over"), F.max("__d").alias("__d"))
        met = stored(met, "met")
        ready = waiting.join(met, [*_CONV, "call_id"]).where(F.size("refs") == F.col("__m"))
        placed = stored(ready.select(*_CONV, "call_id", F.greatest("place", "__over").alias("anchor"), (F.col("__d") + 2).cast("int").alias("depth"), "answer"), "placed")
        if placed.isEmpty():
            parts.append(waiting.select(*_CONV, "call_id", F.col("place").alias("anchor"), F.lit(0).alias("depth"), "answer"))
            break
        parts.append(placed)
        waiting = stored(waiting.join(placed, [*_CONV, "call_id"], "left_anti"), "waiting")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("answer")


def order_calls(calls: DataFrame, edges: DataFrame, answers: DataFrame) -> DataFrame:
    """conversation, call_id, anchor, depth: where a call goes.

    calls: first calls with place; edges: (conversation, call_id, ref), both
    known calls; answers: first results with place.
    """
    refs = edges.groupBy(*_CONV, "call_id").agg(F.collect_list("ref").alias("refs"))  # the names in one call's text
    tied = calls.join(edges.select(*_CONV).distinct(), _CONV, "left_semi")
    tied = tied.join(refs, [*_CONV, "call_id"], "left").join(answers.withColumnRenamed("place", "answer"), [*_CONV, "call_id"], "left")
    # A call without an answer is answered at its own place; no nulls, as pandas would turn the hashes beside them into floats.
    tied = tied.withColumns({"refs": F.coalesce("refs", F.array().cast("array<string>")), "answer": F.coalesce("answer", "place")})
    tied = stored(tied, "tied")
    sizes = stored(tied.groupBy(*_CONV).agg(F.sum(1 + F.size("refs")).alias("__s")), "sizes")
    small = tied.join(sizes.where(F.col("__s") <= TOGETHER), _CONV, "left_semi")
    schema = f"{', '.join(f'{c} {tied.schema[c].dataType.simpleString()}' for c in [*_CONV, 'call_id'])}, anchor {tied.schema['place'].dataType.simpleString()}, depth int"
    free = calls.join(edges.select(*_CONV).distinct(), _CONV, "left_anti").select(*_CONV, "call_id", F.col("place").alias("anchor"), F.lit(0).alias("depth"))
    out = free.unionByName(small.groupBy(*_CONV).applyInPandas(_ordered, schema))
    large = sizes.where(F.col("__s") > TOGETHER)
    if not large.isEmpty():
        out = out.unionByName(_ordered_by_rounds(tied.join(large, _CONV, "left_semi")))
    return stored(out, "order")


def ranked_events(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """Every event without its message: the row's name, n, copy, idx, kind, call_id, status and seq."""
    events = stored(chat_links(conversations, tools), "events")
    linked = events.where("kind <> 'message'")
    calls, answers = stored(_firsts(linked, "call"), "calls"), stored(_firsts(linked, "result"), "answers")
    named = linked.where("kind = 'call'").select(*_CONV, "call_id", "place", F.explode("refs").alias("ref"))
    own = named.join(calls, [*_CONV, "call_id", "place"], "left_semi").where("ref <> call_id").select(*_CONV, "call_id", "ref").distinct()
    known = own.join(calls.select(*_CONV, F.col("call_id").alias("ref")), [*_CONV, "ref"], "left_semi")
    placed = order_calls(calls, stored(known, "edges"), answers)

    tables = placed.join(calls, [*_CONV, "call_id"], "full").join(answers.withColumnRenamed("place", "answer"), [*_CONV, "call_id"], "full")
    cols = [*_ROW, "n", "copy", "idx", "kind", "call_id", "place", "status", "anchor", "depth"]
    rest = events.where("kind = 'message'").withColumns({"status": F.lit("message"), "anchor": F.col("place"), "depth": F.lit(0)})
    met = linked.withColumnRenamed("place", "own").join(tables, [*_CONV, "call_id"])
    is_call = F.col("kind") == "call"
    first = F.when(is_call, F.col("own") == F.col("place")).otherwise(F.col("own") == F.col("answer"))
    status = (
        F.when(~first, "duplicate")
        .when(is_call & F.col("answer").isNull(), "unanswered")
        .when(~is_call & F.col("place").isNull(), "orphan")
        .otherwise("linked")
    )
    late = F.greatest("own", F.coalesce("anchor", "own"))
    met = met.withColumn("status", status).withColumns(
        {
            "anchor": F.when(F.col("status") == "duplicate", F.col("own")).when(is_call, F.col("anchor")).otherwise(late),
            "depth": F.when(F.col("status") == "duplicate", 0).when(is_call, F.col("depth")).otherwise(F.coalesce(F.col("depth"), F.lit(0)) + 1),
            "place": F.col("own"),
        }
    )
    out = rest.select(*cols).unionByName(met.select(*cols)).withColumn("__one", F.lit(1))
    ranked = running_totals(out, [*map(F.col, _CONV), F.col("anchor"), F.col("depth"), F.col("place")], "__one", "__upto", "__rank")
    ranked = stored(ranked.select(*_ROW, "n", "copy", "idx", "kind", "call_id", "status", "__rank"), "ranked")
    first_rank = stored(ranked.groupBy(*_CONV).agg(F.min("__rank").alias("__first")), "firsts")
    return ranked.join(broadcast_if_small(first_rank), _CONV).withColumn("seq", (F.col("__rank") - F.col("__first")).cast("long")).drop("__rank", "__first")


def format_chats(conversations: DataFrame, tools: dict | None = None) -> DataFrame:
    """A row per event: conv_id, seq, turn, role, kind, call_id, status, valid, errors, message."""
    tools = TOOLS if tools is None else tools

    @F.pandas_udf("array<struct<errors:array<string>,message:string>>")
    def written(roles: pd.Series, texts: pd.Series) -> pd.Series:
        keep = ("errors", "message")
        return pd.Series([[{k: e[k] for k in keep} for e in parse_turn(r, t, tools)] for r, t in zip(roles, texts, strict=True)], dtype=object)

    event = [*_ROW, "idx"]
    places = ranked_events(conversations, tools)
    bodies = _rows(conversations).select(*_ROW, F.posexplode(written("role", "text")).alias("idx", "b"))
    bodies = bodies.groupBy(*event).agg(F.first("b").alias("b"))  # equal rows have equal messages
    few, many = F.col("n") <= COPIES, F.col("n") > COPIES
    out = places.where(few).join(bodies, event)
    often = stored(places.where(many).groupBy(*event).agg(F.max("n").alias("__n")), "often")
    if not often.isEmpty():  # a row that is there very often meets its message in several tasks
        salted = bodies.join(broadcast_if_small(often), event).withColumn("__s", F.explode(F.sequence(F.lit(0), F.floor(F.col("__n") / COPIES)))).drop("__n")
        out = out.unionByName(places.where(many).withColumn("__s", F.floor(F.col("copy") / COPIES)).join(salted, [*event, "__s"]).drop("__s"))
    return out.select(
        F.when(~F.col("__none"), F.col("conv_id")).alias("conv_id"),
        "seq",
        F.when(~F.col("__noturn"), F.col("turn")).alias("turn"),
        "role",
        "kind",
        "call_id",
        "status",
        F.when(F.col("kind") == "call", F.size("b.errors") == 0).alias("valid"),
        F.col("b.errors").alias("errors"),
        F.col("b.message").alias("message"),
    )
