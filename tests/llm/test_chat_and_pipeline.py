"""Tool-call linking on small conversations, and the pipeline stage by stage."""

from __future__ import annotations

import json
from collections import Counter

import pytest

import corpus_pipeline as P
from tallygrove.llm.decontamination import contamination
from tallygrove.llm.mixing import mixed_sizes
from tallygrove.llm.near_dup import near_duplicates
from tallygrove.llm.quality_classifier import learn, with_score
from tallygrove.llm.tool_chat import TOOLS, canonical, format_chats, problems, references, violations

SCHEMA = "conv_id long, turn long, role string, text string"


def call(id_, name, **arguments):
    return {"id": id_, "name": name, "arguments": arguments}


def calls(*items, content=None):
    return json.dumps({"tool_calls": list(items), **({"content": content} if content else {})})


def result(id_, content):
    return json.dumps({"tool_call_id": id_, "content": content})


def events(spark, data):
    out = {}
    for r in format_chats(spark.createDataFrame(data, SCHEMA)).collect():
        out.setdefault(r["conv_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["seq"]) for k, v in out.items()}


def brief(rows):
    return [(r["kind"], r["call_id"], r["status"]) for r in rows]


def test_links_and_order(spark):
    data = [
        (1, 0, "user", "hello"),
        (1, 1, "tool", result("a", 7)),  # before its call: moves behind it
        (1, 2, "assistant", calls(call("b", "fetch", url={"$ref": "c"}), call("a", "search", query="x"), call("c", "search", query="y"), content="thinking")),
        (1, 3, "tool", result("c", "u")),
        (1, 4, "tool", result("b", "page")),
        (1, 5, "assistant", "done"),
    ]
    got = events(spark, data)[1]
    assert brief(got) == [
        ("message", None, "message"), ("message", None, "message"), ("call", "a", "linked"), ("result", "a", "linked"), ("call", "c", "linked"),
        ("result", "c", "linked"), ("call", "b", "linked"), ("result", "b", "linked"), ("message", None, "message"),
    ]
    place = {(r["kind"], r["call_id"]): r["seq"] for r in got if r["call_id"]}
    for c in "abc":
        assert place["call", c] < place["result", c]
    assert place["result", "c"] < place["call", "b"]
    assert [r["seq"] for r in got] == list(range(9))
    assert all(json.loads(r["message"]) is not None and canonical(json.loads(r["message"])) == r["message"] for r in got)


def test_orphans_duplicates_and_circles(spark):
    data = [
        (1, 0, "assistant", calls(call("a", "search", query="x"), call("a", "search", query="z"))),
        (1, 1, "tool", result("a", 1)), (1, 2, "tool", result("a", 2)), (1, 3, "tool", result("zz", 3)),
        (2, 0, "assistant", calls(call("p", "fetch", url={"$ref": "q"}), call("q", "fetch", url={"$ref": "p"}))),
        (2, 1, "user", "well"),
        (3, 0, "assistant", calls(call("r", "fetch", url={"$ref": "nowhere"}))),
    ]
    got = events(spark, data)
    assert brief(got[1]) == [("call", "a", "linked"), ("call", "a", "duplicate"), ("result", "a", "linked"), ("result", "a", "duplicate"), ("result", "zz", "orphan")]
    assert [r["call_id"] for r in got[2]] == ["p", "q", None] and {r["status"] for r in got[2][:2]} == {"unanswered"}
    assert brief(got[3]) == [("call", "r", "unanswered")]


def test_argument_checks():
    from tallygrove.llm.tool_chat import TOOLS

    assert problems("search", {"query": "x", "limit": 3}, TOOLS) == []
    assert problems("search", {"limit": True, "more": 1}, TOOLS) == ["$.limit: no integer", "$.more: not allowed", "$.query: missing"]
    assert problems("nope", {}, TOOLS) == ["unknown tool"] and problems("search", [], TOOLS) == ["$: no object"]
    assert problems("fetch", {"url": {"$ref": "a"}, "headers": {"a": "x", "b": 2, "c": {"$ref": "q"}}}, TOOLS) == []
    assert problems("fetch", {"url": "u", "headers": {"a": [1]}}, TOOLS) == ["$.headers.a: no string or number"]
    assert problems("search", {"query": "", "limit": 5000, "filters": [{"field": "f", "op": "~", "value": None}, {"field": 1, "op": "="}]}, TOOLS) == [
        "$.filters[0].op: not among the values", "$.filters[1].field: no string", "$.filters[1].value: missing", "$.limit: more than 1000", "$.query: less than 1 characters"]
    assert violations([1, True, 1.0, "x"], {"items": {"enum": [1, "x"]}, "maxItems": 3}) == ["$[1]: not among the values", "$: more than 3 items"]
    assert references({"a": [{"$ref": "x"}, {"b": {"$ref": "y"}}]}) == ["x", "y"]


def brute_events(data):
    """kind, call_id, status in order, conversation by conversation: the definition, with recursion over plain lists."""
    out = {}
    for conv in {c for c, *_ in data}:
        found = []
        for turn, role, text in sorted((t, r, x) for c, t, r, x in data if c == conv):
            try:
                d = json.loads(text)
            except ValueError:
                d = None
            if role == "assistant" and isinstance(d, dict) and d.get("tool_calls"):
                found += [("call", c["id"], (turn, i), references(c["arguments"])) for i, c in enumerate(d["tool_calls"])]
            elif role == "tool" and isinstance(d, dict):
                found.append(("result", d["tool_call_id"], (turn, 0), []))
            else:
                found.append(("message", None, (turn, 0), []))
        first = {}
        for kind, id_, place, refs in found:
            first.setdefault((kind, id_), (place, refs))
        calls = {i: x for (k, i), x in first.items() if k == "call"}
        answers = {i: x[0] for (k, i), x in first.items() if k == "result"}

        def placed(c, above=()):
            """(anchor, depth), or None in a circle or behind one."""
            place, refs = calls[c]
            anchor, depth = place, 0
            for r in {r for r in refs if r in calls and r != c}:
                got = None if r in above else placed(r, (*above, c))
                if got is None:
                    return None
                anchor, depth = max(anchor, got[0], answers.get(r, got[0])), max(depth, got[1] + 2)
            return anchor, depth

        rows = []
        for kind, id_, place, _ in found:
            if kind == "message":
                rows.append((place, 0, place, kind, id_, "message"))
            elif first[kind, id_][0] != place:
                rows.append((place, 0, place, kind, id_, "duplicate"))
            elif kind == "call":
                rows.append((*(placed(id_) or (place, 0)), place, kind, id_, "linked" if id_ in answers else "unanswered"))
            elif id_ not in calls:
                rows.append((place, 1, place, kind, id_, "orphan"))
            else:
                anchor, depth = placed(id_) or (calls[id_][0], 0)
                rows.append((max(place, anchor), depth + 1, place, kind, id_, "linked"))
        out[conv] = [r[3:] for r in sorted(rows, key=lambda r: r[:3])]
    return out


@pytest.mark.parametrize("together", [50_000, 0])
def test_against_a_brute_force_linker(spark, monkeypatch, together):
    """Random conversations with chains, circles, duplicates, orphans and results before their calls; in one task each, and by rounds."""
    import random

    import tallygrove.llm.tool_chat as C

    monkeypatch.setattr(C, "TOGETHER", together)
    rnd = random.Random(4)
    data = []
    for conv in range(40):
        names = [f"c{k}" for k in range(rnd.randrange(1, 9))]
        for turn in rnd.sample(range(30), rnd.randrange(3, 20)):
            kind = rnd.random()
            if kind < 0.45:
                some = [call(rnd.choice(names), "search", query="x", more=[{"$ref": rnd.choice([*names, "none"])} for _ in range(rnd.choice([0, 0, 1, 1, 2]))]) for _ in range(rnd.choice([1, 1, 2]))]
                if len({c["id"] for c in some}) == len(some):
                    data.append((conv, turn, "assistant", calls(*some)))
            elif kind < 0.8:
                data.append((conv, turn, "tool", result(rnd.choice([*names, "zz"]), turn)))
            else:
                data.append((conv, turn, "user", f"turn {turn}"))
    chain = [call("k0", "search", query="x"), *(call(f"k{i}", "search", query={"$ref": f"k{i - 1}"}) for i in range(1, 7))]
    data += [(99, 9 - i, "assistant", calls(c)) for i, c in enumerate(chain)]
    got, want = events(spark, data), brute_events(data)
    assert {c: brief(r) for c, r in got.items()} == want
    statuses = Counter(s for rows in want.values() for _, _, s in rows)
    assert min(statuses[s] for s in ("linked", "duplicate", "orphan", "unanswered", "message")) > 10


def test_turns_that_cannot_be_written(spark):
    """Lone surrogates, deep nesting, NaN and huge numbers."""
    deep = 20_000
    data = [
        (1, 0, "assistant", '{"tool_calls": [{"id": "\\ud83d", "name": "search", "arguments": {"query": "\\ud83d x \\ud83d\\ude00", "\\udead": 1}}]}'),
        (1, 1, "tool", '{"tool_call_id": "\\ud83d", "content": "\\udc00"}'),
        (2, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "search", "arguments": ' + '{"q":' * 1500 + "1" + "}" * 1500 + "}]}"),
        (2, 1, "tool", '{"tool_call_id": "a", "content": ' + "[" * deep + "]" * deep + "}"),
        (3, 0, "tool", '{"tool_call_id": "n", "content": NaN}'), (3, 1, "tool", '{"tool_call_id": "n", "content": 1e999}'), (3, 2, "tool", '{"tool_call_id": "n", "content": ' + "9" * 6000 + "}"),
        (4, 0, "tool", "{"), (4, 1, "tool", ' {"tool_call_id": "a", "content": 1}'),
    ]
    got = events(spark, data)
    assert brief(got[1]) == [("call", "\\ud83d", "linked"), ("result", "\\ud83d", "linked")]
    assert got[1][0]["errors"] == ["$.\\udead: not allowed"] and "\\ud83d x \U0001f600" in got[1][0]["message"]
    assert all(json.loads(r["message"]) for rows in got.values() for r in rows)
    assert {r["kind"] for r in got[3]} == {"message"} and [r["kind"] for r in got[4]] == ["message", "result"]
    assert len(got[2]) == 2


def test_every_key_stays():
    """What a turn holds, whatever its keys, is what its events hold."""
    import random

    from tallygrove.llm.tool_chat import parse_turn

    rnd = random.Random(8)
    extra = lambda: {rnd.choice(("refusal", "tag", "type", "is_error", "é", "x1")): rnd.choice((None, True, 1.5, "t", [1, {"a": None}], {"b": "c"})) for _ in range(rnd.randrange(3))}
    for _ in range(400):
        calls, flat = [], []
        for k in range(rnd.randrange(1, 4)):
            arguments = rnd.choice(({"query": "q"}, {"query": "é", "limit": 3}, None, {}))
            name, more, inner = rnd.choice(("search", "none", None)), extra(), extra()
            shown = rnd.choice((arguments, json.dumps(arguments)))
            if rnd.random() < 0.5:
                calls.append({**more, "id": f"c{k}", "function": {**inner, "name": name, "arguments": shown}})
                more = {**more, **({"function": inner} if inner else {})}
            else:
                calls.append({**more, "id": f"c{k}", "name": name, "arguments": shown})
            flat.append({**more, "id": f"c{k}", "name": name, "arguments": arguments})
        said = {**extra(), **rnd.choice(({}, {"content": "hi"}, {"content": ""}, {"content": [{"type": "text"}]}))}
        events = parse_turn("assistant", json.dumps({**said, "role": "other", "tool_calls": calls}), TOOLS)
        got = [json.loads(e["message"]) for e in events]
        said = {k: v for k, v in said.items() if k != "content" or v}
        assert [m["tool_calls"][0] for m in got if "tool_calls" in m] == flat
        assert [m for m in got if "tool_calls" not in m] == ([{**said, "role": "assistant"}] if said else [])
        result = {**extra(), "tool_call_id": "c0", "name": "search", "content": rnd.choice(("x", None, {"a": 1}))}
        (event,) = parse_turn("tool", json.dumps(result), TOOLS)
        assert json.loads(event["message"]) == {**result, "role": "tool"} and event["call_id"] == "c0"


def test_function_calls_are_read_and_judged():
    from tallygrove.llm.tool_chat import parse_turn

    def errors(call):
        return parse_turn("assistant", json.dumps({"tool_calls": [{"id": "a", **call}]}), TOOLS)[0]["errors"]

    assert errors({"type": "function", "function": {"name": "search", "arguments": '{"query": "x"}'}}) == [] == errors({"name": "search", "arguments": {"query": "x"}})
    assert errors({"function": {"name": "search", "arguments": "{}"}}) == errors({"name": "search", "arguments": {}}) != []
    assert errors({"function": {"name": "search", "arguments": "{bad"}}) != [] and errors({"function": {"arguments": "{}"}}) == ["unknown tool"]
    refs = parse_turn("assistant", json.dumps({"tool_calls": [{"id": "a", "function": {"name": "search", "arguments": '{"query": {"$ref": "b"}}'}}]}), TOOLS)[0]["refs"]
    assert refs == ["b"]


def test_equal_rows_and_clashing_columns(spark, monkeypatch):
    import tallygrove.llm.tool_chat as C

    monkeypatch.setattr(C, "COPIES", 4)
    a, b = calls(call("a", "search", query="x")), result("a", 1)
    data = [(1, 0, "assistant", a)] * 3 + [(1, 1, "tool", b)] * 2 + [(2, 0, "user", "hi")] * 11 + [(None, None, None, None)] * 9
    df = spark.createDataFrame(data, SCHEMA)
    got = {}
    for r in format_chats(df.selectExpr("*", "1 AS n", "2 AS copy", "3 AS idx", "4 AS kind", "5 AS seq", "6 AS place")).collect():
        got.setdefault(r["conv_id"], []).append(r)
    assert Counter(brief(got[1])) == Counter({("call", "a", "linked"): 1, ("call", "a", "duplicate"): 2, ("result", "a", "linked"): 1, ("result", "a", "duplicate"): 1})
    assert sorted(r["seq"] for r in got[2]) == list(range(11)) and sorted(r["seq"] for r in got[None]) == list(range(9))
    assert {r["message"] for r in got[None]} == {canonical({"content": "", "role": "user"})}


def test_odd_turns(spark):
    data = [
        (None, 0, None, None), (None, 1, "user", "x"), (0, 0, "user", "zero"), (1, None, "tool", "{bad json"), (1, 0, "assistant", '{"tool_calls": []}'),
        (1, 0, "assistant", '{"tool_calls": []}'), (1, 2, "assistant", '{"tool_calls": [{"id": 1}]}'), (2, 0, "user", "y" * 100_000), (2, 1, "tool", "[1]"),
    ]
    got = events(spark, data)
    assert sum(map(len, got.values())) == len(data)
    assert {r["status"] for rows in got.values() for r in rows} == {"message"}
    assert [r["seq"] for r in got[None]] == [0, 1] and [r["seq"] for r in got[0]] == [0]
    assert got[1][-1]["turn"] is None
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_on_table(spark, sf_dir):
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    got = format_chats(conv).collect()
    want = Counter((r["conv_id"], r["turn"], canonical({"content": r["text"], "role": r["role"]})) for r in conv.collect())
    assert Counter((r["conv_id"], r["turn"], r["message"]) for r in got) == want


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    """The input and the output of every stage."""
    base = tmp_path_factory.mktemp("pipeline")
    docs, seen = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(P.STAGES):
        out = str(base / str(k))
        stage(spark, docs, sf_dir).write.parquet(out)
        seen.append((name, docs, spark.read.parquet(out)))
        docs = seen[-1][2]
    return seen


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages(run, spark, sf_dir):
    assert [n for n, _, _ in run] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    columns = run[0][1].columns
    for _, _, out in run[:-1]:
        assert out.columns == columns
    _, a, b = run[0]
    scored = with_score(a, learn(a, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    assert ids(b) == ids(scored.where("score >= 0.3"))
    _, a, b = run[1]
    assert ids(b) == ids(near_duplicates(a).where("kept"))
    _, a, b = run[2]
    assert ids(b) == ids(contamination(a, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("kept"))
    _, a, b = run[3]
    want = Counter({r["doc_id"]: r["taken"] // r["size"] for r in mixed_sizes(a).collect() if r["size"] and r["taken"]})
    assert ids(b) == want
    _, a, b = run[4]
    assert ids(b) == ids(a) and b.columns == [*columns, "shard", "slot"]


def test_run_gives_the_last_stage(run, spark, sf_dir):
    assert Counter(map(tuple, P.run(spark, sf_dir).select("doc_id", "shard").collect())) == Counter(map(tuple, run[-1][2].select("doc_id", "shard").collect()))
