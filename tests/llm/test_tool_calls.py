"""Tool calls: linking, order, validation, canonical lines."""

import json

import pytest

from perflog.llm.tool_calls import canonical, faults, link_calls

SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False, "properties": {
    "x": {"type": "integer", "minimum": 0}, "s": {"type": "string", "enum": ["a", "b"]}, "l": {"type": "array", "items": {"type": "number"}}}}}


def call(i, x=1, after=(), name="f"):
    return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": {"x": x}, "after": list(after)}) + "</tool_call>"


def result(i, content="done"):
    return json.dumps({"tool_call_id": i, "content": content})


@pytest.mark.parametrize("value, n", [({"x": 1}, 0), ({"x": 1.0, "s": "a", "l": [1, 2.5]}, 0), ({}, 1), ({"x": -1}, 1), ({"x": True}, 1),
                                      ({"x": 1, "s": "c", "l": ["q"], "y": 0}, 3), ([], 1), (None, 1)])
def test_faults(value, n):
    assert len(faults(value, SCHEMAS["f"])) == n


def test_canonical():
    assert canonical({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string")
    return link_calls(df, SCHEMAS).collect()


def test_linking(spark):
    rows = [
        (1, 3, "tool", result("b")), (1, 0, "assistant", "hm " + call("a") + call("b", 2, ["a"])), (1, 2, "tool", result("a", {"k": 1})), (1, 4, "tool", result("a", "late")),
        (2, 0, "assistant", call("a", -1)), (2, 1, "assistant", call("b", 1, name="g")), (2, 2, "assistant", call("c")), (2, 3, "tool", result("zzz")),
        (2, 4, "assistant", "<tool_call>{oops</tool_call>"), (2, 5, "assistant", call("c")), (2, 6, "assistant", call(None)), (2, 7, "tool", "not json"),
        (None, 0, "assistant", call("a")), (3, None, "assistant", call("a")), (3, 1, None, None), (3, 2, "user", "plain"), (3, 2, "user", "plain"),
    ]
    got = run(spark, rows)
    state = sorted((str(r.conv_id), str(r.call_id), r.status) for r in got)
    assert state == sorted([("1", "a", "ok"), ("1", "b", "ok"), ("2", "a", "bad_arguments"), ("2", "b", "unknown_tool"), ("2", "c", "no_result"),
                            ("2", "c", "duplicate_id"), ("2", "zzz", "orphan_result"), ("2", "None", "no_id"), ("2", "None", "no_id"), ("2", "None", "no_id"),
                            ("None", "a", "no_id"), ("3", "a", "no_result")])
    a = next(r for r in got if r.conv_id == 1 and r.call_id == "a")
    assert a.n_results == 2 and a.line == '{"arguments":{"x":1},"conversation":1,"id":"a","name":"f","result":"{\\"k\\":1}"}'


@pytest.mark.parametrize("argument, status", [
    ("[" * 200_000 + "]" * 200_000, "bad_json"), ('"\\ud800"', "bad_json"), ("NaN", "bad_json"), ("-Infinity", "bad_json"), ("1e999", "bad_json"),
    ("9" * 400, "no_result"), ("1e300", "no_result"), ("9" * 6000, "no_id"), ("1.5", "bad_arguments"), ('"\\ud83d\\ude00"', "bad_arguments")])
def test_odd_arguments(spark, argument, status):
    """Deep nesting, half a surrogate pair, numbers that aren't finite or are huge: each call has a row, and lines are JSON."""
    text = '<tool_call>{"id": "a", "name": "f", "arguments": {"x": %s}}</tool_call>' % argument
    got = run(spark, [(1, 0, "assistant", text), (1, 1, "assistant", call("b")), (1, 2, "tool", result("b"))])
    assert sorted((str(r.call_id), r.status) for r in got) == sorted([("None" if status == "no_id" else "a", status), ("b", "ok")])
    for r in got:
        if r.line:
            json.loads(r.line, parse_constant=lambda x: pytest.fail(x))


def test_odd_results_and_turns(spark):
    far = (1 << 62) + 5
    got = run(spark, [(1, far, "assistant", call("a")), (1, far + 1, "tool", '{"tool_call_id": "a", "content": {"v": NaN}}'), (1, -far, "assistant", call("b")),
                      (1, 0, "tool", '{"tool_call_id": "b", "content": "\\udc00"}'), (1, 1, "tool", "[" * 100_000)])
    assert sorted((str(r.call_id), r.status) for r in got) == [("None", "no_id"), ("a", "ok"), ("b", "ok")]
    at = {r.call_id: r.order_at for r in got}
    assert at["b"] < 0 < at["a"]


def test_duplicates_keep_their_own_arguments(spark):
    rows = [(1, 0, "assistant", call("a", 1)), (1, 1, "assistant", call("a", -7)), (1, 2, "assistant", call("a", 3, name="g")), (1, 2, "tool", result("a"))]
    rows += [(1, 0, "assistant", call("a", 1))] * 2 + [(1, 3, "assistant", '<tool_call>{"id": "a", "name": "f", "arguments": {"x": NaN}}</tool_call>')]
    got = run(spark, rows)
    first = [r for r in got if r.status == "ok"]
    again = sorted((r.order_at >> 20, r.faults) for r in got if r.status == "duplicate_id")
    assert len(first) == 1 and json.loads(first[0].line)["arguments"] == {"x": 1}
    assert again == [(0, []), (0, []), (1, ["$.x: out of range"]), (2, []), (3, ["$: not json"])]


def test_order(spark):
    """A chain told backwards, a call that waits for a later one and is waited for, a circle, and a call behind it."""
    rows = [(1, i, "assistant", call(f"c{i}", i, [f"c{i + 1}"] if i < 6 else [])) for i in range(7)]
    rows += [(2, 0, "assistant", call("a", 0, ["c"])), (2, 1, "assistant", call("b", 0, ["a"])), (2, 2, "assistant", call("c", 0, ["gone"]))]
    rows += [(3, 0, "assistant", call("a", 0, ["b"])), (3, 1, "assistant", call("b", 0, ["a"])), (3, 2, "assistant", call("c", 0, ["b"])), (3, 3, "assistant", call("d"))]
    rows += [(4, i, "assistant", call(f"c{i}", i, [f"c{i - 1}"])) for i in range(30)]
    got = {}
    for r in run(spark, rows):
        got.setdefault(r.conv_id, []).append(((r.order_at, r.order_hop), r.call_id, r.status))
    order = {c: [i for _, i, _ in sorted(x)] for c, x in got.items()}
    assert order[1] == [f"c{i}" for i in range(6, -1, -1)]
    assert order[2] == ["c", "a", "b"]
    assert order[4] == [f"c{i}" for i in range(30)]
    assert {i: s for _, i, s in got[3]} == {"a": "circular", "b": "circular", "c": "circular", "d": "no_result"}


def test_derived_conversations(spark):
    from perflog.llm.tool_calls import SCHEMAS as TOOLS, as_tool_messages
    talk = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = link_calls(as_tool_messages(talk), TOOLS).collect()
    turns = {(r.conv_id, r.turn): r.role for r in talk.collect()}
    calls = [k for k, role in turns.items() if role == "assistant"]
    assert sum(r.status != "orphan_result" for r in got) == len(calls)
    for r in got:
        if r.line:
            conv, turn = map(int, r.call_id.split("-")[1:])
            assert (json.loads(r.line)["result"] is not None) == (turns.get((conv, turn + 1)) == "user")


def test_empty(spark):
    assert run(spark, []) == []
