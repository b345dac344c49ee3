"""Tool calls: links, order, checks and canonical JSON."""

import json

from hypothesis import given, settings, strategies as st

from sensorloom.llm import chat
from tests.llm.conftest import rows_of

CALLS = "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>, content string"
RESULTS = "conv_id long, call_id string, turn long, content string"
TOOLS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "string", "enum": ["x", "y"]}}}}


def linked(spark, calls, results):
    out = chat.link_calls(spark.createDataFrame([(*c, "clash") for c in calls], CALLS), spark.createDataFrame(results, RESULTS), TOOLS)
    return {(r["conv_id"], r["call_id"]): r for r in rows_of(out)}


def test_links_order_and_checks(spark):
    calls = [
        (1, "c", 3, "f", '{"b":"x", "a": 1.0}', ["a", "b"]), (1, "a", 1, "f", '{"a":1}', []), (1, "b", 2, "f", '{"a":2}', ["a", "gone", None]),
        (1, "x", 4, "f", '{"a":1}', ["y"]), (1, "y", 4, "f", '{"a":1}', ["x"]), (1, "z", 5, "f", '{"a":1}', ["y", "a"]),
        (2, "a", 1, "f", '{"a":-1,"c":0}', None), (2, "b", 1, "g", "{}", []), (2, "n", 1, "f", '{"a":1,"a":2}', []), (2, "m", 1, "f", None, []),
        (3, "a", 7, "f", '{"a":1}', []), (3, "t", 1, "f", '{"a":1}', []), (3, "t", 1, "f", '{"a":1}', []), (3, "t", 0, "f", '{"a":0}', []),
        (None, "a", 1, "f", "{}", []), (4, None, 1, "f", "{}", []), (5, "deep", 1, "f", "[" * 5000, []),
    ]
    results = [(1, "a", 2, "one"), (1, "c", 9, 'ü "q"\n'), (3, "a", 2, "before"), (3, "t", 4, "b"), (3, "t", 4, "a"), (9, "o", 1, None), (None, "a", 1, "x")]
    got = linked(spark, calls, results)
    state = {k: (r["level"], r["status"]) for k, r in got.items()}
    assert state == {
        (1, "a"): (0, "ok"), (1, "b"): (1, "unanswered"), (1, "c"): (2, "ok"), (1, "x"): (None, "cycle"), (1, "y"): (None, "cycle"), (1, "z"): (None, "cycle"),
        (2, "a"): (0, "invalid"), (2, "b"): (0, "invalid"), (2, "n"): (0, "invalid"), (2, "m"): (0, "invalid"),
        (3, "a"): (0, "early"), (3, "t"): (0, "ok"), (9, "o"): (None, "orphan"), (5, "deep"): (0, "invalid"),
    }
    assert got[1, "c"]["record"] == '{"call":{"arguments":{"a":1,"b":"x"},"name":"f","needs":["a","b"]},"id":"c","result":"ü \\"q\\"\\n"}'
    assert got[2, "a"]["problems"] == ["$.a: below 0", "$.c: unknown"]
    assert (got[3, "t"]["n_calls"], got[3, "t"]["n_results"]) == (3, 2) and '"result":"a"' in got[3, "t"]["record"] and '"a":0' in got[3, "t"]["record"]


def test_a_long_chain_is_ordered(spark):
    calls = [(1, f"k{i}", 0, "f", '{"a":1}', [f"k{i - 1}"] if i else []) for i in range(12)]
    assert {k[1]: r["level"] for k, r in linked(spark, calls, []).items()} == {f"k{i}": i for i in range(12)}


def test_no_rows(spark):
    assert linked(spark, [], []) == {}


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers(-10**9, 10**9) | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20))
def test_canonical_json_reads_back_and_is_stable(value):
    text = chat.canonical(value)
    assert json.loads(text) == value and chat.canonical(json.loads(text)) == text


def test_given_conversations(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = {(r["conv_id"], r["turn"]): r for r in rows_of(turns)}
    want = {}
    for (conv, turn), r in rows.items():
        if r["role"] == "user":
            reply = rows.get((conv, turn + 1))
            reply = reply["text"] if reply and reply["role"] == "assistant" else None
            want[conv, f"ask-{turn}"] = (1, reply)
            for i, _ in enumerate(r["text"].split("\n")):
                lines = reply.split("\n") if reply is not None else []
                want[conv, f"line-{turn}-{i}"] = (0, lines[i] if i < len(lines) else None)
    out = {(r["conv_id"], r["call_id"]): (r["level"], json.loads(r["record"]).get("result")) for r in rows_of(chat.link_calls(*chat.calls_of_turns(turns), chat.TOOLS)) if r["status"] != "orphan"}
    assert out == want
