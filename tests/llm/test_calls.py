import itertools
import json

import pytest

from crossload.llm import tool_calls

CALL = "call_id string, conv_id long, position long, tool string, arguments string, after string"
RESULT = "call_id string, position long, content string"
TOOLS = {"t": {"s": ("string", True), "d": ("double", False), "n": ("bigint", False), "b": ("boolean", False)}}


def fits(value, kind):
    if kind == "string":
        return isinstance(value, str)
    if kind == "boolean":
        return isinstance(value, bool)
    return not isinstance(value, bool) and isinstance(value, (int,) if kind == "bigint" else (int, float))


def plain(calls, results, tools):
    """status and canonical arguments of each call by a loop."""
    by = {c[0]: c for c in reversed(sorted((c for c in calls if c[0]), key=lambda c: c[2]))}
    has = {r[0] for r in results if r[0]}
    out = {i: ("no_call", None) for i in has - by.keys()}
    for i, (_, _, _, tool, arguments, _) in by.items():
        seen, at = set(), i
        while at in by and at not in seen:
            seen.add(at)
            at = by[at][5]
        try:
            given = json.loads(arguments)
        except (TypeError, ValueError):
            given = None
        fields = tools.get(tool)
        good = fields and isinstance(given, dict) and given.keys() <= fields.keys() and all(
            fits(given[k], kind) if given.get(k) is not None else not required for k, (kind, required) in fields.items())
        status = "unknown_tool" if fields is None else "invalid" if not good else "cycle" if at in seen else "ok" if i in has else "no_result"
        out[i] = (status, json.dumps(given, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if status == "ok" else None)
    return out


def result(spark, calls, results, tools=TOOLS):
    df = tool_calls.link_calls(spark.createDataFrame(calls, CALL), spark.createDataFrame(results, RESULT), tools)
    return {r.call_id: (r.status, json.loads(r.message)["arguments"] if r.message else None) for r in df.collect()}


def test_every_kind_of_call(spark):
    values = [None, "x", 1, 1.5, -0.25, True, [1], {"s": 1}]
    calls = [(f"c{n}", 1, n, "t", json.dumps({"s": "q", k: v}), None) for n, (k, v) in enumerate(itertools.product("sdnb", values))]
    calls += [("more", 1, 1, "t", '{"s":"q","z":1}', None), ("bad", 1, 1, "t", "no json", None), ("list", 1, 1, "t", "[]", None), ("none", 1, 1, "t", None, None),
              ("other", 1, 1, "unheard", "{}", None), ("null", 1, 1, None, "{}", None), (None, 1, 1, "t", "{}", None), ("alone", 1, 1, "t", '{"s":"q"}', None),
              ("loop1", 1, 1, "t", '{"s":"q"}', "loop2"), ("loop2", 1, 1, "t", '{"s":"q"}', "loop1"), ("own", 1, 1, "t", '{"s":"q"}', "own"), ("child", 1, 1, "t", '{"s":"q"}', "gone"),
              ("twice", 1, 5, "t", '{"s":"second"}', None), ("twice", 1, 2, "t", '{"s":"first"}', None), ("long", 1, 1, "t", json.dumps({"s": "é" * 200_000}), None)]
    results = [(c[0], 1, "r") for c in calls if c[0] not in ("alone",)] + [("lost", 1, "r"), ("twice", 0, "r")]
    got = result(spark, calls, results)
    assert got == plain(calls, results, TOOLS)
    assert {s for s, _ in got.values()} == {"ok", "invalid", "unknown_tool", "no_result", "no_call", "cycle"}


def test_query_equals_a_loop(spark):
    path = "/root/testdata/sf0.001"
    talk = spark.read.parquet(f"{path}/conversations.parquet").collect()
    calls = [(f"{r.conv_id}-{r.turn}", r.conv_id, r.turn, "answer" if r.turn % 4 == 0 else "reply", json.dumps({"question": r.text, "turn": r.turn}), f"{r.conv_id}-{r.turn - 2}") for r in talk if r.role == "user"]
    results = [(f"{r.conv_id}-{r.turn - 1}", r.turn, r.text) for r in talk if r.role == "assistant"]
    got = {r.call_id: (r.status, json.loads(r.message)["arguments"] if r.message else None) for r in tool_calls.op4_tool_calls(spark, path).collect()}
    assert got == plain(calls, results, tool_calls.SCHEMAS)


@pytest.mark.parametrize("kind,good", [("double", [1, 1.5, 1e300, 0.1]), ("bigint", [0, -5, 2**40])])
def test_numbers(spark, kind, good):
    tools = {"t": {"v": (kind, True)}}
    calls = [(str(n), 1, n, "t", json.dumps({"v": v}), None) for n, v in enumerate(good)]
    assert {s for s, _ in result(spark, calls, [(c[0], 1, "r") for c in calls], tools).values()} == {"ok"}
