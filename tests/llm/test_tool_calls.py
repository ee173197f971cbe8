"""Tool calls: order, links, faults and canonical JSON against plain Python, over cycles and odd rows."""

import hashlib
import json
import random

from concordat.llm.tool_calls import faults, levels, link

CALLS = "conv_id long, call_id string, name string, arguments string, after array<string>, message string"
RESULTS = "conv_id long, call_id string, content string, turn long, name string"
SCHEMAS = "name string, field string, type string, required boolean"
TOOLS = [("f", "a", "string", True), ("f", "b", "integer", False), ("g", "c", "object", True), ("g", "d", "array", False), ("g", "e", "boolean", False)]


def depths(calls):
    graph = {(v, i): {(v, d) for d in after or [] if d} for v, i, _, _, after, _ in calls}
    graph = {k: {d for d in deps if d in graph} for k, deps in graph.items()}
    out, left = {}, dict(graph)
    while ready := [k for k, deps in left.items() if deps <= out.keys()]:
        for k in ready:
            out[k] = 1 + max((out[d] for d in left[k]), default=-1)
            del left[k]
    return graph, out


def test_levels(spark):
    rng = random.Random(2)
    calls = []
    for v in range(12):
        for i in range(15):
            after = [str(rng.randint(-2, 16)) for _ in range(rng.choice([0, 1, 1, 2]))] if v % 3 == 0 else [str(rng.randint(0, i)) for _ in range(2)][: i % 3]
            calls.append((v, str(i), "f", None, [a for a in after if a != str(i)] + ([None] if i == 3 else []), None))
    graph, want = depths(calls)
    got = {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {k: want.get(k) for k in graph}
    position = {(r.conv_id, r.call_id): r.position for r in link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame(TOOLS, SCHEMAS)).collect()}
    for v in range(12):
        order = sorted((k for k in graph if k[0] == v), key=lambda k: (want.get(k, 10**9), hashlib.md5(k[1].encode()).hexdigest()))
        assert [position[k] for k in order] == list(range(len(order)))


def test_faults_and_messages(spark):
    rows = [
        ("1", "f", '{ "b": 3, "a": "x" }', ""), ("2", "f", '{"b": 3}', "missing a"), ("3", "f", '{"a": 1, "b": "y", "z": {}}', "type a,type b,unknown z"),
        ("4", "h", "{}", "tool"), ("5", "f", "{", "json"), ("6", "f", None, "json"), ("7", "g", '{"d": [1, {"y": 1, "x": "é\\n"}], "c": {"q": 1, "b": null}}', ""),
        ("8", "g", '{"c": null, "e": 1}', "missing c,type e"), ("9", "f", "[1]", "json"), ("10", None, "nope", "json,tool"),
    ]
    calls = [(1, i, n, a, None, "clash") for i, n, a, _ in rows] + [(None, "1", "f", "{}", None, None), (1, None, "f", "{}", None, None), (1, "1", "f", '{ "b": 3, "a": "x" }', None, None)]
    results = [(1, "1", 'say "hi"\n', 4, None), (1, "1", "later", 9, None), (1, "77", "no call", 1, None), (None, "1", "x", 1, None), (1, "2", None, 1, None)]
    frames = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(TOOLS, SCHEMAS)
    got = {r.call_id: r for r in link(*frames).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, name, arguments, errors in rows:
        assert got[i].errors == errors and got[i].valid == (errors == "")
        try:
            value = json.loads(arguments)
        except (TypeError, ValueError):
            value = None
        content = 'say "hi"\n' if i == "1" else None
        text = json.dumps({"arguments": value, "call_id": i, "name": name, "result": content}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[i].message == text
    assert got["1"].n_results == 2 and got["2"].n_results == 1 and got["3"].n_results == 0
    assert {r.call_id for r in faults(frames[0].filter("conv_id is not null and call_id is not null"), frames[2]).collect()} == {r[0] for r in rows if r[3]}


def test_empty(spark):
    frames = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame(TOOLS, SCHEMAS)
    assert link(*frames).collect() == []


def test_long_chains(spark):
    """Chains of 400 calls with branches, circles and calls that wait for the ends of several chains."""
    calls = [(1, str(i), "f", None, [str(i - 1)] if i else [], None) for i in range(400)]
    calls += [(1, f"b{i}", "f", None, [f"b{i - 1}" if i else "37"], None) for i in range(50)]
    calls += [(1, f"o{i}", "f", None, [f"o{(i + 1) % 7}"], None) for i in range(7)] + [(1, f"p{i}", "f", None, [f"p{i - 1}" if i else "o3"], None) for i in range(9)]
    calls += [(1, "join", "f", None, ["399", "b49", "5"], None), (1, "stuck", "f", None, ["399", "p8"], None), (1, "end", "f", None, ["join"], None), (1, "more", "f", None, ["end", "join", "0"], None)]
    graph, want = depths(calls)
    got = {(r.conv_id, r.call_id): r.level for r in levels(spark.createDataFrame(calls, CALLS)).collect()}
    assert got == {k: want.get(k) for k in graph} and got[1, "more"] == 402 and got[1, "stuck"] is None


def test_nested_fields_and_types(spark):
    schema = [("f", "n", "number", True), ("f", "o", "object", False), ("f", "o.x", "integer", True), ("f", "o.p", "object", False), ("f", "o.p.q", "string", True), ("f", "m", "money", False), ("f", "any", None, False)]
    rows = [
        ('{"n": 1.5}', ""), ('{"n": 3, "o": {"x": 1}}', ""), ('{"n": "3"}', "type n"), ('{"n": 1e300, "o": {}}', "missing o.x"), ('{"n": 1, "o": {"x": 2, "y": 1}}', "unknown o.y"),
        ('{"n": 1, "o": {"x": 2.5, "p": {"q": 1, "r": null}}}', "type o.p.q,type o.x"), ('{"n": 1, "o": 5}', "type o"), ('{"n": 1, "m": 1, "any": [1]}', "schema m"), ('{"n": 1, "o": {"x": 1, "p": {"z": {"deep": 1}}}}', "missing o.p.q,unknown o.p.z"),
    ]
    calls = spark.createDataFrame([(1, str(k), "f", a, None, None) for k, (a, _) in enumerate(rows)], CALLS)
    got = {r.call_id: r.errors for r in faults(calls, spark.createDataFrame(schema, SCHEMAS)).collect()}
    assert got == {str(k): e for k, (_, e) in enumerate(rows) if e}
