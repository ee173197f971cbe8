"""The document model: long chains of references, circles, deep composition, odd documents."""

import json

from concordat.sources import specmodel

SCHEMA = "scan_id string, spec_id string, spec_pos int, json string, name string, node int"


def model(spark, *docs):
    rows = [("s", f"d{i}", i, x if x is None or isinstance(x, str) else json.dumps(x), "n", 1) for i, x in enumerate(docs)]
    return specmodel.spec_model(spark.createDataFrame(rows, SCHEMA))


def test_chains_of_references(spark):
    """A chain of 70 references takes seven rounds; a tail that leads into a circle is part of it."""
    ref = lambda n: {"$ref": f"#/components/parameters/{n}"}
    named = {f"c{i}": ref(f"c{i + 1}") for i in range(70)} | {"c70": {"name": "end", "in": "header", "schema": {"type": "string"}}}
    named |= {"t1": ref("t2"), "t2": ref("l1"), "l1": ref("l2"), "l2": ref("l3"), "l3": ref("l1"), "self": ref("self"), "out": ref("nowhere")}
    ops = {"get": {"parameters": [ref("c0"), ref("c69"), ref("t1"), ref("self"), ref("out")]}}
    t = model(spark, {"openapi": "3", "paths": {"/p": ops}, "components": {"parameters": named}})
    assert [r.name for r in t["params"].orderBy("pos").collect()] == ["end", "end", None, None, None]
    told = sorted(r.text for r in t["blind_spots"].collect())
    assert [x.split("'")[1] for x in told if "cycle" in x] == ["self", "t1"] and [x.split("'")[1] for x in told if "not in the document" in x] == ["out"]


def test_deep_composition(spark):
    """Forty levels, each with the one below twice: one row per schema and field, not one per path."""
    schemas = {f"S{i}": {"properties": {f"f{i}": {"type": "string"}, "all": {"type": f"t{i}"}}, "allOf": [{"$ref": f"#/x/S{i + 1}"}] * 2} for i in range(40)}
    schemas["S40"] = {"properties": {"f40": {"type": "string"}}}
    rows = model(spark, {"components": {"schemas": schemas}})["fields"].filter("schema IN ('S0', 'S30')").collect()
    assert {(r.schema, r.field) for r in rows} == {("S0", f"f{i}") for i in range(41)} | {("S30", f"f{i}") for i in range(30, 41)} | {("S0", "all"), ("S30", "all")}
    assert len(rows) == 41 + 11 + 2 and {r.type for r in rows if r.field == "all"} == {"t0", "t30"}
    assert {tuple(r.path) for r in rows if r.schema == "S0" and r.field == "f3"} == {(0, 0, 0)}


def test_odd_documents(spark):
    t = model(spark, None, "", "[]", "{", {"openapi": "3"}, {"paths": 5}, {"paths": {"/a": {"get": None, "post": 3, "x": {}}, "/b": None}, "components": {"schemas": {"N": None, "T": {"properties": None, "allOf": None}}}})
    assert sorted(r.spec_id for r in t["messages"].collect()) == ["d0", "d1", "d2", "d3"]
    assert sorted((r.method, r.path) for r in t["endpoints"].collect()) == [("GET", "/a"), ("POST", "/a")]
    assert sorted(r.schema for r in t["schemas"].collect()) == ["N", "T"] and t["fields"].count() == t["params"].count() == t["responses"].count() == 0
    empty = specmodel.spec_model(spark.createDataFrame([], SCHEMA))
    assert all(x.count() == 0 for x in empty.values())
    nameless = specmodel.spec_model(spark.createDataFrame([(None, "a", 1, '{"openapi":"3"}', "", 0), ("s", None, 1, "{}", "", 0)], SCHEMA))
    assert nameless["specs"].count() == nameless["messages"].count() == 0
