"""Queries of the full document model: references, composition and blind spots, with expected rows told case by case."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from concordat.plans.registry import fixture, query
from concordat.sources import specmodel

c = F.col


def _ref(kind: str, name: str) -> dict:
    return {"$ref": f"#/components/{kind}/{name}"}


def _schema(name: str) -> dict:
    return _ref("schemas", name)


# Documents by case; @p is the number of the page that a document is made for.
CASES: list[dict | str] = [
    {
        "openapi": "3.0.1", "info": {"title": "T@p", "version": "1"}, "servers": [{"url": "https://h:8080/api"}, {"url": "/api/"}],
        "paths": {"/x@p/{id}": {
            "parameters": [_ref("parameters", "Id"), {"name": "q", "in": "query", "schema": {"type": "integer"}}, {"name": "q", "in": "header", "schema": {"type": "boolean"}}],
            "get": {"operationId": "op@p", "parameters": [
                {"name": "q", "in": "query", "schema": _schema("Kind1")},
                {"name": "w", "in": "query", "description": "Must be one of [NBC2, NBC4 , X_1].", "content": {"application/json": {"schema": {"type": "string", "format": "uuid"}}}},
                _ref("parameters", "Loop1"), _ref("parameters", "Gone@p"),
                {"name": "deep", "in": "query", "style": "deepObject", "required": True, "schema": {"type": "object"}},
                {"name": "odd", "in": "cookie", "description": "[lower, Case] [ONE]", "schema": _schema("Nowhere")}]},
            "put": {"responses": {}}}},
        "components": {
            "parameters": {"Id": _ref("parameters", "Id2"), "Id2": _ref("parameters", "Id3"), "Id3": {"name": "id", "in": "path", "schema": _schema("Kind2")},
                           "Loop1": _ref("parameters", "Loop2"), "Loop2": _ref("parameters", "Loop1")},
            "schemas": {"Kind1": _schema("Kind2"), "Kind2": _schema("Kind3"), "Kind3": {"type": "string", "enum": ["A@p", "B"]}}},
    },
    {
        "openapi": "3.0.1", "servers": [{"url": "/a"}, {"url": "/b"}],
        "paths": {"/y@p": {
            "post": {"requestBody": _ref("requestBodies", "Body"), "responses": {
                "200": _ref("responses", "Ok"), "201": {"content": {"text/csv": {"schema": {"type": "string"}}, "application/json": {}}},
                "404": {"content": {"application/problem+json": {"schema": {"type": "array", "items": {"type": "string"}}}}}, "500": _ref("responses", "Lost"), "5XX": {}, "default": {}}},
            "delete": {"requestBody": {"required": False, "content": {"application/xml": {"schema": _schema("X@p")}}}, "responses": {"204": {}}}}},
        "components": {
            "requestBodies": {"Body": _ref("requestBodies", "Body2"),
                              "Body2": {"required": True, "content": {"application/xml": {"schema": _schema("X")}, "application/json": {"schema": {"type": "array", "items": _schema("Line@p")}}}}},
            "responses": {"Ok": {"content": {"application/json": {"schema": _schema("Line@p")}}}}, "schemas": {"Line@p": {"type": "object"}}},
    },
    {
        "openapi": "3.1.0", "servers": [{"url": "https://{env}.host/v1?x#y"}], "security": [{"oauth": ["r"]}, {"key": []}],
        "paths": {"/z@p": {"get": {}, "post": {"security": []}, "put": {"security": [{}, {"basic": []}]}, "patch": {"security": [{"mtls": [], "basic": []}]}, "delete": {"security": [{}]}, "summary": "s"}},
    },
    {
        "openapi": "3.0.1", "components": {"schemas": {
            "Status@p": {"type": "string", "enum": ["ON", "OFF"], "maxLength": 3},
            "Animal": {"type": "object", "required": ["name"], "properties": {"name": {"type": "string"}, "age": {"type": "integer"}, "status": _schema("Status@p")}},
            "Pet": {"type": "object", "required": ["tag", "bark"], "properties": {"tag": {"type": "string"}, "age": {"type": "number"}, "owner": {"allOf": [_schema("Animal")], "nullable": True}},
                    "allOf": [{"properties": {"bark": {"type": "string"}, "tag": {"type": "integer"}}}, _schema("Animal"), {"required": ["x"], "properties": {"x": {"type": "array", "items": _schema("Pet")}}}]},
            "Puppy": {"required": ["bark"], "allOf": [_schema("Pet"), {"type": "object", "properties": {"name": {"type": "boolean"}}}]},
            "Left": {"properties": {"l": {"type": "string"}, "same": {"type": "string"}}, "allOf": [_schema("Root")]},
            "Right": {"properties": {"r": {"type": "string"}, "same": {"type": "integer"}, "top": {"type": "integer"}}, "allOf": [_schema("Root")]},
            "Root": {"properties": {"top": {"type": "string"}}},
            "Diamond": {"allOf": [_schema("Left"), _schema("Right")]}}},
    },
    {
        "openapi": "3.0.1", "components": {"schemas": {
            "A": {"properties": {"a": {"type": "string"}, "both": {"type": "string"}}, "allOf": [_schema("B")]},
            "B": {"properties": {"b": {"type": "string"}, "both": {"type": "integer"}}, "allOf": [_schema("A")]},
            "Level": {"type": "integer", "enum": [1, 2]}, "OfScalar": {"properties": {"k": {"type": "string"}}, "allOf": [_schema("Level")]},
            "OfNone": {"allOf": [{"$ref": "other.yaml#/Base@p"}]}, "Nested": {"allOf": [{"allOf": [_schema("A")]}]}, "OverNested": {"allOf": [_schema("Nested"), _schema("A")]},
            "Choice": {"oneOf": [{"type": "string"}], "anyOf": [_schema("A")], "discriminator": {"propertyName": "t"}},
            "Free": {"type": "object", "additionalProperties": {"type": "string"}}, "Shut": {"type": "object", "additionalProperties": False}, "Alias": _schema("Level"),
            "Uses": {"properties": {"alias": _schema("Alias"), "level": {"allOf": [_schema("Level")]}, "many": {"type": "array", "items": _schema("Level")}, "two": {"allOf": [_schema("A"), _schema("B")]}}}}},
    },
    "not json @p",
]


@fixture
def model_docs(d) -> str:
    arms = " ".join(f"WHEN {i} THEN '{x if isinstance(x, str) else json.dumps(x)}'" for i, x in enumerate(CASES))
    return f"SELECT scan_id, CAST(pos AS STRING) AS spec_id, pos AS spec_pos, replace(CASE pos % {len(CASES)} {arms} END, '@p', CAST(pos AS STRING)) AS json FROM fx_endpoints"


# Expected rows: case, kind, a, b, k, v, r, flag.
SPECS = [
    (0, "endpoint", "GET", "/api/x@p/{id}", "op@p", "||", None, None), (0, "endpoint", "PUT", "/api/x@p/{id}", None, "||", None, None),
    (0, "param", "GET", "q", "QUERY", "string", "A@p,B", False), (0, "param", "GET", "w", "QUERY", "string/uuid*", "NBC2,NBC4,X_1", False),
    (0, "param", "GET", None, "QUERY", "", None, False), (0, "param", "GET", None, "QUERY", "", None, False), (0, "param", "GET", "deep", "QUERY", "object", None, True),
    (0, "param", "GET", "odd", "COOKIE", "", None, False), (0, "param", "GET", "id", "PATH", "string", "A@p,B", True), (0, "param", "GET", "q", "HEADER", "boolean", None, False),
    (0, "param", "PUT", "id", "PATH", "string", "A@p,B", True), (0, "param", "PUT", "q", "QUERY", "integer", None, False), (0, "param", "PUT", "q", "HEADER", "boolean", None, False),
    (0, "spot", "Spec parameter reference 'Loop1' is part of a cycle; it is not compared.", None, None, None, None, None),
    (0, "spot", "Spec parameter reference 'Gone@p' is not in the document; it is not compared.", None, None, None, None, None),
    (0, "spot", "Spec parameter schema reference 'Nowhere' is not in the document; it is not compared.", None, None, None, None, None),
    (0, "spot", "Spec parameter 'deep' on /api/x@p/{id} uses deepObject serialization, which is not modelled against the code binding.", None, None, None, None, None),
    (1, "endpoint", "POST", "/y@p", None, "application/json,application/xml|application/json,text/csv|", "Line@p[]", True),
    (1, "endpoint", "DELETE", "/y@p", None, "application/xml||", "X@p", False),
    (1, "response", "POST", "200", None, "application/json", "Line@p", None), (1, "response", "POST", "201", None, "application/json,text/csv", "string", None),
    (1, "response", "POST", "404", None, "application/problem+json", None, None), (1, "response", "POST", "500", None, None, None, None), (1, "response", "DELETE", "204", None, None, None, None),
    (1, "spot", "Spec response 'default' on POST /y@p is a range/default key, not a concrete status code — not compared.", None, None, None, None, None),
    (1, "spot", "Spec response '5XX' on POST /y@p is a range/default key, not a concrete status code — not compared.", None, None, None, None, None),
    (1, "spot", "Spec response reference 'Lost' is not in the document; it is not compared.", None, None, None, None, None),
    (2, "endpoint", "GET", "/v1/z@p", None, "||oauth,key", None, None), (2, "endpoint", "POST", "/v1/z@p", None, "||", None, None), (2, "endpoint", "PUT", "/v1/z@p", None, "||", None, None),
    (2, "endpoint", "PATCH", "/v1/z@p", None, "||basic,mtls", None, None), (2, "endpoint", "DELETE", "/v1/z@p", None, "||", None, None),
    (2, "spot", "Spec PUT /v1/z@p declares OPTIONAL security (an empty {} alternative alongside [basic]) — anonymous access is permitted, so it is not compared as required.", None, None, None, None, None),
    (5, "message", "The document is not a readable API specification", None, None, None, None, None),
]

_ANIMAL = [("name", "string", None, None, True), ("age", "integer", None, None, False), ("status", "string", "ON,OFF 3", "Status@p", False)]
_PET = [("tag", "string", None, None, True), ("age", "number", None, None, False), ("owner", None, None, "Animal", False), ("x", "array", None, "Pet[]", True)]


def _fields(case: int, schema: str, rows: list[tuple]) -> list[tuple]:
    return [(case, "field", schema, f, t, v, r, q) for f, t, v, r, q in rows]


def _spot(case: int, text: str) -> tuple:
    return (case, "spot", text, None, None, None, None, None)


def _composed(case: int, schema: str, kinds: str) -> tuple:
    return _spot(case, f"Spec schema '{schema}' uses {kinds} composition; its composed structure is not fully compared (field-level diff may be incomplete).")


_A, _B = [("a", "string", None, None, False)], [("b", "string", None, None, False)]
COMPOSED = [
    *_fields(3, "Animal", _ANIMAL), *_fields(3, "Pet", [*_PET, ("bark", "string", None, None, True), ("name", "string", None, None, True), _ANIMAL[2]]),
    *_fields(3, "Puppy", [*_PET, ("bark", "string", None, None, False), ("name", "string", None, None, True), _ANIMAL[2]]),
    *_fields(3, "Left", [("l", "string", None, None, False), ("same", "string", None, None, False), ("top", "string", None, None, False)]),
    *_fields(3, "Right", [("r", "string", None, None, False), ("same", "integer", None, None, False), ("top", "integer", None, None, False)]),
    *_fields(3, "Root", [("top", "string", None, None, False)]),
    *_fields(3, "Diamond", [("l", "string", None, None, False), ("same", "string", None, None, False), ("top", "string", None, None, False), ("r", "string", None, None, False)]),
    _spot(3, "Spec schema 'Pet' declares nullable propert(ies); nullability (a non-null code field vs a nullable spec field) is not compared — verify it."),
    *_fields(4, "A", [*_A, ("both", "string", None, None, False), *_B]), *_fields(4, "B", [*_A, ("both", "integer", None, None, False), *_B]), *_fields(4, "OfScalar", [("k", "string", None, None, False)]),
    *_fields(4, "OverNested", [*_A, ("both", "string", None, None, False), *_B]),
    *_fields(4, "Uses", [("alias", None, None, "Alias", False), ("level", "integer", "1,2", "Level", False), ("many", "array", None, "Level[]", False), ("two", None, None, None, False)]),
    _composed(4, "OfScalar", "allOf($ref)"), _composed(4, "OfNone", "allOf($ref)"), _composed(4, "Nested", "allOf($ref)"), _composed(4, "OverNested", "allOf($ref)"),
    _composed(4, "Choice", "oneOf / anyOf / discriminator"), _composed(4, "Free", "additionalProperties"),
]


def _twin(rows: list[tuple]) -> str:
    def value(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return "NULL" if x is None else str(x)

    put = lambda x: f"replace(e.{x}, '@p', CAST(pos AS VARCHAR)) AS {x}"
    body = ",\n".join("(" + ", ".join(value(x) for x in row) + ")" for row in rows)
    return f"""SELECT e.kind, CAST(pos AS VARCHAR) AS spec_id, {', '.join(put(x) for x in "abkvr")}, CAST(e.flag AS BOOLEAN) AS flag
    FROM fx_endpoints JOIN (VALUES {body}) e(cs, kind, a, b, k, v, r, flag) ON pos % {len(CASES)} = e.cs"""


def _row(df, kind: str, **cols):
    none = F.lit(None).cast("string")
    return df.select(F.lit(kind).alias("kind"), "spec_id", *[cols.get(n, none).alias(n) for n in "abkvr"], cols.get("flag", F.lit(None).cast("boolean")).alias("flag"))


def _joined(x: str):
    return F.array_join(x, ",")


@query("src_3_references", _twin([x for x in SPECS if x[1] != "spot"]))
def src_3_references(ctx):
    t = specmodel.spec_model(ctx.fx("model_docs"))
    at = t["endpoints"].select("scan_id", "spec_id", c("pos").alias("ep"), "method")
    params, told = (t[x].join(at, ["scan_id", "spec_id", "ep"]) for x in ("params", "responses"))
    lists = F.concat_ws("|", _joined("consumes"), _joined("produces"), _joined("security"))
    kind = F.concat(F.concat_ws("/", "type", "format"), F.when(c("constraints.enumFromDescription"), "*").otherwise(""))
    out = _row(t["endpoints"], "endpoint", a=c("method"), b=c("path"), k=c("operation_id"), v=lists, r=c("body.schema_ref"), flag=c("body.required"))
    out = out.unionByName(_row(params, "param", a=c("method"), b=c("name"), k=c("location"), v=kind, r=_joined("constraints.enumValues"), flag=c("required")))
    out = out.unionByName(_row(told, "response", a=c("method"), b=c("status").cast("string"), v=_joined("media_types"), r=c("schema_ref")))
    return out.unionByName(_row(t["messages"], "message", a=c("message")))


@query("src_4_composition", _twin(COMPOSED + [x for x in SPECS if x[1] == "spot"]))
def src_4_composition(ctx):
    t = specmodel.spec_model(ctx.fx("model_docs"))
    bound = F.nullif(F.concat_ws(" ", _joined("constraints.enumValues"), c("constraints.maxLength").cast("string")), F.lit(""))
    out = _row(t["fields"], "field", a=c("schema"), b=c("field"), k=c("type"), v=bound, r=c("ref_schema"), flag=c("required"))
    return out.unionByName(_row(t["blind_spots"], "spot", a=c("text")))
