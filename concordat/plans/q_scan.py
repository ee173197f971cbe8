"""From documents to verdicts in one query, with expected findings told case by case."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from concordat.operators.scan import scan
from concordat.plans.dialect import SparkDialect
from concordat.plans.registry import fixture, query

c = F.col


def _ref(name: str) -> dict:
    return {"$ref": f"#/components/schemas/{name}"}


def _json(schema: dict) -> dict:
    return {"content": {"application/json": {"schema": schema}}}


def _doc(paths: dict, schemas: dict | None = None, title: str = "T") -> dict:
    return {"openapi": "3.0.1", "info": {"title": title, "version": "1"}, "paths": paths, "components": {"schemas": schemas or {}}}


_DTO = {"type": "object", "properties": {"x": {"type": "string"}, "n": {"type": "integer"}}}
_VIEW = {"type": "object", "properties": {"n": {"type": "integer"}, "more": {"type": "string"}}}
_ROLE = [{"role": []}]
_ALIKE = _doc({"/same@p/{id}": {"get": {"parameters": [{"name": "id", "in": "path", "schema": {"type": "string"}}], "responses": {"200": _json(_ref("Same"))}}}}, {"Same": _DTO})

# Per case: the code, then its specs. @p is the number of the page that a scan is made for.
SCANS: list[list[dict | str]] = [
    [
        _doc({"/a": {"get": {"security": _ROLE, "parameters": [{"name": "q", "in": "query", "required": True, "schema": {"type": "integer"}}], "responses": {"200": _json(_ref("Dto"))}}},
              "/b": {"get": {"responses": {"200": _json(_ref("Dto2"))}}}, "/gone@p": {"get": {}}}, {"Dto": _DTO, "Dto2": _DTO}),
        _doc({"/a": {"get": {"parameters": [{"name": "q", "in": "query", "schema": {"type": "string"}}], "responses": {"200": _json(_ref("View")), "404": {}}}, "post": {}},
              "/b": {"get": {"responses": {"200": _json(_ref("View"))}}}, "/dead@p": {"get": {}}}, {"View": _VIEW}, " "),
        "no document @p",
    ],
    [_ALIKE, _ALIKE, _ALIKE],
    [
        _doc({"/x": {"get": {}}, "/y@p": {"put": {}}}),
        _doc({"/x": {"get": {}}, "/y@p": {"put": {}}}),
        {**_doc({"/x": {"get": {}}}), "servers": [{"url": "/"}]},
    ],
    [_doc({"/new@p": {"get": {}}, "/kept@p": {"delete": {}}}), _doc({"/other": {"trace": {}}})],
    [
        _doc({"/s@p": {"post": {"requestBody": {**_json(_ref("In"))}, "responses": {"200": _json({"type": "array", "items": _ref("Same")}), "500": {}}}}}, {"In": {"type": "object", "properties": {"k": {"type": "string", "maxLength": 5}, "sub": _ref("Sub")}}, "Sub": _DTO, "Same": _DTO}),
        _doc({"/s@p": {"post": {"requestBody": {**_json(_ref("In"))}, "responses": {"200": _json(_ref("Same")), "204": {}}}}}, {"In": {"type": "object", "properties": {"k": {"type": "string"}, "sub": _ref("Other")}}, "Other": {"type": "object", "properties": {"x": {"type": "integer"}, "n": {"type": "integer"}}}, "Same": _DTO}),
    ],
]

# Expected findings: case, spec, type, severity, endpoint, summary, confidence, locus, operations, status.
FOUND = [
    (0, "B", "OPENAPI_PARSE_ERROR", "BLOCKER", None, "The document is not a readable API specification", "HIGH", None, None, None),
    (0, "A", "MISSING_INFO_FIELD", "INFO", None, "Spec is missing info.title", "MEDIUM", None, None, None),
    (0, "A", "VERB_MISMATCH", "CRITICAL", "POST /a", "Spec documents POST /a but the code exposes [GET] on that path", "HIGH", None, None, None),
    (0, "A", "MISSING_ENDPOINT", "CRITICAL", "GET /gone@p", "Endpoint GET /gone@p exists in code but is missing from the spec", "HIGH", None, None, None),
    (0, "A", "EXTRA_ENDPOINT", "MINOR", "GET /dead@p", "Endpoint GET /dead@p is in the spec but not found in code (dead spec?)", "MEDIUM", None, None, None),
    (0, "A", "PARAM_TYPE_MISMATCH", "MAJOR", "GET /a", "Parameter 'q' type — code integer vs spec string", "MEDIUM", None, None, None),
    (0, "A", "PARAM_REQUIRED_MISMATCH", "MAJOR", "GET /a", "Parameter 'q' required — code true vs spec false", "MEDIUM", None, None, None),
    (0, "A", "SECURITY_MISMATCH", "CRITICAL", "GET /a", "Code enforces authorization (role) but the spec declares no security for this operation", "HIGH", None, None, None),
    (0, "A", "SCHEMA_FIELD_EXTRA", "MINOR", "GET /a.more", "Field 'more' of shared spec schema 'View' is in the spec but not in code", "LOW", "View#more", 2, None),
    (0, "A", "SCHEMA_FIELD_MISSING", "MAJOR", "GET /a.x", "Field 'x' of shared spec schema 'View' is in code but missing from the spec schema", "HIGH", "View#x", 2, None),
    (2, "B", "MISSING_ENDPOINT", "CRITICAL", "PUT /y@p", "Endpoint PUT /y@p exists in code but is missing from the spec", "HIGH", None, None, None),
    (2, "A vs B", "SPEC_DRIFT", "MINOR", "PUT /y@p", "PUT /y@p is in A but not in B", "HIGH", None, None, None),
    (3, "A", "MISSING_ENDPOINT", "CRITICAL", "GET /new@p", "Endpoint GET /new@p exists in code but is missing from the spec", "HIGH", None, None, "FALSE_POSITIVE"),
    (3, "A", "MISSING_ENDPOINT", "CRITICAL", "DELETE /kept@p", "Endpoint DELETE /kept@p exists in code but is missing from the spec", "HIGH", None, None, "WONT_FIX"),
    (3, "A", "EXTRA_ENDPOINT", "MINOR", "TRACE /other", "Endpoint TRACE /other is in the spec but not found in code (dead spec?)", "MEDIUM", None, None, None),
    (4, "A", "STATUS_CODE_MISSING", "MAJOR", "POST /s@p", "Code can return 500 but the spec doesn't document it", "MEDIUM", None, None, None),
    (4, "A", "STATUS_CODE_EXTRA", "MINOR", "POST /s@p", "Spec documents success status 204 but the code never returns it", "LOW", None, None, None),
    (4, "A", "SCHEMA_FIELD_TYPE_MISMATCH", "MAJOR", "POST /s@p.sub.x", "Field 'x' type — code string vs spec integer", "MEDIUM", "Other#x#string~integer", None, None),
    (4, "A", "RESPONSE_SCHEMA_MISMATCH", "MAJOR", "POST /s@p", "Success response schema — code returns 'Same[]' but the spec declares 'Same'", "MEDIUM", None, None, None),
    (4, "A", "CONSTRAINT_GAP", "MAJOR", "In.k", "Field 'k' has code constraints not exposed in the spec", "MEDIUM", None, None, None),
]

# Expected verdict numbers: case, counted, blocker, critical, major, minor, unspecified, breaking, verdict.
VERDICTS = [
    (0, 9, 1, 3, 3, 1, 0, 6, "FAIL"), (1, 0, 0, 0, 0, 0, 0, 0, "PASS"), (2, 2, 0, 1, 0, 1, 0, 1, "FAIL"),
    (3, 1, 0, 0, 0, 1, 0, 0, "WARN"), (4, 4, 0, 0, 4, 0, 0, 3, "FAIL"),
]


def _text(x) -> str:
    return "'" + (x if isinstance(x, str) else json.dumps(x)).replace("'", "''") + "'"


@fixture
def scan_docs(d) -> str:
    n = len(SCANS)
    rows = []
    for k, (side, spec) in enumerate([("code", "code"), ("spec", "A"), ("spec", "B")]):
        arms = " ".join(f"WHEN {i} THEN {_text(docs[k])}" for i, docs in enumerate(SCANS) if len(docs) > k)
        known = ", ".join(str(i) for i, docs in enumerate(SCANS) if len(docs) > k)
        rows.append(
            f"SELECT CAST(pos AS STRING) AS scan_id, '{side}' AS side, '{spec}' AS spec_id, {k} AS spec_pos, replace(CASE pos % {n} {arms} END, '@p', CAST(pos AS STRING)) AS json "
            f"FROM fx_endpoints WHERE pos % {n} IN ({known})"
        )
    return " UNION ALL ".join(rows)


@fixture
def scan_history(d) -> str:
    """What was decided about the missing operations of the fourth case: one dismissal per scan, and older ones."""
    sha = (lambda x: f"sha2({x}, 256)") if isinstance(d, SparkDialect) else (lambda x: f"sha256({x})")
    mark = "chr(1)"
    name = lambda verb: f"concat('{verb} /', CASE WHEN '{verb}' = 'GET' THEN 'new' ELSE 'kept' END, pos)"
    ident = lambda verb: sha(f"concat('MISSING_ENDPOINT', {mark}, {name(verb)}, {mark}, 'A', {mark}, 'Endpoint ', {name(verb)}, ' exists in code but is missing from the spec')")
    rows = [("GET", 1, "ACCEPTED"), ("GET", 2, "FALSE_POSITIVE"), ("DELETE", 1, "WONT_FIX"), ("DELETE", 2, "OPEN")]
    return " UNION ALL ".join(
        f"SELECT concat('old-', {k}) AS scan_id, {ident(verb)} AS finding_id, '{status}' AS status, CAST(NULL AS STRING) AS user_severity, TIMESTAMP '2001-0{k}-01 00:00:00' AS created_at "
        f"FROM fx_endpoints WHERE pos % {len(SCANS)} = 3"
        for verb, k, status in rows
    )


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else _text(x)


def _twin(rows: list[tuple], columns: list[str], cast: dict[str, str]) -> str:
    put = ", ".join(f"replace(e.{x}, '@p', CAST(pos AS VARCHAR)) AS {x}" if cast.get(x) is None else f"CAST(e.{x} AS {cast[x]}) AS {x}" for x in columns)
    body = ",\n".join("(" + ", ".join(_value(x) for x in row) + ")" for row in rows)
    return f"SELECT CAST(pos AS VARCHAR) AS scan_id, {put} FROM fx_endpoints JOIN (VALUES {body}) e(cs, {', '.join(columns)}) ON pos % {len(SCANS)} = e.cs"


_FOUND = ["spec_source", "type", "severity", "endpoint", "summary", "confidence", "spec_locus", "n_affected", "status"]
_COUNTS = ["counted", "blocker", "critical", "major", "minor", "unspecified", "breaking"]


@query("scan_findings", _twin(FOUND, _FOUND, {"n_affected": "BIGINT"}))
def scan_findings(ctx):
    found, _ = scan(ctx.fx("scan_docs"), ctx.fx("scan_history"))
    return found.select("scan_id", *_FOUND)


@query("scan_pipeline", _twin(VERDICTS, [*_COUNTS, "verdict"], dict.fromkeys(_COUNTS, "BIGINT")))
def scan_pipeline(ctx):
    _, verdicts = scan(ctx.fx("scan_docs"), ctx.fx("scan_history"))
    return verdicts.select("scan_id", *_COUNTS, "verdict")
