"""Contract comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.functions import contract as ct
from concordat.operators import contract as op
from concordat.operators import schemas as sc
from concordat.plans import duck
from concordat.plans.dialect import pick, struct
from concordat.plans.registry import fixture, query

c = F.col


def constraints(d, seed: str, shift: str) -> str:
    """A constraint set that varies with a seed; null members mean "not declared"."""
    return struct(
        d,
        {
            "minLength": f"CASE WHEN {seed} % 7 = 0 THEN CAST({seed} % 3 + {shift} AS INTEGER) END",
            "maxLength": f"CASE WHEN {seed} % 7 = 1 THEN CAST(10 + {seed} % 4 + {shift} AS INTEGER) END",
            "minimum": f"CASE WHEN {seed} % 7 = 2 AND {shift} < 2 THEN CAST({seed} % 5 + {shift} AS DOUBLE) END",
            "maximum": f"CASE WHEN {seed} % 7 = 3 THEN CAST(50 + {seed} % 5 - {shift} AS DOUBLE) END",
            "exclusiveMin": f"CASE WHEN {seed} % 7 = 2 THEN ({seed} + {shift}) % 2 = 0 END",
            "exclusiveMax": f"CASE WHEN {seed} % 7 IN (3, 4) THEN ({seed} + {shift}) % 2 = 1 END",
            "pattern": f"CASE WHEN {seed} % 7 = 5 THEN concat('^x', {seed} % 3 + {shift}) END",
            "enumValues": f"CASE WHEN {seed} % 7 = 6 THEN {d.array('concat(' + repr('a') + f', {seed} % 2)', repr('B'), f'concat({repr(chr(86))}, {shift})')} END",
            "format": f"CASE WHEN {seed} % 11 = 5 THEN concat('f', {shift}) END",
            "enumFromDescription": f"{seed} % 2 = 0",
        },
    )


_NONE = """({0} IS NULL OR ({0}.minLength IS NULL AND {0}.maxLength IS NULL AND {0}.minimum IS NULL AND {0}.maximum IS NULL AND NOT coalesce({0}.exclusiveMin, false)
 AND NOT coalesce({0}.exclusiveMax, false) AND {0}.pattern IS NULL AND {0}.format IS NULL AND coalesce(len({0}.enumValues), 0) = 0))""".format


def _set(x: str) -> str:
    return f"list_sort(list_distinct(list_transform(coalesce({x}, []), lambda v: lower(v))))"


def _list(x: str) -> str:
    return f"coalesce('[' || array_to_string({x}, ', ') || ']', 'null')"


def duck_constraint(a: str, b: str, ai: str, bi: str) -> str:
    """First differing keyword as SQL CASE arms."""

    def show(x: str) -> str:
        return f"coalesce(CAST({x} AS VARCHAR), 'null')"

    def msg(k: str, x: str, y: str) -> str:
        return f"'{k} code=' || {show(x)} || ' spec=' || {show(y)}"

    arms = []
    for k in ("minLength", "maxLength"):
        arms.append((f"{a}.{k} IS DISTINCT FROM {b}.{k}", msg(k, f"{a}.{k}", f"{b}.{k}")))
    for k, e, s in (("minimum", "exclusiveMin", "+ 1"), ("maximum", "exclusiveMax", "- 1")):
        x = f"CASE WHEN coalesce({ai}, false) AND coalesce({a}.{e}, false) THEN {a}.{k} {s} ELSE {a}.{k} END"
        y = f"CASE WHEN coalesce({bi}, false) AND coalesce({b}.{e}, false) THEN {b}.{k} {s} ELSE {b}.{k} END"
        arms.append((f"({x}) IS NOT NULL AND ({x}) IS DISTINCT FROM ({y})", msg(k, x, y)))
    for e, k in (("exclusiveMin", "exclusiveMinimum"), ("exclusiveMax", "exclusiveMaximum")):
        x = f"(NOT coalesce({ai}, false) AND coalesce({a}.{e}, false))"
        y = f"(NOT coalesce({bi}, false) AND coalesce({b}.{e}, false))"
        arms.append((f"{x} <> {y}", msg(k, f"{a}.{e}", f"{b}.{e}")))
    arms.append((f"{a}.format <> {b}.format", msg("format", f"{a}.format", f"{b}.format")))
    arms.append((f"{a}.pattern IS NOT NULL AND {a}.pattern IS DISTINCT FROM {b}.pattern", msg("pattern", f"{a}.pattern", f"{b}.pattern")))
    arms.append(
        (f"{_set(a + '.enumValues')} <> {_set(b + '.enumValues')}", f"'enum code=' || {_list(a + '.enumValues')} || ' spec=' || {_list(b + '.enumValues')}")
    )
    return "CASE " + " ".join(f"WHEN {w} THEN {t}" for w, t in arms) + " END"


# --- endpoints ---------------------------------------------------------------------------------------

_K = f"""ce AS (SELECT *, method || ' ' || {duck.norm_path('path')} AS key, {duck.norm_path('path')} AS np, method || ' ' || path AS label FROM fx_code_endpoints),
 se AS (SELECT *, method || ' ' || {duck.norm_path('path')} AS key, {duck.norm_path('path')} AS np, method || ' ' || path AS label FROM fx_spec_endpoints WHERE spec_id = 'A'),
 sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY pos DESC) AS rn FROM se) WHERE rn = 1),
 m AS (SELECT ce.scan_id, ce.pos, ce.label, ce.method, ce.path, sl.pos AS s_pos, sl.path AS s_path FROM ce JOIN sl USING (scan_id, key)),
 co AS (SELECT * FROM ce WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.scan_id = ce.scan_id AND se.key = ce.key)),
 so AS (SELECT * FROM se WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.scan_id = se.scan_id AND ce.key = se.key))"""


def _code(ctx):
    return ctx.fx("code_endpoints")


def _spec(ctx):
    return ctx.fx("spec_endpoints").filter(c("spec_id") == "A")


def _blind(ctx):
    return _code(ctx).filter(c("blind_spot").isNotNull()).select("scan_id", c("blind_spot").alias("text"))


def _pairs(ctx):
    return op.matched(_code(ctx), _spec(ctx))


@query(
    "jn_1",
    f"""WITH {_K} SELECT 'matched' AS kind, scan_id, pos, s_pos FROM m UNION ALL SELECT 'code_only', scan_id, pos, NULL FROM co
    UNION ALL SELECT 'spec_only', scan_id, NULL, pos FROM so
    UNION ALL SELECT DISTINCT 'collision', scan_id, NULL::BIGINT, NULL::BIGINT FROM (SELECT scan_id FROM se GROUP BY scan_id, key HAVING count(*) > 1)""",
)
def jn_1(ctx):
    code, spec = _code(ctx), _spec(ctx)
    none = F.lit(None).cast("bigint")

    def shape(df, kind, pos, s_pos):
        return df.select(F.lit(kind).alias("kind"), "scan_id", pos.alias("pos"), s_pos.alias("s_pos"))

    return (
        shape(_pairs(ctx), "matched", c("pos"), c("s_pos"))
        .unionByName(shape(op.code_only(code, spec), "code_only", c("pos"), none))
        .unionByName(shape(op.spec_only(code, spec), "spec_only", none, c("pos")))
        .unionByName(shape(op.key_collisions(spec), "collision", none, none))
    )


def _verbs(side: str) -> str:
    order = "CASE method WHEN 'GET' THEN 0 WHEN 'POST' THEN 1 WHEN 'PUT' THEN 2 WHEN 'PATCH' THEN 3 WHEN 'DELETE' THEN 4 ELSE 5 END"
    return f"(SELECT scan_id, np, '[' || string_agg(method, ', ' ORDER BY o) || ']' AS verbs FROM (SELECT DISTINCT scan_id, np, method, {order} AS o FROM {side}) GROUP BY scan_id, np)"


_VM = f"""{_K}, cv AS {_verbs("ce")}, sv AS {_verbs("se")},
 a AS (SELECT co.scan_id, co.np, co.label AS endpoint, 'Code exposes ' || method || ' ' || path || ' but the spec defines ' || verbs || ' for that path' AS summary FROM co JOIN sv USING (scan_id, np)),
 b AS (SELECT so.scan_id, so.label AS endpoint, 'Spec documents ' || method || ' ' || path || ' but the code exposes ' || verbs || ' on that path' AS summary,
       row_number() OVER (PARTITION BY so.scan_id, so.np ORDER BY pos) AS rn
       FROM so JOIN cv USING (scan_id, np) WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.scan_id = so.scan_id AND a.np = so.np))"""


@query("jn_2", f"""WITH {_VM} SELECT scan_id, 'VERB_MISMATCH' AS type, endpoint, summary, 'HIGH' AS confidence FROM a
   UNION ALL SELECT scan_id, 'VERB_MISMATCH', endpoint, summary, 'HIGH' FROM b WHERE rn = 1""")  # fmt: skip
def jn_2(ctx):
    return op.verb_mismatch(_code(ctx), _spec(ctx))


@query("jn_3", f"""WITH {_K} SELECT scan_id, 'MISSING_ENDPOINT' AS type, label AS endpoint, 'Endpoint ' || label || ' exists in code but is missing from the spec' AS summary,
   'HIGH' AS confidence FROM co WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.scan_id = co.scan_id AND se.np = co.np)""")  # fmt: skip
def jn_3(ctx):
    return op.missing_endpoints(_code(ctx), _spec(ctx))


@query(
    "jn_4",
    f"""WITH {_K}, inc AS (SELECT DISTINCT scan_id FROM fx_code_endpoints WHERE contains(blind_spot, 'mappings declared on interfaces are not analysed')),
    x AS (SELECT so.*, inc.scan_id IS NOT NULL AS i FROM so LEFT JOIN inc USING (scan_id) WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.scan_id = so.scan_id AND ce.np = so.np))
    SELECT scan_id, 'EXTRA_ENDPOINT' AS type, label AS endpoint, 'Endpoint ' || label || ' is in the spec but not found in code (dead spec?)' AS summary, 'MEDIUM' AS confidence FROM x WHERE NOT i
    UNION ALL SELECT scan_id, 'EXTRA_ENDPOINT', 'code-extraction-incomplete', count(*) || ' spec endpoint(s) could not be cross-checked against code', 'LOW' FROM x WHERE i GROUP BY scan_id""",
)
def jn_4(ctx):
    return op.extra_endpoints(_code(ctx), _spec(ctx), _blind(ctx))


@fixture
def spec_docs_meta(d) -> str:
    return f"""
    SELECT doc_id AS spec_id, CASE WHEN doc_id % 9 > 0 THEN '3.0.1' END AS openapi,
           CASE WHEN doc_id % 4 = 0 THEN ' ' ELSE source END AS title, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE lang END AS version,
           text AS message FROM {d.t("documents")}"""


@query(
    "jn_5",
    """SELECT spec_id, 'MISSING_INFO_FIELD' AS type, 'Spec is missing info.title' AS summary, 'MEDIUM' AS confidence FROM fx_spec_docs_meta
       WHERE openapi IS NOT NULL AND coalesce(trim(title), '') = ''
    UNION ALL SELECT spec_id, 'MISSING_INFO_FIELD', 'Spec is missing info.version', 'MEDIUM' FROM fx_spec_docs_meta WHERE openapi IS NOT NULL AND coalesce(trim(version), '') = ''
    UNION ALL SELECT spec_id, CASE WHEN message ILIKE '%ref%' THEN 'UNRESOLVED_REF' ELSE 'OPENAPI_PARSE_ERROR' END, message, 'HIGH' FROM fx_spec_docs_meta""",
)
def jn_5(ctx):
    meta = ctx.fx("spec_docs_meta")
    return op.l1_findings(meta, meta.select("spec_id", "message"))


@query(
    "jn_6",
    rf"""WITH {_K}, v AS (SELECT *, regexp_extract_all(path, '\{{([^}}]*)\}}', 1) AS cv, regexp_extract_all(s_path, '\{{([^}}]*)\}}', 1) AS sv FROM m)
    SELECT scan_id, 'PATH_VAR_NAME_MISMATCH' AS type, label AS endpoint, 'Path variable names differ — code ' || {_list("cv")} || ' vs spec ' || {_list("sv")} AS summary,
      'HIGH' AS confidence FROM v WHERE cv <> sv AND len(cv) = len(sv)""",
)
def jn_6(ctx):
    return op.path_var_diff(_pairs(ctx))


# --- parameters --------------------------------------------------------------------------------------


def _params(d, side: str) -> str:
    parts = []
    code = side == "code"
    for k, (name, loc) in enumerate([("limit", "QUERY"), ("X-Trace", "HEADER"), ("sort", "QUERY"), ("id", "PATH"), ("q", None)]):
        keep = f"(pos + {k}) % 6 <> 1" if code else f"(pos + {k}) % 5 <> 2"
        shown = name if code else name.lower()
        t = pick(f"(pos + {k}) % 4" if code else f"(pos + 2 * {k}) % 4", ["integer", "string", "object", None])
        location = "NULL" if loc is None else f"'{loc}'"
        parts.append(f"""
        SELECT scan_id, pos AS ep, {k} AS pos, '{shown}' AS name, CAST({location} AS STRING) AS location, {t} AS type,
               CASE WHEN pos % 3 = 0 THEN 'int{32 if code else 64}' END AS format, (pos + {k}) % {2 if code else 3} = 0 AS required,
               {constraints(d, f"(pos + {k})", "0" if code else f"(pos % 3)")} AS constraints
        FROM fx_{side}_endpoints WHERE {keep} {"" if code else "AND spec_id = 'A'"}""")
    return " UNION ALL ".join(parts)


@fixture
def code_params(d) -> str:
    return _params(d, "code")


@fixture
def spec_params(d) -> str:
    return _params(d, "spec")


_PK = "coalesce(location, '?') || ':' || CASE WHEN location = 'HEADER' THEN lower(coalesce(name, '')) ELSE coalesce(name, '') END"
_PARAM_ORACLE = f"""WITH {_K},
 cp AS (SELECT p.*, m.s_pos, m.label, {_PK} AS pk FROM fx_code_params p JOIN m ON m.scan_id = p.scan_id AND m.pos = p.ep),
 sp AS (SELECT p.*, {_PK} AS pk FROM fx_spec_params p),
 sl2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, ep, pk ORDER BY pos DESC) AS rn FROM sp) WHERE rn = 1),
 j AS (SELECT cp.scan_id, cp.label, cp.name, cp.location, cp.type AS ct, cp.format AS cf, cp.required AS cr, cp.constraints AS cc,
         s.pk AS spk, s.type AS st, s.format AS sf, s.required AS sr, s.constraints AS scn
       FROM cp LEFT JOIN sl2 s ON s.scan_id = cp.scan_id AND s.ep = cp.s_pos AND s.pk = cp.pk WHERE cp.location IS DISTINCT FROM 'PATH'),
 w AS (SELECT *, 'Parameter ''' || name || '''' AS who, coalesce(ct = 'object', false) OR coalesce(st = 'object', false) AS wild, {_NONE("cc")} AS cn, {_NONE("scn")} AS sn,
        {duck_constraint("cc", "scn", "ct = 'integer'", "st = 'integer'")} AS diff FROM j),
 flat AS (SELECT DISTINCT scan_id, pos FROM fx_code_endpoints WHERE pos % 4 = 0),
 r AS (
 SELECT scan_id, label AS endpoint, 'PARAM_MISSING' AS type, who || ' (' || coalesce(location, 'null') || ') is in code but missing from the spec' AS summary, 'HIGH' AS confidence FROM w WHERE spk IS NULL
 UNION ALL SELECT scan_id, label, 'PARAM_TYPE_MISMATCH', who || ' type — code ' || ct || ' vs spec ' || st, 'MEDIUM' FROM w WHERE spk IS NOT NULL AND NOT wild AND ct <> st
 UNION ALL SELECT scan_id, label, 'PARAM_TYPE_MISMATCH', who || ' type — code declares ' || ct || ' but the spec omits a type (under-specified)', 'LOW' FROM w WHERE spk IS NOT NULL AND NOT wild AND ct IS NOT NULL AND st IS NULL
 UNION ALL SELECT scan_id, label, 'PARAM_REQUIRED_MISMATCH', who || ' required — code ' || cr || ' vs spec ' || sr, 'MEDIUM' FROM w WHERE spk IS NOT NULL AND cr <> sr
 UNION ALL SELECT scan_id, label, 'CONSTRAINT_GAP', who || ' format — code ' || cf || ' vs spec ' || sf, 'LOW' FROM w WHERE cf <> sf
 UNION ALL SELECT scan_id, label, 'CONSTRAINT_GAP', who || ' has code constraints not exposed in the spec', 'MEDIUM' FROM w WHERE spk IS NOT NULL AND NOT cn AND sn
 UNION ALL SELECT scan_id, label, 'CONSTRAINT_GAP', who || ' constraint mismatch — ' || diff, 'MEDIUM' FROM w WHERE spk IS NOT NULL AND NOT cn AND NOT sn AND diff IS NOT NULL
 UNION ALL SELECT scan_id, label, 'CONSTRAINT_GAP', CASE WHEN scn.enumFromDescription THEN who || ' — the spec''s description documents the allowed values ' || {_list("scn.enumValues")} ||
   ', but the schema doesn''t formally constrain them and the code doesn''t enforce them at the API boundary' ELSE who || ' — the spec restricts it to ' || {_list("scn.enumValues")} ||
   ' but the code binds it without that enum (allowed values not enforced at the API boundary)' END, 'LOW' FROM w WHERE spk IS NOT NULL AND cn AND len(scn.enumValues) > 0
 UNION ALL SELECT sp.scan_id, m.label, 'PARAM_EXTRA', 'Parameter ''' || sp.name || ''' (' || coalesce(sp.location, 'null') || ') is in the spec but not in code', 'MEDIUM'
   FROM sp JOIN m ON m.scan_id = sp.scan_id AND m.s_pos = sp.ep LEFT JOIN flat ON flat.scan_id = m.scan_id AND flat.pos = m.pos
   WHERE sp.location IS DISTINCT FROM 'PATH' AND NOT (flat.pos IS NOT NULL AND coalesce(sp.location, 'QUERY') = 'QUERY')
     AND NOT EXISTS (SELECT 1 FROM cp WHERE cp.scan_id = sp.scan_id AND cp.ep = m.pos AND cp.pk = sp.pk))
 SELECT scan_id, endpoint, type, summary, confidence FROM r"""


@query("jn_7", _PARAM_ORACLE)
def jn_7(ctx):
    handler = F.concat(F.lit("C.op"), c("pos"))
    pairs = _pairs(ctx).withColumn("handler", handler)
    blind = _code(ctx).filter(c("pos") % 4 == 0).select(
        "scan_id", F.concat(F.lit("Controller "), handler, F.lit(" binds all query params into a map")).alias("text")
    )
    return op.param_diff(pairs, ctx.fx("code_params"), ctx.fx("spec_params"), blind)


# --- statuses, security, media -------------------------------------------------------------------------


def _media(d, seed: str) -> str:
    sets = [
        d.array("'application/json'"), d.array("'application/*'", "'text/html; charset=utf-8'"), d.array("'*/*'"),
        d.array("'application/problem+json'"), d.array("'application/*+json'"), d.array("'junk'", "' '"),
        d.array("'text/html'", "'APPLICATION/JSON'"), "NULL",
    ]
    return f"CASE {seed} % 8 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(sets)) + " END"


def _responses(d, side: str) -> str:
    code = side == "code"
    parts = []
    for k, status in enumerate([200, 302, 404, 201, 500]):
        keep = f"(pos + {k}) % 4 <> 0" if code else f"(pos + 2 * {k}) % 5 <> 1"
        origin = pick(f"(pos + {k}) % 3", ["EXCEPTION_HANDLER", "EXCEPTION_HANDLER_REACHABLE", None]) if code else "'SPEC'"
        parts.append(f"""
        SELECT scan_id, pos AS ep, {k} AS pos, {status} AS status, {origin} AS origin,
               {_media(d, f"(pos + {k})" if code else f"(pos * 3 + {k})")} AS media_types
        FROM fx_{side}_endpoints WHERE {keep} {"" if code else "AND spec_id = 'A'"}""")
    return " UNION ALL ".join(parts)


@fixture
def code_responses(d) -> str:
    return _responses(d, "code")


@fixture
def spec_responses(d) -> str:
    return _responses(d, "spec")


@query(
    "jn_9",
    f"""WITH {_K}, cr AS (SELECT r.*, m.label, m.s_pos FROM fx_code_responses r JOIN m ON m.scan_id = r.scan_id AND m.pos = r.ep),
    sr AS (SELECT r.*, m.label, m.pos AS c_pos FROM fx_spec_responses r JOIN m ON m.scan_id = r.scan_id AND m.s_pos = r.ep),
    ok AS (SELECT scan_id, ep, s_pos, label, arg_min(status, pos) AS status FROM cr WHERE status BETWEEN 200 AND 299 GROUP BY ALL)
    SELECT scan_id, label AS endpoint, 'STATUS_CODE_MISSING' AS type, 'Code returns ' || status || ' but the spec doesn''t document it' AS summary, 'MEDIUM' AS confidence FROM ok
      WHERE NOT EXISTS (SELECT 1 FROM fx_spec_responses s WHERE s.scan_id = ok.scan_id AND s.ep = ok.s_pos AND s.status = ok.status)
    UNION ALL SELECT scan_id, label, 'STATUS_CODE_MISSING', 'Code can return ' || status || ' but the spec doesn''t document it', CASE WHEN origin = 'EXCEPTION_HANDLER' THEN 'LOW' ELSE 'MEDIUM' END FROM cr
      WHERE status >= 300 AND NOT EXISTS (SELECT 1 FROM fx_spec_responses s WHERE s.scan_id = cr.scan_id AND s.ep = cr.s_pos AND s.status = cr.status)
    UNION ALL SELECT scan_id, label, 'STATUS_CODE_EXTRA', 'Spec documents ' || CASE WHEN status < 300 THEN 'success' ELSE 'redirect' END || ' status ' || status || ' but the code never returns it', 'LOW' FROM sr
      WHERE status BETWEEN 200 AND 399 AND NOT EXISTS (SELECT 1 FROM fx_code_responses x WHERE x.scan_id = sr.scan_id AND x.ep = sr.c_pos AND x.status = sr.status)""",
)
def jn_9(ctx):
    return op.status_diff(_pairs(ctx), ctx.fx("code_responses"), ctx.fx("spec_responses"))


def _base(x: str) -> str:
    return f"nullif(trim(split_part(lower({x}), ';', 1)), '')"


def _bases(x: str) -> str:
    return f"list_filter(list_transform(coalesce({x}, []), lambda q: {_base('q')}), lambda q: q IS NOT NULL)"


def duck_compatible(a: str, b: str) -> str:
    def one(x: str, y: str) -> str:
        t1, t2, s1, s2 = f"split_part({x},'/',1)", f"split_part({y},'/',1)", f"split_part({x},'/',2)", f"split_part({y},'/',2)"
        f1 = f"CASE WHEN contains({s1}, '+') THEN split_part({s1}, '+', -1) END"
        f2 = f"CASE WHEN contains({s2}, '+') THEN split_part({s2}, '+', -1) END"
        w1 = f"coalesce(starts_with({s1}, '*+') AND (({f1}) = {s2} OR coalesce(({f1}) = ({f2}), false)), false)"
        w2 = f"coalesce(starts_with({s2}, '*+') AND (({f2}) = {s1} OR coalesce(({f1}) = ({f2}), false)), false)"
        return f"({t1} = '*' OR {t2} = '*' OR ({t1} = {t2} AND ({s1} = {s2} OR {s1} = '*' OR {s2} = '*' OR {w1} OR {w2})))"

    x, y = _bases(a), _bases(b)
    odd = f"(len({x}) = 0 OR len({y}) = 0 OR len(list_filter(list_concat({x}, {y}), lambda q: NOT contains(q, '/'))) > 0)"
    fwd = f"len(list_filter({x}, lambda p: len(list_filter({y}, lambda q: {one('p', 'q')})) = 0)) = 0"
    bwd = f"len(list_filter({y}, lambda q: len(list_filter({x}, lambda p: {one('p', 'q')})) = 0)) = 0"
    return f"CASE WHEN {odd} THEN list_sort(list_distinct({x})) = list_sort(list_distinct({y})) ELSE {fwd} AND {bwd} END"


@query(
    "jn_12",
    f"""WITH {_K}, cr AS (SELECT r.*, m.label, m.s_pos FROM fx_code_responses r JOIN m ON m.scan_id = r.scan_id AND m.pos = r.ep WHERE status >= 300),
    j AS (SELECT cr.scan_id, cr.label, cr.status, cr.origin, cr.media_types AS a, s.media_types AS b FROM cr JOIN fx_spec_responses s ON s.scan_id = cr.scan_id AND s.ep = cr.s_pos AND s.status = cr.status)
    SELECT scan_id, label AS endpoint, 'CONSUMES_PRODUCES_MISMATCH' AS type, 'Error ' || status || ' media type — code ' || {_list("a")} || ' vs spec ' || {_list("b")} AS summary,
      CASE WHEN starts_with(origin, 'EXCEPTION_HANDLER') THEN 'LOW' ELSE 'MEDIUM' END AS confidence FROM j WHERE len(a) > 0 AND len(b) > 0 AND NOT ({duck_compatible("a", "b")})""",
)
def jn_12(ctx):
    return op.error_media_diff(_pairs(ctx), ctx.fx("code_responses"), ctx.fx("spec_responses"))


@fixture
def wide_code(d) -> str:
    sec = f"CASE pos % 5 WHEN 0 THEN {d.array(repr('role:A'))} WHEN 1 THEN {d.array(repr('unresolved:x'))} WHEN 2 THEN {d.array(repr('unresolved:x'), repr('auth'))} END"
    return f"""
    SELECT scan_id, pos, method, path, {sec} AS security, {_media(d, "pos")} AS produces, CASE WHEN pos % 3 > 0 THEN {_media(d, "(pos + 2)")} END AS consumes,
           {_media(d, "(pos + 5)")} AS body_media, pos % 4 < 3 AS body_ref_present,
           CASE WHEN pos % 31 = 7 THEN 'security is set in a SecurityFilterChain bean' END AS blind_spot FROM fx_code_endpoints"""


@fixture
def wide_spec(d) -> str:
    sec = f"CASE pos % 4 WHEN 0 THEN {d.array(repr('oauth'), repr('key'))} WHEN 1 THEN {d.array(repr('basic'))} END"
    return f"""
    SELECT scan_id, pos, method, path, {sec} AS security, {_media(d, "(pos * 3)")} AS produces, {_media(d, "(pos * 5 + 1)")} AS consumes,
           {_media(d, "(pos + 4)")} AS body_media, pos % 3 < 2 AS body_ref_present FROM fx_spec_endpoints WHERE spec_id = 'A'"""


_WIDE = f"""{_K}, wm AS (SELECT m.scan_id, m.label, m.s_pos, a.security AS cs, b.security AS ss, a.produces AS cp, b.produces AS sp, a.consumes AS cc, b.consumes AS scn,
   a.body_media AS cb, b.body_media AS sb, a.body_ref_present AS cbp, b.body_ref_present AS sbp FROM m
   JOIN fx_wide_code a ON a.scan_id = m.scan_id AND a.pos = m.pos JOIN fx_wide_spec b ON b.scan_id = m.scan_id AND b.pos = m.s_pos)"""


def _wide(ctx):
    return op.matched(ctx.fx("wide_code"), ctx.fx("wide_spec"))


@query("jn_8", f"""WITH {_WIDE} SELECT scan_id, 'REQUEST_BODY_PRESENCE_MISMATCH' AS type, label AS endpoint,
   'Request body presence — code ' || cbp || ' vs spec ' || sbp AS summary, 'HIGH' AS confidence FROM wm WHERE cbp <> sbp""")  # fmt: skip
def jn_8(ctx):
    return op.body_presence(_wide(ctx))


@query(
    "jn_10",
    f"""WITH {_WIDE}, cen AS (SELECT DISTINCT scan_id FROM fx_wide_code WHERE blind_spot IS NOT NULL)
    SELECT scan_id, label AS endpoint, 'SECURITY_MISMATCH' AS type, 'Code enforces authorization (' || array_to_string(cs, ', ') || ') but the spec declares no security for this operation' AS summary, 'HIGH' AS confidence
      FROM wm WHERE len(cs) > 0 AND coalesce(len(ss), 0) = 0 AND len(list_filter(cs, lambda t: NOT starts_with(t, 'unresolved:'))) > 0
    UNION ALL SELECT scan_id, label, 'SECURITY_MISMATCH', 'Spec requires security (' || array_to_string(ss, ', ') || ') but the code enforces none on this endpoint', 'MEDIUM'
      FROM wm WHERE coalesce(len(cs), 0) = 0 AND len(ss) > 0 AND scan_id NOT IN (SELECT scan_id FROM cen)""",
)
def jn_10(ctx):
    blind = ctx.fx("wide_code").filter(c("blind_spot").isNotNull()).select("scan_id", c("blind_spot").alias("text"))
    return op.security_diff(_wide(ctx), blind)


@query(
    "jn_11",
    f"""WITH {_WIDE}, er AS (SELECT scan_id, ep, list(b) AS benign FROM (SELECT DISTINCT scan_id, ep, unnest({_bases("media_types")}) AS b FROM fx_spec_responses WHERE status >= 300) GROUP BY ALL),
    x AS (SELECT wm.*, list_filter(cp, lambda q: NOT coalesce(list_contains(coalesce(benign, []), {_base("q")}), false)) AS eff FROM wm LEFT JOIN er ON er.scan_id = wm.scan_id AND er.ep = wm.s_pos),
    y AS (SELECT scan_id, label, 'produces' AS k, cp AS shown, eff AS a, sp AS b FROM x UNION ALL SELECT scan_id, label, 'consumes', cc, cc, scn FROM x
          UNION ALL SELECT scan_id, label, 'request body content', cb, cb, sb FROM x WHERE coalesce(len(cc), 0) = 0)
    SELECT scan_id, label AS endpoint, 'CONSUMES_PRODUCES_MISMATCH' AS type, k || ' media types — code ' || {_list("shown")} || ' vs spec ' || {_list("b")} AS summary, 'LOW' AS confidence
    FROM y WHERE len(a) > 0 AND len(b) > 0 AND NOT ({duck_compatible("a", "b")})""",
)
def jn_11(ctx):
    return op.media_diff(_wide(ctx), ctx.fx("spec_responses"))


# --- constraints ---------------------------------------------------------------------------------------


@fixture
def constraint_pairs(d) -> str:
    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {constraints(d, "l_partkey", "0")} AS cc,
           CASE WHEN l_suppkey % 13 = 0 THEN NULL ELSE {constraints(d, "l_partkey", "(l_suppkey % 3)")} END AS sc,
           l_linenumber % 2 = 0 AS ci, l_linenumber % 3 = 0 AS si FROM {d.t("lineitem")}"""


@query(
    "jn_17",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN cc IS NOT NULL AND sc IS NOT NULL THEN {duck_constraint("cc", "sc", "ci", "si")} END AS diff FROM fx_constraint_pairs""",
)
def jn_17(ctx):
    return ctx.fx("constraint_pairs").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        ct.constraint_diff(c("cc"), c("sc"), c("ci"), c("si")).alias("diff"),
    )


@fixture
def value_sets(d) -> str:
    return f"""
    SELECT p_partkey, {d.array("p_type", "p_brand", "lower(p_type)")} AS a,
           CASE p_partkey % 4 WHEN 0 THEN {d.array("lower(p_brand)", "p_type")} WHEN 1 THEN {d.array("p_type")} WHEN 2 THEN NULL
                ELSE {d.array("p_brand", "p_type", "p_name")} END AS b FROM {d.t("part")}"""


@query("set_3", f"SELECT p_partkey, {_set('a')} = {_set('b')} AS same FROM fx_value_sets")
def set_3(ctx):
    return ctx.fx("value_sets").select("p_partkey", ct.same_set(c("a"), c("b")).alias("same"))


# --- specs against specs ---------------------------------------------------------------------------------

_ALL = f"""e AS (SELECT *, method || ' ' || {duck.norm_path('path')} AS key, method || ' ' || path AS label FROM fx_spec_endpoints)"""


@query(
    "jn_18",
    f"""WITH {_ALL}, s AS (SELECT DISTINCT scan_id, spec_id FROM e)
    SELECT e.scan_id, 'SPEC_DRIFT' AS type, e.label AS endpoint, least(e.spec_id, o.spec_id) || ' vs ' || greatest(e.spec_id, o.spec_id) AS spec_source,
      e.label || ' is in ' || e.spec_id || ' but not in ' || o.spec_id AS summary, 'HIGH' AS confidence
    FROM e JOIN s o ON o.scan_id = e.scan_id AND o.spec_id <> e.spec_id
    WHERE NOT EXISTS (SELECT 1 FROM e k WHERE k.scan_id = e.scan_id AND k.spec_id = o.spec_id AND k.key = e.key)""",
)
def jn_18(ctx):
    e = ctx.fx("spec_endpoints")
    specs = e.select("scan_id", "spec_id").distinct().withColumn("spec_pos", F.ascii("spec_id"))
    return op.spec_drift(specs, e)


@query("set_2", f"""WITH {_ALL}, a AS (SELECT scan_id, key FROM e WHERE spec_id = 'A'), b AS (SELECT scan_id, key FROM e WHERE spec_id = 'B')
   SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")  # fmt: skip
def set_2(ctx):
    e = ctx.fx("spec_endpoints")
    return op.spec_minus_spec(e.filter(c("spec_id") == "A"), e.filter(c("spec_id") == "B"))


@fixture
def security_rules(d) -> str:
    rows = [
        (0, "'/en/**'", d.array("'GET'")), (1, "'/fr/**'", d.array("'POST'", "'PUT'")), (2, "'/en/claims'", d.array("'DELETE'")),
        (3, "'/de/*/{id}'", d.array("'DELETE'")), (4, "'/es/Orders/'", d.array("'GET'")), (5, "'/fr/quotes/**'", d.array("'POST'")),
    ]
    out = [
        f"SELECT DISTINCT scan_id, {n} AS pos, concat('r', {n}) AS rule_id, {p} AS pattern, {m} AS methods, false AS any_request FROM fx_endpoints"
        for n, p, m in rows
    ]
    out.append(
        f"SELECT scan_id, 9, 'default', CAST(NULL AS STRING), {d.array(repr('GET'))}, true FROM fx_endpoints GROUP BY scan_id HAVING count(*) > 2"
    )
    return " UNION ALL ".join(out)


@query(
    "jn_19",
    r"""WITH p AS (SELECT e.scan_id, e.pos, e.verb AS method, e.path, r.rule_id, r.pattern,
        CASE WHEN r.pattern LIKE '%/**' THEN starts_with(e.path || '/', replace(r.pattern, '**', '')) ELSE e.path = r.pattern END AS hit,
        r.pattern LIKE '%*/%' AND regexp_matches(e.path, '^/de/[^/]*/\{id\}$') AS odd1,
        r.pattern NOT LIKE '%*%' AND e.path <> r.pattern AND rtrim(e.path, '/') = rtrim(r.pattern, '/') AS odd2, r.pattern LIKE '%*/%' AS gl
      FROM fx_endpoints e JOIN fx_security_rules r ON r.scan_id = e.scan_id AND NOT r.any_request AND list_contains(r.methods, e.verb)),
    g AS (SELECT scan_id, pos, count(*) FILTER (WHERE hit AND NOT gl) AS n, max(rule_id) FILTER (WHERE hit AND NOT gl) AS r, bool_or(odd1 OR odd2) AS odd FROM p GROUP BY ALL),
    d AS (SELECT scan_id, rule_id AS dr FROM fx_security_rules WHERE any_request)
    SELECT e.scan_id, e.pos, e.verb AS method, e.path, CASE WHEN coalesce(odd, false) OR coalesce(n, 0) > 1 THEN NULL WHEN n = 1 THEN r ELSE dr END AS rule_id
    FROM fx_endpoints e LEFT JOIN g ON g.scan_id = e.scan_id AND g.pos = e.pos LEFT JOIN d ON d.scan_id = e.scan_id""",
)
def jn_19(ctx):
    e = ctx.fx("endpoints").withColumnRenamed("verb", "method")
    return op.resolve_security(e, ctx.fx("security_rules"))


# --- schemas --------------------------------------------------------------------------------------------


def _svc(d) -> str:
    return f"concat('svc-', {d.idiv('p_partkey', '88')})"


def _name(d, n: str, spec: bool) -> str:
    if not spec:
        return f"concat('S', {n})"
    return f"CASE WHEN {d.idiv('p_partkey', '88')} % 2 = 1 AND {n} >= 4 THEN concat('T', {n}) ELSE concat('S', {n}) END"


def _fields(d, spec: bool) -> str:
    n, target = "(p_partkey % 8)", "((p_partkey + 1 + p_partkey % 3) % 8)"
    has_ref = f"p_partkey % 6 = 1{' AND p_partkey % 42 <> 1' if spec else ''}"
    arr = f"CASE WHEN p_partkey % 18 = 1{' OR p_partkey % 30 = 1' if spec else ''} THEN '[]' ELSE '' END"
    typ = pick(f"(p_partkey + {'p_partkey % 9 / 8' if False else '0'}) % 4", ["string", "integer", "number", None])
    if spec:
        typ = f"CASE WHEN p_partkey % 9 = 0 THEN 'boolean' ELSE {typ} END"
    drop = f"{'p_partkey % 23 <> 0' if spec else 'p_partkey % 29 <> 0'} AND NOT (p_partkey % 8 = 7 AND {d.idiv('p_partkey', '88')} % 3 = {0 if spec else 1})"
    return f"""
    SELECT {_svc(d)} AS scan_id, {_name(d, n, spec)} AS schema, p_partkey AS pos, concat('f', p_partkey % 11) AS field,
           CASE WHEN {has_ref} THEN CASE WHEN p_partkey % 5 = 0 THEN 'array' ELSE 'object' END ELSE {typ} END AS type,
           CASE WHEN p_partkey % 10 = 0 THEN '{"uuid" if spec else "date"}' END AS format, p_partkey % {5 if spec else 3} = 0 AS required,
           CASE WHEN {has_ref} THEN concat({_name(d, target, spec)}, {arr}) END AS ref_schema,
           CASE WHEN p_partkey % 4 = 0 THEN {constraints(d, "p_partkey", "(p_size % 2)" if spec else "0")} END AS constraints
    FROM {d.t("part")} WHERE {drop}"""


@fixture
def code_fields(d) -> str:
    return _fields(d, False)


@fixture
def spec_fields(d) -> str:
    return _fields(d, True)


def _schemas(d, spec: bool) -> str:
    enum = f"CASE WHEN p_partkey % 8 = 6 THEN {d.array(repr('A'), repr('B'))} END"
    if spec:
        enum = f"CASE WHEN p_partkey % 8 = 6 THEN CASE WHEN {d.idiv('p_partkey', '88')} % 5 = 0 THEN {d.array(repr('b'))} ELSE {d.array(repr('b'), repr('a'))} END END"
    return f"""
    SELECT {_svc(d)} AS scan_id, {_name(d, "(p_partkey % 8)", spec)} AS schema, {enum} AS enum_values,
           CASE WHEN {d.idiv('p_partkey', '88')} % 2 = 0 THEN 'object' END AS type
    FROM {d.t("part")} WHERE p_partkey % 11 = 0"""


@fixture
def code_schemas(d) -> str:
    return _schemas(d, False)


@fixture
def spec_schemas(d) -> str:
    return _schemas(d, True)


@fixture
def schema_blind_spots(d) -> str:
    return f"""
    SELECT {_svc(d)} AS scan_id, concat('Spec schema ''S', p_partkey % 8, ''' uses oneOf composition; not compared') AS text
    FROM {d.t("part")} WHERE p_partkey % 88 = 55 AND {d.idiv('p_partkey', '88')} % 12 = 0"""


@fixture
def bindings(d) -> str:
    return f"""
    SELECT {_svc(d)} AS scan_id, p_partkey AS binding_id, {pick("p_partkey % 2", ["BODY", "RESPONSE"])} AS kind,
           concat('GET /x', p_partkey % 88) AS locus,
           concat(CASE WHEN p_partkey % 88 = 80 THEN 'String' ELSE concat('S', p_partkey % 8) END, CASE WHEN p_partkey % 3 = 0 THEN '[]' ELSE '' END) AS code_ref,
           concat({_name(d, "((p_partkey + p_partkey % 10 / 9) % 8)".replace("p_partkey % 10 / 9", d.idiv("p_partkey % 10", "9")), True)},
                  CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 > 0 THEN '[]' ELSE '' END) AS spec_ref
    FROM {d.t("part")}"""


_INFO = """ci AS (SELECT s.*, coalesce(n, 0) > 0 AS hf, coalesce(n, 0) = 0 AND coalesce(len(enum_values), 0) = 0 AS sl FROM fx_code_schemas s
     LEFT JOIN (SELECT scan_id, schema, count(*) AS n FROM fx_code_fields GROUP BY ALL) USING (scan_id, schema)),
 si0 AS (SELECT s.*, coalesce(n, 0) > 0 AS hf, coalesce(n, 0) = 0 AND coalesce(len(enum_values), 0) = 0 AS sl FROM fx_spec_schemas s
     LEFT JOIN (SELECT scan_id, schema, count(*) AS n FROM fx_spec_fields GROUP BY ALL) USING (scan_id, schema)),
 si AS (SELECT *, sl AND NOT (coalesce(type = 'object', false) AND NOT EXISTS (SELECT 1 FROM fx_schema_blind_spots b WHERE b.scan_id = si0.scan_id
     AND contains(b.text, '''' || si0.schema || '''') AND contains(b.text, 'composition'))) AS skip FROM si0),
 cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, schema, field ORDER BY pos DESC) AS rn FROM fx_code_fields) WHERE rn = 1),
 sl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, schema, field ORDER BY pos DESC) AS rn FROM fx_spec_fields) WHERE rn = 1)"""


def _field_rows(pairs: str, keep: str) -> str:
    """SELECTs of field findings for a pair relation with scan_id, cs, ss, locus and the kept columns."""
    diff = duck_constraint("x.cc", "x.sc", "x.ct = 'integer'", "x.st = 'integer'")
    j = f"""(SELECT p.*, f.field, f.type AS ct, f.format AS cf, f.required AS cr, f.constraints AS cc, s.field AS sfield, s.type AS st, s.format AS sf, s.required AS sr, s.constraints AS sc
       FROM {pairs} p JOIN fx_code_fields f ON f.scan_id = p.scan_id AND f.schema = p.cs LEFT JOIN sl s ON s.scan_id = p.scan_id AND s.schema = p.ss AND s.field = f.field)"""
    head = f"{keep}, x.locus || '.' || x.field AS endpoint"
    who = "'Field ''' || x.field || ''''"
    cn, sn = _NONE("x.cc"), _NONE("x.sc")
    return f"""SELECT {head}, 'SCHEMA_FIELD_MISSING' AS type, {who} || ' of ' || x.locus || ' is in code but missing from the spec schema' AS summary, 'HIGH' AS confidence FROM {j} x WHERE sfield IS NULL
 UNION ALL SELECT {head}, 'SCHEMA_FIELD_TYPE_MISMATCH', {who} || ' type — code ' || ct || ' vs spec ' || st, 'MEDIUM' FROM {j} x WHERE ct <> st AND ct <> 'object' AND st <> 'object'
 UNION ALL SELECT {head}, 'CONSTRAINT_GAP', {who} || ' is required in code but optional in the spec', 'MEDIUM' FROM {j} x WHERE cr AND NOT sr
 UNION ALL SELECT {head}, 'CONSTRAINT_GAP', {who} || ' format — code ' || cf || ' vs spec ' || sf, 'LOW' FROM {j} x WHERE cf <> sf
 UNION ALL SELECT {head}, 'CONSTRAINT_GAP', {who} || ' has code constraints not exposed in the spec', 'MEDIUM' FROM {j} x WHERE sfield IS NOT NULL AND NOT {cn} AND {sn}
 UNION ALL SELECT {head}, 'CONSTRAINT_GAP', {who} || ' constraint mismatch — ' || {diff}, 'MEDIUM' FROM {j} x WHERE sfield IS NOT NULL AND NOT {cn} AND NOT {sn} AND {diff} IS NOT NULL
 UNION ALL SELECT {keep}, x.locus || '.' || f.field, 'SCHEMA_FIELD_EXTRA', 'Field ''' || f.field || ''' of ' || x.locus || ' is in the spec but not in code', 'LOW'
   FROM {pairs} x JOIN fx_spec_fields f ON f.scan_id = x.scan_id AND f.schema = x.ss WHERE NOT EXISTS (SELECT 1 FROM fx_code_fields k WHERE k.scan_id = x.scan_id AND k.schema = x.cs AND k.field = f.field)"""


@query(
    "jn_13",
    f"""WITH {_INFO}, pr AS (SELECT scan_id, schema AS cs, schema AS ss, schema AS locus FROM ci JOIN si USING (scan_id, schema) WHERE NOT skip)
    SELECT DISTINCT scan_id, type, endpoint, summary, confidence FROM ({_field_rows("pr", "x.scan_id")})""",
)
def jn_13(ctx):
    return sc.field_diff(*_schema_tables(ctx)).drop("spec_locus").distinct()


def _schema_tables(ctx):
    return [ctx.fx(t) for t in ("code_schemas", "code_fields", "spec_schemas", "spec_fields", "schema_blind_spots")]


_ARR = "coalesce({0} LIKE '%[]', false)".format
_STEP = """(SELECT n.*, c.field, c.type AS ct, c.ref_schema AS cref, s.type AS st, s.ref_schema AS sref FROM {0} n
  JOIN cl c ON c.scan_id = n.scan_id AND c.schema = n.cs JOIN sl s ON s.scan_id = n.scan_id AND s.schema = n.ss AND s.field = c.field)""".format
_TREE = f"""WITH RECURSIVE {_INFO},
 ok AS (SELECT a.scan_id, a.schema AS cs, b.schema AS ss FROM ci a JOIN si b ON a.scan_id = b.scan_id WHERE NOT a.sl AND NOT b.skip),
 link AS (SELECT c.scan_id, c.schema AS cs, s.schema AS ss, c.field, replace(c.ref_schema, '[]', '') AS nc, replace(s.ref_schema, '[]', '') AS ns
   FROM cl c JOIN sl s ON s.scan_id = c.scan_id AND s.field = c.field WHERE c.ref_schema IS NOT NULL AND s.ref_schema IS NOT NULL AND {_ARR("c.ref_schema")} = {_ARR("s.ref_schema")}),
 t AS (SELECT b.scan_id, b.binding_id, b.locus, ok.cs, ok.ss, [ok.cs || '|' || ok.ss] AS visited FROM fx_bindings b
     JOIN ok ON ok.scan_id = b.scan_id AND ok.cs = replace(b.code_ref, '[]', '') AND ok.ss = replace(b.spec_ref, '[]', '') WHERE {_ARR("code_ref")} = {_ARR("spec_ref")}
   UNION ALL
   SELECT t.scan_id, t.binding_id, t.locus || '.' || l.field, l.nc, l.ns, list_append(t.visited, l.nc || '|' || l.ns)
     FROM t JOIN link l ON l.scan_id = t.scan_id AND l.cs = t.cs AND l.ss = t.ss JOIN ok ON ok.scan_id = t.scan_id AND ok.cs = l.nc AND ok.ss = l.ns
     WHERE NOT list_contains(t.visited, l.nc || '|' || l.ns)),
 st AS {_STEP("t")},
 mm AS (SELECT scan_id, binding_id, locus || '.' || field AS endpoint, 'SCHEMA_FIELD_TYPE_MISMATCH' AS type,
     'Field ''' || field || ''' of ' || locus || ' is ' || CASE WHEN cref IS NOT NULL THEN 'a nested object/array in code but a scalar (' || st || ') in the spec'
       ELSE 'a scalar (' || ct || ') in code but a nested object/array in the spec' END AS summary, 'HIGH' AS confidence FROM st
     WHERE (cref IS NULL) <> (sref IS NULL) AND CASE WHEN cref IS NOT NULL THEN st ELSE ct END <> 'object' AND coalesce(CASE WHEN cref IS NOT NULL THEN ct ELSE st END <> 'array', true)
   UNION ALL SELECT scan_id, binding_id, locus || '.' || field, 'SCHEMA_FIELD_TYPE_MISMATCH', 'Field ''' || field || ''' of ' || locus || ' is ' ||
     CASE WHEN {_ARR("cref")} THEN 'an array in code but a single object in the spec' ELSE 'a single object in code but an array in the spec' END, 'HIGH' FROM st
     WHERE cref IS NOT NULL AND sref IS NOT NULL AND {_ARR("cref")} <> {_ARR("sref")}),
 cmp AS (SELECT * FROM ({_field_rows("t", "x.scan_id, x.binding_id, x.cs, x.ss")})),
 em AS (SELECT DISTINCT * FROM (SELECT scan_id, binding_id, endpoint, type, summary, confidence FROM cmp WHERE cs <> ss UNION ALL SELECT * FROM mm)),
 dv AS (SELECT scan_id, binding_id FROM cmp UNION SELECT scan_id, binding_id FROM mm)"""


@query("jn_14", f"{_TREE} SELECT scan_id, binding_id, endpoint, type, summary, confidence FROM em")
def jn_14(ctx):
    return sc.bound_field_diff(ctx.fx("bindings"), *_schema_tables(ctx)).findings.drop("spec_locus").distinct()


_SCALARS = "('string','integer','int','long','short','byte','boolean','double','float','number','bigdecimal','biginteger','character','char','uuid','date','localdate','localdatetime','instant','offsetdatetime','zoneddatetime','void')"
_VERDICT = f"""{_TREE},
 r AS (SELECT b.scan_id, b.binding_id, replace(code_ref, '[]', '') AS cs, replace(spec_ref, '[]', '') AS ss, {_ARR("code_ref")} <> {_ARR("spec_ref")} AS arr FROM fx_bindings b),
 r1 AS (SELECT r.*, ci.schema AS c_has, si.schema AS s_has, ci.sl AS c_sl, si.sl AS s_sl, si.skip FROM r LEFT JOIN ci ON ci.scan_id = r.scan_id AND ci.schema = r.cs LEFT JOIN si ON si.scan_id = r.scan_id AND si.schema = r.ss),
 r2 AS (SELECT *, lower(cs) IN {_SCALARS} AND c_has IS NULL AS csc, lower(ss) IN {_SCALARS} AND s_has IS NULL AS ssc FROM r1),
 r3 AS (SELECT *, CASE WHEN arr THEN 'DIFFER' WHEN csc <> ssc AND coalesce(CASE WHEN csc THEN NOT s_sl ELSE NOT c_sl END, false) THEN 'DIFFER'
        WHEN c_has IS NULL OR s_has IS NULL OR c_sl OR skip THEN 'UNRESOLVED' END AS early FROM r2),
 edge AS (SELECT l.* FROM link l JOIN ci ON ci.scan_id = l.scan_id AND ci.schema = l.cs AND coalesce(len(ci.enum_values), 0) = 0 JOIN si ON si.scan_id = l.scan_id AND si.schema = l.ss AND coalesce(len(si.enum_values), 0) = 0
        JOIN ci c2 ON c2.scan_id = l.scan_id AND c2.schema = l.nc JOIN si s2 ON s2.scan_id = l.scan_id AND s2.schema = l.ns),
 g AS (SELECT scan_id, binding_id, cs, ss FROM r3 WHERE early IS NULL
   UNION SELECT g.scan_id, g.binding_id, e.nc, e.ns FROM g JOIN edge e ON e.scan_id = g.scan_id AND e.cs = g.cs AND e.ss = g.ss),
 nd AS (SELECT DISTINCT scan_id, binding_id, cs, ss FROM g),
 pp AS (SELECT DISTINCT scan_id, cs, ss FROM nd),
 pe AS (SELECT pp.*, ci.enum_values AS ce, si.enum_values AS se FROM pp JOIN ci ON ci.scan_id = pp.scan_id AND ci.schema = pp.cs JOIN si ON si.scan_id = pp.scan_id AND si.schema = pp.ss),
 bad AS (SELECT scan_id, cs, ss FROM pe WHERE (coalesce(len(ce), 0) > 0 OR coalesce(len(se), 0) > 0) AND NOT (coalesce(len(ce), 0) > 0 AND coalesce(len(se), 0) > 0 AND {_set("ce")} = {_set("se")})
   UNION SELECT pe.scan_id, cs, ss FROM pe JOIN cl ON cl.scan_id = pe.scan_id AND cl.schema = cs LEFT JOIN sl ON sl.scan_id = pe.scan_id AND sl.schema = ss AND sl.field = cl.field
     WHERE ce IS NULL AND se IS NULL AND (sl.field IS NULL OR (cl.type <> sl.type AND cl.type <> 'object' AND sl.type <> 'object')
       OR (cl.ref_schema IS NOT NULL AND sl.ref_schema IS NOT NULL AND {_ARR("cl.ref_schema")} <> {_ARR("sl.ref_schema")}))
   UNION SELECT pe.scan_id, cs, ss FROM pe JOIN sl ON sl.scan_id = pe.scan_id AND sl.schema = ss LEFT JOIN cl ON cl.scan_id = pe.scan_id AND cl.schema = cs AND cl.field = sl.field
     WHERE ce IS NULL AND se IS NULL AND cl.field IS NULL),
 df AS (SELECT DISTINCT nd.scan_id, nd.binding_id FROM nd JOIN bad USING (scan_id, cs, ss)),
 vd AS (SELECT r3.scan_id, r3.binding_id, coalesce(early, CASE WHEN df.binding_id IS NULL THEN 'MATCH' ELSE 'DIFFER' END) AS verdict FROM r3 LEFT JOIN df USING (scan_id, binding_id))"""


@query("jn_15", f"{_VERDICT} SELECT scan_id, binding_id, verdict FROM vd")
def jn_15(ctx):
    return sc.structural_verdict(ctx.fx("bindings"), *_schema_tables(ctx))


@query(
    "jn_16",
    f"""{_VERDICT} SELECT b.scan_id, b.binding_id, CASE WHEN kind = 'BODY' THEN 'REQUEST_BODY_SCHEMA_MISMATCH' ELSE 'RESPONSE_SCHEMA_MISMATCH' END AS type,
      CASE WHEN kind = 'BODY' THEN 'Request body shape — code expects ''' || code_ref || ''' but the spec declares ''' || spec_ref || ''''
           ELSE 'Success response schema — code returns ''' || code_ref || ''' but the spec declares ''' || spec_ref || '''' END AS summary,
      CASE WHEN kind = 'BODY' THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
    FROM fx_bindings b JOIN vd ON vd.scan_id = b.scan_id AND vd.binding_id = b.binding_id AND verdict = 'DIFFER'
    WHERE ({_ARR("code_ref")} <> {_ARR("spec_ref")} OR lower(replace(code_ref, '[]', '')) <> lower(replace(spec_ref, '[]', '')))
      AND NOT EXISTS (SELECT 1 FROM dv WHERE dv.scan_id = b.scan_id AND dv.binding_id = b.binding_id)""",
)
def jn_16(ctx):
    b = ctx.fx("bindings")
    tables = _schema_tables(ctx)
    return sc.coarse_diff(b, sc.bound_field_diff(b, *tables), sc.structural_verdict(b, *tables))
