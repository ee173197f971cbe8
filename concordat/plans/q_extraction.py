"""Evidence out of raw sources: issues, wiki pages and a code model, with rows that cannot be read among them."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import extraction
from concordat.plans import duck
from concordat.plans.dialect import pick
from concordat.plans.q_expressions import duck_redact
from concordat.plans.registry import fixture, query

c = F.col
_NL = "chr(10)"


@fixture
def raw_issues(d) -> str:
    adf = '{"type":"doc","content":[{"type":"heading","attrs":{"level":2},"content":[{"type":"text","text":"Acceptance"}]},{"type":"paragraph","content":[{"type":"text","text":"When @k closes it shall be final"}]}]}'
    key = "concat('K-', conv_id, '-', turn)"
    wiki = f"concat('# Acceptance', {_NL}, '- The order ', {key}, ' must close', {_NL}, 'Given a card', {_NL}, 'plain line', {_NL}, '# Rules', {_NL}, '- it closes', {_NL}, 'mail a.b@example.org shall go')"
    return f"""
    SELECT concat('r', conv_id % 5) AS scope_id, conv_id * 1000 + turn AS pos, CASE WHEN conv_id % 29 = 7 AND turn = 0 THEN ' ' ELSE {key} END AS key, text AS summary,
           CASE (conv_id + turn) % 5 WHEN 1 THEN {wiki} WHEN 2 THEN replace('{adf}', '@k', {key}) WHEN 3 THEN '{{"type": "doc", ' WHEN 4 THEN 'nothing to see' END AS description,
           {pick("(conv_id + turn) % 7", ["DONE", "TO_DO", "IN_PROGRESS", "DESCOPED", None, "DONE", "TO_DO"])} AS lifecycle, CASE WHEN turn % 2 = 0 THEN 'P1' END AS priority,
           CASE WHEN conv_id % 3 = 0 THEN {d.array("'Billing'")} END AS components, {d.array("concat('L-', conv_id)")} AS links
    FROM {d.t("conversations")}"""


@fixture
def raw_pages(d) -> str:
    clean = d.rx("text", "[^A-Za-z0-9@.:=]+", " ")
    return f"""
    SELECT concat('r', doc_id % 5) AS scope_id, concat('p', doc_id) AS page_id, concat('Page ', doc_id) AS title,
           CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '<p>nothing here</p>' ELSE concat('<h2>Rules of ', doc_id, '</h2><ul><li>first ', doc_id, '</li><li>', trim({clean}), '</li></ul><p>It must hold</p>') END AS html,
           trim({clean}) AS clean, doc_id
    FROM {d.t("documents")}"""


@fixture
def raw_code(d) -> str:
    return """
    SELECT concat('r', pos % 5) AS scope_id, pos, verb AS method, path, CASE WHEN pos % 4 > 0 THEN concat('Ctl', pos % 3) END AS controller FROM fx_endpoints"""


def _duck_units() -> str:
    """Raw units by construction, then redaction, ids and hints over them."""
    hash8 = duck.hash8
    title = "key || ' — ' || kind"
    parts = [
        ("(conv_id + turn) % 5 = 1", "ACCEPTANCE_CRITERIA", "'The order K-' || conv_id || '-' || turn || ' must close'"), ("(conv_id + turn) % 5 = 1", "ACCEPTANCE_CRITERIA", "'Given a card'"),
        ("(conv_id + turn) % 5 = 1", "REQUIREMENT", "'it closes'"), ("(conv_id + turn) % 5 = 1", "BUSINESS_RULE", "'mail a.b@example.org shall go'"),
        ("(conv_id + turn) % 5 = 2", "ACCEPTANCE_CRITERIA", "'When K-' || conv_id || '-' || turn || ' closes it shall be final'"),
    ]
    issue_parts = " UNION ALL ".join(f"SELECT scope_id, 'JIRA' AS source, key || '#' || {hash8(raw)} AS id, '{kind}' AS type, {title.replace('kind', repr(kind))} AS title, {raw} AS raw, more, NULL AS h FROM live WHERE {when}" for when, kind, raw in parts)
    page = "SELECT scope_id, 'CONFLUENCE' AS source, page_id || '#rules-of-' || doc_id || '-' || {0} AS id, 'DESIGN' AS type, title, {1} AS raw, []::VARCHAR[] AS more, NULL AS h FROM fx_raw_pages WHERE doc_id % 7 > 1 AND {1} <> ''"
    pages = " UNION ALL ".join(page.format(hash8(f"({x})"), x) for x in ("'first ' || doc_id", "clean", "'It must hold'"))
    cls = "coalesce(controller, '?')"
    words = "list_filter(regexp_extract_all(lower(regexp_replace(path, '[{][^/]*', '', 'g')), '[a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains(string_split('" + duck.STOP + "', ' '), t))"
    text = "method || ' ' || path || ' — parameters: id (PATH, required)' || CASE WHEN pos % 2 = 0 THEN ', q (QUERY)' ELSE '' END || '; responses: 200 S' || pos || ', 404' || CASE WHEN pos % 3 = 0 THEN '; secured: role' ELSE '' END"
    code = f"""SELECT scope_id, 'CODE' AS source, 'CODE:' || {cls} || '#' || method || ' ' || path AS id, 'ENDPOINT' AS type, method || ' ' || path AS title, {text} AS raw, []::VARCHAR[] AS more,
        list_append({words}, lower({cls})) AS h FROM fx_raw_code
      UNION ALL SELECT scope_id, 'CODE', 'CODE:Order' || pos || '.schema', 'DTO_CONSTRAINT', 'Schema Order' || pos, 'Schema Order' || pos || ': x (string, required), y (null); allowed values: A, B', [], ['order' || pos] FROM fx_raw_code WHERE pos % 6 = 0
      UNION ALL SELECT scope_id, 'CODE', 'CODE:caveat-' || {hash8("('caveat ' || pos)")}, 'GLOBAL_CAVEAT', 'Analysis caveat', 'caveat ' || pos, [], ['cross-cutting'] FROM fx_raw_code WHERE pos % 13 = 5"""
    redact, last, counts = duck_redact("numbered", "n")
    return f"""WITH issue AS (SELECT i.*, CAST(pos // 1000 AS BIGINT) AS conv_id, CAST(pos % 1000 AS BIGINT) AS turn, list_transform(coalesce(components, []), lambda x: lower(x)) AS more FROM fx_raw_issues i),
    st AS (SELECT *, coalesce(lifecycle <> 'DESCOPED', true) AS alive, CASE WHEN trim(key) = '' THEN 'an issue without a key' WHEN (conv_id + turn) % 5 = 3 THEN 'the description cannot be read' END AS error FROM issue),
    live AS (SELECT * FROM st WHERE alive AND error IS NULL),
    sel AS (SELECT DISTINCT 'r' || (n_nationkey % 5) AS scope_id, unnest(['CODE', 'JIRA', 'CONFLUENCE']) AS source FROM nation UNION ALL SELECT 'r9', 'JIRA'),
    raw0 AS (SELECT scope_id, 'JIRA' AS source, key AS id, 'REQUIREMENT' AS type, key AS title, coalesce(summary, '') AS raw, more, NULL::VARCHAR[] AS h FROM live UNION ALL {issue_parts} UNION ALL {pages} UNION ALL {code}),
    raw AS (SELECT row_number() OVER () AS n, * FROM raw0 SEMI JOIN (SELECT * FROM sel WHERE NOT (scope_id = 'r4' AND source = 'CODE')) s USING (scope_id, source)),
    numbered AS (SELECT n, raw AS text FROM raw), {redact},
    u AS (SELECT raw.* EXCLUDE (raw), r.text, {' + '.join('r.' + x for x in counts)} AS hidden, list_sort(list_distinct(list_concat(coalesce(raw.h, {duck.hint_set('r.text')}), raw.more))) AS hints FROM raw JOIN {last} r USING (n)),
    fl AS (SELECT scope_id, 'JIRA' AS source, key AS item, error FROM st WHERE alive AND error IS NOT NULL UNION ALL SELECT scope_id, 'CONFLUENCE', page_id, 'the page cannot be read' FROM fx_raw_pages WHERE html IS NULL),
    ct AS (SELECT scope_id, 'JIRA' AS source, count(*) AS requested, count(*) FILTER (WHERE alive AND error IS NULL) AS fetched FROM st GROUP BY 1 UNION ALL
      SELECT scope_id, 'CONFLUENCE', count(*), count(*) FILTER (WHERE doc_id % 7 > 1) FROM fx_raw_pages GROUP BY 1 UNION ALL SELECT DISTINCT scope_id, 'CODE', 1, 1 FROM fx_raw_code)
    SELECT 'unit' AS kind, scope_id, source, id, type, title, text, array_to_string(hints, ',') AS hints, NULL::BIGINT AS requested, NULL::BIGINT AS fetched, NULL::BIGINT AS failed, NULL::BIGINT AS redactions FROM u
    UNION ALL SELECT 'failure', scope_id, source, item, NULL, NULL, error, NULL, NULL, NULL, NULL, NULL FROM fl
    UNION ALL SELECT 'provenance', s.scope_id, s.source, NULL, NULL, NULL, NULL, NULL, greatest(coalesce(requested, 0), 1), coalesce(fetched, 0),
      (SELECT count(*) FROM fl WHERE fl.scope_id = s.scope_id AND fl.source = s.source), (SELECT coalesce(sum(hidden), 0) FROM u WHERE u.scope_id = s.scope_id AND u.source = s.source)::BIGINT
      FROM (SELECT * FROM sel WHERE NOT (scope_id = 'r4' AND source = 'CODE')) s LEFT JOIN ct ON ct.scope_id = s.scope_id AND ct.source = s.source"""


@query("src_7_extraction", _duck_units())
def src_7_extraction(ctx):
    e = ctx.fx("raw_code")
    one = lambda pos, **cols: e.select("scope_id", c("pos").alias("ep"), F.lit(pos).alias("pos"), *[v.alias(k) for k, v in cols.items()])
    params = one(0, name=F.lit("id"), location=F.lit("PATH"), required=F.lit(True))
    params = params.unionByName(one(1, name=F.lit("q"), location=F.lit("QUERY"), required=F.lit(False)).filter("ep % 2 = 0"))
    answers = one(1, status=F.lit(404), schema_ref=F.lit(None).cast("string")).unionByName(one(0, status=F.lit(200), schema_ref=F.concat(F.lit("S"), "ep")))
    some = e.filter("pos % 6 = 0").select("scope_id", F.concat(F.lit("Order"), "pos").alias("schema"))
    field = lambda pos, name, kind, needed: some.select("scope_id", "schema", F.lit(pos).alias("pos"), F.lit(name).alias("field"), F.lit(kind).cast("string").alias("type"), F.lit(needed).alias("required"))
    model = {
        "endpoints": e.withColumn("security", F.when(c("pos") % 3 == 0, F.array(F.lit("role")))), "params": params, "responses": answers,
        "schemas": some.withColumn("enum_values", F.array(F.lit("A"), F.lit("B"))), "fields": field(1, "y", None, False).unionByName(field(0, "x", "string", True)),
        "blind_spots": e.filter("pos % 13 = 5").select("scope_id", F.concat(F.lit("caveat "), "pos").alias("text")),
    }
    sources = F.explode(F.array(F.lit("CODE"), F.lit("JIRA"), F.lit("CONFLUENCE"))).alias("source")
    every = ctx.table("nation").select(F.concat(F.lit("r"), (c("n_nationkey") % 5).cast("string")).alias("scope_id"), sources)
    more = ctx.table("region").filter("r_regionkey = 0").select(F.lit("r9").alias("scope_id"), F.lit("JIRA").alias("source"))
    selected = every.filter("NOT (scope_id = 'r4' AND source = 'CODE')").unionByName(more)
    out = extraction.extract(selected, ctx.fx("raw_issues"), ctx.fx("raw_pages").select("scope_id", "page_id", "title", "html"), model)
    names = ["id", "type", "title", "text", "hints"]
    numbers = ["requested", "fetched", "failed", "redactions"]

    def row(df, kind, **cols):
        empty = [cols.get(x, F.lit(None).cast("string")).alias(x) for x in names] + [cols.get(x, F.lit(None).cast("bigint")).alias(x) for x in numbers]
        return df.select(F.lit(kind).alias("kind"), "scope_id", "source", *empty)

    units = row(out["units"], "unit", id=c("id"), type=c("type"), title=c("title"), text=c("text"), hints=F.array_join(F.array_sort("hints"), ","))
    units = units.unionByName(row(out["failures"], "failure", id=c("item"), text=c("error")))
    return units.unionByName(row(out["provenance"], "provenance", **{x: c(x) for x in numbers}))
