"""Source and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from concordat.operators import coverage as cv
from concordat.operators import portfolio as pf

from concordat.plans.registry import fixture, query
from concordat.schemas import SOURCE_TABLES
from concordat.session import checkpoint_dir
from concordat.sources import sinks, specdocs, tracker, wiki


c = F.col


@query("src_1", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in SOURCE_TABLES))
def src_1(ctx):
    out = None
    for t in SOURCE_TABLES:
        row = ctx.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


_RES = "CASE turn % 4 WHEN 0 THEN 'Won''t Do' WHEN 1 THEN 'Fixed' END"


@query(
    "src_2",
    """WITH p AS (SELECT *, conv_id * 1000 + turn AS page FROM conversations), r AS (SELECT 0 AS k UNION ALL SELECT 1)
    SELECT 'C-' || conv_id || '-' || turn || CASE k WHEN 0 THEN '' ELSE '-b' END AS key, page, CAST(k AS BIGINT) AS pos, text AS summary, CASE WHEN role = 'user' THEN 'done' ELSE 'new' END AS status_category,
      CASE WHEN turn % 4 = 0 THEN 'DESCOPED' WHEN role = 'user' THEN 'DONE' ELSE 'TO_DO' END AS lifecycle, CASE WHEN turn % 3 > 0 THEN 'P' || turn END AS priority, role || ',x' AS components,
      CASE WHEN turn % 2 = 0 THEN 'L-' || conv_id ELSE '' END AS links FROM p, r""",
)
def src_2(ctx):
    t = c("turn")
    field = F.struct(
        c("text").alias("summary"),
        F.struct(F.lit("s").alias("name"), F.struct(F.when(c("role") == "user", "done").otherwise("new").alias("key")).alias("statusCategory")).alias("status"),
        F.when(t % 4 < 2, F.struct(F.when(t % 4 == 0, "Won't Do").otherwise("Fixed").alias("name"))).alias("resolution"),
        F.struct(F.when(t % 3 > 0, F.concat(F.lit(" P"), t)).otherwise(" ").alias("name")).alias("priority"),
        F.array(F.struct(c("role").alias("name")), F.struct(F.lit(" ").alias("name")), F.struct(F.lit("x").alias("name"))).alias("components"),
        F.array(F.struct(F.struct(F.when(t % 2 == 0, F.concat(F.lit("L-"), "conv_id")).otherwise("").alias("key")).alias("outwardIssue"))).alias("issuelinks"),
    )
    key = F.concat(F.lit("C-"), "conv_id", F.lit("-"), t)
    both = F.array(*[F.struct(k.alias("key"), field.alias("fields")) for k in (key, F.concat(key, F.lit("-b")))])
    pages = ctx.table("conversations").select(
        (c("conv_id") * 1000 + t).alias("page"), F.to_json(F.struct(F.lit(2).alias("total"), both.alias("issues"))).alias("json")
    )
    out = tracker.issues(pages)
    return out.select(
        "key", "page", c("pos").cast("bigint").alias("pos"), "summary", "status_category", "lifecycle", "priority",
        F.array_join("components", ",").alias("components"), F.array_join("links", ",").alias("links"),
    )


@fixture
def spec_docs(d) -> str:
    q = '"'

    def obj(*pairs: str) -> str:
        return "concat('{', " + ", ',', ".join(pairs) + ", '}')"

    def kv(key: str, value: str) -> str:
        return f"concat('{q}{key}{q}:', {value})"

    s = lambda v: f"concat('{q}', {v}, '{q}')"
    ref = lambda v: obj(kv("$ref", s(f"concat('#/components/schemas/', {v})")))
    media = lambda schema, extra=None: obj(kv("application/json", obj(kv("schema", schema), *([extra] if extra else []))))
    limit = obj(kv("name", "'\"limit\"'"), kv("in", "'\"query\"'"), kv("required", "CASE WHEN pos % 2 = 0 THEN 'true' ELSE 'false' END"),
                kv("schema", obj(kv("type", "'\"integer\"'"), kv("minimum", "CAST(pos % 5 AS STRING)"))))
    pid = obj(kv("name", "'\"id\"'"), kv("in", "'\"path\"'"), kv("schema", obj(kv("type", "'\"string\"'"))))
    op = obj(
        kv("operationId", s("concat('op', pos)")), kv("parameters", f"concat('[', {limit}, ',', {pid}, ']')"),
        kv("requestBody", obj(kv("required", "'true'"), kv("content", media(ref("concat('S', pos % 4)"))))),
        kv("responses", obj(
            kv("200", obj(kv("content", media(obj(kv("type", "'\"array\"'"), kv("items", ref("concat('S', (pos + 1) % 4)"))), kv("example", "'{}'"))))),
            kv("404", "'{}'"), kv("default", "'{}'"))),
    )
    fields = obj(kv("id", obj(kv("type", "'\"string\"'"), kv("maxLength", "CAST(10 + pos % 3 AS STRING)"))), kv("next", ref("concat('S', (pos + 1) % 4)")))
    schema = obj(kv("type", "'\"object\"'"), kv("required", "'[\"id\"]'"), kv("properties", fields), kv("allOf", f"concat('[', {ref(repr('Base'))}, ']')"))
    doc = obj(
        kv("openapi", "'\"3.0.1\"'"), kv("info", obj(kv("title", s("concat('T', pos)")), kv("version", "'\"1\"'"))),
        kv("paths", obj(f"concat('{q}', path, '{q}:', {obj(f'concat({chr(39)}{q}{chr(39)}, lower(verb), {chr(39)}{q}:{chr(39)}, {op})', kv('summary', s(repr('x'))))})")),
        kv("components", obj(kv("schemas", obj(f"concat('{q}S', pos % 4, '{q}:', {schema})", kv("Base", obj(kv("type", "'\"string\"'"))))))),
    )
    return f"SELECT pos AS spec_id, scan_id, CASE WHEN pos % 41 = 40 THEN 'not json' ELSE {doc} END AS json FROM fx_endpoints"


@query(
    "src_3",
    """WITH e AS (SELECT * FROM fx_endpoints WHERE pos % 41 <> 40)
    SELECT 'endpoint' AS kind, pos AS spec_id, verb AS a, path AS b, 'op' || pos AS k, 'application/json' AS v, 'S' || (pos % 4) AS r, true AS flag FROM e
    UNION ALL SELECT 'param', pos, 'limit', 'QUERY', 'integer', CAST(CAST(pos % 5 AS DOUBLE) AS VARCHAR), NULL, pos % 2 = 0 FROM e UNION ALL SELECT 'param', pos, 'id', 'PATH', 'string', NULL, NULL, true FROM e
    UNION ALL SELECT 'response', pos, '200', '200', NULL, 'application/json', 'S' || ((pos + 1) % 4) || '[]', true FROM e UNION ALL SELECT 'response', pos, '404', '404', NULL, NULL, NULL, false FROM e
    UNION ALL SELECT 'response', pos, 'default', NULL, NULL, NULL, NULL, false FROM e
    UNION ALL SELECT 'schema', pos, 'S' || (pos % 4), 'object', NULL, 'Base', NULL, NULL FROM e UNION ALL SELECT 'schema', pos, 'Base', 'string', NULL, '', NULL, NULL FROM e
    UNION ALL SELECT 'field', pos, 'S' || (pos % 4), 'id', 'string', CAST(10 + pos % 3 AS VARCHAR), NULL, true FROM e UNION ALL SELECT 'field', pos, 'S' || (pos % 4), 'next', NULL, NULL, 'S' || ((pos + 1) % 4), false FROM e""",
)
def src_3(ctx):
    t = specdocs.flatten_specs(ctx.fx("spec_docs"))
    none = F.lit(None).cast("string")

    def row(df, kind, a, b, k, v, r, flag):
        cols = {"a": a, "b": b, "k": k, "v": v, "r": r}
        return df.select(F.lit(kind).alias("kind"), "spec_id", *[x.alias(n) for n, x in cols.items()], flag.alias("flag"))

    join = lambda x: F.array_join(x, ",")
    out = row(t["endpoints"], "endpoint", c("method"), c("path"), c("operation_id"), join("consumes"), c("body_ref"), c("body_required"))
    out = out.unionByName(row(t["params"], "param", c("name"), c("location"), c("type"), c("constraints.minimum").cast("string"), none, c("required")))
    out = out.unionByName(row(t["responses"], "response", c("code"), c("status").cast("string"), none, join("media_types"), c("schema_ref"), c("has_example")))
    out = out.unionByName(row(t["schemas"], "schema", c("schema"), c("type"), none, join("all_of"), none, F.lit(None).cast("boolean")))
    return out.unionByName(row(t["fields"], "field", c("schema"), c("field"), c("type"), c("constraints.maxLength").cast("string"), c("ref_schema"), c("required")))


@query(
    "agg_22",
    """SELECT scan_id, bool_or(pos % 41 <> 40) AS examples, bool_or(pos % 41 <> 40) AS properties, bool_or(pos % 41 <> 40) AS constrained, bool_or(pos % 41 <> 40) AS errors FROM fx_endpoints GROUP BY scan_id""",
)
def agg_22(ctx):
    docs = ctx.fx("spec_docs")
    return specdocs.presence(specdocs.flatten_specs(docs), docs.select("spec_id", "scan_id"))


@fixture
def allof_edges(d) -> str:
    return f"""
    SELECT 'w' AS scan_id, concat('N', n_nationkey) AS schema, 0 AS pos, concat('R', n_regionkey) AS base FROM {d.t("nation")}
    UNION ALL SELECT 'w', concat('N', n_nationkey), 1, concat('N', n_nationkey + 7) FROM {d.t("nation")}
    UNION ALL SELECT 'w', concat('S', s_suppkey), CAST(s_suppkey % 2 AS INTEGER), concat('N', s_nationkey) FROM {d.t("supplier")}
    UNION ALL SELECT 'w', concat('S', s_suppkey), CAST(1 - s_suppkey % 2 AS INTEGER), concat('R', s_suppkey % 7) FROM {d.t("supplier")}
    UNION ALL SELECT 'w', concat('R', n_regionkey), 0, concat('N', max(n_nationkey)) FROM {d.t("nation")} GROUP BY n_regionkey"""


@fixture
def allof_fields(d) -> str:
    return f"""
    SELECT 'w' AS scan_id, concat('R', r_regionkey) AS schema, 0 AS pos, concat('f', r_regionkey % 3) AS field, r_name AS type FROM {d.t("region")}
    UNION ALL SELECT 'w', concat('R', r_regionkey), 1, 'id', 'r' FROM {d.t("region")}
    UNION ALL SELECT 'w', concat('N', n_nationkey), 0, concat('f', n_nationkey % 4), n_name FROM {d.t("nation")}
    UNION ALL SELECT 'w', concat('S', s_suppkey), 0, CASE WHEN s_suppkey % 3 = 0 THEN 'id' ELSE concat('g', s_suppkey % 4) END, s_name FROM {d.t("supplier")}"""


@query(
    "src_4",
    """WITH RECURSIVE k AS (SELECT DISTINCT schema FROM fx_allof_fields), e AS (SELECT schema, pos, base FROM fx_allof_edges WHERE base IN (SELECT schema FROM k)),
    t AS (SELECT schema, schema AS node, []::INTEGER[] AS path, [schema] AS seen FROM k UNION ALL
      SELECT t.schema, e.base, list_append(t.path, e.pos), list_append(t.seen, e.base) FROM t JOIN e ON e.schema = t.node WHERE NOT list_contains(t.seen, e.base)),
    f AS (SELECT t.schema, x.field, arg_min(struct_pack(d := t.node, ty := x.type), (t.path, x.pos)) AS v FROM t JOIN fx_allof_fields x ON x.schema = t.node GROUP BY ALL)
    SELECT 'field' AS kind, schema, field, v.d AS declared_in, v.ty AS type FROM f UNION ALL SELECT 'unresolved', schema, base, NULL, NULL FROM fx_allof_edges WHERE base NOT IN (SELECT schema FROM k)""",
)
def src_4(ctx):
    fields = ctx.fx("allof_fields")
    eff, missing = specdocs.resolve_allof(fields.select("scan_id", "schema"), ctx.fx("allof_edges"), fields)
    none = F.lit(None).cast("string")
    a = eff.select(F.lit("field").alias("kind"), "schema", "field", "declared_in", "type")
    b = missing.select(F.lit("unresolved").alias("kind"), "schema", c("base").alias("field"), none.alias("declared_in"), none.alias("type"))
    return a.unionByName(b)


@fixture
def page_edges(d) -> str:
    return f"""
    SELECT concat('R', n_regionkey) AS parent, concat('N', n_nationkey) AS child, n_nationkey AS pos FROM {d.t("nation")}
    UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), 0 FROM {d.t("nation")}
    UNION ALL SELECT concat('N', c_nationkey), concat('C', c_custkey), CAST(1 + c_custkey AS INTEGER) FROM {d.t("customer")}
    UNION ALL SELECT concat('C', o_custkey), concat('O', o_orderkey), CAST(o_orderkey AS INTEGER) FROM {d.t("orders")}"""


@query(
    "src_5",
    """WITH RECURSIVE t AS (SELECT 'R' || r_regionkey AS root, 'R' || r_regionkey AS page, 0 AS depth, []::INTEGER[] AS path FROM region
      UNION ALL SELECT t.root, e.child, depth + 1, list_append(path, e.pos) FROM t JOIN fx_page_edges e ON e.parent = t.page AND e.child <> t.root WHERE depth < 5),
    o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, path) AS ord FROM t) SELECT root, page, depth, CAST(ord AS INTEGER) AS ord FROM o""",
)
def src_5(ctx):
    roots = ctx.table("region").select(F.concat(F.lit("R"), "r_regionkey").alias("root"))
    return wiki.page_tree(ctx.fx("page_edges"), roots).select("root", "page", "depth", "ord")


@fixture
def test_files(d) -> str:
    nl = "chr(10)"
    return f"""
    SELECT concat('t/', page_id, '.java') AS path, replace(replace(CASE page_id % 3 WHEN 0 THEN replace(html, '</li>', concat('</li>', {nl}, 'x.Get(', {nl}))
      WHEN 1 THEN replace(html, '<li>', concat('delete', {nl}, {nl}, '<li>')) ELSE replace(html, '<li>', concat({nl}, '<li>')) END, 'href="/a', 'href="/api/v1/../'), '</ul>', '"/x.json" "/12/3" "/ok/{{id}}"') AS text
    FROM {d.t("pages")}"""


@query(
    "src_6",
    r"""WITH l AS (SELECT path AS file, unnest(s) AS x, generate_subscripts(s, 1) - 1 AS line FROM (SELECT path, string_split(text, chr(10)) AS s FROM fx_test_files)),
    v AS (SELECT *, nullif(upper(regexp_extract(x, '(?i)\b(get|post|put|patch|delete)\b', 1)), '') AS v FROM l),
    w AS (SELECT file, line, x, coalesce(v, lag(v, 1) OVER o, lag(v, 2) OVER o) AS method FROM v WINDOW o AS (PARTITION BY file ORDER BY line)),
    p AS (SELECT file, line, method, unnest(regexp_extract_all(x, '["''](/[A-Za-z0-9_./{}\-]*)["'']', 1)) AS path FROM w)
    SELECT file, CAST(line AS INTEGER) AS line, method, path FROM p WHERE length(path) >= 2 AND NOT contains(path, '..') AND NOT regexp_matches(path, '\.[A-Za-z0-9]{1,6}$') AND regexp_matches(path, '[A-Za-z]')""",
)
def src_6(ctx):
    return wiki.test_inventory(ctx.fx("test_files"))


@fixture
def wiki_pages(d) -> str:
    return f"""
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN concat(html, '<pre>openapi: 3.0', chr(10), 'paths: ', page_id, '</pre><code>swagger paths: x</code>')
      WHEN 1 THEN concat('<code>one</code>', html, '<ac:plain-text-body><![CDATA[ {{"paths": 1}} ]]></ac:plain-text-body><pre class="x">two longer</pre>')
      WHEN 2 THEN concat(html, '<pre>aa</pre><pre>bb</pre><code> </code>') ELSE html END AS html FROM {d.t("pages")}"""


@query(
    "src_8",
    r"""SELECT page_id, CAST(CASE page_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS score, CASE page_id % 4 WHEN 0 THEN 'openapi: 3.0' || chr(10) || 'paths: ' || page_id WHEN 1 THEN '{"paths": 1}' ELSE 'aa' END || chr(10) AS block
       FROM pages WHERE page_id % 4 < 3""",
)
def src_8(ctx):
    return wiki.best_spec_block(ctx.fx("wiki_pages")).select("page_id", "score", "block")


@fixture
def markdown_docs(d) -> str:
    nl = "chr(10)"
    return f"""
    SELECT concat('d', doc_id) AS id, concat(CASE WHEN doc_id % 3 = 0 THEN concat('intro must hold', {nl}) ELSE '' END, '# ', CASE WHEN doc_id % 2 = 0 THEN 'Acceptance Criteria: and more words here' ELSE '!!' END, {nl}, '- first item', {nl},
      '1. the second shall be', {nl}, '| a | b |', {nl}, '|---|:-:|', {nl}, 'Given x', {nl}, {nl}, '## Rules ', doc_id % 5, {nl}, '  - it should work', {nl}, text, {nl}, 'Thenable word', {nl}, 'and MUST stop') AS markdown
    FROM {d.t("documents")}"""


@query(
    "src_9",
    r"""WITH l AS (SELECT id AS source, trim(unnest(s)) AS line, generate_subscripts(s, 1) AS pos FROM (SELECT id, string_split(markdown, chr(10)) AS s FROM fx_markdown_docs)),
    m AS (SELECT *, regexp_matches(' ' || lower(line) || ' ', ' (must|shall|should) ') AS modal, regexp_replace(line, '^#+\s*', '') AS hd FROM l WHERE line <> ''),
    s AS (SELECT *, CASE WHEN line LIKE '#%' THEN 'H' WHEN regexp_full_match(line, '\|[\s|:\-]+\|?') THEN NULL WHEN line LIKE '|%' THEN 'T' WHEN line LIKE '- %' OR regexp_matches(line, '^\d+\.\s') THEN 'B'
      WHEN regexp_matches(line, '(?i)^(given|when|then|and|but)\b') THEN 'G' WHEN modal THEN 'M' END AS sh FROM m),
    h AS (SELECT *, CASE WHEN sh = 'H' THEN coalesce(nullif(regexp_replace(regexp_replace(lower(hd), '[^a-z0-9]+', '-', 'g'), '(^-|-$)', '', 'g'), ''), 'sec') END AS slug, CASE WHEN sh = 'H' THEN contains(lower(hd), 'acceptance') END AS ac FROM s WHERE sh IS NOT NULL),
    w AS (SELECT *, coalesce(last_value(slug IGNORE NULLS) OVER o, 'general') AS section, coalesce(last_value(ac IGNORE NULLS) OVER o, false) AS ina, count(*) FILTER (WHERE sh <> 'H') OVER o AS n FROM h WINDOW o AS (PARTITION BY source ORDER BY pos)),
    t AS (SELECT *, CASE sh WHEN 'T' THEN regexp_replace(trim(regexp_replace(regexp_replace(line, '^\|', ''), '\|$', '')), '\s*\|\s*', ' — ', 'g') WHEN 'B' THEN trim(regexp_replace(line, '^(-\s|\d+\.\s)', '')) ELSE line END AS text FROM w WHERE sh <> 'H')
    SELECT source || '#' || section || '-' || n AS id, CASE WHEN sh = 'G' THEN 'ACCEPTANCE_CRITERIA' WHEN sh <> 'B' THEN 'BUSINESS_RULE' WHEN ina THEN 'ACCEPTANCE_CRITERIA'
      WHEN regexp_matches(' ' || lower(text) || ' ', ' (must|shall|should) ') THEN 'BUSINESS_RULE' ELSE 'REQUIREMENT' END AS kind, text FROM t""",
)
def src_9(ctx):
    return wiki.test_basis(ctx.fx("markdown_docs")).select("id", "kind", "text")


@fixture
def nested_pages(d) -> str:
    """Pages of nested markup around the words of every document and page."""
    words = lambda x: f"trim({d.rx(x, '[^A-Za-z0-9]+', ' ')})"
    page = lambda ident, x: f"""concat('<h2>Page <b>', {ident}, '</b></h2><p>', {x}, ' &amp; <em>more</em> <a href=\"/u\">here</a></p><ul><li>one', '<ul><li>two ', {ident}, '</li></ul></li><li><p>three</p></li></ul><ol><li>first</li><li>second</li></ol>',
      '<table><tr><th>H</th><th>I</th></tr><tr><td>x<table><tr><td>in</td></tr></table></td><td><code>', {ident}, '</code></td></tr></table><blockquote>said ', {ident}, '</blockquote>loose <div>end</div>')"""  # noqa: E731
    return f"""
    SELECT page_id, {words("html")} AS words, {page("page_id", words("html"))} AS html FROM {d.t("pages")}
    UNION ALL SELECT -1 - doc_id, {words("text")}, {page("-1 - doc_id", words("text"))} FROM {d.t("documents")}"""


@query(
    "src_10",
    """SELECT page_id, CAST(e.pos AS INTEGER) AS pos, e.kind, replace(replace(e.text, '@w', CASE WHEN e.pos = 1 THEN words ELSE '' END), '@p', CAST(page_id AS VARCHAR)) AS text FROM fx_nested_pages JOIN (VALUES
      (0, 'heading', '## Page **@p**'), (1, 'text', '@w & *more* [here](/u)'), (2, 'item', '- onetwo @p'), (3, 'item', '- three'), (4, 'item', '1. first'), (5, 'item', '2. second'),
      (6, 'row', '| H | I |'), (7, 'row', '| --- | --- |'), (8, 'row', '| xin | `@p` |'), (9, 'row', '| in |'), (10, 'quote', '> said @p'), (11, 'text', 'loose end')) e(pos, kind, text) ON true""".replace(
        "'@w & *more*", "trim('@w & *more*"
    ).replace("[here](/u)')", "[here](/u)'))"),
)
def src_10(ctx):
    return wiki.pages_to_lines(ctx.fx("nested_pages").select("page_id", "html"))


@query(
    "src_11",
    """SELECT 'C-' || conv_id || '-' || turn AS key, 'heading' AS kind, '## ' || role AS text FROM conversations
    UNION ALL SELECT 'C-' || conv_id || '-' || turn, 'paragraph', '**' || text || '**@me' FROM conversations UNION ALL SELECT 'C-' || conv_id || '-' || turn, 'listItem', '- item ' || turn || chr(10) || '- sub' FROM conversations
    UNION ALL SELECT 'C-' || conv_id || '-' || turn, 'tableRow', unnest(['| a | b |', '| --- | --- |', '| x y | - ' || turn || ' |']) FROM conversations""",
)
def src_11(ctx):
    def node(kind, *content, attrs=""):
        return F.concat(F.lit(f'{{"type":"{kind}",{attrs}"content":['), F.concat_ws(",", *content), F.lit("]}"))

    def text(t, **marks):
        return F.to_json(F.struct(F.lit("text").alias("type"), t.alias("text"), *[v.alias(k) for k, v in marks.items()]))

    def para(*inline):
        return node("paragraph", *inline)

    turn = c("turn").cast("string")
    bold = text(c("text"), marks=F.array(F.struct(F.lit("strong").alias("type"))))
    mention = F.lit('{"type":"mention","attrs":{"text":"me"}}')
    listed = lambda *inner: node("bulletList", node("listItem", *inner))
    row = lambda *cells: node("tableRow", *[node("tableCell", x) for x in cells])
    table = node("table", row(para(text(F.lit("a"))), para(text(F.lit("b")))), row(para(text(F.lit("x y"))), listed(para(text(turn)))))
    item = listed(para(text(F.concat(F.lit("item "), turn))), listed(para(text(F.lit("sub")))))
    adf = node("doc", node("heading", text(c("role")), attrs='"attrs":{"level":2},'), para(bold, mention), item, table)
    docs = ctx.table("conversations").select(F.concat(F.lit("C-"), "conv_id", F.lit("-"), "turn").alias("key"), adf.alias("adf"))
    return tracker.adf_to_lines(docs).select("key", "kind", "text")


# --- sinks: written to the shared checkpoint folder and read back ------------------------------------------------


def _out(ctx, name):
    return f"{checkpoint_dir(ctx.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("snk_1", "SELECT service, CAST(count(*) AS VARCHAR) AS scans FROM fx_scans WHERE trim(service) <> '' GROUP BY service")
def snk_1(ctx):
    path = _out(ctx, "scorecard")
    sinks.write_scorecard(pf.catalog({"scans": ctx.fx("scans")}), path)
    return ctx.spark.read.schema("service string, scans string").option("header", True).option("escape", '"').csv(path)


@query(
    "snk_2",
    """WITH d AS (SELECT plan_id, 'TECHNIQUE' AS dimension, technique AS v FROM fx_required_cases UNION ALL SELECT plan_id, 'LEVEL', level FROM fx_required_cases UNION ALL SELECT plan_id, 'TYPE', type FROM fx_required_cases
      UNION ALL SELECT plan_id, 'RISK_ID', risk_id FROM fx_required_cases UNION ALL SELECT plan_id, 'REQUIREMENT_KEY', requirement_key FROM fx_required_cases) SELECT plan_id, dimension, v AS value FROM d WHERE trim(v) <> ''""",
)
def snk_2(ctx):
    path = _out(ctx, "rtm")
    sinks.write_rtm(cv.dimensions(ctx.fx("required_cases")).select("plan_id", "dimension", "value"), path)
    return ctx.spark.read.schema("dimension string, value string, plan_id string").parquet(path)


@query("snk_3", "SELECT row_id, type FROM fx_findings")
def snk_3(ctx):
    path = _out(ctx, "findings")
    rows = ctx.fx("findings").select("row_id", "type")
    sinks.append_findings(rows, path, 1)
    sinks.append_findings(rows, path, 1)
    return load_batches(ctx.spark, path)


def load_batches(spark, path):
    return spark.read.schema("row_id string, type string, batch int").parquet(path).drop("batch")



