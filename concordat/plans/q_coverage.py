"""Coverage, traceability and plan queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import coverage as cv
from concordat.plans import duck
from concordat.plans.dialect import pick
from concordat.plans.registry import fixture, query

c = F.col


@fixture
def required_cases(d) -> str:
    return f"""
    SELECT p_brand AS plan_id, p_partkey AS pos,
           CASE p_partkey % 7 WHEN 0 THEN concat(upper(p_name), ' -- ', p_type, '!') WHEN 1 THEN concat('check ', p_name, ' of ', p_type) WHEN 2 THEN ' ?? '
                WHEN 3 THEN substr(p_name, 2, 5) WHEN 4 THEN NULL WHEN 5 THEN concat('zz ', p_name, p_partkey % 5) ELSE substr(p_name, 1, 2) END AS title,
           CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '' ELSE concat('req-', p_partkey % 60) END AS requirement_key,
           CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN ' ' ELSE concat('r', p_size) END AS risk_id,
           {pick("p_partkey % 4", ["boundary", "decision", "", None])} AS technique, {pick("p_partkey % 3", ["system", "component", None])} AS level, p_type AS type
    FROM {d.t("part")}"""


@fixture
def existing_tests(d) -> str:
    return f"""
    SELECT p_brand AS plan_id, p_partkey AS pos, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('T-', p_partkey) END AS key,
           CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ', p_type) WHEN 2 THEN '' WHEN 3 THEN concat('Verify ', upper(p_name), ' in depth')
                WHEN 4 THEN 'ox' ELSE concat(p_name, ' / ', p_size) END AS title FROM {d.t("part")} WHERE p_partkey % 3 <> 0"""


_MATCH = f"""r AS (SELECT *, {duck.title_fp("title")} AS fp FROM fx_required_cases), t AS (SELECT *, {duck.title_fp("title")} AS tfp FROM fx_existing_tests),
 h AS (SELECT plan_id, tfp, key, true AS hit FROM (SELECT plan_id, tfp, arg_min(coalesce(key, '~'), pos) AS key FROM t WHERE tfp <> '' GROUP BY ALL) WHERE key <> '~'),
 rf AS (SELECT DISTINCT plan_id, fp FROM r WHERE fp <> ''), tf AS (SELECT plan_id, tfp, min(pos) AS pos, arg_min(coalesce(key, '~'), pos) AS key FROM t WHERE tfp <> '' GROUP BY ALL),
 md AS (SELECT rf.plan_id, rf.fp, arg_min(tf.key, tf.pos) AS key FROM rf JOIN tf ON tf.plan_id = rf.plan_id AND (contains(tf.tfp, rf.fp) OR contains(rf.fp, tf.tfp))
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.plan_id = rf.plan_id AND h.tfp = rf.fp) GROUP BY ALL),
 m AS (SELECT r.*, CASE WHEN h.hit THEN h.key ELSE nullif(md.key, '~') END AS matched_key,
   CASE WHEN CASE WHEN h.hit THEN h.key ELSE nullif(md.key, '~') END IS NOT NULL THEN 'MATCHED' ELSE 'GAP' END AS status,
   CASE WHEN h.hit THEN 'HIGH' WHEN md.key <> '~' THEN 'MEDIUM' ELSE 'HIGH' END AS confidence
   FROM r LEFT JOIN h ON h.plan_id = r.plan_id AND h.tfp = r.fp LEFT JOIN md ON md.plan_id = r.plan_id AND md.fp = r.fp)"""


def _matches(ctx):
    return cv.match_coverage(ctx.fx("required_cases"), ctx.fx("existing_tests"))


@query("jn_27", f"WITH {_MATCH} SELECT plan_id, pos, status, matched_key, confidence FROM m")
def jn_27(ctx):
    return _matches(ctx).select("plan_id", "pos", "status", "matched_key", "confidence")


_ORPH = "o AS (SELECT plan_id, key, title FROM fx_existing_tests t WHERE key IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m WHERE m.plan_id = t.plan_id AND m.matched_key = t.key))"


@query("jn_28", f"WITH {_MATCH}, {_ORPH} SELECT plan_id, key, title FROM o")
def jn_28(ctx):
    return cv.orphans(ctx.fx("existing_tests"), _matches(ctx)).select("plan_id", "key", "title")


_ACT = """g AS (SELECT m.plan_id, m.pos, m.fp, d.dup, row_number() OVER (PARTITION BY m.plan_id, m.fp ORDER BY m.pos) AS rn FROM m
   LEFT JOIN (SELECT plan_id, tfp, arg_min(key, pos) AS dup FROM t WHERE key IS NOT NULL GROUP BY ALL) d ON d.plan_id = m.plan_id AND d.tfp = m.fp WHERE m.status = 'GAP'),
 a AS (SELECT plan_id, pos, dup, CASE WHEN dup IS NULL AND rn = 1 THEN 'CREATED' ELSE 'SKIPPED_DUP' END AS action FROM g)"""


@query("jn_29", f"WITH {_MATCH}, {_ACT} SELECT plan_id, pos, dup, action FROM a")
def jn_29(ctx):
    return cv.gap_actions(_matches(ctx), ctx.fx("existing_tests")).select("plan_id", "pos", "dup", "action")


@fixture
def plan_issues(d) -> str:
    return f"""
    SELECT CASE WHEN s_suppkey % 30 > 24 THEN 'none' ELSE concat('Brand#', s_suppkey % 30) END AS plan_id, concat('REQ-', s_suppkey % 40) AS key FROM {d.t("supplier")}"""


@fixture
def plan_risks(d) -> str:
    return f"""
    SELECT p_brand AS plan_id, concat('R', p_size) AS risk_id, {pick("min(p_partkey) % 5", ["high", "LOW", "vh", "Very High", "medium"])} AS level
    FROM {d.t("part")} WHERE p_size % 4 > 0 GROUP BY p_brand, p_size"""


@query(
    "jn_30",
    """WITH k AS (SELECT DISTINCT plan_id, upper(key) AS k FROM fx_plan_issues), r AS (SELECT DISTINCT plan_id, upper(risk_id) AS r FROM fx_plan_risks),
    x AS (SELECT q.*, requirement_key IS NOT NULL AND plan_id IN (SELECT plan_id FROM k) AND NOT EXISTS (SELECT 1 FROM k WHERE k.plan_id = q.plan_id AND k.k = upper(requirement_key)) AS dropped_key,
          coalesce(trim(risk_id) <> '', false) AND NOT EXISTS (SELECT 1 FROM r WHERE r.plan_id = q.plan_id AND r.r = upper(risk_id)) AS dropped_risk FROM fx_required_cases q)
    SELECT plan_id, pos, dropped_key, dropped_risk, CASE WHEN NOT dropped_key THEN requirement_key END AS requirement_key, CASE WHEN NOT dropped_risk THEN risk_id END AS risk_id FROM x""",
)
def jn_30(ctx):
    out = cv.enforce_traceability(ctx.fx("required_cases"), ctx.fx("plan_issues"), ctx.fx("plan_risks"))
    return out.select("plan_id", "pos", "dropped_key", "dropped_risk", "requirement_key", "risk_id")


@query(
    "agg_24",
    """WITH n AS (SELECT plan_id, upper(risk_id) AS r, count(*) AS n FROM fx_required_cases WHERE trim(risk_id) <> '' GROUP BY ALL)
    SELECT k.plan_id, k.risk_id, k.level, coalesce(n, 0) AS n FROM fx_plan_risks k LEFT JOIN n ON n.plan_id = k.plan_id AND n.r = upper(k.risk_id)
    WHERE (upper(level) LIKE '%HIGH%' OR upper(level) IN ('VH', 'H')) AND coalesce(n, 0) < 2""",
)
def agg_24(ctx):
    return cv.under_covered(ctx.fx("plan_risks"), ctx.fx("required_cases")).select("plan_id", "risk_id", "level", "n")


@fixture
def test_conditions(d) -> str:
    return f"""
    SELECT p_brand AS service, concat('cond-', p_partkey) AS cond_id, p_partkey AS pos, CASE WHEN p_partkey % 4 > 0 THEN concat('tc-', p_partkey % 30) END AS condition_ref,
           CASE WHEN p_partkey % 3 = 0 THEN concat('Item-', p_partkey % 20) WHEN p_partkey % 3 = 1 THEN ' ' END AS basis_item,
           {pick("p_partkey % 3", ["AUTOMATED", "MANUAL", "CANDIDATE"])} AS automation FROM {d.t("part")}"""


@fixture
def test_cases(d) -> str:
    return f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('Brand#', l_partkey % 28) AS service,
           CASE WHEN l_linenumber % 2 = 0 THEN concat('TC-', l_suppkey % 45) END AS condition_ref,
           CASE WHEN l_linenumber % 3 > 0 THEN concat('ITEM-', l_suppkey % 33) END AS requirement_key FROM {d.t("lineitem")}"""


@query(
    "jn_31",
    """WITH a AS (SELECT service, upper(condition_ref) AS k, arg_min(struct_pack(i := cond_id, m := automation), pos) AS v FROM fx_test_conditions WHERE condition_ref IS NOT NULL GROUP BY ALL),
    b AS (SELECT service, upper(basis_item) AS k, arg_min(struct_pack(i := cond_id, m := automation), pos) AS v FROM fx_test_conditions WHERE trim(basis_item) <> '' GROUP BY ALL),
    x AS (SELECT q.*, coalesce(a.v, b.v) AS v, q.service IN (SELECT service FROM fx_test_conditions) AS has FROM fx_test_cases q LEFT JOIN a ON a.service = q.service AND a.k = upper(q.condition_ref)
      LEFT JOIN b ON b.service = q.service AND b.k = upper(q.requirement_key))
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, v.i AS cond_id, v.m AS automation, CASE WHEN has AND v IS NULL THEN NULL ELSE requirement_key END AS requirement_key FROM x""",
)
def jn_31(ctx):
    out = cv.link_cases(ctx.fx("test_cases"), ctx.fx("test_conditions"))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cond_id", "automation", "requirement_key")


@fixture
def cited_conditions(d) -> str:
    return f"""
    SELECT item_id, concat('src', item_id % 22) AS strategy, CASE WHEN item_id % 4 = 0 THEN 'r9' WHEN item_id % 4 = 1 THEN 'R1' WHEN item_id % 4 = 2 THEN ' ' END AS risk_ref,
           CASE item_id % 5 WHEN 0 THEN 'the' WHEN 1 THEN ' ' ELSE substr(text, 1, 40) END AS basis_item, CAST(40 + item_id % 60 AS DOUBLE) AS confidence FROM {d.t("benchmark")}
    UNION ALL SELECT 1000000 + doc_id, source, NULL, concat(substr(text, 5, 14), ' '), 80.0 FROM {d.t("documents")}"""


@fixture
def strategy_risks(d) -> str:
    return f"SELECT concat('src', n_nationkey) AS strategy, concat('r', n_nationkey % 3) AS risk_id FROM {d.t('nation')} WHERE n_nationkey % 2 = 0"


@query(
    "jn_32",
    f"""WITH b AS (SELECT source AS strategy, {duck.norm_blank("text")} AS t FROM documents),
    q AS (SELECT *, {duck.norm_blank("basis_item")} AS p FROM fx_cited_conditions),
    ph AS (SELECT DISTINCT strategy, p FROM q WHERE trim(basis_item) <> ''), ok AS (SELECT DISTINCT ph.strategy, ph.p FROM ph JOIN b ON b.strategy = ph.strategy AND contains(b.t, ph.p)),
    x AS (SELECT q.*, q.strategy IN (SELECT strategy FROM fx_strategy_risks) AND coalesce(trim(risk_ref) <> '', false) AND NOT EXISTS (SELECT 1 FROM fx_strategy_risks r WHERE r.strategy = q.strategy AND upper(r.risk_id) = upper(q.risk_ref)) AS dropped_risk,
      coalesce(trim(basis_item) <> '', false) AND ok.p IS NULL AS dropped_item FROM q LEFT JOIN ok ON ok.strategy = q.strategy AND ok.p = q.p),
    s AS (SELECT strategy, bool_or(dropped_risk OR dropped_item) AS cap FROM x GROUP BY strategy)
    SELECT item_id, CASE WHEN NOT dropped_risk THEN risk_ref END AS risk_ref, CASE WHEN NOT dropped_item THEN basis_item END AS basis_item, CASE WHEN cap THEN least(confidence, 50) ELSE confidence END AS confidence
    FROM x JOIN s USING (strategy)""",
)
def jn_32(ctx):
    basis = ctx.table("documents").select(c("source").alias("strategy"), "text")
    out = cv.ground_conditions(ctx.fx("cited_conditions"), ctx.fx("strategy_risks"), basis)
    return out.select("item_id", "risk_ref", "basis_item", "confidence")


# --- endpoint references -----------------------------------------------------------------------------------


@fixture
def api_endpoints(d) -> str:
    return """
    SELECT scan_id AS grp, pos, verb AS method, CASE WHEN pos % 29 = 0 THEN '/' WHEN pos % 17 = 0 THEN '/{a}/{b}' WHEN pos % 5 = 0 THEN concat(path, '/') ELSE path END AS path FROM fx_endpoints"""


@fixture
def test_refs(d) -> str:
    filled = d.rx(d.rx("path", "[{]id[}]", "42"), "[{]line[}]", "x9")
    return f"""
    SELECT scan_id AS grp, pos, CASE WHEN pos % 3 = 0 THEN NULL WHEN pos % 3 = 1 THEN verb ELSE next_verb END AS method,
           CASE pos % 6 WHEN 0 THEN concat('/api', {filled}, '/') WHEN 1 THEN upper({filled}) WHEN 2 THEN concat({filled}, '/more') WHEN 3 THEN concat('host', {filled})
                WHEN 4 THEN {filled} ELSE concat({filled}, '//') END AS path, concat('T', pos % 40, '.java') AS file FROM fx_endpoints"""


_TPL = r"""e AS (SELECT grp, pos, method, path, CASE WHEN length(trim(path)) > 1 THEN rtrim(lower(trim(path)), '/') ELSE lower(trim(path)) END AS t FROM fx_api_endpoints),
 er AS (SELECT *, '^.*' || CASE WHEN replace(t, '/', '') = '' THEN '/' ELSE regexp_replace(regexp_replace(t, '\{[^/]*\}', '[^/]+', 'g'), '\.', '\\.', 'g') END || '/?$' AS rx FROM e),
 rn AS (SELECT *, CASE WHEN length(trim(path)) > 1 AND trim(path) LIKE '%/' THEN regexp_replace(lower(trim(path)), '/$', '') ELSE lower(trim(path)) END AS norm FROM fx_test_refs),
 hit AS (SELECT er.grp, er.pos, er.method, rn.pos AS rpos, rn.method AS rmethod, rn.file, rn.norm FROM er JOIN rn ON rn.grp = er.grp AND regexp_matches(rn.norm, er.rx))"""


@query(
    "jn_33",
    f"""WITH {_TPL}, c AS (SELECT grp, pos, arg_min(file, rpos) AS file FROM hit WHERE rmethod IS NULL OR rmethod = method GROUP BY ALL)
    SELECT e.grp, e.pos, e.method, e.path, CASE WHEN c.file IS NOT NULL THEN 'CURRENT' ELSE 'GAP' END AS status, c.file FROM e LEFT JOIN c USING (grp, pos)""",
)
def jn_33(ctx):
    return cv.reconcile_tests(ctx.fx("api_endpoints"), ctx.fx("test_refs"))


@query(
    "jn_34",
    f"""WITH {_TPL}, o AS (SELECT *, row_number() OVER (PARTITION BY grp, norm ORDER BY pos) AS k FROM rn WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.grp = rn.grp AND hit.norm = rn.norm))
    SELECT grp, pos, method, path, file FROM o WHERE k = 1""",
)
def jn_34(ctx):
    return cv.orphan_refs(ctx.fx("api_endpoints"), ctx.fx("test_refs"))


@fixture
def scoped_endpoints(d) -> str:
    return f"""
    SELECT concat('svc-', n_regionkey) AS scan_id, 'GET' AS method, concat('/n/', n_nationkey) AS path,
           {d.array("concat('#/components/schemas/N', n_nationkey)", "concat('List<R', n_regionkey, '>')", "' '")} AS refs FROM {d.t("nation")}"""


@fixture
def scope_edges(d) -> str:
    return f"""
    SELECT concat('svc-', n_regionkey) AS scan_id, concat('N', n_nationkey) AS schema, concat('S', s_suppkey, '[]') AS ref_schema FROM {d.t("supplier")} JOIN {d.t("nation")} ON s_nationkey = n_nationkey
    UNION ALL SELECT concat('svc-', n_regionkey), concat('S', s_suppkey), concat('List<S', s_suppkey + 25, '>') FROM {d.t("supplier")} JOIN {d.t("nation")} ON s_nationkey = n_nationkey
    UNION ALL SELECT concat('svc-', n_regionkey), concat('R', n_regionkey), concat('N', n_nationkey) FROM {d.t("nation")} WHERE n_nationkey % 3 = 0
    UNION ALL SELECT concat('svc-', n_regionkey), concat('S', s_suppkey), concat('R', n_regionkey) FROM {d.t("supplier")} JOIN {d.t("nation")} ON s_nationkey = n_nationkey WHERE s_suppkey % 9 = 0"""


@query(
    "jn_35",
    r"""WITH RECURSIVE k AS (SELECT DISTINCT scan_id, schema FROM fx_scope_edges),
    l AS (SELECT DISTINCT scan_id, schema, regexp_replace(regexp_replace(ref_schema, '\[\]$', ''), '^List<(.*)>$', '\1') AS nx FROM fx_scope_edges),
    s AS (SELECT scan_id, regexp_replace(regexp_replace(regexp_replace(r, '\[\]$', ''), '^List<(.*)>$', '\1'), '^.*/', '') AS schema
          FROM (SELECT scan_id, unnest(refs) AS r FROM fx_scoped_endpoints WHERE CAST(substr(path, 4) AS INTEGER) % 5 < 2)),
    t AS (SELECT scan_id, schema FROM s SEMI JOIN k USING (scan_id, schema) UNION SELECT t.scan_id, l.nx FROM t JOIN l ON l.scan_id = t.scan_id AND l.schema = t.schema JOIN k ON k.scan_id = t.scan_id AND k.schema = l.nx)
    SELECT scan_id, schema FROM t""",
)
def jn_35(ctx):
    e = ctx.fx("scoped_endpoints")
    chosen = F.regexp_extract("path", "([0-9]+)$", 1).cast("int") % 5 < 2
    sigs = e.filter(chosen).select("scan_id", F.concat_ws(" ", "method", "path").alias("signature"))
    edges = ctx.fx("scope_edges")
    _, reached = cv.scope_model(e, sigs, edges.select("scan_id", "schema"), edges)
    return reached.select("scan_id", "schema")


# --- plans ---------------------------------------------------------------------------------------------------


@query(
    "agg_23",
    f"""WITH {_MATCH}, {_ORPH}, {_ACT}, p AS (SELECT plan_id FROM r UNION SELECT plan_id FROM t)
    SELECT plan_id, (SELECT count(*) FROM m WHERE m.plan_id = p.plan_id) AS total, (SELECT count(*) FROM m WHERE m.plan_id = p.plan_id AND status = 'MATCHED') AS matched,
      (SELECT count(*) FROM m WHERE m.plan_id = p.plan_id AND status = 'GAP') AS gaps, (SELECT count(*) FROM o WHERE o.plan_id = p.plan_id) AS orphans,
      (SELECT count(*) FROM a WHERE a.plan_id = p.plan_id AND action = 'CREATED') AS created FROM p""",
)
def agg_23(ctx):
    m = _matches(ctx)
    tests = ctx.fx("existing_tests")
    return cv.coverage_summary(m, cv.orphans(tests, m), cv.gap_actions(m, tests))


@query(
    "agg_23_dimensions",
    """WITH d AS (SELECT plan_id, 'TECHNIQUE' AS dimension, technique AS v FROM fx_required_cases UNION ALL SELECT plan_id, 'LEVEL', level FROM fx_required_cases UNION ALL SELECT plan_id, 'TYPE', type FROM fx_required_cases
      UNION ALL SELECT plan_id, 'RISK_ID', risk_id FROM fx_required_cases UNION ALL SELECT plan_id, 'REQUIREMENT_KEY', requirement_key FROM fx_required_cases)
    SELECT plan_id, dimension, v AS value, count(*) AS n FROM d WHERE trim(v) <> '' GROUP BY ALL""",
)
def agg_23_dimensions(ctx):
    return cv.dimensions(ctx.fx("required_cases")).groupBy("plan_id", "dimension", "value").agg(F.count("*").alias("n"))


@query(
    "agg_25",
    """SELECT strategy, ref, CASE WHEN upper(trim(raw)) IN ('AUTOMATED','AUTOMATE','AUTO') THEN 'AUTOMATED' WHEN upper(trim(raw)) = 'MANUAL' THEN 'MANUAL' ELSE 'CANDIDATE' END AS automation FROM fx_conditions""",
)
def agg_25(ctx):
    return cv.routing(ctx.fx("conditions"))


@fixture
def plan_parts(d) -> str:
    return f"""
    SELECT conv_id AS plan_id, turn AS part, turn AS pos, CASE WHEN turn % 3 = 0 THEN NULL ELSE concat('REQ-', turn % 2) END AS requirement_key,
           concat(CASE WHEN turn % 2 = 0 THEN ' Login  ' ELSE 'login ' END, CASE WHEN turn % 4 < 2 THEN 'Works' ELSE substr(text, 1, 6) END) AS title,
           CASE WHEN turn % 4 = 0 THEN ' ' WHEN turn % 4 = 1 THEN NULL ELSE concat('R', turn % 3) END AS risk_id, role AS description,
           CAST(90 - (conv_id + turn * 7) % 50 AS DOUBLE) AS confidence, CASE WHEN turn % 2 = 0 THEN role ELSE 'same note' END AS note FROM {d.t("conversations")}"""


@query(
    "agg_37",
    f"""WITH a AS (SELECT 'case' AS kind, plan_id, coalesce(requirement_key, '') || '|' || {duck.norm_blank("title")} AS mk, part, pos FROM fx_plan_parts),
    b AS (SELECT 'risk' AS kind, plan_id, CASE WHEN coalesce(trim(risk_id), '') = '' THEN 'desc:' || {duck.norm_blank("description")} ELSE risk_id END AS mk, part, pos FROM fx_plan_parts),
    n AS (SELECT 'note' AS kind, plan_id, note AS mk, part, pos FROM fx_plan_parts), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM n)
    SELECT kind, plan_id, mk, min(part) AS part, NULL::DOUBLE AS confidence FROM u GROUP BY kind, plan_id, mk
    UNION ALL SELECT 'confidence', plan_id, NULL, NULL, min(confidence) FROM fx_plan_parts GROUP BY plan_id""",
)
def agg_37(ctx):
    p = ctx.fx("plan_parts")
    m = cv.merge_parts(p, p, p, p)
    no_conf = F.lit(None).cast("double").alias("confidence")

    def rows(kind, df, key):
        return df.select(F.lit(kind).alias("kind"), "plan_id", c(key).alias("mk"), "part", no_conf)

    conf = m["confidence"].select(
        F.lit("confidence").alias("kind"), "plan_id", F.lit(None).cast("string").alias("mk"), F.lit(None).cast("bigint").alias("part"), "confidence"
    )
    out = rows("case", m["cases"], "mk").unionByName(rows("risk", m["risks"], "mk"))
    return out.unionByName(rows("note", m["notes"], "note")).unionByName(conf)


@fixture
def call_edges(d) -> str:
    return f"""SELECT concat('svc', l_orderkey % 200) AS svc, concat('GET /', l_partkey % 50) AS endpoint, concat('m', l_suppkey % 70) AS called FROM {d.t("lineitem")}"""


@fixture
def throw_edges(d) -> str:
    return f"""SELECT concat('svc', p_partkey % 200) AS svc, concat('m', p_partkey % 61) AS called, concat('Ex', p_size) AS exception FROM {d.t("part")}"""


@fixture
def direct_throws(d) -> str:
    return f"""SELECT concat('svc', o_orderkey % 200) AS svc, concat('GET /', o_orderkey % 53) AS endpoint, concat('Ex', o_custkey % 70) AS exception FROM {d.t("orders")}"""


@fixture
def handler_rows(d) -> str:
    return f"""SELECT concat('svc', p_partkey % 200) AS svc, concat('Ex', p_partkey % 23) AS exception, p_partkey AS pos, CAST(200 + 100 * (p_size % 4) + p_size AS INTEGER) AS status FROM {d.t("part")}"""


@fixture
def exception_notes(d) -> str:
    return f"""SELECT concat('svc', s_suppkey % 200) AS svc, concat('Ex', s_suppkey % 31) AS exception, CAST(400 + s_suppkey % 20 AS INTEGER) AS status FROM {d.t("supplier")}"""


@fixture
def local_handlers(d) -> str:
    return f"""SELECT concat('svc', c_custkey % 200) AS svc, concat('GET /', c_custkey % 55) AS endpoint, CAST(390 + c_custkey % 60 AS INTEGER) AS status, 'EXCEPTION_HANDLER_LOCAL' AS origin FROM {d.t("customer")}"""


@fixture
def framework_defaults(d) -> str:
    return f"SELECT concat('Ex', n_nationkey * 2) AS exception, CAST(380 + n_nationkey * 6 AS INTEGER) AS status FROM {d.t('nation')}"


@query(
    "jn_49",
    """WITH e AS (SELECT c.svc, c.endpoint, t.exception FROM (SELECT DISTINCT * FROM fx_call_edges) c JOIN (SELECT DISTINCT * FROM fx_throw_edges) t USING (svc, called) UNION SELECT svc, endpoint, exception FROM fx_direct_throws),
    h AS (SELECT svc, exception, arg_min(status, pos) AS s FROM fx_handler_rows GROUP BY ALL), n AS (SELECT svc, exception, min(status) AS s FROM fx_exception_notes GROUP BY ALL),
    x AS (SELECT e.svc, e.endpoint, coalesce(h.s, n.s, f.status) AS status, 0 AS rk, 'EXCEPTION_HANDLER_REACHABLE' AS origin FROM e LEFT JOIN h USING (svc, exception) LEFT JOIN n USING (svc, exception) LEFT JOIN fx_framework_defaults f USING (exception)
      UNION ALL SELECT svc, endpoint, status, 1, origin FROM fx_local_handlers)
    SELECT svc, endpoint, status, arg_min(origin, rk) AS origin FROM x WHERE status >= 400 GROUP BY ALL""",
)
def jn_49(ctx):
    names = ("call_edges", "throw_edges", "direct_throws", "local_handlers", "handler_rows", "exception_notes", "framework_defaults")
    return cv.reachable_statuses(*[ctx.fx(n) for n in names])
