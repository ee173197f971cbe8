"""Clean-up chain, carry-forward, evidence binding and vulnerability snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import findings as fn
from concordat.operators import vulnerabilities as vu
from concordat.plans import duck
from concordat.plans.dialect import pick
from concordat.plans.registry import fixture, query

c = F.col


@query(
    "set_1",
    """SELECT row_id, pos + k * 1000000000000000 AS pos, CAST(k AS INTEGER) AS source_order, CASE WHEN k = 2 THEN NULL ELSE explanation END AS explanation
       FROM fx_findings JOIN (SELECT unnest([0, 1, 2]) AS k) ON (k = 0 AND type LIKE 'OPENAPI%') OR (k = 1 AND type NOT LIKE 'OPENAPI%') OR (k = 2 AND type = 'SPEC_DRIFT')""",
)
def set_1(ctx):
    f = ctx.fx("findings")
    parser = f.filter(c("type").startswith("OPENAPI"))
    diff = f.filter(~c("type").startswith("OPENAPI"))
    drift = f.filter(c("type") == "SPEC_DRIFT").drop("explanation")
    return fn.all_findings(parser, diff, drift).select("row_id", "pos", "source_order", "explanation")


_NS = duck.norm_summary("summary")


@query(
    "win_3",
    f"""WITH k AS (SELECT *, upper(coalesce(origin, '')) = 'DETERMINISTIC' AS det, type || '|' || coalesce(endpoint, '') || '|' || coalesce(spec_source, '') || '|' || {_NS} AS key FROM fx_near),
    r AS (SELECT *, row_number() OVER (PARTITION BY scan_id, key ORDER BY det DESC, pos) AS rn, first_value(det) OVER w AS fdet, first_value(explanation) OVER w AS fe,
          first_value(proposed_fix) OVER w AS fp, min(pos) OVER (PARTITION BY scan_id, key) AS first_pos FROM k WINDOW w AS (PARTITION BY scan_id, key ORDER BY pos))
    SELECT row_id, first_pos, CASE WHEN det AND NOT fdet THEN coalesce(explanation, fe) ELSE explanation END AS explanation,
      CASE WHEN det AND NOT fdet THEN coalesce(proposed_fix, fp) ELSE proposed_fix END AS proposed_fix FROM r WHERE rn = 1""",
)
def win_3(ctx):
    return fn.dedup_cross(ctx.fx("near")).select("row_id", "first_pos", "explanation", "proposed_fix")


@fixture
def near(d) -> str:
    return """
    SELECT CAST(CAST(scan_id AS BIGINT) % 50 AS STRING) AS scan_id, row_id, pos * 1000000 + CAST(scan_id AS BIGINT) AS pos, type, endpoint, spec_source, summary, origin, explanation, proposed_fix FROM fx_findings"""


@fixture
def located(d) -> str:
    return """
    SELECT CAST(CAST(scan_id AS BIGINT) % 300 AS STRING) AS scan_id, row_id, finding_id, pos * 1000000 + CAST(scan_id AS BIGINT) AS pos, type, endpoint, spec_source, spec_locus, summary, code_file,
           CAST(code_line AS INTEGER) AS code_line FROM fx_findings"""


_RC = f"""k AS (SELECT *, CASE WHEN type IN ('SCHEMA_FIELD_MISSING','SCHEMA_FIELD_EXTRA','SCHEMA_FIELD_TYPE_MISMATCH') AND spec_locus IS NOT NULL
     THEN 'S|' || type || '|' || coalesce(spec_source, '') || '|' || spec_locus
     WHEN code_file IS NOT NULL THEN 'C|' || type || '|' || coalesce(spec_source, '') || '|' || code_file || '|' || coalesce(CAST(code_line AS VARCHAR), '') || '|' || {_NS} END AS rc FROM fx_located),
 e AS (SELECT scan_id, rc, endpoint, min(pos) AS first_pos FROM k WHERE rc IS NOT NULL AND endpoint IS NOT NULL
     AND (rc NOT LIKE 'S|%' OR regexp_matches(endpoint, '^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE) ')) GROUP BY ALL),
 n AS (SELECT scan_id, rc, count(*) AS n FROM e GROUP BY ALL)"""


@query(
    "win_4",
    f"""WITH {_RC}, s AS (SELECT k.*, n.n, row_number() OVER (PARTITION BY k.scan_id, k.rc ORDER BY pos) AS rn FROM k LEFT JOIN n ON n.scan_id = k.scan_id AND n.rc = k.rc)
    SELECT row_id, CASE WHEN n > 1 AND rc LIKE 'S|%' THEN sha256(type || chr(1) || coalesce(spec_source, chr(0)) || chr(1) || spec_locus) ELSE finding_id END AS finding_id,
      CASE WHEN n > 1 AND rc LIKE 'S|%' AND type = 'SCHEMA_FIELD_MISSING' THEN 'Field ''' || split_part(spec_locus, '#', 2) || ''' of shared spec schema ''' || split_part(spec_locus, '#', 1) || ''' is in code but missing from the spec schema'
           WHEN n > 1 AND rc LIKE 'S|%' AND type = 'SCHEMA_FIELD_EXTRA' THEN 'Field ''' || split_part(spec_locus, '#', 2) || ''' of shared spec schema ''' || split_part(spec_locus, '#', 1) || ''' is in the spec but not in code'
           ELSE summary END AS summary, CASE WHEN n > 1 THEN n END AS n_affected FROM s WHERE rn = 1 OR rc IS NULL""",
)
def win_4(ctx):
    survivors, _ = fn.collapse_root_cause(ctx.fx("located"))
    return survivors.select("row_id", "finding_id", "summary", "n_affected")


@query("win_4_affected", f"WITH {_RC} SELECT e.scan_id, e.rc, e.endpoint, e.first_pos FROM e JOIN n ON n.scan_id = e.scan_id AND n.rc = e.rc AND n.n > 1")
def win_4_affected(ctx):
    _, affected = fn.collapse_root_cause(ctx.fx("located"))
    return affected.select("scan_id", "rc", "endpoint", "first_pos")


def _prior(cond: str, cols: str) -> str:
    return f"""p AS (SELECT f.row_id, arg_max(struct_pack({cols}), (h.created_at, h.row_id)) AS v FROM fx_findings f
      JOIN fx_findings h ON h.finding_id = f.finding_id AND h.scan_id <> f.scan_id AND {cond} GROUP BY f.row_id)"""


@query("jn_20", f"""WITH {_prior("h.status <> 'OPEN'", "s := h.status, b := h.reviewed_by, a := h.reviewed_at")}
   SELECT f.row_id, CASE WHEN v IS NULL THEN f.status ELSE v.s END AS status, CASE WHEN v IS NULL THEN f.reviewed_by ELSE v.b END AS reviewed_by,
     CAST(CAST(CASE WHEN v IS NULL THEN f.reviewed_at ELSE v.a END AS DATE) AS VARCHAR) AS reviewed_on FROM fx_findings f LEFT JOIN p USING (row_id)""")  # fmt: skip
def jn_20(ctx):
    f = ctx.fx("findings")
    out = fn.carry_disposition(f, f)
    return out.select("row_id", "status", "reviewed_by", F.to_date("reviewed_at").cast("string").alias("reviewed_on"))


@query("jn_21", f"""WITH {_prior("h.user_severity IS NOT NULL", "s := h.user_severity")}
   SELECT f.row_id, coalesce(f.user_severity, CASE WHEN v.s IN ('BLOCKER','CRITICAL','MAJOR','MINOR','INFO','UNSPECIFIED') THEN v.s END) AS user_severity FROM fx_findings f LEFT JOIN p USING (row_id)""")  # fmt: skip
def jn_21(ctx):
    f = ctx.fx("findings")
    return fn.carry_user_severity(f, f).select("row_id", "user_severity")


@query("jn_22", f"""WITH {_prior("h.dispute_verdict IS NOT NULL", "s := h.dispute_verdict, b := h.reviewed_by, a := h.reviewed_at")}
   SELECT f.row_id, CASE WHEN v IS NULL THEN f.dispute_verdict ELSE v.s END AS dispute_verdict,
     CASE WHEN v IS NOT NULL AND f.reviewed_at IS NULL THEN v.b ELSE f.reviewed_by END AS reviewed_by FROM fx_findings f LEFT JOIN p USING (row_id)""")  # fmt: skip
def jn_22(ctx):
    f = ctx.fx("findings")
    return fn.carry_dispute_verdict(f, f).select("row_id", "dispute_verdict", "reviewed_by")


@fixture
def enrichment(d) -> str:
    return f"""
    SELECT concat(p_partkey, '-R') AS finding_id, CASE WHEN p_size % 2 = 0 THEN p_name END AS explanation,
           CASE WHEN p_size % 3 = 0 THEN p_type END AS proposed_fix FROM {d.t("part")}"""


@fixture
def ai_disputes(d) -> str:
    return f"""
    SELECT concat(p_partkey, '-', CASE WHEN p_size % 2 = 0 THEN 'R' ELSE 'A' END) AS finding_id, p_brand AS reason FROM {d.t("part")}"""


@query(
    "jn_23",
    f"""WITH a AS (SELECT *, {duck.attention()} AS att FROM fx_findings)
    SELECT a.row_id, coalesce(a.explanation, e.explanation) AS explanation, coalesce(a.proposed_fix, e.proposed_fix) AS proposed_fix,
      CASE WHEN reason IS NOT NULL AND upper(origin) = 'DETERMINISTIC' AND NOT att THEN reason ELSE ai_dispute_reason END AS ai_dispute_reason,
      ai_disputed OR coalesce(reason IS NOT NULL AND upper(origin) = 'DETERMINISTIC' AND NOT att, false) AS ai_disputed
    FROM a LEFT JOIN fx_enrichment e USING (finding_id) LEFT JOIN fx_ai_disputes d USING (finding_id)""",
)
def jn_23(ctx):
    out = fn.graft(ctx.fx("findings"), ctx.fx("enrichment"), ctx.fx("ai_disputes"))
    return out.select("row_id", "explanation", "proposed_fix", "ai_dispute_reason", "ai_disputed")


@fixture
def spec_texts(d) -> str:
    nl = "chr(10)"
    return f"""
    SELECT scan_id, pos AS spec_pos, CASE WHEN pos % 23 = 0 THEN ' ' ELSE concat('paths:', {nl}, '  ', CASE WHEN pos % 2 = 0 THEN path ELSE concat('"', path, '"') END, ':', {nl},
      '    get:', {nl}, '      id: op', pos, {nl}, '   ', {nl}, CASE WHEN pos % 5 = 0 THEN '' ELSE concat('  /other/', pos % 4, ':', {nl}, '    x: 1', {nl}) END, '# end') END AS content FROM fx_endpoints"""


@fixture
def located_findings(d) -> str:
    return """
    SELECT scan_id, pos AS row_id, CASE pos % 6 WHEN 0 THEN concat('/other/', pos % 5) WHEN 1 THEN NULL ELSE concat(verb, ' ', path) END AS endpoint FROM fx_endpoints"""


@query(
    "jn_24",
    r"""WITH l AS (SELECT scan_id, spec_pos, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT scan_id, spec_pos, string_split(content, chr(10)) AS s FROM fx_spec_texts WHERE trim(content) <> '')),
    x AS (SELECT *, length(line) - length(ltrim(line)) AS ind, trim(line) AS t FROM l),
    w AS (SELECT DISTINCT scan_id, endpoint, CASE WHEN contains(endpoint, ' ') THEN substr(endpoint, instr(endpoint, ' ') + 1) ELSE endpoint END AS path FROM fx_located_findings WHERE endpoint IS NOT NULL),
    s AS (SELECT w.scan_id, w.endpoint, arg_min(struct_pack(p := x.spec_pos, i := x.i, ind := x.ind), (x.spec_pos, x.i)) AS a FROM w JOIN x ON x.scan_id = w.scan_id AND x.t IN (w.path || ':', '"' || w.path || '":') GROUP BY ALL),
    e AS (SELECT s.scan_id, s.endpoint, s.a, min(x.i) FILTER (WHERE x.t <> '' AND x.ind <= s.a.ind) AS stop FROM s LEFT JOIN x ON x.scan_id = s.scan_id AND x.spec_pos = s.a.p AND x.i > s.a.i GROUP BY ALL),
    f AS (SELECT e.scan_id, e.endpoint, rtrim(string_agg(x.line, chr(10) ORDER BY x.i), chr(10) || ' ') AS fragment FROM e JOIN x ON x.scan_id = e.scan_id AND x.spec_pos = e.a.p AND x.i >= e.a.i AND (stop IS NULL OR x.i < stop) GROUP BY ALL)
    SELECT q.row_id, q.endpoint, f.fragment FROM fx_located_findings q LEFT JOIN f ON f.scan_id = q.scan_id AND f.endpoint = q.endpoint""",
)
def jn_24(ctx):
    return fn.attach_fragment(ctx.fx("located_findings"), ctx.fx("spec_texts")).select("row_id", "endpoint", "fragment")


@fixture
def known_paths(d) -> str:
    return f"""
    SELECT DISTINCT concat('src', page_id % 18) AS scan_id, lower({d.rxget("html", '<a href="(/[^"]*)"')}) AS path FROM {d.t("pages")}
    UNION ALL SELECT DISTINCT 'src3' AS scan_id, ' ' AS path FROM {d.t("region")}
    UNION ALL SELECT 'src5' AS scan_id, CASE WHEN n_nationkey % 2 = 0 THEN '/v' ELSE concat('/v', n_nationkey) END FROM {d.t("nation")}"""


@fixture
def design_findings(d) -> str:
    first = d.rxget("text", "([A-Za-z]+)")
    return f"""
    SELECT doc_id, source AS scan_id, 'MAJOR' AS severity, CASE WHEN doc_id % 2 = 0 THEN 'because' END AS explanation,
           CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN concat('GET /v', doc_id % 40, '/x') WHEN 3 THEN concat('GET /', {first}, '/{{id}}')
                ELSE concat('Schema ', {first}) END AS endpoint FROM {d.t("documents")}"""


@query(
    "jn_25",
    """WITH h AS (SELECT doc_id FROM fx_design_findings f WHERE EXISTS (SELECT 1 FROM fx_known_paths k WHERE k.scan_id = f.scan_id AND trim(k.path) <> '' AND contains(lower(f.endpoint), k.path))),
    x AS (SELECT f.*, coalesce(trim(endpoint) <> '', false) AND scan_id IN (SELECT scan_id FROM fx_known_paths) AND doc_id NOT IN (SELECT doc_id FROM h) AS phantom FROM fx_design_findings f)
    SELECT doc_id, phantom, CASE WHEN phantom THEN 'INFO' ELSE severity END AS severity, CASE WHEN phantom AND regexp_matches(endpoint, '^(GET|POST) ') THEN
      '[unverified endpoint — ''' || endpoint || ''' is not a parsed API endpoint] ' || coalesce(explanation, '') ELSE explanation END AS explanation FROM x""",
)
def jn_25(ctx):
    return fn.phantom_check(ctx.fx("design_findings"), ctx.fx("known_paths")).select("doc_id", "phantom", "severity", "explanation")


@fixture
def code_schema_rows(d) -> str:
    return f"""
    SELECT p_brand AS scan_id, concat('S', p_partkey % 9) AS schema, min(p_partkey) AS pos, CASE WHEN min(p_partkey) % 4 = 0 THEN NULL ELSE concat('S', p_partkey % 9, '.java') END AS source
    FROM {d.t("part")} GROUP BY p_brand, p_partkey % 9"""


@fixture
def code_field_rows(d) -> str:
    return f"""
    SELECT p_brand AS scan_id, concat('S', p_partkey % 9) AS schema, concat('f', p_size % 6) AS field, p_partkey AS pos,
           CASE WHEN p_partkey % 5 > 0 THEN concat('S.java:', p_partkey) END AS source FROM {d.t("part")}"""


@fixture
def pointed(d) -> str:
    return f"""
    SELECT p_partkey, p_brand AS scan_id, CASE WHEN p_partkey % 3 > 0 THEN concat('S', p_size % 11) END AS code_schema,
           CASE WHEN p_partkey % 3 = 1 THEN concat('f', p_partkey % 8) END AS code_field, concat('S', p_partkey % 10) AS endpoint FROM {d.t("part")}"""


@query(
    "jn_26",
    """WITH f AS (SELECT scan_id, schema, field, arg_min(source, pos) AS src FROM fx_code_field_rows WHERE source IS NOT NULL GROUP BY ALL)
    SELECT p_partkey, CASE WHEN code_schema IS NOT NULL AND code_field IS NOT NULL THEN f.src ELSE s.source END AS evidence,
      CASE WHEN code_schema IS NOT NULL AND code_field IS NOT NULL THEN CASE WHEN f.src IS NOT NULL THEN code_schema || '#' || code_field END WHEN s.source IS NOT NULL THEN endpoint END AS spec_locus
    FROM fx_pointed p LEFT JOIN f ON f.scan_id = p.scan_id AND f.schema = code_schema AND f.field = code_field
    LEFT JOIN fx_code_schema_rows s ON s.scan_id = p.scan_id AND s.schema = p.endpoint""",
)
def jn_26(ctx):
    out = fn.bind_evidence(ctx.fx("pointed"), ctx.fx("code_schema_rows"), ctx.fx("code_field_rows"))
    return out.select("p_partkey", "evidence", "spec_locus")


@query(
    "jn_43",
    """SELECT row_id, f.severity, s.service FROM fx_findings f LEFT JOIN fx_scans s USING (scan_id) WHERE finding_id NOT IN (SELECT finding_id FROM fx_defects WHERE created)""",
)
def jn_43(ctx):
    return fn.defects_to_create(ctx.fx("findings"), ctx.fx("defects"), ctx.fx("scans")).select("row_id", "severity", "service")


@fixture
def tracker_statuses(d) -> str:
    return f"""
    SELECT concat('KEY-', o_orderkey) AS jira_key, {pick("o_orderkey % 4", ["To Do", "In Progress", "Closed", None])} AS name,
           {pick("o_orderkey % 5", ["new", "done", "done", None, None])} AS category FROM {d.t("orders")}"""


@query(
    "jn_44",
    """SELECT link_id, new_name, new_category, status_name IS DISTINCT FROM new_name OR status_category IS DISTINCT FROM new_category AS changed
       FROM fx_defects JOIN (SELECT jira_key, name AS new_name, category AS new_category FROM fx_tracker_statuses) USING (jira_key)
       WHERE created AND jira_key <> '' AND (status_category IS NULL OR lower(status_category) <> 'done')""",
)
def jn_44(ctx):
    return fn.sync_status(ctx.fx("defects"), ctx.fx("tracker_statuses")).select("link_id", "new_name", "new_category", "changed")


# --- vulnerabilities ------------------------------------------------------------------------------------

_ROLL = """r AS (SELECT watch_id, snapshot_id, taken_on, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
  count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low, count(DISTINCT project) AS projects, count(*) FILTER (WHERE fixable) AS fixable
  FROM fx_vulns GROUP BY ALL)"""
_DELTA = f"""{_ROLL}, d AS (SELECT *, critical + high + medium + low AS total, critical * 1000000000000 + high * 100000000 + medium * 10000 + low AS score,
   lag(snapshot_id) OVER w AS psid, lag(critical) OVER w AS pc, coalesce(lag(critical + high + medium + low) OVER w, 0) AS prev_total,
   lag(critical * 1000000000000 + high * 100000000 + medium * 10000 + low) OVER w AS pscore FROM r WINDOW w AS (PARTITION BY watch_id ORDER BY taken_on, snapshot_id)),
 ns AS (SELECT d.snapshot_id, min(v.severity) AS new_severe FROM d JOIN fx_vulns v ON v.snapshot_id = d.snapshot_id AND v.severity IN ('critical','high')
   WHERE psid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_vulns o WHERE o.snapshot_id = d.psid AND o.issue_id = v.issue_id) GROUP BY d.snapshot_id)"""
_WORST = "CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END"


@query("agg_17", f"WITH {_ROLL} SELECT watch_id, snapshot_id, critical, high, medium, low, projects, fixable FROM r")
def agg_17(ctx):
    return vu.snapshot_rollup(ctx.fx("vulns")).drop("taken_on")


@query(
    "agg_18",
    f"""WITH {_ROLL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY watch_id ORDER BY taken_on DESC, snapshot_id DESC) AS rn FROM r) WHERE rn = 1)
    SELECT 'watches' AS measure, CAST(count(*) AS DOUBLE) AS value FROM l UNION ALL SELECT 'projects', sum(projects) FROM l UNION ALL SELECT 'critical', sum(critical) FROM l
    UNION ALL SELECT 'high', sum(high) FROM l UNION ALL SELECT 'medium', sum(medium) FROM l UNION ALL SELECT 'low', sum(low) FROM l UNION ALL SELECT 'fixable', sum(fixable) FROM l
    UNION ALL SELECT 'unseen_alerts', count(*) FROM fx_alerts WHERE NOT seen UNION ALL SELECT 'trains', count(*) FROM fx_trains
    UNION ALL SELECT 'trains_open', count(*) FROM fx_trains WHERE status NOT IN ('DONE','FAILED','CANCELLED','ALREADY_FIXED','MERGED')
    UNION ALL SELECT 'trains_done', count(*) FROM fx_trains WHERE status = 'DONE' UNION ALL SELECT 'fix_actions', count(*) FROM fx_ledger WHERE skill = 'fix'
    UNION ALL SELECT 'fix_cost', floor(sum(est_cost) * 100 + 0.5) / 100 FROM fx_ledger WHERE skill = 'fix'""",
)
def agg_18(ctx):
    return vu.portfolio_summary(ctx.fx("vulns"), ctx.fx("alerts"), ctx.fx("trains"), ctx.fx("ledger"), "fix")


@query("win_5", f"WITH {_DELTA} SELECT watch_id, snapshot_id, total, prev_total, {_WORST} AS worst, coalesce(score > pscore, false) AS escalated FROM d")
def win_5(ctx):
    out = vu.snapshot_delta(vu.snapshot_rollup(ctx.fx("vulns")))
    return out.select("watch_id", "snapshot_id", "total", "prev_total", "worst", "escalated")


@query("jn_40", f"WITH {_DELTA} SELECT snapshot_id, new_severe FROM ns")
def jn_40(ctx):
    v = ctx.fx("vulns")
    return vu.new_severe(v, vu.snapshot_delta(vu.snapshot_rollup(v))).select("snapshot_id", "new_severe")


@query(
    "st_1_batch",
    f"""WITH {_DELTA}, a AS (SELECT d.*, ns.new_severe, psid IS NULL AND total > 0 AS first_, critical > coalesce(pc, 0) AS nc, total > prev_total AS worse, coalesce(score > pscore, false) AS esc,
      format('{{}} critical, {{}} high, {{}} medium, {{}} low.', critical, high, medium, low) AS counts FROM d LEFT JOIN ns USING (snapshot_id))
    SELECT watch_id, snapshot_id, {_WORST} AS severity, CASE WHEN first_ THEN 'Now watching ' || watch_id || ': ' || counts WHEN nc THEN 'New critical vulnerability in ' || watch_id || ' — now ' || counts
      WHEN new_severe IS NOT NULL THEN 'New ' || new_severe || '-severity vulnerability in ' || watch_id || ' — now ' || counts
      WHEN worse THEN 'Vulnerabilities increased in ' || watch_id || ' (was ' || prev_total || ') — now ' || counts
      WHEN esc THEN 'Vulnerability severity increased in ' || watch_id || ' — now ' || counts ELSE 'Vulnerabilities changed in ' || watch_id || ' — now ' || counts END AS message
    FROM a WHERE first_ OR nc OR worse OR esc OR new_severe IS NOT NULL""",
)
def st_1_batch(ctx):
    return vu.alerts(ctx.fx("vulns"))


@query(
    "top_4",
    """WITH l AS (SELECT watch_id, max(taken_on) AS t FROM fx_vulns GROUP BY watch_id)
    SELECT v.watch_id, v.event_id, v.severity, v.risk_score, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank
    FROM fx_vulns v JOIN l ON l.watch_id = v.watch_id AND l.t = v.taken_on""",
)
def top_4(ctx):
    return vu.latest_issues(ctx.fx("vulns")).select("watch_id", "event_id", "severity", "risk_score", "rank")
