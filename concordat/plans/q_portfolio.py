"""Verdicts, summaries, costs, defects, activity and order-based operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.operators import portfolio as pf
from concordat.operators import windows as win
from concordat.plans import duck
from concordat.plans.dialect import pick
from concordat.plans.registry import fixture, query

c = F.col
TODAY = "2001-08-01"


def now():
    return F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")


RANK = duck.SEVERITY_RANK.format


@fixture
def alerts(d) -> str:
    return f"""
    SELECT event_id, concat('w', user_id) AS watch_id, event_id % 3 = 0 AS seen,
           {pick("event_id % 5", ["critical", "High", "medium", "low", None])} AS severity, ts AS created_at
    FROM {d.t("events")}"""


@fixture
def gates(d) -> str:
    return f"""
    SELECT event_id, {pick("event_id % 4", ["PENDING", "APPROVED", "REJECTED", "CONSUMED"])} AS status FROM {d.t("events")}"""


@fixture
def codegen_runs(d) -> str:
    return f"""
    SELECT concat('run-', o_orderkey) AS run_id, {pick("o_orderkey % 3", ["PASS", "FAIL", None])} AS build_status,
           {d.plus_minutes("o_orderdate", "o_orderkey % 1440")} AS created_at FROM {d.t("orders")}"""


@fixture
def acks(d) -> str:
    return f"""
    SELECT CASE WHEN c_custkey % 50 = 0 THEN ' ' ELSE CAST(c_custkey * 3 AS STRING) END AS item_id FROM {d.t("customer")}"""


_VERDICT = f"""count(*) FILTER (WHERE NOT att) AS counted,
  {", ".join(f"count(*) FILTER (WHERE NOT att AND eff = '{s}') AS {s.lower()}" for s in ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "UNSPECIFIED"))},
  count(*) FILTER (WHERE NOT att AND type IN {duck.BREAKING}) AS breaking, count(*) FILTER (WHERE ai_disputed) AS disputed"""
_F = f"f AS (SELECT *, {duck.attention()} AS att, coalesce(user_severity, severity) AS eff FROM fx_findings)"
_CASE = "CASE WHEN blocker > {0} OR critical > {1} OR breaking > {2} THEN 'FAIL' WHEN major + minor + unspecified > 0 THEN 'WARN' ELSE 'PASS' END"
_LATEST = """l AS (SELECT service, arg_max(scan_id, (started_at, seq)) AS scan_id FROM fx_scans
  WHERE status = 'COMPLETED' AND started_at IS NOT NULL AND service IS NOT NULL GROUP BY service)"""


@query("agg_1", f"WITH {_F}, v AS (SELECT scan_id, {_VERDICT} FROM f GROUP BY scan_id) SELECT *, {_CASE.format(0, 0, 0)} AS verdict FROM v")
def agg_1(ctx):
    return pf.release_verdict(ctx.fx("findings"))


@query("agg_1_caps", f"WITH {_F}, v AS (SELECT scan_id, {_VERDICT} FROM f GROUP BY scan_id) SELECT scan_id, {_CASE.format(1, 1, 2)} AS verdict FROM v")
def agg_1_caps(ctx):
    return pf.release_verdict(ctx.fx("findings"), max_blocker=1, max_critical=1, max_breaking=2).select("scan_id", "verdict")


@query(
    "agg_2",
    """SELECT scan_id, 'engine' AS kind, severity AS sev, count(*) AS n FROM fx_findings GROUP BY scan_id, severity
    UNION ALL SELECT scan_id, 'effective', upper(coalesce(user_severity, severity, 'INFO')) AS s, count(*) FROM fx_findings GROUP BY scan_id, s""",
)
def agg_2(ctx):
    return pf.by_severity(ctx.fx("findings"))


_EXEC = f"""WITH {_LATEST}, {_F}, v AS (SELECT scan_id, {_VERDICT} FROM f WHERE status IS NULL OR status NOT IN
  ('REJECTED','FALSE_POSITIVE','WONT_FIX') GROUP BY scan_id),
e AS (SELECT service, scan_id, coalesce(blocker, 0) AS blocker, coalesce(critical, 0) AS critical, coalesce(breaking, 0) AS breaking,
      coalesce(major, 0) AS major, coalesce(minor, 0) AS minor, coalesce(unspecified, 0) AS unspecified FROM l LEFT JOIN v USING (scan_id))"""


@query("agg_3", f"{_EXEC} SELECT service, scan_id, breaking, blocker + critical AS blocking, {_CASE.format(0, 0, 0)} AS verdict FROM e")
def agg_3(ctx):
    return pf.executive(ctx.fx("scans"), ctx.fx("findings")).select("service", "scan_id", "breaking", "blocking", "verdict")


@query("agg_4", f"""SELECT count(DISTINCT finding_id) AS caught FROM fx_findings WHERE type IN {duck.BREAKING}
   AND (status IS NULL OR status NOT IN ('REJECTED','FALSE_POSITIVE'))""")  # fmt: skip
def agg_4(ctx):
    return pf.caught(ctx.fx("findings"))


_DISP = """count(*) FILTER (WHERE reviewed_at IS NOT NULL) AS reviewed, count(*) FILTER (WHERE status = 'ACCEPTED') AS accepted,
  count(*) FILTER (WHERE status IN ('REJECTED','FALSE_POSITIVE')) AS rejected, count(*) FILTER (WHERE status = 'JIRA_CREATED') AS filed,
  count(*) FILTER (WHERE coalesce(status, 'OPEN') = 'OPEN') AS open, count(*) FILTER (WHERE ai_disputed) AS disputed"""


@query("agg_5", f"SELECT {_DISP} FROM fx_findings")
def agg_5(ctx):
    return pf.dispositions(ctx.fx("findings"))


@query("agg_6", f"""WITH d AS (SELECT scan_id, {_DISP} FROM fx_findings GROUP BY scan_id)
  SELECT scan_id, accepted + rejected + filed AS decided,
         CAST(floor((accepted + filed) / nullif(accepted + rejected + filed, 0) * 100 + 0.5) AS BIGINT) AS kept_pct FROM d""")  # fmt: skip
def agg_6(ctx):
    return pf.kept_rate(pf.dispositions(ctx.fx("findings"), ["scan_id"])).select("scan_id", "decided", "kept_pct")


@fixture
def assets(d) -> str:
    return f"""
    SELECT n_name AS service, 'strategies' AS kind FROM {d.t("supplier")} JOIN {d.t("nation")} ON s_nationkey = n_nationkey
    UNION ALL SELECT n_name, 'conditions' FROM {d.t("customer")} JOIN {d.t("nation")} ON c_nationkey = n_nationkey
    UNION ALL SELECT CASE WHEN p_partkey % 30 = 26 THEN ' ' WHEN p_partkey % 30 > 26 THEN NULL ELSE concat('NATION_', p_partkey % 30) END, 'cases' FROM {d.t("part")}
    UNION ALL SELECT concat('NATION_', doc_id % 24), 'plans' FROM {d.t("documents")}"""


@query(
    "agg_7",
    """WITH a AS (SELECT service, kind FROM fx_assets UNION ALL SELECT service, 'scans' FROM fx_scans UNION ALL SELECT service, 'codegen' FROM fx_runs)
    SELECT service, count(*) FILTER (WHERE kind = 'strategies') AS strategies, count(*) FILTER (WHERE kind = 'conditions') AS conditions,
      count(*) FILTER (WHERE kind = 'cases') AS cases, count(*) FILTER (WHERE kind = 'plans') AS plans,
      count(*) FILTER (WHERE kind = 'scans') AS scans, count(*) FILTER (WHERE kind = 'codegen') AS codegen
    FROM a WHERE trim(service) <> '' GROUP BY service""",
)
def agg_7(ctx):
    a = ctx.fx("assets")
    tables = {k: a.filter(c("kind") == k).drop("kind") for k in ("strategies", "conditions", "cases", "plans")}
    return pf.catalog({**tables, "scans": ctx.fx("scans"), "codegen": ctx.fx("runs")})


@query(
    "agg_8",
    """SELECT CASE WHEN grouping(s) = 1 THEN NULL ELSE s END AS skill, CAST(grouping(s) AS INTEGER) AS is_total, sum(coalesce(est_cost, 0)) AS cost,
       count(*) AS actions FROM (SELECT coalesce(skill, 'unknown') AS s, est_cost FROM fx_ledger) GROUP BY ROLLUP (s)""",
)
def agg_8(ctx):
    return pf.cost_summary(ctx.fx("ledger"))


@query(
    "agg_9",
    """WITH cal AS (SELECT CAST(DATE '2024-01-31' - CAST(i AS INTEGER) AS DATE) AS day FROM range(0, 40) t(i)),
    s AS (SELECT CAST(created_at AS DATE) AS day, sum(coalesce(est_cost, 0)) AS t, count(*) AS n FROM fx_ledger GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, floor(coalesce(t, 0) * 10000 + 0.5) / 10000 AS total, coalesce(n, 0) AS actions FROM cal LEFT JOIN s USING (day)""",
)
def agg_9(ctx):
    return pf.cost_trend(ctx.fx("ledger"), "2024-01-31", 40).withColumn("day", c("day").cast("string"))


@query(
    "agg_10",
    """WITH cal AS (SELECT CAST(DATE '2001-08-01' - CAST(i AS INTEGER) AS DATE) AS day FROM range(0, 9999) t(i)),
    s AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS n, CAST(sum(total_findings) AS BIGINT) AS f FROM fx_scans GROUP BY 1)
    SELECT CAST(day AS VARCHAR) AS day, coalesce(n, 0) AS scans, coalesce(f, 0) AS findings FROM cal LEFT JOIN s USING (day)""",
)
def agg_10(ctx):
    return pf.scan_trend(ctx.fx("scans"), TODAY, 9999).withColumn("day", c("day").cast("string"))


@query(
    "agg_11",
    """WITH r AS (SELECT coalesce(nullif(trim(severity), ''), 'UNKNOWN') AS s, coalesce(nullif(trim(status_category), ''), 'unsynced') AS k,
          coalesce(nullif(trim(service), ''), 'unknown') AS v, lower(coalesce(status_category, '')) = 'done' AS done FROM fx_defects),
    g AS (SELECT 'severity' AS dim, s AS value, done FROM r UNION ALL SELECT 'category', k, done FROM r UNION ALL SELECT 'service', v, done FROM r
          UNION ALL SELECT 'all', 'all', done FROM r)
    SELECT dim, value, count(*) AS total, count(*) FILTER (WHERE NOT done) AS open, count(*) FILTER (WHERE done) AS closed FROM g GROUP BY dim, value""",
)
def agg_11(ctx):
    return pf.defect_metrics(ctx.fx("defects"))


@query("agg_12", """SELECT count(*) AS over_seven_days FROM fx_defects WHERE lower(coalesce(status_category, '')) <> 'done'
   AND created_at < TIMESTAMP '2001-07-25 00:00:00'""")  # fmt: skip
def agg_12(ctx):
    return pf.aging(ctx.fx("defects"), now())


_DEDUP = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY finding_id ORDER BY created_at DESC, row_id) AS rn FROM {0}) WHERE rn = 1)"""
_DIS = """d AS (SELECT f.*, s.service FROM fx_findings f JOIN fx_scans s USING (scan_id) WHERE ai_disputed
   AND (f.status IS NULL OR f.status NOT IN ('REJECTED','FALSE_POSITIVE')))"""


@query(
    "agg_13",
    f"""WITH {_DIS}, u AS {_DEDUP.format("d")},
    e AS (SELECT type, row_id, row_number() OVER (PARTITION BY type ORDER BY created_at DESC, row_id) AS r FROM u),
    x AS (SELECT type, string_agg(row_id, ',' ORDER BY r) AS examples FROM e WHERE r <= 5 GROUP BY type),
    k AS (SELECT type, dispute_verdict AS v, count(*) AS n FROM u WHERE trim(dispute_verdict) <> '' GROUP BY ALL),
    m AS (SELECT type, string_agg(v || '=' || n, ',' ORDER BY v) AS verdicts FROM k GROUP BY type),
    b AS (SELECT type, count(*) AS n, count(DISTINCT nullif(trim(service), '')) AS services FROM u GROUP BY type)
    SELECT type, n, services, verdicts, examples FROM b LEFT JOIN m USING (type) LEFT JOIN x USING (type)""",
)
def agg_13(ctx):
    out = pf.dispute_clusters(pf.disputes(ctx.fx("findings"), ctx.fx("scans")))
    pairs = F.transform(F.map_entries("verdicts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select(
        "type", "n", "services", F.array_join(pairs, ",").alias("verdicts"), F.array_join("examples", ",").alias("examples")
    )


_VOTES = """v AS (SELECT f.*, s.service FROM fx_findings f JOIN fx_scans s USING (scan_id) WHERE severity = 'UNSPECIFIED'
   AND user_severity IS NOT NULL AND service IS NOT NULL AND service <> '' AND (f.status IS NULL OR f.status NOT IN ('REJECTED','FALSE_POSITIVE')))"""


@query(
    "agg_14",
    f"""WITH {_VOTES}, u AS {_DEDUP.format("v")}, w AS (SELECT *, {RANK('user_severity')} AS rk FROM u WHERE {RANK('user_severity')} IS NOT NULL),
    k AS (SELECT type, user_severity, rk, count(*) AS n FROM w GROUP BY ALL),
    t AS (SELECT type, CAST(sum(n) AS BIGINT) AS votes, arg_max(user_severity, (n, -rk)) AS consensus FROM k GROUP BY type),
    s AS (SELECT type, count(DISTINCT service) AS services FROM w GROUP BY type)
    SELECT type, votes, consensus, services FROM t JOIN s USING (type) WHERE votes >= 3 AND services >= 2""",
)
def agg_14(ctx):
    return pf.proposals(pf.votes(ctx.fx("findings"), ctx.fx("scans")))


@query(
    "agg_15",
    """SELECT count(DISTINCT finding_id) FILTER (WHERE severity = 'UNSPECIFIED') AS unspecified,
       count(DISTINCT finding_id) FILTER (WHERE ai_disputed) AS disputed FROM fx_findings WHERE status IS NULL OR status NOT IN ('REJECTED','FALSE_POSITIVE')""",
)
def agg_15(ctx):
    return pf.debt(ctx.fx("findings"))


_OUT = """o AS (SELECT *, CASE WHEN status ILIKE '%pass%' THEN 'PASSED' WHEN status ILIKE '%fail%' THEN 'FAILED'
   WHEN status ILIKE '%block%' OR status ILIKE '%abort%' THEN 'BLOCKED' ELSE 'NOT_RUN' END AS outcome FROM fx_runs)"""


@query(
    "agg_16",
    f"""WITH {_OUT}, g AS (SELECT service, count(*) AS total, count(*) FILTER (WHERE outcome = 'PASSED') AS passed,
      count(*) FILTER (WHERE outcome = 'FAILED') AS failed, count(*) FILTER (WHERE outcome = 'BLOCKED') AS blocked,
      count(*) FILTER (WHERE outcome = 'NOT_RUN') AS not_run FROM o GROUP BY service)
    SELECT *, format('{{}} designed · {{}} passed · {{}} failed · {{}} blocked · {{}} not run', total, passed, failed, blocked, not_run) ||
      CASE WHEN failed > 0 OR blocked > 0 THEN ' — NEEDS ATTENTION (failures/blocks must be explained or fixed before release).'
           WHEN not_run > 0 THEN ' — INCOMPLETE (not every test has been executed).' ELSE ' — ALL PASSED.' END AS verdict FROM g""",
)
def agg_16(ctx):
    return pf.completion(ctx.fx("runs"))


@query("agg_16_deviations", f"WITH {_OUT} SELECT service, test_key, status, outcome FROM o WHERE outcome IN ('FAILED', 'BLOCKED')")
def agg_16_deviations(ctx):
    return pf.deviations(ctx.fx("runs")).select("service", "test_key", "status", "outcome")


@query(
    "agg_19",
    """SELECT floor(median(d) * 10 + 0.5) / 10 AS mttr_days FROM (SELECT (epoch_us(finished_at) - epoch_us(created_at)) / 86400e6 AS d
       FROM fx_trains WHERE status = 'DONE') WHERE d > 0""",
)
def agg_19(ctx):
    return pf.mttr(ctx.fx("trains"))


@query(
    "agg_20",
    """WITH d AS (SELECT * FROM fx_scans WHERE upper(status) = 'COMPLETED')
    SELECT 'median_minutes' AS measure, (SELECT median(m) FROM (SELECT (epoch_us(finished_at) - epoch_us(started_at)) / 60e6 AS m FROM d) WHERE m > 0) AS value
    UNION ALL SELECT 'cost_per_audit', sum(est_cost) / count(*) FROM d UNION ALL SELECT 'hours_avoided', CAST(count(*) * 4 AS DOUBLE) FROM d""",
)
def agg_20(ctx):
    return pf.value_strip(ctx.fx("scans"))


@query(
    "agg_21",
    f"""{_EXEC}, x AS (SELECT breaking, {_CASE.format(0, 0, 0)} AS verdict FROM e)
    SELECT count(*) FILTER (WHERE verdict = 'PASS') AS pass, count(*) FILTER (WHERE verdict = 'WARN') AS warn,
           count(*) FILTER (WHERE verdict = 'FAIL') AS fail, CAST(sum(breaking) AS BIGINT) AS breaking FROM x""",
)
def agg_21(ctx):
    e = pf.executive(ctx.fx("scans"), ctx.fx("findings"))
    tone = [F.count_if(c("verdict") == v).alias(v.lower()) for v in ("PASS", "WARN", "FAIL")]
    return e.agg(*tone, F.sum("breaking").alias("breaking"))


@fixture
def collapsed(d) -> str:
    return f"""
    SELECT row_id, type, origin, confidence, summary, endpoint,
           CASE WHEN pos % 4 = 0 THEN {d.array("endpoint", "concat(endpoint, '/x')", "concat('GET /', finding_id)")}
                WHEN pos % 4 = 1 THEN {d.array("'GET /single'")} END AS affected_endpoints FROM fx_findings"""


@query(
    "agg_31",
    r"""WITH a AS (SELECT TRY_CAST(nullif(regexp_extract(summary, '\b([3-5][0-9][0-9])\b', 1), '') AS INTEGER) AS status,
        CASE WHEN len(affected_endpoints) > 1 THEN affected_endpoints ELSE [endpoint] END AS eps FROM fx_collapsed
        WHERE type = 'STATUS_CODE_MISSING' AND upper(origin) = 'DETERMINISTIC' AND confidence = 'LOW'),
    e AS (SELECT status, unnest(eps) AS ep FROM a WHERE status IS NOT NULL)
    SELECT status, count(DISTINCT ep) AS endpoints FROM e GROUP BY status""",
)
def agg_31(ctx):
    return pf.error_contract(ctx.fx("collapsed"))


@query(
    "agg_32",
    f"""WITH {_F}, n AS (SELECT scan_id, eff AS severity, {RANK('eff')} AS rk, count(*) AS n FROM f WHERE NOT att AND {RANK('eff')} IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, sum(n) OVER (PARTITION BY scan_id) AS t, sum(n) OVER (PARTITION BY scan_id ORDER BY rk) AS cum FROM n)
    SELECT scan_id, severity, n, 100.0::DOUBLE * n / t AS pct, 100.0::DOUBLE * (cum - n) / t AS start_pct, 100.0::DOUBLE * cum / t AS end_pct FROM w""",
)
def agg_32(ctx):
    return pf.severity_distribution(ctx.fx("findings"))


@query(
    "agg_33",
    f"""WITH {_F}, b AS (SELECT scan_id, {_VERDICT},
      count(*) FILTER (WHERE NOT att AND type LIKE '%MISSING%') AS m,
      count(*) FILTER (WHERE NOT att AND type NOT LIKE '%MISSING%' AND type NOT LIKE '%EXTRA%') AS w,
      count(*) FILTER (WHERE NOT att AND type NOT LIKE '%MISSING%' AND type LIKE '%EXTRA%') AS x FROM f GROUP BY scan_id),
    t AS (SELECT *, concat_ws(', ', CASE WHEN m > 0 THEN 'document ' || m END,
      CASE WHEN w > 0 THEN 'correct ' || w || CASE WHEN w = 1 THEN ' mismatch' ELSE ' mismatches' END END,
      CASE WHEN x > 0 THEN 'remove ' || x || CASE WHEN x = 1 THEN ' stale entry' ELSE ' stale entries' END END) AS todo FROM b)
    SELECT scan_id, counted, {_CASE.format(0, 0, 0)} AS verdict, CASE WHEN counted <= 3 THEN 'small' WHEN counted <= 8 THEN 'moderate' ELSE 'large' END AS effort,
      CASE WHEN counted = 0 THEN 'No action needed — the documentation matches the code.' ELSE upper(todo[1]) || todo[2:] || '.' ||
        CASE WHEN breaking > 1 THEN ' ' || breaking || ' of these are consumer-breaking — fix those first.'
             WHEN breaking = 1 THEN ' 1 of these is consumer-breaking — fix it first.' ELSE '' END END AS action FROM t""",
)
def agg_33(ctx):
    return pf.bottom_line(ctx.fx("findings")).select("scan_id", "counted", "verdict", "effort", "action")


@query(
    "agg_34",
    """SELECT 'scans_total' AS gauge, (SELECT count(*) FROM fx_scans) AS n UNION ALL SELECT 'cost_entries_total', (SELECT count(*) FROM fx_ledger)
    UNION ALL SELECT 'trains_total', (SELECT count(*) FROM fx_trains) UNION ALL SELECT 'trains_failed', (SELECT count(*) FROM fx_trains WHERE status = 'FAILED')
    UNION ALL SELECT 'trains_inflight', (SELECT count(*) FROM fx_trains WHERE status NOT IN ('DONE','FAILED','CANCELLED','ALREADY_FIXED','MERGED'))
    UNION ALL SELECT 'alerts_unseen', (SELECT count(*) FROM fx_alerts WHERE NOT seen)""",
)
def agg_34(ctx):
    return pf.gauges(ctx.fx("scans"), ctx.fx("ledger"), ctx.fx("trains"), ctx.fx("alerts"))


@fixture
def selections(d) -> str:
    return f"""
    SELECT concat('app-', s_suppkey % 13) AS app, concat('org.x:lib-', p_partkey) AS coordinate, concat('1.', p_size) AS old_version,
           concat('1.', p_size + 1, '.', p_partkey % 5) AS fixed_in,
           {pick("p_partkey % 6", ["critical", "High", "MEDIUM", "low", "odd", "high"])} AS severity
    FROM {d.t("part")} JOIN {d.t("supplier")} ON p_partkey % 100 = s_suppkey"""


@query(
    "agg_35",
    """WITH g AS (SELECT CASE WHEN grouping(app) = 1 THEN NULL ELSE app END AS app, CAST(grouping(app) AS INTEGER) AS is_total, count(*) AS u, count(DISTINCT app) AS apps,
      count(*) FILTER (WHERE upper(severity) = 'CRITICAL') AS cr, count(*) FILTER (WHERE upper(severity) = 'HIGH') AS hi,
      count(*) FILTER (WHERE upper(severity) = 'MEDIUM') AS me, count(*) FILTER (WHERE upper(severity) = 'LOW') AS lo FROM fx_selections GROUP BY ROLLUP (app)),
    t AS (SELECT *, concat_ws(', ', CASE WHEN cr > 0 THEN cr || ' critical' END, CASE WHEN hi > 0 THEN hi || ' high' END,
      CASE WHEN me > 0 THEN me || ' medium' END, CASE WHEN lo > 0 THEN lo || ' low' END) AS b FROM g)
    SELECT app, is_total, u AS upgrades, CASE WHEN is_total = 1 THEN 'Scope: ' || apps || ' application' || CASE WHEN apps = 1 THEN '' ELSE 's' END || ', ' || u ||
      ' dependency upgrade' || CASE WHEN u = 1 THEN '' ELSE 's' END || CASE WHEN b = '' THEN '' ELSE ' (' || b || ')' END || '.'
      ELSE app || ' (' || u || ' upgrade' || CASE WHEN u = 1 THEN '' ELSE 's' END || ')' END AS text FROM t""",
)
def agg_35(ctx):
    return pf.fix_story(ctx.fx("selections")).select("app", "is_total", "upgrades", "text")


@query("agg_35_lines", "SELECT app, coordinate || ' ' || old_version || '->' || fixed_in || ' [' || lower(severity) || ']' AS line FROM fx_selections")
def agg_35_lines(ctx):
    return pf.fix_story_lines(ctx.fx("selections"))


@query(
    "agg_36",
    """WITH l AS (SELECT service, arg_max(coalesce(coverage_gaps, 0), (coalesce(started_at, TIMESTAMP '0001-01-01'), seq)) AS gaps FROM fx_scans
       WHERE upper(status) = 'COMPLETED' AND release_safe IS NOT NULL AND service IS NOT NULL GROUP BY service)
    SELECT 'services' AS measure, CAST(count(DISTINCT service) AS DOUBLE) AS value FROM fx_scans
    UNION ALL SELECT 'open_defects', CAST(count(*) AS DOUBLE) FROM fx_defects WHERE lower(coalesce(status_category, '')) <> 'done'
    UNION ALL SELECT 'spend', sum(est_cost) FROM fx_ledger UNION ALL SELECT 'coverage_gaps', CAST(sum(gaps) AS DOUBLE) FROM l""",
)
def agg_36(ctx):
    return pf.headline(ctx.fx("scans"), ctx.fx("defects"), ctx.fx("ledger"))


@fixture
def batches(d) -> str:
    return f"""
    SELECT conv_id AS batch, CAST(conv_id % 17 AS DOUBLE) / 4 AS cost FROM {d.t("conversations")} WHERE turn = 0
    UNION ALL SELECT 1000000000 + item_id, 1.5 FROM {d.t("benchmark")}"""


@query(
    "agg_38",
    """SELECT batch, count(conv_id) AS items, cost / greatest(count(conv_id), 1) AS unit_cost FROM fx_batches LEFT JOIN conversations ON conv_id = batch
       GROUP BY batch, cost""",
)
def agg_38(ctx):
    return pf.unit_cost(ctx.fx("batches"), ctx.table("conversations").select(c("conv_id").alias("batch")))


_BUCKET = """CASE WHEN status IN ('DONE','PR_OPEN') THEN 'fixed' WHEN status IN ('AWAITING_CONFIRM','AWAITING_MANUAL_FIX') THEN 'waiting'
   WHEN status = 'FAILED' THEN 'failed' WHEN status = 'ALREADY_FIXED' THEN 'already_safe'
   WHEN status IN ('PLANNING','CHECKING','VERIFYING','OPENING_PRS') THEN 'building' ELSE 'cancelled' END"""


@query(
    "agg_39",
    f"""WITH b AS (SELECT story, app, {_BUCKET} AS b FROM fx_trains)
    SELECT story, app, {", ".join(f"count(*) FILTER (WHERE b = '{x}') AS {x}" for x in pf.TRAIN_BUCKETS)} FROM b GROUP BY story, app""",
)
def agg_39(ctx):
    return pf.batch_rollup(ctx.fx("trains"))


@fixture
def steps(d) -> str:
    return f"""
    SELECT CAST(l_orderkey AS STRING) AS train_id, l_linenumber % 5 = 0 AS manual,
           {pick("l_partkey % 5", ["PR_OPEN", "MERGED", "FAILED", "PR_OPEN", "PLANNED"])} AS status FROM {d.t("lineitem")}"""


@query(
    "agg_40",
    """SELECT train_id, coalesce(bool_and(status IN ('PR_OPEN','MERGED')) FILTER (WHERE NOT manual AND status <> 'FAILED'), false) AS open
       FROM fx_steps GROUP BY train_id""",
)
def agg_40(ctx):
    return pf.train_open(ctx.fx("steps"))


_ITEMS = """i AS (SELECT scan_id AS item_id, 'SCAN' AS kind, CASE WHEN status = 'RUNNING' THEN CASE WHEN stage = 'QUEUED' THEN 'QUEUED' ELSE 'RUNNING' END ELSE status END AS state,
     started_at, finished_at, status = 'FAILED' AS attention FROM fx_scans
   UNION ALL SELECT train_id, 'FIX_TRAIN', CASE WHEN status = 'DONE' THEN 'COMPLETED' WHEN status = 'FAILED' THEN 'FAILED'
     WHEN status IN ('AWAITING_CONFIRM','AWAITING_MANUAL_FIX','PR_OPEN') THEN 'WAITING_FOR_YOU' ELSE 'RUNNING' END,
     created_at, finished_at, status IN ('FAILED', 'AWAITING_CONFIRM', 'AWAITING_MANUAL_FIX') FROM fx_trains
   UNION ALL SELECT run_id, 'CODEGEN', CASE WHEN build_status = 'FAIL' THEN 'FAILED' ELSE 'COMPLETED' END, created_at, created_at, coalesce(build_status = 'FAIL', false) FROM fx_codegen_runs),
 k AS (SELECT i.*, state IN ('COMPLETED','FAILED') AS terminal, a.item_id IS NOT NULL AS acked FROM i LEFT JOIN (SELECT DISTINCT item_id FROM fx_acks WHERE trim(item_id) <> '') a USING (item_id)
   WHERE NOT (state IN ('COMPLETED','FAILED') AND (finished_at IS NULL OR finished_at < TIMESTAMP '2001-07-25 00:00:00')))"""


def _items(ctx):
    return pf.activity_items(ctx.fx("scans"), ctx.fx("trains"), ctx.fx("codegen_runs"), ctx.fx("acks"), now())


@query(
    "agg_41",
    f"""WITH {_ITEMS} SELECT (SELECT count(*) FROM k WHERE attention AND NOT acked) + (SELECT count(*) FROM fx_alerts WHERE NOT seen) AS n,
       (SELECT bool_or(lower(severity) = 'critical') FROM fx_alerts WHERE NOT seen) AS critical""",
)
def agg_41(ctx):
    return pf.bell(_items(ctx), ctx.fx("alerts"))


# --- order-based ------------------------------------------------------------------------------------


@query("win_1", f"WITH {_LATEST} SELECT service, scan_id FROM l")
def win_1(ctx):
    return pf.latest_completed(ctx.fx("scans")).select("service", "scan_id")


@query(
    "win_2",
    """WITH f AS (SELECT *, CASE WHEN pos % 7 = 0 THEN NULL ELSE finding_id END AS fp FROM fx_findings)
    SELECT row_id, fp FROM (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY created_at DESC, row_id) AS rn FROM f) WHERE rn = 1 OR fp IS NULL""",
)
def win_2(ctx):
    f = ctx.fx("findings").withColumn("fp", F.when(c("pos") % 7 != 0, c("finding_id")))
    return win.dedup_first(f, "fp", "row_id", [F.desc("created_at"), F.asc("row_id")]).select("row_id", "fp")


@query(
    "win_6",
    """WITH cal AS (SELECT CAST(DATE '2024-01-31' - CAST(i AS INTEGER) AS DATE) AS day FROM range(0, 40) t(i)),
    s AS (SELECT CAST(created_at AS DATE) AS day, sum(coalesce(est_cost, 0)) AS t FROM fx_ledger GROUP BY 1),
    z AS (SELECT day, floor(coalesce(t, 0) * 10000 + 0.5) / 10000 AS v FROM cal LEFT JOIN s USING (day)),
    w AS (SELECT day, count(*) OVER (ORDER BY day) AS n, sum(v) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS a,
          sum(v) OVER (ORDER BY day ROWS BETWEEN 13 PRECEDING AND 7 PRECEDING) AS b FROM z)
    SELECT CAST(day AS VARCHAR) AS day, CASE WHEN n >= 14 AND NOT (a = 0 AND b = 0) THEN floor((a - b) * 100 + 0.5) / 100 END AS delta FROM w""",
)
def win_6(ctx):
    out = pf.weekly_delta(pf.cost_trend(ctx.fx("ledger"), "2024-01-31", 40), "total")
    return out.withColumn("day", c("day").cast("string"))


@query(
    "win_7",
    """SELECT train_id, story, row_number() OVER w AS version, lag(train_id) OVER w AS previous FROM fx_trains WINDOW w AS (PARTITION BY story ORDER BY created_at, seq)""",
)
def win_7(ctx):
    t = ctx.fx("trains").select("train_id", "story", "created_at", "seq")
    v = win.numbered(t, "story", ["created_at", "seq"], F.date_trunc("year", "created_at"), "version")
    prev = win.with_previous(v, "story", ["created_at", "seq"], F.date_trunc("year", "created_at"), ["train_id"])
    return prev.select("train_id", "story", "version", c("prev_train_id").alias("previous"))


@query(
    "win_8",
    """SELECT story, train_id, status FROM (SELECT *, row_number() OVER (PARTITION BY story ORDER BY CASE WHEN status = 'MERGED' THEN 0 ELSE 1 END,
       created_at DESC, seq DESC) AS rn FROM fx_trains) WHERE rn = 1""",
)
def win_8(ctx):
    approved = F.when(F.upper("status") == "MERGED", 0).otherwise(1)
    return win.first_k(ctx.fx("trains"), ["story"], [approved.asc(), F.desc("created_at"), F.desc("seq")]).select(
        "story", "train_id", "status"
    )


@fixture
def status_log(d) -> str:
    return f"""
    SELECT concat('case-', user_id) AS case_id, event_id, ts,
           {pick("event_id % 8", ["PROPOSED", "approved", "REJECTED", "CREATED_IN_XRAY", "ATTACHED", "IMPLEMENTED", None, "Approved"])} AS status
    FROM {d.t("events")}"""


_PAIRS = """p(a, b) AS (VALUES ('PROPOSED','APPROVED'),('PROPOSED','REJECTED'),('APPROVED','REJECTED'),('APPROVED','CREATED_IN_XRAY'),('APPROVED','ATTACHED'),
  ('APPROVED','IMPLEMENTED'),('REJECTED','PROPOSED'),('REJECTED','APPROVED'),('CREATED_IN_XRAY','ATTACHED'),('CREATED_IN_XRAY','IMPLEMENTED'),('ATTACHED','IMPLEMENTED'))"""


@query(
    "win_9",
    f"""WITH {_PAIRS}, s AS (SELECT case_id, event_id, upper(coalesce(status, 'PROPOSED')) AS b,
        coalesce(lag(upper(coalesce(status, 'PROPOSED'))) OVER (PARTITION BY case_id ORDER BY ts, event_id), 'PROPOSED') AS a FROM fx_status_log)
    SELECT case_id, event_id, a AS from_status, b AS to_status FROM s WHERE a <> b AND NOT EXISTS (SELECT 1 FROM p WHERE p.a = s.a AND p.b = s.b)""",
)
def win_9(ctx):
    from concordat.operators.workitems import illegal_transitions

    return illegal_transitions(ctx.fx("status_log"))


@fixture
def models(d) -> str:
    return f"""
    SELECT p_name AS model, p_brand AS tier, p_partkey AS pos, p_partkey % 5 > 0 AS enabled, CAST(p_partkey % 7 AS DOUBLE) AS cost FROM {d.t("part")}"""


@fixture
def policy(d) -> str:
    return f"""
    SELECT p_brand AS tier, p_name AS model, p_partkey AS pos FROM {d.t("part")}
    UNION ALL SELECT concat('extra-', n_nationkey) AS tier, CASE WHEN n_nationkey % 2 = 0 THEN 'small ring' ELSE 'ghost' END, 0 FROM {d.t("nation")}"""


@query(
    "win_11",
    """WITH pr AS (SELECT tier, arg_min(model, pos) AS primary_ FROM fx_policy GROUP BY tier),
    m AS (SELECT m.*, min(CASE WHEN pr.primary_ IS NULL THEN 1 ELSE 0 END) AS np FROM fx_models m LEFT JOIN pr ON pr.tier = m.tier AND pr.primary_ = m.model
          WHERE enabled GROUP BY ALL),
    b AS (SELECT tier, arg_min(model, (cost, np, pos)) AS best FROM m GROUP BY tier),
    fb AS (SELECT tier, arg_min(model, (pos, model)) AS fb FROM fx_policy WHERE model IN (SELECT model FROM fx_models WHERE enabled) GROUP BY tier),
    t AS (SELECT tier FROM fx_policy UNION SELECT tier FROM fx_models)
    SELECT tier, coalesce(best, fb, 'default') AS model FROM t LEFT JOIN b USING (tier) LEFT JOIN fb USING (tier)""",
)
def win_11(ctx):
    return pf.cheapest(ctx.fx("models"), ctx.fx("policy"), "default")


@fixture
def commits(d) -> str:
    return f"""
    SELECT concat('src/F', l_partkey % 300, '.java') AS file, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS committed_at,
           CASE l_suppkey % 6 WHEN 0 THEN concat('dev', l_suppkey, '@example.org') WHEN 1 THEN 'ci-bot@example.org' WHEN 2 THEN NULL
                ELSE concat('dev', l_suppkey % 20, '@x.org') END AS email,
           CASE l_suppkey % 4 WHEN 0 THEN 'Two Words' WHEN 1 THEN '' ELSE concat(' nick', l_suppkey % 9) END AS name,
           concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS commit_id FROM {d.t("lineitem")}"""


@query(
    "win_12",
    """WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY committed_at DESC, seq DESC, commit_id) AS rn FROM fx_commits) WHERE rn <= 40),
    u AS (SELECT file, rn, CASE WHEN lower(email) LIKE '%ci-bot%' THEN NULL WHEN contains(email, '@') THEN split_part(email, '@', 1)
          WHEN name IS NULL OR trim(name) = '' OR contains(trim(name), ' ') THEN NULL ELSE trim(name) END AS usr FROM r),
    d AS (SELECT file, usr, min(rn) AS rn FROM u WHERE usr IS NOT NULL GROUP BY ALL),
    k AS (SELECT file, usr, row_number() OVER (PARTITION BY file ORDER BY rn) AS place FROM d)
    SELECT f.file, coalesce(usr, 'default-reviewer') AS reviewer, coalesce(place, 1) AS place FROM (SELECT DISTINCT file FROM fx_commits) f
    LEFT JOIN (SELECT * FROM k WHERE place <= 3) k USING (file)""",
)
def win_12(ctx):
    from concordat.operators.workitems import reviewers

    return reviewers(ctx.fx("commits"), 3, "ci-bot", "default-reviewer")


# --- sorts and top-k --------------------------------------------------------------------------------


@query("top_1", f"SELECT scan_id, row_id, severity, {RANK('severity')} AS rank FROM fx_findings")
def top_1(ctx):
    from concordat.operators.findings import order_findings

    return order_findings(ctx.fx("findings")).select("scan_id", "row_id", "severity", "rank")


@query(
    "top_2",
    f"""WITH {_ITEMS} SELECT item_id, kind, state, attention, acked, terminal FROM k ORDER BY terminal, started_at DESC NULLS LAST, kind, item_id LIMIT 50""",
)
def top_2(ctx):
    return pf.feed(_items(ctx)).select("item_id", "kind", "state", "attention", "acked", "terminal")


@query(
    "top_3",
    f"""WITH {_ITEMS}, s AS (SELECT *, CASE WHEN attention AND NOT acked THEN 'waiting' WHEN state IN ('QUEUED','RUNNING') THEN 'in_progress' ELSE 'history' END AS section,
       CAST(coalesce(finished_at, started_at) AS DATE) AS d FROM k)
    SELECT item_id, kind, section, CASE WHEN section = 'history' THEN CASE WHEN d IS NULL THEN 'earlier' WHEN d = DATE '2001-08-01' THEN 'today'
       WHEN d = DATE '2001-07-31' THEN 'yesterday' ELSE CAST(d AS VARCHAR) END END AS day_bucket FROM s""",
)
def top_3(ctx):
    return pf.activity_sections(_items(ctx), F.lit(TODAY).cast("date")).select("item_id", "kind", "section", "day_bucket")


@query(
    "top_5",
    f"""{_EXEC}, w AS (SELECT service, blocker + critical AS n FROM e WHERE blocker + critical > 0 ORDER BY n DESC, service LIMIT 1),
    r AS (SELECT scan_id, seq FROM fx_scans WHERE started_at IS NOT NULL ORDER BY started_at DESC, seq DESC LIMIT 8),
    k AS (SELECT coalesce(skill, 'unknown') AS s, sum(coalesce(est_cost, 0)) AS cost FROM fx_ledger GROUP BY 1)
    SELECT 'worst' AS part, service AS name, CAST(n AS DOUBLE) AS value FROM w UNION ALL SELECT 'recent', scan_id, CAST(seq AS DOUBLE) FROM r
    UNION ALL SELECT 'skill', s, cost FROM k""",
)
def top_5(ctx):
    e = pf.executive(ctx.fx("scans"), ctx.fx("findings")).filter(c("blocking") > 0)
    worst = e.orderBy(F.desc("blocking"), F.asc("service")).limit(1)
    recent = ctx.fx("scans").filter(c("started_at").isNotNull()).orderBy(F.desc("started_at"), F.desc("seq")).limit(8)
    skills = pf.cost_summary(ctx.fx("ledger")).filter(c("is_total") == 0).orderBy(F.desc("cost"))
    return (
        worst.select(F.lit("worst").alias("part"), c("service").alias("name"), c("blocking").cast("double").alias("value"))
        .unionByName(recent.select(F.lit("recent").alias("part"), c("scan_id").alias("name"), c("seq").cast("double").alias("value")))
        .unionByName(skills.select(F.lit("skill").alias("part"), c("skill").alias("name"), c("cost").alias("value")))
    )


@query(
    "top_6",
    f"""{_EXEC}, q AS (SELECT 'blocking' AS measure, CAST(sum(blocker + critical) AS BIGINT) AS n FROM e
      UNION ALL SELECT 'gates', count(*) FROM fx_gates WHERE status = 'PENDING' UNION ALL SELECT 'alerts', count(*) FROM fx_alerts WHERE NOT seen
      UNION ALL SELECT 'trains', count(*) FROM fx_trains WHERE status IN ('AWAITING_CONFIRM','AWAITING_MANUAL_FIX'))
    SELECT * FROM q WHERE n > 0""",
)
def top_6(ctx):
    e = pf.executive(ctx.fx("scans"), ctx.fx("findings"))
    return pf.decision_queue(e, ctx.fx("gates"), ctx.fx("alerts"), ctx.fx("trains"))


# --- joins over the same tables ----------------------------------------------------------------------


@query("jn_42", f"WITH {_VOTES}, {_DIS} SELECT 'vote' AS kind, row_id, type, service FROM v UNION ALL SELECT 'dispute', row_id, type, service FROM d")
def jn_42(ctx):
    v = pf.votes(ctx.fx("findings"), ctx.fx("scans")).select(F.lit("vote").alias("kind"), "row_id", "type", "service")
    d = pf.disputes(ctx.fx("findings"), ctx.fx("scans")).select(F.lit("dispute").alias("kind"), "row_id", "type", "service")
    return v.unionByName(d)


@query("jn_45", f"WITH {_ITEMS} SELECT item_id, kind, acked FROM k")
def jn_45(ctx):
    return _items(ctx).select("item_id", "kind", "acked")


@query("jn_45_append", "SELECT DISTINCT scan_id AS item_id FROM fx_scans WHERE scan_id NOT IN (SELECT item_id FROM fx_acks)")
def jn_45_append(ctx):
    return pf.new_acks(ctx.fx("scans").select(c("scan_id").alias("item_id")), ctx.fx("acks"))


_CATALOGUE = [("gpt-a", 3.0, 12.0, 1.0), ("gpt-b", 0.5, 2.0, 0.33), ("opus-x", 15.0, 75.0, 10.0), ("mini-c", 0.1, 0.4, 0.0)]
_LIVE = [("gpt-b", 0.25), ("unknown-z", 2.0)]
_CAT_SQL = "cat(model, ri, ro, mu) AS (VALUES " + ", ".join(str((m, str(a), str(b), str(x))) for m, a, b, x in _CATALOGUE) + ")"


def _catalogue(ctx):
    return (
        ctx.spark.createDataFrame(_CATALOGUE, "model string, rate_in double, rate_out double, multiplier double"),
        ctx.spark.createDataFrame(_LIVE, "model string, multiplier double"),
    )


@query(
    "jn_46",
    f"""WITH {_CAT_SQL} SELECT id, CASE WHEN cached THEN 0.0::DOUBLE ELSE floor((tokens_in / 1e6 * coalesce(ri::DOUBLE, 0) + tokens_out / 1e6 * coalesce(ro::DOUBLE, 0)) * 0.01::DOUBLE * 10000 + 0.5) / 10000 END AS cost
    FROM fx_ledger LEFT JOIN cat USING (model)""",
)
def jn_46(ctx):
    catalogue, live = _catalogue(ctx)
    return pf.price(ctx.fx("ledger"), catalogue, live).select("id", "cost")


@query(
    "jn_46_requests",
    f"""WITH {_CAT_SQL}, live(model, lv) AS (VALUES ('gpt-b', '0.25'), ('unknown-z', '2.0')),
    m AS (SELECT id, cached, greatest(1.0::DOUBLE, coalesce(lv::DOUBLE, mu::DOUBLE, 1.0)) AS r FROM fx_ledger LEFT JOIN cat USING (model) LEFT JOIN live USING (model))
    SELECT id, CASE WHEN cached THEN 0.0::DOUBLE ELSE r END AS requests, CASE WHEN cached THEN 0.0::DOUBLE ELSE floor(r * 0.04::DOUBLE * 10000 + 0.5) / 10000 END AS cost FROM m""",
)
def jn_46_requests(ctx):
    catalogue, live = _catalogue(ctx)
    return pf.price(ctx.fx("ledger"), catalogue, live, "PREMIUM_REQUESTS", cli_counts=True).select("id", "requests", "cost")


@query(
    "jn_48",
    f"""{_EXEC}, sv AS (SELECT service, count(*) AS scans FROM fx_scans WHERE trim(service) <> '' GROUP BY service),
    g AS (SELECT l.service, s.coverage_gaps AS cg FROM l JOIN fx_scans s USING (scan_id))
    SELECT sv.service, sv.scans, e.breaking, e.blocker + e.critical AS blocking,
      CASE WHEN e.service IS NOT NULL THEN {_CASE.format(0, 0, 0)} END AS verdict,
      CASE WHEN cg = 0 THEN 'full' WHEN cg IS NOT NULL THEN cg || ' gaps' END AS visibility FROM sv LEFT JOIN e ON e.service = sv.service LEFT JOIN g ON g.service = sv.service""",
)
def jn_48(ctx):
    scans = ctx.fx("scans")
    services = pf.catalog({"scans": scans})
    return pf.scorecard(services, pf.executive(scans, ctx.fx("findings")), pf.latest_completed(scans))
