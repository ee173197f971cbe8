"""Domain tables derived from the source tables by plain expressions both engines have.

No random values and no clock: the same text feeds the query and its twin.
"""

from __future__ import annotations

from concordat.plans.dialect import pick
from concordat.plans.registry import fixture
from concordat.taxonomy import FINDING_TYPES, SEVERITIES

VERB4 = ["GET", "POST", "PUT", "DELETE"]
TYPES = [t[0] for t in FINDING_TYPES]
TYPE_SEVERITIES = [t[2] for t in FINDING_TYPES]
TYPE_LAYERS = [t[1] for t in FINDING_TYPES]
STATUSES = [None, "OPEN", "TRIAGED", "ACCEPTED", "REJECTED", "FALSE_POSITIVE", "WONT_FIX", "JIRA_CREATED"]
NOW = "TIMESTAMP '2001-08-01 00:00:00'"
EVENTS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"


@fixture
def findings(d) -> str:
    return f"""
    SELECT CAST(l_orderkey AS STRING) AS scan_id,
           concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS row_id,
           concat(l_partkey, '-', l_returnflag) AS finding_id,
           l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey AS pos,
           {pick("l_partkey % 25", TYPES)} AS type,
           {pick("l_partkey % 25", TYPE_LAYERS)} AS layer,
           CASE WHEN l_partkey % 3 = 0 AND l_partkey % 25 > 5 THEN 'UNSPECIFIED'
                ELSE {pick("l_partkey % 25", TYPE_SEVERITIES)} END AS severity,
           {pick("l_linenumber % 3", ["HIGH", "MEDIUM", "LOW"])} AS confidence,
           CASE WHEN l_suppkey % 5 = 0 THEN 'LLM' WHEN l_suppkey % 17 = 0 THEN NULL
                WHEN l_suppkey % 3 = 0 THEN 'deterministic' ELSE 'DETERMINISTIC' END AS origin,
           {pick("l_suppkey % 8", STATUSES)} AS status,
           CASE WHEN l_suppkey % 8 >= 2 THEN {d.plus_days("l_shipdate", "1")} END AS reviewed_at,
           CASE WHEN l_suppkey % 8 >= 2 THEN concat('reviewer-', l_suppkey % 7) END AS reviewed_by,
           CASE WHEN l_suppkey % 23 = 0 THEN 'SEVERE'
                WHEN l_linenumber % 4 = 0 THEN {pick("l_suppkey % 6", SEVERITIES)} END AS user_severity,
           l_suppkey % 11 = 0 AS ai_disputed,
           CASE WHEN l_suppkey % 11 = 0 THEN concat('reason ', l_suppkey % 5) END AS ai_dispute_reason,
           CASE WHEN l_suppkey % 22 = 0 THEN {pick("l_linenumber % 3", ["UPHELD", "OVERTURNED", ""])} END
               AS dispute_verdict,
           CASE WHEN l_partkey % 19 = 0 THEN concat('Schema', l_partkey % 40)
                ELSE concat({pick("l_partkey % 4", VERB4)}, ' /p', l_partkey % 400) END AS endpoint,
           concat('spec-', l_suppkey % 3) AS spec_source,
           CASE WHEN l_partkey % 2 = 0 THEN concat('Schema', l_partkey % 40, '#f', l_partkey % 5) END AS spec_locus,
           concat('Code can return ', 400 + 1 * (l_partkey % 8), CASE WHEN l_linenumber % 2 = 0 THEN ' but  the spec'
                  ELSE ' but the spec' END, ' does not document it', CASE WHEN l_linenumber % 3 = 0 THEN '.' ELSE '' END)
               AS summary,
           CASE WHEN l_linenumber % 3 = 1 THEN concat('because ', l_returnflag) END AS explanation,
           CASE WHEN l_linenumber % 5 = 2 THEN concat('fix ', l_linestatus) END AS proposed_fix,
           CASE WHEN l_suppkey % 4 > 0 THEN concat('src/C', l_partkey % 50, '.java') END AS code_file,
           CASE WHEN l_suppkey % 6 > 0 THEN l_suppkey % 30 END AS code_line,
           l_shipdate AS created_at
    FROM {d.t("lineitem")}"""


@fixture
def scans(d) -> str:
    return f"""
    SELECT CAST(o_orderkey AS STRING) AS scan_id, o_orderkey AS seq,
           CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '' ELSE n_name END AS service,
           {pick("CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END", ["COMPLETED", "RUNNING", "FAILED"])}
               AS status,
           CASE WHEN o_orderkey % 6 = 0 THEN 'QUEUED' ELSE 'DIFF' END AS stage,
           CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_orderdate END AS started_at,
           CASE WHEN o_orderstatus <> 'O' THEN {d.plus_minutes("o_orderdate", "o_orderkey % 17")} END AS finished_at,
           CASE WHEN o_orderkey % 5 > 0 THEN {d.plus_minutes("o_orderdate", "o_orderkey % 90")} END AS updated_at,
           CAST(o_orderkey % 23 AS INTEGER) AS total_findings,
           floor(o_totalprice) / 100000 AS est_cost,
           CASE WHEN o_orderkey % 10 < 9 THEN CAST(o_orderkey % 4 AS INTEGER) END AS coverage_gaps,
           {pick("o_orderkey % 4", ["PASS", "WARN", "FAIL", None])} AS release_safe,
           o_orderpriority AS owner, c_custkey AS cust
    FROM {d.t("orders")}
    JOIN {d.t("customer")} ON o_custkey = c_custkey
    JOIN {d.t("nation")} ON c_nationkey = n_nationkey"""


@fixture
def defects(d) -> str:
    return f"""
    SELECT CAST(o_orderkey AS STRING) AS link_id, concat(o_orderkey % 2000, '-A') AS finding_id,
           CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE concat('KEY-', o_orderkey) END AS jira_key,
           {pick("o_orderkey % 7", ["BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO", "UNSPECIFIED", None])} AS severity,
           {pick("o_orderkey % 5", ["new", "indeterminate", "done", "Done", None])} AS status_category,
           {pick("o_orderkey % 3", ["To Do", "In Progress", "Closed"])} AS status_name,
           CASE WHEN o_orderkey % 41 = 0 THEN NULL WHEN o_orderkey % 43 = 0 THEN '' ELSE n_name END AS service,
           CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderdate END AS created_at,
           o_orderkey % 3 > 0 AS created
    FROM {d.t("orders")}
    JOIN {d.t("customer")} ON o_custkey = c_custkey
    JOIN {d.t("nation")} ON c_nationkey = n_nationkey"""


@fixture
def ledger(d) -> str:
    return f"""
    SELECT concat('e', event_id) AS id,
           {pick("event_id % 6", ["validate", "review", "plan", "fix", None, ""])} AS skill,
           {pick("event_id % 5", ["gpt-a", "gpt-b", "opus-x", "mini-c", "unknown-z"])} AS model,
           event_id % 9 = 0 AS cached,
           CAST(floor(value * 1000) AS BIGINT) AS tokens_in, CAST(floor(value * 210) AS BIGINT) AS tokens_out,
           CASE WHEN event_id % 37 = 0 THEN NULL ELSE floor(value * 100) / 10000 END AS est_cost,
           ts AS created_at
    FROM {d.t("events")}"""


@fixture
def vulns(d) -> str:
    return f"""
    SELECT concat('w', user_id) AS watch_id,
           concat('w', user_id, '@', CAST(CAST(ts AS DATE) AS STRING)) AS snapshot_id,
           CAST(ts AS DATE) AS taken_on,
           concat('proj-', event_id % 4) AS project,
           concat('ISSUE-', {d.json("props", "k")}) AS issue_id,
           {pick("CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END",
                 ["critical", "high", "medium", "low", "unknown"])} AS severity,
           CAST(floor(value) AS INTEGER) AS risk_score,
           value > 100 AS fixable, event_id
    FROM {d.t("events")}"""


@fixture
def endpoints(d) -> str:
    """One operation per page: the host is the scan, verb and resource follow from the page id."""
    host = d.rx(d.rxget("url", "^https?://([^/]+)"), "^(m|blog|www)[.]", "")
    lang = d.rxget("url", "^https?://[^/]+/([a-z]+)/")
    return f"""
    SELECT page_id AS pos, {host} AS scan_id, {pick("page_id % 4", VERB4)} AS verb,
           {pick("(page_id + 1) % 4", VERB4)} AS next_verb,
           concat('/', {lang}, '/', {pick("page_id % 9", ["Orders", "accounts", "claims", "policies", "quotes", "offers",
                                                          "users", "items", "notes"])},
                  {pick("page_id % 3", ["", "/{id}", "/{id}/lines/{line}"])}) AS path
    FROM {d.t("pages")}"""


@fixture
def code_endpoints(d) -> str:
    return """
    SELECT scan_id, 'code' AS spec_id, pos, verb AS method, path,
           CASE WHEN pos % 13 = 5 THEN 'mappings declared on interfaces are not analysed: X' END AS blind_spot
    FROM fx_endpoints WHERE pos % 10 <> 0"""


@fixture
def spec_endpoints(d) -> str:
    spec_path = d.rx("path", "[{]id[}]", "{pageId}")
    return f"""
    SELECT scan_id, 'A' AS spec_id, pos, CASE WHEN pos % 8 = 3 THEN next_verb ELSE verb END AS method,
           CASE WHEN pos % 3 = 1 THEN {spec_path} WHEN pos % 5 = 2 THEN concat(lower(path), '/') ELSE path END AS path
    FROM fx_endpoints WHERE pos % 7 <> 0
    UNION ALL
    SELECT scan_id, 'B' AS spec_id, pos, verb AS method, path FROM fx_endpoints WHERE pos % 6 <> 0
    UNION ALL
    SELECT scan_id, 'C' AS spec_id, pos, verb AS method, {spec_path} AS path FROM fx_endpoints WHERE pos % 5 <> 0"""


@fixture
def units(d) -> str:
    """Evidence units of three sources. The title is the first words of the text."""

    def title(text: str, n: int) -> str:
        return d.rx(d.rxget(text, "^[^A-Za-z]*((?:[A-Za-z]+[^A-Za-z]+){0,%d}[A-Za-z]*)" % n), "[^A-Za-z]+", " ")

    return f"""
    SELECT concat('doc-', doc_id) AS id, doc_id AS num, 'CONFLUENCE' AS source,
           {pick("doc_id % 7", ["SECTION", "SECTION", "STANDARD", "SECTION", "SECTION", "GLOBAL_CAVEAT", "SECTION"])} AS type,
           {title("text", 4)} AS title, text, CAST(NULL AS STRING) AS lifecycle
    FROM {d.t("documents")}
    UNION ALL
    SELECT concat('CODE:', page_id) AS id, 1000000000 + page_id AS num, 'CODE' AS source, 'ENDPOINT' AS type,
           {title(d.rxget("html", "<title>([^<]*)</title>"), 3)} AS title, html AS text, CAST(NULL AS STRING) AS lifecycle
    FROM {d.t("pages")}
    UNION ALL
    SELECT concat('ISSUE-', conv_id, '-', turn) AS id, 2000000000 + conv_id * 1000 + turn AS num, 'JIRA' AS source,
           'ISSUE' AS type, {title("text", 4)} AS title, text,
           {pick("(conv_id + turn) % 5", ["DONE", "TO_DO", "IN_PROGRESS", "DESCOPED", None])} AS lifecycle
    FROM {d.t("conversations")}"""


@fixture
def trains(d) -> str:
    return f"""
    SELECT CAST(o_orderkey AS STRING) AS train_id, o_orderkey AS seq,
           {pick("o_orderkey % 11", ["PLANNING", "CHECKING", "VERIFYING", "OPENING_PRS", "PR_OPEN", "MERGED", "DONE",
                                     "FAILED", "CANCELLED", "ALREADY_FIXED", "AWAITING_MANUAL_FIX"])} AS status,
           {pick("o_orderkey % 5", ["PLANNING", "CHECKING", "VERIFYING", "OPENING_PRS", None])} AS failed_stage,
           concat('story-', o_custkey % 500) AS story, concat('app-', o_custkey % 37) AS app,
           o_orderdate AS created_at,
           CASE WHEN o_orderkey % 11 >= 4 AND o_orderkey % 11 < 10
                THEN {d.plus_minutes("o_orderdate", "(o_orderkey % 4000) - 100")} END AS finished_at,
           floor(o_totalprice) / 1000000 AS est_cost
    FROM {d.t("orders")}"""
