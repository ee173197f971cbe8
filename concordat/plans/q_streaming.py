"""Streaming queries: the tables are read as streams, drained, and compared with batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from concordat.functions.text import est_tokens
from concordat.operators import retention as rt
from concordat.operators.chunking import chunk_lines
from concordat.plans.dialect import SparkDialect, pick
from concordat.plans.q_findings import _DELTA, _WORST
from concordat.plans.registry import ORACLES, fixture, query, with_fixtures
from concordat.schemas import SOURCE_TABLES
from concordat.streaming import jobs

c = F.col


class _StreamDialect(SparkDialect):
    """Source tables read as file streams."""

    def __init__(self, spark, sf_dir):
        super().__init__(sf_dir)
        self.spark = spark

    def t(self, name):
        view = f"_stream_{name}_{uuid.uuid4().hex[:8]}"
        # A glob, because a stream source wants a folder or a pattern where a table may also be a single file.
        path = f"{self.sf_dir}/{{{name}.parquet}}"
        self.spark.readStream.schema(SOURCE_TABLES[name]).parquet(path).createOrReplaceTempView(view)
        return view


def stream(ctx, name):
    sql = with_fixtures(f"SELECT * FROM fx_{name}", _StreamDialect(ctx.spark, ctx.sf_dir))
    return ctx.spark.sql(sql)


@query("st_1", ORACLES["st_1_batch"])
def st_1(ctx):
    return jobs.vulnerability_alerts(stream(ctx, "vulns"))


def _now():
    return F.lit("2001-08-01 00:00:00").cast("timestamp_ntz")


@query(
    "st_2_batch",
    """SELECT scan_id AS id, 'Scan made no progress for over 60 min' AS error FROM fx_scans WHERE status = 'RUNNING' AND stage <> 'QUEUED' AND coalesce(updated_at, started_at) < TIMESTAMP '2001-07-31 23:00:00'
    UNION ALL SELECT train_id, 'The fix exceeded the maximum runtime of 120 min.' FROM fx_trains WHERE status IN ('PLANNING','CHECKING','VERIFYING','OPENING_PRS') AND created_at < TIMESTAMP '2001-07-31 22:00:00'""",
)
def st_2_batch(ctx):
    a = rt.stale_scans(ctx.fx("scans"), _now()).select(c("scan_id").alias("id"), "error")
    return a.unionByName(rt.stale_trains(ctx.fx("trains"), _now()).select(c("train_id").alias("id"), "error"))


@fixture
def heartbeats(d) -> str:
    return f"""
    SELECT concat('scan-', user_id) AS key, ts, event_type <> 'purchase' AS live FROM {d.t("events")}"""


@query(
    "st_2",
    """WITH l AS (SELECT key, max(ts) AS ts, arg_max(live, ts) AS live FROM fx_heartbeats GROUP BY key), w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS wm FROM fx_heartbeats)
    SELECT key, epoch_us(ts) // 1000 AS last_ms FROM l, w WHERE live AND ts + INTERVAL 600 MINUTE < wm""",
)
def st_2(ctx):
    return jobs.run_available(jobs.stale_keys(stream(ctx, "heartbeats"), 600)).drop("batch")


@query(
    "st_3",
    """SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, floor(sum(coalesce(est_cost, 0)) * 10000 + 0.5) / 10000 AS total, count(*) AS actions FROM fx_ledger GROUP BY CAST(created_at AS DATE)""",
)
def st_3(ctx):
    out = jobs.daily_totals(stream(ctx, "ledger"))
    return out.select(c("day").cast("string").alias("day"), (F.floor(c("total") * 10000 + 0.5) / 10000).alias("total"), "actions")


@query(
    "st_4",
    """SELECT 'finding' AS kind, row_id AS id FROM fx_findings WHERE NOT created_at < TIMESTAMP '2001-08-01' - INTERVAL 180 DAY
    UNION ALL SELECT 'cost', id FROM fx_ledger WHERE NOT created_at < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY
    UNION ALL SELECT 'alert', CAST(event_id AS VARCHAR) FROM fx_alerts WHERE NOT (seen AND created_at < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY)
    UNION ALL SELECT 'train', train_id FROM fx_trains WHERE NOT coalesce(status IN ('FAILED','CANCELLED','ALREADY_FIXED') AND finished_at < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY, false)
    UNION ALL SELECT 'off', train_id FROM fx_trains
    UNION ALL SELECT 'snapshot', snapshot_id FROM (SELECT DISTINCT watch_id, snapshot_id, taken_on FROM fx_vulns) s
      WHERE NOT taken_on < DATE '2024-01-26' OR taken_on = (SELECT max(taken_on) FROM fx_vulns v WHERE v.watch_id = s.watch_id)""",
)
def st_4(ctx):
    late = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    snaps = ctx.fx("vulns").select("watch_id", "snapshot_id", "taken_on").distinct()

    def rows(kind, df, key):
        return df.select(F.lit(kind).alias("kind"), c(key).cast("string").alias("id"))

    out = rows("finding", rt.retain(ctx.fx("findings"), "created_at", 180, _now()), "row_id")
    out = out.unionByName(rows("cost", rt.retain(ctx.fx("ledger"), "created_at", 20, late), "id"))
    out = out.unionByName(rows("alert", rt.retain(ctx.fx("alerts"), "created_at", 10, late, c("seen")), "event_id"))
    out = out.unionByName(rows("train", rt.retain_trains(ctx.fx("trains"), 90, _now()), "train_id"))
    out = out.unionByName(rows("off", rt.retain_trains(ctx.fx("trains"), 0, _now()), "train_id"))
    return out.unionByName(rows("snapshot", rt.retain_snapshots(snaps, 5, late), "snapshot_id"))


@fixture
def index_snapshots(d) -> str:
    return f"""
    SELECT event_id, ts AS updated_at, CASE WHEN event_id % 3 > 0 THEN {d.plus_minutes("ts", "event_id % 50")} END AS generation_started_at,
           CASE WHEN event_id % 5 = 0 THEN concat('st-', user_id) END AS strategy_id, CASE WHEN event_id % 7 = 0 THEN 'boom' END AS error FROM {d.t("events")}"""


@query(
    "st_5",
    """SELECT event_id, coalesce(generation_started_at < TIMESTAMP '2024-01-30 23:30:00', false) AND strategy_id IS NULL AND error IS NULL AS failed,
      updated_at < TIMESTAMP '2024-01-30 00:00:00' AND (generation_started_at IS NULL OR generation_started_at < TIMESTAMP '2024-01-30 23:30:00') AS deleted FROM fx_index_snapshots""",
)
def st_5(ctx):
    late = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return rt.sweep_snapshots(ctx.fx("index_snapshots"), late, 24, 30).select("event_id", "failed", "deleted")


@fixture
def gate_events(d) -> str:
    ms = "unix_millis(CAST(ts AS TIMESTAMP))" if isinstance(d, SparkDialect) else "epoch_us(ts) // 1000"
    return f"""
    SELECT concat('run-', user_id % 60) AS key, {ms} AS ms, event_id,
           {pick("CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END", ["APPROVE", "REJECT", "AWAIT"])} AS kind FROM {d.t("events")}"""


@query(
    "st_6",
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, event_id) AS rn FROM fx_gate_events),
    s AS (SELECT key, event_id, rn, CASE WHEN kind = 'AWAIT' THEN 'PENDING' ELSE 'CONFLICT' END AS outcome, CASE WHEN kind = 'AWAIT' THEN 'PENDING' END AS st FROM r WHERE rn = 1
      UNION ALL SELECT r.key, r.event_id, r.rn,
        CASE WHEN r.kind = 'AWAIT' THEN CASE WHEN s.st = 'APPROVED' THEN 'APPROVED' ELSE 'PENDING' END WHEN s.st = 'PENDING' THEN CASE r.kind WHEN 'APPROVE' THEN 'APPROVED' ELSE 'REJECTED' END ELSE 'CONFLICT' END,
        CASE WHEN r.kind = 'AWAIT' THEN CASE WHEN s.st = 'APPROVED' THEN 'CONSUMED' ELSE 'PENDING' END WHEN s.st = 'PENDING' THEN CASE r.kind WHEN 'APPROVE' THEN 'APPROVED' ELSE 'REJECTED' END ELSE s.st END
      FROM s JOIN r ON r.key = s.key AND r.rn = s.rn + 1)
    SELECT key, event_id, outcome FROM s""",
)
def st_6(ctx):
    return jobs.run_available(jobs.gate_decisions(stream(ctx, "gate_events"))).drop("batch")


@query("st_7", "SELECT DISTINCT issue_id AS issue_id FROM fx_intake")
def st_7(ctx):
    return jobs.dedup_stream(stream(ctx, "intake"), "issue_id").select("issue_id")


@fixture
def intake(d) -> str:
    return f"SELECT concat({d.json('props', 'k')}, '-', user_id % 20) AS issue_id, ts FROM {d.t('events')}"


@fixture
def claim_requests(d) -> str:
    ms = "unix_millis(CAST(ts AS TIMESTAMP))" if isinstance(d, SparkDialect) else "epoch_us(ts) // 1000"
    return f"SELECT concat('snap-', user_id) AS key, {ms} AS ms, event_id, 'CLAIM' AS kind FROM {d.t('events')}"


@query(
    "st_8",
    """WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, event_id) AS rn FROM fx_claim_requests),
    s AS (SELECT key, event_id, rn, 'CLAIMED' AS outcome, ms AS held FROM r WHERE rn = 1
      UNION ALL SELECT r.key, r.event_id, r.rn, CASE WHEN s.held > r.ms - 36000000 THEN 'CONFLICT' ELSE 'CLAIMED' END, CASE WHEN s.held > r.ms - 36000000 THEN s.held ELSE r.ms END FROM s JOIN r ON r.key = s.key AND r.rn = s.rn + 1)
    SELECT key, event_id, outcome FROM s""",
)
def st_8(ctx):
    return jobs.run_available(jobs.claims(stream(ctx, "claim_requests"), 36_000_000)).drop("batch")


@query(
    "win_10",
    """WITH RECURSIVE r AS (SELECT role AS grp, conv_id * 1000 + turn AS pos, CAST((length(text) + 1 + 3) // 4 AS BIGINT) AS tokens, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) AS rn FROM conversations),
    s AS (SELECT grp, pos, rn, tokens, 7 + tokens AS used, 0 AS chunk FROM r WHERE rn = 1
      UNION ALL SELECT r.grp, r.pos, r.rn, r.tokens, CASE WHEN s.used + r.tokens > 400 THEN 7 + r.tokens ELSE s.used + r.tokens END, CASE WHEN s.used + r.tokens > 400 THEN s.chunk + 1 ELSE s.chunk END
      FROM s JOIN r ON r.grp = s.grp AND r.rn = s.rn + 1)
    SELECT grp, pos, tokens, chunk FROM s""",
)
def win_10(ctx):
    line = F.concat("text", F.lit("\n"))
    lines = ctx.table("conversations").select(c("role").alias("grp"), (c("conv_id") * 1000 + c("turn")).alias("pos"), est_tokens(line).alias("tokens"))
    return chunk_lines(lines, 400, 7)
