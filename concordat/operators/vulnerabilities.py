"""Vulnerability snapshots: roll-ups, changes between snapshots, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.portfolio import NON_TERMINAL, half_up
from concordat.operators.windows import latest, with_previous

c = F.col
LEVELS = ["critical", "high", "medium", "low"]


def vuln_rank(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    out = F.when(s == LEVELS[0], 0)
    for i, level in enumerate(LEVELS[1:], 1):
        out = out.when(s == level, i)
    return out.otherwise(4)


def snapshot_rollup(vulns: DataFrame) -> DataFrame:
    """Counts per snapshot; unknown severities are kept in the table but not counted."""
    s = F.lower("severity")
    return vulns.groupBy("watch_id", "snapshot_id", "taken_on").agg(
        *[F.count_if(s == level).alias(level) for level in LEVELS],
        F.countDistinct("project").alias("projects"),
        F.count_if("fixable").alias("fixable"),
    )


def total() -> Column:
    return c("critical") + c("high") + c("medium") + c("low")


def score(prefix: str = "") -> Column:
    """Escalation score: one vulnerability of a level outweighs any number below it."""
    weights = {"critical": 10**12, "high": 10**8, "medium": 10**4, "low": 1}
    parts = [c(prefix + k) * F.lit(w) for k, w in weights.items()]
    return parts[0] + parts[1] + parts[2] + parts[3]


def worst() -> Column:
    return F.when(c("critical") > 0, "critical").when(c("high") > 0, "high").when(c("medium") > 0, "medium").otherwise("low")


def snapshot_delta(rollup: DataFrame) -> DataFrame:
    """Each snapshot with its predecessor; a watch's history is cut by month."""
    cols = ["snapshot_id", *LEVELS]
    d = with_previous(rollup, "watch_id", ["taken_on", "snapshot_id"], F.date_trunc("month", "taken_on"), cols)
    prev_total = c("prev_critical") + c("prev_high") + c("prev_medium") + c("prev_low")
    return d.withColumns(
        {
            "total": total(),
            "prev_total": F.coalesce(prev_total, F.lit(0)),
            "worst": worst(),
            "escalated": c("prev_exists") & (score() > score("prev_")),
        }
    )


def new_severe(vulns: DataFrame, delta: DataFrame) -> DataFrame:
    """Worst severe level of issues that the previous snapshot of the watch did not have."""
    prev = delta.filter("prev_exists").select("snapshot_id", "prev_snapshot_id")
    cur = vulns.filter(c("issue_id").isNotNull() & F.lower("severity").isin("critical", "high"))
    cur = cur.select("watch_id", "snapshot_id", "issue_id", F.lower("severity").alias("severity")).distinct()
    known = vulns.select(c("snapshot_id").alias("prev_snapshot_id"), "issue_id").distinct()
    fresh = cur.join(prev, "snapshot_id").join(known, ["prev_snapshot_id", "issue_id"], "left_anti")
    return fresh.groupBy("watch_id", "snapshot_id").agg(F.min("severity").alias("new_severe"))


def alerts(vulns: DataFrame) -> DataFrame:
    """One alert per snapshot that got worse, with level and message."""
    d = snapshot_delta(snapshot_rollup(vulns))
    j = d.join(new_severe(vulns, d).select("snapshot_id", "new_severe"), "snapshot_id", "left")
    first = ~c("prev_exists") & (c("total") > 0)
    new_critical = c("critical") > F.coalesce("prev_critical", F.lit(0))
    worse = c("total") > c("prev_total")
    j = j.filter(first | new_critical | worse | c("escalated") | c("new_severe").isNotNull())
    return j.select("watch_id", "snapshot_id", c("worst").alias("severity"), alert_message(first, new_critical, worse).alias("message"))


def alert_message(first: Column, new_critical: Column, worse: Column) -> Column:
    counts = F.concat(
        c("critical"), F.lit(" critical, "), c("high"), F.lit(" high, "), c("medium"), F.lit(" medium, "), c("low"), F.lit(" low.")
    )
    w = c("watch_id")
    now = F.concat(F.lit(" — now "), counts)
    return (
        F.when(first, F.concat(F.lit("Now watching "), w, F.lit(": "), counts))
        .when(new_critical, F.concat(F.lit("New critical vulnerability in "), w, now))
        .when(c("new_severe").isNotNull(), F.concat(F.lit("New "), c("new_severe"), F.lit("-severity vulnerability in "), w, now))
        .when(worse, F.concat(F.lit("Vulnerabilities increased in "), w, F.lit(" (was "), c("prev_total"), F.lit(")"), now))
        .when(c("escalated"), F.concat(F.lit("Vulnerability severity increased in "), w, now))
        .otherwise(F.concat(F.lit("Vulnerabilities changed in "), w, now))
    )


def latest_issues(vulns: DataFrame) -> DataFrame:
    """Issues of the newest snapshot of each watch, most severe and riskiest first."""
    snaps = vulns.select("watch_id", "snapshot_id", "taken_on").distinct()
    newest = latest(snaps, ["watch_id"], "taken_on", "snapshot_id").select("snapshot_id")
    rows = vulns.join(newest, "snapshot_id", "left_semi").withColumn("rank", vuln_rank(c("severity")))
    return rows.orderBy("watch_id", "rank", F.desc("risk_score"))


def portfolio_summary(vulns: DataFrame, alert_rows: DataFrame, trains: DataFrame, ledger: DataFrame, skill: str) -> DataFrame:
    """Summary measures as rows; each source is aggregated on its own and nothing is cross-joined."""
    newest = latest(snapshot_rollup(vulns), ["watch_id"], "taken_on", "snapshot_id")
    a = newest.agg(
        F.count("*").alias("watches"), F.sum("projects").alias("projects"),
        *[F.sum(level).alias(level) for level in LEVELS], F.sum("fixable").alias("fixable"),
    )
    b = alert_rows.agg(F.count_if(~c("seen")).alias("unseen_alerts"))
    t = trains.agg(
        F.count("*").alias("trains"), F.count_if(c("status").isin(NON_TERMINAL)).alias("trains_open"),
        F.count_if(c("status") == "DONE").alias("trains_done"),
    )
    k = ledger.filter(c("skill") == skill).agg(
        F.count("*").alias("fix_actions"), half_up(F.coalesce(F.sum("est_cost"), F.lit(0.0)), 2).alias("fix_cost")
    )
    out = None
    for row in (a, b, t, k):
        wide = row.select(*[c(n).cast("double").alias(n) for n in row.columns])
        part = wide.unpivot([], wide.columns, "measure", "value")
        out = part if out is None else out.unionByName(part)
    return out
