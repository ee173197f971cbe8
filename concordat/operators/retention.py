"""Retention and sweeps. ``now`` is always a parameter; zero days disables a rule; cut-offs are strict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.portfolio import MACHINE_DRIVEN
from concordat.operators.windows import latest

c = F.col


def _before(ts: str, now: Column, days: int) -> Column:
    return F.coalesce(c(ts) < now - F.expr(f"INTERVAL '{int(days)}' DAY"), F.lit(False))


def retain(df: DataFrame, ts: str, days: int, now: Column, only: Column | None = None) -> DataFrame:
    """Rows that stay. ``only`` narrows what may be dropped (seen alerts, closed trains)."""
    if days <= 0:
        return df
    drop = _before(ts, now, days)
    return df.filter(~(drop & F.coalesce(only, F.lit(False)) if only is not None else drop))


def retain_trains(trains: DataFrame, days: int, now: Column) -> DataFrame:
    return retain(trains, "finished_at", days, now, c("status").isin("FAILED", "CANCELLED", "ALREADY_FIXED"))


def retain_snapshots(snaps: DataFrame, days: int, now: Column) -> DataFrame:
    """Old snapshots go, but the newest one of a watch stays as the baseline of the next poll."""
    if days <= 0:
        return snaps
    newest = latest(snaps, ["watch_id"], "taken_on", "snapshot_id").select("snapshot_id", F.lit(True).alias("_newest"))
    j = snaps.join(newest, "snapshot_id", "left")
    return j.filter(~_before("taken_on", now, days) | c("_newest").isNotNull()).drop("_newest")


def stale_scans(scans: DataFrame, now: Column, minutes: int = 60) -> DataFrame:
    """Running scans (queued ones exempt) whose last sign of life is too old."""
    heartbeat = F.coalesce("updated_at", "started_at")
    old = heartbeat < now - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    live = (c("status") == "RUNNING") & F.coalesce(c("stage") != "QUEUED", F.lit(True))
    note = F.lit(f"Scan made no progress for over {minutes} min")
    return scans.filter(live & old).withColumn("error", note)


def stale_trains(trains: DataFrame, now: Column, minutes: int = 120) -> DataFrame:
    old = c("created_at") < now - F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    return trains.filter(c("status").isin(MACHINE_DRIVEN) & old).withColumn(
        "error", F.lit(f"The fix exceeded the maximum runtime of {minutes} min.")
    )


def sweep_snapshots(snaps: DataFrame, now: Column, ttl_hours: int, lease_minutes: int) -> DataFrame:
    """Action per feature-index snapshot: generations past the lease fail; idle ones that nobody holds are deleted.
    Failing is recorded first and does not renew the snapshot, so one row can get both actions."""
    lease = now - F.expr(f"INTERVAL '{int(lease_minutes)}' MINUTE")
    idle = c("updated_at") < now - F.expr(f"INTERVAL '{int(ttl_hours)}' HOUR")
    started = c("generation_started_at")
    fail = F.coalesce(started < lease, F.lit(False)) & c("strategy_id").isNull() & c("error").isNull()
    delete = F.coalesce(idle, F.lit(False)) & (started.isNull() | (started < lease))
    return snaps.withColumns({"failed": fail, "deleted": delete})
