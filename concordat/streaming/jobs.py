"""Structured Streaming jobs over append tables.

Stateful operators keep a small state per key and read their input batch by batch in event-time order. Events
older than what a key has already seen are reported as late instead of being applied.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from concordat.operators.vulnerabilities import alerts
from concordat.session import checkpoint_dir

c = F.col


def _drain(stream: DataFrame, write: Callable[[DataFrame, int, str], None], mode: str = "append") -> str:
    """Hand every micro-batch that is available to ``write`` with its number and a fresh folder in the shared one."""
    base = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda batch, epoch: write(batch, epoch, base))
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return base


def _with_batch(schema: StructType) -> StructType:
    return StructType([*schema.fields, StructField("batch", LongType())])


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain what is available into a table in the shared folder and read it back. Every micro-batch writes its
    own folder, so a replayed batch replaces itself."""

    def write(batch: DataFrame, epoch: int, base: str) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    base = _drain(stream, write, mode)
    return stream.sparkSession.read.schema(_with_batch(stream.schema)).parquet(f"{base}/out")


# --- vulnerability alerts -----------------------------------------------------------------------------------


def vulnerability_alerts(vulns: DataFrame) -> DataFrame:
    """Alerts on each snapshot of a watch that got worse, after all that is available.

    A micro-batch is kept, and the alerts of the watches it touches are worked out anew from all their rows by the
    same column expressions as in batch; the last such result of a watch counts. So a snapshot whose rows come in
    several batches, or after a younger one, gives the alerts that it gives in one piece."""
    spark, schema = vulns.sparkSession, vulns.schema

    def write(batch: DataFrame, epoch: int, base: str) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={epoch}")
        rows = batch.sparkSession.read.schema(_with_batch(schema)).parquet(f"{base}/rows").filter(c("batch") <= epoch)
        touched = rows.filter(c("batch") == epoch).select("watch_id").distinct()
        touched.write.mode("overwrite").parquet(f"{base}/touched/batch={epoch}")
        alerts(rows.drop("batch").join(touched, "watch_id", "left_semi")).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    base = _drain(vulns, write)
    seen = spark.read.schema("watch_id string, batch bigint").parquet(f"{base}/touched")
    last = seen.groupBy("watch_id").agg(F.max("batch").alias("batch"))
    out = spark.read.schema("watch_id string, snapshot_id string, severity string, message string, batch bigint").parquet(f"{base}/out")
    return out.join(last, ["watch_id", "batch"], "left_semi").select("watch_id", "snapshot_id", "severity", "message")


# --- timeouts ------------------------------------------------------------------------------------------------


def stale_keys(updates: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Keys (key, ts, live) without progress for the given time: a timer per key on event time, moved by every
    update. A key that is no longer live keeps that mark until the watermark has passed it, so that an older
    update which comes later does not bring it back."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, live = state.get
            state.remove()
            yield pd.DataFrame({"key": [key[0]] * live, "last_ms": pd.Series([last] * live, dtype="int64")})
            return
        last, live = state.get if state.exists else (-1, True)
        for pdf in pdfs:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            at = int(ms.to_numpy().argmax())
            if int(ms.iloc[at]) >= last:
                last, live = int(ms.iloc[at]), bool(pdf["live"].iloc[at])
        state.update((last, live))
        state.setTimeoutTimestamp(max(last + minutes * 60_000 * live, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": pd.Series(dtype="str"), "last_ms": pd.Series(dtype="int64")})

    rows = updates.select("key", c("ts").cast("timestamp").alias("ts"), "live").withWatermark("ts", delay)
    return rows.groupBy("key").applyInPandasWithState(
        step, "key string, last_ms bigint", "last_ms bigint, live boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


# --- totals, intake, gates, claims ---------------------------------------------------------------------------------


def daily_totals(ledger: DataFrame) -> DataFrame:
    """(day, total, actions) after all that is available. Every micro-batch adds its partial sums, which are added up
    when they are read: no row is too late, and there is no state to keep."""
    cost = F.sum(F.coalesce(c("est_cost").cast("double"), F.lit(0.0)))

    def write(batch: DataFrame, epoch: int, base: str) -> None:
        sums = batch.groupBy(F.to_date("created_at").alias("day")).agg(cost.alias("total"), F.count("*").alias("actions"))
        sums.write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    base = _drain(ledger, write)
    parts = ledger.sparkSession.read.schema("day date, total double, actions bigint, batch bigint").parquet(f"{base}/out")
    return parts.groupBy("day").agg(F.sum("total").alias("total"), F.sum("actions").alias("actions"))


def dedup_stream(rows: DataFrame, key: str) -> DataFrame:
    """Idempotent intake: a row of each key once, ever. The state holds a mark per key that has passed, so a micro-batch
    costs what it brings; of several rows of a new key in one batch the least passes, column by column."""
    names = rows.columns

    def step(found: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        least = None
        for pdf in pdfs:
            mine = pdf if least is None else pd.concat([least, pdf])
            least = None if state.exists else mine.sort_values(names, na_position="first").head(1)
        if least is not None:
            state.update((True,))
            yield least[names]

    return run_available(rows.groupBy(key).applyInPandasWithState(step, rows.schema, "passed boolean", "append", GroupStateTimeout.NoTimeout))


def _sequential(rows: DataFrame, apply: Callable[[np.ndarray, np.ndarray, str | None], tuple[np.ndarray, str | None]]) -> DataFrame:
    """Outcomes of the events (key, ms, event_id, kind) of each key in event-time order.

    ``apply`` maps the kinds and times of a batch and the status before it to outcomes and the status after it, as
    arrays. The state is (status, ms of the last applied event); what is older than that is late. A task holds the
    three columns of one key's events of one micro-batch."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [(p["ms"].to_numpy(np.int64), p["event_id"].to_numpy(np.int64), p["kind"].to_numpy(object)) for p in pdfs]
        ms, event, kind = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((event, ms))
        ms, event, kind = ms[order], event[order], kind[order]
        status, seen = state.get if state.exists else (None, -(2**62))
        late = int(np.searchsorted(ms, seen, side="left"))
        outcome, status = apply(kind[late:], ms[late:], status)
        if late < len(ms):
            seen = int(ms[-1])
        state.update((status, seen))
        yield pd.DataFrame({"key": [key[0]] * len(ms), "event_id": event, "outcome": np.concatenate((np.full(late, "LATE", object), outcome))})

    return rows.select("key", "ms", "event_id", "kind").groupBy("key").applyInPandasWithState(
        run, "key string, event_id bigint, outcome string", "status string, seen bigint", "append", GroupStateTimeout.NoTimeout
    )


STATES = (None, "PENDING", "APPROVED", "REJECTED", "CONSUMED")
# Per kind, for every state: the state after it, and the outcome.
GATE = {
    "AWAIT": ([1, 1, 4, 1, 1], ["PENDING", "PENDING", "APPROVED", "PENDING", "PENDING"]),
    "APPROVE": ([0, 2, 2, 3, 4], ["CONFLICT", "APPROVED", "CONFLICT", "CONFLICT", "CONFLICT"]),
    "REJECT": ([0, 3, 2, 3, 4], ["CONFLICT", "REJECTED", "CONFLICT", "CONFLICT", "CONFLICT"]),
}


def gate_decisions(events: DataFrame) -> DataFrame:
    """Approval gates: an approval is used up by one action, a pending request is reused, decisions need a pending
    request. Kinds: AWAIT, APPROVE, REJECT; any other one decides like REJECT.

    An event maps states to states, and such maps compose: all prefixes of a batch are composed in a logarithmic
    number of array steps."""

    def apply(kind: np.ndarray, ms: np.ndarray, status: str | None) -> tuple[np.ndarray, str | None]:
        if not len(kind):
            return np.empty(0, object), status
        which = np.where(kind == "AWAIT", 0, np.where(kind == "APPROVE", 1, 2))
        after = np.array([GATE[k][0] for k in GATE])[which]
        step = 1
        while step < len(after):
            after[step:] = np.take_along_axis(after[step:], after[:-step].copy(), axis=1)
            step *= 2
        start = STATES.index(status)
        before = np.concatenate(([start], after[:-1, start]))
        return np.array([GATE[k][1] for k in GATE], object)[which, before], STATES[after[-1, start]]

    return _sequential(events, apply)


def claims(requests: DataFrame, lease_ms: int) -> DataFrame:
    """One generation per snapshot: a claim is taken when none is in flight or the last one is past its lease. A batch
    is walked from claim to claim."""

    def apply(kind: np.ndarray, ms: np.ndarray, status: str | None) -> tuple[np.ndarray, str | None]:
        outcome = np.full(len(ms), "CONFLICT", object)
        at = 0 if status is None else int(np.searchsorted(ms, int(status) + lease_ms, side="left"))
        while at < len(ms):
            outcome[at], status = "CLAIMED", str(int(ms[at]))
            at = max(at + 1, int(np.searchsorted(ms, ms[at] + lease_ms, side="left")))
        return outcome, status

    return _sequential(requests, apply)
