"""Streams replayed in several files against their batch twins."""

import datetime as dt

from pyspark.sql import functions as F

import concordat.plans.catalog  # noqa: F401
from concordat.operators import vulnerabilities as vu
from concordat.plans.registry import Ctx
from concordat.sources import sinks, tracker
from concordat.streaming import jobs


def replay(spark, df, path, parts, order):
    """Write ``df`` as ``parts`` files in time order and read them one per micro-batch."""
    n = df.count()
    rows = df.orderBy(order).collect()
    size = n // parts + 1
    for i in range(parts):
        chunk = spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        chunk.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_alerts_over_many_batches(spark, sf, tmp_path):
    vulns = Ctx(spark, sf).fx("vulns")
    # Late snapshots and snapshots over several files: the youngest days first, and every day in two files.
    day, half = F.dayofmonth("taken_on"), F.pmod(F.xxhash64("issue_id"), F.lit(2))
    path = str(tmp_path / "vulns")
    for lo, hi in ((21, 31), (1, 10), (11, 20)):
        for k in (0, 1):
            vulns.filter(day.between(lo, hi) & (F.coalesce(half, F.lit(0)) == k)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(vulns.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = jobs.vulnerability_alerts(stream)
    key = lambda r: (r["watch_id"], r["snapshot_id"], r["severity"], r["message"])
    assert {key(r) for r in got.collect()} == {key(r) for r in vu.alerts(vulns).collect()}


def test_claims_keep_their_lease_over_batches(spark, tmp_path):
    rows = [("k", m * 60_000, m, "CLAIM") for m in (0, 5, 29, 30, 31, 59, 60, 200)]
    df = spark.createDataFrame(rows, "key string, ms bigint, event_id bigint, kind string")
    out = jobs.run_available(jobs.claims(replay(spark, df, str(tmp_path / "c"), 3, "ms"), 30 * 60_000))
    got = {r["event_id"]: r["outcome"] for r in out.collect()}
    assert [e for e, o in sorted(got.items()) if o == "CLAIMED"] == [0, 30, 60, 200]


def test_gate_uses_an_approval_once(spark, tmp_path):
    kinds = ["AWAIT", "AWAIT", "APPROVE", "AWAIT", "AWAIT", "REJECT", "APPROVE"]
    df = spark.createDataFrame([("r", i, i, k) for i, k in enumerate(kinds)], "key string, ms bigint, event_id bigint, kind string")
    out = jobs.run_available(jobs.gate_decisions(replay(spark, df, str(tmp_path / "g"), 2, "ms")))
    got = [r["outcome"] for r in sorted(out.collect(), key=lambda r: r["event_id"])]
    assert got == ["PENDING", "PENDING", "APPROVED", "APPROVED", "PENDING", "REJECTED", "CONFLICT"]


def test_silent_keys_time_out(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("quiet", t0, True), ("busy", t0, True), ("done", t0, False)]
    rows += [("busy", t0 + dt.timedelta(minutes=30 * i), True) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, live boolean")
    out = jobs.run_available(jobs.stale_keys(replay(spark, df, str(tmp_path / "h"), 2, "ts"), 60))
    assert [r["key"] for r in out.collect()] == ["quiet"]


def test_intake_is_idempotent(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(minutes=i)) for i, k in enumerate("abacabad")] + [("a", t0 + dt.timedelta(days=90)), ("b", t0 + dt.timedelta(days=91))]
    df = spark.createDataFrame(rows, "k string, ts timestamp")
    out = jobs.dedup_stream(replay(spark, df, str(tmp_path / "d"), 3, "ts"), "k")
    assert sorted(r["k"] for r in out.collect()) == ["a", "b", "c", "d"]


def test_late_rows_count(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, d), 1.0) for i, d in enumerate((20, 21, 22, 1, 20, 2))]
    df = spark.createDataFrame(rows, "i int, created_at timestamp, est_cost double")
    got = {str(r["day"]): (r["total"], r["actions"]) for r in jobs.daily_totals(replay(spark, df, str(tmp_path / "t"), 3, "i")).collect()}
    assert got == {"2024-01-20": (2.0, 2), "2024-01-21": (1.0, 1), "2024-01-22": (1.0, 1), "2024-01-01": (1.0, 1), "2024-01-02": (1.0, 1)}


def test_a_closed_key_stays_closed(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    rows = [(0, "k", at(5), False), (1, "x", at(6), True), (2, "k", at(1), True), (3, "x", at(70), True), (4, "x", at(140), True), (5, "x", at(200), True)]
    df = spark.createDataFrame(rows, "i int, key string, ts timestamp, live boolean")
    out = jobs.run_available(jobs.stale_keys(replay(spark, df, str(tmp_path / "s"), 3, "i").drop("i"), 60))
    assert "k" not in [r["key"] for r in out.collect()]


def test_batches_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    path = str(tmp_path / "f")
    sinks.append_findings(df, path, 1)
    sinks.append_findings(df, path, 1)
    sinks.append_findings(df, path, 2)
    assert spark.read.parquet(path).count() == 4


def test_issue_pages_from_files(spark, tmp_path):
    for i in (1, 2):
        body = '{"total":2,"issues":[{"key":"K-%d","fields":{"summary":"s","status":{"name":"x","statusCategory":{"key":"done"}}}}]}' % i
        (tmp_path / f"page-{i}.json").write_text(body)
    rows = tracker.issues(tracker.read_pages(spark, str(tmp_path)), 0).orderBy("page").collect()
    assert [(r["key"], r["page"], r["lifecycle"]) for r in rows] == [("K-1", 1, "DONE"), ("K-2", 2, "DONE")]
