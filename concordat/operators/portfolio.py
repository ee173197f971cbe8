"""Verdicts, summaries, costs, defects and dashboards over many services at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions import rules, text
from concordat.operators.findings import breaking, with_attention
from concordat.operators.windows import dedup_first, exact_median, first_k, latest
from concordat.taxonomy import DISMISSED, FINDING_TYPES, NOT_CAUGHT, SEVERITIES, severity_rank

c = F.col
TYPE_NAMES = [t[0] for t in FINDING_TYPES]


def half_up(x: Column, digits: int) -> Column:
    """Half-up rounding on the binary value."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def _caught() -> Column:
    return c("status").isNull() | ~c("status").isin(NOT_CAUGHT)


# --- verdicts -------------------------------------------------------------------------------------


def verdict_aggregates() -> list[Column]:
    """Aggregates of counted findings by effective severity. Needs ``attention``."""
    counted = ~c("attention")
    eff = rules.effective_severity(c("user_severity"), c("severity"))
    by = {
        s: F.count_if(counted & (eff == s)).alias(s.lower()) for s in ("BLOCKER", "CRITICAL", "MAJOR", "MINOR", "UNSPECIFIED")
    }
    return [
        F.count_if(counted).alias("counted"),
        *by.values(),
        F.count_if(counted & breaking(c("type"))).alias("breaking"),
        F.count_if(F.coalesce(c("ai_disputed"), F.lit(False))).alias("disputed"),
    ]


def verdict_of(max_blocker: int = 0, max_critical: int = 0, max_breaking: int = 0) -> Column:
    fail = (c("blocker") > max_blocker) | (c("critical") > max_critical) | (c("breaking") > max_breaking)
    return F.when(fail, "FAIL").when(c("major") + c("minor") + c("unspecified") > 0, "WARN").otherwise("PASS")


def release_verdict(findings: DataFrame, keys: list[str] | None = None, **caps: int) -> DataFrame:
    """Verdict per key (default: per scan), one partial aggregation and one shuffle."""
    agg = with_attention(findings).groupBy(*(keys or ["scan_id"])).agg(*verdict_aggregates())
    return agg.withColumn("verdict", verdict_of(**caps))


def latest_completed(scans: DataFrame) -> DataFrame:
    done = scans.filter((c("status") == "COMPLETED") & c("started_at").isNotNull() & c("service").isNotNull())
    return latest(done, ["service"], "started_at", "seq")


def executive(scans: DataFrame, findings: DataFrame, **caps: int) -> DataFrame:
    """Per service: verdict of its latest completed scan without dismissed findings."""
    newest = latest_completed(scans).select("service", "scan_id")
    live = findings.filter(c("status").isNull() | ~c("status").isin(DISMISSED))
    agg = with_attention(live.join(newest, "scan_id")).groupBy("scan_id").agg(*verdict_aggregates())
    out = newest.join(agg, "scan_id", "left").na.fill(0)
    return out.withColumn("verdict", verdict_of(**caps)).withColumn("blocking", c("blocker") + c("critical"))


def by_severity(findings: DataFrame) -> DataFrame:
    """Engine severity and effective severity (INFO when there is none) per scan, zero rows dropped."""
    eff = F.upper(F.coalesce("user_severity", "severity", F.lit("INFO")))
    kinds = F.array(
        F.struct(F.lit("engine").alias("kind"), c("severity").alias("sev")),
        F.struct(F.lit("effective").alias("kind"), eff.alias("sev")),
    )
    return findings.select("scan_id", F.inline(kinds)).groupBy("scan_id", "kind", "sev").agg(F.count("*").alias("n"))


def caught(findings: DataFrame) -> DataFrame:
    hits = findings.filter(breaking(c("type")) & _caught())
    return hits.agg(F.countDistinct("finding_id").alias("caught"))


def debt(findings: DataFrame) -> DataFrame:
    live = findings.filter(_caught())
    return live.agg(
        F.countDistinct(F.when(c("severity") == "UNSPECIFIED", c("finding_id"))).alias("unspecified"),
        F.countDistinct(F.when(c("ai_disputed"), c("finding_id"))).alias("disputed"),
    )


def dispositions(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    status = F.coalesce("status", F.lit("OPEN"))
    return findings.groupBy(*(keys or [])).agg(
        F.count_if(c("reviewed_at").isNotNull()).alias("reviewed"),
        F.count_if(status == "ACCEPTED").alias("accepted"),
        F.count_if(status.isin(NOT_CAUGHT)).alias("rejected"),
        F.count_if(status == "JIRA_CREATED").alias("filed"),
        F.count_if(status == "OPEN").alias("open"),
        F.count_if(F.coalesce("ai_disputed", F.lit(False))).alias("disputed"),
    )


def kept_rate(disp: DataFrame) -> DataFrame:
    """Share of decided findings that were kept, in whole percent; null when none was decided."""
    decided = c("accepted") + c("rejected") + c("filed")
    pct = F.floor((c("accepted") + c("filed")) / F.nullif(decided, F.lit(0)) * 100 + 0.5)
    return disp.withColumn("decided", decided).withColumn("kept_pct", pct)


def severity_distribution(findings: DataFrame) -> DataFrame:
    """Counts, shares and running shares of effective severities in rank order, counted findings only."""
    eff = rules.effective_severity(c("user_severity"), c("severity"))
    n = (
        with_attention(findings)
        .filter(~c("attention"))
        .groupBy("scan_id", eff.alias("severity"))
        .agg(F.count("*").alias("n"))
        .filter(c("severity").isin(SEVERITIES))
        .withColumn("rank", severity_rank(c("severity")))
    )
    all_rows = Window.partitionBy("scan_id")
    run = all_rows.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum("n").over(all_rows)
    return n.select(
        "scan_id",
        "severity",
        "n",
        (100.0 * c("n") / total).alias("pct"),
        (100.0 * (F.sum("n").over(run) - c("n")) / total).alias("start_pct"),
        (100.0 * F.sum("n").over(run) / total).alias("end_pct"),
    )


def bottom_line(findings: DataFrame, **caps: int) -> DataFrame:
    """Effort band and action text per scan."""
    bucket = rules.bucket(c("type"))
    counted = ~c("attention")
    agg = (
        with_attention(findings)
        .groupBy("scan_id")
        .agg(
            *verdict_aggregates(),
            *[F.count_if(counted & (bucket == b)).alias("n_" + b.lower()) for b in ("MISSING", "WRONG", "DEAD")],
        )
        .withColumn("verdict", verdict_of(**caps))
    )

    def part(n: str, one: str, many: str, verb: str) -> Column:
        return F.when(c(n) > 0, F.concat(F.lit(verb), c(n), F.when(c(n) == 1, one).otherwise(many)))

    todo = F.concat_ws(
        ", ",
        part("n_missing", "", "", "document "),
        part("n_wrong", " mismatch", " mismatches", "correct "),
        part("n_dead", " stale entry", " stale entries", "remove "),
    )
    capital = F.concat(F.upper(F.substr(todo, F.lit(1), F.lit(1))), F.substr(todo, F.lit(2)))
    one = c("breaking") == 1
    first = F.when(
        c("breaking") > 0,
        F.concat(
            F.lit(" "), c("breaking"), F.when(one, " of these is").otherwise(" of these are"),
            F.lit(" consumer-breaking — fix "), F.when(one, "it").otherwise("those"), F.lit(" first."),
        ),
    ).otherwise("")
    action = F.when(c("counted") == 0, "No action needed — the documentation matches the code.").otherwise(
        F.concat(capital, F.lit("."), first)
    )
    effort = F.when(c("counted") <= 3, "small").when(c("counted") <= 8, "moderate").otherwise("large")
    return agg.withColumns({"effort": effort, "action": action})


def error_contract(findings: DataFrame) -> DataFrame:
    """Distinct endpoints per error status of demoted status findings; collapsed findings expand."""
    demoted = (
        (c("type") == "STATUS_CODE_MISSING") & rules.is_deterministic(c("origin")) & (c("confidence") == "LOW")
    )
    status = text.status_in(c("summary"))
    spread = F.when(F.size(F.coalesce("affected_endpoints", F.array())) > 1, c("affected_endpoints")).otherwise(
        F.array_compact(F.array("endpoint"))
    )
    rows = findings.filter(demoted & status.isNotNull()).select(status.alias("status"), F.explode(spread).alias("endpoint"))
    return rows.groupBy("status").agg(F.countDistinct("endpoint").alias("endpoints"))


# --- votes and disputes ---------------------------------------------------------------------------


def votes(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Human severities given to unspecified findings of named services."""
    f = findings.filter((c("severity") == "UNSPECIFIED") & c("user_severity").isNotNull() & _caught())
    s = scans.filter(c("service").isNotNull() & (c("service") != "")).select("scan_id", "service")
    return f.select("row_id", "scan_id", "type", "finding_id", "user_severity", "created_at").join(s, "scan_id")


def disputes(findings: DataFrame, scans: DataFrame) -> DataFrame:
    f = findings.filter(c("ai_disputed") & _caught()).select(
        "row_id", "scan_id", "type", "finding_id", "ai_dispute_reason", "dispute_verdict", "endpoint", "summary", "created_at"
    )
    return f.join(scans.select("scan_id", "service"), "scan_id")


def _recent(df: DataFrame) -> DataFrame:
    return dedup_first(df, "finding_id", "row_id", [F.desc("created_at"), F.asc("row_id")])


def dispute_clusters(rows: DataFrame, examples: int = 5) -> DataFrame:
    """Per type: distinct disputes, distinct services, verdict breakdown and the latest examples."""
    uniq = _recent(rows).filter(c("type").isin(TYPE_NAMES))
    named = F.when(F.trim("service") != "", c("service"))
    base = uniq.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct(named).alias("services"))
    per_verdict = uniq.filter(F.trim("dispute_verdict") != "").groupBy("type", "dispute_verdict").agg(F.count("*").alias("k"))
    verdicts = per_verdict.groupBy("type").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("dispute_verdict", "k")))).alias("verdicts")
    )
    top = first_k(uniq, ["type"], [F.desc("created_at"), F.asc("row_id")], examples, "r")
    shown = top.groupBy("type").agg(F.array_sort(F.collect_list(F.struct("r", "row_id"))).alias("examples"))
    out = base.join(verdicts, "type", "left").join(shown, "type", "left")
    return out.withColumn("examples", F.transform("examples", lambda e: e["row_id"]))


def proposals(rows: DataFrame, min_votes: int = 3, min_services: int = 2) -> DataFrame:
    """Majority severity per type; a tie goes to the more severe one."""
    uniq = _recent(rows).filter(c("type").isin(TYPE_NAMES) & c("user_severity").isin(SEVERITIES))
    per_sev = uniq.groupBy("type", "user_severity").agg(F.count("*").alias("k"))
    consensus = F.max_by("user_severity", F.struct("k", (-severity_rank(c("user_severity"))).alias("r")))
    tally = per_sev.groupBy("type").agg(F.sum("k").alias("votes"), consensus.alias("consensus"))
    services = uniq.groupBy("type").agg(F.countDistinct("service").alias("services"))
    return tally.join(services, "type").filter((c("votes") >= min_votes) & (c("services") >= min_services))


# --- catalogue, cost, defects ---------------------------------------------------------------------


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of each asset kind per named service. Every input is counted before the union."""
    kinds = list(tables)
    parts = [
        df.filter(F.trim("service") != "").groupBy("service").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        for kind, df in tables.items()
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = [F.coalesce(F.sum(F.when(c("kind") == k, c("n"))), F.lit(0)).alias(k) for k in kinds]
    return rows.groupBy("service").agg(*sums)


def cost_summary(ledger: DataFrame) -> DataFrame:
    """Grand total and totals per skill from one pass (grouping sets)."""
    rows = ledger.select(F.coalesce("skill", F.lit("unknown")).alias("skill"), F.coalesce("est_cost", F.lit(0.0)).alias("cost"))
    return rows.rollup("skill").agg(
        F.grouping("skill").cast("int").alias("is_total"), F.sum("cost").alias("cost"), F.count("*").alias("actions")
    )


def daily(df: DataFrame, ts: str, measures: dict[str, Column], today: str, days: int = 30) -> DataFrame:
    """Zero-filled totals of the last ``days`` days up to ``today``."""
    if days < 1:
        raise ValueError("days must be 1 or more")
    span = days
    spark = df.sparkSession
    last = F.to_date(F.lit(today))
    calendar = spark.range(span).select(F.date_sub(last, c("id").cast("int")).alias("day"))
    per_day = (
        df.filter((F.to_date(ts) > F.date_sub(last, span)) & (F.to_date(ts) <= last))
        .groupBy(F.to_date(ts).alias("day"))
        .agg(*[m.alias(n) for n, m in measures.items()])
    )
    return calendar.join(per_day, "day", "left").na.fill(0, list(measures))


def cost_trend(ledger: DataFrame, today: str, days: int = 30) -> DataFrame:
    out = daily(ledger, "created_at", {"total": F.sum(F.coalesce("est_cost", F.lit(0.0))), "actions": F.count("*")}, today, days)
    return out.withColumn("total", half_up(c("total"), 4))


def scan_trend(scans: DataFrame, today: str, days: int = 30) -> DataFrame:
    return daily(scans, "started_at", {"scans": F.count("*"), "findings": F.sum("total_findings")}, today, days)


def weekly_delta(series: DataFrame, value: str) -> DataFrame:
    """Last seven points minus the seven before, per day; null below 14 points or when both are zero.
    The series has one row per day, so a single ordered window is small."""
    w = Window.orderBy("day")
    last7 = F.sum(value).over(w.rowsBetween(-6, 0))
    prev7 = F.sum(value).over(w.rowsBetween(-13, -7))
    enough = F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)) >= 14
    delta = F.when(enough & ~((last7 == 0) & (prev7 == 0)), half_up(last7 - prev7, 2))
    return series.select("day", delta.alias("delta"))


def _or(col_: str, default: str) -> Column:
    return F.when(F.trim(col_) != "", c(col_)).otherwise(default)


def defect_metrics(links: DataFrame) -> DataFrame:
    """Totals, and counts by severity, category and service, in one pass over grouping sets."""
    done = F.lower(F.coalesce("status_category", F.lit(""))) == "done"
    rows = links.select(
        _or("severity", "UNKNOWN").alias("severity"),
        _or("status_category", "unsynced").alias("category"),
        _or("service", "unknown").alias("service"),
        done.alias("done"),
    )
    dims = ["severity", "category", "service"]
    sets = rows.groupingSets([[c(d)] for d in dims] + [[]], *[c(d) for d in dims])
    agg = sets.agg(
        F.count("*").alias("total"), F.count_if(c("done")).alias("closed"), F.grouping_id().alias("gid")
    )
    dim = F.when(c("gid") == 3, "severity").when(c("gid") == 5, "category").when(c("gid") == 6, "service").otherwise("all")
    return agg.select(
        dim.alias("dim"),
        F.coalesce("severity", "category", "service", F.lit("all")).alias("value"),
        "total",
        (c("total") - c("closed")).alias("open"),
        "closed",
    )


def aging(links: DataFrame, now: Column) -> DataFrame:
    old = (F.lower(F.coalesce("status_category", F.lit(""))) != "done") & (
        c("created_at") < now - F.expr("INTERVAL '7' DAY")
    )
    return links.agg(F.count_if(F.coalesce(old, F.lit(False))).alias("over_seven_days"))


def price(calls: DataFrame, catalogue: DataFrame, live: DataFrame, mode: str = "USAGE_CREDITS", credit_usd: float = 0.01,
          price_per_request: float = 0.04, cli_counts: bool = False) -> DataFrame:
    """Price ledger rows. Catalogue and live multipliers hold one row per model; the join strategy is left
    to the optimiser, which knows their size."""
    spec = catalogue.select("model", "rate_in", "rate_out", "multiplier")
    joined = calls.join(spec, "model", "left").join(live.select("model", c("multiplier").alias("live")), "model", "left")
    zero = F.lit(0.0)
    credits = (c("tokens_in") / 1e6) * F.coalesce("rate_in", zero) + (c("tokens_out") / 1e6) * F.coalesce("rate_out", zero)
    mult = F.coalesce("live", "multiplier", F.lit(1.0))
    requests = F.greatest(F.lit(1.0), mult) if cli_counts else mult
    usage = mode == "USAGE_CREDITS"
    cost = credits * credit_usd if usage else requests * price_per_request
    return joined.withColumns(
        {
            "requests": zero if usage else F.when(c("cached"), zero).otherwise(requests),
            "cost": F.when(c("cached"), zero).otherwise(half_up(cost, 4)),
        }
    ).drop("live", "rate_in", "rate_out", "multiplier")


def cheapest(catalogue: DataFrame, policy: DataFrame, default_model: str) -> DataFrame:
    """Cheapest enabled model per tier; the primary wins a tie; else the first enabled candidate of the policy,
    else the default. ``policy`` has tier, pos, model; the lowest pos is the primary."""
    enabled = catalogue.filter(c("enabled"))
    primary = first_k(policy, ["tier"], [F.asc("pos")]).select("tier", c("model").alias("primary"))
    at_tier = enabled.join(primary, "tier", "left").withColumn("not_primary", ~c("model").eqNullSafe(c("primary")))
    # On equal cost the primary takes over whenever it is met; otherwise the first one stays.
    best = first_k(at_tier, ["tier"], [F.asc("cost"), F.asc("not_primary"), F.asc("pos")]).select("tier", c("model").alias("best"))
    fallback = first_k(
        policy.join(enabled.select("model").distinct(), "model", "left_semi"), ["tier"], [F.asc("pos")]
    ).select("tier", c("model").alias("fallback"))
    tiers = policy.select("tier").union(catalogue.select("tier")).distinct()
    out = tiers.join(best, "tier", "left").join(fallback, "tier", "left")
    return out.select("tier", F.coalesce("best", "fallback", F.lit(default_model)).alias("model"))


def unit_cost(batch: DataFrame, items: DataFrame) -> DataFrame:
    """Batch cost spread over its items (at least one)."""
    n = items.groupBy("batch").agg(F.count("*").alias("items"))
    per = c("cost") / F.greatest(F.coalesce("items", F.lit(0)), F.lit(1))
    return batch.join(n, "batch", "left").select("batch", F.coalesce("items", F.lit(0)).alias("items"), per.alias("unit_cost"))


# --- executions, trains, strips --------------------------------------------------------------------


def completion(runs: DataFrame) -> DataFrame:
    outcome = rules.normalise_run_status(c("status"))
    agg = runs.groupBy("service").agg(
        F.count("*").alias("total"),
        *[F.count_if(outcome == o).alias(o.lower()) for o in ("PASSED", "FAILED", "BLOCKED", "NOT_RUN")],
    )
    counts = F.concat(
        c("total"), F.lit(" designed · "), c("passed"), F.lit(" passed · "), c("failed"), F.lit(" failed · "),
        c("blocked"), F.lit(" blocked · "), c("not_run"), F.lit(" not run"),
    )
    tail = (
        F.when(c("failed") + c("blocked") > 0, " — NEEDS ATTENTION (failures/blocks must be explained or fixed before release).")
        .when(c("not_run") > 0, " — INCOMPLETE (not every test has been executed).")
        .otherwise(" — ALL PASSED.")
    )
    return agg.withColumn("verdict", F.concat(counts, tail))


def deviations(runs: DataFrame) -> DataFrame:
    """Failed and blocked runs, one row each (the list of a service can be arbitrarily long)."""
    out = runs.withColumn("outcome", rules.normalise_run_status(c("status")))
    return out.filter(c("outcome").isin("FAILED", "BLOCKED"))


TRAIN_BUCKETS = ["fixed", "building", "waiting", "failed", "already_safe", "cancelled"]
NON_TERMINAL = ["AWAITING_CONFIRM", "PLANNING", "CHECKING", "VERIFYING", "OPENING_PRS", "PR_OPEN", "AWAITING_MANUAL_FIX"]
MACHINE_DRIVEN = ["PLANNING", "CHECKING", "VERIFYING", "OPENING_PRS"]
HELD = ["AWAITING_CONFIRM", "AWAITING_MANUAL_FIX"]
HUMAN_WAIT = [*HELD, "PR_OPEN"]


def train_bucket(status: Column) -> Column:
    return (
        F.when(status.isin("DONE", "PR_OPEN"), "fixed")
        .when(status.isin(MACHINE_DRIVEN), "building")
        .when(status.isin(HELD), "waiting")
        .when(status == "FAILED", "failed")
        .when(status == "ALREADY_FIXED", "already_safe")
        .otherwise("cancelled")
    )


def batch_rollup(trains: DataFrame) -> DataFrame:
    bucket = train_bucket(c("status"))
    return trains.groupBy("story", "app").agg(*[F.count_if(bucket == b).alias(b) for b in TRAIN_BUCKETS])


def train_open(steps: DataFrame) -> DataFrame:
    """Open: at least one actionable step (not manual, not failed) and all of those open or merged."""
    actionable = ~c("manual") & (c("status") != "FAILED")
    ready = c("status").isin("PR_OPEN", "MERGED")
    return steps.groupBy("train_id").agg(
        ((F.count_if(actionable) > 0) & (F.count_if(actionable & ~ready) == 0)).alias("open")
    )


def mttr(trains: DataFrame) -> DataFrame:
    """Median days from creation to finish of done trains, one decimal."""
    days = (F.unix_micros(c("finished_at").cast("timestamp")) - F.unix_micros(c("created_at").cast("timestamp"))) / 86400e6
    done = trains.filter((c("status") == "DONE")).select(days.alias("days")).filter(c("days") > 0)
    return exact_median(done, "days", 0.05).select(half_up(c("median"), 1).alias("mttr_days"))


def value_strip(scans: DataFrame, manual_hours: int = 4) -> DataFrame:
    done = scans.filter(F.upper("status") == "COMPLETED")
    minutes = (F.unix_micros(c("finished_at").cast("timestamp")) - F.unix_micros(c("started_at").cast("timestamp"))) / 60e6
    med = exact_median(done.select(minutes.alias("m")).filter(c("m") > 0), "m", 0.25, "value").select(
        F.lit("median_minutes").alias("measure"), "value"
    )
    rest = done.agg(
        (F.sum(F.coalesce("est_cost", F.lit(0.0))) / F.nullif(F.count("*"), F.lit(0))).alias("cost_per_audit"),
        (F.count("*") * manual_hours).cast("double").alias("hours_avoided"),
    )
    return med.unionByName(rest.unpivot([], ["cost_per_audit", "hours_avoided"], "measure", "value"))


def headline(scans: DataFrame, defects: DataFrame, ledger: DataFrame) -> DataFrame:
    """Four headline numbers as rows, each an independent aggregate."""
    newest = latest(
        scans.filter((F.upper("status") == "COMPLETED") & c("release_safe").isNotNull() & c("service").isNotNull()),
        ["service"], "started_at", "seq",
    )
    not_done = F.lower(F.coalesce("status_category", F.lit(""))) != "done"
    parts = {
        "services": scans.agg(F.countDistinct("service").cast("double").alias("value")),
        "open_defects": defects.agg(F.count_if(not_done).cast("double").alias("value")),
        "spend": ledger.agg(F.sum("est_cost").alias("value")),
        "coverage_gaps": newest.agg(F.sum("coverage_gaps").cast("double").alias("value")),
    }
    return _measures(parts)


def _measures(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in parts.items():
        row = df.select(F.lit(name).alias("measure"), F.coalesce(c("value"), F.lit(0.0)).alias("value"))
        out = row if out is None else out.unionByName(row)
    return out


def gauges(scans: DataFrame, ledger: DataFrame, trains: DataFrame, alerts: DataFrame) -> DataFrame:
    """Operations gauges: each table is scanned once."""
    active = c("status").isin(NON_TERMINAL)

    def counts(df: DataFrame, **measures: Column) -> DataFrame:
        row = df.agg(*[m.alias(n) for n, m in measures.items()])
        return row.unpivot([], list(measures), "gauge", "n")

    out = counts(scans, scans_total=F.count("*"))
    for part in (
        counts(ledger, cost_entries_total=F.count("*")),
        counts(trains, trains_total=F.count("*"), trains_inflight=F.count_if(active), trains_failed=F.count_if(c("status") == "FAILED")),
        counts(alerts, alerts_unseen=F.count_if(~c("seen"))),
    ):
        out = out.unionByName(part)
    return out


# --- activity --------------------------------------------------------------------------------------


def activity_items(scans: DataFrame, trains: DataFrame, runs: DataFrame, acks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Scans, trains and generator runs as feed items; finished ones older than the window are dropped."""
    scan_status = (
        F.when((c("status") == "RUNNING") & (c("stage") == "QUEUED"), "QUEUED")
        .when(c("status") == "RUNNING", "RUNNING")
        .when(c("status") == "FAILED", "FAILED")
        .otherwise("COMPLETED")
    )
    s = scans.select(
        c("scan_id").alias("item_id"), F.lit("SCAN").alias("kind"), scan_status.alias("state"), "started_at", "finished_at"
    ).withColumn("attention", c("state") == "FAILED")
    train_status = (
        F.when(c("status") == "DONE", "COMPLETED")
        .when(c("status") == "FAILED", "FAILED")
        .when(c("status").isin(HUMAN_WAIT), "WAITING_FOR_YOU")
        .otherwise("RUNNING")
    )
    t = trains.select(
        c("train_id").alias("item_id"), F.lit("FIX_TRAIN").alias("kind"), train_status.alias("state"),
        c("created_at").alias("started_at"), "finished_at",
        (F.when(c("status").isin(HUMAN_WAIT), c("status") != "PR_OPEN").otherwise(c("status") == "FAILED")).alias("attention"),
    )
    failed = c("build_status") == "FAIL"
    r = runs.select(
        c("run_id").alias("item_id"), F.lit("CODEGEN").alias("kind"), F.when(failed, "FAILED").otherwise("COMPLETED").alias("state"),
        c("created_at").alias("started_at"), c("created_at").alias("finished_at"), F.coalesce(failed, F.lit(False)).alias("attention"),
    )
    items = s.unionByName(t).unionByName(r).withColumn("terminal", c("state").isin("COMPLETED", "FAILED"))
    cutoff = now - F.expr(f"INTERVAL '{int(days)}' DAY")
    live = items.filter(~c("terminal") | F.coalesce(c("finished_at") >= cutoff, F.lit(False)))
    return mark_acked(live, acks)


def mark_acked(items: DataFrame, acks: DataFrame) -> DataFrame:
    flags = acks.filter(F.trim("item_id") != "").select("item_id", F.lit(True).alias("acked")).distinct()
    return items.join(flags, "item_id", "left").withColumn("acked", F.coalesce("acked", F.lit(False)))


def new_acks(requested: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledgements to append: asked for, not blank, not there yet."""
    asked = requested.filter(F.trim("item_id") != "").select("item_id").distinct()
    return asked.join(acks.select("item_id"), "item_id", "left_anti")


def feed(items: DataFrame, limit: int = 50) -> DataFrame:
    """Unfinished first, newest first; the limit is the feature."""
    return items.orderBy(F.asc("terminal"), F.desc_nulls_last("started_at"), F.asc("kind"), F.asc("item_id")).limit(limit)


def activity_sections(items: DataFrame, today: Column) -> DataFrame:
    """Section and its order keys, with the day bucket of finished items."""
    live = c("state").isin("QUEUED", "RUNNING")
    section = F.when(c("attention") & ~c("acked"), "waiting").when(live, "in_progress").otherwise("history")
    day = F.to_date(F.coalesce("finished_at", "started_at"))
    bucket = (
        F.when(day.isNull(), "earlier")
        .when(day == today, "today")
        .when(day == F.date_sub(today, 1), "yesterday")
        .otherwise(F.date_format(day, "yyyy-MM-dd"))
    )
    return items.withColumn("section", section).withColumn("day_bucket", F.when(c("section") == "history", bucket)).orderBy(
        F.expr("CASE section WHEN 'waiting' THEN 0 WHEN 'in_progress' THEN 1 ELSE 2 END"),
        F.expr("CASE WHEN section = 'in_progress' AND state <> 'RUNNING' THEN 1 ELSE 0 END"),
        F.expr("CASE WHEN section = 'waiting' THEN started_at END").asc_nulls_last(),
        F.expr("CASE WHEN section = 'in_progress' THEN started_at END").desc_nulls_last(),
        F.expr("CASE WHEN section = 'history' THEN finished_at END").desc_nulls_last(),
        "item_id",
    )


def bell(items: DataFrame, alerts: DataFrame) -> DataFrame:
    """Open attention items plus unseen alerts, and whether one of those is critical."""
    a = items.agg(F.count_if(c("attention") & ~c("acked")).alias("n")).select("n", F.lit(False).alias("critical"))
    b = alerts.filter(~c("seen")).agg(
        F.count("*").alias("n"), F.coalesce(F.bool_or(F.lower("severity") == "critical"), F.lit(False)).alias("critical")
    )
    return a.unionByName(b).agg(F.sum("n").alias("n"), F.bool_or("critical").alias("critical"))


def decision_queue(blocking: DataFrame, gates: DataFrame, alerts: DataFrame, trains: DataFrame) -> DataFrame:
    parts = {
        "blocking": blocking.agg(F.sum("blocking").cast("double").alias("value")),
        "gates": gates.agg(F.count_if(c("status") == "PENDING").cast("double").alias("value")),
        "alerts": alerts.agg(F.count_if(~c("seen")).cast("double").alias("value")),
        "trains": trains.agg(F.count_if(c("status").isin(HELD)).cast("double").alias("value")),
    }
    return _measures(parts).filter(c("value") > 0).select("measure", c("value").cast("bigint").alias("n"))


def scorecard(services: DataFrame, summary: DataFrame, newest: DataFrame) -> DataFrame:
    """Service table joined to the executive summary and the latest scan."""
    s = summary.select("service", "verdict", "breaking", "blocking")
    n = newest.select("service", "coverage_gaps")
    visibility = F.when(c("coverage_gaps") == 0, "full").when(
        c("coverage_gaps").isNotNull(), F.concat(c("coverage_gaps"), F.lit(" gaps"))
    )
    return services.join(s, "service", "left").join(n, "service", "left").withColumn("visibility", visibility).drop("coverage_gaps")


def fix_story(selections: DataFrame) -> DataFrame:
    """Per application and in total: upgrades by severity."""
    sev = F.upper("severity")
    rows = selections.rollup("app").agg(
        F.count("*").alias("upgrades"),
        *[F.count_if(sev == s).alias(s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW")],
        F.countDistinct("app").alias("apps"),
        F.grouping("app").cast("int").alias("is_total"),
    )

    def many(n: Column, noun: str) -> Column:
        return F.concat(n, F.lit(" " + noun), F.when(n == 1, "").otherwise("s"))

    parts = F.concat_ws(
        ", ", *[F.when(c(s) > 0, F.concat(c(s), F.lit(" " + s))) for s in ("critical", "high", "medium", "low")]
    )
    breakdown = F.when(parts == "", "").otherwise(F.concat(F.lit(" ("), parts, F.lit(")")))
    scope = F.concat(
        F.lit("Scope: "), many(c("apps"), "application"), F.lit(", "), many(c("upgrades"), "dependency upgrade"), breakdown, F.lit(".")
    )
    line = F.concat(c("app"), F.lit(" ("), many(c("upgrades"), "upgrade"), F.lit(")"))
    return rows.withColumn("text", F.when(c("is_total") == 1, scope).otherwise(line))


def fix_story_lines(selections: DataFrame) -> DataFrame:
    """The upgrades of each application, one row each."""
    line = F.concat(
        c("coordinate"), F.lit(" "), c("old_version"), F.lit("->"), c("fixed_in"), F.lit(" ["), F.lower("severity"), F.lit("]")
    )
    return selections.select("app", line.alias("line"))
