"""Operators on findings: taxonomy, attention, filters, clean-up chain, carry-forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.functions import ids, paths, rules, text
from concordat.operators.containment import first_held
from concordat.operators.windows import first_k
from concordat.taxonomy import BREAKING_TYPES, DEFAULT_STANDARD, SEVERITIES, severity_rank, taxonomy

c = F.col


def with_taxonomy(findings: DataFrame) -> DataFrame:
    """Attach layer, severity, breaking flag and standard by type; unknown types are UNSPECIFIED."""
    dim = taxonomy(findings.sparkSession)
    kept = findings.drop("layer", "severity", "breaking", "standard")
    joined = kept.join(F.broadcast(dim), "type", "left")
    return joined.withColumns(
        {
            "layer": F.coalesce("layer", F.lit("L4")),
            "severity": F.coalesce("severity", F.lit("UNSPECIFIED")),
            "breaking": F.coalesce("breaking", F.lit(False)),
            "standard": F.coalesce("standard", F.lit(DEFAULT_STANDARD)),
        }
    )


def with_attention(findings: DataFrame) -> DataFrame:
    c = F.col
    flag = rules.needs_attention(c("type"), c("origin"), c("confidence"), c("ai_disputed"))
    return findings.withColumn("attention", flag)


def filter_findings(
    findings: DataFrame, severity: str | None = None, layer: str | None = None, status: str | None = None
) -> DataFrame:
    """Case-insensitive filters; blank means no filter. Stored values are upper case, so plain
    equality on the upper-cased argument reaches the scan."""
    out = findings
    for column, wanted in (("severity", severity), ("layer", layer), ("status", status)):
        if wanted and wanted.strip():
            out = out.filter(F.col(column) == wanted.upper())
    return out


def strip_disclaimers(findings: DataFrame, blind_scans: DataFrame, default: str = text.NO_DISCLAIMER_LEFT) -> DataFrame:
    """Remove false missing-source sentences from generated findings of scans without blind spots."""
    marked = findings.join(
        blind_scans.select("scan_id", F.lit(True).alias("_blind")).distinct(), "scan_id", "left"
    )
    c = F.col
    hit = (
        c("_blind").isNull()
        & c("origin").isNotNull()
        & ~rules.is_deterministic(c("origin"))
        & (text.claims_missing_source(c("summary")) | text.claims_missing_source(c("explanation")))
    )
    return marked.withColumns(
        {
            name: F.when(hit, text.drop_missing_source(c(name), default)).otherwise(c(name))
            for name in ("summary", "explanation")
        }
    ).drop("_blind")


def breaking(type_: Column) -> Column:
    return F.coalesce(type_.isin(BREAKING_TYPES), F.lit(False))


def order_findings(findings: DataFrame) -> DataFrame:
    """Findings by scan, severity rank and position."""
    ranked = findings.withColumn("rank", severity_rank(F.col("severity")))
    return ranked.orderBy("scan_id", F.asc_nulls_last("rank"), "pos")


SPEC_LOCUS_TYPES = ["SCHEMA_FIELD_MISSING", "SCHEMA_FIELD_EXTRA", "SCHEMA_FIELD_TYPE_MISMATCH"]


def all_findings(*sources: DataFrame) -> DataFrame:
    """Union of the finding sources of a scan; position keeps the order of sources, then rows."""
    out = None
    for i, df in enumerate(sources):
        part = df.withColumns({"source_order": F.lit(i), "pos": F.lit(i) * F.lit(10**15) + c("pos")})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def dedup_cross(findings: DataFrame) -> DataFrame:
    """One row per scan, type, endpoint, spec and normalised summary.

    The first deterministic row wins over a generated one that came earlier and takes its texts where it has
    none. Both picks are aggregates, so copies are combined before the shuffle."""
    det = rules.is_deterministic(c("origin"))
    empty = F.lit("")
    key = [
        c("scan_id"), c("type"), F.coalesce("endpoint", empty).alias("_e"),
        F.coalesce("spec_source", empty).alias("_s"), text.norm_summary(c("summary")).alias("_n"),
    ]
    row = F.struct(*findings.columns)
    agg = findings.groupBy(*key).agg(
        F.min_by(row, F.struct(~det, c("pos"))).alias("w"),
        F.min_by(F.struct("explanation", "proposed_fix", det.alias("det")), c("pos")).alias("f"),
        F.min("pos").alias("first_pos"),
    )
    fill = rules.is_deterministic(c("w.origin")) & ~c("f.det")
    out = agg.select("w.*", "f", "first_pos", fill.alias("_fill"))
    for name in ("explanation", "proposed_fix"):
        out = out.withColumn(name, F.when(c("_fill"), F.coalesce(c(name), c("f")[name])).otherwise(c(name)))
    return out.drop("f", "_fill")


def root_cause_key(df: DataFrame) -> DataFrame:
    """``rc``: shared schema field, else code line with summary, else null (never collapses).

    ``rc_kind`` (S, C or null) says the same cheaply; filters use it, so they do not repeat the text work."""
    none = F.lit("")
    schema = F.concat_ws("|", F.lit("S"), "type", F.coalesce("spec_source", none), "spec_locus")
    code = F.concat_ws(
        "|", F.lit("C"), "type", F.coalesce("spec_source", none), "code_file",
        F.coalesce(c("code_line").cast("string"), none), text.norm_summary(c("summary")),
    )
    by_schema = c("type").isin(SPEC_LOCUS_TYPES) & c("spec_locus").isNotNull()
    by_code = c("code_file").isNotNull()
    kind = F.when(by_schema, "S").when(by_code, "C")
    return df.withColumns({"rc_kind": kind, "rc": F.when(by_schema, schema).when(by_code, code)})


def affected_endpoints(findings: DataFrame) -> DataFrame:
    """Distinct endpoints per root cause with their first position; schema causes count HTTP endpoints only."""
    f = root_cause_key(findings).filter(c("rc_kind").isNotNull() & c("endpoint").isNotNull())
    f = f.filter((c("rc_kind") == "C") | paths.is_http_endpoint(c("endpoint")))
    return f.groupBy("scan_id", "rc", "endpoint").agg(F.min("pos").alias("first_pos"))


def collapse_root_cause(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Survivors, and the endpoints of collapsed ones as rows (a list could be arbitrarily long)."""
    f = root_cause_key(findings)
    eps = affected_endpoints(findings)
    n = eps.groupBy("scan_id", "rc").agg(F.count("*").alias("n_affected"))
    counted = eps.withColumn("_n", F.count("*").over(Window.partitionBy("scan_id", "rc")))
    keyed = f.filter(c("rc_kind").isNotNull())
    first = first_k(keyed, ["scan_id", "rc"], [F.asc("pos")]).join(n, ["scan_id", "rc"], "left")
    many, by_schema = F.coalesce(c("n_affected") > 1, F.lit(False)), c("rc_kind") == "S"
    locus = F.split("spec_locus", "#", 2)
    field = F.coalesce(F.try_element_at(locus, F.lit(2)), c("spec_locus"))
    lead = F.concat(F.lit("Field '"), field, F.lit("' of shared spec schema '"), locus[0], F.lit("' is "))
    rewritten = F.when(c("type") == "SCHEMA_FIELD_MISSING", F.concat(lead, F.lit("in code but missing from the spec schema"))).when(
        c("type") == "SCHEMA_FIELD_EXTRA", F.concat(lead, F.lit("in the spec but not in code"))
    )
    shared = many & by_schema
    survivors = first.withColumns(
        {
            "finding_id": F.when(shared, ids.finding_fingerprint(c("type"), c("spec_source"), c("spec_locus"))).otherwise(c("finding_id")),
            "summary": F.when(shared, F.coalesce(rewritten, c("summary"))).otherwise(c("summary")),
            "n_affected": F.when(many, c("n_affected")),
        }
    )
    rest = f.filter(c("rc_kind").isNull()).withColumn("n_affected", F.lit(None).cast("bigint"))
    affected = counted.filter((c("_n") > 1) & c("scan_id").isNotNull()).drop("_n")
    return survivors.unionByName(rest), affected


def latest_prior(history: DataFrame, cols: list[str]) -> DataFrame:
    """Per fingerprint, the newest row and the newest row of another scan than that one.

    Whatever scan asks, one of the two is the newest row of a different scan."""
    order = F.struct("created_at", "row_id")
    per_scan = history.groupBy("finding_id", "scan_id").agg(
        F.max_by(F.struct("scan_id", *cols), order).alias("v"), F.max(order).alias("o")
    )
    top = first_k(per_scan, ["finding_id"], [F.desc("o")], 2, "r")
    return top.groupBy("finding_id").agg(
        F.max(F.when(c("r") == 1, c("v"))).alias("p1"), F.max(F.when(c("r") == 2, c("v"))).alias("p2")
    )


def _with_prior(findings: DataFrame, history: DataFrame, cols: list[str]) -> DataFrame:
    j = findings.join(latest_prior(history, cols), "finding_id", "left")
    return j.withColumn("prior", F.when(c("p1.scan_id") != c("scan_id"), c("p1")).otherwise(c("p2"))).drop("p1", "p2")


def carry_disposition(findings: DataFrame, history: DataFrame) -> DataFrame:
    """Take over the newest decided status of the same fingerprint from another scan."""
    past = history.filter(c("status").isNotNull() & (c("status") != "OPEN"))
    cols = ["status", "reviewed_by", "reviewed_at"]
    j = _with_prior(findings, past, cols)
    hit = c("prior").isNotNull()
    return j.withColumns({n: F.when(hit, c("prior")[n]).otherwise(c(n)) for n in cols}).drop("prior")


def carry_user_severity(findings: DataFrame, history: DataFrame) -> DataFrame:
    """Take over the newest human severity; own overrides stay, unknown names are ignored."""
    j = _with_prior(findings, history.filter(c("user_severity").isNotNull()), ["user_severity"])
    valid = F.when(c("prior.user_severity").isin(SEVERITIES), c("prior.user_severity"))
    return j.withColumn("user_severity", F.coalesce("user_severity", valid)).drop("prior")


def carry_dispute_verdict(findings: DataFrame, history: DataFrame) -> DataFrame:
    """Take over the newest dispute verdict; reviewer fields are filled only when empty."""
    cols = ["dispute_verdict", "reviewed_by", "reviewed_at"]
    j = _with_prior(findings, history.filter(c("dispute_verdict").isNotNull()), cols)
    hit = c("prior").isNotNull()
    fill = hit & c("reviewed_at").isNull()
    return j.withColumns(
        {
            "dispute_verdict": F.when(hit, c("prior.dispute_verdict")).otherwise(c("dispute_verdict")),
            "reviewed_by": F.when(fill, c("prior.reviewed_by")).otherwise(c("reviewed_by")),
            "reviewed_at": F.when(fill, c("prior.reviewed_at")).otherwise(c("reviewed_at")),
        }
    ).drop("prior")


def graft(findings: DataFrame, enrich: DataFrame, disputes: DataFrame) -> DataFrame:
    """Attach texts and disputes by finding id; existing text wins, only counted deterministic rows are disputed."""
    e = enrich.select("finding_id", c("explanation").alias("_e"), c("proposed_fix").alias("_p"))
    d = disputes.select("finding_id", c("reason").alias("_r"))
    j = with_attention(findings).join(e, "finding_id", "left").join(d, "finding_id", "left")
    hit = c("_r").isNotNull() & rules.is_deterministic(c("origin")) & ~c("attention")
    return j.withColumns(
        {
            "explanation": F.coalesce("explanation", "_e"),
            "proposed_fix": F.coalesce("proposed_fix", "_p"),
            "ai_dispute_reason": F.when(hit, c("_r")).otherwise(c("ai_dispute_reason")),
            "ai_disputed": c("ai_disputed") | hit,
        }
    ).drop("_e", "_p", "_r", "attention")


def attach_fragment(findings: DataFrame, specs: DataFrame) -> DataFrame:
    """The block of the first spec (by ``spec_pos``) that has the finding's path as a key.

    Keys are read off the spec lines once, so paths meet specs by an equi-join; the block is cut out of the
    line array of its own row, up to the next non-blank line that is not indented deeper."""
    lines = specs.filter(F.trim("content") != "").withColumn("lines", F.split("content", "\n"))
    keys = lines.select("scan_id", "spec_pos", F.posexplode("lines").alias("i", "line"))
    bare = text.strip(c("line"))
    named = F.regexp_replace(F.regexp_replace(bare, ":$", ""), "^([\"'])(.*)\\1$", "$2")
    keys = keys.filter(bare.endswith(":")).select("scan_id", "spec_pos", "i", named.alias("path"))
    wanted = findings.filter(c("endpoint").isNotNull()).select(
        "scan_id", "endpoint", F.trim(F.when(c("endpoint").contains(" "), F.expr("substr(endpoint, instr(endpoint, ' ') + 1)")).otherwise(c("endpoint"))).alias("path")
    )
    wanted = wanted.filter(c("path") != "").distinct()
    starts = keys.join(wanted.select("scan_id", "path").distinct(), ["scan_id", "path"], "left_semi")
    best = starts.groupBy("scan_id", "path").agg(F.min(F.struct("spec_pos", "i")).alias("at"))
    cut = best.select("scan_id", "path", c("at.spec_pos").alias("spec_pos"), c("at.i").alias("i")).join(
        lines.select("scan_id", "spec_pos", "lines"), ["scan_id", "spec_pos"]
    )

    def indent(line):
        return F.length(line) - F.length(F.ltrim(line))

    own = F.element_at("lines", c("i") + 1)
    rest = F.slice("lines", c("i") + 2, F.size("lines"))
    ends = F.transform("rest", lambda x: ~x.rlike(r"^\s*$") & (indent(x) <= c("ind")))
    stop = F.array_position(ends, F.lit(True))
    cut = cut.withColumns({"own": own, "rest": rest, "ind": indent(own)}).withColumn("stop", stop)
    body = F.when(c("stop") > 0, F.slice("rest", F.lit(1), (c("stop") - 1).cast("int"))).otherwise(c("rest"))
    frag = F.regexp_replace(F.array_join(F.concat(F.array("own"), body), "\n"), r"\s+$", "")
    frags = wanted.join(cut.select("scan_id", "path", frag.alias("fragment")), ["scan_id", "path"]).select("scan_id", "endpoint", "fragment")
    return findings.join(frags, ["scan_id", "endpoint"], "left")


def phantom_check(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Downgrade free-text findings whose endpoint holds no known path of the scan. Scans without known
    paths are not second-guessed."""
    low = F.lower("endpoint")
    hay = findings.filter(F.trim("endpoint") != "").select(c("scan_id").alias("grp"), low.alias("text"))
    needles = known.filter(F.trim("path") != "").select(c("scan_id").alias("grp"), c("path").alias("text"), F.lit(0).alias("rank"))
    hits = first_held(hay, needles).select(c("grp").alias("scan_id"), c("hay").alias("_h"), F.lit(True).alias("_hit"))
    has = known.select("scan_id", F.lit(True).alias("_any")).distinct()
    j = findings.withColumn("_h", low).join(hits, ["scan_id", "_h"], "left").join(has, "scan_id", "left")
    phantom = F.coalesce(F.trim("endpoint") != "", F.lit(False)) & c("_any").isNotNull() & c("_hit").isNull()
    note = F.concat(F.lit("[unverified endpoint — '"), c("endpoint"), F.lit("' is not a parsed API endpoint] "), F.coalesce("explanation", F.lit("")))
    return j.withColumns(
        {
            "phantom": phantom,
            "severity": F.when(phantom, "INFO").otherwise(c("severity")),
            "explanation": F.when(phantom & paths.is_http_endpoint(c("endpoint")), note).otherwise(c("explanation")),
        }
    ).drop("_h", "_hit", "_any")


def bind_evidence(findings: DataFrame, schemas: DataFrame, fields: DataFrame) -> DataFrame:
    """Locate a free-text finding: by its schema and field pointer, or by a schema named as the endpoint.
    A pointer that does not resolve binds nothing."""
    f = fields.filter(c("source").isNotNull()).groupBy("scan_id", c("schema").alias("code_schema"), c("field").alias("code_field")).agg(
        F.min_by("source", "pos").alias("f_src")
    )
    s = schemas.filter(c("source").isNotNull()).select("scan_id", c("schema").alias("endpoint"), c("source").alias("s_src"))
    j = findings.join(f, ["scan_id", "code_schema", "code_field"], "left").join(s, ["scan_id", "endpoint"], "left")
    pointed = c("code_schema").isNotNull() & c("code_field").isNotNull()
    by_field = pointed & c("f_src").isNotNull()
    by_schema = ~pointed & c("s_src").isNotNull()
    return j.withColumns(
        {
            "evidence": F.when(by_field, c("f_src")).when(by_schema, c("s_src")),
            "spec_locus": F.when(by_field, F.concat("code_schema", F.lit("#"), "code_field")).when(by_schema, c("endpoint")),
        }
    ).drop("f_src", "s_src")


def defects_to_create(findings: DataFrame, defects: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings whose defect has not been created yet, with service and severity."""
    done = defects.filter(c("created")).select("finding_id")
    return findings.join(done, "finding_id", "left_anti").join(scans.select("scan_id", "service"), "scan_id", "left")


def sync_status(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Created links that are not done, with the tracker's status; changed when name or category differs."""
    live = links.filter(c("created") & (c("jira_key") != "") & (F.lower(F.coalesce("status_category", F.lit(""))) != "done"))
    j = live.join(statuses.select("jira_key", c("name").alias("new_name"), c("category").alias("new_category")), "jira_key")
    changed = ~c("status_name").eqNullSafe(c("new_name")) | ~c("status_category").eqNullSafe(c("new_category"))
    return j.withColumn("changed", changed)
