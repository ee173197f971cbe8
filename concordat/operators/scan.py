"""A whole scan: from API documents to findings and release verdicts, for many scans at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions import ids
from concordat.operators import contract, findings, schemas
from concordat.operators.portfolio import release_verdict
from concordat.schemas import conform
from concordat.session import cut_lineage, sized_by_rows
from concordat.sources.specmodel import spec_model
from concordat.taxonomy import DISMISSED

c = F.col
_MARK = "\u0001"
HISTORY = ("scan_id", "finding_id", "status", "user_severity", "created_at")


def _models(documents: DataFrame) -> list[dict[str, DataFrame]]:
    """Tables of the documents of side "code", and of side "spec". One model of both, so that each step runs once."""
    sides = documents.filter(c("side").isin("code", "spec"))
    docs = cut_lineage(sides.select("scan_id", F.concat(F.substring("side", 1, 1), "spec_id").alias("spec_id"), "spec_pos", "json"))
    model = {name: cut_lineage(df) for name, df in spec_model(docs).items()}
    side = lambda df, mark: df.filter(c("spec_id").startswith(mark)).withColumn("spec_id", F.expr("substring(spec_id, 2)"))
    return [{name: side(df, mark) for name, df in model.items()} for mark in "cs"]


def _numbered(df: DataFrame) -> DataFrame:
    """Under the key of a comparison: (scan, spec)."""
    return df.withColumn("scan_id", F.concat("scan_id", F.lit(_MARK), "spec_id"))


def _endpoints(model: dict[str, DataFrame], side: str) -> DataFrame:
    rows = conform(model["endpoints"].withColumn("side", F.lit(side)), "endpoints", ("scan_id", "pos", "method", "path", "security", "body"))
    return rows.withColumns({"body_media": c("body.media_types"), "body_ref_present": c("body").isNotNull(), "handler": F.lit(None).cast("string")})


def _bindings(pairs: DataFrame, code: dict[str, DataFrame], spec: dict[str, DataFrame]) -> DataFrame:
    """Schemas that both sides bind to one body or to the first success of one operation."""
    base = pairs.select("scan_id", "pos", "s_pos", "label", "body", "s_body")
    bodies = base.select(
        "scan_id", (c("pos") * 2).alias("binding_id"), F.lit("BODY").alias("kind"), c("label").alias("locus"),
        c("body.schema_ref").alias("code_ref"), c("s_body.schema_ref").alias("spec_ref"),
    )
    first = lambda t, ep, ref: t.filter(c("status").between(200, 299)).groupBy("scan_id", c("ep").alias(ep)).agg(F.min_by("schema_ref", F.struct("status", "pos")).alias(ref))
    answers = base.join(first(code["responses"], "pos", "code_ref"), ["scan_id", "pos"]).join(first(spec["responses"], "s_pos", "spec_ref"), ["scan_id", "s_pos"])
    answers = answers.select("scan_id", (c("pos") * 2 + 1).alias("binding_id"), F.lit("RESPONSE").alias("kind"), c("label").alias("locus"), "code_ref", "spec_ref")
    return bodies.unionByName(answers).filter(c("code_ref").isNotNull() & c("spec_ref").isNotNull())


def compare(code: dict[str, DataFrame], spec: dict[str, DataFrame]) -> list[DataFrame]:
    """Findings of every check between code and spec models, in the order in which their findings take precedence."""
    left, right = cut_lineage(_endpoints(code, "code")), cut_lineage(_endpoints(spec, "spec"))
    blind = code["blind_spots"]
    pairs = cut_lineage(contract.matched(left, right))
    tables = (code["schemas"], code["fields"], spec["schemas"], spec["fields"], spec["blind_spots"])
    bindings = cut_lineage(_bindings(pairs, code, spec))
    bound = schemas.bound_field_diff(bindings, *tables)
    coarse = schemas.coarse_diff(bindings, bound, schemas.structural_verdict(bindings, *tables))
    coarse = coarse.join(bindings.select("scan_id", "binding_id", c("locus").alias("endpoint")), ["scan_id", "binding_id"])
    return [
        contract.key_collisions(right),
        contract.verb_mismatch(left, right),
        contract.missing_endpoints(left, right),
        contract.extra_endpoints(left, right, blind),
        contract.path_var_diff(pairs),
        contract.param_diff(pairs, code["params"], spec["params"], blind),
        contract.body_presence(pairs),
        contract.status_diff(pairs, code["responses"], spec["responses"]),
        contract.security_diff(pairs, blind),
        contract.media_diff(pairs, spec["responses"]),
        contract.error_media_diff(pairs, code["responses"], spec["responses"]),
        bound.findings,
        coarse,
        schemas.field_diff(*tables),
    ]


def _as_findings(df: DataFrame, order: int) -> DataFrame:
    """Findings of one check with their place: the check's, then that of their operation if the check knows it, then one
    that follows from their content."""
    told = F.xxhash64("scan_id", "spec_source", "type", "endpoint", "summary")
    place = c("binding_id") * 4096 + F.pmod(told, F.lit(4096)) if "binding_id" in df.columns else F.pmod(told, F.lit(1 << 55))
    locus = c("spec_locus") if "spec_locus" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"pos": F.lit(order) * F.lit(1 << 55) + place, "spec_locus": locus}).select(
        "scan_id", "spec_source", "type", "endpoint", "summary", "confidence", "spec_locus", "pos"
    )


@sized_by_rows()
def scan(documents: DataFrame, history: DataFrame | None = None, **caps: int) -> tuple[DataFrame, DataFrame]:
    """(findings, verdicts) of documents (scan_id, side, spec_id, spec_pos, json).

    A scan has a document of side "code", which describes what the code offers, and any number of side "spec". Each spec
    is compared with the code and with the other specs. Findings of all checks get one identity, severity by type, are
    merged where they say the same, and where they have one cause, and take over what was decided about them in
    ``history`` (earlier findings: scan_id, finding_id, status, reviewed_by, reviewed_at, user_severity, created_at).
    Findings have the columns of that domain table and ``n_affected``. Every scan has a verdict, also without findings.

    All steps join on (scan and spec, operation, schema or field), so that many scans, and large ones, run as one job;
    their tables compress well, so that it is their rows that tell whether one is broadcast.
    A spec that cannot be read is a finding and is compared with nothing; code that cannot be read has no endpoints. A missing ``history`` is an
    empty one; columns it needs and lacks raise ``ValueError``. Rows without a scan id are left out."""
    documents = documents.filter(c("scan_id").isNotNull() & c("spec_id").isNotNull())
    code, spec = _models(documents)
    readable = cut_lineage(spec["specs"].select("scan_id", "spec_id", "spec_pos").distinct())
    # Code is compared with every spec of its scan.
    left = {name: cut_lineage(_numbered(df.drop("spec_id").join(readable.drop("spec_pos"), "scan_id"))) for name, df in code.items()}
    right = {name: _numbered(df) for name, df in spec.items()}
    parts = contract.l1_findings(
        right["specs"].select(c("scan_id").alias("spec_id"), "openapi", "title", "version"), right["messages"].select(c("scan_id").alias("spec_id"), "message")
    )
    parts = parts.select(c("spec_id").alias("scan_id"), "type", F.lit(None).cast("string").alias("endpoint"), "summary", "confidence")
    told = []
    for i, df in enumerate([parts, *compare(left, right)]):
        names = F.split("scan_id", _MARK, 2)
        # One at a time: as one plan, all checks would be planned, exchanged and broadcast by the driver at once.
        told.append(cut_lineage(_as_findings(df.withColumns({"spec_source": names[1], "scan_id": names[0]}), i)))
    drift = contract.spec_drift(readable, spec["endpoints"])
    told.append(cut_lineage(_as_findings(drift, len(told))))
    rows = told[0]
    for more in told[1:]:
        rows = rows.unionByName(more)
    rows = findings.with_taxonomy(rows).withColumns(
        {"origin": F.lit("DETERMINISTIC"), "ai_disputed": F.lit(False), "finding_id": ids.finding_fingerprint(c("type"), c("endpoint"), c("spec_source"), c("summary"))}
    )
    rows = cut_lineage(conform(rows, "findings", ("scan_id", "type", "summary", "pos")))
    once = findings.dedup_cross(rows).withColumn("pos", c("first_pos")).drop("first_pos")
    kept, _ = findings.collapse_root_cause(cut_lineage(once))
    kept = cut_lineage(kept.drop("rc", "rc_kind"))
    if history is not None:
        missing = [x for x in HISTORY if x not in history.columns]
        if missing:
            raise ValueError(f"history: {', '.join(missing)} missing")
        past = history.select(*HISTORY, *[(c(x) if x in history.columns else F.lit(None)).cast(t).alias(x) for x, t in (("reviewed_by", "string"), ("reviewed_at", "timestamp"))])
        past = past.withColumn("row_id", F.xxhash64("scan_id", "finding_id", "status"))
        kept = cut_lineage(findings.carry_user_severity(findings.carry_disposition(kept, past), past))
    live = kept.filter(c("status").isNull() | ~c("status").isin(DISMISSED))
    verdicts = documents.select("scan_id").distinct().join(release_verdict(live, **caps), "scan_id", "left")
    verdicts = verdicts.na.fill(0).withColumn("verdict", F.coalesce("verdict", F.lit("PASS")))
    return kept, verdicts
