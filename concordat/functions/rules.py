"""Classification predicates and status vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resolutions that take an issue out of scope.
DESCOPED_RESOLUTIONS = ["won't do", "wont do", "won't fix", "wont fix", "rejected", "declined", "abandoned"]

# Progress of a fix train by phase.
PHASE_PCT = {"PLANNING": 18, "CHECKING": 45, "VERIFYING": 75, "OPENING_PRS": 92}

# Marks of an incomplete code extraction and of centralised security in blind-spot texts.
INCOMPLETE_MARKS = [
    "mappings declared on interfaces are not analysed",
    "request mappings it declares are not analysed",
    "RouterFunction",
    "Functional routing",
    "Kotlin source file(s) declare Spring web routing",
    "coRouter",
]
CENTRAL_SECURITY_MARKS = ["SecurityFilterChain", "HttpSecurity"]
FLATTENED_QUERY_MARKS = ["binds all query params", "@ModelAttribute", "command object", "pagination", "@MatrixVariable"]


def contains_any(text: Column, marks: list[str]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | text.contains(mark)
    return F.coalesce(out, F.lit(False))


def effective_severity(user_severity: Column, severity: Column) -> Column:
    return F.coalesce(user_severity, severity)


def needs_attention(type_: Column, origin: Column, confidence: Column, ai_disputed: Column) -> Column:
    """Left out of the gate: design-only types, generated, low confidence or disputed. Nulls do not exclude."""

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    return (
        sure(type_.isin("DESIGN_QUALITY", "TEST_BASIS_GAP"))
        | sure(F.upper(origin) != "DETERMINISTIC")
        | sure(confidence == "LOW")
        | sure(ai_disputed)
    )


def is_deterministic(origin: Column) -> Column:
    return F.coalesce(F.upper(origin) == "DETERMINISTIC", F.lit(False))


def bucket(type_: Column) -> Column:
    return F.when(type_.contains("MISSING"), "MISSING").when(type_.contains("EXTRA"), "DEAD").otherwise("WRONG")


def lifecycle(resolution: Column, category: Column) -> Column:
    descoped = F.lower(F.trim(resolution)).isin(DESCOPED_RESOLUTIONS)
    return (
        F.when(descoped, "DESCOPED")
        .when(category == "done", "DONE")
        .when(category == "indeterminate", "IN_PROGRESS")
        .when(category == "new", "TO_DO")
    )


def normalise_run_status(status: Column) -> Column:
    s = F.upper(F.coalesce(status, F.lit("")))
    return (
        F.when(s.contains("PASS"), "PASSED")
        .when(s.contains("FAIL"), "FAILED")
        .when(s.contains("BLOCK") | s.contains("ABORT"), "BLOCKED")
        .otherwise("NOT_RUN")
    )


def normalise_automation(raw: Column) -> Column:
    v = F.upper(F.trim(raw))
    return (
        F.when(v.isin("AUTOMATED", "AUTOMATE", "AUTO"), "AUTOMATED").when(v == "MANUAL", "MANUAL").otherwise("CANDIDATE")
    )


def is_non_testable(summary: Column) -> Column:
    return F.coalesce(
        F.lower(summary).rlike(r"\b(spike|investigat|research|chore|infra|documentation)\b|\[doc"), F.lit(False)
    )


def is_high_risk(level: Column) -> Column:
    v = F.upper(F.trim(F.coalesce(level, F.lit(""))))
    return v.contains("HIGH") | v.isin("VH", "H")


def security_expr(access: Column, roles: Column) -> Column:
    """Expression text of a security rule; null for rules that restrict nothing."""

    def call(single: str, many: str) -> Column:
        quoted = F.array_join(F.transform(roles, lambda r: F.concat(F.lit("'"), r, F.lit("'"))), ", ")
        return F.concat(F.when(F.size(roles) > 1, many).otherwise(single), F.lit("("), quoted, F.lit(")"))

    return (
        F.when(access == "AUTHENTICATED", F.lit("authenticated"))
        .when(access == "DENY_ALL", F.lit("denyAll"))
        .when(access == "ROLE", call("hasRole", "hasAnyRole"))
        .when(access == "AUTHORITY", call("hasAuthority", "hasAnyAuthority"))
    )


def valid_coordinate(coordinate: Column) -> Column:
    """``group:artifact`` of safe characters only."""
    return F.coalesce(coordinate.rlike(r"^[A-Za-z0-9._-]+:[A-Za-z0-9._-]+$"), F.lit(False))


def phase_pct(status: Column, failed_stage: Column) -> Column:
    by_phase = F.create_map(*[F.lit(x) for kv in PHASE_PCT.items() for x in kv])

    def lookup(key: Column) -> Column:
        return F.try_element_at(by_phase, F.coalesce(key, F.lit("")))

    return (
        F.when(status.isin("DONE", "PR_OPEN", "MERGED"), 100)
        .when(status == "AWAITING_MANUAL_FIX", 92)
        .when(status == "FAILED", F.coalesce(lookup(failed_stage), F.lit(8)))
        .otherwise(F.coalesce(lookup(status), F.lit(6)))
    )


def usage_flags(build_text: Column, artifacts: dict[str, str]) -> dict[str, Column]:
    """Which framework parts a build file uses: a version property or an artifact id, by part."""
    flags = {
        f"uses_{part}": F.coalesce(
            build_text.contains(f"<{artifact}.version>") | build_text.contains(f"<artifactId>{artifact}</artifactId>"),
            F.lit(False),
        )
        for part, artifact in artifacts.items()
    }
    any_part = F.lit(False)
    for c in flags.values():
        any_part = any_part | c
    return {**flags, "uses_any": any_part}
