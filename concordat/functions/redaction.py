"""Redaction of secrets and personal data, eight ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns, applied in this order: (name, pattern, replacement, digit bounds of a Luhn gate or None).
RULES = [
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\b", "[REDACTED-TOKEN]", None),
    (
        "cloud_token",
        r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[0-9A-Za-z]{36,}\b|\bAIza[0-9A-Za-z_-]{35}\b|\bsk-[A-Za-z0-9]{20,}\b"
        r"|\bxox[baprs]-[0-9A-Za-z-]{10,}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----",
        "[REDACTED-SECRET]",
        None,
    ),
    ("auth_header", r"(?i)\b(?:bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", "[REDACTED-AUTH]", None),
    (
        "secret_assign",
        r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b\s*[:=]\s*\S+",
        "[REDACTED-SECRET]",
        None,
    ),
    ("card", r"\b\d[\d -]{11,21}\d\b", "[REDACTED-PAN]", (13, 19)),
    ("national_id", r"\b\d{3}[ -]?\d{3}[ -]?\d{3}\b", "[REDACTED-SIN]", (9, 9)),
    ("email", r"\b[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}\b", "[REDACTED-EMAIL]", None),
    (
        "ipv4",
        r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
        "[REDACTED-IP]",
        None,
    ),
]


def _has(text: Column, *parts: str) -> Column:
    """Whether one of the parts occurs."""
    found = F.contains(text, F.lit(parts[0]))
    for part in parts[1:]:
        found = found | F.contains(text, F.lit(part))
    return found


# What a text must have for a rule to find anything: plain parts and short patterns, told faster than the rule.
NEEDS = {
    "jwt": lambda x: _has(x, "eyJ"),
    "cloud_token": lambda x: _has(x, "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AIza", "sk-", "xox", "PRIVATE KEY-----"),
    "auth_header": lambda x: _has(F.lower(x), "bearer", "basic"),
    "secret_assign": lambda x: _has(x, ":", "=") & _has(F.lower(x), "api", "secret", "token", "password", "passwd", "pwd"),
    "card": lambda x: x.rlike("[0-9][0-9 -]{11}"),
    "national_id": lambda x: x.rlike("[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}"),
    "email": lambda x: x.rlike(r"@[A-Za-z0-9-]{1,63}\."),
    "ipv4": lambda x: x.rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
}


def luhn(digits: Column) -> Column:
    """Luhn check; false for null or empty."""
    return F.coalesce(F.call_function("luhn_check", digits), F.lit(False))


def _passes(match: Column, bounds: tuple[int, int]) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.length(digits).between(*bounds) & luhn(digits)


def _gated(text: Column, pattern: str, repl: str, bounds: tuple[int, int]) -> tuple[Column, Column]:
    """Replace only the matches that pass the gate, keeping the text between matches as it is."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern)
    rebuilt = F.array_join(
        F.zip_with(
            pieces,
            hits,
            lambda p, h: F.concat(
                p, F.coalesce(F.when(_passes(h, bounds), F.lit(repl)).otherwise(h), F.lit(""))
            ),
        ),
        "",
    )
    count = F.size(F.filter(hits, lambda h: _passes(h, bounds)))
    return rebuilt, count


def redact(df: DataFrame, text: str, out: str = "redacted", prefix: str = "n_") -> DataFrame:
    """Add the redacted text and one hit count per rule (``n_<rule>``).

    Each rule sees the text left by the rule before it, so the steps are stacked projections;
    the optimiser keeps them apart because a merged projection would repeat the regex work. A rule looks only at texts
    that have what it needs, and rewrites only those in which it has found something.
    """
    cur = df.withColumn(out, F.col(text))
    for name, pattern, repl, bounds in RULES:
        source, hits = F.col(out), F.col(prefix + name)
        if bounds is None:
            counted, replaced = F.regexp_count(source, F.lit(pattern)), F.regexp_replace(source, pattern, repl)
        else:
            replaced, counted = _gated(source, pattern, repl, bounds)
        cur = cur.withColumn(prefix + name, F.coalesce(F.when(NEEDS[name](source), counted), F.lit(0)))
        cur = cur.withColumn(out, F.when(hits > 0, replaced).otherwise(source))
    return cur


def redact_columns(prefix: str = "n_") -> list[str]:
    return [prefix + r[0] for r in RULES]
