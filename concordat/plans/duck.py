"""Building blocks of the DuckDB twins, written independently of the Spark expressions."""

from __future__ import annotations

B32 = "abcdefghijklmnopqrstuvwxyz234567"


def norm_path(x: str) -> str:
    s = (
        f"replace(regexp_replace(regexp_replace(lower({x}), "
        r"'\{[^{}]*(\{[^{}]*(\{[^{}]*\}[^{}]*)*\}[^{}]*)*\}', chr(1), 'g'), '(?s)\{.*$', chr(1)), chr(1), '{}')"
    )
    s = f"regexp_replace({s}, '/+', '/', 'g')"
    cut = f"CASE WHEN length({s}) > 1 THEN rtrim({s}, '/') ELSE {s} END"
    return f"coalesce(nullif({cut}, ''), '/')"


def norm_blank(x: str) -> str:
    return rf"lower(regexp_replace(regexp_replace(coalesce({x}, ''), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"


def hash8(x: str) -> str:
    n = f"CAST('0x' || substr(sha256({norm_blank(x)}), 1, 10) AS BIGINT)"
    return "concat(" + ", ".join(f"substr('{B32}', CAST((({n} >> {s}) & 31) + 1 AS INTEGER), 1)" for s in range(35, -1, -5)) + ")"


def set_digest(x: str) -> str:
    """Digest of the group's set of ``x``, each given once."""
    part = lambda at: f"CAST(sum(CAST('0x' || substr(sha256({x}), {at}, 15) AS BIGINT)) AS VARCHAR)"
    return hash8(f"concat(count(*), ':', {part(1)}, ':', {part(16)})")


def title_fp(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g'))"


def norm_summary(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'), '[.;:,]+$', ''))"


def stem(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 4 AND {t} LIKE '%ies' THEN substr({t}, 1, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 4 AND regexp_matches({t}, '(s|x|z|ch|sh)es$') THEN substr({t}, 1, length({t}) - 2) "
        f"WHEN length({t}) > 3 AND regexp_matches({t}, '[^su]s$') THEN substr({t}, 1, length({t}) - 1) ELSE {t} END"
    )


STOP = (
    "the and for with from into this that api service endpoint get post put patch delete request response returns "
    "should must via user users account accounts data system management customer profile value"
)


def hints(x: str) -> str:
    """Distinct hint tokens of a text as a list, first occurrence order."""
    toks = f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
    kept = f"list_filter({toks}, lambda t: length(t) >= 3 AND NOT list_contains(string_split('{STOP}', ' '), t))"
    return f"list_filter({kept}, lambda t, i: list_position({kept}, t) = i)"


def stems(x: str) -> str:
    """Distinct stems of a text as a list."""
    toks = f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"
    kept = f"list_filter({toks}, lambda t: length(t) >= 3 AND NOT list_contains(string_split('{STOP}', ' '), t))"
    return f"list_distinct(list_transform({kept}, lambda t: {stem('t')}))"


def hint_set(x: str) -> str:
    """Distinct hint tokens of a text, sorted."""
    toks = f"list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'))"
    return f"list_sort(list_filter({toks}, lambda t: length(t) >= 3 AND NOT list_contains(string_split('{STOP}', ' '), t)))"


SEVERITY_RANK = (
    "CASE {0} WHEN 'BLOCKER' THEN 0 WHEN 'CRITICAL' THEN 1 WHEN 'MAJOR' THEN 2 WHEN 'MINOR' THEN 3 "
    "WHEN 'INFO' THEN 4 WHEN 'UNSPECIFIED' THEN 5 END"
)

BREAKING = (
    "('OPENAPI_PARSE_ERROR','UNRESOLVED_REF','MISSING_ENDPOINT','VERB_MISMATCH','SECURITY_MISMATCH',"
    "'SCHEMA_FIELD_TYPE_MISMATCH','PARAM_TYPE_MISMATCH','PARAM_REQUIRED_MISMATCH','REQUEST_BODY_PRESENCE_MISMATCH',"
    "'REQUEST_BODY_SCHEMA_MISMATCH','RESPONSE_SCHEMA_MISMATCH','CONSTRAINT_GAP')"
)


def attention(p: str = "") -> str:
    return (
        f"(coalesce({p}type IN ('DESIGN_QUALITY','TEST_BASIS_GAP'), false) OR "
        f"coalesce(upper({p}origin) <> 'DETERMINISTIC', false) OR coalesce({p}confidence = 'LOW', false) OR "
        f"coalesce({p}ai_disputed, false))"
    )
