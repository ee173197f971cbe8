"""Text normal forms, tokens, estimates and sentence filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never count as a hint.
STOP_WORDS = [
    "the", "and", "for", "with", "from", "into", "this", "that", "api", "service", "endpoint",
    "get", "post", "put", "patch", "delete", "request", "response", "returns", "should", "must", "via",
    "user", "users", "account", "accounts", "data", "system", "management", "customer", "profile", "value",
]

# Fixed pattern: an upper-case value list in prose, two values or more.
PROSE_ENUM = r"\[\s*([A-Z][A-Z0-9_]*(?:\s*,\s*[A-Z][A-Z0-9_]*)+)\s*\]"

# Fixed pattern: a sentence saying the source was not at hand.
MISSING_SOURCE = (
    r"(?i)(?<![\w-])sources?\b[^.;]{0,40}\bnot\s+(supplied|provided|available)\b"
    r"|(?i)\bnot\s+(supplied|provided|available)\b[^.;]{0,40}(?<![\w-])sources?\b"
)

# Fixed pattern: review gaps about attributes the reviewer never saw.
UNSCOREABLE_GAP = (
    r"(?i)(traceab|linked requirement|requirement (id|key|link|reference|trace)|not (traced|linked)|"
    r"priorit|preconditions?|postconditions?|risk (level|rating|mapping|coverage|id))"
)

NO_DISCLAIMER_LEFT = "All referenced sources were parsed for this scan."


def strip(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def title_fp(title: Column) -> Column:
    """Lower case, runs of other characters to one space, trimmed; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), F.lit(""))


def norm_blank(text: Column) -> Column:
    """Stripped, single blanks, lower case; null is empty."""
    return F.coalesce(F.lower(F.regexp_replace(strip(text), r"\s+", " ")), F.lit(""))


def norm_summary(summary: Column) -> Column:
    # Most summaries are normal: looking costs less than replacing every blank by itself.
    blanks = F.when(summary.rlike(r"[\t\n\x0B\f\r]| {2}"), F.regexp_replace(summary, r"\s+", " ")).otherwise(summary)
    return F.coalesce(F.trim(F.regexp_replace(blanks, "[.;:,]+$", "")), F.lit(""))


def est_tokens(text: Column) -> Column:
    """About four characters per token, rounded up; 0 for null or empty."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 4).cast("bigint")


def trim_middle(text: Column, budget: int) -> Column:
    """Keep 60 % from the head and the rest from the tail, with a marker for what was left out."""
    if budget <= 0:
        return text
    head = int(budget * 0.6)
    tail = max(0, budget - head - 60)
    cut = F.length(text) - head - tail
    short = F.concat(
        F.substr(text, F.lit(1), F.lit(head)),
        F.lit("\n…["),
        cut.cast("string"),
        F.lit(" chars elided to fit the context budget]…\n"),
        F.right(text, F.lit(tail)),
    )
    return F.when(F.length(text) > budget, short).otherwise(text)


def _keep(tokens: Column) -> Column:
    return F.filter(F.array_distinct(tokens), lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def hints_text(text: Column) -> Column:
    """Distinct tokens of three characters or more, without stop words, in order."""
    return _keep(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"))


def hints_path(path: Column) -> Column:
    """The same from the literal segments of a path template."""
    literal = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: ~s.startswith("{"))
    return _keep(F.flatten(F.transform(literal, lambda s: F.split(F.lower(s), "[^a-z0-9]+"))))


def stem(token: Column) -> Column:
    """Plural-only stemmer with length guards. Most tokens have no plural ending and are told by the first test, as each
    use of the token in the others lowers it again."""
    t = F.lower(F.coalesce(token, F.lit("")))
    n = F.length(t)
    es = t.endswith("ses") | t.endswith("xes") | t.endswith("zes") | t.endswith("ches") | t.endswith("shes")
    return (
        F.when(~t.endswith("s"), t)
        .when((n > 4) & t.endswith("ies"), F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & es, F.substr(t, F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~t.endswith("ss") & ~t.endswith("us"), F.substr(t, F.lit(1), n - 1))
        .otherwise(t)
    )


def stem_all(tokens: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(tokens, F.array().cast("array<string>")), stem))


def prose_enum(description: Column) -> Column:
    """Values listed as ``[A, B]`` in a description, or null."""
    inner = F.regexp_extract(description, PROSE_ENUM, 1)
    return F.when(inner != "", F.split(inner, r"\s*,\s*"))


def strip_citation(citation: Column) -> Column:
    """Drop section markers and trailing dotted numbers."""
    c = F.regexp_replace(citation, r"\s*\(?§\s*\d+(?:\.\d+)*\)?", "")
    return strip(F.regexp_replace(c, r"\s+\d+(?:\.\d+)+\s*$", ""))


def mask(text: Column, secrets: list[str]) -> Column:
    """Given secrets, then bearer and basic credentials, become ``***``."""
    out = text
    for secret in secrets:
        if secret and secret.strip():
            out = F.replace(out, F.lit(secret), F.lit("***"))
    out = F.regexp_replace(out, r"(?i)(bearer)\s+\S+", "$1 ***")
    return F.regexp_replace(out, r"(?i)(basic)\s+\S+", "$1 ***")


def claims_missing_source(text: Column) -> Column:
    return F.coalesce(text.rlike(MISSING_SOURCE), F.lit(False))


def drop_missing_source(text: Column, default: str = NO_DISCLAIMER_LEFT) -> Column:
    """Remove the sentences that claim a missing source; a default sentence if nothing is left."""
    kept = F.filter(F.split(text, r"(?<=[.;])\s+"), lambda s: ~s.rlike(MISSING_SOURCE))
    cleaned = strip(F.array_join(kept, " "))
    return F.when(text.isNull(), F.lit(None)).when(cleaned == "", F.lit(default)).otherwise(cleaned)


def suppress_gaps(gaps: Column) -> Column:
    """Struct of the gap texts kept and the number dropped."""
    kept = F.filter(gaps, lambda g: ~F.coalesce(g.rlike(UNSCOREABLE_GAP), F.lit(False)))
    return F.struct(kept.alias("kept"), (F.size(gaps) - F.size(kept)).alias("dropped"))


def contradicts(summary: Column, examples: Column, properties: Column, constraints: Column, errors: Column) -> Column:
    """Does a summary claim absence of something the specs do have?"""
    s = F.lower(F.coalesce(summary, F.lit("")))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | s.contains(w)
        return out

    absent = has("no ", "not ", "without", "missing", "absent", "lacks", "none")
    says = [
        (has("example"), examples),
        (has("propert", "field"), properties),
        (has("constraint"), constraints),
        (has("error response", "error code", "error status"), errors),
    ]
    any_claim, all_false = F.lit(False), F.lit(True)
    for claim, present in says:
        any_claim = any_claim | claim
        all_false = all_false & (~claim | present)
    return absent & any_claim & all_false


def status_in(summary: Column) -> Column:
    """First 3xx–5xx status in a summary, or null."""
    m = F.regexp_extract(summary, r"\b([3-5]\d\d)\b", 1)
    return F.when(m != "", m.cast("int"))
