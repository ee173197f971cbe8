"""Fixed vocabularies of the finding model, and the 25-row taxonomy dimension."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Severities in rank order, most severe first.
SEVERITIES = ["BLOCKER", "CRITICAL", "MAJOR", "MINOR", "INFO", "UNSPECIFIED"]

# HTTP verbs in enum order.
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "TRACE"]

# Fixed values: (type, layer, severity, breaking, governing standard).
FINDING_TYPES = [
    ("OPENAPI_PARSE_ERROR", "L1", "BLOCKER", True, "OpenAPI Specification — document structure"),
    ("UNRESOLVED_REF", "L1", "BLOCKER", True, "OpenAPI Specification — document structure"),
    ("MISSING_INFO_FIELD", "L1", "INFO", False, "OpenAPI Specification — document structure"),
    ("MISSING_ENDPOINT", "L2", "CRITICAL", True, "OpenAPI Specification — Paths & Operations"),
    ("EXTRA_ENDPOINT", "L3", "MINOR", False, "OpenAPI Specification — Paths & Operations"),
    ("VERB_MISMATCH", "L4", "CRITICAL", True, "RFC 9110 — HTTP methods"),
    ("PATH_VAR_NAME_MISMATCH", "L4", "MINOR", False, "OpenAPI Specification — Paths & Operations"),
    ("PARAM_MISSING", "L4", "MAJOR", False, "OpenAPI Specification — Parameter Object"),
    ("PARAM_EXTRA", "L4", "MINOR", False, "OpenAPI Specification — Parameter Object"),
    ("PARAM_TYPE_MISMATCH", "L4", "MAJOR", True, "OpenAPI Specification — Parameter Object"),
    ("PARAM_REQUIRED_MISMATCH", "L4", "MAJOR", True, "OpenAPI Specification — Parameter Object"),
    ("REQUEST_BODY_PRESENCE_MISMATCH", "L4", "MAJOR", True, "OpenAPI Specification — Request Body Object"),
    ("REQUEST_BODY_SCHEMA_MISMATCH", "L4", "MAJOR", True, "OpenAPI Specification — Request Body Object"),
    ("STATUS_CODE_MISSING", "L4", "MAJOR", False, "RFC 9110 — HTTP status codes"),
    ("STATUS_CODE_EXTRA", "L4", "MINOR", False, "RFC 9110 — HTTP status codes"),
    ("RESPONSE_SCHEMA_MISMATCH", "L4", "MAJOR", True, "OpenAPI Specification — Responses & Schema Object"),
    ("SCHEMA_FIELD_MISSING", "L4", "MAJOR", False, "OpenAPI Specification — Schema Object"),
    ("SCHEMA_FIELD_EXTRA", "L4", "MINOR", False, "OpenAPI Specification — Schema Object"),
    ("SCHEMA_FIELD_TYPE_MISMATCH", "L4", "MAJOR", True, "OpenAPI Specification — Schema Object"),
    ("CONSUMES_PRODUCES_MISMATCH", "L4", "MINOR", False, "RFC 9110 — content negotiation (media types)"),
    ("CONSTRAINT_GAP", "L4", "MAJOR", True, "JSON Schema validation (OpenAPI Schema Object)"),
    ("SECURITY_MISMATCH", "L4", "CRITICAL", True, "OpenAPI Specification — Security Requirement Object"),
    ("SPEC_DRIFT", "L3", "MINOR", False, "OpenAPI Specification — document structure"),
    ("DESIGN_QUALITY", "L4", "INFO", False, "REST API design guidelines"),
    ("TEST_BASIS_GAP", "L4", "INFO", False, "ISTQB CTFL — test basis adequacy"),
]

DEFAULT_STANDARD = "OpenAPI Specification"
BREAKING_TYPES = [t[0] for t in FINDING_TYPES if t[3]]

# Dispositions. The verdict drops DISMISSED; distinct counts drop NOT_CAUGHT only.
DISMISSED = ["REJECTED", "FALSE_POSITIVE", "WONT_FIX"]
NOT_CAUGHT = ["REJECTED", "FALSE_POSITIVE"]


def taxonomy(spark: SparkSession) -> DataFrame:
    """The taxonomy as a 25-row dimension (fixed size, safe to broadcast)."""
    return spark.createDataFrame(
        FINDING_TYPES, "type string, layer string, severity string, breaking boolean, standard string"
    )


def severity_rank(severity: Column) -> Column:
    """0 for BLOCKER … 5 for UNSPECIFIED, null for unknown names."""
    return reduce(
        lambda acc, item: acc.when(severity == item[1], F.lit(item[0])),
        list(enumerate(SEVERITIES))[1:],
        F.when(severity == SEVERITIES[0], F.lit(0)),
    )


def verb_rank(method: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERBS]), method)
