"""Explicit schemas: the parquet tables on disk and the domain tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas are DDL text: readers take it as it is, and no session is needed at import.
SOURCE_TABLES = {
    "region": ("r_regionkey int, r_name string"),
    "nation": ("n_nationkey int, n_name string, n_regionkey int"),
    "customer": ("c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
    "supplier": ("s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double"),
    "part": ("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": ("doc_id bigint, text string, lang string, source string, n_chars bigint"),
    "embeddings": ("vec_id bigint, embedding array<float>, label int"),
    "pages": ("page_id bigint, url string, html string"),
    "benchmark": ("item_id bigint, text string"),
    "labels": ("doc_id bigint, quality int, toxic int"),
    "conversations": ("conv_id bigint, turn bigint, role string, text string"),
}

CONSTRAINTS = (
    "struct<minLength:int,maxLength:int,minimum:double,maximum:double,exclusiveMin:boolean,"
    "exclusiveMax:boolean,pattern:string,enumValues:array<string>,format:string,enumFromDescription:boolean>"
)

DOMAIN_TABLES = {
    "endpoints": (
        "scan_id string, side string, spec_id string, pos bigint, method string, path string, operation_id string, "
        "consumes array<string>, produces array<string>, security array<string>, "
        "body struct<schema_ref:string,required:boolean,media_types:array<string>>, controller string"
    ),
    "params": (
        "scan_id string, side string, spec_id string, ep bigint, pos int, name string, location string, "
        f"type string, format string, required boolean, constraints {CONSTRAINTS}"
    ),
    "responses": (
        "scan_id string, side string, spec_id string, ep bigint, pos int, status int, schema_ref string, "
        "media_types array<string>, origin string"
    ),
    "fields": (
        "scan_id string, side string, spec_id string, schema string, pos int, field string, type string, "
        f"format string, required boolean, ref_schema string, constraints {CONSTRAINTS}"
    ),
    "findings": (
        "scan_id string, finding_id string, pos bigint, type string, layer string, severity string, "
        "confidence string, origin string, endpoint string, affected_endpoints array<string>, spec_locus string, "
        "spec_source string, summary string, explanation string, proposed_fix string, status string, reviewed_by string, "
        "reviewed_at timestamp, ai_disputed boolean, ai_dispute_reason string, dispute_verdict string, "
        "user_severity string, code_file string, code_line int, created_at timestamp"
    ),
    "scans": (
        "scan_id string, service string, status string, stage string, queued_at timestamp, started_at timestamp, "
        "finished_at timestamp, updated_at timestamp, total_findings int, est_cost double, coverage_gaps int, "
        "release_safe string, owner string"
    ),
    "ledger": (
        "id string, skill string, action string, model string, tokens_in bigint, tokens_out bigint, "
        "cached boolean, est_cost double, created_at timestamp"
    ),
    "vulns": (
        "watch_id string, snapshot_id string, taken_at timestamp, project string, issue_id string, severity string, "
        "pkg string, version string, fixed_in string, cvss double, risk_score int, fixable boolean"
    ),
    "units": (
        "id string, source string, type string, title string, text string, lifecycle string, priority string, "
        "links array<string>, hints array<string>"
    ),
}


def conform(df: DataFrame, table: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with exactly the columns of a domain table: missing ones are null unless ``needed``, others are left out.

    The border between sources and operators: a needed column that is not there, or a column whose type is not that
    of the table and does not widen to it, raises ``ValueError`` before anything runs."""
    want = T._parse_datatype_string(DOMAIN_TABLES[table])
    have = {f.name: f.dataType for f in df.schema}
    gone = [n for n in needed if n not in have]
    wrong = [f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in want if f.name in have and not _widens(have[f.name], f.dataType)]
    if gone or wrong:
        raise ValueError(f"{table}: " + "; ".join([f"{n} is missing" for n in gone] + wrong))
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])


def _widens(a: T.DataType, b: T.DataType) -> bool:
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return [f.name for f in a] == [f.name for f in b] and all(_widens(x.dataType, y.dataType) for x, y in zip(a, b, strict=True))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _widens(a.elementType, b.elementType)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    times = (T.TimestampType, T.TimestampNTZType, T.DateType)
    kinds = (whole, times)
    return a == b or isinstance(a, T.NullType) or any(isinstance(a, k) and isinstance(b, k) for k in kinds)
