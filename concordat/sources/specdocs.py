"""API documents as JSON text: flattened tables, inherited fields, presence facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import cut_lineage
from concordat.taxonomy import VERBS

c = F.col


def _get(col_: str, path: str, type_: str = "string") -> Column:
    return F.try_variant_get(col_, path, type_)


def _ref(col_: str, path: str = "$.schema") -> Column:
    """Schema name a node refers to, with ``[]`` for arrays."""
    direct = F.regexp_extract(_get(col_, path + "['$ref']"), "([^/]+)$", 1)
    items = F.regexp_extract(_get(col_, path + ".items['$ref']"), "([^/]+)$", 1)
    return F.coalesce(F.nullif(direct, F.lit("")), F.concat(F.nullif(items, F.lit("")), F.lit("[]")))


def _constraints(col_: str, path: str) -> Column:
    """Constraint struct of a schema node. Exclusive bounds may be flags or numbers."""
    ex_min, ex_max = _get(col_, path + ".exclusiveMinimum", "double"), _get(col_, path + ".exclusiveMaximum", "double")
    flag_min, flag_max = _get(col_, path + ".exclusiveMinimum", "boolean"), _get(col_, path + ".exclusiveMaximum", "boolean")
    number_min = ex_min.isNotNull() & flag_min.cast("double").isNotNull() & (ex_min != flag_min.cast("double"))
    number_max = ex_max.isNotNull() & flag_max.cast("double").isNotNull() & (ex_max != flag_max.cast("double"))
    return F.struct(
        _get(col_, path + ".minLength", "int").alias("minLength"),
        _get(col_, path + ".maxLength", "int").alias("maxLength"),
        F.coalesce(_get(col_, path + ".minimum", "double"), F.when(number_min, ex_min)).alias("minimum"),
        F.coalesce(_get(col_, path + ".maximum", "double"), F.when(number_max, ex_max)).alias("maximum"),
        F.when(number_min, F.lit(True)).otherwise(flag_min).alias("exclusiveMin"),
        F.when(number_max, F.lit(True)).otherwise(flag_max).alias("exclusiveMax"),
        _get(col_, path + ".pattern").alias("pattern"),
        _get(col_, path + ".enum", "array<string>").alias("enumValues"),
        _get(col_, path + ".format").alias("format"),
        F.lit(False).alias("enumFromDescription"),
    )


def flatten_specs(specs: DataFrame) -> dict[str, DataFrame]:
    """Documents (spec_id, json) to endpoints, params, responses, schemas and fields, all inside the JVM."""
    spark = specs.sparkSession
    docs = specs.select("spec_id", F.try_parse_json("json").alias("j"))
    verbs = ", ".join(f"'{v}'" for v in VERBS)
    ops = spark.sql(
        f"""SELECT d.spec_id, p.key AS path, upper(v.key) AS method, v.value AS op, d.j
            FROM {{docs}} d, LATERAL variant_explode(try_variant_get(d.j, '$.paths', 'variant')) p, LATERAL variant_explode(p.value) v
            WHERE upper(v.key) IN ({verbs})""",
        docs=docs,
    )
    media = F.map_keys(_get("op", "$.requestBody.content", "map<string,variant>"))
    first_media = F.map_values(_get("op", "$.requestBody.content", "map<string,variant>"))
    body = F.try_element_at(first_media, F.lit(1))
    endpoints = ops.withColumn("_b", body).select(
        "spec_id", "method", "path", _get("op", "$.operationId").alias("operation_id"), media.alias("consumes"),
        _get("op", "$.requestBody.required", "boolean").alias("body_required"), _ref("_b").alias("body_ref"),
    )
    params = spark.sql(
        "SELECT o.spec_id, o.method, o.path, e.pos, e.value AS p FROM {ops} o, LATERAL variant_explode(try_variant_get(o.op, '$.parameters', 'variant')) e",
        ops=ops,
    )
    place = F.upper(F.coalesce(_get("p", "$.in"), F.lit("query")))
    params = params.select(
        "spec_id", "method", "path", "pos", _get("p", "$.name").alias("name"), F.when(place.isin("PATH", "HEADER", "COOKIE"), place).otherwise("QUERY").alias("location"),
        _get("p", "$.schema.type").alias("type"), _get("p", "$.schema.format").alias("format"),
        (F.coalesce(_get("p", "$.required", "boolean"), F.lit(False)) | (place == "PATH")).alias("required"), _constraints("p", "$.schema").alias("constraints"),
    )
    resp = spark.sql(
        "SELECT o.spec_id, o.method, o.path, e.key AS code, e.value AS r FROM {ops} o, LATERAL variant_explode(try_variant_get(o.op, '$.responses', 'variant')) e",
        ops=ops,
    )
    content = _get("r", "$.content", "map<string,variant>")
    resp = resp.withColumn("_m", F.try_element_at(F.map_values(content), F.lit(1))).select(
        "spec_id", "method", "path", "code", c("code").try_cast("int").alias("status"), _ref("_m").alias("schema_ref"), F.map_keys(content).alias("media_types"),
        (_get("_m", "$.example", "variant").isNotNull() | _get("_m", "$.examples", "variant").isNotNull() | _get("_m", "$.schema.example", "variant").isNotNull()).alias("has_example"),
    )
    schemas = spark.sql(
        "SELECT d.spec_id, e.key AS schema, e.value AS s FROM {docs} d, LATERAL variant_explode(try_variant_get(d.j, '$.components.schemas', 'variant')) e",
        docs=docs,
    )
    fields = spark.sql(
        "SELECT s.spec_id, s.schema, s.s, e.pos, e.key AS field, e.value AS f FROM {schemas} s, LATERAL variant_explode(try_variant_get(s.s, '$.properties', 'variant')) e",
        schemas=schemas,
    )
    required = F.coalesce(_get("s", "$.required", "array<string>"), F.array().cast("array<string>"))
    fields = fields.select(
        "spec_id", "schema", "pos", "field", _get("f", "$.type").alias("type"), _get("f", "$.format").alias("format"),
        F.array_contains(required, c("field")).alias("required"),
        F.coalesce(F.nullif(F.regexp_extract(_get("f", "$['$ref']"), "([^/]+)$", 1), F.lit("")),
                   F.concat(F.nullif(F.regexp_extract(_get("f", "$.items['$ref']"), "([^/]+)$", 1), F.lit("")), F.lit("[]"))).alias("ref_schema"),
        _constraints("f", "$").alias("constraints"),
    )
    bases = F.transform(
        F.coalesce(_get("s", "$.allOf", "array<variant>"), F.array().cast("array<variant>")),
        lambda v: F.nullif(F.regexp_extract(F.try_variant_get(v, "$['$ref']", "string"), "([^/]+)$", 1), F.lit("")),
    )
    out_schemas = schemas.select("spec_id", "schema", _get("s", "$.type").alias("type"), _get("s", "$.enum", "array<string>").alias("enum_values"), bases.alias("all_of"))
    return {"endpoints": endpoints, "params": params, "responses": resp, "schemas": out_schemas, "fields": fields}


def presence(tables: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """What the specs of a scan have at all: examples, properties, constraints, error responses.
    ``keys`` maps spec_id to scan_id."""
    cs = c("constraints")
    bound = cs["minLength"].isNotNull() | cs["maxLength"].isNotNull() | cs["minimum"].isNotNull() | cs["maximum"].isNotNull()
    bound = bound | cs["pattern"].isNotNull() | cs["format"].isNotNull() | F.coalesce(F.size(cs["enumValues"]) > 0, F.lit(False))
    r = tables["responses"].groupBy("spec_id").agg(
        F.bool_or("has_example").alias("examples"), F.bool_or(F.coalesce(c("status") >= 400, F.lit(False))).alias("errors")
    )
    f = tables["fields"].groupBy("spec_id").agg(F.lit(True).alias("properties"), F.bool_or(bound).alias("constrained"))
    j = keys.join(r, "spec_id", "left").join(f, "spec_id", "left")
    flags = ("examples", "properties", "constrained", "errors")
    return j.groupBy("scan_id").agg(*[F.coalesce(F.bool_or(n), F.lit(False)).alias(n) for n in flags])


def resolve_allof(schemas: DataFrame, edges: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Effective fields with inheritance, and unresolved references.

    ``edges``: scan_id, schema, pos, base. A property of the schema itself wins, then bases in document order,
    depth first. Every (schema, ancestor) keeps its first position only, so diamonds and cycles do not multiply;
    a round looks at positions that improved in the round before."""
    known = schemas.select("scan_id", "schema").distinct()
    unresolved = edges.join(known.withColumnRenamed("schema", "base"), ["scan_id", "base"], "left_anti").select("scan_id", "schema", "base")
    e = cut_lineage(edges.join(known.withColumnRenamed("schema", "base"), ["scan_id", "base"], "left_semi").select("scan_id", c("schema").alias("node"), "pos", "base"))
    start = known.select("scan_id", "schema", c("schema").alias("node"), F.array().cast("array<int>").alias("path"))
    best = cut_lineage(start)
    frontier = best
    while True:
        step = frontier.join(e, ["scan_id", "node"]).select("scan_id", "schema", c("base").alias("node"), F.array_append("path", c("pos")).alias("path"))
        step = step.groupBy("scan_id", "schema", "node").agg(F.min("path").alias("path"))
        old = best.select("scan_id", "schema", "node", c("path").alias("had"))
        frontier = cut_lineage(
            step.join(old, ["scan_id", "schema", "node"], "left").filter(c("had").isNull() | (c("path") < c("had"))).drop("had")
        )
        if frontier.isEmpty():
            break
        best = cut_lineage(best.unionByName(frontier).groupBy("scan_id", "schema", "node").agg(F.min("path").alias("path")))
    rows = best.join(fields.withColumnRenamed("schema", "node"), ["scan_id", "node"])
    rest = [x for x in fields.columns if x not in ("scan_id", "schema", "field")]
    eff = rows.groupBy("scan_id", "schema", "field").agg(
        F.min_by(F.struct(c("node").alias("declared_in"), *rest), F.struct("path", "pos")).alias("v")
    )
    return eff.select("scan_id", "schema", "field", "v.*"), unresolved
