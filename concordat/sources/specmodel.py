"""API documents as the tables that the contract operators read: references followed, compositions merged, and what the
model leaves out listed as blind spots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.paths import join_base, server_base
from concordat.functions.text import prose_enum
from concordat.session import cut_lineage
from concordat.sources.specdocs import _constraints, _get
from concordat.taxonomy import VERBS

c = F.col
DOC = ["scan_id", "spec_id"]
def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _no_nodes() -> Column:
    return F.array().cast("array<variant>")


def ref_name(ref: Column) -> Column:
    """What stands behind the last slash of a reference; null for null."""
    return F.nullif(F.regexp_extract(ref, r"([^/]*)$", 1), F.lit(""))


def _bound(node: str, path: str = "$", wrapped: bool = True) -> Column:
    """Name of the schema that a node binds to: its reference, ``X[]`` for a list of X, or a wrapper of one reference."""
    direct, items = ref_name(_get(node, path + "['$ref']")), ref_name(_get(node, path + ".items['$ref']"))
    out = [direct, F.concat(items, F.lit("[]"))]
    if wrapped:
        only = F.when(F.size(_get(node, path + ".allOf", "array<variant>")) == 1, ref_name(_get(node, path + ".allOf[0]['$ref']")))
        out.append(only)
    return F.coalesce(*out)


def components(docs: DataFrame) -> DataFrame:
    """Every reusable node of the documents: scan_id, spec_id, section, name, node."""
    return docs.sparkSession.sql(
        """SELECT d.scan_id, d.spec_id, s.key AS section, n.key AS name, n.value AS node
           FROM {docs} d, LATERAL variant_explode(try_variant_get(d.j, '$.components', 'variant')) s, LATERAL variant_explode(s.value) n""",
        docs=docs,
    )


def resolve_references(nodes: DataFrame) -> DataFrame:
    """(scan_id, spec_id, section, name, final, state) of nodes that are references themselves: the node at the end of
    the chain, and "ok", "missing" (the chain leaves the document) or "cycle".

    ``nodes``: scan_id, spec_id, section, name, target (null: not a reference). Every round doubles the length of the
    jumps, so a chain of n references takes log2(n) equi-joins; a round that ends no chain leaves cycles only."""
    key = [*DOC, "section"]
    hops = nodes.filter(c("target").isNotNull())
    # Chains end at nodes that are no references or are not there.
    known = nodes.select(*key, c("name").alias("target"), c("target").isNotNull().alias("more"))
    hops = hops.join(known, [*key, "target"], "left")
    hops = cut_lineage(hops.select(*key, "name", "target", F.coalesce("more", F.lit(False)).alias("more"), c("more").isNull().alias("missing")))
    open_ = hops.filter("more").count()
    while open_:
        far = hops.select(*key, c("name").alias("target"), c("target").alias("t"), c("more").alias("m"), c("missing").alias("x"))
        step = hops.filter("more").join(far, [*key, "target"]).select(*key, "name", c("t").alias("target"), c("m").alias("more"), c("x").alias("missing"))
        hops = cut_lineage(hops.filter("NOT more").unionByName(step))
        left = hops.filter("more").count()
        if left == open_:
            break
        open_ = left
    state = F.when(c("more"), "cycle").when(c("missing"), "missing").otherwise("ok")
    return hops.select(*key, "name", c("target").alias("final"), state.alias("state"))


def _followed(rows: DataFrame, node: str, section: str, nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with ``node`` replaced by the node that it refers to, through any number of references. One that leads
    nowhere stays as it is, with the name of the reference in ``lost`` and the reason in ``lost_why``."""
    rows = rows.withColumn("_ref", ref_name(_get(node, "$['$ref']")))
    end = ends.filter(c("section") == section).select(*DOC, c("name").alias("_ref"), c("final"), c("state"))
    rows = rows.join(end, [*DOC, "_ref"], "left").withColumn("_to", F.when(c("state").isNull() | (c("state") == "ok"), F.coalesce("final", "_ref")))
    found = nodes.filter(c("section") == section).select(*DOC, c("name").alias("_to"), c("node").alias("_node"))
    rows = rows.join(found, [*DOC, "_to"], "left")
    gone = c("_ref").isNotNull() & c("_node").isNull()
    rows = rows.withColumns(
        {node: F.coalesce("_node", node), "lost": F.when(gone, c("_ref")), "lost_why": F.when(gone, F.when(c("state") == "cycle", "cycle").otherwise("missing"))}
    )
    return rows.drop("_ref", "_to", "_node", "final", "state")


def _content(node: str, path: str = "$.content") -> Column:
    return _get(node, path, "map<string,variant>")


def _content_schema(content: Column) -> Column:
    """Schema of a JSON media type, else of the first that has one. Media types are in the order of their names."""
    with_schema = F.filter(F.map_entries(content), lambda e: F.try_variant_get(e["value"], "$.schema", "variant").isNotNull())
    json = F.filter(with_schema, lambda e: F.lower(e["key"]).contains("json"))
    return F.try_variant_get(F.coalesce(F.get(json, F.lit(0)), F.get(with_schema, F.lit(0)))["value"], "$.schema", "variant")


def _schema_ref(node: str) -> Column:
    """Name of a body's schema: its reference, ``X[]``, or its plain type; null for lists of anything else."""
    return F.coalesce(_bound(node, "$", wrapped=False), F.nullif(_get(node, "$.type"), F.lit("array")))


def _operations(docs: DataFrame) -> DataFrame:
    """One row per operation. Positions follow the spec's position, then paths and verbs by name."""
    verbs = ", ".join(f"'{v}'" for v in VERBS)
    base = server_base(F.transform(F.coalesce(_get("j", "$.servers", "array<variant>"), _no_nodes()), lambda s: F.try_variant_get(s, "$.url", "string")))
    docs = docs.withColumns({"base": base, "global": _get("j", "$.security", "array<map<string,variant>>")})
    ops = docs.sparkSession.sql(
        f"""SELECT d.scan_id, d.spec_id, d.spec_pos * 4294967296 + p.pos * 16 + v.pos % 16 AS pos, d.base, d.global, p.key AS raw,
                   upper(v.key) AS method, v.value AS op, try_variant_get(p.value, '$.parameters', 'variant') AS shared
            FROM {{docs}} d, LATERAL variant_explode(try_variant_get(d.j, '$.paths', 'variant')) p, LATERAL variant_explode(p.value) v
            WHERE upper(v.key) IN ({verbs})""",
        docs=docs,
    )
    return ops.withColumn("path", join_base(c("base"), c("raw"))).drop("raw", "base")


def _spots(rows: DataFrame, when: Column, *parts) -> DataFrame:
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return rows.filter(when).select(*DOC, text.alias("text"))


def _lost(rows: DataFrame, what: str) -> DataFrame:
    why = F.when(c("lost_why") == "cycle", "is part of a cycle").otherwise("is not in the document")
    return _spots(rows, c("lost").isNotNull(), f"Spec {what} reference '", c("lost"), "' ", why, "; it is not compared.")


def _endpoints(ops: DataFrame, nodes: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Endpoints, responses and their blind spots."""
    bodies = _followed(ops.select(*DOC, "pos", _get("op", "$.requestBody", "variant").alias("b")).filter(c("b").isNotNull()), "b", "requestBodies", nodes, ends)
    content = _content("b")
    body_rows = bodies.filter(content.isNotNull()).withColumn("s", _content_schema(content))
    body = F.struct(_schema_ref("s").alias("schema_ref"), F.coalesce(_get("b", "$.required", "boolean"), F.lit(False)).alias("required"), F.map_keys(content).alias("media_types"))
    body_rows = body_rows.select(*DOC, "pos", body.alias("body"))
    coded = ops.sparkSession.sql(
        """SELECT o.scan_id, o.spec_id, o.pos AS ep, o.method, o.path, e.pos, e.key AS code, e.value AS r
           FROM {ops} o, LATERAL variant_explode(try_variant_get(o.op, '$.responses', 'variant')) e""",
        ops=ops,
    )
    coded = _followed(coded, "r", "responses", nodes, ends).withColumn("status", F.trim("code").try_cast("int"))
    spots = [
        _lost(bodies, "request body"),
        _lost(coded, "response"),
        _spots(coded, c("status").isNull(), "Spec response '", c("code"), "' on ", c("method"), " ", c("path"), " is a range/default key, not a concrete status code — not compared."),
    ]
    told = coded.filter(c("status").isNotNull()).withColumns({"content": _content("r"), "s": _content_schema(_content("r"))})
    responses = told.select(*DOC, "ep", "pos", "status", _schema_ref("s").alias("schema_ref"), F.map_keys("content").alias("media_types"), F.lit("SPEC").alias("origin"))
    good = responses.filter(c("status").between(200, 299)).groupBy(*DOC, c("ep").alias("pos"))
    # The media types of an operation's successes: a handful.
    produces = good.agg(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(c("pos").alias("at"), "media_types"))), lambda x: F.coalesce(x["media_types"], _no_strings())))).alias("produces"))
    own = _get("op", "$.security", "array<map<string,variant>>")
    # An own list, even an empty one, replaces that of the document.
    rules = F.when(_get("op", "$.security", "variant").isNotNull(), F.coalesce(own, F.array().cast("array<map<string,variant>>"))).otherwise(c("global"))
    rules = F.coalesce(rules, F.array().cast("array<map<string,variant>>"))
    ops = ops.withColumns({"schemes": F.flatten(F.transform(rules, lambda r: F.coalesce(F.map_keys(r), _no_strings()))), "open": F.exists(rules, lambda r: r.isNull() | (F.size(r) == 0))})
    optional = c("open") & (F.size("schemes") > 0)
    spots.append(
        _spots(ops, optional, "Spec ", c("method"), " ", c("path"), " declares OPTIONAL security (an empty {} alternative alongside [", F.array_join("schemes", ", "),
               "]) — anonymous access is permitted, so it is not compared as required.")
    )
    found = ops.join(body_rows, [*DOC, "pos"], "left").join(produces, [*DOC, "pos"], "left")
    endpoints = found.select(
        *DOC, "pos", "method", "path", _get("op", "$.operationId").alias("operation_id"), F.coalesce("body.media_types", _no_strings()).alias("consumes"),
        F.coalesce("produces", _no_strings()).alias("produces"), F.when(optional, _no_strings()).otherwise(c("schemes")).alias("security"), "body",
    )
    return endpoints, responses, spots


def _params(ops: DataFrame, nodes: DataFrame, ends: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Parameters of operations: their own, then those of the path that none of their own replaces."""
    rows = ops.sparkSession.sql(
        """SELECT o.scan_id, o.spec_id, o.pos AS ep, o.path, 0 AS shared, e.pos, e.value AS p
           FROM {ops} o, LATERAL variant_explode(try_variant_get(o.op, '$.parameters', 'variant')) e
           UNION ALL SELECT o.scan_id, o.spec_id, o.pos, o.path, 1, e.pos, e.value FROM {ops} o, LATERAL variant_explode(o.shared) e""",
        ops=ops,
    )
    rows = _followed(rows, "p", "parameters", nodes, ends)
    place = F.upper(F.coalesce(_get("p", "$.in"), F.lit("query")))
    rows = rows.withColumns({"name": _get("p", "$.name"), "location": F.when(place.isin("PATH", "HEADER", "COOKIE"), place).otherwise("QUERY")})
    own = rows.filter(c("shared") == 0).select(*DOC, "ep", "name", "location").distinct()
    rows = rows.filter(c("shared") == 0).unionByName(rows.filter(c("shared") == 1).join(own, [*DOC, "ep", "name", "location"], "left_anti").select(rows.columns))
    spots = [
        _lost(rows, "parameter"),
        _spots(rows, F.coalesce(F.lower(_get("p", "$.style")) == "deepobject", F.lit(False)), "Spec parameter '", F.coalesce("name", F.lit("null")), "' on ", c("path"),
               " uses deepObject serialization, which is not modelled against the code binding."),
    ]
    first = F.filter(F.map_values(_content("p")), lambda m: F.try_variant_get(m, "$.schema", "variant").isNotNull())
    rows = rows.withColumn("s", F.coalesce(_get("p", "$.schema", "variant"), F.try_variant_get(F.get(first, F.lit(0)), "$.schema", "variant"))).drop("lost", "lost_why")
    rows = _followed(rows, "s", "schemas", nodes, ends)
    spots.append(_lost(rows, "parameter schema"))
    formal = _constraints("s", "$")
    prose = F.when(F.size(F.coalesce(formal["enumValues"], _no_strings())) == 0, prose_enum(_get("p", "$.description")))
    rows = rows.withColumns({"formal": formal, "prose": prose})
    constraints = c("formal").withField("enumValues", F.coalesce("prose", "formal.enumValues")).withField("enumFromDescription", c("prose").isNotNull())
    params = rows.select(
        *DOC, "ep", (c("shared") * 1_000_000 + c("pos")).cast("int").alias("pos"), "name", "location", _get("s", "$.type").alias("type"), _get("s", "$.format").alias("format"),
        (F.coalesce(_get("p", "$.required", "boolean"), F.lit(False)) | (c("location") == "PATH")).alias("required"), constraints.alias("constraints"),
    )
    return params, spots


def first_paths(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(scan_id, spec_id, schema, node, path): every schema that ``schema`` takes properties from, itself included, by
    the path of positions on which a walk in document order, depth first, meets it first.

    ``edges``: scan_id, spec_id, node, pos, base. One row per pair, so diamonds and cycles do not multiply; a round
    extends what was new or came nearer in the round before, and only that is written."""
    pair = [*DOC, "schema", "node"]
    edges = cut_lineage(edges)
    rounds = [cut_lineage(known.select(*DOC, "schema", c("schema").alias("node"), F.array().cast("array<int>").alias("path")))]
    if edges.isEmpty():
        return rounds[0]
    while True:
        step = rounds[-1].join(edges, [*DOC, "node"]).select(*DOC, "schema", c("base").alias("node"), F.array_append("path", c("pos")).alias("path"))
        step = step.groupBy(*pair).agg(F.min("path").alias("path"))
        for old in rounds:  # as many as compositions are deep
            had = old.select(*pair, c("path").alias("had"))
            step = step.join(had, pair, "left").filter(c("had").isNull() | (c("path") < c("had"))).drop("had")
        step = cut_lineage(step)
        if step.isEmpty():
            break
        rounds.append(step)
    best = rounds[0]
    for found in rounds[1:]:
        best = best.unionByName(found)
    return best.groupBy(*pair).agg(F.min("path").alias("path"))


def _schemas(nodes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Schemas, their effective fields, and blind spots.

    A schema's own properties win, then those of its allOf members in document order, depth first: inline members as
    they stand, referenced ones with all they are composed of. A member that is a scalar, is not in the document or
    holds another allOf leaves the schema incomplete, and every schema that takes properties from it."""
    s = nodes.filter(c("section") == "schemas").select(*DOC, c("name").alias("schema"), "node")
    members = _get("node", "$.allOf", "array<variant>")
    props = _get("node", "$.properties", "variant")
    scalar = props.isNull() & members.isNull() & (_get("node", "$.enum", "variant").isNotNull() | F.coalesce(_get("node", "$.type") != "object", F.lit(False)))
    s = cut_lineage(s.withColumns({"members": members, "scalar": scalar}))
    parts = s.select(*DOC, "schema", F.posexplode("members").alias("pos", "m"))
    some = F.size(F.coalesce(_get("m", "$.properties", "map<string,variant>"), F.expr("map()").cast("map<string,variant>"))) > 0
    parts = parts.withColumns({"inline": some, "base": F.when(~some, ref_name(_get("m", "$['$ref']")))})
    bases = parts.filter(c("base").isNotNull()).select(*DOC, c("schema").alias("node"), "pos", "base")
    target = s.select(*DOC, c("schema").alias("base"), "scalar")
    bases = bases.join(target, [*DOC, "base"], "left")
    usable = F.coalesce(~c("scalar"), F.lit(False))
    nested = parts.filter(~c("inline") & c("base").isNull() & _get("m", "$.allOf", "variant").isNotNull()).select(*DOC, c("schema").alias("node"))
    bad = bases.filter(~usable).select(*DOC, "node").unionByName(nested).distinct()
    reach = cut_lineage(first_paths(s.select(*DOC, "schema"), bases.filter(usable).select(*DOC, "node", "pos", "base")))
    incomplete = reach.join(bad, [*DOC, "node"]).select(*DOC, "schema", F.lit(True).alias("incomplete")).distinct()

    listed = _get("node", "$.required", "array<string>")
    here = s.select(*DOC, c("schema").alias("node"), F.array().cast("array<int>").alias("at"), props.alias("props"), F.coalesce(listed, _no_strings()).alias("required"), F.lit(None).cast("array<string>").alias("fallback"))
    whole = s.select(*DOC, "schema", F.coalesce(listed, _no_strings()).alias("outer"))
    inner = parts.filter("inline").join(whole, [*DOC, "schema"]).select(
        *DOC, c("schema").alias("node"), F.array("pos").alias("at"), _get("m", "$.properties", "variant").alias("props"),
        _get("m", "$.required", "array<string>").alias("required"), c("outer").alias("fallback"),
    )
    given = here.unionByName(inner)
    each = given.sparkSession.sql(
        "SELECT g.scan_id, g.spec_id, g.node, g.at, g.required, g.fallback, e.pos, e.key AS field, e.value AS f FROM {g} g, LATERAL variant_explode(g.props) e", g=given
    )
    leaf = s.filter("scalar").select(*DOC, c("schema").alias("_leaf"), c("node").alias("_value"))
    direct = F.regexp_extract(_bound("f"), r"^(.*[^\]])$", 1)
    each = each.withColumn("_leaf", F.nullif(direct, F.lit(""))).join(leaf, [*DOC, "_leaf"], "left").withColumn("v", F.coalesce("_value", "f"))
    each = cut_lineage(
        each.select(
            *DOC, "node", "at", "required", "fallback", "pos", "field", _get("v", "$.type").alias("type"), _get("v", "$.format").alias("format"),
            _bound("f").alias("ref_schema"), _constraints("v", "$").alias("constraints"), F.coalesce(_get("f", "$.nullable", "boolean"), F.lit(False)).alias("nullable"),
        )
    )
    rows = reach.join(each, [*DOC, "node"]).withColumn("path", F.concat("path", "at"))
    # An inline member without a list of its own takes that of the schema it stands in, where that is the schema asked for.
    needed = F.coalesce("required", F.when(c("node") == c("schema"), c("fallback")), _no_strings())
    value = F.struct("path", "pos", c("node").alias("declared_in"), "type", "format", F.array_contains(needed, c("field")).alias("required"), "ref_schema", "constraints")
    first = rows.withColumn("value", value).groupBy(*DOC, "schema", "field").agg(F.min_by("value", F.struct("path", "pos")).alias("v"))
    fields = first.select(*DOC, "schema", c("v.pos").alias("pos"), "field", "v.type", "v.format", "v.required", "v.ref_schema", "v.constraints", "v.declared_in", c("v.path").alias("path"))

    marks = s.join(incomplete, [*DOC, "schema"], "left")
    free = F.coalesce(F.schema_of_variant(_get("node", "$.additionalProperties", "variant")).startswith("OBJECT"), F.lit(False))
    kinds = F.array_compact(
        F.array(
            *[F.when(_get("node", f"$.{k}", "variant").isNotNull(), F.lit(k)) for k in ("oneOf", "anyOf")],
            F.when(c("incomplete"), F.lit("allOf($ref)")),
            F.when(_get("node", "$.discriminator", "variant").isNotNull(), F.lit("discriminator")),
            F.when(free, F.lit("additionalProperties")),
        )
    )
    marks = marks.withColumn("kinds", kinds)
    nullable = each.filter((F.size("at") == 0) & c("nullable")).select(*DOC, c("node").alias("schema")).distinct()
    spots = [
        _spots(marks, F.size("kinds") > 0, "Spec schema '", c("schema"), "' uses ", F.array_join("kinds", " / "),
               " composition; its composed structure is not fully compared (field-level diff may be incomplete)."),
        _spots(nullable, F.lit(True), "Spec schema '", c("schema"), "' declares nullable propert(ies); nullability (a non-null code field vs a nullable spec field) is not compared — verify it."),
    ]
    schemas = s.select(*DOC, "schema", _get("node", "$.type").alias("type"), _get("node", "$.enum", "array<string>").alias("enum_values"))
    return schemas, fields, spots


def spec_model(specs: DataFrame) -> dict[str, DataFrame]:
    """Documents (scan_id, spec_id, spec_pos, json) as tables: specs, messages, endpoints, params, responses, schemas,
    fields and blind_spots, with the columns that the contract operators read.

    A parameter, body or response that is a reference is followed through any chain of references; so is a parameter's
    schema. Parameters of a path belong to all its operations. A parameter's schema may stand under ``content``, its
    allowed values in the description. A property of a scalar schema takes that schema's type and constraints. Properties
    composed by allOf are merged (see ``_schemas``). Paths carry the base path that all servers share. What is not
    modelled (composition by choice, status ranges, optional security, references that lead nowhere or in a circle, …)
    is told in blind_spots.

    Everything is keyed by (scan_id, spec_id) and a name or an operation, so that one large scan is many keys. Documents
    that are not JSON objects have a row in messages and no others. Names of objects come in the order of their text, as the
    parsed form keeps them. Rows without an id, empty tables: no rows. Other columns are not read."""
    docs = specs.filter(c("scan_id").isNotNull() & c("spec_id").isNotNull())
    docs = docs.select(*DOC, c("spec_pos").cast("bigint").alias("spec_pos"), F.try_parse_json("json").alias("j"))
    good = _get("j", "$.paths", "variant").isNotNull() | _get("j", "$.openapi").isNotNull() | _get("j", "$.components", "variant").isNotNull()
    messages = docs.filter(~good | c("j").isNull()).select(*DOC, F.lit("The document is not a readable API specification").alias("message"))
    docs = docs.filter(good)
    info = docs.select(*DOC, "spec_pos", _get("j", "$.openapi").alias("openapi"), _get("j", "$.info.title").alias("title"), _get("j", "$.info.version").alias("version"))
    nodes = cut_lineage(components(docs))
    ends = resolve_references(nodes.select(*DOC, "section", "name", ref_name(_get("node", "$['$ref']")).alias("target")))
    ops = cut_lineage(_operations(docs))
    endpoints, responses, spots = _endpoints(ops, nodes, ends)
    params, more = _params(ops, nodes, ends)
    schemas, fields, most = _schemas(nodes)
    blind = spots[0]
    for found in spots[1:] + more + most:
        blind = blind.unionByName(found)
    return {"specs": info, "messages": messages, "endpoints": endpoints, "params": params, "responses": responses, "schemas": schemas, "fields": fields, "blind_spots": blind}
