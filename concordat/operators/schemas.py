"""Schema comparison: same-name fields, binding-driven nested pairs, structural verdicts.

Schemas are keyed by (scan_id, schema). ``schemas`` rows carry type and enum_values; ``fields`` rows carry
pos, field, type, format, required, ref_schema and constraints. Nested comparison works on the graph of distinct
pairs (code schema, spec schema) of a scan: each pair is compared once, whatever the number of paths to it, and paths are
walked only where they lead to a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import contract as ct
from concordat.operators.contract import _emit, _finding, _text
from concordat.operators.graph import closure, union_all
from concordat.operators.windows import first_k
from concordat.session import cut_lineage

c = F.col
PAIR = ["scan_id", "cs", "ss"]
_HERE = "\u0001"  # stands for the place of a pair in what the pair shows by itself


def last_fields(fields: DataFrame) -> DataFrame:
    """One row per field name of a schema; the last declaration wins."""
    return first_k(fields, ["scan_id", "schema", "field"], [F.desc("pos")])


def schema_info(schemas: DataFrame, fields: DataFrame) -> DataFrame:
    """Add whether a schema has fields, and whether it has any structure at all."""
    with_fields = fields.select("scan_id", "schema", F.lit(True).alias("has_fields")).distinct()
    out = schemas.join(with_fields, ["scan_id", "schema"], "left")
    has_fields = F.coalesce("has_fields", F.lit(False))
    return out.withColumns(
        {"has_fields": has_fields, "structureless": ~has_fields & ~ct.has_values(c("enum_values"))}
    )


def suppressed(info: DataFrame, blind_spots: DataFrame) -> DataFrame:
    """Flag spec schemas without structure, except objects that are empty on purpose (no composition)."""
    composed = (
        blind_spots.filter(c("text").contains("composition"))
        .select("scan_id", F.explode(F.regexp_extract_all("text", F.lit("'([^']*)'"), F.lit(1))).alias("schema"))
        .distinct()
        .withColumn("composed", F.lit(True))
    )
    j = info.join(composed, ["scan_id", "schema"], "left")
    empty_on_purpose = F.coalesce(c("type") == "object", F.lit(False)) & c("composed").isNull()
    return j.withColumn("suppressed", c("structureless") & ~empty_on_purpose).drop("composed")


def _spec_side(fields: DataFrame) -> DataFrame:
    s = F.struct("type", "format", "required", "ref_schema", "constraints").alias("s")
    return last_fields(fields).select("scan_id", c("schema").alias("ss"), "field", s)


def compare_fields(pairs: DataFrame, code_fields: DataFrame, spec_fields: DataFrame) -> DataFrame:
    """Field findings of (code schema ``cs``, spec schema ``ss``) pairs under a ``locus``. ``spec_locus`` names the field
    of the spec schema that one edit would mend; types that differ in another way are another place."""
    keep = pairs.columns
    j = pairs.join(code_fields.withColumnRenamed("schema", "cs"), ["scan_id", "cs"])
    j = j.join(_spec_side(spec_fields), ["scan_id", "ss", "field"], "left")
    gone, both = c("s").isNull(), c("s").isNotNull()
    who = _text("Field '", c("field"), "'")
    code_none, spec_none = ct.no_constraints(c("constraints")), ct.no_constraints(c("s.constraints"))
    diff = ct.constraint_diff(c("constraints"), c("s.constraints"), c("type") == "integer", c("s.type") == "integer")
    types_differ = (c("type") != c("s.type")) & (c("type") != "object") & (c("s.type") != "object")
    found = [
        _finding(gone, "SCHEMA_FIELD_MISSING", _text(who, " of ", c("locus"), " is in code but missing from the spec schema"), "HIGH"),
        _finding(both & types_differ, "SCHEMA_FIELD_TYPE_MISMATCH", _text(who, " type — code ", c("type"), " vs spec ", c("s.type")), "MEDIUM"),
        _finding(both & c("required") & ~c("s.required"), "CONSTRAINT_GAP", _text(who, " is required in code but optional in the spec"), "MEDIUM"),
        _finding(both & (c("format") != c("s.format")), "CONSTRAINT_GAP", _text(who, " format — code ", c("format"), " vs spec ", c("s.format")), "LOW"),
        _finding(both & ~code_none & spec_none, "CONSTRAINT_GAP", _text(who, " has code constraints not exposed in the spec"), "MEDIUM"),
        _finding(both & ~code_none & ~spec_none & diff.isNotNull(), "CONSTRAINT_GAP", _text(who, " constraint mismatch — ", diff), "MEDIUM"),
    ]
    place = _text(c("ss"), "#", c("field"))
    kept = [*keep, _text(c("locus"), ".", c("field")).alias("endpoint"), place.alias("_at"), _text(place, "#", c("type"), "~", c("s.type")).alias("_kind")]
    at = F.when(c("type") == "SCHEMA_FIELD_MISSING", c("_at")).when(c("type") == "SCHEMA_FIELD_TYPE_MISMATCH", c("_kind"))
    a = _emit(j, found, *kept).withColumn("spec_locus", at).drop("_at", "_kind")
    extra = pairs.join(spec_fields.withColumnRenamed("schema", "ss"), ["scan_id", "ss"])
    extra = extra.join(code_fields.select("scan_id", c("schema").alias("cs"), "field"), ["scan_id", "cs", "field"], "left_anti")
    b = extra.select(
        *keep, _text(c("locus"), ".", c("field")).alias("endpoint"), F.lit("SCHEMA_FIELD_EXTRA").alias("type"),
        _text("Field '", c("field"), "' of ", c("locus"), " is in the spec but not in code").alias("summary"), F.lit("LOW").alias("confidence"),
        place.alias("spec_locus"),
    )
    return a.unionByName(b)


def field_diff(code_schemas: DataFrame, code_fields: DataFrame, spec_schemas: DataFrame, spec_fields: DataFrame, blind_spots: DataFrame) -> DataFrame:
    """Same-name schemas of both sides; opaque spec schemas are skipped."""
    usable = suppressed(schema_info(spec_schemas, spec_fields), blind_spots).filter(~c("suppressed"))
    pairs = code_schemas.select("scan_id", "schema").join(usable.select("scan_id", "schema"), ["scan_id", "schema"])
    pairs = pairs.select("scan_id", c("schema").alias("cs"), c("schema").alias("ss"), c("schema").alias("locus"))
    return compare_fields(pairs, code_fields, spec_fields).select("scan_id", "type", "endpoint", "summary", "confidence", "spec_locus").distinct()


def _common_fields(nodes: DataFrame, code_last: DataFrame, spec_last: DataFrame) -> DataFrame:
    cf = code_last.select("scan_id", c("schema").alias("cs"), "field", c("type").alias("c_type"), c("ref_schema").alias("c_ref"))
    sf = spec_last.select("scan_id", c("schema").alias("ss"), "field", c("type").alias("s_type"), c("ref_schema").alias("s_ref"))
    return nodes.join(cf, ["scan_id", "cs"]).join(sf, ["scan_id", "ss", "field"])


def _leading_to(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs from which a target is reached along ``edges`` (scan_id, cs, ss, n_cs, n_ss), targets included."""
    back = edges.select("scan_id", "cs", "ss", c("n_cs").alias("t_cs"), c("n_ss").alias("t_ss"))
    return closure(
        targets.select(*PAIR),
        lambda new: back.join(new.select("scan_id", c("cs").alias("t_cs"), c("ss").alias("t_ss")), ["scan_id", "t_cs", "t_ss"]).select(*PAIR),
    )


class BoundDiff:
    """Result of :func:`bound_field_diff`: what each pair shows by itself, and which bindings reach which pairs.

    ``divergent`` names the bindings with a difference on some path; ``findings`` walks the paths."""

    def __init__(self, starts: DataFrame, edges: DataFrame, local: DataFrame, divergent: DataFrame):
        self.starts, self.edges, self.local, self.divergent = starts, edges, local, divergent

    @property
    def findings(self) -> DataFrame:
        """A row per finding and path. Only paths that can still reach a finding are followed, so their number is that
        of the rows returned, not that of all paths of the graph."""
        useful = cut_lineage(_leading_to(self.local, self.edges))
        edges = cut_lineage(self.edges.join(useful.select("scan_id", c("cs").alias("n_cs"), c("ss").alias("n_ss")), ["scan_id", "n_cs", "n_ss"], "left_semi"))
        pair = lambda cs, ss: F.concat(cs, F.lit("|"), ss)
        level = self.starts.join(useful, PAIR, "left_semi").withColumn("visited", F.array(pair("cs", "ss")))
        levels = []
        while True:
            level = cut_lineage(level)
            if level.isEmpty():
                break
            levels.append(level.select("scan_id", "binding_id", "locus", "cs", "ss"))
            nxt = level.join(edges, PAIR).filter(~F.array_contains("visited", pair("n_cs", "n_ss")))
            level = nxt.select(
                "scan_id", "binding_id", _text(c("locus"), ".", c("field")).alias("locus"), c("n_cs").alias("cs"), c("n_ss").alias("ss"),
                F.array_append("visited", pair("n_cs", "n_ss")).alias("visited"),
            )
        spark = self.starts.sparkSession
        paths = union_all(levels) if levels else spark.createDataFrame([], "scan_id string, binding_id bigint, locus string, cs string, ss string")
        at = lambda x: F.replace(c(x), F.lit(_HERE), c("locus")).alias(x)
        return paths.join(self.local, PAIR).select("scan_id", "binding_id", "type", at("endpoint"), at("summary"), "confidence", "spec_locus").distinct()


def bound_field_diff(bindings: DataFrame, code_schemas: DataFrame, code_fields: DataFrame, spec_schemas: DataFrame,
                     spec_fields: DataFrame, blind_spots: DataFrame) -> BoundDiff:
    """Compare nested schemas through the fields that bind them.

    ``bindings``: scan_id, binding_id, locus, code_ref, spec_ref. The visited set is kept per path, so a
    shared nested schema is reported on every path. Pairs of equal names are not emitted here (the same-name
    comparison reports them once) but still count as divergence. The pairs themselves are compared once each.
    """
    code_ok = cut_lineage(schema_info(code_schemas, code_fields).filter(~c("structureless")).select("scan_id", c("schema").alias("cs")))
    spec_ok = suppressed(schema_info(spec_schemas, spec_fields), blind_spots).filter(~c("suppressed"))
    spec_ok = cut_lineage(spec_ok.select("scan_id", c("schema").alias("ss")))
    code_last, spec_last = cut_lineage(last_fields(code_fields)), cut_lineage(last_fields(spec_fields))
    starts = bindings.filter(ct.is_array_ref(c("code_ref")) == ct.is_array_ref(c("spec_ref"))).select(
        "scan_id", "binding_id", "locus", ct.base_name(c("code_ref")).alias("cs"), ct.base_name(c("spec_ref")).alias("ss")
    )
    starts = cut_lineage(starts.join(code_ok, ["scan_id", "cs"]).join(spec_ok, ["scan_id", "ss"]))
    c_arr, s_arr = ct.is_array_ref(c("c_ref")), ct.is_array_ref(c("s_ref"))
    both_refs = c("c_ref").isNotNull() & c("s_ref").isNotNull()

    def below(pairs: DataFrame) -> DataFrame:
        f = _common_fields(pairs, code_last, spec_last).filter(both_refs & (c_arr == s_arr))
        f = f.select(*PAIR, "field", ct.base_name(c("c_ref")).alias("n_cs"), ct.base_name(c("s_ref")).alias("n_ss"))
        return f.join(code_ok.withColumnRenamed("cs", "n_cs"), ["scan_id", "n_cs"]).join(spec_ok.withColumnRenamed("ss", "n_ss"), ["scan_id", "n_ss"])

    pairs = cut_lineage(closure(starts.select(*PAIR), lambda new: below(new).select("scan_id", c("n_cs").alias("cs"), c("n_ss").alias("ss"))))
    edges = cut_lineage(below(pairs).select(*PAIR, "field", "n_cs", "n_ss"))
    here = pairs.withColumn("locus", F.lit(_HERE))
    f = _common_fields(here, code_last, spec_last)
    one_ref = c("c_ref").isNotNull() != c("s_ref").isNotNull()
    ref_type = F.when(c("c_ref").isNotNull(), c("c_type")).otherwise(c("s_type"))
    scalar = F.when(c("c_ref").isNotNull(), c("s_type")).otherwise(c("c_type"))
    shape = F.when(
        c("c_ref").isNotNull(), _text("a nested object/array in code but a scalar (", c("s_type"), ") in the spec")
    ).otherwise(_text("a scalar (", c("c_type"), ") in code but a nested object/array in the spec"))
    arr = F.when(c_arr, "an array in code but a single object in the spec").otherwise("a single object in code but an array in the spec")
    lead = _text("Field '", c("field"), "' of ", c("locus"), " is ")
    kinds = [
        _finding(one_ref & scalar.isNotNull() & (scalar != "object") & F.coalesce(ref_type != "array", F.lit(True)),
                 "SCHEMA_FIELD_TYPE_MISMATCH", _text(lead, shape), "HIGH"),
        _finding(both_refs & (c_arr != s_arr), "SCHEMA_FIELD_TYPE_MISMATCH", _text(lead, arr), "HIGH"),
    ]
    cols = [*PAIR, "type", "endpoint", "summary", "confidence", "spec_locus"]
    how = F.when(one_ref, "nested").otherwise("list")
    mismatches = _emit(f, kinds, *PAIR, _text(c("locus"), ".", c("field")).alias("endpoint"), _text(c("ss"), "#", c("field"), "#", how).alias("spec_locus")).select(*cols)
    compared = cut_lineage(compare_fields(here, code_fields, spec_fields).select(*cols).unionByName(mismatches.withColumn("type", F.concat(F.lit("+"), "type"))).distinct())
    differs = _leading_to(compared.select(*PAIR).distinct(), edges)
    divergent = starts.join(differs, PAIR, "left_semi").select("scan_id", "binding_id").distinct()
    told = c("type").startswith("+")
    local = compared.filter(told | (c("cs") != c("ss"))).withColumn("type", F.regexp_replace("type", r"^\+", ""))
    return BoundDiff(starts, edges, local, divergent)


def _local_failures(pairs: DataFrame, info_c: DataFrame, info_s: DataFrame, code_last: DataFrame, spec_last: DataFrame) -> DataFrame:
    """Pairs (scan_id, cs, ss) that differ by themselves: enum sets, field sets, field types, array-ness."""
    key = ["scan_id", "cs", "ss"]
    ce = info_c.select("scan_id", c("schema").alias("cs"), c("enum_values").alias("c_enum"))
    se = info_s.select("scan_id", c("schema").alias("ss"), c("enum_values").alias("s_enum"))
    p = pairs.join(ce, ["scan_id", "cs"]).join(se, ["scan_id", "ss"])
    c_has, s_has = ct.has_values(c("c_enum")), ct.has_values(c("s_enum"))
    by_enum = p.filter((c_has | s_has) & ~(c_has & s_has & ct.same_set(c("c_enum"), c("s_enum")))).select(*key)
    plain = p.filter(~(c_has | s_has)).select(*key)
    cf = plain.join(code_last.withColumnRenamed("schema", "cs"), ["scan_id", "cs"]).select(
        *key, "field", c("type").alias("c_type"), c("ref_schema").alias("c_ref"), F.lit(1).alias("in_c")
    )
    sf = plain.join(spec_last.withColumnRenamed("schema", "ss"), ["scan_id", "ss"]).select(
        *key, "field", c("type").alias("s_type"), c("ref_schema").alias("s_ref"), F.lit(1).alias("in_s")
    )
    j = cf.join(sf, [*key, "field"], "full")
    typed = c("c_type").isNotNull() & c("s_type").isNotNull() & (c("c_type") != "object") & (c("s_type") != "object")
    bad = (
        c("in_c").isNull()
        | c("in_s").isNull()
        | (typed & (c("c_type") != c("s_type")))
        | (
            c("c_ref").isNotNull() & c("s_ref").isNotNull()
            & (ct.is_array_ref(c("c_ref")) != ct.is_array_ref(c("s_ref")))
        )
    )
    return by_enum.unionByName(j.filter(bad).select(*key)).distinct()


def structural_verdict(roots: DataFrame, code_schemas: DataFrame, code_fields: DataFrame, spec_schemas: DataFrame,
                       spec_fields: DataFrame, blind_spots: DataFrame) -> DataFrame:
    """MATCH, DIFFER or UNRESOLVED per root (scan_id, binding_id, code_ref, spec_ref).

    A root matches when no reachable pair differs by itself. That is a property of the root's pair: pairs that
    differ are found once and followed backwards, and roots look their pair up.
    """
    info_c = cut_lineage(schema_info(code_schemas, code_fields))
    info_s = cut_lineage(suppressed(schema_info(spec_schemas, spec_fields), blind_spots))
    code_last, spec_last = cut_lineage(last_fields(code_fields)), cut_lineage(last_fields(spec_fields))
    r = roots.withColumns({"cs": ct.base_name(c("code_ref")), "ss": ct.base_name(c("spec_ref"))})
    ci = info_c.select("scan_id", c("schema").alias("cs"), c("structureless").alias("c_none"))
    si = info_s.select("scan_id", c("schema").alias("ss"), c("structureless").alias("s_none"), c("suppressed").alias("s_skip"))
    r = r.join(ci, ["scan_id", "cs"], "left").join(si, ["scan_id", "ss"], "left")
    c_scalar = ct.is_scalar_name(c("cs")) & c("c_none").isNull()
    s_scalar = ct.is_scalar_name(c("ss")) & c("s_none").isNull()
    other_real = F.when(c_scalar, ~c("s_none")).otherwise(~c("c_none"))
    early = (
        F.when(ct.is_array_ref(c("code_ref")) != ct.is_array_ref(c("spec_ref")), "DIFFER")
        .when((c_scalar != s_scalar) & F.coalesce(other_real, F.lit(False)), "DIFFER")
        .when(c("c_none").isNull() | c("s_none").isNull() | c("c_none") | c("s_skip"), "UNRESOLVED")
    )
    r = cut_lineage(r.withColumn("early", early).select("scan_id", "binding_id", "cs", "ss", "early"))
    exists_c, exists_s = code_schemas.select("scan_id", c("schema").alias("cs")), spec_schemas.select("scan_id", c("schema").alias("ss"))
    no_enum_c = info_c.filter(~ct.has_values(c("enum_values"))).select("scan_id", c("schema").alias("cs"))
    no_enum_s = info_s.filter(~ct.has_values(c("enum_values"))).select("scan_id", c("schema").alias("ss"))

    def below(pairs: DataFrame) -> DataFrame:
        open_pairs = pairs.join(no_enum_c, ["scan_id", "cs"]).join(no_enum_s, ["scan_id", "ss"])
        f = _common_fields(open_pairs, code_last, spec_last).filter(c("c_ref").isNotNull() & c("s_ref").isNotNull())
        f = f.filter(ct.is_array_ref(c("c_ref")) == ct.is_array_ref(c("s_ref")))
        f = f.select(*PAIR, ct.base_name(c("c_ref")).alias("n_cs"), ct.base_name(c("s_ref")).alias("n_ss"))
        return f.join(exists_c.withColumnRenamed("cs", "n_cs"), ["scan_id", "n_cs"]).join(exists_s.withColumnRenamed("ss", "n_ss"), ["scan_id", "n_ss"])

    roots_ = r.filter(c("early").isNull()).select(*PAIR)
    pairs = cut_lineage(closure(roots_, lambda new: below(new).select("scan_id", c("n_cs").alias("cs"), c("n_ss").alias("ss"))))
    edges = cut_lineage(below(pairs).select(*PAIR, "n_cs", "n_ss").distinct())
    bad = _local_failures(pairs, info_c, info_s, code_last, spec_last)
    differs = _leading_to(bad, edges).withColumn("differs", F.lit(True))
    out = r.join(differs, PAIR, "left")
    verdict = F.coalesce("early", F.when(c("differs"), "DIFFER").otherwise("MATCH"))
    return out.select("scan_id", "binding_id", verdict.alias("verdict"))


def coarse_diff(bindings: DataFrame, bound: BoundDiff, verdicts: DataFrame) -> DataFrame:
    """Whole-shape mismatch of a body or response, only when no field-level finding explains it."""

    def norm(ref: Column) -> Column:
        return F.lower(ct.base_name(ref))

    refs_differ = (ct.is_array_ref(c("code_ref")) != ct.is_array_ref(c("spec_ref"))) | (norm(c("code_ref")) != norm(c("spec_ref")))
    left = bindings.filter(refs_differ).join(bound.divergent, ["scan_id", "binding_id"], "left_anti")
    left = left.join(verdicts.filter(c("verdict") == "DIFFER"), ["scan_id", "binding_id"], "left_semi")
    body = c("kind") == "BODY"
    text = F.when(
        body, _text("Request body shape — code expects '", c("code_ref"), "' but the spec declares '", c("spec_ref"), "'")
    ).otherwise(_text("Success response schema — code returns '", c("code_ref"), "' but the spec declares '", c("spec_ref"), "'"))
    return left.select(
        "scan_id", "binding_id",
        F.when(body, "REQUEST_BODY_SCHEMA_MISMATCH").otherwise("RESPONSE_SCHEMA_MISMATCH").alias("type"),
        text.alias("summary"), F.when(body, "HIGH").otherwise("MEDIUM").alias("confidence"),
    )
