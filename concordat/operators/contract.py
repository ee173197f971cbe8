"""Code-versus-spec and spec-versus-spec comparison, for many scans at once.

All inputs are keyed by ``scan_id``; joins use finer keys (scan and endpoint, path or schema), so a
scan with a large share of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import contract as ct
from concordat.functions import paths, rules
from concordat.operators.windows import first_k
from concordat.taxonomy import VERBS

c = F.col
FINDING_COLUMNS = ["scan_id", "type", "endpoint", "summary", "confidence"]


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def keyed(endpoints: DataFrame) -> DataFrame:
    """Add the join key, the normalised path and the label."""
    return endpoints.withColumns(
        {
            "key": paths.endpoint_key(c("method"), c("path")),
            "np": paths.norm_path(c("path")),
            "label": paths.endpoint_label(c("method"), c("path")),
        }
    )


def _verb_list(method: str) -> Column:
    """Distinct verbs of a group in enum order, at most eight values."""
    seen = F.collect_set(method)
    known = F.filter(F.array(*[F.lit(v) for v in VERBS]), lambda v: F.array_contains(seen, v))
    return F.concat(F.lit("["), F.array_join(known, ", "), F.lit("]"))


def _verbs_by_path(endpoints: DataFrame) -> DataFrame:
    return endpoints.groupBy("scan_id", "np").agg(_verb_list("method").alias("verbs"))


def _last_per_key(endpoints: DataFrame) -> DataFrame:
    return first_k(endpoints, ["scan_id", "key"], [F.desc("pos")])


def matched(code: DataFrame, spec: DataFrame) -> DataFrame:
    """Every code endpoint with its spec partner (the last one of that key)."""
    s = _last_per_key(keyed(spec))
    s = s.select("scan_id", "key", *[c(x).alias("s_" + x) for x in s.columns if x not in ("scan_id", "key")])
    return keyed(code).join(s, ["scan_id", "key"])


def code_only(code: DataFrame, spec: DataFrame) -> DataFrame:
    return keyed(code).join(keyed(spec).select("scan_id", "key"), ["scan_id", "key"], "left_anti")


def spec_only(code: DataFrame, spec: DataFrame) -> DataFrame:
    return keyed(spec).join(keyed(code).select("scan_id", "key"), ["scan_id", "key"], "left_anti")


def key_collisions(spec: DataFrame) -> DataFrame:
    """Scans whose spec operations collapse to fewer keys; one note per scan."""
    per_key = keyed(spec).groupBy("scan_id", "key").agg(F.count("*").alias("n"))
    hit = per_key.groupBy("scan_id").agg(F.max("n").alias("n")).filter(c("n") > 1)
    return hit.select(
        "scan_id",
        F.lit("EXTRA_ENDPOINT").alias("type"),
        F.lit("spec-key-collision").alias("endpoint"),
        F.lit(
            "Two or more spec operations collapse to the same normalized signature (distinct path-variable names or "
            "letter-casing); code-vs-spec matching is ambiguous for them and they may not be compared reliably."
        ).alias("summary"),
        F.lit("LOW").alias("confidence"),
    )


def _code_verb_mismatch(code: DataFrame, spec: DataFrame) -> DataFrame:
    return code_only(code, spec).join(_verbs_by_path(keyed(spec)), ["scan_id", "np"])


def verb_mismatch(code: DataFrame, spec: DataFrame) -> DataFrame:
    """The path is known on the other side under other verbs. The spec side reports a path once, and only
    when the code side did not."""
    from_code = _code_verb_mismatch(code, spec)
    a = from_code.select(
        "scan_id",
        F.lit("VERB_MISMATCH").alias("type"),
        c("label").alias("endpoint"),
        _text("Code exposes ", c("method"), " ", c("path"), " but the spec defines ", c("verbs"), " for that path").alias("summary"),
        F.lit("HIGH").alias("confidence"),
    )
    rest = spec_only(code, spec).join(_verbs_by_path(keyed(code)), ["scan_id", "np"])
    rest = rest.join(from_code.select("scan_id", "np").distinct(), ["scan_id", "np"], "left_anti")
    once = first_k(rest, ["scan_id", "np"], [F.asc("pos")])
    b = once.select(
        "scan_id",
        F.lit("VERB_MISMATCH").alias("type"),
        c("label").alias("endpoint"),
        _text("Spec documents ", c("method"), " ", c("path"), " but the code exposes ", c("verbs"), " on that path").alias("summary"),
        F.lit("HIGH").alias("confidence"),
    )
    return a.unionByName(b)


def missing_endpoints(code: DataFrame, spec: DataFrame) -> DataFrame:
    out = code_only(code, spec).join(keyed(spec).select("scan_id", "np"), ["scan_id", "np"], "left_anti")
    return out.select(
        "scan_id",
        F.lit("MISSING_ENDPOINT").alias("type"),
        c("label").alias("endpoint"),
        _text("Endpoint ", c("label"), " exists in code but is missing from the spec").alias("summary"),
        F.lit("HIGH").alias("confidence"),
    )


def incomplete_scans(blind_spots: DataFrame) -> DataFrame:
    return blind_spots.filter(rules.contains_any(c("text"), rules.INCOMPLETE_MARKS)).select("scan_id").distinct()


def extra_endpoints(code: DataFrame, spec: DataFrame, blind_spots: DataFrame) -> DataFrame:
    """Spec endpoints unknown to the code; one rolled-up note for scans whose extraction is incomplete."""
    rest = spec_only(code, spec).join(keyed(code).select("scan_id", "np"), ["scan_id", "np"], "left_anti")
    rest = rest.join(incomplete_scans(blind_spots).withColumn("incomplete", F.lit(True)), "scan_id", "left")
    sure = rest.filter(c("incomplete").isNull()).select(
        "scan_id",
        F.lit("EXTRA_ENDPOINT").alias("type"),
        c("label").alias("endpoint"),
        _text("Endpoint ", c("label"), " is in the spec but not found in code (dead spec?)").alias("summary"),
        F.lit("MEDIUM").alias("confidence"),
    )
    unsure = rest.filter(c("incomplete")).groupBy("scan_id").agg(F.count("*").alias("n"))
    note = unsure.select(
        "scan_id",
        F.lit("EXTRA_ENDPOINT").alias("type"),
        F.lit("code-extraction-incomplete").alias("endpoint"),
        _text(c("n").cast("string"), " spec endpoint(s) could not be cross-checked against code").alias("summary"),
        F.lit("LOW").alias("confidence"),
    )
    return sure.unionByName(note)


def l1_findings(specs: DataFrame, messages: DataFrame) -> DataFrame:
    """Document checks of parsed specs, and parser messages."""

    def blank(name: str) -> Column:
        return c(name).isNull() | (F.trim(name) == "")

    checks = F.array_compact(
        F.array(
            F.when(blank("title"), F.lit("Spec is missing info.title")),
            F.when(blank("version"), F.lit("Spec is missing info.version")),
        )
    )
    info = specs.filter(c("openapi").isNotNull()).select(
        "spec_id", F.lit("MISSING_INFO_FIELD").alias("type"), F.explode(checks).alias("summary"), F.lit("MEDIUM").alias("confidence")
    )
    kind = F.when(F.lower("message").contains("ref"), "UNRESOLVED_REF").otherwise("OPENAPI_PARSE_ERROR")
    parsed = messages.select("spec_id", kind.alias("type"), c("message").alias("summary"), F.lit("HIGH").alias("confidence"))
    return info.unionByName(parsed)


def path_var_diff(pairs: DataFrame) -> DataFrame:
    cv, sv = paths.path_vars(c("path")), paths.path_vars(c("s_path"))
    out = pairs.withColumns({"cv": cv, "sv": sv}).filter((c("cv") != c("sv")) & (F.size("cv") == F.size("sv")))
    return out.select(
        "scan_id",
        F.lit("PATH_VAR_NAME_MISMATCH").alias("type"),
        c("label").alias("endpoint"),
        _text("Path variable names differ — code ", ct.show_list(c("cv")), " vs spec ", ct.show_list(c("sv"))).alias("summary"),
        F.lit("HIGH").alias("confidence"),
    )


def _finding(cond: Column, type_: str, summary: Column, confidence: str) -> Column:
    return F.when(
        cond, F.struct(F.lit(type_).alias("type"), summary.alias("summary"), F.lit(confidence).alias("confidence"))
    )


def _emit(df: DataFrame, findings: list[Column], *keep: str) -> DataFrame:
    return df.select(*keep, F.inline(F.array_compact(F.array(*findings))))


def flattening_endpoints(blind_spots: DataFrame) -> DataFrame:
    """``Class.method`` of handlers that bind all query parameters, read off the blind-spot texts."""
    hit = blind_spots.filter(rules.contains_any(c("text"), rules.FLATTENED_QUERY_MARKS))
    handler = F.regexp_extract("text", r"^Controller (\S+) ", 1)
    return hit.select("scan_id", handler.alias("handler")).filter(c("handler") != "").distinct()


def _with_param_key(params: DataFrame) -> DataFrame:
    return params.withColumn("pkey", paths.param_key(c("location"), c("name")))


def param_diff(pairs: DataFrame, code_params: DataFrame, spec_params: DataFrame, blind_spots: DataFrame) -> DataFrame:
    """Parameters of matched endpoints, path parameters left out.

    ``pairs`` holds scan_id, pos, s_pos, label and handler; parameters are keyed by (scan_id, ep)."""
    p = pairs.select("scan_id", c("pos").alias("ep"), c("s_pos").alias("s_ep"), "label", "handler")
    cp = _with_param_key(code_params).join(p, ["scan_id", "ep"])
    sp_last = first_k(_with_param_key(spec_params), ["scan_id", "ep", "pkey"], [F.desc("pos")])
    s = F.struct("name", "location", "type", "format", "required", "constraints").alias("s")
    sp_last = sp_last.select("scan_id", c("ep").alias("s_ep"), "pkey", s)
    not_path = F.coalesce(c("location") != "PATH", F.lit(True))
    j = cp.filter(not_path).join(sp_last, ["scan_id", "s_ep", "pkey"], "left")
    gone, both = c("s").isNull(), c("s").isNotNull()
    wild = F.coalesce(c("type") == "object", F.lit(False)) | F.coalesce(c("s.type") == "object", F.lit(False))
    who = _text("Parameter '", c("name"), "'")
    code_none, spec_none = ct.no_constraints(c("constraints")), ct.no_constraints(c("s.constraints"))
    diff = ct.constraint_diff(c("constraints"), c("s.constraints"), c("type") == "integer", c("s.type") == "integer")
    spec_enum = ct.has_values(c("s.constraints.enumValues"))
    prose = F.coalesce(c("s.constraints.enumFromDescription"), F.lit(False))
    values = ct.show_list(c("s.constraints.enumValues"))
    enum_text = F.when(
        prose,
        _text(who, " — the spec's description documents the allowed values ", values,
              ", but the schema doesn't formally constrain them and the code doesn't enforce them at the API boundary"),
    ).otherwise(
        _text(who, " — the spec restricts it to ", values,
              " but the code binds it without that enum (allowed values not enforced at the API boundary)")
    )
    found = [
        _finding(gone, "PARAM_MISSING", _text(who, " (", F.coalesce("location", F.lit("null")), ") is in code but missing from the spec"), "HIGH"),
        _finding(both & ~wild & (c("type") != c("s.type")), "PARAM_TYPE_MISMATCH",
                 _text(who, " type — code ", c("type"), " vs spec ", c("s.type")), "MEDIUM"),
        _finding(both & ~wild & c("type").isNotNull() & c("s.type").isNull(), "PARAM_TYPE_MISMATCH",
                 _text(who, " type — code declares ", c("type"), " but the spec omits a type (under-specified)"), "LOW"),
        _finding(both & (c("required") != c("s.required")), "PARAM_REQUIRED_MISMATCH",
                 _text(who, " required — code ", c("required").cast("string"), " vs spec ", c("s.required").cast("string")), "MEDIUM"),
        _finding(both & (c("format") != c("s.format")), "CONSTRAINT_GAP",
                 _text(who, " format — code ", c("format"), " vs spec ", c("s.format")), "LOW"),
        _finding(both & ~code_none & spec_none, "CONSTRAINT_GAP", _text(who, " has code constraints not exposed in the spec"), "MEDIUM"),
        _finding(both & ~code_none & ~spec_none & diff.isNotNull(), "CONSTRAINT_GAP", _text(who, " constraint mismatch — ", diff), "MEDIUM"),
        _finding(both & code_none & spec_enum, "CONSTRAINT_GAP", enum_text, "LOW"),
    ]
    a = _emit(j, found, "scan_id", c("label").alias("endpoint"))
    sp = _with_param_key(spec_params).filter(not_path).withColumnRenamed("ep", "s_ep").join(p, ["scan_id", "s_ep"])
    sp = sp.join(_with_param_key(code_params).select("scan_id", "ep", "pkey"), ["scan_id", "ep", "pkey"], "left_anti")
    flat = flattening_endpoints(blind_spots).withColumn("flat", F.lit(True))
    sp = sp.join(flat, ["scan_id", "handler"], "left").filter(
        c("flat").isNull() | ~F.coalesce(c("location") == "QUERY", F.lit(True))
    )
    b = sp.select(
        "scan_id",
        c("label").alias("endpoint"),
        F.lit("PARAM_EXTRA").alias("type"),
        _text("Parameter '", F.coalesce("name", F.lit("null")), "' (", F.coalesce("location", F.lit("null")), ") is in the spec but not in code").alias("summary"),
        F.lit("MEDIUM").alias("confidence"),
    )
    return a.unionByName(b)


def body_presence(pairs: DataFrame) -> DataFrame:
    has_code, has_spec = c("body_ref_present"), c("s_body_ref_present")
    return pairs.filter(has_code != has_spec).select(
        "scan_id",
        F.lit("REQUEST_BODY_PRESENCE_MISMATCH").alias("type"),
        c("label").alias("endpoint"),
        _text("Request body presence — code ", has_code.cast("string"), " vs spec ", has_spec.cast("string")).alias("summary"),
        F.lit("HIGH").alias("confidence"),
    )


def status_diff(pairs: DataFrame, code_resp: DataFrame, spec_resp: DataFrame) -> DataFrame:
    """Statuses the code can return but the spec does not name, and the other way round."""
    p = pairs.select("scan_id", c("pos").alias("ep"), c("s_pos").alias("s_ep"), "label")
    cr = code_resp.join(p, ["scan_id", "ep"])
    documented = spec_resp.select("scan_id", c("ep").alias("s_ep"), "status")
    first_ok = cr.filter(c("status").between(200, 299)).groupBy("scan_id", "ep", "s_ep", "label").agg(F.min_by("status", "pos").alias("status"))
    no_ok = first_ok.join(documented, ["scan_id", "s_ep", "status"], "left_anti").select(
        "scan_id", c("label").alias("endpoint"), F.lit("STATUS_CODE_MISSING").alias("type"),
        _text("Code returns ", c("status").cast("string"), " but the spec doesn't document it").alias("summary"), F.lit("MEDIUM").alias("confidence"),
    )
    origin = F.coalesce("origin", F.lit(""))
    blanket = origin.startswith("EXCEPTION_HANDLER") & (origin != "EXCEPTION_HANDLER_REACHABLE")
    undocumented = cr.filter(c("status") >= 300).join(documented, ["scan_id", "s_ep", "status"], "left_anti").select(
        "scan_id", c("label").alias("endpoint"), F.lit("STATUS_CODE_MISSING").alias("type"),
        _text("Code can return ", c("status").cast("string"), " but the spec doesn't document it").alias("summary"),
        F.when(blanket, "LOW").otherwise("MEDIUM").alias("confidence"),
    )
    returned = code_resp.select("scan_id", "ep", "status")
    never = spec_resp.filter(c("status").between(200, 399)).withColumnRenamed("ep", "s_ep").join(p, ["scan_id", "s_ep"])
    never = never.join(returned, ["scan_id", "ep", "status"], "left_anti").select(
        "scan_id", c("label").alias("endpoint"), F.lit("STATUS_CODE_EXTRA").alias("type"),
        _text("Spec documents ", F.when(c("status") < 300, "success").otherwise("redirect"), " status ", c("status").cast("string"),
              " but the code never returns it").alias("summary"),
        F.lit("LOW").alias("confidence"),
    )
    return no_ok.unionByName(undocumented).unionByName(never)


def error_media_diff(pairs: DataFrame, code_resp: DataFrame, spec_resp: DataFrame) -> DataFrame:
    """Media types of equal error statuses; the first spec response of a status counts."""
    p = pairs.select("scan_id", c("pos").alias("ep"), c("s_pos").alias("s_ep"), "label")
    sr = spec_resp.groupBy("scan_id", c("ep").alias("s_ep"), "status").agg(F.min_by("media_types", "pos").alias("s_media"))
    j = code_resp.filter(c("status") >= 300).join(p, ["scan_id", "ep"]).join(sr, ["scan_id", "s_ep", "status"])
    j = j.filter(ct.has_values(c("media_types")) & ct.has_values(c("s_media")))
    j = j.filter(~ct.media_compatible(c("media_types"), c("s_media")))
    advice = F.coalesce("origin", F.lit("")).startswith("EXCEPTION_HANDLER")
    return j.select(
        "scan_id", c("label").alias("endpoint"), F.lit("CONSUMES_PRODUCES_MISMATCH").alias("type"),
        _text("Error ", c("status").cast("string"), " media type — code ", ct.show_list(c("media_types")), " vs spec ",
              ct.show_list(c("s_media"))).alias("summary"),
        F.when(advice, "LOW").otherwise("MEDIUM").alias("confidence"),
    )


def security_diff(pairs: DataFrame, blind_spots: DataFrame) -> DataFrame:
    central = (
        blind_spots.filter(rules.contains_any(c("text"), rules.CENTRAL_SECURITY_MARKS))
        .select("scan_id", F.lit(True).alias("central"))
        .distinct()
    )
    j = pairs.join(central, "scan_id", "left")
    code_has, spec_has = ct.has_values(c("security")), ct.has_values(c("s_security"))
    resolved = F.exists("security", lambda t: ~t.startswith("unresolved:"))
    return _emit(
        j,
        [
            _finding(code_has & ~spec_has & resolved, "SECURITY_MISMATCH",
                     _text("Code enforces authorization (", F.array_join("security", ", "),
                           ") but the spec declares no security for this operation"), "HIGH"),
            _finding(~code_has & spec_has & c("central").isNull(), "SECURITY_MISMATCH",
                     _text("Spec requires security (", F.array_join("s_security", ", "),
                           ") but the code enforces none on this endpoint"), "MEDIUM"),
        ],
        "scan_id", c("label").alias("endpoint"),
    )


def media_diff(pairs: DataFrame, spec_resp: DataFrame) -> DataFrame:
    """Produces, consumes and body media types of matched endpoints; error media of the spec are benign."""
    base = F.explode(F.transform("media_types", ct.media_base)).alias("m")
    err = spec_resp.filter(c("status") >= 300).select("scan_id", c("ep").alias("s_pos"), base).filter(c("m").isNotNull())
    # Distinct media types of one operation: a handful of values.
    err = err.groupBy("scan_id", "s_pos").agg(F.collect_set("m").alias("benign"))
    j = pairs.join(err, ["scan_id", "s_pos"], "left").withColumn("benign", F.coalesce("benign", F.array().cast("array<string>")))

    def check(which: str, code: Column, spec: Column, benign: Column | None, extra: Column = None) -> Column:
        eff = code if benign is None else F.filter(code, lambda m: ~F.coalesce(F.array_contains(benign, ct.media_base(m)), F.lit(False)))
        bad = ct.has_values(code) & ct.has_values(spec) & ct.has_values(eff) & ~ct.media_compatible(eff, spec)
        if extra is not None:
            bad = bad & extra
        text = _text(which + " media types — code ", ct.show_list(code), " vs spec ", ct.show_list(spec))
        return _finding(bad, "CONSUMES_PRODUCES_MISMATCH", text, "LOW")

    return _emit(
        j,
        [
            check("produces", c("produces"), c("s_produces"), c("benign")),
            check("consumes", c("consumes"), c("s_consumes"), None),
            check("request body content", c("body_media"), c("s_body_media"), None, ~ct.has_values(c("consumes"))),
        ],
        "scan_id",
        c("label").alias("endpoint"),
    )


def spec_drift(specs: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Endpoints present in one spec of a pair only, for every pair of specs of a scan.

    The specs of a scan are a short list, and so are those that have an operation; what the second list lacks of the
    first becomes rows, and nothing else does."""
    e = keyed(endpoints)
    mine = specs.select("scan_id", "spec_id", "spec_pos")
    every = specs.groupBy("scan_id").agg(F.collect_set(F.struct("spec_id", "spec_pos")).alias("every"))
    held = e.groupBy("scan_id", "key").agg(F.collect_set("spec_id").alias("held"))
    lacking = F.filter("every", lambda s: ~F.array_contains("held", s["spec_id"]))
    gone = e.join(mine, ["scan_id", "spec_id"]).join(held, ["scan_id", "key"]).join(every, "scan_id").withColumn("o", F.explode(lacking))
    gone = gone.withColumns({"other": c("o.spec_id"), "o_pos": c("o.spec_pos")})
    first = c("spec_pos") < c("o_pos")
    pair = F.when(first, _text(c("spec_id"), " vs ", c("other"))).otherwise(_text(c("other"), " vs ", c("spec_id")))
    return gone.select(
        "scan_id", F.lit("SPEC_DRIFT").alias("type"), c("label").alias("endpoint"), pair.alias("spec_source"),
        _text(c("label"), " is in ", c("spec_id"), " but not in ", c("other")).alias("summary"), F.lit("HIGH").alias("confidence"),
    )


def spec_minus_spec(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set difference of two specs, both ways."""
    left = keyed(a).select("scan_id", "key").exceptAll(keyed(b).select("scan_id", "key")).withColumn("side", F.lit("a"))
    right = keyed(b).select("scan_id", "key").exceptAll(keyed(a).select("scan_id", "key")).withColumn("side", F.lit("b"))
    return left.unionByName(right)


def resolve_security(endpoints: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """The rule that governs each endpoint, or none when rules overlap or a pattern cannot be trusted.

    Simple patterns are a literal path or ``prefix/**``; they meet the endpoint by an equi-join on the
    endpoint's path prefixes. Only wildcard patterns need a regex test, joined on the scan."""
    simple = F.coalesce(~F.regexp_replace("pattern", r"/\*\*$", "").rlike(r"[*?]") & (c("pattern") != ""), F.lit(False))
    r = rule_rows.withColumn("simple", simple)

    def cut(p: Column) -> Column:
        return F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)

    deep = c("pattern").endswith("/**")
    prefix_of_rule = F.when(deep, F.regexp_replace("pattern", r"/\*\*$", ""))
    s = r.filter(c("simple") & ~c("any_request")).select(
        "scan_id", "rule_id", "methods", "pattern",
        F.when(deep, F.concat(F.lit("P"), prefix_of_rule)).otherwise(F.concat(F.lit("E"), cut(c("pattern")))).alias("probe"),
    )
    segs = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.concat(F.lit("P"), F.array_join(F.slice(segs, F.lit(1), n), "/")))
    probes = F.array_distinct(F.concat(prefixes, F.array(F.concat(F.lit("P"), cut(c("path")))), F.array(F.concat(F.lit("E"), cut(c("path"))))))
    e = endpoints.select("scan_id", "pos", "method", "path")
    hit = e.withColumn("probe", F.explode(probes)).join(s, ["scan_id", "probe"])
    hit = hit.filter((F.size("methods") == 0) | F.array_contains("methods", c("method")))
    # A literal pattern that differs from the path by a trailing slash only is not trusted.
    exact = c("probe").startswith("P") | (c("pattern") == c("path"))
    per = hit.groupBy("scan_id", "pos").agg(
        F.countDistinct(F.when(exact, c("rule_id"))).alias("n"),
        F.max(F.when(exact, c("rule_id"))).alias("rule_id"),
        F.bool_or(~exact).alias("odd"),
    )
    glob = r.filter(~c("simple") & ~c("any_request") & c("pattern").isNotNull())
    regex = F.regexp_replace(F.regexp_replace("pattern", r"([.+^$(){}|\[\]\\])", r"\\$1"), r"/\*\*", "\u0001")
    regex = F.regexp_replace(F.regexp_replace(regex, r"\*", "[^/]*"), r"\?", "[^/]")
    # What a pattern matches starts with its literal folders, which are among the folders of the path.
    folder = F.regexp_extract(F.regexp_extract("pattern", r"^[^*?]*", 0), r"(?s)^(.*)/", 1)
    glob = glob.select("scan_id", folder.alias("folder"), "methods", F.concat(F.lit("^"), F.replace(regex, F.lit("\u0001"), F.lit("(/.*)?")), F.lit("$")).alias("rx"))
    doubtful = (
        e.withColumn("folder", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(prefixes, lambda p: F.substr(p, F.lit(2)))))))
        .join(glob, ["scan_id", "folder"])
        .filter(((F.size("methods") == 0) | F.array_contains("methods", c("method"))) & F.expr("path RLIKE rx"))
        .select("scan_id", "pos", F.lit(True).alias("doubtful"))
        .distinct()
    )
    default = r.filter("any_request").groupBy("scan_id").agg(F.max_by("rule_id", "pos").alias("default_rule"))
    out = e.join(per, ["scan_id", "pos"], "left").join(doubtful, ["scan_id", "pos"], "left").join(default, "scan_id", "left")
    n = F.coalesce("n", F.lit(0))
    rule = F.when(c("doubtful") | F.coalesce("odd", F.lit(False)) | (n > 1), F.lit(None)).when(n == 1, c("rule_id")).otherwise(c("default_rule"))
    return out.select("scan_id", "pos", "method", "path", rule.alias("rule_id"))
