"""Test coverage: titles, traceability, endpoint references, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions import paths, rules, text
from concordat.operators.containment import first_held, first_holder
from concordat.operators.graph import closure
from concordat.operators.windows import first_k
from concordat.session import cut_lineage

c = F.col


def match_coverage(required: DataFrame, tests: DataFrame) -> DataFrame:
    """Match required titles (plan_id, pos, title) to tests (plan_id, pos, key, title).

    Equal fingerprints give HIGH, containment either way gives MEDIUM; the first test in order wins. Titles are
    matched by distinct fingerprint, so copies cost nothing. An empty required title is a gap, and so is a match
    whose first test has no key."""
    r = required.withColumn("fp", text.title_fp(c("title")))
    t = tests.withColumn("fp", text.title_fp(c("title")))
    first = t.filter(c("fp") != "").groupBy("plan_id", "fp").agg(F.min(F.struct("pos", "key")).alias("t"))
    want = r.filter(c("fp") != "").select("plan_id", "fp").distinct()
    exact = first.filter(c("t.key").isNotNull())
    high = want.join(exact, ["plan_id", "fp"]).select("plan_id", "fp", c("t.key").alias("key"), F.lit("HIGH").alias("conf"))
    left = want.join(high.select("plan_id", "fp"), ["plan_id", "fp"], "left_anti").select(c("plan_id").alias("grp"), c("fp").alias("text"))
    have = first.select(c("plan_id").alias("grp"), c("fp").alias("text"), c("t").alias("rank"))
    a = first_holder(have, left).select(c("grp").alias("plan_id"), c("needle").alias("fp"), c("first").alias("t"))
    b = first_held(left, have).select(c("grp").alias("plan_id"), c("hay").alias("fp"), c("first").alias("t"))
    medium = a.unionByName(b).groupBy("plan_id", "fp").agg(F.min("t").alias("t")).select(
        "plan_id", "fp", c("t.key").alias("key"), F.lit("MEDIUM").alias("conf")
    )
    hits = cut_lineage(high.unionByName(medium))  # what builds on the matches reads them more than once
    out = r.join(hits, ["plan_id", "fp"], "left")
    return out.withColumns(
        {
            "status": F.when(c("key").isNotNull(), "MATCHED").otherwise("GAP"),
            "confidence": F.when(c("key").isNotNull(), c("conf")).otherwise("HIGH"),
        }
    ).withColumnRenamed("key", "matched_key").drop("conf")


def orphans(tests: DataFrame, matches: DataFrame) -> DataFrame:
    """Existing tests that no required case matched."""
    used = matches.filter(c("matched_key").isNotNull()).select("plan_id", c("matched_key").alias("key"))
    return tests.filter(c("key").isNotNull()).join(used, ["plan_id", "key"], "left_anti")


def gap_actions(matches: DataFrame, tests: DataFrame) -> DataFrame:
    """What to do about each gap: skip it if a test of that fingerprint exists or an earlier gap creates it."""
    t = tests.filter(c("key").isNotNull()).withColumn("fp", text.title_fp(c("title")))
    t = t.groupBy("plan_id", "fp").agg(F.min_by("key", "pos").alias("dup"))
    gaps = matches.filter(c("status") == "GAP").select("plan_id", "fp", "pos", "title")
    firsts = gaps.groupBy("plan_id", "fp").agg(F.min("pos").alias("first_pos"))
    j = gaps.join(firsts, ["plan_id", "fp"]).join(t, ["plan_id", "fp"], "left")
    create = c("dup").isNull() & (c("pos") == c("first_pos"))
    return j.withColumn("action", F.when(create, "CREATED").otherwise("SKIPPED_DUP"))


def enforce_traceability(cases: DataFrame, issues: DataFrame, risks: DataFrame) -> DataFrame:
    """Null out requirement keys and risk ids that do not exist; keys are checked only if the plan has issues."""
    keys = issues.filter(F.trim("key") != "").select("plan_id", F.upper("key").alias("_k"), F.lit(True).alias("_ok")).distinct()
    any_keys = keys.select("plan_id", F.lit(True).alias("_any")).distinct()
    ids = risks.filter(F.trim("risk_id") != "").select("plan_id", F.upper("risk_id").alias("_r"), F.lit(True).alias("_rok")).distinct()
    j = cases.withColumns({"_k": F.upper("requirement_key"), "_r": F.upper("risk_id")})
    j = j.join(keys, ["plan_id", "_k"], "left").join(ids, ["plan_id", "_r"], "left").join(any_keys, "plan_id", "left")
    bad_key = c("requirement_key").isNotNull() & c("_any").isNotNull() & c("_ok").isNull()
    bad_risk = F.coalesce(F.trim("risk_id") != "", F.lit(False)) & c("_rok").isNull()
    return j.withColumns(
        {
            "dropped_key": bad_key,
            "dropped_risk": bad_risk,
            "requirement_key": F.when(~bad_key, c("requirement_key")),
            "risk_id": F.when(~bad_risk, c("risk_id")),
        }
    ).drop("_k", "_r", "_ok", "_rok", "_any")


def under_covered(risks: DataFrame, cases: DataFrame, least: int = 2) -> DataFrame:
    """High risks with fewer than two traced cases, zero included."""
    n = cases.filter(F.trim("risk_id") != "").groupBy("plan_id", F.upper("risk_id").alias("_r")).agg(F.count("*").alias("n"))
    high = risks.filter(rules.is_high_risk(c("level"))).withColumn("_r", F.upper("risk_id"))
    j = high.join(n, ["plan_id", "_r"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.filter(c("n") < least).drop("_r")


def link_cases(cases: DataFrame, conditions: DataFrame) -> DataFrame:
    """Link cases to conditions by reference, else by basis item; the first condition per key wins.
    Automation is inherited; an unlinked case loses its requirement when the service has conditions."""
    cond = conditions.select("service", "cond_id", "pos", F.upper("condition_ref").alias("ref"), F.upper("basis_item").alias("item"), "automation")
    pick = F.min(F.struct("pos", "cond_id", "automation"))
    by_ref = cond.filter(c("ref").isNotNull()).groupBy("service", c("ref").alias("_a")).agg(pick.alias("a"))
    by_item = cond.filter(F.trim("item") != "").groupBy("service", c("item").alias("_b")).agg(pick.alias("b"))
    has = conditions.select("service", F.lit(True).alias("_any")).distinct()
    j = cases.withColumns({"_a": F.upper("condition_ref"), "_b": F.upper("requirement_key")})
    j = j.join(by_ref, ["service", "_a"], "left").join(by_item, ["service", "_b"], "left").join(has, "service", "left")
    hit = F.coalesce("a", "b")
    return j.withColumns(
        {
            "cond_id": hit["cond_id"],
            "automation": hit["automation"],
            "requirement_key": F.when(c("_any").isNull() | hit.isNotNull(), c("requirement_key")),
        }
    ).drop("_a", "_b", "a", "b", "_any")


def ground_conditions(conditions: DataFrame, risks: DataFrame, basis: DataFrame) -> DataFrame:
    """Drop risk references outside the register and phrases not found in the test basis of the strategy;
    any drop caps the confidence of the strategy at 50."""
    ids = risks.select("strategy", F.upper("risk_id").alias("_r"), F.lit(True).alias("_rok")).distinct()
    any_risk = risks.select("strategy", F.lit(True).alias("_any")).distinct()
    phrase = text.norm_blank(c("basis_item"))
    hay = basis.select(c("strategy").alias("grp"), text.norm_blank(c("text")).alias("text"), F.lit(0).alias("rank"))
    needles = conditions.select(c("strategy").alias("grp"), phrase.alias("text"))
    found = first_holder(hay, needles).select(c("grp").alias("strategy"), c("needle").alias("_p"), F.lit(True).alias("_pok"))
    j = conditions.withColumns({"_r": F.upper("risk_ref"), "_p": phrase})
    j = j.join(ids, ["strategy", "_r"], "left").join(any_risk, "strategy", "left").join(found, ["strategy", "_p"], "left")
    bad_risk = c("_any").isNotNull() & F.coalesce(F.trim("risk_ref") != "", F.lit(False)) & c("_rok").isNull()
    bad_item = F.coalesce(F.trim("basis_item") != "", F.lit(False)) & c("_pok").isNull()
    j = j.withColumns({"dropped_risk": bad_risk, "dropped_item": bad_item})
    drops = j.filter(c("dropped_risk") | c("dropped_item")).select("strategy", F.lit(True).alias("_cap")).distinct()
    j = j.join(drops, "strategy", "left")
    return j.withColumns(
        {
            "risk_ref": F.when(~c("dropped_risk"), c("risk_ref")),
            "basis_item": F.when(~c("dropped_item"), c("basis_item")),
            "confidence": F.when(c("_cap"), F.least("confidence", F.lit(50.0))).otherwise(c("confidence")),
        }
    ).drop("_r", "_p", "_rok", "_any", "_pok", "_cap")


# --- endpoint references -------------------------------------------------------------------------------


def _ref_norm(path: Column) -> Column:
    p = F.lower(F.trim(F.coalesce(path, F.lit(""))))
    return F.when((F.length(p) > 1) & p.endswith("/"), F.regexp_replace(p, "/$", "")).otherwise(p)


def _templates(endpoints: DataFrame) -> DataFrame:
    """Segment count, variable mask and masked literal text of each endpoint template."""
    segs = F.filter(F.split(F.lower(F.trim(F.coalesce("path", F.lit("")))), "/"), lambda s: s != "")
    is_var = lambda s: s.startswith("{") & s.endswith("}")
    e = endpoints.withColumn("segs", segs)
    return e.withColumns(
        {
            "k": F.size("segs"),
            "mask": F.array_join(F.transform("segs", lambda s: F.when(is_var(s), "v").otherwise("l")), ""),
            "masked": F.array_join(F.transform("segs", lambda s: F.when(is_var(s), "{}").otherwise(s)), "/"),
        }
    ).drop("segs")


def _ref_keys(refs: DataFrame, templates: DataFrame) -> DataFrame:
    """Each reference under every mask in use: its last k segments with the variable positions blanked.

    An endpoint matches as a suffix, variables match one non-empty segment. Masks are few, so this is an
    equi-join where a regex per endpoint would be a nested loop."""
    r = refs.withColumn("norm", _ref_norm(c("path")))
    tail = F.regexp_replace(F.regexp_replace("norm", "^[^/]*/", ""), "/$", "")
    r = r.withColumn("segs", F.when(c("norm").contains("/"), F.split(tail, "/")).otherwise(F.array().cast("array<string>")))
    masks = templates.select("grp", "k", "mask").distinct()
    lens = F.sequence(F.lit(0), F.size("segs"))
    j = r.withColumn("k", F.explode(lens)).join(masks, ["grp", "k"])
    last = F.slice("segs", F.size("segs") - c("k") + 1, c("k"))
    flags = F.split("mask", "")
    blanked = F.zip_with(last, flags, lambda s, f: F.when(f == "v", F.when(s != "", "{}")).otherwise(s))
    whole = F.when(c("k") == 0, F.lit("")).otherwise(
        F.when(~F.exists(blanked, lambda s: s.isNull()), F.array_join(blanked, "/"))
    )
    j = j.withColumn("masked", whole).filter(c("masked").isNotNull())
    # An endpoint without segments matches references that end with a slash.
    return j.filter((c("k") > 0) | c("norm").endswith("/")).drop("segs", "mask")


def reconcile_tests(endpoints: DataFrame, refs: DataFrame) -> DataFrame:
    """CURRENT with the first covering file, or GAP, per endpoint (grp, pos, method, path)."""
    t = _templates(endpoints)
    keyed = _ref_keys(refs, t)
    # References are reduced to the first file per template key and verb before they meet the endpoints.
    first = keyed.groupBy("grp", "k", "masked", c("method").alias("ref_method")).agg(F.min(F.struct("pos", "file")).alias("r"))
    j = t.join(first, ["grp", "k", "masked"], "left")
    ok = c("ref_method").isNull() | (c("ref_method") == c("method"))
    cover = j.groupBy("grp", "pos", "method", "path").agg(F.min(F.when(ok, c("r"))).alias("r"))
    return cover.select(
        "grp", "pos", "method", "path", F.when(c("r").isNotNull(), "CURRENT").otherwise("GAP").alias("status"), c("r.file").alias("file")
    )


def orphan_refs(endpoints: DataFrame, refs: DataFrame) -> DataFrame:
    """References whose path matches no endpoint, once per normalised path."""
    t = _templates(endpoints)
    keyed = _ref_keys(refs, t)
    hit = keyed.join(t.select("grp", "k", "masked").distinct(), ["grp", "k", "masked"], "left_semi").select("grp", "norm").distinct()
    rest = refs.withColumn("norm", _ref_norm(c("path"))).join(hit, ["grp", "norm"], "left_anti")
    return rest.groupBy("grp", "norm").agg(F.min(F.struct("pos", "method", "path", "file")).alias("r")).select("grp", "r.*")


def _ref_base(ref: Column) -> Column:
    """Schema name of a reference: array suffix, generic wrapper and pointer prefix removed."""
    s = F.regexp_replace(F.trim(ref), r"\[\]$", "")
    s = F.when(s.rlike("<.*>"), F.regexp_extract(s, "<(.*)>", 1)).otherwise(s)
    return F.nullif(F.trim(F.substring_index(s, "/", -1)), F.lit(""))


def scope_model(endpoints: DataFrame, signatures: DataFrame, schemas: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen endpoints, and every schema reachable from their bodies and responses.

    ``endpoints``: scan_id, method, path, refs array; ``edges``: scan_id, schema, ref_schema. Breadth first,
    one visited set per scan; each round looks at new schemas only and writes nothing else."""
    kept = endpoints.withColumn("signature", paths.endpoint_label(c("method"), c("path"))).join(signatures, ["scan_id", "signature"], "left_semi")
    known = schemas.select("scan_id", "schema").distinct()
    links = edges.filter(c("ref_schema").isNotNull()).select("scan_id", "schema", _ref_base(c("ref_schema")).alias("next")).distinct()
    frontier = kept.select("scan_id", F.explode("refs").alias("ref")).select("scan_id", _ref_base(c("ref")).alias("schema"))
    links, known = cut_lineage(links), cut_lineage(known)
    below = lambda new: new.join(links, ["scan_id", "schema"]).select("scan_id", c("next").alias("schema")).join(known, ["scan_id", "schema"], "left_semi")
    return kept, closure(frontier.join(known, ["scan_id", "schema"], "left_semi"), below)


# --- plans ------------------------------------------------------------------------------------------------


def coverage_summary(items: DataFrame, plan_orphans: DataFrame, actions: DataFrame) -> DataFrame:
    """Counts per plan; every input is aggregated before the plans meet."""
    a = items.groupBy("plan_id").agg(
        F.count("*").alias("total"), F.count_if(c("status") == "MATCHED").alias("matched"), F.count_if(c("status") == "GAP").alias("gaps")
    )
    b = plan_orphans.groupBy("plan_id").agg(F.count("*").alias("orphans"))
    d = actions.groupBy("plan_id").agg(F.count_if(c("action") == "CREATED").alias("created"))
    return a.join(b, "plan_id", "full").join(d, "plan_id", "full").na.fill(0)


def dimensions(cases: DataFrame) -> DataFrame:
    """Planned items per dimension of a case, blank values left out."""
    rows = cases.unpivot(["plan_id", "title"], ["technique", "level", "type", "risk_id", "requirement_key"], "dimension", "value")
    return rows.filter(F.trim("value") != "").withColumn("dimension", F.upper("dimension"))


def routing(conditions: DataFrame) -> DataFrame:
    """Condition references by automation candidacy, one row each (no per-strategy list)."""
    return conditions.select("strategy", rules.normalise_automation(c("raw")).alias("automation"), "ref")


def merge_parts(cases: DataFrame, risks: DataFrame, reviews: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """Merge the batches of a plan: first case and risk per key, least confidence, distinct notes."""
    key = F.concat(F.coalesce("requirement_key", F.lit("")), F.lit("|"), text.norm_blank(c("title")))
    blank_id = F.coalesce(F.trim("risk_id"), F.lit("")) == ""
    rkey = F.when(blank_id, F.concat(F.lit("desc:"), text.norm_blank(c("description")))).otherwise(c("risk_id"))
    order = [F.asc("part"), F.asc("pos")]
    return {
        "cases": first_k(cases.withColumn("mk", key), ["plan_id", "mk"], order),
        "risks": first_k(risks.withColumn("mk", rkey), ["plan_id", "mk"], order),
        "confidence": reviews.groupBy("plan_id").agg(F.min("confidence").alias("confidence")),
        "notes": first_k(notes, ["plan_id", "note"], order),
    }


def reachable_statuses(calls: DataFrame, throws: DataFrame, direct: DataFrame, local: DataFrame, handlers: DataFrame,
                       annotations: DataFrame, defaults: DataFrame) -> DataFrame:
    """Error statuses an endpoint can reach over one call hop.

    Called service methods contribute the exceptions they throw, next to the endpoint's own throws. The status
    of an exception comes from the first handler, else its annotation, else the framework default. Handlers of
    the controller itself add their statuses with their own origin. Only errors count; per endpoint and status
    the origin written first wins (throws before local handlers)."""
    called = calls.select("svc", "called", "endpoint").distinct()
    hop = called.join(throws.select("svc", "called", "exception").distinct(), ["svc", "called"]).select("svc", "endpoint", "exception")
    edges = hop.unionByName(direct.select("svc", "endpoint", "exception")).distinct()
    h = handlers.groupBy("svc", "exception").agg(F.min_by("status", "pos").alias("h"))
    a = annotations.groupBy("svc", "exception").agg(F.min("status").alias("a"))
    d = defaults.groupBy("exception").agg(F.min("status").alias("d"))
    j = edges.join(h, ["svc", "exception"], "left").join(a, ["svc", "exception"], "left").join(d, "exception", "left")
    thrown = j.select("svc", "endpoint", F.coalesce("h", "a", "d").alias("status"), F.lit(0).alias("rank"), F.lit("EXCEPTION_HANDLER_REACHABLE").alias("origin"))
    own = local.select("svc", "endpoint", "status", F.lit(1).alias("rank"), "origin")
    rows = thrown.unionByName(own).filter(c("status") >= 400)
    best = rows.groupBy("svc", "endpoint", "status").agg(F.min(F.struct("rank", "origin")).alias("o"))
    return best.select("svc", "endpoint", "status", c("o.origin").alias("origin"))
