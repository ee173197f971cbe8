"""Evidence units, features and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from concordat.functions import text
from concordat.operators import evidence as ev
from concordat.plans import duck
from concordat.plans.dialect import pick
from concordat.plans.registry import fixture, query

c = F.col


def _units(ctx, name="units"):
    """Units with the hints of their whole texts."""
    return ctx.fx(name).withColumn("hints", text.hints_text(c("text")))


_CL = f"""u AS (SELECT *, {duck.stems("text")} AS st FROM fx_units),
 cl AS (SELECT * FROM u WHERE coalesce(lifecycle <> 'DESCOPED', true) AND type NOT IN ('GLOBAL_CAVEAT', 'STANDARD')),
 sx AS (SELECT id, unnest(st) AS x FROM cl), pr AS (SELECT a.id, a.x, b.x AS y FROM sx a JOIN sx b ON a.id = b.id AND a.x < b.x),
 mn AS (SELECT x, y, min(id) AS b FROM pr GROUP BY ALL), ed AS (SELECT DISTINCT pr.id AS a, mn.b FROM pr JOIN mn USING (x, y) WHERE pr.id <> mn.b)"""


_COMP = f"""WITH RECURSIVE {_CL}, e2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
 lab AS (SELECT id, id AS l FROM cl UNION SELECT e2.b, lab.l FROM lab JOIN e2 ON e2.a = lab.id AND lab.l < e2.b),
 cm AS (SELECT id, min(l) AS l FROM lab GROUP BY id),
 fid AS (SELECT l, 'feat-' || {duck.set_digest("id")} AS feature_id FROM cm GROUP BY l),
 mb AS (SELECT cl.*, feature_id FROM cl JOIN cm USING (id) JOIN fid USING (l))"""

_STATUS = """CASE WHEN code AND intent THEN CASE WHEN active THEN 'PARTIAL' ELSE 'IMPLEMENTED' END WHEN code THEN 'UNDOCUMENTED' WHEN done AND NOT active THEN 'COVERAGE_GAP' ELSE 'PLANNED' END"""


def _described(members: str) -> str:
    return f"""sa AS (SELECT feature_id, bool_or(source = 'CODE') AS code, bool_or(source <> 'CODE') AS intent, coalesce(bool_or(source <> 'CODE' AND lifecycle IN ('TO_DO', 'IN_PROGRESS')), false) AS active,
   coalesce(bool_or(source <> 'CODE' AND lifecycle = 'DONE'), false) AS done, count(*) AS size FROM {members} GROUP BY feature_id),
 hn AS (SELECT feature_id, s, count(*) AS n FROM (SELECT feature_id, unnest(st) AS s FROM {members}) GROUP BY ALL),
 hb AS (SELECT feature_id, arg_min(s, (-n, -length(s), s)) AS s FROM hn GROUP BY feature_id),
 tt AS (SELECT feature_id, arg_min(title, num) AS t FROM {members} WHERE trim(title) <> '' GROUP BY feature_id),
 ft AS (SELECT sa.feature_id, {_STATUS} AS status, size, coalesce(hb.s, tt.t, sa.feature_id) AS name FROM sa LEFT JOIN hb USING (feature_id) LEFT JOIN tt USING (feature_id))"""


@query("jn_36", f"{_COMP} SELECT id AS a, l AS b FROM cm WHERE id <> l")
def jn_36(ctx):
    linked = ev.hint_components(ev.clusterable(_units(ctx)))
    return linked.filter(c("id") != c("label")).select(c("id").alias("a"), c("label").alias("b"))


@query("gr_1", f"{_COMP} SELECT id AS unit_id, feature_id FROM mb")
def gr_1(ctx):
    return ev.seed_features(_units(ctx))[1].select("unit_id", "feature_id")


@query("gr_1_features", f"{_COMP}, {_described('mb')} SELECT feature_id, name, status, size FROM ft")
def gr_1_features(ctx):
    return ev.seed_features(_units(ctx))[0].select("feature_id", "name", "status", "size")


# --- features given by a table --------------------------------------------------------------------------------------


@fixture
def feature_units(d) -> str:
    return """
    SELECT id, num, source, type, title, text, lifecycle, concat('f', num % 97) AS feature_id FROM fx_units"""


_FU = f"fu AS (SELECT *, {duck.stems('text')} AS st FROM fx_feature_units)"


def _members(ctx):
    return _units(ctx, "feature_units")


@query("agg_26", f"WITH {_FU}, {_described('fu')} SELECT feature_id, status, size FROM ft")
def agg_26(ctx):
    return ev.feature_status(_members(ctx))


@query("agg_27", f"WITH {_FU}, {_described('fu')} SELECT feature_id, name FROM ft")
def agg_27(ctx):
    return ev.dominant_hint(_members(ctx))


@fixture
def sparse_units(d) -> str:
    return """
    SELECT id, num, source, type, title, text, lifecycle, concat(source, '-', num % 40) AS feature_id FROM fx_units"""


_SU = f"su AS (SELECT *, {duck.stems('text')} AS st FROM fx_sparse_units)"


@query(
    "agg_28",
    f"""WITH {_SU}, {_described('su')} SELECT feature_id, CASE status WHEN 'PLANNED' THEN 'PLANNED_NOT_IMPLEMENTED' WHEN 'UNDOCUMENTED' THEN 'IMPLEMENTED_UNDOCUMENTED' ELSE status END AS kind,
      '"' || name || '"' || CASE status WHEN 'PLANNED' THEN ' is specified but no implementing code was found — its tests are pending until it''s built.'
        WHEN 'UNDOCUMENTED' THEN ' is implemented but unspecified — confirm the intent (possible scope creep).'
        ELSE ' is marked done in Jira but no implementing code was found — confirm whether it shipped (a coverage gap, not a planned feature).' END AS message
    FROM ft WHERE status IN ('PLANNED', 'UNDOCUMENTED', 'COVERAGE_GAP')""",
)
def agg_28(ctx):
    return ev.gaps(ev.describe_features(_units(ctx, "sparse_units")))


@query(
    "jn_37",
    f"""WITH {_SU}, {_described('su')}, s AS (SELECT DISTINCT feature_id, unnest(st) AS x FROM su)
    SELECT p.feature_id AS planned, u.feature_id AS undocumented, count(*) AS shared FROM s p JOIN s u ON p.x = u.x JOIN ft a ON a.feature_id = p.feature_id AND a.status IN ('PLANNED', 'COVERAGE_GAP')
      JOIN ft b ON b.feature_id = u.feature_id AND b.status = 'UNDOCUMENTED' GROUP BY ALL HAVING count(*) >= 2""",
)
def jn_37(ctx):
    m = _units(ctx, "sparse_units")
    return ev.misclusters(ev.feature_status(m), m)


@fixture
def cites(d) -> str:
    return f"""
    SELECT doc_id AS cite, concat('sec', doc_id % 60) AS section, concat('f', CASE WHEN doc_id % 8 = 0 THEN doc_id + 1 ELSE doc_id END % 97) AS feature_id,
           CASE doc_id % 13 WHEN 0 THEN ' ' WHEN 1 THEN concat('doc-', doc_id + 5) ELSE concat('doc-', doc_id) END AS unit_id,
           CASE doc_id % 6 WHEN 0 THEN ' ' WHEN 1 THEN substr(text, 4, 11) WHEN 2 THEN concat('  ', replace(substr(text, 1, 43), 'e', 'E')) WHEN 3 THEN concat(substr(text, 9, 30), ' qqq') ELSE substr(text, 20, 25) END AS quote
    FROM {d.t("documents")}"""


_CITE = f"""al AS (SELECT id AS unit_id, feature_id FROM fx_feature_units), cr AS (SELECT id FROM fx_feature_units WHERE type IN ('GLOBAL_CAVEAT', 'STANDARD')),
 k AS (SELECT q.*, {duck.norm_blank("q.quote")} AS nq, {duck.norm_blank("u.text")} AS nt, u.text, coalesce(trim(q.unit_id), '') <> '' AND (EXISTS (SELECT 1 FROM al WHERE al.unit_id = q.unit_id AND al.feature_id = q.feature_id) OR q.unit_id IN (SELECT id FROM cr)) AS ok
   FROM fx_cites q LEFT JOIN fx_feature_units u ON u.id = q.unit_id),
 ck AS (SELECT cite, section, CASE WHEN NOT ok THEN 'NOT_ALLOWED' WHEN text IS NULL THEN 'NO_UNIT' WHEN nq = '' THEN 'NO_QUOTE' WHEN length(nq) < 12 THEN 'TOO_SHORT' WHEN NOT contains(nt, nq) THEN 'NOT_FOUND' END AS problem FROM k)"""


def _checked(ctx):
    u = ctx.fx("feature_units")
    members = u.select("feature_id", c("id").alias("unit_id"))
    return ev.validate_citations(ctx.fx("cites"), u, ev.feature_slice(members, u))


@query("jn_38", f"WITH {_CITE} SELECT cite, section, problem FROM ck")
def jn_38(ctx):
    return _checked(ctx).select("cite", "section", "problem")


@query("jn_38_sections", f"WITH {_CITE} SELECT section, bool_and(problem IS NULL) AS valid, count(problem) AS problems FROM ck GROUP BY section")
def jn_38_sections(ctx):
    return ev.section_verdicts(_checked(ctx))


@fixture
def claims(d) -> str:
    return f"""
    SELECT doc_id AS claim_id, concat('sec', doc_id % 60) AS section, CASE WHEN doc_id % 9 = 0 THEN 'doc-0' ELSE concat('doc-', doc_id) END AS ref,
           CASE doc_id % 4 WHEN 0 THEN 'a an it' WHEN 1 THEN 'zzzz qqqq wwww' ELSE substr(text, 1, 60) END AS claim FROM {d.t("documents")}"""


@query(
    "jn_39",
    f"""WITH ci AS (SELECT DISTINCT section, unit_id FROM fx_cites WHERE trim(unit_id) <> ''),
    k AS (SELECT q.claim_id, ci.unit_id IS NOT NULL AS cited, u.text IS NOT NULL AS has, len(list_filter(string_split({duck.norm_blank("q.claim")}, ' '), lambda w: length(w) >= 4 AND contains({duck.norm_blank("u.text")}, w))) > 0 AS shares
      FROM fx_claims q LEFT JOIN ci ON ci.section = q.section AND ci.unit_id = q.ref LEFT JOIN fx_feature_units u ON u.id = q.ref)
    SELECT claim_id, CASE WHEN NOT cited THEN 'NOT_CITED' WHEN has AND NOT shares THEN 'NO_SHARED_TERM' END AS problem FROM k""",
)
def jn_39(ctx):
    return ev.validate_claims(ctx.fx("claims"), ctx.fx("cites"), ctx.fx("feature_units")).select("claim_id", "problem")


@query("gr_5", """SELECT feature_id, id AS unit_id FROM fx_feature_units UNION ALL SELECT '*', id FROM fx_feature_units WHERE type IN ('GLOBAL_CAVEAT', 'STANDARD')""")
def gr_5(ctx):
    u = ctx.fx("feature_units")
    return ev.feature_slice(u.select("feature_id", c("id").alias("unit_id")), u)


@fixture
def indexed_units(d) -> str:
    return """
    SELECT concat('ix', num % 3) AS index_id, id, source, type, title, text, concat('f', num % 96) AS feature_id FROM fx_units"""


@query(
    "jn_41",
    """WITH n AS (SELECT *, CASE WHEN id LIKE 'doc-%77' AND type = 'SECTION' THEN text || '!' ELSE text END AS t2 FROM fx_indexed_units),
    ch AS (SELECT index_id, feature_id, bool_or(t2 <> text) AS changed FROM n GROUP BY ALL), cx AS (SELECT index_id, bool_or(t2 <> text) AS c2 FROM n WHERE type IN ('GLOBAL_CAVEAT', 'STANDARD') GROUP BY ALL)
    SELECT ch.index_id, ch.feature_id, k AS section FROM ch LEFT JOIN cx USING (index_id) JOIN (SELECT unnest(['risk', 'approach']) AS k) ON true WHERE NOT changed AND NOT coalesce(c2, false)""",
)
def jn_41(ctx):
    old = ctx.fx("indexed_units")
    touched = F.when(c("id").rlike("^doc-.*77$") & (c("type") == "SECTION"), F.concat("text", F.lit("!"))).otherwise(c("text"))
    new = old.withColumn("text", touched)
    members = old.select("index_id", "feature_id", c("id").alias("unit_id"))
    sections = members.select("index_id", "feature_id").distinct().withColumn("section", F.explode(F.array(F.lit("risk"), F.lit("approach"))))
    return ev.reusable_sections(ev.grounding(members, old), ev.grounding(members, new), sections)


@fixture
def strategy_sections(d) -> str:
    return f"""
    SELECT source AS strategy, concat('f', doc_id % 30) AS feature_id, CASE WHEN doc_id % 7 < 4 AND doc_id % 30 < 25 THEN 'risk' ELSE 'approach' END AS kind, doc_id % 5 AS n_evidence FROM {d.t("documents")}"""


@fixture
def strategy_features(d) -> str:
    return f"""
    SELECT DISTINCT source AS strategy, concat('f', doc_id % 33) AS feature_id, {pick("doc_id % 33 % 5", ["IMPLEMENTED", "PLANNED", "UNDOCUMENTED", "PARTIAL", "COVERAGE_GAP"])} AS status FROM {d.t("documents")}
    UNION ALL SELECT 'quiet' AS strategy, 'f1' AS feature_id, 'UNDOCUMENTED' AS status FROM {d.t("region")} WHERE r_regionkey = 0"""


@fixture
def strategy_dropped(d) -> str:
    return f"SELECT source AS strategy, doc_id FROM {d.t('documents')} WHERE doc_id % 50 = 0"


@fixture
def strategy_gaps(d) -> str:
    return f"SELECT DISTINCT source AS strategy, concat('f', doc_id % 33) AS feature_id FROM {d.t('documents')} WHERE doc_id % 4 > 0"


_ASYM = "asy AS (SELECT strategy, feature_id FROM fx_strategy_sections GROUP BY ALL HAVING count(DISTINCT kind) = 1)"


@query("set_4", f"WITH {_ASYM} SELECT strategy, feature_id FROM asy")
def set_4(ctx):
    return ev.asymmetric(ctx.fx("strategy_sections"))


@query(
    "agg_29",
    f"""WITH {_ASYM}, cv AS (SELECT DISTINCT strategy, feature_id FROM fx_strategy_sections), s AS (SELECT strategy FROM fx_strategy_features UNION SELECT strategy FROM fx_strategy_sections),
    x AS (SELECT strategy, (SELECT count(*) FROM fx_strategy_dropped d WHERE d.strategy = s.strategy) AS dropped, (SELECT count(*) FROM asy a WHERE a.strategy = s.strategy) AS "asymmetric",
      (SELECT count(*) FROM fx_strategy_features f WHERE f.strategy = s.strategy AND status IN ('IMPLEMENTED', 'PARTIAL') AND NOT EXISTS (SELECT 1 FROM cv WHERE cv.strategy = f.strategy AND cv.feature_id = f.feature_id)) AS uncovered,
      (SELECT count(*) FROM fx_strategy_features f WHERE f.strategy = s.strategy AND status IN ('PLANNED', 'COVERAGE_GAP') AND NOT EXISTS (SELECT 1 FROM fx_strategy_gaps g WHERE g.strategy = f.strategy AND g.feature_id = f.feature_id)) AS unraised,
      (SELECT count(*) FROM fx_strategy_sections q WHERE q.strategy = s.strategy AND n_evidence = 0) AS ungrounded, (SELECT count(*) FROM cv WHERE cv.strategy = s.strategy) AS covered FROM s),
    y AS (SELECT *, (dropped = 0)::INT + ("asymmetric" = 0)::INT + (uncovered = 0)::INT + (unraised = 0)::INT + (ungrounded = 0)::INT AS passed FROM x)
    SELECT *, CAST(floor(100.0 * passed / 5 + 0.5) AS BIGINT) AS confidence, CASE WHEN passed = 5 THEN 'OK' ELSE 'DEGRADED' END AS verdict FROM y""",
)
def agg_29(ctx):
    return ev.strategy_scorecard(*[ctx.fx("strategy_" + n) for n in ("sections", "dropped", "features", "gaps")])


@fixture
def extracts(d) -> str:
    return f"""
    SELECT concat(source, '-', lang) AS source, CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 1 END AS requested, CASE WHEN lang = 'de' AND source = 'src3' THEN 0 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS fetched,
           CASE WHEN doc_id % 3 > 0 THEN 'timeout' END AS error FROM {d.t("documents")}"""


@query("agg_30", """SELECT source, CAST(sum(requested) AS BIGINT) AS requested, CAST(sum(fetched) AS BIGINT) AS fetched, count(error) AS failed,
   sum(requested) > 0 AND sum(fetched) = 0 AS hard_fail FROM fx_extracts GROUP BY source""")  # fmt: skip
def agg_30(ctx):
    return ev.provenance(ctx.fx("extracts"))


# --- edits ------------------------------------------------------------------------------------------------------------


@fixture
def merge_groups(d) -> str:
    return f"""
    SELECT quality * 2 + toxic + 4 * (doc_id % 20) AS group_pos, doc_id AS ref_pos, concat('f', doc_id % 110) AS ref, CASE WHEN doc_id % 20 < 9 THEN ' ' ELSE concat('Group ', doc_id % 20) END AS name FROM {d.t("labels")}"""


_GROUPS = f"""{_FU}, {_described('fu')}, tk AS (SELECT * FROM (SELECT g.*, ft.name AS own, row_number() OVER (PARTITION BY ref ORDER BY group_pos, ref_pos) AS rn FROM fx_merge_groups g JOIN ft ON ft.feature_id = g.ref) WHERE rn = 1),
 nm AS (SELECT group_pos, arg_min(struct_pack(a := name, b := own), ref_pos) AS n FROM tk GROUP BY group_pos),
 mm AS (SELECT fu.*, tk.group_pos FROM fu LEFT JOIN tk ON tk.ref = fu.feature_id),
 gi AS (SELECT group_pos, 'feat-' || {duck.set_digest("id")} AS new_id FROM mm WHERE group_pos IS NOT NULL GROUP BY group_pos)"""


@query(
    "gr_2",
    f"""WITH {_GROUPS}, o AS (SELECT coalesce(gi.new_id, mm.feature_id) AS feature_id, mm.source, mm.lifecycle FROM mm LEFT JOIN gi USING (group_pos)),
    s2 AS (SELECT feature_id, bool_or(source = 'CODE') AS code, bool_or(source <> 'CODE') AS intent, coalesce(bool_or(source <> 'CODE' AND lifecycle IN ('TO_DO', 'IN_PROGRESS')), false) AS active,
      coalesce(bool_or(source <> 'CODE' AND lifecycle = 'DONE'), false) AS done, count(*) AS size FROM o GROUP BY feature_id)
    SELECT s2.feature_id, {_STATUS} AS status, size, CASE WHEN gi.group_pos IS NULL THEN ft2.name ELSE coalesce(nullif(trim(nm.n.a), ''), nm.n.b) END AS name
    FROM s2 LEFT JOIN gi ON gi.new_id = s2.feature_id LEFT JOIN nm ON nm.group_pos = gi.group_pos LEFT JOIN (SELECT feature_id, name FROM ft) ft2 ON ft2.feature_id = s2.feature_id""",
)
def gr_2(ctx):
    m = _members(ctx)
    out, _ = ev.apply_groups(ev.describe_features(m), m, ctx.fx("merge_groups"))
    return out.select("feature_id", "status", "size", "name")


@fixture
def hand_merges(d) -> str:
    return f"""
    SELECT concat('m', n_regionkey) AS merge_id, n_nationkey AS pos, concat('f', CASE WHEN n_regionkey = 4 THEN 90 ELSE n_nationkey * 4 END) AS feature_id,
           CASE WHEN n_regionkey % 2 = 0 THEN concat(' Merged ', n_regionkey, ' ') END AS name FROM {d.t("nation")}"""


@fixture
def pinned(d) -> str:
    return f"SELECT concat('f', s_suppkey) AS feature_id FROM {d.t('supplier')} WHERE s_suppkey % 2 = 0"


@query(
    "gr_3",
    f"""WITH {_FU}, {_described('fu')}, v AS (SELECT h.merge_id, h.feature_id, h.name, min(h.pos) AS pos, ft.name AS own, ft.size FROM fx_hand_merges h JOIN ft USING (feature_id) GROUP BY ALL),
    b AS (SELECT merge_id, max(name) AS given, arg_min(own, (-size, pos)) AS largest FROM v GROUP BY merge_id HAVING count(*) >= 2),
    mm AS (SELECT fu.*, v.merge_id FROM fu LEFT JOIN (SELECT v.* FROM v JOIN b USING (merge_id)) v USING (feature_id)),
    gi AS (SELECT merge_id, 'feat-' || {duck.set_digest("id")} AS new_id FROM mm WHERE merge_id IS NOT NULL GROUP BY merge_id),
    o AS (SELECT coalesce(gi.new_id, mm.feature_id) AS feature_id, any_value(mm.merge_id) AS merge_id, count(*) AS size, any_value(mm.feature_id) AS old FROM mm LEFT JOIN gi USING (merge_id) GROUP BY 1),
    pn AS (SELECT DISTINCT coalesce(gi.new_id, p.feature_id) AS feature_id FROM fx_pinned p LEFT JOIN v ON v.feature_id = p.feature_id LEFT JOIN gi ON gi.merge_id = v.merge_id)
    SELECT o.feature_id, o.size, CASE WHEN o.merge_id IS NULL THEN ft.name ELSE coalesce(nullif(trim(b.given), ''), b.largest) END AS name, pn.feature_id IS NOT NULL AS pinned
    FROM o LEFT JOIN b ON b.merge_id = o.merge_id LEFT JOIN ft ON ft.feature_id = o.old AND o.merge_id IS NULL LEFT JOIN pn ON pn.feature_id = o.feature_id""",
)
def gr_3(ctx):
    m = _members(ctx)
    out, pins = ev.merge_features(ev.describe_features(m), m, ctx.fx("hand_merges"), ctx.fx("pinned"))
    flags = pins.withColumn("pinned", F.lit(True))
    return out.join(flags, "feature_id", "left").select("feature_id", "size", "name", F.coalesce("pinned", F.lit(False)).alias("pinned"))


@fixture
def service_members(d) -> str:
    return f"""
    SELECT source AS service, concat('f', doc_id % 60) AS feature_id, concat('doc-', doc_id) AS unit_id FROM {d.t("documents")}"""


@fixture
def edit_units(d) -> str:
    return f"""
    SELECT DISTINCT source AS service, CAST(doc_id % 4 AS INTEGER) AS edit, CASE WHEN doc_id % 4 = 3 THEN concat('gone-', doc_id) ELSE concat('doc-', CASE WHEN doc_id % 4 = 1 THEN doc_id % 200 ELSE doc_id % 120 END) END AS unit_id
    FROM {d.t("documents")}"""


@fixture
def edit_log(d) -> str:
    return f"""
    SELECT DISTINCT source AS service, CAST(doc_id % 4 AS INTEGER) AS edit, {pick("doc_id % 4", ["MERGE", "RENAME", "PIN", "RENAME"])} AS kind,
           CASE WHEN doc_id % 4 = 0 THEN 'Joined' WHEN doc_id % 4 = 1 THEN concat('Name of ', source) WHEN doc_id % 4 = 3 THEN 'lost' END AS name, doc_id % 4 = 2 AS pinned FROM {d.t("documents")}"""


@query(
    "jn_47",
    """WITH sz AS (SELECT service, feature_id, count(*) AS size FROM fx_service_members GROUP BY ALL),
    n AS (SELECT e.service, e.edit, m.feature_id, count(*) AS n, any_value(size) AS size FROM fx_edit_units e JOIN fx_service_members m USING (service, unit_id) JOIN sz ON sz.service = m.service AND sz.feature_id = m.feature_id GROUP BY ALL)
    SELECT service, edit, arg_min(feature_id, (-n, size, feature_id)) AS feature_id, max(n) AS overlap, count(*) AS parts FROM (SELECT * FROM n) GROUP BY service, edit""",
)
def jn_47(ctx):
    return ev.best_overlap(ctx.fx("edit_units"), ctx.fx("service_members"))


def _best(members: str, edit: int) -> str:
    """Per service of an edit: how many features share units with it, and the one that shares most."""
    return f"""(SELECT service, count(*) AS parts, arg_min(feature_id, (-n, size, feature_id)) AS feature_id, sum(n) AS n, sum(size) AS size FROM (
      SELECT m.service, m.feature_id, count(e.unit_id) AS n, count(*) AS size FROM {members} m LEFT JOIN (SELECT * FROM fx_edit_units WHERE edit = {edit}) e USING (service, unit_id)
      GROUP BY ALL HAVING count(e.unit_id) > 0) GROUP BY service)"""


# The fourth edit of a service names units that are gone, so it is always lost.
_REPLAY = f"""WITH m0 AS (SELECT DISTINCT service, feature_id, unit_id FROM fx_service_members), l AS (SELECT * FROM fx_edit_log),
 b0 AS {_best("m0", 0)}, many AS (SELECT b0.* FROM b0 JOIN l USING (service) WHERE l.edit = 0 AND parts > 1),
 tg AS (SELECT DISTINCT m0.service, m0.feature_id FROM m0 JOIN fx_edit_units e USING (service, unit_id) JOIN many ON many.service = m0.service WHERE e.edit = 0),
 ids AS (SELECT service, 'feat-' || {duck.set_digest("unit_id")} AS new_id FROM m0 SEMI JOIN tg USING (service, feature_id) GROUP BY service),
 m1 AS (SELECT m0.service, CASE WHEN tg.feature_id IS NULL THEN m0.feature_id ELSE ids.new_id END AS feature_id, unit_id, tg.feature_id IS NOT NULL AS joined FROM m0 LEFT JOIN tg USING (service, feature_id) LEFT JOIN ids USING (service)),
 b1 AS {_best("m1", 1)}, b2 AS {_best("m1", 2)},
 f AS (SELECT DISTINCT m1.service, m1.feature_id, CASE WHEN r.service IS NOT NULL THEN trim(r.name) WHEN joined OR a.service IS NOT NULL THEN 'Joined' ELSE m1.feature_id END AS name, p.service IS NOT NULL AS pinned FROM m1
   LEFT JOIN (SELECT b0.service, b0.feature_id FROM b0 JOIN l USING (service) WHERE l.edit = 0 AND parts = 1) a ON a.service = m1.service AND a.feature_id = m1.feature_id
   LEFT JOIN (SELECT b1.service, b1.feature_id, l.name FROM b1 JOIN l USING (service) WHERE l.edit = 1) r ON r.service = m1.service AND r.feature_id = m1.feature_id
   LEFT JOIN (SELECT b2.service, b2.feature_id FROM b2 JOIN l USING (service) WHERE l.edit = 2) p ON p.service = m1.service AND p.feature_id = m1.feature_id),
 split AS (SELECT ' to the largest remaining part — that feature was split across several features in the new extraction.' AS t),
 n AS (SELECT service, 0 AS edit, 'Re-applied a merge ("Joined"): the new extraction had grouped additional units into those features, so the merged feature now includes them.' AS note FROM many WHERE size > n
   UNION ALL SELECT service, 1, 'Re-applied a rename ("Name of ' || service || '")' || t FROM b1 JOIN l USING (service), split WHERE edit = 1 AND parts > 1
   UNION ALL SELECT service, 2, 'Re-applied a pin' || t FROM b2 JOIN l USING (service), split WHERE edit = 2 AND parts > 1
   UNION ALL SELECT l.service, l.edit, CASE l.edit WHEN 0 THEN 'Couldn''t re-apply a merge ("Joined"): those features are no longer separate features in the new extraction.'
     WHEN 1 THEN 'Couldn''t re-apply a rename ("' || l.name || '"): that feature is no longer present in the new extraction.' ELSE 'Couldn''t re-apply a pin: that feature is no longer present in the new extraction.' END
     FROM l LEFT JOIN b0 ON b0.service = l.service LEFT JOIN b1 ON b1.service = l.service LEFT JOIN b2 ON b2.service = l.service
     WHERE (l.edit = 0 AND b0.service IS NULL) OR (l.edit = 1 AND b1.service IS NULL) OR (l.edit = 2 AND b2.service IS NULL)
   UNION ALL SELECT service, 3, 'Couldn''t re-apply a rename ("lost"): that feature is no longer present in the new extraction.' FROM l WHERE edit = 3)
 SELECT service, 'feature' AS kind, feature_id, name, pinned FROM f UNION ALL SELECT service, 'note', CAST(edit AS VARCHAR), note, false FROM n"""


@query("gr_4", _REPLAY)
def gr_4(ctx):
    m = ctx.fx("service_members")
    f = m.select("service", "feature_id", c("feature_id").alias("name")).distinct()
    out = ev.replay_edits(f, m, ctx.fx("edit_log"), ctx.fx("edit_units"))
    pins = out["pins"].withColumn("pinned", F.lit(True))
    feats = out["features"].join(pins, ["service", "feature_id"], "left").select(
        "service", F.lit("feature").alias("kind"), "feature_id", "name", F.coalesce("pinned", F.lit(False)).alias("pinned")
    )
    notes = out["notes"].select("service", F.lit("note").alias("kind"), c("edit").cast("string").alias("feature_id"), c("note").alias("name"), F.lit(False).alias("pinned"))
    return feats.unionByName(notes)


@query(
    "src_7",
    """WITH u AS (SELECT 'CONFLUENCE' AS source, 'doc-' || doc_id AS id, source AS origin FROM documents UNION ALL SELECT 'JIRA', 'c-' || conv_id || '-' || turn, 'c-' || conv_id FROM conversations)
    SELECT 'unit' AS kind, source, id, NULL::BIGINT AS requested, NULL::BIGINT AS fetched FROM u
    UNION ALL SELECT 'provenance', source, NULL, count(DISTINCT origin), count(DISTINCT origin) FROM u GROUP BY source UNION ALL SELECT 'provenance', 'CODE', NULL, 1, 0""",
)
def src_7(ctx):
    docs = ctx.table("documents").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), c("source").alias("origin"))
    conv = ctx.table("conversations").select(
        F.concat(F.lit("c-"), "conv_id", F.lit("-"), "turn").alias("id"), F.concat(F.lit("c-"), "conv_id").alias("origin"), "role"
    )
    units, prov = ev.evidence({"CODE": None, "JIRA": conv, "CONFLUENCE": docs})
    none = F.lit(None).cast("bigint")
    a = units.select(F.lit("unit").alias("kind"), "source", "id", none.alias("requested"), none.alias("fetched"))
    b = prov.select(F.lit("provenance").alias("kind"), "source", F.lit(None).cast("string").alias("id"), "requested", "fetched")
    return a.unionByName(b)
