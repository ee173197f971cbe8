"""Joins over graphs and sets: overlap components against all pairs, nested schemas with more paths than atoms."""

import os
import random
import subprocess
import sys

import pytest

from concordat.operators import evidence as ev
from concordat.operators import schemas as sc
from concordat.schemas import CONSTRAINTS, conform


ROOT = os.path.abspath(os.path.join(os.path.dirname(__file__), ".."))


def components(sets):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(set(sets[a]) & set(sets[b])) >= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("seed", "few", "rounds"), [(1, 8, 3), (3, 3, 0)])
def test_overlap_components(spark, seed, few, rounds):
    """Sparse and dense sets, long rows, common members that link nothing, chains through pairs of rare members."""
    rng = random.Random(seed)
    sets = {}
    for block in range(4):
        for i in range(25):
            sets[f"b{block}-{i:02}"] = {f"{block}:{x}" for x in rng.sample(range(160), rng.randint(1, 14))} | {"common"}
    for i in range(12):
        sets[f"c{i:02}"] = {f"k{i}", f"l{i}", f"k{i + 1}", f"l{i + 1}", "common"}
    sets["long"] = {f"0:{x}" for x in range(0, 160, 2)} | {f"z{x}" for x in range(300)}
    sets["single"], sets["none"], sets["twins1"], sets["twins2"] = {"common"}, set(), {"t1", "t2"}, {"t1", "t2"}
    frame = spark.createDataFrame([(k, sorted(v) * 2) for k, v in sets.items()], "id string, s array<string>").repartition(5)
    got = {r.id: r.label for r in ev.overlap_components(frame, few, rounds).collect()}
    assert got == components(sets)
    assert ev.overlap_components(spark.createDataFrame([], "id string, s array<string>")).collect() == []


FIELD = f"scan_id string, schema string, pos int, field string, type string, format string, required boolean, ref_schema string, constraints {CONSTRAINTS}"
SCHEMA = "scan_id string, schema string, type string, enum_values array<string>"


def chain(spark, n, last):
    """n schemas, each with the next under two names, and the fields of the last."""
    rows = [("s", f"S{i}", k, f, "object", None, False, f"S{i + 1}", None) for i in range(n) for k, f in enumerate("lr")]
    rows += [("s", f"S{n}", k, f, t, None, False, None, None) for k, (f, t) in enumerate(last)]
    return spark.createDataFrame([("s", f"S{i}", "object", None) for i in range(n + 1)], SCHEMA), spark.createDataFrame(rows, FIELD)


def test_diamonds(spark):
    """2**20 paths that hold no finding are never walked; verdicts come from the pairs."""
    same = [("x", "string"), ("y", "integer")]
    code, spec = chain(spark, 20, same), chain(spark, 20, same)
    blind = spark.createDataFrame([], "scan_id string, text string")
    root = spark.createDataFrame([("s", 1, "GET /a", "S0", "S0")], "scan_id string, binding_id long, locus string, code_ref string, spec_ref string")
    bound = sc.bound_field_diff(root, *code, *spec, blind)
    assert bound.findings.count() == 0 and bound.divergent.count() == 0
    code, spec, other = (chain(spark, 4, last) for last in (same, same, [("x", "string"), ("y", "string")]))
    assert [r.verdict for r in sc.structural_verdict(root, *code, *spec, blind).collect()] == ["MATCH"]
    differs = sc.bound_field_diff(root, *code, *other, blind)
    assert differs.divergent.count() == 1  # same names: told by the same-name comparison, not here
    assert differs.findings.count() == 0
    assert [r.verdict for r in sc.structural_verdict(root, *code, *other, blind).collect()] == ["DIFFER"]


def test_every_path_to_a_finding(spark):
    """A mismatch below three diamonds is told on all eight paths, a loop does not add any."""
    code = chain(spark, 3, [("x", "object")])
    fields = code[1].unionByName(spark.createDataFrame([("s", "S3", 5, "back", "object", None, False, "S0", None), ("s", "S3", 6, "sub", "object", None, False, "T", None), ("s", "T", 0, "z", "string", None, False, None, None)], FIELD))
    schemas = code[0].unionByName(spark.createDataFrame([("s", "T", "object", None)], SCHEMA))
    spec_fields = fields.replace({"T": "U"}, subset=["schema", "ref_schema"]).replace({"z": "w"}, subset=["field"])
    spec_schemas = schemas.replace({"T": "U"}, subset=["schema"])
    root = spark.createDataFrame([("s", 1, "GET /a", "S0[]", "S0[]"), ("s", 2, "GET /b", "S3", "S3"), ("s", 3, "GET /c", "S3[]", "S3")], "scan_id string, binding_id long, locus string, code_ref string, spec_ref string")
    bound = sc.bound_field_diff(root, schemas, fields, spec_schemas, spec_fields, spark.createDataFrame([], "scan_id string, text string"))
    found = sorted((r.binding_id, r.type, r.endpoint) for r in bound.findings.collect())
    ways = [a + "." + b + "." + x for a in "lr" for b in "lr" for x in "lr"]
    assert found == sorted([(1, t, f"GET /a.{w}.sub.{f}") for w in ways for t, f in (("SCHEMA_FIELD_MISSING", "z"), ("SCHEMA_FIELD_EXTRA", "w"))] + [(2, "SCHEMA_FIELD_MISSING", "GET /b.sub.z"), (2, "SCHEMA_FIELD_EXTRA", "GET /b.sub.w")])


def test_conform(spark):
    rows = spark.createDataFrame([("s", 1, "GET", "/a")], "scan_id string, pos int, method string, path string")
    out = conform(rows, "endpoints", ("scan_id", "path"))
    assert out.columns[:5] == ["scan_id", "side", "spec_id", "pos", "method"] and dict(out.dtypes)["pos"] == "bigint"
    with pytest.raises(ValueError, match="controller is missing"):
        conform(rows, "endpoints", ("controller",))
    with pytest.raises(ValueError, match="pos is string"):
        conform(rows.withColumn("pos", rows["path"]), "endpoints")


@pytest.mark.parametrize(("light", "block"), [(10_000, 1024), (6, 3), (0, 1024)])
def test_misclusters(spark, light, block):
    """The same counts whether a stem is joined or multiplied."""
    rng = random.Random(light + block)
    hints = {f"f{i:02}": sorted({f"word{x}q" for x in rng.sample(range(25), rng.randint(0, 9))} | ({"everywhere"} if i % 3 else set())) for i in range(40)}
    status = {f: ("PLANNED", "COVERAGE_GAP", "UNDOCUMENTED", "IMPLEMENTED")[i % 4] for i, f in enumerate(hints)}
    members = spark.createDataFrame([(f, h[k::2]) for f, h in hints.items() for k in (0, 1)], "feature_id string, hints array<string>")
    features = spark.createDataFrame(list(status.items()), "feature_id string, status string")
    want = {(a, b): len(set(hints[a]) & set(hints[b])) for a in hints for b in hints if status[a] in ("PLANNED", "COVERAGE_GAP") and status[b] == "UNDOCUMENTED"}
    got = {(r.planned, r.undocumented): r.shared for r in ev.misclusters(features, members, light=light, block=block).collect()}
    assert got == {k: n for k, n in want.items() if n >= 2}


def test_intermediate_tables_can_be_dropped(tmp_path):
    """In a process of its own: dropping touches every table that was written so far."""
    code = """
import os, sys
from concordat.session import cut_lineage, drop_intermediates, get_session
spark = get_session("drop", "local[1]", **{"spark.checkpoint.dir": sys.argv[1]})
a = cut_lineage(spark.range(5))
assert a.count() == 5 and any(n.startswith("table-") for _, d, _ in os.walk(sys.argv[1]) for n in d)
assert drop_intermediates(spark) == 1 and drop_intermediates(spark) == 0
assert not any(n.startswith("table-") for _, d, _ in os.walk(sys.argv[1]) for n in d)
print("dropped")
"""
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path)], env={**os.environ, "PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=240)
    assert out.stdout.strip().endswith("dropped"), out.stderr[-2000:]


def test_overlap_components_in_many_rounds(spark):
    """Postings too many for one round: members are settled one by one, and what is left is looked up in the largest."""
    rng = random.Random(7)
    sets = {f"r{i:02}": {f"m{x}" for x in rng.sample(range(60), rng.randint(1, 9))} | {"common"} for i in range(60)}
    sets |= {f"s{i}": {f"a{i}", f"a{i + 1}", f"b{i}", f"b{i + 1}"} for i in range(6)}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, s array<string>").repartition(3)
    pairs, made = ev._linking_pairs, []
    ev._linking_pairs = lambda p: made.append(p.count()) or pairs(p)
    try:
        got = {r.id: r.label for r in ev.overlap_components(frame, 0, 2, 150).collect()}
    finally:
        ev._linking_pairs = pairs
    assert got == components(sets)
    assert len(made) > 1 and max(made) < sum(len(s) * (len(s) - 1) // 2 for s in sets.values())


def skewed(rng, n, words, long):
    """Sets over one frequent and one rare vocabulary, many of which share nothing frequent."""
    sets = {f"u{i:03}": {f"w{int(words * rng.random() ** 3)}" for _ in range(rng.randint(0, long))} for i in range(n)}
    return sets | {f"v{i:03}": {f"w{rng.randrange(words)}", f"own{rng.randrange(9)}"} for i in range(n // 2)}


def test_overlap_components_settles_common_members_without_their_pairs(spark):
    """Long rows that common members link make fewer pairs than they have postings."""
    rng = random.Random(5)
    sets = {f"r{i:02}": {f"t{x}" for x in range(6)} | {f"m{x}" for x in rng.sample(range(400), 60)} for i in range(80)} | {"far1": {"p", "q", "m1"}, "far2": {"p", "q"}, "far3": {"p", "m1"}}
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, s array<string>").repartition(3)
    pairs, made = ev._linking_pairs, []
    ev._linking_pairs = lambda p: made.append(p.count()) or pairs(p)
    try:
        got = {r.id: r.label for r in ev.overlap_components(frame, least=1000).collect()}
    finally:
        ev._linking_pairs = pairs
    assert got == components(sets)
    assert sum(made) < 80 * 66


@pytest.mark.parametrize(("few", "rounds", "least", "chunk"), [(1000, 5, 8, 7), (1000, 64, 8, 1 << 20), (0, 3, 400, 1 << 20)])
def test_overlap_components_asks_the_largest(spark, few, rounds, least, chunk):
    """Rows that rounds leave outside ask for some pairs, then for all, in chunks."""
    rng = random.Random(few + rounds)
    sets = skewed(rng, 120, 200, 14)
    frame = spark.createDataFrame([(k, sorted(v)) for k, v in sets.items()], "id string, s array<string>").repartition(3)
    looked, meet = ev._looked_up, ev._meet
    ev._looked_up = lambda asked, n, large: looked(asked, n, large, max(chunk, -(-n // 3) if chunk == 7 else 0))
    ev._meet = lambda b, x, y: meet(b, x, y, chunk)
    try:
        got = {r.id: r.label for r in ev.overlap_components(frame, few, rounds, least).collect()}
    finally:
        ev._looked_up, ev._meet = looked, meet
    assert got == components(sets)


def test_hashes_that_clash_are_replaced(spark, monkeypatch):
    """Members that one seed gives one hash still count as two."""
    real = ev.F.xxhash64
    weak = lambda *cols: real(*cols) if isinstance(cols[0], str) else ev.F.when(cols[0] == ev.F.lit(0), ev.F.lit(7).cast("bigint")).otherwise(real(*cols))
    frame = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y", "x"]), ("c", ["z", "x"])], "id string, s array<string>")
    monkeypatch.setattr(ev.F, "xxhash64", weak)
    got = {r.id: r.label for r in ev.overlap_components(frame).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}


UNIT = "id string, num bigint, source string, type string, title string, text string, lifecycle string, hints array<string>"


def test_features_move_no_texts(spark, monkeypatch):
    """Clustering writes stems, never texts; of repeated ids the first number counts; units without an id link but are no members."""
    rows = [
        ("a", 1, "CODE", "ENDPOINT", "One", "t", None, ["orders", "claims", "users"]), ("a", 2, "JIRA", "ISSUE", "Two", "t", "DONE", ["other", "words"]),
        ("a", 1, "CODE", "ENDPOINT", "One", "t", None, ["orders", "claims", "users"]), ("b", 3, "CONFLUENCE", "SECTION", "Three", "t", None, ["item", "policy"]),
        (None, 4, "JIRA", "ISSUE", "Four", "t", "DONE", ["claim", "user", "items", "policies"]), (None, 5, "JIRA", "ISSUE", "Five", "t", "DONE", ["far", "off"]),
        ("c", 6, "JIRA", "ISSUE", " ", "t", "DONE", ["far", "off"]), ("d", 7, "JIRA", "ISSUE", "Seven", "t", "DONE", None),
    ]
    frame = spark.createDataFrame(rows, UNIT)
    written, cut = [], ev.cut_lineage
    monkeypatch.setattr(ev, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    features, members = ev.seed_features(frame)
    of = {r.unit_id: r.feature_id for r in members.collect()}
    assert sorted(of) == ["a", "b", "c", "d"] and members.count() == 4
    assert of["a"] == of["b"] and len(set(of.values())) == 3
    got = {r.feature_id: (r.name, r.status, r.size) for r in features.collect()}
    assert got == {of["a"]: ("policy", "IMPLEMENTED", 2), of["c"]: ("far", "COVERAGE_GAP", 1), of["d"]: ("Seven", "COVERAGE_GAP", 1)}
    assert written and not any({"text", "hints"} & set(columns) for columns in written)


def test_rows_tell_what_is_broadcast(spark):
    """Rows that repeat make small files, and tables of any length would go through the driver; small tables still do."""
    from concordat.session import cut_lineage, sized_by_rows

    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "300k")
    try:
        rows = spark.range(40_000).selectExpr("id", "repeat('text ', 40) AS t")
        with sized_by_rows():
            long, short = cut_lineage(rows), cut_lineage(rows.limit(20))
        plan = lambda a, b: a.join(b.filter("t <> ''"), "id")._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan(spark.range(10), cut_lineage(rows.selectExpr("id % 2 AS id", "t")))
        assert "BroadcastHashJoin" not in plan(spark.range(10**9), long)
        assert "BroadcastHashJoin" in plan(spark.range(10**9), short)
        assert not cut_lineage(rows)._jdf.queryExecution().analyzed().toString().startswith("ResolvedHint")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_scan_is_sized_by_rows(spark, monkeypatch):
    """All tables of a scan are written under that rule, and none after it."""
    from concordat import session
    from concordat.operators import scan as sc_

    def model(docs):
        raise InterruptedError(session._by_rows)

    monkeypatch.setattr(sc_, "spec_model", model)
    docs = spark.createDataFrame([("s", "code", "code", 0, "{}")], "scan_id string, side string, spec_id string, spec_pos int, json string")
    with pytest.raises(InterruptedError, match="True"):
        sc_.scan(docs)
    assert not session._by_rows
