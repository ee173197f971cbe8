"""Operators on small tables against brute force, and golden contract cases."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from concordat.operators import contract as op
from concordat.operators import evidence as ev
from concordat.operators import findings
from concordat.operators import windows as win
from concordat.operators.chunking import chunk_lines
from concordat.operators.containment import first_held, first_holder
from concordat.operators.graph import connected_components, set_digest
from concordat.operators.portfolio import train_open


def test_containment_matches_brute_force(spark):
    rng = random.Random(7)
    word = lambda a, b: "".join(rng.choice("abc 𝒳") for _ in range(rng.randint(a, b)))
    hay = [(g, word(0, 40)) for g in ("x", "y") for _ in range(60)] + [("x", word(900, 900)), ("z", "abc"), ("x", None)]
    needles = [(g, word(0, 8)) for g in ("x", "y") for _ in range(60)] + [("x", hay[-3][1][250:700]), ("x", None)]
    table = lambda rows: spark.createDataFrame([(g, t, i) for i, (g, t) in enumerate(rows)], "grp string, text string, rank int")
    holds = [(g, h, n, i, k) for i, (g, h) in enumerate(hay) for k, (o, n) in enumerate(needles) if g == o and h and n and n in h]
    holder, held = {}, {}
    for g, h, n, i, k in holds:
        holder[g, n] = min(i, holder.get((g, n), i))
        held[g, h] = min(k, held.get((g, h), k))
    got = first_holder(table(hay), table(needles).drop("rank")).collect()
    assert len(got) == len(holder) and {(r[0], r[1]): r[2] for r in got} == holder
    got = first_held(table(hay).drop("rank"), table(needles)).collect()
    assert len(got) == len(held) and {(r[0], r[1]): r[2] for r in got} == held


def naive_chunks(tokens, budget, header):
    out, used, chunk, has = [], header, 0, False
    for t in tokens:
        if has and used + t > budget:
            chunk, used, has = chunk + 1, header, False
        used, has = used + t, True
        out.append(chunk)
    return out


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
@pytest.mark.parametrize("header", [0, 4, 30])
def test_chunking_is_greedy_for_any_block(spark, block, header):
    rng = random.Random(block)
    data = {"a": [6, 5, 5, 11, 1], "b": [rng.randint(1, 14) for _ in range(80)], "c": [50, 1, 1]}
    rows = [(g, i, t) for g, ts in data.items() for i, t in enumerate(ts)]
    out = chunk_lines(spark.createDataFrame(rows, "grp string, pos bigint, tokens bigint"), 20, header, block)
    got = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: (r["grp"], r["pos"])):
        got[r["grp"]].append(r["chunk"])
    assert dict(got) == {g: naive_chunks(ts, 20, header) for g, ts in data.items()}


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 90):03d}", f"n{rng.randint(0, 90):03d}") for _ in range(60)]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for n in parent}
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want


def test_numbering_and_previous_across_chunks(spark):
    rows = [("k", i, i // 3) for i in range(10)] + [("j", 5, 1)]
    df = spark.createDataFrame(rows, "k string, t int, c int")
    out = win.numbered(df, "k", ["t"], F.col("c"), "n")
    out = win.with_previous(out, "k", ["t"], F.col("c"), ["t"]).collect()
    assert {(r["k"], r["t"]): (r["n"], r["prev_t"]) for r in out} == {
        **{("k", i): (i + 1, i - 1 if i else None) for i in range(10)}, ("j", 5): (1, None),
    }


def test_median_even_and_odd(spark):
    for vals in ([3.0], [1.0, 9.0], [5.0, 5.0, 1.0, 2.0], [float(i * i % 37) for i in range(101)], [i / 997 - 1 for i in range(1500)]):
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        s = sorted(vals)
        want = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2
        assert win.exact_median(df, "v", 2.0).first()[0] == want


def test_digest_ignores_order_and_copies(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "a")], "k int, i string")
    d = {r["k"]: r["d"] for r in set_digest(df, ["k"], "i", "d").collect()}
    assert d[1] == d[2] != d[3]


def test_train_without_actionable_steps_is_closed(spark):
    df = spark.createDataFrame([("a", True, "PR_OPEN"), ("b", False, "MERGED"), ("c", False, "PLANNED")], "train_id string, manual boolean, status string")
    assert {r[0]: r[1] for r in train_open(df).collect()} == {"a": False, "b": True, "c": False}


# --- golden contract cases: (code endpoints, spec endpoints, types that must and must not appear) -----------------

CASES = [
    ("same", [("GET", "/a/{id}")], [("GET", "/a/{id}")], set(), {"MISSING_ENDPOINT", "EXTRA_ENDPOINT", "VERB_MISMATCH", "PATH_VAR_NAME_MISMATCH"}),
    ("var name", [("GET", "/a/{id}")], [("GET", "/A/{key}/")], {"PATH_VAR_NAME_MISMATCH"}, {"MISSING_ENDPOINT"}),
    ("missing", [("GET", "/a"), ("POST", "/b")], [("GET", "/a")], {"MISSING_ENDPOINT"}, {"VERB_MISMATCH"}),
    ("dead", [("GET", "/a")], [("GET", "/a"), ("GET", "/old")], {"EXTRA_ENDPOINT"}, {"MISSING_ENDPOINT"}),
    ("verb", [("GET", "/a")], [("POST", "/a")], {"VERB_MISMATCH"}, {"MISSING_ENDPOINT", "EXTRA_ENDPOINT"}),
    ("collision", [("GET", "/a/{x}")], [("GET", "/a/{x}"), ("GET", "/A/{y}")], {"EXTRA_ENDPOINT"}, {"MISSING_ENDPOINT"}),
]


@pytest.mark.parametrize("name, code, spec, must, must_not", CASES, ids=[c[0] for c in CASES])
def test_golden(spark, name, code, spec, must, must_not):
    schema = "scan_id string, pos int, method string, path string"
    c = spark.createDataFrame([("s", i, m, p) for i, (m, p) in enumerate(code)], schema)
    s = spark.createDataFrame([("s", i, m, p) for i, (m, p) in enumerate(spec)], schema)
    none = spark.createDataFrame([], "scan_id string, text string")
    found = op.verb_mismatch(c, s)
    for part in (op.missing_endpoints(c, s), op.extra_endpoints(c, s, none), op.path_var_diff(op.matched(c, s)), op.key_collisions(s)):
        found = found.unionByName(part.select(found.columns))
    types = {r["type"] for r in found.collect()}
    assert must <= types and not (must_not & types)


def test_incomplete_code_rolls_dead_endpoints_up(spark):
    schema = "scan_id string, pos int, method string, path string"
    c = spark.createDataFrame([("s", 0, "GET", "/a")], schema)
    s = spark.createDataFrame([("s", 0, "GET", "/x"), ("s", 1, "GET", "/y")], schema)
    blind = spark.createDataFrame([("s", "uses a RouterFunction bean")], "scan_id string, text string")
    rows = op.extra_endpoints(c, s, blind).collect()
    assert [(r["endpoint"], r["confidence"]) for r in rows] == [("code-extraction-incomplete", "LOW")]


# --- edits ----------------------------------------------------------------------------------------------------------


def test_edit_replay(spark):
    members = spark.createDataFrame(
        [("s", "f1", "u1"), ("s", "f1", "u2"), ("s", "f2", "u3"), ("s", "f3", "u4"), ("s", "f3", "u5"), ("s", "f3", "u6")], "service string, feature_id string, unit_id string"
    )
    features = spark.createDataFrame([("s", "f1", "one"), ("s", "f2", "two"), ("s", "f3", "three")], "service string, feature_id string, name string")
    edits = spark.createDataFrame(
        [("s", 1, "PIN", None, True), ("s", 2, "MERGE", " ", None), ("s", 3, "RENAME", "Third", None), ("s", 4, "RENAME", "gone", None)],
        "service string, edit int, kind string, name string, pinned boolean",
    )
    units = spark.createDataFrame(
        [("s", 1, "u3"), ("s", 2, "u1"), ("s", 2, "u3"), ("s", 3, "u4"), ("s", 3, "u1"), ("s", 3, "u5"), ("s", 4, "zz")], "service string, edit int, unit_id string"
    )
    out = ev.replay_edits(features, members, edits, units)
    names = {r["name"] for r in out["features"].collect()}
    assert names == {"one", "Third"}
    pin = out["pins"].first()["feature_id"]
    assert {r["unit_id"] for r in out["members"].filter(F.col("feature_id") == pin).collect()} == {"u1", "u2", "u3"}
    notes = {r["edit"]: r["note"] for r in out["notes"].collect()}
    assert "additional units" in notes[2] and "split across" in notes[3] and "no longer present" in notes[4]


def test_affected_endpoints_are_grouped_once(spark):
    """The endpoints of collapsed findings are counted beside them, not grouped again and joined to themselves."""
    rows = [("s", f"r{i}", f"f{i}", i, "STATUS_DRIFT", f"GET /{i % k}", "A", None, "x", f"C{k}.java", 1) for k in (1, 2) for i in range(4)]
    rows += [(None, "n", "n", 9, "STATUS_DRIFT", f"GET /n{i}", "A", None, "x", "N.java", 1) for i in range(2)]
    schema = "scan_id string, row_id string, finding_id string, pos bigint, type string, endpoint string, spec_source string, spec_locus string, summary string, code_file string, code_line int"
    _, affected = findings.collapse_root_cause(spark.createDataFrame(rows, schema))
    assert "Join" not in affected._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.scan_id, r.endpoint, r.first_pos) for r in affected.collect()) == [("s", "GET /0", 0), ("s", "GET /1", 1)]


def test_misclusters_take_texts_apart_once(spark):
    """Both sides of the comparison read one table of stems."""
    read = spark.sparkContext.accumulator(0)

    def told(x):
        read.add(1)
        return x.split(" ")

    rows = [("p", "order lines"), ("p", "claim"), ("u", "orders line"), ("v", "claims")]
    members = spark.createDataFrame(rows, "feature_id string, t string").withColumn("hints", F.udf(told, "array<string>")("t"))
    features = spark.createDataFrame([("p", "PLANNED"), ("u", "UNDOCUMENTED"), ("v", "UNDOCUMENTED")], "feature_id string, status string")
    got = [tuple(r) for r in ev.misclusters(features, members).collect()]
    assert got == [("p", "u", 2)]
    assert read.value == len(rows)
