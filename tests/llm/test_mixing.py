"""Mixing: against an iterative resharing, exact budgets, and odd inputs."""

import random
import re

from concordat.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, size string"


def targets(sizes):
    """Share out, stop at the double, share the rest again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, full, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            break
        for s in over:
            full[s] = 2 * sizes[s]
            left -= full[s]
        open_ -= over
    return {s: full.get(s, left / max(1, sum(weight[x] for x in open_)) * weight[s] if s in open_ else 0) for s in names}


def rows():
    rng = random.Random(5)
    out = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["b", "a", "ä", None, "c", "b", "b", "z"]), "x") for i in range(400)]
    out += [(1000, None, None, "b", None), (1001, "", "en", "only-empty", None), (None, "a b\tc\x0bd e", "en", "a", None)]
    return out + [out[3]] * 5 + [(9999, "long " * 30000, "en", "b", None)]


def test_mix(spark):
    data = rows()
    got = mix(spark.createDataFrame(data, SCHEMA), buckets=16).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, text, _, source, _ in data:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    again = mix(spark.createDataFrame(data[::-1], SCHEMA), buckets=16).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    other = mix(spark.createDataFrame(data, SCHEMA), buckets=512).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, other))


def test_empty(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).collect() == []
    one = mix(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in one] == [(0, 0.0, 0)]
