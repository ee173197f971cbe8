"""SimHash clusters against plain fingerprints and all pairs: near copies, crowded anchors, odd rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from concordat.llm import common
from concordat.llm import simhash_anchors as sa
from concordat.sources.tables import load

SCHEMA = "doc_id long, text string, fp string, label int"


def plain_print(text, k=3):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum((2 * sum(x >> j & 1 for x in h) > len(h)) << j for j in range(64))


def components(prints, ids, most):
    """The least id reached from each place, by union of all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= most) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    by_id = {}
    for i, d in enumerate(ids):
        if d is not None:
            x, y = find(i), find(by_id.setdefault(d, i))
            root[max(x, y)] = min(x, y)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(a))]


def brute(docs, most=3):
    prints = [plain_print(t) for _, t in docs]
    return sorted(((d or -1), f"{p:016x}", x) for (d, _), p, x in zip(docs, prints, components(prints, [d for d, _ in docs], most), strict=True))


def got(frame):
    return sorted((r.doc_id or -1 if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in sa.report(frame).collect())


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["Été", "ü"]
    docs = []
    for _ in range(60):
        w = rng.choices(vocab, k=rng.randint(1, 300))
        for _ in range(rng.randint(1, 6)):
            v = w.copy()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            docs.append(" ".join(v))
    docs += [None, "", " \t ", "a", "A", "a b", "a b c", "x " * 400, docs[0].upper(), "  " + docs[0].replace(" ", "\n")]
    rng.shuffle(docs)
    return [(1 + 7 * i % 9973, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("window", [1 << 20, 16])
def test_fingerprints(monkeypatch, window):
    monkeypatch.setattr(sa, "word_windows", lambda text, table: common.word_windows(text, table, window))
    for _, text in make(1)[:80]:
        assert sa.fingerprint(text, 3) == plain_print(text)


@pytest.mark.parametrize("dim", sa.DIMENSIONS)
def test_anchors_are_a_code(dim):
    words = sa.anchors(dim)
    assert len(np.unique(words)) == 2**dim and words[0] == 0
    assert set((words[1:64] ^ words[64:127]).tolist()) <= set(words.tolist())
    assert int(np.bitwise_count(words[1:]).min()) >= 16


@pytest.mark.parametrize(("dim", "block"), [(7, 4096), (10, 50), (13, 4096)])
def test_links_of_crowded_prints(spark, monkeypatch, dim, block):
    """Every pair within the threshold is connected, in a crowd around few centres as among spread prints."""
    monkeypatch.setattr(sa, "BLOCK", block)
    rng = np.random.default_rng(dim)
    centres = rng.integers(0, 2**64, 12, np.uint64)
    prints = {0, 2**64 - 1, *rng.integers(0, 2**64, 300, np.uint64).tolist()}
    for centre in centres.tolist():
        for _ in range(80):
            flips = rng.choice(64, rng.integers(0, 9), replace=False)
            prints.add(centre ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    edges = [tuple(np.array(r, np.int64).view(np.uint64).tolist()) for r in sa.links(frame, 3, dim).collect()]
    place = {p: i for i, p in enumerate(prints)}
    assert len(edges) < 20 * len(prints)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(place[a]), find(place[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == components(prints, list(range(len(prints))), 3)


def test_clusters(spark):
    docs = make(2)
    frame = spark.createDataFrame([(d, t, None, 1) for d, t in docs], SCHEMA)
    assert got(frame) == brute(docs)


def test_given_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in sa.report(load(spark, sf, "documents")).collect()) == sorted(
        (d, f"{plain_print(t):016x}", x) for (d, t), x in zip(docs, components([plain_print(t) for _, t in docs], [d for d, _ in docs], 3), strict=True)
    )


def test_odd(spark):
    assert sa.report(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = [(5, None), (4, ""), (7, "alpha beta gamma delta"), (None, "alpha beta gamma delta"), (None, "lone words without any id"), (9, "one text"), (9, "another one of it"), (3, "one text"), (3, "one text")]
    frame = spark.createDataFrame([(d, t, "x", 2) for d, t in docs], SCHEMA)
    assert got(frame) == brute(docs)
    texts = spark.createDataFrame([("b", "some text here"), ("a", "some text here"), ("c", None)], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in sa.report(texts).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]


def test_code_grows_with_the_prints():
    dims = [sa.dimension(n, 3) for n in (0, 10**5, 10**7, 10**9)]
    assert dims == sorted(dims) and dims[0] == 7 and dims[-1] == 19
