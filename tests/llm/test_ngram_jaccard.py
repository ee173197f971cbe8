"""N-gram join against all pairs by brute force: families, copies, common passages, short and odd texts."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from concordat.llm import ngram_jaccard as nj
from concordat.llm.ngram_jaccard import keep_one, link, shingle_sets
from concordat.sources.tables import load

SCHEMA = "doc_id long, text string, n long, rep string"


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(docs, k, num, den):
    sets = [(d[0], shingles(d[1], k)) for d in docs]
    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for t in s:
            at[t].append(i)
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, s) in enumerate(sets):
        o = defaultdict(int)
        for t in s:
            for j in at[t]:
                if j > i:
                    o[j] += 1
        for j, m in o.items():
            if den * m >= num * (len(s) + len(sets[j][1]) - m):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)], links[i]) for i, (d, s) in enumerate(sets)]


def make(rng):
    vocab = ["w%d" % i for i in range(3000)] + ["É", "é"]
    text = lambda n: rng.choices(vocab, k=n)
    docs, passage, base = [], text(60), text(140)

    def add(words):
        docs.append((len(docs) * 7 % 1009, " ".join(words), None, "x"))

    for k in range(120):
        w = base.copy()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        add(w)
    for _ in range(80):
        w = text(rng.randint(10, 200))
        at = rng.randint(0, len(w))
        add(w[:at] + passage + w[at:])
    for _ in range(40):
        w = text(rng.randint(3, 300))
        for _ in range(rng.randint(1, 5)):
            add(w[: len(w) - rng.choice([0, 0, 1, 3, 20])])
    for w in (["a"], ["A"], ["a", "b", "c"], ["a", "b", "C"], [], ["d"] * 500, ["d"] * 400, text(20000)):
        add(w)
    docs.append((2000, docs[0][1].upper(), None, None))
    docs.append((2001, "  " + docs[0][1].replace(" ", "\n"), None, None))
    docs.append((2002, None, 5, None))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("k", "num", "block", "short"), [(4, 85, 256, 32), (5, 80, 7, 4)])
def test_against_all_pairs(spark, monkeypatch, k, num, block, short):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "SHORT", short)
    docs = make(random.Random(k))
    got = link(spark.createDataFrame(docs, SCHEMA), k, num, 100).collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs, k, num, 100))


def test_keep_one_of_different_texts(spark):
    """Of texts under one id a non-empty one stays, the same in any order of rows."""
    texts = [None, "", "  ", "one two three four five six", "seven eight nine ten eleven twelve", "a b"]
    kept = set()
    for seed in range(4):
        rows = [(k, t) for k in range(40) for t in texts]
        random.Random(seed).shuffle(rows)
        frame = spark.createDataFrame([(k * 10, f"{t} of {k}" if t and t.strip() else t) for k, t in rows], "doc_id long, text string").repartition(3 + seed)
        got = sorted((r.doc_id, r.text) for r in keep_one(frame).collect())
        assert len({i for i, _ in got}) == len(got) and all(t and t.strip() for _, t in got)
        kept.add(tuple(got))
    assert len(kept) == 1


def test_keep_one(spark):
    docs = make(random.Random(2))[:150]
    docs += [docs[0], (None, "no id", None, None), (None, "no id", None, None)]
    frame = spark.createDataFrame(docs, SCHEMA)
    want = {r[2] for r in brute(docs[:150], 5, 80, 100)}
    kept = keep_one(frame)
    rows = kept.collect()
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(want) and len(rows) == len(want) + 2


def test_given_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in load(spark, sf, "documents").collect()]
    assert sorted(map(tuple, link(load(spark, sf, "documents")).collect())) == sorted(brute(docs, 4, 85, 100))


def test_odd(spark):
    assert link(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, None), (2, "", None, None), (None, "a b c d e", None, None), (5, "a b c d e", None, None), (9, "x y z v w", None, None), (9, "a b c d e", None, None), (3, "x y z v w", None, None)]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in link(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 2, 3), (1, 0, 1), (2, 0, 2), (3, 2, 3), (5, 2, 3), (9, 2, 3), (9, 2, 3)]
    assert [len(s) for s in shingle_sets(["a b", "a b c d", None, "  "], 4)] == [1, 1, 0, 0]
    assert nj.prefix_size(20, 85, 100) == 4 and np.array_equal(shingle_sets(["A b"], 4)[0], shingle_sets(["a  B"], 4)[0])


def test_tasks_get_few_rows(spark, monkeypatch):
    import pyarrow as pa

    from concordat.llm import ngram_jaccard

    def counted(batches, *_):
        for b in batches:
            assert b.num_rows <= ngram_jaccard.ROWS
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["token", "bits", "n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(ngram_jaccard, "_token_counts", counted)
    docs = spark.range(3 * ngram_jaccard.ROWS).selectExpr("id AS doc_id", "concat('one two three four ', id) AS text").coalesce(1)
    assert ngram_jaccard.link(docs).count() == 3 * ngram_jaccard.ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
