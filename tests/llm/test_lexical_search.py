"""Ranked search against a plain scan: ties, repeated rows, blocks of items, narrow tiles, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from concordat.llm import lexical_search as ls
from concordat.sources.tables import load

DOCS = "doc_id long, text string, rank int, score string"
ITEMS = "item_id long, text string, score double"


def words(text):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    tf = [(d, Counter(words(t))) for d, t in docs]
    n_docs, n_all = sum(bool(f) for _, f in tf), sum(sum(f.values()) for _, f in tf)
    df = Counter(t for _, f in tf for t in f)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for d, f in tf:
            n = sum(f.values())
            score = 0
            for t in set(words(text)) & set(f):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * (1_000_000_000 * f[t] // (1000 * f[t] + 8 * (10 + 90 * n * n_docs // n_all)))
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(80)] + ["é", "ß9", "7", "ÉCOLE"]
    text = lambda n: rng.choice([" ", ", ", "_"]).join(rng.choices(vocab, k=n))
    docs = [(i * 13 % 401, text(rng.randint(1, 60))) for i in range(150)]
    docs += [(500 + i, docs[0][1].upper()) for i in range(30)]  # more equal scores than places
    docs += [(i, "w1") for i in range(600, 640)] + [docs[3], docs[3], (900, None), (901, ""), (902, "... --"), (None, docs[5][1]), (None, docs[5][1])]
    docs += [(950, text(30_000))]
    rng.shuffle(docs)
    items = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(50, docs[0][1] or "w2"), (51, "w1 w1 W1"), (52, None), (53, "unseen"), (54, ""), (50, "w3"), (55, "w4"), (55, "w4"), (None, "w5")]
    return docs, items


@pytest.mark.parametrize(("tile", "rows", "terms"), [(4096, 256, 50_000), (3, 7, 60)])
def test_against_a_scan(spark, monkeypatch, tile, rows, terms):
    monkeypatch.setattr(ls, "TILE_TERMS", tile)
    monkeypatch.setattr(ls, "TILE_ITEMS", 5 if tile == 3 else 256)
    monkeypatch.setattr(ls, "TILE_DOCS", rows)
    docs, items = make(rows)
    found = ls.search(
        spark.createDataFrame([(d, t, 1, "x") for d, t in docs], DOCS).repartition(5), spark.createDataFrame([(i, t, 0.5) for i, t in items], ITEMS), block_terms=terms
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_tiles_are_exact():
    """With the greatest weights a tile is so narrow that no sum reaches 2**53."""
    block = ls.Block([[b"%d" % i for i in range(3000)], [b"1", b"2"]])
    block.weigh(np.full(3000, 5_000_000, np.int64))
    assert max(len(t.columns) for t in block.tiles) * 5_000_000 * ls.IMPACT < 1 << 53 and sum(len(t.columns) for t in block.tiles if t.first == 0) >= 3000
    assert sum(int((t.weights > 0).sum()) for t in block.tiles) == 3002


def test_odd(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a", 0.1)], ITEMS)
    assert ls.search(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a b", 0, ""), (2, None, 0, "")], DOCS)
    assert ls.search(some, spark.createDataFrame([], ITEMS)).collect() == []
    assert ls.search(spark.createDataFrame([(1, None, 0, "")], DOCS), items).collect() == []
    named = spark.createDataFrame([("z", "a b"), ("y", "a b"), ("x", "c d")], "doc_id string, text string")
    assert [(r.rank, r.doc_id) for r in ls.search(named, items).orderBy("rank").collect()] == [(1, "y"), (2, "z")]


def test_given_tables(spark, sf):
    docs, items = load(spark, sf, "documents"), load(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sorted(map(tuple, ls.report(docs, items).collect()), key=str) == want
