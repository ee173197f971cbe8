"""The audit against plain sums over the whole matrix, and the joint descent against all cells."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from concordat.llm import source_divergence as sd

SCHEMA = "text string, lang string, source string, item string, rank string, row int, p long"


def brute(docs, least=3, ranks=200):
    count, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        lang, source = lang or "", source or ""
        langs[lang].add(source)
        count[lang, source].update(w)
        df[lang].update(set(w))
    out = []
    for lang, sources in langs.items():
        kept = {t for t, n in df[lang].items() if n >= least}

        def price(c, kept=kept):
            total = sum(n for t, n in c.items() if t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: price(count[lang, s]) for s in sources}
        q = price(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources - {s}]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ordered) if part == "pair" or i < ranks]
    return sorted(out)


def make(seed, sources=9):
    rng = random.Random(seed)
    vocab = [a + b for a in "abcdefgh" for b in "klmnopqé"] + ["Über", "ÉTÉ"]
    docs = []
    for lang in ("en", "de", None):
        for i in range(60):
            s = rng.randrange(sources)
            own = vocab[s * 5 : s * 5 + 20] + vocab[:4]
            docs.append((" ".join(rng.choices(own, k=rng.randint(1, 80))) + rng.choice(["", " 12 x7y", "--"]), lang, f"s{s}" if s else None))
    docs += [(None, "en", "s1"), ("", "en", "silent"), ("1 2 3", "xx", "only"), ("a b", "yy", "one"), ("a b", "yy", "two"), (None, None, None)]
    docs += [docs[0]] * 5 + [("ak " * 40_000 + "once", "en", "s2")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize(("rows", "columns", "held", "ranks"), [(32, 1024, 200_000, 200), (4, 8, 50, 5)])
def test_against_the_whole_matrix(spark, monkeypatch, rows, columns, held, ranks):
    monkeypatch.setattr(sd, "ROWS", rows)
    monkeypatch.setattr(sd, "COLUMNS", columns)
    monkeypatch.setattr(sd, "HELD", held)
    docs = make(rows)
    found = sd.audit(spark.createDataFrame([(*d, "x", "y", 1, 2) for d in docs], SCHEMA).repartition(3), ranks=ranks)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == brute(docs, ranks=ranks)


@pytest.mark.parametrize(("side", "same"), [(5, True), (37, True), (20, False)])
def test_joint_descent(side, same):
    """Every pair of cells with one that is not zero is a leaf, once; nothing else is."""
    rng = np.random.default_rng(side)
    full = [rng.integers(1, 9, (side, 64)) * (rng.random((side, 64)) < share) for share in (0.1, 0.3)]
    full[1][:, 32:] = 0
    depth = 6
    trees = [sd.Quadtree(*np.nonzero(m), m[np.nonzero(m)], depth) for m in full]
    left, right = (trees[0], trees[0]) if same else trees
    one, two = (full[0], full[0]) if same else full
    a, b, x, y = sd.joint_leaves(left, right, (side, side), depth, same)
    got = Counter(zip(a.tolist(), b.tolist(), np.append(left.value, 0)[x].tolist(), np.append(right.value, 0)[y].tolist(), strict=True))
    want = Counter((i, j, int(one[i, k]), int(two[j, k])) for i in range(side) for j in range(side) for k in range(64) if (one[i, k] or two[j, k]) and (not same or i < j))
    assert got == want


def test_large_counts(spark):
    """Prices of counts beyond 64 bits when scaled."""
    frame = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "n long, total long, v long")
    assert frame.select(sd._p("n", "total", "v")).first()[0] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)


def test_odd(spark):
    assert sd.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    assert sd.audit(spark.createDataFrame([(None, None, None, "", "", 0, 0)], SCHEMA)).collect() == []
    docs = [(None, None, "a"), ("", None, "b")]
    assert sorted(map(tuple, sd.audit(spark.createDataFrame([(*d, "", "", 0, 0) for d in docs], SCHEMA)).collect())) == brute(docs)
