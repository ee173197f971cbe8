"""Decontamination against a word-by-word search, in one pass and in several."""

import hashlib
import random
import re

from concordat.llm.decontamination import decontaminate, report

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_hit string, _hits string"


def words(text):
    return WORD.findall("".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def brute(doc, items):
    d, hit, ids = words(doc), set(), set()
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            for q in range(len(d) - n + 1):
                if d[q : q + n] == w[p : p + n]:
                    hit.update(range(q, q + n))
                    if item is not None:
                        ids.add(str(item))
    return len(d), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(d)


def data():
    rng = random.Random(3)
    vocab = ["the", "Ära", "été", "x1", "of", "İz", "ba", "zo", "naïve"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(0, 30))) for i in range(14)] + [(3, "The of, THE."), (None, "lone zebra"), (50, None), (7, text(13)), (51, "")]
    items.append(items[5])
    docs = []
    for i in range(60):
        part = rng.choice(items)[1] or ""
        docs.append((i, text(rng.randint(0, 60)) + "\n" + part.upper() + "; " + text(rng.randint(0, 200)), None, None))
    docs += [(100, None, "a", None), (101, "", None, "b"), (102, "--- ,,", None, None), (103, "see a lone-zebra here", None, None), (104, text(20000), None, None), (None, "the of the", None, None)]
    return docs + [docs[2]] * 3, items


def test_report(spark):
    docs, items = data()
    items = items[::-1]
    want = sorted(str((d[0], *brute(d[1], items))) for d in docs)
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(str(tuple(r)) for r in report(frame, bench).collect()) == want
    from concordat.llm import decontamination as m

    several = m.annotate(frame, bench, "h", block_words=40).select("doc_id", "h.n_words", "h.n_hit", "h.items", m.contaminated("h"))
    got = [(r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[4]) for r in several.collect()]
    assert sorted(map(str, got)) == want


def test_remove(spark):
    docs, items = data()
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate(frame, bench)
    assert kept.columns == frame.columns
    want = sorted(str((d[0], d[1])) for d in docs if not brute(d[1], items)[4])
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want
    cut = {r.doc_id: r.text for r in decontaminate(frame, bench, "spans").collect()}
    assert cut[103] == "see a  here" and cut[100] is None and cut[102] == "--- ,,"


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b", None, None)], DOCS)
    assert [r.n_hit for r in report(docs, none).collect()] == [0]
    assert report(docs.limit(0), none).collect() == []


def test_an_item_longer_than_a_pass(spark):
    """Windows of an item that is dealt in pieces are all found, each once, in whatever piece they are."""
    from concordat.llm import decontamination as m

    rng = random.Random(3)
    long = [f"w{rng.randrange(60)}" for _ in range(130)]
    items = [(1, " ".join(long)), (2, " ".join(long[20:32])), (3, " ".join(long[:40])), (None, "w1 w2"), (4, None)]
    docs = [(k, " ".join(["x"] * 3 + long[k : k + 12 + k % 3] + ["y"] + long[5:9])) for k in range(0, 118, 2)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [(r[0], r[1], r[2], len(r[3]), hashlib.sha256(",".join(r[3]).encode()).hexdigest(), r[4]) for r in
           m.annotate(frame, bench, "h", block_words=50).select("doc_id", "h.n_words", "h.n_hit", "h.items", m.contaminated("h")).collect()]
    assert sorted(map(str, got)) == sorted(str((d[0], *brute(d[1], items))) for d in docs)
    assert m._dealt(bench, 13, 50)[0].count() > len(items)
