"""Toxicity: pooling by plain loops, held-out accuracy on made-up insults with inflected forms, odd inputs."""

import random
import zlib

import numpy as np

from concordat.llm import toxicity as tox

DOCS = "doc_id long, text string, lang string, source string, toxic string"
LABELS = "doc_id long, quality int, toxic int, text string"


def made_up(n, rng):
    vocab = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    bad = ["zurk" + e for e in ("", "o", "en", "ity", "ling")] + ["vlub" + e for e in ("", "a", "er", "ish")]
    rows = []
    for k in range(n):
        words, toxic = rng.choices(vocab, k=rng.randint(5, 120)), int(rng.random() < 0.2)
        for _ in range(rng.randint(1, 3) * toxic):
            words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), "xx", toxic))
    return rows


def test_pooling():
    rng = np.random.default_rng(3)
    net = tox.Net(filters=[rng.normal(size=(w, tox.DIM, tox.FILTERS)).astype(np.float32) for w in tox.WIDTHS], bias=[np.zeros(tox.FILTERS, np.float32)] * 3)
    net.table[:] = rng.normal(size=net.table.shape)
    texts = ["one two three four", None, "solo", "", "five, SIX seven"]
    w = tox._encoded(texts)
    slots = tox.word_slots(w)
    got = net.pooled(slots, w.first)[0]
    for i in range(len(texts)):
        x = net.table[slots[w.first[i] : w.first[i + 1]]].sum(axis=1)
        x = np.concatenate((np.zeros((2, tox.DIM)), x, np.zeros((3, tox.DIM))))
        want = []
        for width, f in zip(tox.WIDTHS, net.filters, strict=True):
            y = [sum(x[p + k] @ f[k] for k in range(width)) for p in range(len(x) - width + 1)]
            want.append(np.maximum(np.max(y, axis=0), 0))
        assert np.allclose(got[i], np.concatenate(want), atol=1e-4)


def test_threshold():
    raw, y = np.array([0.0, 1, 2, 3, 10, 11]), np.array([0, 0, 1, 0, 1, 1])
    assert 3 < tox.threshold(raw, y, 2.0) < 10 and 1 < tox.threshold(raw, y, 0.5) < 2


def test_report(spark):
    rng = random.Random(8)
    rows = made_up(2500, rng)
    docs = [(k, t, g, None, "extra") for k, t, g, _ in rows] + [(9001, None, None, None, None), (9002, "", None, None, None), (9003, "w " * 60000, None, None, None)]
    labels = [(k, None, y, "x") for k, _, _, y in rows] + [(9001, 1, None, None), (None, 1, 1, None), (123456, 0, 1, None), (rows[0][0], 1, rows[0][3], None)]
    docs.append(docs[1])
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = tox.report(frame, marks).collect()
    assert len(got) == len(docs)
    truth = {k: y for k, _, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.predicted for r in held if truth[r.doc_id]) >= 0.93 * sum(truth[r.doc_id] for r in held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.predicted for r in got if r.doc_id in (9001, 9002)} == {0}


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b", "en", None, None), (2, None, None, None, None)], DOCS)
    assert [r.score for r in tox.report(docs, spark.createDataFrame([], LABELS)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1, 1, None), (2, 1, 1, None), (3, 1, 1, None)], LABELS)
    assert {r.score for r in tox.report(docs, one).collect()} == {1.0}
    assert tox.report(docs.limit(0), one).collect() == []


def test_every_labelled_row_counts(spark):
    rows = [(k, f"own{k}word and others", "xx", int(k % 800 == 0)) for k in range(4000)]
    docs = spark.createDataFrame([(k, t, g, None, None) for k, t, g, _ in rows], DOCS)
    net, _ = tox.train(docs, spark.createDataFrame([(k, 1, y, None) for k, _, _, y in rows], LABELS))
    seen = sum(bool(net.table[tox.word_slots(tox._encoded([f"own{k}word"]))[0, 0]].any()) for k, *_ in rows)
    assert 0.7 * len(rows) < seen < 0.8 * len(rows)


def test_threshold_of_counts():
    raw, y, n = np.array([0.0, 1, 1, 2, 3]), np.array([0, 0, 1, 1, 0]), np.array([9, 2, 5, 6, 1])
    cut = tox.threshold(raw, y, 1.0, n)
    assert cut == tox.threshold(np.repeat(raw, n), np.repeat(y, n), 1.0) and 0 < cut < 1


def test_pass_moves_as_plain_loops():
    rng = np.random.default_rng(4)
    texts, y = ["one two three", "four", "", "two five six seven four"], np.array([1, 0, 0, 1])
    w = tox._encoded(texts)
    slots = tox.word_slots(w)
    per = [np.bincount(slots[:, 0], minlength=tox.SLOTS) + k for k in (1, 0)]
    net, past = tox.start(per, [2, 2])
    net = tox.with_dense(net, tox.dense(net) + rng.normal(0, 0.2, len(tox.dense(net))) + 1.0)
    after, _, moved = tox.learn(net, past, slots, w.first, y, rng)

    def loss(v):
        h = tox.with_dense(net, v).pooled(slots, w.first)[0]
        raw = h @ v[-25:-1] + v[-1]
        return float(np.mean(np.log1p(np.exp(raw)) - y * raw))

    v, change = tox.dense(net), tox.dense(after) - tox.dense(net)
    for k in (0, 100, 575, 580, 600, 610, len(v) - 1):
        e = np.zeros(len(v))
        e[k] = 1e-2
        slope = (loss(v + e) - loss(v - e)) / 2e-2
        assert abs(change[k] + 0.05 * slope / np.sqrt(0.01 + slope**2)) < 2e-3
    assert len(moved) and set(moved.tolist()) <= set(slots.ravel().tolist())


def test_labelled_texts_as_a_join(spark):
    """Repeated and null ids, null texts, ids without a label or without a text: the rows of a plain join, each shard in order."""
    docs = [(k % 40, f"text {k % 55}", "xx", None, None) for k in range(120)] + [(None, "lost", None, None, None), (7, None, None, None, None), (99, "free", None, None, None)]
    frame = spark.createDataFrame(docs, DOCS)
    known = spark.createDataFrame([(k, k % 2) for k in range(0, 60, 3)] + [(7, 1)], "doc_id bigint, toxic int")
    got = tox._labelled(frame, known, 3)
    want = frame.select("doc_id", "text").join(known, "doc_id").select("text", "toxic")
    assert got.count() == want.count() and got.select("text", "toxic").exceptAll(want).isEmpty()
    assert {r.shard for r in got.collect()} == {0, 1, 2}


def test_words_are_embedded_once():
    rng = np.random.default_rng(4)
    net = tox.Net(table=rng.normal(size=(tox.SLOTS, tox.DIM)).astype(np.float32))
    slots = rng.integers(0, tox.SLOTS, (50, 3)).astype(np.int32)[rng.integers(0, 50, 3000)]
    assert np.array_equal(net.embedded(slots), net.table[slots].sum(axis=1))
    assert net.embedded(slots[:0]).shape == (0, tox.DIM)
