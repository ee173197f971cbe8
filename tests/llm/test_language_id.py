"""Language ID: Viterbi by plain code, held-out accuracy, scripts, and odd inputs."""

import random
import zlib

import numpy as np

from concordat.llm import language_id
from concordat.llm.language_id import Letters, Model, annotate, report, train
from concordat.sources.tables import load

SCHEMA = "doc_id long, text string, lang string, language string, score string"
LATIN = {"aa": "the and of this that with from for was".split(), "bb": "der die und nicht mit ist das ein für".split()}
RUSSIAN = "что это как для она они был после только".split()


def brute(scores, penalty):
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        step = value[None, :] - penalty * (1 - np.eye(len(row)))
        back.append(step.argmax(axis=1))
        value = step.max(axis=1) + row
    path = [int(value.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1], value.max()


def total(scores, path, penalty):
    return sum(scores[t, s] for t, s in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))  # noqa: B905


def test_viterbi():
    rng = np.random.default_rng(1)
    model = Model(["a", "b", "c"], np.zeros((3, 1)), np.ones((1, 3), bool), penalty=3.0)
    sizes = [0, 1, 5, 40, 0, 200, 3, 60]
    scores = np.concatenate([rng.normal(0, 1.5, (n, 3)) + np.repeat(rng.normal(0, 1.2, (-(-n // 9), 3)), 9, axis=0)[:n] for n in sizes])
    first = np.concatenate(([0], np.cumsum(sizes)))
    path = model.spans(scores, first)
    for a, b in zip(first, first[1:]):  # noqa: B905
        if a < b:
            want, value = brute(scores[a:b], 3.0)
            assert abs(total(scores[a:b], path[a:b].tolist(), 3.0) - value) < 1e-6


def test_words():
    w = Letters(["Añb c1d", None, "", "x日本y", "..."])
    assert w.first.tolist() == [0, 3, 3, 3, 6, 6] and w.lens.tolist() == [3, 1, 1, 1, 2, 1]


def docs(rng):
    out, k = [], 0
    for lang, words in [*LATIN.items(), ("ru", RUSSIAN)]:
        for _ in range(150):
            out.append((k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))), lang, "x", None))
            k += 1
    return out


def test_spans_and_scripts(spark):
    rng = random.Random(2)
    frame = spark.createDataFrame(docs(rng), SCHEMA)
    model = train(frame, per_lang=100)
    rng.seed(3)
    mixed = " ".join([*rng.choices(LATIN["aa"], k=30), *rng.choices(LATIN["bb"], k=20), *rng.choices(RUSSIAN, k=25)])
    rows = [(1, mixed, None, None, None), (2, None, "aa", None, None), (3, "12 !!", None, None, None), (4, "слово", None, None, None), (5, "漢字", None, None, None)]
    got = {r.doc_id: r.language for r in annotate(spark.createDataFrame(rows, SCHEMA), model).collect()}
    cut = [(s.lang, s.start, s.stop) for s in got[1].spans]
    assert [s[0] for s in cut] == ["aa", "bb", "ru"] and abs(cut[0][2] - 30) <= 1 and cut[1][2] == 50 and cut[2][2] == 75
    assert got[2].lang == got[3].lang == "und" and got[2].score == 0 and got[4].lang == "ru" and got[5].lang in ("aa", "bb", "ru")


def test_report(spark):
    rows = docs(random.Random(5)) + [(None, None, None, None, None), (9000, "the and of", None, None, None)]
    frame = spark.createDataFrame([*rows, rows[0]], SCHEMA)
    got = report(frame).collect()
    lang = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows) + 1
    for r in got:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
            assert lang[r.doc_id] is None or r.lang_pred == lang[r.doc_id]
    assert report(frame.limit(0)).collect() == []
    none = report(spark.createDataFrame([(1, "words", None, None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_held_out_accuracy(spark, sf):
    got = report(load(spark, sf, "documents")).join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    rows = [r for r in got.collect() if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


def test_told_and_few_or_many_texts_alike():
    rng = np.random.default_rng(5)
    model = Model(["a", "b", "c"], rng.normal(0, 1, (3, 1 << 18)), np.ones((17, 3), bool), penalty=2.0)
    texts = [None, "", "12 3"] + [" ".join(rng.choice(["ab", "cd", "ef", "ghi"], n)) for n in rng.integers(1, 60, 400)]
    many = model.label(texts)
    assert model.told(texts) == [g for g, _, _ in many]
    for k in (0, 1, 3, 50, 399):
        assert model.label([texts[k]])[0][2] == many[k][2] and model.told([texts[k]]) == [many[k][0]]
    scores = rng.normal(0, 1, (9000, 3))
    got = model._walk_one(scores)
    assert np.isclose(total(scores, got.tolist(), 2.0), brute(scores, 2.0)[1])


def test_equal_words_are_hashed_once(monkeypatch):
    rng = np.random.default_rng(6)
    vocab = ["ab", "abc", "der", "日本", "слово", "x日本y", "日", "x", "Ñandu", "a"]
    texts = [None, "", "12 3"] + [" ".join(rng.choice(vocab, n)) for n in rng.integers(1, 80, 300)]
    model = Model(["a", "b"], rng.normal(0, 1, (2, 1 << 18)), rng.random((17, 2)) < 0.7)
    letters, plain = [], language_id.mix
    monkeypatch.setattr(language_id, "mix", lambda h: letters.append(len(h)) or plain(h))
    w = Letters(texts)
    got = model.word_scores(w)
    assert sum(letters) < w.lens.sum()
    # Every word by itself, with the letters of other scripts that touch it.
    slots, begin = w.features(np.arange(len(w.starts)))
    for k in range(2):
        letters_of = sum(model.table[k][v] for v in slots[:3])
        want = np.add.reduceat(letters_of, begin) / 3 + model.table[k][slots[3]]
        allowed = model.allowed[w.script]
        want = np.where(allowed.any(axis=1), want - np.where(allowed[:, k], 0.0, 50.0), 0.0)
        assert np.array_equal(got[:, k], want)
    monkeypatch.setattr(language_id, "_MUL", np.uint64(0))
    monkeypatch.setattr(language_id, "_powers", lambda n: np.zeros(n, np.uint64))  # all words have one hash
    assert len(w.distinct()[0]) == len(w.starts)
