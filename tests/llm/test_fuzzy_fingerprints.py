"""Fingerprints: edit distance by table, neighbours by sorting, and what edits do to the likeness."""

import hashlib
import random

from concordat.llm.fuzzy_fingerprints import _common, fingerprint, likeness, neighbours, with_fingerprint

SCHEMA = "doc_id long, text string, fingerprint string, part string, side string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(0, 70))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        assert _common(a, b) == row[-1]


def test_likeness():
    rng = random.Random(2)
    for n in (20, 300, 5000):
        text = words(rng, n)
        changed = text.replace(" ", "  ", 1)
        cut = text[: len(text) // 2] + words(rng, n)[: len(text) - len(text) // 2]
        other = words(rng, n)
        f = fingerprint(text)
        assert likeness(f, f) == 1.0 and likeness(f, fingerprint(changed)) > 0.8
        assert likeness(f, fingerprint(changed)) > likeness(f, fingerprint(cut)) > likeness(f, fingerprint(other))
        assert likeness(f, fingerprint(cut)) == likeness(fingerprint(cut), f)
    assert fingerprint(None) == fingerprint("") == "0::" and likeness("0::", "0::") == 1.0 and likeness("0::", fingerprint("abc")) == 0.0
    assert likeness(fingerprint("a" * 100000), fingerprint("a" * 100000)) == 1.0


def test_repetitive_texts():
    """A passage repeated many times: nearly all small edits stay near, a shared half is mostly seen."""
    small, halves = [], []
    for seed in range(12):
        rng = random.Random(seed)
        passage, other = words(rng, 60) + "\n", words(rng, 70) + "\n"
        for n in (100, 300, 1000):
            text = passage * n
            f, at, half = fingerprint(text), len(text) // 3, text[: len(text) // 2]
            assert len(f.split(":")[1]) >= 6
            small += [likeness(f, fingerprint(t)) for t in (text[:at] + "#" + text[at + 1 :], text[:at] + "#" + text[at:], text[:at] + text[at + 5 :])]
            halves += [likeness(f, fingerprint((half + end)[: len(text)])) for end in (words(rng, 200), other * n, words(rng, len(half) // 5))]
    assert sum(x >= 0.3 for x in small) >= 0.95 * len(small) and sum(x > 0 for x in halves) >= 0.7 * len(halves)
    assert 32 <= len(fingerprint("a" * 10**6).split(":")[1]) <= 65


def test_boundaries_by_scalar_code():
    """The vectorised rolling hash against one that looks at each byte's window alone."""
    rng = random.Random(9)
    for n in (1, 5, 64, 900):
        data = words(rng, n).encode()
        ends = []
        for i in range(len(data)):
            r = 0
            for k in range(7):
                j = i - 6 + k
                r = (r * 0x01000193 + (data[j] + 1 if j >= 0 else 0)) % 2**32 if k else (data[j] + 1 if j >= 0 else 0)
            r ^= r >> 15
            r = r * 0x2C1B3C6D % 2**32
            r ^= r >> 12
            r |= 1 << 31
            ends.append((r & -r).bit_length() - 1)
        level = next(k for k in range(33) if sum(e >= k for e in ends) <= 64)
        chunks = sum(e >= level for e in ends) + (ends[-1] < level)
        got = fingerprint(data.decode()).split(":")
        assert got[0] == str(level) and len(got[1]) == chunks


def test_neighbours(spark):
    rng = random.Random(4)
    docs = [(i * 3 + 1, words(rng, rng.randint(0, 300)), "x", None, "first") for i in range(150)]
    docs += [(7, "tie", None, None, None), (7, "tie", None, None, None), (8, None, None, None, None), (9, "", None, None, None), (None, "no id", "", "", ""), (5000, words(rng, 30000), None, None, None)]
    got = neighbours(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect()
    assert len(got) == len(docs)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
    order = sorted({d[0] for d in docs if d[0] not in (7,)}, key=lambda i: (i is not None, i or 0))
    text = {d[0]: d[1] or "" for d in docs}
    ids = [i for i in order]
    for k, i in enumerate(ids):
        after = ids[(k + 1) % len(ids)]
        if 7 in (i, after) or (after or 0) >= 7 and (i or 0) < 7:
            continue
        own = text[i]
        half = len(own) // 2
        edited = own[: len(own) - half] + text[after][:half]
        r = by_id[i][0]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(own), fingerprint(edited))
        assert r.near_edited == likeness(fingerprint(own), fingerprint(edited)) and r.near_next == likeness(fingerprint(own), fingerprint(text[after]))
    assert any(r.near_next == 1.0 for r in by_id[7])
    one = neighbours(spark.createDataFrame([(1, "abcdef", None, None, None)], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert neighbours(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.f for r in with_fingerprint(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), "f").collect()] == ["0::"]
