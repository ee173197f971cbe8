"""Recall of the field on secrets that no base pattern finds, put into given texts, and alarms on texts left alone."""

import random
from string import ascii_letters, digits

import duckdb
import pytest

from concordat.llm import secret_scan as ss

CODE = ascii_letters + digits


@pytest.fixture(scope="module")
def field_and_texts():
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()]
    return ss.fit(sorted(set(texts[:300]))), texts[300:]


def forms(rng):
    draw = lambda letters, n: "".join(rng.choices(letters, k=n))
    return {
        "bearer": ("Authorization: Bearer ", f"eyJ{draw(CODE, 18)}.{draw(CODE, 40)}.{draw(CODE, 30)}"), "prefix": ("", "ghp_" + draw(CODE, 36)), "unseen prefix": ("", f"xoxb-{draw(digits, 11)}-{draw(CODE, 24)}"),
        "other cue": ("passphrase = ", draw(CODE, rng.randint(16, 40))), "short cue": ("auth: ", draw(CODE, rng.randint(16, 40))), "capital hex": ("", draw("0123456789ABCDEF", 40)),
        "split": ("private_key = ", " ".join(draw(CODE + "+/", 64) for _ in range(3))), "no cue": ("the login is ", draw(CODE, 20)),
    }


def test_recall_without_base_patterns(field_and_texts):
    field, texts = field_and_texts
    rng = random.Random(11)
    for name in forms(rng):
        docs, want = [], []
        for k in range(60):
            words = texts[k * 7 % len(texts)].split(" ")[:400]
            lead, value = forms(rng)[name]
            at = rng.randint(0, len(words))
            left = " ".join(words[:at])
            docs.append(f"{left} {lead}{value} {' '.join(words[at:])}")
            want.append((len(left) + 1 + len(lead), len(left) + 1 + len(lead) + len(value)))
        found = 0
        for spans, (a, b) in zip(ss.scan(docs, field), want, strict=True):
            found += sum(max(0, min(b, y) - max(a, x)) for x, y, kind in spans if kind == "crf") >= 0.9 * (b - a)
        assert found >= 54, (name, found)


def test_no_alarms_on_given_texts(field_and_texts):
    field, texts = field_and_texts
    assert sum(kind == "crf" for spans in ss.scan(texts, field) for _, _, kind in spans) <= len(texts) // 100
