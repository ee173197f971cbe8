"""Secret scan: fixed patterns, and a linear-chain conditional random field over tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from concordat.llm.common import pieces

c = F.col
# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "crf")
# Words that announce a secret.
CUES = frozenset(
    "password passwd pwd passphrase secret token key apikey api_key access_key secret_key private_key client_secret auth authorization "
    "bearer basic credential credentials signature aws_secret_access_key access_token refresh_token".split()
)
EDGE = "\"'`()[]{}<>,;:.!?*$%&#|"
LABELS = ("B", "I", "O")
_HEX_BYTES = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))
_TOKEN = re.compile(r"\S+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and not overlapping per kind, by start and then kind."""
    raw = text.encode()
    low = raw.lower()
    found = []
    if any(x in low for x in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in raw.translate(_HEX_BYTES):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _shape(core: str) -> tuple[str, ...]:
    """Features of a token that is no plain word: what characters it has, how mixed they are, how long it is."""
    kinds = ["9" if x.isdigit() else "a" if x.islower() else "A" if x.isupper() else x if x.isascii() else "u" for x in core]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))  # noqa: B905
    n, seen = len(core), Counter(core)
    bits = -sum(k / n * math.log2(k / n) for k in seen.values())
    has = "".join(k for k in "aA9" if k in kinds)
    marks = "".join(sorted({k for k in kinds if k not in "aA9u"}))[:4]
    out = [f"has={has}", f"marks={marks}", f"turns={min(turns.bit_length(), 6)}", f"size={min(n.bit_length(), 8)}", f"bits={min(int(bits * 2), 12)}"]
    out.append(f"mixed={has},{min(n.bit_length(), 7)},{min(int(bits), 6)}")
    if n >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        out.append("hex")
    if n >= 12 and re.fullmatch(r"[A-Za-z0-9+/_=-]+", core) and len(has) >= 2:
        out.append("coded")
    if m := re.match(r"(?:[A-Za-z]{2,6}[_-]|AKIA|eyJ)", core):
        out.append("lead=coded" if m.end() < n - 8 else "lead")
    if "@" in core or core.startswith(("http", "www.")):
        out.append("address")
    if "=" in core[:-1] or ":" in core[:-1]:
        out.append("joined=cue" if re.split(r"[=:]", core.lower())[0].strip("\"'-") in CUES else "joined")
    return tuple(out)


def _features(token: str) -> tuple[tuple[str, ...], str]:
    """(features of the token itself, what its neighbours see of it)."""
    core = token.strip(EDGE)
    if not core:
        kind = "=" if token in ("=", ":", "=>", ":=") else "mark"
        return (f"only={kind}",), kind
    low = core.lower().rstrip("=:")
    if low in CUES:
        return ("cue",), "cue=" if token[-1] in "=:" else "cue"
    if core.isalpha() and (len(core) < 20 or core.islower() or core.istitle()):
        return ("plain",), "plain"
    return _shape(core), "number" if core.isdigit() else "other"


NEAR = ("edge", "=", "mark", "cue", "cue=", "plain", "number", "other")
FILES = 6


def _file_feature(views: np.ndarray) -> int:
    """A feature of the whole text: how many of its tokens are no plain words, and whether it assigns values."""
    n = max(1, len(views))
    odd = float(np.isin(views, (1, 2, 6, 7)).sum()) / n
    return (0 if odd < 0.02 else 1 if odd < 0.2 else 2) + 3 * int((views == 1).any())


@dataclass
class Field:
    """Weights per feature and label, and per pair of labels."""

    own: dict[str, np.ndarray]
    before: np.ndarray
    before2: np.ndarray
    after: np.ndarray
    file: np.ndarray
    pair: np.ndarray

    def __post_init__(self):
        self._seen: dict[str, int] = {}
        self._kinds: dict[tuple, int] = {}
        self._weights: list[np.ndarray] = []
        self._views: list[int] = []
        come = self.pair[:, :2] - self.pair[:, 2:]
        go = self.pair[:2] - self.pair[2]
        self._sure = float(max(0.0, come.max(), go.max(), (come[:, :, None] + go[None]).max()))

    def _kind(self, token: str) -> int:
        own, near = _features(token)
        k = self._kinds.get((own, near))
        if k is None:
            k = self._kinds[own, near] = len(self._weights)
            self._weights.append(np.sum([self.own[f] for f in own if f in self.own] or [np.zeros(3)], axis=0))
            self._views.append(NEAR.index(near))
        if len(self._seen) > 300_000:
            self._seen.clear()
        self._seen[token] = k
        return k

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """A score per token and label, and where each text begins."""
        seen, kind = self._seen.get, self._kind
        ids: list[int] = []
        first = [0]
        for tokens in texts:
            ids += [k if (k := seen(t)) is not None else kind(t) for t in tokens]
            first.append(len(ids))
        at, begin = np.array(ids, np.int64), np.array(first)
        if not len(at):
            return np.zeros((0, 3)), begin
        views = np.array(self._views)[at]
        out = np.array(self._weights)[at]
        owner = np.repeat(np.arange(len(texts)), np.diff(begin))
        for step, weights in ((1, self.before), (2, self.before2), (-1, self.after)):
            near = np.roll(views, step)
            other = np.roll(owner, step) != owner
            other[:step] |= step > 0
            other[len(other) + min(step, 0) :] |= step < 0
            out += weights[np.where(other, 0, near)]
        files = np.array([_file_feature(views[a:b]) for a, b in zip(first, first[1:])])  # noqa: B905
        return out + self.file[files[owner]], begin

    def tag(self, scores: np.ndarray) -> list[tuple[int, int]]:
        """(first token, token after the last) of the secrets on the best path.

        A token whose O is ahead by more than any change of two label pairs can make up is O on every best path, so
        the path is searched between such tokens only."""
        open_ = np.flatnonzero(scores[:, 2] - scores[:, :2].max(axis=1) <= self._sure)
        spans: list[tuple[int, int]] = []
        if not len(open_):
            return spans
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            labels = viterbi(scores[run], self.pair, run[0] > 0, run[-1] + 1 < len(scores))
            for t, label in zip(run.tolist(), labels, strict=True):
                if label == 2:
                    continue
                if label == 1 and spans and spans[-1][1] == t:
                    spans[-1] = (spans[-1][0], t + 1)
                else:
                    spans.append((t, t + 1))
        return spans


def viterbi(scores: np.ndarray, pair: np.ndarray, after_o: bool, before_o: bool) -> list[int]:
    """Best labels of a run of tokens between tokens that are O, or the edges of the text."""
    value = scores[0] + (pair[2] if after_o else 0)
    back = []
    for row in scores[1:]:
        step = value[:, None] + pair
        back.append(step.argmax(axis=0))
        value = step.max(axis=0) + row
    value = value + (pair[:, 2] if before_o else 0)
    path = [int(value.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _example_secrets(rng: np.random.Generator) -> list[list[str]]:
    """Made-up secrets in their usual surroundings, as tokens; those of the secret begin with a zero byte."""
    hexa, upper, code = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    cue = str(rng.choice(sorted(CUES)))
    n = int(rng.integers(16, 64))
    return [
        [f"{cue}:", "\0" + draw(code, n)], [cue, "=", '\0"' + draw(code, n) + '"'], [f"\0{cue}={draw(code, n)}"],
        ["Authorization:", "Bearer", "\0eyJ" + draw(code, 20) + "." + draw(code, n) + "." + draw(code, 24)], ["\0ghp_" + draw(code, 36)],
        ["key", "\0AKIA" + draw(upper, 16)], [cue, ":", "\0" + draw(hexa, n)], ["\0" + draw(hexa, 40)], [f"{cue}:", "\0" + draw(hexa.upper(), 40)],
        ["\0sk_live_" + draw(code, 24)], [cue, "=", *["\0" + draw(code + "+/", 64) for _ in range(int(rng.integers(2, 5)))]],
    ]


def fit(texts: list[str], rounds: int = 80, seed: int = 7, width: int = 21) -> Field:
    """A field from texts, labelled by the base patterns, with made-up secrets put in at random places.

    Trained on stretches of tokens around every secret and at as many random places, by gradient steps (Adam) on
    the log likelihood, which forward and backward sums give for all stretches at once."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[list[str], list[int]]] = []
    for text in texts:
        hits = []
        for a, b, kind in base_spans(text):
            m = ASSIGN.match(text, a) if kind == "assign" else None
            hits.append(m.span(2) if m else (a, b))
        found = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
        tokens, marks = [text[a:b] for a, b in found], [2] * len(found)
        starts = np.array([a for a, _ in found], np.int64)
        for s, e in hits:
            k = max(0, int(np.searchsorted(starts, s, side="right")) - 1)
            label = 0
            while k < len(found) and found[k][0] < e:
                marks[k], label, k = label, 1, k + 1
        rows.append((tokens, marks))
    for k in range(80):
        words = list(rows[k % len(rows)][0][:200]) if rows else []
        for example in _example_secrets(rng):
            at = int(rng.integers(0, len(words) + 1))
            around = words[max(0, at - 10) : at], words[at : at + 10]
            tokens = [*around[0], *example, *around[1]]
            marks = [2] * len(tokens)
            for j, t in enumerate(example, len(around[0])):
                if t[0] == "\0":
                    tokens[j], marks[j] = t[1:], 1 if j and marks[j - 1] != 2 else 0
            rows.append((tokens, marks))
    own: dict[str, int] = {}
    x_own, x_near, x_file, y, mask = [], [], [], [], []
    for tokens, marks in rows:
        seen = [_features(t) for t in tokens]
        views = np.array([NEAR.index(v) for _, v in seen], np.int64)
        file = _file_feature(views)
        secrets = [t for t, m in enumerate(marks) if m == 0]
        centres = [*secrets, *rng.integers(0, max(1, len(tokens)), max(2, len(secrets))).tolist()]
        for at in centres if tokens else ():
            a = max(0, int(at) - width // 2)
            b = min(len(tokens), a + width)
            x_own.append([[own.setdefault(f, len(own)) for f in seen[t][0]] for t in range(a, b)])
            near = lambda t: int(views[t]) if 0 <= t < len(views) else 0  # noqa: E731, B023
            x_near.append([(near(t - 1), near(t - 2), near(t + 1)) for t in range(a, b)])
            x_file.append(file)
            y.append(marks[a:b])
    n, size = len(y), len(own)
    most = max((len(f) for row in x_own for f in row), default=1)
    ids = np.full((n, width, most), size, np.int64)
    near, mask, gold = np.zeros((n, width, 3), np.int64), np.zeros((n, width), bool), np.full((n, width), 2, np.int64)
    for i in range(n):
        for t, f in enumerate(x_own[i]):
            ids[i, t, : len(f)] = f
        k = len(y[i])
        near[i, :k], mask[i, :k], gold[i, :k] = x_near[i], True, y[i]
    files = np.array(x_file, np.int64)
    w = {"own": np.zeros((size + 1, 3)), "n0": np.zeros((len(NEAR), 3)), "n1": np.zeros((len(NEAR), 3)), "n2": np.zeros((len(NEAR), 3)), "file": np.zeros((FILES, 3)), "pair": np.zeros((3, 3))}
    one, two = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, rounds + 1 if n else 1):
        e = w["own"][ids].sum(axis=2) + w["n0"][near[:, :, 0]] + w["n1"][near[:, :, 1]] + w["n2"][near[:, :, 2]] + w["file"][files][:, None, :]
        ahead, behind = np.zeros((n, width, 3)), np.zeros((n, width, 3))
        ahead[:, 0] = e[:, 0]
        for t in range(1, width):
            moved = np.logaddexp.reduce(ahead[:, t - 1, :, None] + w["pair"], axis=1) + e[:, t]
            ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            moved = np.logaddexp.reduce(w["pair"][None] + (e[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
            behind[:, t] = np.where(mask[:, t + 1, None], moved, 0.0)
        norm = np.logaddexp.reduce(ahead[:, -1], axis=1)
        p = np.exp(ahead + behind - norm[:, None, None]) * mask[:, :, None]
        d = p - np.eye(3)[gold] * mask[:, :, None]
        g = {k: np.zeros_like(v) for k, v in w.items()}
        for label in range(3):
            g["own"][:, label] = np.bincount(ids.reshape(-1), np.repeat(d[:, :, label].reshape(-1), most), size + 1)
            for k in range(3):
                g[f"n{k}"][:, label] = np.bincount(near[:, :, k].reshape(-1), d[:, :, label].reshape(-1), len(NEAR))
        np.add.at(g["file"], files, d.sum(axis=1))
        for t in range(1, width):
            both = ahead[:, t - 1, :, None] + w["pair"] + (e[:, t] + behind[:, t])[:, None, :] - norm[:, None, None]
            g["pair"] += (np.exp(both) * mask[:, t, None, None]).sum(axis=0)
            np.add.at(g["pair"], (gold[mask[:, t], t - 1], gold[mask[:, t], t]), -1.0)
        for k in w:
            grad = g[k] / n + 1e-4 * w[k]
            one[k], two[k] = 0.9 * one[k] + 0.1 * grad, 0.99 * two[k] + 0.01 * grad**2
            w[k] -= 0.15 * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.99**step)) + 1e-8)
        w["own"][size] = 0
    return Field({f: w["own"][k] for f, k in own.items()}, w["n0"], w["n1"], w["n2"], w["file"], w["pair"])


def train(docs: DataFrame, sample: int = 300) -> Field:
    """A field from about ``sample`` texts with a word of the base patterns and as many of any kind, chosen by a hash
    of text and doc_id. Without texts it learns from made-up secrets alone."""
    rows = docs.filter(c("text").isNotNull()).select("doc_id", "text")
    low = F.lower("text")
    cue = c("text").contains("AKIA")
    for x in ("passw", "secret", "token", "apikey", "api_key"):
        cue = cue | low.contains(x)
    sizes = rows.agg(F.count_if(cue), F.count("*")).first()
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    texts: set[str] = set()
    for part, size in zip((rows.filter(cue), rows), sizes, strict=True):
        if size:
            picked = part.filter(draw < sample / size).select("text").limit(2 * sample + 100)
            texts |= {r["text"] for r in picked.collect()}
    return fit(sorted(texts))


def _left(text: str, start: int, stop: int, spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The pieces of a stretch that are in no span (these are by start), without what is at their edges."""
    out = []
    for x, y in [*((x, y) for x, y, _ in spans if x < stop and start < y), (stop, stop)]:
        s, e = start, x
        while s < e and (text[s] in EDGE or text[s].isspace()):
            s += 1
        while e > s and (text[e - 1] in EDGE or text[e - 1].isspace()):
            e -= 1
        if s < e:
            out.append((s, e))
        start = max(start, y)
    return out


def scan(texts: list[str | None], field: Field) -> list[list[tuple[int, int, str]]]:
    """All spans per text, in code points, by start and then kind. Of what the field finds, every piece that no base
    span covers is added, without the quotes, stops and white space around it."""
    whole = [t or "" for t in texts]
    tokens = [t.split() for t in whole]
    scores, begin = field.scores(tokens)
    out = []
    for k, text in enumerate(whole):
        spans = base_spans(text)
        tagged = field.tag(scores[begin[k] : begin[k + 1]])
        if tagged:
            places, found = [m.span() for m in _TOKEN.finditer(text)], []
            for a, b in tagged:
                found += [(s, e, "crf") for s, e in _left(text, places[a][0], places[b - 1][1], spans)]
            spans = sorted([*spans, *found], key=lambda s: (s[0], KINDS.index(s[2])))
        out.append(spans)
    return out


RESULT = "array<struct<kind:string,start:bigint,stop:bigint>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def annotate(docs: DataFrame, field: Field, out: str = "secrets") -> DataFrame:
    """Documents with the secrets of the whole text in ``out``: kind (assign, access, hex, crf), start and stop in code
    points, by start and then kind. Spans of different kinds may overlap, spans of one kind do not. Null and empty
    texts have none. Works inside the row; other columns pass through unread."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @arrow_udf(RESULT)
    def find(text: pa.Array) -> pa.Array:
        rows = [[{"kind": k, "start": a, "stop": b} for a, b, k in spans] for run in pieces(text) for spans in scan(run, shared.value)]
        return pa.array(rows, ARROW)

    return docs.withColumn(out, find(c("text").cast("string")))


def cover(text: str | None, spans: list[dict], mark: str) -> str | None:
    """The text with every stretch of spans replaced by ``mark``."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["stop"])
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """Documents with every secret in ``text`` replaced by ``mark``; all rows and other columns stay. A text goes to one
    Python task, which finds and covers."""

    shared = docs.sparkSession.sparkContext.broadcast(field)

    @arrow_udf("string")
    def covered(text: pa.Array) -> pa.Array:
        rows = []
        for run in pieces(text):
            for t, spans in zip(run, scan(run, shared.value), strict=True):
                rows.append(cover(t, [{"start": a, "stop": b} for a, b, _ in spans], mark))
        return pa.array(rows, pa.string())

    return docs.withColumn("text", covered(c("text").cast("string")))


def report(docs: DataFrame, sample: int = 300) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf."""
    docs = docs.select("doc_id", "text")
    found = annotate(docs, train(docs, sample), "__s")
    number = lambda kind: F.size(F.filter("__s", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = F.filter("__s", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(c("__s")).alias("spans"),
        number("crf").alias("n_crf"),
    )
