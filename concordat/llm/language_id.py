"""Language identification: scripts narrow the candidates, then Viterbi over word scores labels spans."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from concordat.llm.common import _MUL, _powers, mix, pieces

c = F.col
SLOTS = 1 << 18
UNKNOWN = "und"
RUN = 250_000  # characters worked on at a time: what a task needs for them stays small, and near the processor
# Code point ranges of scripts. Letters outside them count as one more script.
SCRIPTS = {
    "Latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FFFF)],
}
OTHER = len(SCRIPTS) + 1
_TABLE: np.ndarray | None = None


def script_table() -> np.ndarray:
    """Script number per code point; 0 for what is no letter. Built once per process."""
    global _TABLE
    if _TABLE is None:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        table = np.where(letter, OTHER, 0).astype(np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                table[a : b + 1][letter[a : b + 1]] = k
        _TABLE = table
    return _TABLE


class Letters:
    """Words of many texts: runs of letters of one script. ``first``: index of each text's first word."""

    def __init__(self, texts: list[str | None]):
        lowered = [t.lower() if t else "" for t in texts]
        sizes = np.fromiter((len(t) for t in lowered), np.int64, len(texts))
        points = np.frombuffer("".join(f"{t}\n" for t in lowered).encode("utf-32-le"), np.uint32)
        script = script_table()[points]
        turn = np.flatnonzero(np.diff(script, prepend=np.uint8(0), append=np.uint8(0)))
        ends = np.append(turn[1:], len(script))
        is_word = script[np.minimum(turn, len(script) - 1)] > 0
        self.starts, self.lens = turn[is_word], (ends - turn)[is_word]
        self.script = script[self.starts]
        self.first = np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes + 1))))
        self._points, self._letter = points, script > 0

    def _at(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the letters of the words ``which`` are, one word after the other, and at which of them each word begins."""
        lens = self.lens[which]
        begin = np.cumsum(lens) - lens
        return np.repeat(self.starts[which] - begin, lens) + np.arange(int(lens.sum())), begin

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(which, number): words that stand for all, and for every word the number of its own among them. Both have the
        same letters and edges, so the same features. Words that touch one of another script stand for themselves."""
        count = len(self.starts)
        if not count:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, begin = self._at(np.arange(count))
        here = self._points[at]
        value = (here.astype(np.uint64) + np.uint64(1)) * _powers(int(self.lens.max()))[np.arange(len(at)) - np.repeat(begin, self.lens)]
        key = np.add.reduceat(value, begin) + self.lens.astype(np.uint64) * _MUL
        # Every text ends with a line break, so a word is never the last of the buffer.
        touches = np.flatnonzero(((self.starts > 0) & self._letter[self.starts - 1]) | self._letter[self.starts + self.lens])
        code = pa.array(key).dictionary_encode()
        number, size = code.indices.to_numpy().astype(np.int64), len(code.dictionary)
        number[touches] = size + np.arange(len(touches))
        which = np.full(size + len(touches), -1)
        which[number[::-1]] = np.arange(count)[::-1]
        used = which >= 0
        number, which = (np.cumsum(used) - 1)[number], which[used]
        like = which[number]
        if not np.array_equal(self.lens[like], self.lens) or not np.array_equal(self._points[self._at(like)[0]], here):
            return np.arange(count), np.arange(count)  # two words of one hash
        return which, number

    def features(self, which: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Hash slots of two, three and four letters around every letter of the words ``which``, word edges included, and one
        slot per word for the whole of it; and at which letter each word begins."""
        if not len(which):
            return [np.empty(0, np.int64)] * 4, np.empty(0, np.int64)
        keep, begin = self._at(which)
        x = np.where(self._letter, self._points, 0)
        x = np.concatenate((np.zeros(2, x.dtype), x, np.zeros(2, x.dtype)))
        b1, here, a1 = (x[keep + k].astype(np.uint64) for k in (1, 2, 3))
        b2 = np.where(b1 > 0, x[keep], 0).astype(np.uint64)
        two = b1 * np.uint64(0x9E3779B97F4A7C15) + here
        three = two * np.uint64(0xC2B2AE3D27D4EB4F) + a1 + np.uint64(7)
        four = three * np.uint64(0x165667B19E3779F9) + b2 + np.uint64(13)
        lens = self.lens[which]
        pos = np.arange(len(keep)) - np.repeat(begin, lens)
        whole = np.add.reduceat((here + np.uint64(1)) * _powers(int(lens.max()))[pos], begin) + np.uint64(29)
        return [(mix(v) & np.uint64(SLOTS - 1)).astype(np.int64) for v in (two, three, four, whole)], begin


@dataclass
class Model:
    """Languages, a score per hash slot and language, and which languages a script allows."""

    langs: list[str]
    table: np.ndarray
    allowed: np.ndarray
    penalty: float = 12.0

    def word_scores(self, w: Letters) -> np.ndarray:
        """A log score per word and language; languages that its script rules out are far behind. Where it rules out all
        of them, the word says nothing: zeros."""
        if not len(w.starts):
            return np.zeros((0, len(self.langs)))
        which, number = w.distinct()
        (two, three, four, whole), begin = w.features(which)
        each = np.empty((len(which), len(self.langs)))
        for k in range(len(self.langs)):
            column = self.table[k]
            letters = column[two] + column[three] + column[four]
            each[:, k] = np.add.reduceat(letters, begin) / 3 + column[whole]
        allowed = self.allowed[w.script[which]]
        each -= np.where(allowed, 0.0, 50.0)
        each[~allowed.any(axis=1)] = 0.0
        return each[number]

    def spans(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Language number per word: the path with the highest sum of scores less the penalty for each switch.

        Where no run of words gains more than one penalty by any other language, staying with the language
        of the highest sum is such a path; only other texts are walked word by word, all of them together."""
        n = np.diff(first)
        path = np.zeros(len(scores), np.int64)
        if not len(scores):
            return path
        running = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0)))
        total = running[first[1:]] - running[first[:-1]]
        best = total.argmax(axis=1)
        owner = np.repeat(np.arange(len(n)), n)
        path[:] = best[owner]
        ahead = scores - scores[np.arange(len(scores)), path][:, None]
        gain = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(ahead, axis=0)))
        drop = 1e4 + 2 * float(np.abs(ahead).sum(axis=0).max(initial=0.0))
        level = -drop * np.arange(len(n))
        offset = (level[:, None] - gain[first[:-1]])[owner]
        low = np.minimum.accumulate(gain[:-1] + offset, axis=0)
        high = gain[1:] + offset - low
        mixed = np.zeros(len(n), bool)
        mixed[owner[(high > self.penalty).any(axis=1)]] = True
        self._walk(scores, first, np.flatnonzero(mixed & (n > 0)), path)
        return path

    def _walk(self, scores: np.ndarray, first: np.ndarray, which: np.ndarray, path: np.ndarray) -> None:
        n = np.diff(first)[which]
        order = np.argsort(-n, kind="stable")
        which, n = which[order], n[order]
        alone = 512 // max(1, scores.shape[1])  # so few texts are walked faster one by one
        for i in which[:alone].tolist():
            path[first[i] : first[i + 1]] = self._walk_one(scores[first[i] : first[i + 1]])
        which, n = which[alone:], n[alone:]
        if not len(which):
            return
        begin, langs = first[:-1][which], np.arange(scores.shape[1])
        value = scores[begin].copy()
        back: list[np.ndarray] = []
        for t in range(1, int(n[0])):
            k = int(np.searchsorted(-n, -t, side="left"))
            v = value[:k]
            top = v.argmax(axis=1)
            switched = v[np.arange(k), top][:, None] - self.penalty
            back.append(np.where(switched > v, top[:, None], langs[None, :]).astype(np.int16))
            value[:k] = np.maximum(v, switched) + scores[begin[:k] + t]
        state = value.argmax(axis=1)
        for t in range(int(n[0]) - 1, -1, -1):
            k = int(np.searchsorted(-n, -t, side="left"))
            path[begin[:k] + t] = state[:k]
            if t:
                state[:k] = back[t - 1][np.arange(k), state[:k]]

    def _walk_one(self, scores: np.ndarray) -> np.ndarray:
        """The path of one text: the steps in plain numbers, what they came from in blocks."""
        langs, penalty = np.arange(scores.shape[1]), self.penalty
        value, back = scores[0].tolist(), []
        for at in range(1, len(scores), 4096):
            before = []
            for row in scores[at : at + 4096].tolist():
                before.append(value)
                switched = max(value) - penalty
                value = [(v if v > switched else switched) + s for v, s in zip(value, row, strict=True)]
            v = np.array(before)
            top = v.argmax(axis=1)
            switch = v[np.arange(len(v)), top][:, None] - penalty
            back.append(np.where(switch > v, top[:, None], langs[None, :]).astype(np.int16))
        state = value.index(max(value))
        path = [state]
        for block in reversed(back):
            for row in reversed(block.tolist()):
                state = row[state]
                path.append(state)
        return np.array(path[::-1], np.int64)

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """(language, score, spans) per text; a span is (language, first word, word after the last). Words in a script of
        no language are spans of ``und`` and count among the letters that the score is a share of."""
        w = Letters(texts)
        scores = self.word_scores(w)
        path = self.spans(scores, w.first) if self.langs else np.zeros(len(w.starts), np.int64)
        known, names = self.allowed.any(axis=1)[w.script], [*self.langs, UNKNOWN]
        out = []
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if a == b or not self.langs:
                out.append((UNKNOWN, 0.0, []))
                continue
            mine, size = np.where(known[a:b], path[a:b], len(self.langs)), w.lens[a:b]
            letters = np.bincount(mine, weights=size, minlength=len(self.langs) + 1)
            k = int(letters[:-1].argmax())
            own = mine == k
            mean = scores[a:b][own].mean(axis=0) * min(10, int(own.sum())) if own.any() else np.zeros(len(self.langs))
            sure = 1.0 / float(np.exp(np.clip(mean - mean[k], -60, 60)).sum())
            edge = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), b - a]
            spans = [(names[int(mine[s])], s, e) for s, e in zip(edge, edge[1:])]  # noqa: B905
            out.append((self.langs[k], min(1.0, float(letters[k] / letters.sum() * sure)), spans))
        return out


    def told(self, texts: list[str | None]) -> list[str]:
        """The language per text that ``label`` gives, without scores and spans."""
        w, wide = Letters(texts), len(self.langs) + 1
        n = np.diff(w.first)
        if not self.langs or not len(w.starts):
            return [UNKNOWN] * len(texts)
        path = self.spans(self.word_scores(w), w.first)
        mine = np.where(self.allowed.any(axis=1)[w.script], path, len(self.langs))
        at = np.repeat(np.arange(len(n)), n) * wide + mine
        best = np.bincount(at, weights=w.lens, minlength=len(n) * wide).reshape(len(n), wide)[:, :-1].argmax(axis=1)
        return [self.langs[k] if some else UNKNOWN for k, some in zip(best.tolist(), (n > 0).tolist(), strict=True)]


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, slot, n): how often a hash slot (kind 0) or script (kind 1) occurs."""
    for batch in rows:
        langs, texts = (x.to_pylist() for x in batch.columns)
        for lang in sorted(set(langs)):
            mine = pa.array([t for g, t in zip(langs, texts, strict=True) if g == lang], pa.string())
            for run in pieces(mine, RUN):
                w = Letters(run)
                which, number = w.distinct()
                slots, _ = w.features(which)
                times = np.bincount(number, minlength=len(which))
                n = sum(np.bincount(v, np.repeat(times, w.lens[which]) if k < 3 else times, SLOTS) for k, v in enumerate(slots))
                slot = np.flatnonzero(n)
                n = n[slot]
                scripts = np.bincount(w.script, weights=w.lens, minlength=OTHER + 1)
                seen = np.flatnonzero(scripts)
                size = len(slot) + len(seen)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * size, pa.string()),
                        pa.array(np.concatenate((np.zeros(len(slot)), np.ones(len(seen)))).astype(np.int32)),
                        pa.array(np.concatenate((slot, seen)).astype(np.int32)),
                        pa.array(np.concatenate((n, scripts[seen])).astype(np.int64)),
                    ],
                    names=["lang", "kind", "slot", "n"],
                )


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(docs: DataFrame, per_lang: int | None = 2000, smooth: float = 0.5, least_share: float = 0.01) -> Model:
    """A model from (doc_id, text, lang) rows with a language, on about ``per_lang`` documents of each, chosen by a
    hash of doc_id; on all of them without ``per_lang``. Counting runs in Spark; the driver gets at most 2**18 slots per language.

    The score of a slot is its smoothed log frequency in a language less the mean over languages. A script allows
    the languages with at least ``least_share`` of their letters in it."""
    known = docs.filter(c("lang").isNotNull() & c("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((0, SLOTS)), np.zeros((OTHER + 1, 0), bool))
    if per_lang is not None:
        share = F.create_map(*[F.lit(v) for g in langs for v in (g, min(1.0, per_lang / sizes[g]))])
        draw = F.pmod(F.xxhash64(F.lit("language"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
        known = known.filter(draw < share[c("lang")])
    sample = known.select("lang", "text")
    sums = sample.mapInArrow(_counts, "lang string, kind int, slot int, n bigint").groupBy("lang", "kind", "slot").agg(F.sum("n").alias("n"))
    counts, scripts = np.full((len(langs), SLOTS), smooth), np.zeros((len(langs), OTHER + 1))
    rows = sums.toArrow()
    number = {g: k for k, g in enumerate(langs)}
    lang = np.fromiter((number[g] for g in rows["lang"].to_pylist()), np.int64, rows.num_rows)
    kind, slot, n = (rows[x].to_numpy() for x in ("kind", "slot", "n"))
    np.add.at(counts, (lang[kind == 0], slot[kind == 0]), n[kind == 0])
    np.add.at(scripts, (lang[kind == 1], slot[kind == 1]), n[kind == 1])
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    allowed = (scripts / np.maximum(1.0, scripts.sum(axis=1, keepdims=True)) >= least_share).T
    return Model(langs, logs - logs.mean(axis=0), allowed)


RESULT = "struct<lang:string,score:double,spans:array<struct<lang:string,start:bigint,stop:bigint>>>"
ARROW = pa.struct(
    [
        ("lang", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))),
    ]
)


def annotate(docs: DataFrame, model: Model, out: str = "language") -> DataFrame:
    """Documents with a struct ``out``: lang, score from 0 to 1, and spans of words by language.

    lang is the language of most letters, ``und`` for null and for texts without a letter; the score is its part of
    the letters times the probability of its own words' scores. Letters of a script that no language is written in
    count as none's: a text of nothing else has score 0, and the first language stands for it. Works inside the row on whole texts; other columns
    pass through and are never read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(RESULT)
    def label(text: pa.Array) -> pa.Array:
        rows = [
            {"lang": lang, "score": score, "spans": [{"lang": g, "start": a, "stop": b} for g, a, b in spans]}
            for run in pieces(text, RUN)
            for lang, score, spans in shared.value.label(run)
        ]
        return pa.array(rows, ARROW)

    # As non-deterministic it is not copied into a filter on its result, which would label every text twice.
    return docs.withColumn(out, label.asNondeterministic()(c("text").cast("string")))


def report(docs: DataFrame, per_lang: int = 2000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from rows whose fold of four is not 2 and
    predicts all; a table without languages predicts ``und`` with score 0."""
    model = train(docs.filter(fold(c("doc_id"), 4) != 2), per_lang)
    done = annotate(docs.select("doc_id", "text"), model, "__language")
    return done.select(
        "doc_id", (fold(c("doc_id"), 4) == 2).alias("held_out"), c("__language.lang").alias("lang_pred"), c("__language.score").alias("score")
    )
