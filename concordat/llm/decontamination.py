"""Benchmark decontamination: a broadcast hash set of test n-grams against the word windows of every document."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from concordat.llm.common import Words, folded, mix, pieces, separator_table
from concordat.session import cut_lineage

c = F.col
WIDTH = 13
HITS = "__benchmark_hits"
SPAN = "array<struct<start:bigint,stop:bigint>>"
RESULT = f"struct<n_words:bigint,n_hit:bigint,spans:{SPAN},items:array<string>>"
ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("items", pa.list_(pa.string())),
    ]
)
_ALNUM = separator_table("alnum")
_BASE = np.uint64(0x9FB21C651E98DF25)
_SLOTS = 1 << 22


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    out = h[:n].copy()
    for k in range(1, width):
        out *= _BASE
        out += h[k : k + n]
    return mix(out)


class Table(NamedTuple):
    """Distinct windows of one width in order of their hashes: the hash, the first word in the benchmark, and where the
    window's items begin and end in ``items``; ``slots``: a bit per low part of a hash."""

    hash: np.ndarray
    first: np.ndarray
    edge: np.ndarray
    items: np.ndarray
    slots: np.ndarray


class Grams:
    """The hash set of benchmark windows, in arrays over one buffer of the items' words: about 40 bytes a word."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        names = {name: k for k, name in enumerate(dict.fromkeys(name for name, _ in items))}
        self.names = list(names)
        self.buf, self.starts, self.ends = np.empty(0, np.uint8), np.empty(0, np.int32), np.empty(0, np.int32)
        runs, size, buffers, words, found, at = [[]], 0, [], [], defaultdict(list), 0
        for item in items:
            runs[-1].append(item)
            size += len(item[1] or "")
            if size > 500_000:
                runs, size = [*runs, []], 0
        for run in runs:
            w = Words([folded(text) for _, text in run], _ALNUM)
            offset = sum(len(x) for x in buffers)
            words.append((w.starts + offset, w.ends + offset))
            buffers.append(w.buf)
            for (name, _), a, b in zip(run, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                if b > a:
                    n = min(width, b - a)
                    h = window_hashes(w.hash[a:b], n)
                    found[n].append((h, np.arange(at + a, at + a + len(h), dtype=np.int32), np.full(len(h), names[name], np.int32)))
            at += len(w.hash)
        if buffers:
            self.buf = np.concatenate(buffers)
            self.starts, self.ends = (np.concatenate([x[k] for x in words]).astype(np.int64) for k in (0, 1))
        self.tables = {n: self._table(n, *(np.concatenate(x) for x in zip(*parts, strict=True))) for n, parts in sorted(found.items())}

    def window(self, at: int, n: int) -> bytes:
        return b" ".join([self.buf[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True)])

    def _table(self, n: int, h: np.ndarray, first: np.ndarray, item: np.ndarray) -> Table:
        order = np.argsort(h, kind="stable")
        h, first, item = h[order], first[order], item[order]
        edge = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(h))))
        # Windows with one hash are almost always equal; those that are not get an entry each.
        many = np.flatnonzero(np.diff(np.append(edge, len(h))) > 1)
        entry = np.zeros(len(h), np.int64)
        for g in many.tolist():
            stop = edge[g + 1] if g + 1 < len(edge) else len(h)
            known: dict[bytes, int] = {}
            for k in range(int(edge[g]), int(stop)):
                entry[k] = known.setdefault(self.window(int(first[k]), n), len(known))
        order = np.lexsort((item, entry, group))
        h, first, item, entry, group = h[order], first[order], item[order], entry[order], group[order]
        new = np.append(True, (group[1:] != group[:-1]) | (entry[1:] != entry[:-1]))
        keep = new | np.append(True, item[1:] != item[:-1])
        slots = np.zeros(_SLOTS // 8, np.uint8)
        low = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        np.bitwise_or.at(slots, low >> 3, (1 << (low & 7)).astype(np.uint8))
        return Table(h[new], first[new], np.append(np.flatnonzero(new[keep]), keep.sum()), item[keep], slots)


def scan(texts: list[str | None], before: list[dict | None], grams: Grams) -> list[dict]:
    """Hits per text, joined with hits of earlier passes. An equal hash is only a hint; the words decide."""
    w = Words([folded(t) for t in texts], _ALNUM)
    n_words = np.diff(w.first)
    owner = np.repeat(np.arange(len(texts)), n_words)
    step = np.zeros(len(owner) + 1, np.int32)
    items: dict[int, set[str]] = defaultdict(set)
    for n, t in grams.tables.items():
        hashes = window_hashes(w.hash, n)
        low = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        hint = np.flatnonzero(t.slots[low >> 3] >> (low & 7) & 1)
        hint = hint[owner[hint] == owner[hint + n - 1]]
        left, right = np.searchsorted(t.hash, hashes[hint], "left"), np.searchsorted(t.hash, hashes[hint], "right")
        for at, lo, hi in zip(hint[left < right].tolist(), left[left < right].tolist(), right[left < right].tolist(), strict=True):
            words = b" ".join([w.buf[a:b].tobytes() for a, b in zip(w.starts[at : at + n], w.ends[at : at + n], strict=True)])
            for k in range(lo, hi):
                if grams.window(int(t.first[k]), n) == words:
                    step[at] += 1
                    step[at + n] -= 1
                    items[int(owner[at])].update(x for x in (grams.names[i] for i in t.items[t.edge[k] : t.edge[k + 1]]) if x is not None)
    for k, old in enumerate(before):
        for s in old["spans"] if old else ():
            step[w.first[k] + s["start"]] += 1
            step[w.first[k] + s["stop"]] -= 1
        if old:
            items[k].update(old["items"])
    hit = np.cumsum(step[:-1]) > 0
    out = []
    for k, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        mine = hit[a:b]
        edge = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist() if mine.any() else []
        spans = [{"start": s, "stop": e} for s, e in zip(edge[::2], edge[1::2], strict=True)]
        out.append({"n_words": b - a, "n_hit": int(mine.sum()), "spans": spans, "items": sorted(items.get(k, ()))})
    return out


def cut(text: str | None, spans: list[dict]) -> str | None:
    """The text without the hit words and what stands between them; the rest keeps its order."""
    if not text or not spans:
        return text
    raw = text.encode()
    w = Words([folded(text)], _ALNUM)
    kept, at = [], 0
    for s in spans:
        kept.append(raw[at : w.starts[s["start"]]])
        at = int(w.ends[s["stop"] - 1])
    return b"".join([*kept, raw[at:]]).decode()


def _hits(shared: Broadcast) -> Callable:
    @arrow_udf(RESULT)
    def hits(text: pa.Array, old: pa.Array) -> pa.Array:
        rows, at, past = [], 0, old.to_pylist()
        for run in pieces(text):
            rows += scan(run, past[at : at + len(run)], shared.value)
            at += len(run)
        return pa.array(rows, ARROW)

    return hits.asNondeterministic()  # so that a filter on the result does not scan every text twice


def _dealt(benchmark: DataFrame, width: int, block_words: int) -> tuple[DataFrame, int]:
    """(item_id, text, block) and the number of blocks. Items of more than ``block_words`` words are cut so that every
    window is in one piece; a piece without a window of its own is left out."""
    word = F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    rows = benchmark.select(c("item_id").cast("string").alias("item_id"), F.coalesce(c("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", word).cast("bigint"))
    total = rows.agg(F.sum("n")).first()[0]
    blocks = max(1, -(-int(total or 0) // block_words))
    short = rows.filter(c("n") <= block_words).select("item_id", "text")
    if blocks > 1:
        long = rows.filter(c("n") > block_words).withColumn("words", F.regexp_extract_all("text", word, F.lit(0)))
        starts = F.explode(F.sequence(F.lit(0).cast("bigint"), c("n") - width, F.lit(block_words).cast("bigint")))
        piece = F.array_join(F.slice("words", (c("at") + 1).cast("int"), F.lit(block_words + width - 1)), " ")
        short = short.unionByName(long.filter(c("n") >= width).withColumn("at", starts).select("item_id", piece.alias("text")))
    return short.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def annotate(docs: DataFrame, benchmark: DataFrame, out: str = "contamination", width: int = WIDTH, block_words: int = 2_000_000) -> DataFrame:
    """Documents with a struct ``out``: n_words, n_hit, spans of hit words (first word, word after the last) and the
    ids, sorted as strings, of the items with a window in the text.

    A window is ``width`` consecutive words of a benchmark item, or all words of a shorter item. The set of windows
    is broadcast; a benchmark of more than ``block_words`` words is dealt to as many passes as it needs, each with a set
    of about that size (twice at most, about 40 bytes a word), so the broadcast has a bound and the result is the same. An
    item that is longer than a pass is dealt in pieces that overlap by a window.

    Works inside the row on whole texts: no shuffle, no limit, nothing dropped, and a lost task is simply run again.
    Null or empty texts have no words and no hits. Items without words match nothing; items with a null id hit
    words but are not listed; repeated items count once. Other columns pass through, ``out`` replaces one of its name.
    """
    dealt, blocks = _dealt(benchmark, width, max(block_words, width))
    spark = docs.sparkSession
    result = docs.withColumn(out, F.lit(None).cast(RESULT))
    for k in range(blocks):
        rows = dealt.filter(c("block") == k).select("item_id", "text").collect()
        shared = spark.sparkContext.broadcast(Grams([(r[0], r[1]) for r in rows], width))
        result = result.withColumn(out, _hits(shared)(c("text").cast("string"), c(out)))
        if k + 1 < blocks:
            result = cut_lineage(result)
    return result


def contaminated(hits: str, least: int = 20):
    """At least one word in ``least`` is hit."""
    return (c(f"{hits}.n_hit") > 0) & (least * c(f"{hits}.n_hit") >= c(f"{hits}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """Documents without contaminated ones (``remove`` "documents"), or with every hit span cut from the texts
    ("spans"). Columns and all other rows stay as they are."""
    marked = annotate(docs, benchmark, HITS)
    if remove == "documents":
        return marked.filter(~contaminated(HITS)).drop(HITS)

    @arrow_udf("string")
    def without(text: pa.Array, hits: pa.Array) -> pa.Array:
        return pa.array([cut(t, h["spans"]) for t, h in zip(text.to_pylist(), hits.to_pylist(), strict=True)], pa.string())

    return marked.withColumn("text", without("text", HITS)).drop(HITS)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated."""
    marked = annotate(docs.select("doc_id", "text"), benchmark, HITS)
    return marked.select(
        "doc_id",
        c(f"{HITS}.n_words"),
        c(f"{HITS}.n_hit"),
        F.size(f"{HITS}.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(f"{HITS}.items", ","), 256).alias("items_sha256"),
        contaminated(HITS).alias("contaminated"),
    )
