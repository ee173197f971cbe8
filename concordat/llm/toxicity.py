"""Toxicity: a convolutional text classifier over hashed word embeddings, with thresholds by language."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from concordat.llm import language_id
from concordat.llm.common import Words, mix, pieces, separator_table
from concordat.llm.ngram_jaccard import BITMAP, _bitmap
from concordat.session import cut_lineage

c = F.col
SLOTS = 1 << 19
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 8
PREFIXES = (4, 5)
LEAD = max(WIDTHS) - 1
PAD = LEAD + 1
SHARD = 8 << 20  # bytes of text that one pass of a task goes over
SHARD_ROWS = 2_000
GRAIN = float(1 << 30)
STEPS = 1024
_ALNUM = separator_table("alnum")


def _encoded(texts: list[str | None]) -> Words:
    return Words([t.lower().encode() if t else b"" for t in texts], _ALNUM)


def word_slots(w: Words) -> np.ndarray:
    """Rows of the embedding table per word: one of the whole word and one of each of its first bytes, so that
    inflected forms share what they have in common."""
    columns = [w.hash]
    lens = w.ends - w.starts
    for n in PREFIXES:
        h = np.full(len(lens), np.uint64(n * 0x51ED27), np.uint64)
        for k in range(n):
            inside = np.minimum(w.starts + k, len(w.buf) - 1)
            h = h * np.uint64(0x100000001B3) + np.where(lens > k, w.buf[inside], 0).astype(np.uint64)
        columns.append(mix(h))
    return np.stack([(h & np.uint64(SLOTS - 1)).astype(np.int32) for h in columns], axis=1)


@dataclass
class Net:
    """Embedding rows, one filter bank per width, and an output layer over the pooled maxima.

    ``base`` is the score where there was nothing to learn from. ``cut``: threshold of the raw score by language."""

    table: np.ndarray = field(default_factory=lambda: np.zeros((SLOTS, DIM), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray = field(default_factory=lambda: np.zeros(1))
    shift: float = 0.0
    base: float | None = None
    cut: dict[str, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """Sent are the rows of the table that are not zero."""
        rows = np.flatnonzero(self.table.any(axis=1)).astype(np.int32)
        return self.__dict__ | {"table": (rows, self.table[rows])}

    def __setstate__(self, state: dict) -> None:
        rows, values = state["table"]
        self.__dict__.update(state)
        self.table = np.zeros((SLOTS, DIM), np.float32)
        self.table[rows] = values

    def embedded(self, slots: np.ndarray) -> np.ndarray:
        """The sum of a word's rows of the table, worked out once for words of the same rows."""
        wide = slots.astype(np.int64)
        code = pa.array((wide[:, 0] * SLOTS + wide[:, 1]) * SLOTS + wide[:, 2]).dictionary_encode()
        own = code.dictionary.to_numpy()
        rows = self.table[own // (SLOTS * SLOTS)] + self.table[own // SLOTS % SLOTS] + self.table[own % SLOTS]
        return rows[code.indices.to_numpy()]

    def pooled(self, slots: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maxima of each filter over the windows of every text, the word at which each is reached, and the
        embedded words. Empty words before and after every text keep its windows off its neighbours."""
        n = np.diff(first)
        begin = first[:-1] + PAD * np.arange(len(n))
        size = int(first[-1]) + PAD * len(n)
        x = np.zeros((size + LEAD, DIM), np.float32)
        at = np.arange(int(first[-1])) + LEAD + PAD * np.repeat(np.arange(len(n)), n)
        x[at] = self.embedded(slots)
        values, places = [], []
        for width, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            y = x[:size] @ f[0]
            for k in range(1, width):
                y += x[k : size + k] @ f[k]
            top = np.maximum.reduceat(y, begin, axis=0)
            values.append(np.maximum(top + b, 0))
            places.append((y, begin, top))
        return np.concatenate(values, axis=1), places, x

    def raw(self, texts: list[str | None]) -> np.ndarray:
        w = _encoded(texts)
        return self.pooled(word_slots(w), w.first)[0] @ self.out + self.shift

    def scores(self, texts: list[str | None], langs: list[str]) -> np.ndarray:
        if self.base is not None:
            return np.full(len(texts), self.base)
        cut = np.array([self.cut.get(g, self.cut[""]) for g in langs])
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(texts) - cut, -60, 60)))


@dataclass
class Past:
    """Sums of squared steps: per row of the embedding table, and per other weight in the order of ``dense``."""

    table: np.ndarray
    dense: np.ndarray


def dense(net: Net) -> np.ndarray:
    """All weights but the table in one vector."""
    return np.concatenate([*(f.ravel() for f in net.filters), *net.bias, net.out, [net.shift]]).astype(np.float64)


def with_dense(net: Net, v: np.ndarray) -> Net:
    """The net with the weights of a vector as ``dense`` gives it."""
    filters, bias, at = [], [], 0
    for width in WIDTHS:
        filters.append(v[at : at + width * DIM * FILTERS].reshape(width, DIM, FILTERS).astype(np.float32))
        at += width * DIM * FILTERS
    for _ in WIDTHS:
        bias.append(v[at : at + FILTERS].astype(np.float32))
        at += FILTERS
    return replace(net, filters=filters, bias=bias, out=v[at:-1].copy(), shift=float(v[-1]))


def start(per: list[np.ndarray], sizes: list[int], seed: int = 11) -> tuple[Net, Past]:
    """A net before its first step. ``per``: in how many texts of class 0 and 1 a slot is; ``sizes``: of the classes.

    The first dimension of a slot starts as its log odds between the classes; the rest starts as small noise."""
    rng = np.random.default_rng(seed)
    net = Net()
    seen = np.flatnonzero(per[0] + per[1])
    net.table[seen] = rng.normal(0, 0.05, (len(seen), DIM))
    odds = np.log((per[1] + 0.5) / sizes[1]) - np.log((per[0] + 0.5) / sizes[0])
    net.table[seen, 0] = np.where(per[0] + per[1] >= 3, np.clip(odds, -2, 4), 0)[seen] / 2
    for width in WIDTHS:
        f = rng.normal(0, 0.3 / np.sqrt(width), (width, DIM, FILTERS)).astype(np.float32)
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5 / width
        net.filters.append(f)
        net.bias.append(np.full(FILTERS, -0.5, np.float32))
    net.out = np.full(len(WIDTHS) * FILTERS, 0.2)
    net.shift = -1.0
    return net, Past(np.full(SLOTS, 1e-3, np.float32), np.full(len(dense(net)), 1e-2))


def learn(net: Net, past: Past, slots: np.ndarray, first: np.ndarray, labels: np.ndarray, rng: np.random.Generator) -> tuple[Net, Past, np.ndarray]:
    """One pass of Adagrad on the log loss over texts given as slots: the net and the sums after it, and which rows of
    the table moved. Only the words at which a filter has its maximum move, as pooling has it."""
    net, past = replace(net, table=net.table.copy()), Past(past.table.copy(), past.dense.copy())
    n, moved = np.diff(first), np.zeros(SLOTS, bool)
    rate, size = 0.05, 64
    order = rng.permutation(len(n))
    for s in range(0, len(order), size):
        pick = order[s : s + size]
        mine = np.concatenate([slots[first[i] : first[i + 1]] for i in pick])
        own = np.concatenate(([0], np.cumsum(n[pick])))
        h, places, x = net.pooled(mine, own)
        p = 1.0 / (1.0 + np.exp(-np.clip(h @ net.out + net.shift, -60, 60)))
        err = (p - labels[pick]) / len(pick)
        d_h = np.outer(err, net.out) * (h > 0)
        d_filters, d_bias, touched, moves = [], [], [], []
        for k, width in enumerate(WIDTHS):
            y, begin, top = places[k]
            d, f = d_h[:, k * FILTERS : (k + 1) * FILTERS], net.filters[k]
            there = y == np.repeat(top, n[pick] + PAD, axis=0)
            at = np.minimum.reduceat(np.where(there, np.arange(len(y))[:, None], len(y)), begin, axis=0)
            d_f = np.zeros(f.shape)
            for j in range(width):
                d_f[j] = np.einsum("mfd,mf->df", x[at + j], d)
                word = at + j - begin[:, None] - LEAD
                real = (word >= 0) & (word < n[pick][:, None]) & (d != 0)
                touched.append(mine[(own[:-1, None] + word)[real]])
                moves.append((f[j].T[None] * d[:, :, None])[real])
            d_filters.append(d_f.ravel())
            d_bias.append(d.sum(axis=0))
        step = np.concatenate([*d_filters, *d_bias, h.T @ err, [err.sum()]])
        past.dense += step**2
        net = with_dense(net, dense(net) - rate * step / np.sqrt(past.dense))
        rows, move = np.concatenate(touched), np.concatenate(moves)
        for column in rows.T if len(rows) else []:
            by = np.argsort(column, kind="stable")
            row, begin = np.unique(column[by], return_index=True)
            step = np.add.reduceat(move[by], begin, axis=0)
            past.table[row] += (step**2).mean(axis=1)
            net.table[row] -= (rate * step / np.sqrt(past.table[row])[:, None]).astype(np.float32)
            moved[row] = True
    return net, past, np.flatnonzero(moved)


def threshold(raw: np.ndarray, labels: np.ndarray, weight: float, counts: np.ndarray | None = None) -> float:
    """The cut with the least weighted errors; the middle of the widest such gap. ``weight``: of a clean text;
    ``counts``: how many texts an entry stands for."""
    order = np.argsort(raw, kind="stable")
    r, y, n = raw[order], labels[order], np.ones(len(raw), np.int64) if counts is None else counts[order]
    wrong = np.concatenate(([0], np.cumsum(n * (y == 1)))) + weight * np.concatenate((np.cumsum((n * (y == 0))[::-1])[::-1], [0]))
    r = np.concatenate(([r[0] - 1], r, [r[-1] + 1]))
    wrong = np.where(np.diff(r) > 0, wrong, np.inf)
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = best[np.argmax(r[best + 1] - r[best])]
    return float((r[k] + r[k + 1]) / 2)


def _chunks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(shard, number, slots, first, labels) of texts that lie together by shard; a large shard gives several."""
    shard, number, size = None, 0, 0
    slots: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    marks: list[int] = []

    def done() -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
        return shard, number, np.concatenate(slots), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.array(marks, np.int64)

    for batch in rows:
        shards, labels = batch.column(0).to_numpy(), batch.column(2).to_pylist()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:]):  # noqa: B905
            if a < b and shards[a] != shard:
                if marks:
                    yield done()
                shard, number, size, slots, sizes, marks = int(shards[a]), 0, 0, [], [], []
            at = a
            for run in pieces(batch.column(1).slice(a, b - a)):
                w = _encoded(run)
                slots.append(word_slots(w))
                sizes.append(np.diff(w.first))
                marks += labels[at : at + len(run)]
                at, size = at + len(run), size + len(w.buf)
                if size >= SHARD:
                    yield done()
                    number, size, slots, sizes, marks = number + 1, 0, [], [], []
    if marks:
        yield done()


def _slot_counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, toxic, n): in how many texts of a class a slot is."""
    for _, _, slots, first, labels in _chunks(rows):
        owner = np.repeat(np.arange(len(labels)), np.diff(first))
        pairs = np.unique(np.concatenate([owner * SLOTS + slots[:, k] for k in range(slots.shape[1])]))
        for y in (0, 1):
            n = np.bincount(pairs[labels[pairs // SLOTS] == y] % SLOTS, minlength=SLOTS)
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(np.full(len(slot), y, np.int32)), pa.array(n[slot])], names=["slot", "toxic", "n"])


def _steps(rows: Iterator[pa.RecordBatch], shared: Broadcast, turn: int) -> Iterator[pa.RecordBatch]:
    """(slot, n, v0, v1, …) after a pass over each chunk: changes of what moved, as whole numbers so that their sums do not
    depend on the order, times the number of texts n. Rows from ``SLOTS`` on hold the other weights and their sums."""
    net, past = shared.value
    for shard, number, slots, first, labels in _chunks(rows):
        after, then, moved = learn(net, past, slots, first, labels, np.random.default_rng((11, turn, shard, number)))
        table = np.concatenate((after.table[moved] - net.table[moved], (then.table[moved] - past.table[moved])[:, None]), axis=1)
        rest = np.stack((dense(after) - dense(net), then.dense - past.dense), axis=1)
        rest = np.concatenate((rest, np.zeros((len(rest), DIM - 1))), axis=1)
        slot = np.concatenate((moved, SLOTS + np.arange(len(rest)))).astype(np.int32)
        n = len(labels)
        values = np.rint(np.concatenate((table, rest)).astype(np.float64) * GRAIN).astype(np.int64) * n
        columns = [pa.array(slot), pa.array(np.full(len(slot), n, np.int64)), *(pa.array(np.ascontiguousarray(v)) for v in values.T)]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *(f"v{k}" for k in range(DIM + 1))])


def fit(rows: DataFrame, sizes: list[int], work: int = 13_500, least: int = 2, most: int = 6) -> Net:
    """A net from all rows (shard, text, toxic) that lie together by shard; ``sizes``: rows of class 0 and 1.

    A round goes over every row once: tasks start from one net, pass over their chunks and return what changed; the
    changes are averaged by number of texts in Spark, those of a word over the chunks in which it moved. There are so
    many rounds that ``work`` texts are seen, from ``least`` to ``most``. The driver holds a net, whatever the input."""
    per = [np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)]
    counted = rows.mapInArrow(_slot_counts, "slot int, toxic int, n bigint").groupBy("slot", "toxic").agg(F.sum("n").alias("n")).toArrow()
    slot, toxic, n = (counted[x].to_numpy() for x in ("slot", "toxic", "n"))
    for y in (0, 1):
        per[y][slot[toxic == y]] = n[toxic == y]
    net, past = start(per, sizes)
    names = [f"v{k}" for k in range(DIM + 1)]
    for turn in range(min(most, max(least, -(-work // sum(sizes))))):
        shared = rows.sparkSession.sparkContext.broadcast((net, past))
        steps = rows.mapInArrow(lambda r, shared=shared, turn=turn: _steps(r, shared, turn), "slot int, n bigint, " + ", ".join(f"{x} bigint" for x in names))
        sums = steps.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)).orderBy("slot").toArrow()
        shared.destroy(blocking=True)
        slot, n = sums["slot"].to_numpy(), sums["n"].to_numpy()
        v = np.stack([sums[x].to_numpy() for x in names], axis=1) / n[:, None] / GRAIN
        of_table = slot < SLOTS
        net.table[slot[of_table]] += v[of_table, :DIM].astype(np.float32)
        past.table[slot[of_table]] += v[of_table, DIM].astype(np.float32)
        net = with_dense(net, dense(net) + v[~of_table, 0])
        past.dense += v[~of_table, 1]
    return net


def _held_scores(rows: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, toxic, step): language told and raw score, in steps, of every text."""
    net, langs = shared.value
    for batch in rows:
        at = 0
        for run in pieces(batch.column(0)):
            step = np.rint(np.clip(net.raw(run), -60, 60) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(langs.told(run), pa.string()), batch.column(1).slice(at, len(run)), pa.array(step)], names=["lang", "toxic", "step"])
            at += len(run)


def _labelled(docs: DataFrame, known: DataFrame, shards: int) -> DataFrame:
    """(shard, text, toxic, kept) of the documents that ``known`` (doc_id, toxic) has, in order and together by shard.

    Only texts that a bitmap of the known ids has move, and they do so once: ids alone are joined, and their labels go
    to the shards of the texts, where a window over the id hands them on."""
    drawn = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "doc_id", "text"), F.lit(n)).cast("int")
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP))
    known = known.select(c("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("doc_id"), "toxic").filter(c("doc_id").isNotNull())
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(known.select(slot.alias("slot"))))

    @arrow_udf("boolean")
    def maybe(slot: pa.Array) -> pa.Array:
        at = slot.to_numpy(zero_copy_only=False)
        return pa.array(((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool))

    texts = docs.filter(c("doc_id").isNotNull()).select("doc_id", c("text").cast("string").alias("text"))
    texts = texts.withColumns({"shard": drawn("toxicity", shards), "kept": drawn("kept", 4) == 3})
    told = texts.select("doc_id", "shard").distinct().join(known, "doc_id")
    none = lambda t: F.lit(None).cast(t)
    told = told.select("shard", "doc_id", none("string").alias("text"), none("boolean").alias("kept"), "toxic")
    both = texts.filter(maybe(slot)).select("shard", "doc_id", "text", "kept", none("int").alias("toxic")).unionByName(told)
    same = Window.partitionBy("shard", "doc_id").orderBy("text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = both.repartition("shard").withColumn("toxic", F.max("toxic").over(same)).filter(c("kept").isNotNull() & c("toxic").isNotNull())
    return both.sortWithinPartitions("shard", "doc_id", "text").select("shard", "text", "toxic", "kept")


def train(docs: DataFrame, labels: DataFrame, least: int = 25) -> tuple[Net, language_id.Model]:
    """A net and a language model from documents (doc_id, text, lang) and labels (doc_id, toxic).

    Learns from every labelled document: three in four, by a hash of id and text, move the net, the others set the
    thresholds, counted in steps of 1 / 1,024 of the raw score. Each language with at least ``least`` such texts of both classes
    gets a threshold of its own, the rest share one; languages are told from the texts, by a model of all documents.
    A document with several labels is toxic if one of them is; labels without a document or without a value are left
    out. With one class or none, the score of every text is the labelled toxic share, 0 if there are no labels."""
    known = labels.filter(c("toxic").isNotNull() & c("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut_lineage(known)
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    one, none = sizes.get(1, 0), sizes.get(0, 0)
    langs = language_id.train(docs, None)
    if not one or not none:
        return Net(base=1.0 if one else 0.0), langs
    marked = cut_lineage(_labelled(docs, known.filter(c("toxic").isin(0, 1)), 1 + (known.count() // SHARD_ROWS)))
    found = {(r["toxic"], r["kept"]): r["count"] for r in marked.groupBy("toxic", "kept").count().collect()}
    if any(not found.get((y, False)) and not found.get((y, True)) for y in (0, 1)):
        return Net(base=one / (one + none)), langs
    apart = all(found.get((y, kept)) for y in (0, 1) for kept in (False, True))
    moving, held = (marked.filter(~c("kept")), marked.filter("kept")) if apart else (marked, marked)
    net = fit(moving.select("shard", "text", "toxic"), [found.get((y, False), 0) + (0 if apart else found.get((y, True), 0)) for y in (0, 1)])
    shared = docs.sparkSession.sparkContext.broadcast((net, langs))
    scored = held.select("text", "toxic").mapInArrow(lambda r: _held_scores(r, shared), "lang string, toxic int, step int")
    counted = scored.groupBy("lang", "step", "toxic").agg(F.count("*").alias("n")).orderBy("lang", "step", "toxic").toArrow()
    shared.destroy(blocking=True)
    told = np.array(counted["lang"].to_pylist())
    raw, y, n = (counted[x].to_numpy() for x in ("step", "toxic", "n"))
    raw = raw / STEPS
    net.cut[""] = threshold(raw, y, 1.0, n)
    for g in sorted(set(told)):
        mine = told == g
        if min(n[mine & (y == v)].sum() for v in (0, 1)) >= least:
            net.cut[str(g)] = threshold(raw[mine], y[mine], 1.0, n[mine])
    return net, langs


def annotate(docs: DataFrame, net: Net, langs: language_id.Model, out: str = "toxicity") -> DataFrame:
    """Documents with the score of the whole text in ``out``: 0 to 1, 0.5 at the threshold of the text's language.
    Null and empty texts have a score too. Works inside the row; other columns pass through unread."""
    shared = docs.sparkSession.sparkContext.broadcast((net, langs))

    @arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        net, langs = shared.value
        runs = [net.scores(run, langs.told(run)) for run in pieces(text)]
        return pa.array(np.concatenate([np.empty(0), *runs]), pa.float64())

    return docs.withColumn(out, score(c("text").cast("string")))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learns from rows whose fold of five is not 0."""
    learn = language_id.fold(c("doc_id"), 5) != 0
    net, langs = train(docs.filter(learn), labels.filter(learn))
    done = annotate(docs.select("doc_id", "text"), net, langs, "__score")
    return done.select(
        "doc_id", (~learn).alias("held_out"), c("__score").alias("score"), F.when(c("__score") >= 0.5, 1).otherwise(0).alias("predicted")
    )
