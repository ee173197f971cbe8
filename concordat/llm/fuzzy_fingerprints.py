"""Document fingerprints by context-triggered piecewise hashing, and the likeness of two fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from concordat.llm.common import _powers, batches, mix
from concordat.session import cut_lineage

c = F.col
WINDOW = 7
CHUNKS = 64
LONGEST = 10
RUN = 7
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = np.uint32(0x01000193)


def _levels(b: np.ndarray) -> np.ndarray:
    """Per byte, how many block sizes end a chunk there: trailing zero bits of a hash of the last bytes."""
    padded = np.concatenate((np.zeros(WINDOW - 1, np.uint32), b.astype(np.uint32) + np.uint32(1)))
    r = padded[: len(b)].copy()
    for k in range(1, WINDOW):
        r *= _ROLL
        r += padded[k : k + len(b)]
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x2C1B3C6D)
    r ^= r >> np.uint32(12)
    r |= np.uint32(1 << 31)
    low = r & (~r + np.uint32(1))
    return np.log2(low.astype(np.float64)).astype(np.int64)


def _signature(b: np.ndarray, ends: np.ndarray) -> str:
    """One letter per chunk; what follows the last boundary is a chunk too."""
    starts = np.concatenate(([0], ends))
    if starts[-1] == len(b):
        starts = starts[:-1]
    sizes = np.diff(np.append(starts, len(b)))
    pos = np.arange(len(b)) - np.repeat(starts, sizes)
    sums = np.add.reduceat((b.astype(np.uint64) + np.uint64(1)) * _powers(int(sizes.max()))[pos], starts)
    return LETTERS[(mix(sums) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def _ends(levels: np.ndarray, level: int) -> np.ndarray:
    """Where chunks of a block size end. A chunk of more than ten block sizes, as hardly any text has that repeats no
    passage, is cut again: at boundaries of the next smaller block size that are one block size or more behind the last
    cut; what is still too long, at those of the one below, and so on."""
    ends = np.flatnonzero(levels >= level) + 1
    most, block = LONGEST << level, 1 << level
    edges = np.concatenate(([0], ends, [len(levels)]))
    long = [(int(edges[k]), int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges) > most)]
    more: list[int] = []
    for lower in range(level - 1, -1, -1):
        pieces, long = long, []
        for start, stop in pieces:
            places = np.flatnonzero(levels[start : stop - 1] >= lower) + start + 1
            cuts = [start]
            while (k := int(np.searchsorted(places, cuts[-1] + block))) < len(places):
                cuts.append(int(places[k]))
            more += cuts[1:]
            long += [(a, b) for a, b in zip(cuts, [*cuts[1:], stop], strict=True) if b - a > most]
    return np.sort(np.concatenate((ends, np.array(more, ends.dtype)))) if more else ends


def fingerprint(text: str | None) -> str:
    """``level:signature:signature at twice the block size`` of the whole text.

    A chunk ends where a rolling hash of the last seven bytes has ``level`` zero bits, so the block size is two to
    that power; where a text repeats a passage so often that its boundaries are at smaller block sizes only, some of
    those are taken (``_ends``). The level is the least one with at most 64 boundaries, whatever the length; every
    chunk has a letter. Null and empty texts: ``0::``."""
    if not text:
        return "0::"
    b = np.frombuffer(text.encode(), np.uint8)
    levels = _levels(b)
    counts = np.cumsum(np.bincount(levels)[::-1])[::-1]
    level = int(np.argmax(np.append(counts, 0) <= CHUNKS))
    while len(b) > (LONGEST << level) * (CHUNKS + 1):  # more than 64 chunks, as none is longer
        level += 1
    while len(ends := _ends(levels, level)) > CHUNKS:
        level += 1
    return f"{level}:{_signature(b, ends)}:{_signature(b, _ends(levels, level + 1))}"


def _squeezed(s: str) -> str:
    """Runs of one letter say little: at most three of them stay."""
    return "".join(x for i, x in enumerate(s) if i < 3 or not x == s[i - 1] == s[i - 2] == s[i - 3])


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, all rows of the table in the bits of one integer."""
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    v = whole
    for x in b:
        u = v & at.get(x, 0)
        v = (v + u) | (v - u)
    return len(a) - (v & whole).bit_count()


def _likeness(a: str, b: str) -> float:
    """1 - edits / letters, with inserted and deleted letters as edits. Signatures without a common run of seven
    letters (of a fourth of the shorter one, if that is less) have nothing in common but chance: 0."""
    a, b = _squeezed(a), _squeezed(b)
    if a == b:
        return 1.0
    run = max(1, min(RUN, min(len(a), len(b)) // 4))
    if {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(b[i : i + run] for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(f: str, g: str) -> float:
    """Likeness of two fingerprints, 0 to 1; only signatures of the same block size are compared. Equal
    fingerprints: 1. An empty text is like empty texts only."""
    if f == g:
        return 1.0
    (k, *s), (m, *t) = f.split(":"), g.split(":")
    if not s[0] or not t[0]:
        return 0.0
    pairs = {0: ((s[0], t[0]), (s[1], t[1])), 1: ((s[0], t[1]),), -1: ((s[1], t[0]),)}.get(int(k) - int(m), ())
    return max((_likeness(a, b) for a, b in pairs), default=0.0)


def fingerprints(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in text.to_pylist()], pa.string())


def with_fingerprint(docs: DataFrame, out: str = "fingerprint") -> DataFrame:
    """Documents with the fingerprint of the whole text."""

    @arrow_udf("string")
    def f(text: pa.Array) -> pa.Array:
        return fingerprints(text)

    return docs.withColumn(out, f(c("text").cast("string")))


FIELDS = [
    ("doc_id", pa.int64()),
    ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()),
    ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()),
    ("near_next", pa.float64()),
]
COLUMNS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(doc: tuple[int | None, str | None], text: str | None, mine: str, after: str) -> tuple:
    """A result row: ``doc`` against the text that follows it."""
    own = doc[1] or ""
    half = len(own) // 2
    edited = own[: len(own) - half] + (text or "")[:half]
    changed = fingerprint(edited)
    return (doc[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), mine, changed, likeness(mine, changed), likeness(mine, after))


def _within(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Result rows of a sorted partition, and its first and its last document, which need their neighbours."""
    schema = pa.schema([*FIELDS, ("part", pa.int32()), ("side", pa.string()), ("text", pa.string())])
    part, before, mine = TaskContext.get().partitionId(), None, ""
    for batch in batches(rows):
        out = []
        for doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            after = fingerprint(doc[1])
            if before is None:
                out.append((doc[0], *[None] * 6, part, "first", doc[1]))
            else:
                out.append((*_compare(before, doc[1], mine, after), part, None, None))
            before, mine = doc, after
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
    if before is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (before[0], *[None] * 6, part, "last", before[1]), strict=True))], schema)


def _across(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(FIELDS)
    for batch in rows:
        out = [_compare((i, t), u, fingerprint(t), fingerprint(u)) for i, t, u in zip(*(x.to_pylist() for x in batch.columns), strict=True)]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document.

    The edited text has its last half replaced by the start of the next document's text. The next document is the
    one with the next higher doc_id; after the last comes the first. Null ids come first; rows with equal ids go by
    text, so copies follow one another. Null texts count as empty. An empty table gives no rows.

    Rows are sorted by ranges of doc_id, which moves the texts once. A range's pairs are computed while it
    streams by; the pairs that span two ranges, one per range, are joined afterwards from the first and last
    documents."""
    order = F.xxhash64("text")
    rows = docs.select(c("doc_id").cast("bigint"), c("text").cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id", order).sortWithinPartitions("doc_id", order, "text").select("doc_id", "text")
    done = cut_lineage(rows.mapInArrow(_within, f"{COLUMNS}, part int, side string, text string"))
    first, last = (done.filter(c("side") == x).select("doc_id", "part", "text") for x in ("first", "last"))
    turn = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(turn), F.first("part").over(turn))
    following = first.select("part", after.alias("after"))
    ends = last.join(following, "part").select("doc_id", "text", "after")
    ends = ends.join(first.select(c("part").alias("after"), c("text").alias("next")), "after").select("doc_id", "text", "next")
    inner = done.filter(c("side").isNull()).drop("part", "side", "text")
    return inner.unionByName(ends.mapInArrow(_across, COLUMNS))
