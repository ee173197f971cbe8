"""Helpers that several operators share: word hashing over bytes and whole-text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_MUL = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.empty(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of an odd base modulo 2**64, grown to the longest word seen."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 64), 0x100000001B3, np.uint64)
        p[0] = 1
        _POWERS = np.cumprod(p, dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spread every input bit over all output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of many texts at once. ``hash``: 64-bit hash per word; ``starts``/``ends``: byte offsets in
    ``buf``; ``first``: index of each text's first word, with a last entry for the number of words."""

    def __init__(self, texts: list[bytes], separators: np.ndarray):
        """``texts`` are folded already; ``separators`` says per byte value whether it splits words."""
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"\x20".join(texts) + b"\x20", np.uint8)
        inside = ~separators[self.buf]
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
        self.starts, self.ends = edge[::2], edge[1::2]
        begins = np.concatenate(([0], np.cumsum(sizes + 1)))
        self.first = np.searchsorted(self.starts, begins)
        lens = self.ends - self.starts
        if not len(lens):
            self.hash = np.empty(0, np.uint64)
            return
        at = np.cumsum(lens) - lens
        pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
        value = (self.buf[inside].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()) + 1)[pos]
        self.hash = mix(np.add.reduceat(value, at) + lens.astype(np.uint64) * _MUL)


def separator_table(keep: str) -> np.ndarray:
    """Per byte value: splits words. ``keep`` "space": only white space splits; "alnum": every ASCII byte but
    digits and small letters does. Bytes of non-ASCII letters never do."""
    t = np.zeros(256, bool)
    if keep == "space":
        t[[0x20, *range(0x09, 0x0E)]] = True
    else:
        t[:0x80] = True
        t[0x30:0x3A] = False
        t[0x61:0x7B] = False
    return t


LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased; empty for null. Lone surrogates cannot occur in Spark strings."""
    return text.encode().translate(LOWER) if text else b""


def pieces(column: pa.Array, budget: int = 500_000) -> Iterator[list[str | None]]:
    """Runs of whole values of about ``budget`` characters, so that memory follows the longest text and not the
    batch."""
    run: list[str | None] = []
    size = 0
    for at in range(0, len(column), 128):
        for text in column.slice(at, 128).to_pylist():
            run.append(text)
            size += len(text) if text else 0
            if size >= budget:
                yield run
                run, size = [], 0
    if run:
        yield run


def batches(rows: Iterator[pa.RecordBatch], most: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``most`` rows, without copying."""
    for batch in rows:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def split_table(separators: np.ndarray) -> bytes:
    """A translation of UTF-8 bytes: A-Z lower-cased, bytes that split words become spaces."""
    return bytes(0x20 if separators[b] else b for b in LOWER)


def word_windows(text: str | None, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """All words of a text as lists for pieces of about ``size`` bytes, so that a long text's words are not held at once."""
    raw = text.encode().translate(table) if text else b""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + size)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end
