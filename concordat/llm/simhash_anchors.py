"""SimHash near duplicates by anchor-point covering: a code's words are the anchors that fingerprints are sent to."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from concordat.llm.common import pieces, separator_table, split_table, word_windows
from concordat.operators.graph import connected_components
from concordat.session import cut_lineage

c = F.col
BITS = 64
SEED = 42
MEET = 4096  # fingerprints that one is compared with, if they were spread evenly
BLOCK = 1024  # fingerprints on a side of a unit
DIMENSIONS = (7, 10, 13, 16, 19)
_SPACE = split_table(separator_table("space"))
POSTS = "anchor int, fp bigint, d tinyint, r tinyint, home boolean"


def shingle_hashes(text: str | None, k: int) -> Iterator[np.ndarray]:
    """XXH64 of the runs of ``k`` words, repeats included, in arrays for pieces of the text; of all words together if
    there are fewer than ``k``."""
    last: list[bytes] = []
    any_run = False
    for words in word_windows(text, _SPACE):
        words = last + words
        if len(words) >= k:
            any_run = True
            runs = map(b" ".join, zip(*(words[j:] for j in range(k)), strict=False))
            yield np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64)
        last = words[max(0, len(words) - k + 1) :]
    if last and not any_run:
        yield np.array([xxh64_intdigest(b" ".join(last), SEED)], np.uint64)


def fingerprint(text: str | None, k: int) -> int:
    """Bit j is set if it is set in over half of the shingles' hashes; 0 for a text without words."""
    ones, n = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text, k):
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def anchors(dim: int) -> np.ndarray:
    """The 2**dim words of a linear code of length 64: the affine functions on GF(64), then quadratic ones.

    Rows after the first seven are traces of multiples of x^9, x^3 and x^5, whose combinations are far from all affine
    functions, so that the words are spread evenly. Any set of words gives the same links, at another cost."""
    power = [1]
    while len(power) < 63:  # powers of a primitive element, x^6 = x + 1
        power.append((power[-1] << 1) ^ (67 if power[-1] & 32 else 0))
    log = {x: i for i, x in enumerate(power)}

    def trace(x: int) -> int:
        out = 0
        for i in range(6):
            out ^= power[log[x] * 2**i % 63] if x else 0
        return out

    points = range(BITS)
    rows = [sum(1 << p for p in points)] + [sum((p >> i & 1) << p for p in points) for i in range(6)]
    rows += [sum(trace(power[(log[p] * e + j) % 63] if p else 0) << p for p in points) for e in (9, 3, 5) for j in range(6)]
    reduced: list[int] = []
    words = np.zeros(1, np.uint64)
    for row in rows:
        rest = row
        for b in reduced:
            rest = min(rest, rest ^ b)
        if rest and len(reduced) < dim:
            reduced.append(rest)
            words = np.concatenate((words, words ^ np.uint64(row)))
    return words


def dimension(n: int, most: int) -> int:
    """The smallest code whose anchors hold at most ``MEET`` of ``n`` fingerprints, if those are spread evenly."""
    within = np.cumsum([comb(BITS, i) / 2.0**BITS for i in range(BITS + 1)])
    for dim in DIMENSIONS:
        nearest = int(np.searchsorted(within, 2.0**-dim))
        if n * within[min(BITS, nearest + most)] <= MEET:
            break
    return dim


def _posts(rows: Iterator[pa.RecordBatch], words: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Per fingerprint its nearest anchor (home) and all anchors within its distance to the code plus ``most``."""
    step = max(1, (1 << 20) // len(words))
    for batch in rows:
        fps = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(fps), step):
            part = fps[at : at + step]
            d = np.bitwise_count(part[:, None] ^ words[None, :])
            r, home = d.min(axis=1), d.argmin(axis=1)
            i, a = np.nonzero(d <= r[:, None] + most)
            columns = a.astype(np.int32), part[i].view(np.int64), d[i, a].astype(np.int8), r[i].astype(np.int8), home[i] == a
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["anchor", "fp", "d", "r", "home"])


def _edges(unit: pa.Table, most: int) -> pa.Table:
    """Edges that connect what is linked between the two sides of a unit: homes (0) and visitors (1) of an anchor.

    A pair at ``most`` or fewer differing bits has distances to the anchor that differ by no more. The pair of home
    and visitor is found where the home is nearer to the code, so that only visitors at least as far from it count. Units
    that share a group by chance only add true edges."""
    side, d, r = (unit[x].to_numpy() for x in ("side", "d", "r"))
    fp = unit["fp"].to_numpy().view(np.uint64)
    order = np.argsort(d, kind="stable")
    left, right = order[side[order] == 0], order[side[order] == 1]
    nodes, node = np.unique(fp, return_inverse=True)
    label, out = np.arange(len(nodes)), []
    for dist in np.unique(d[left]).tolist():
        mine = left[d[left] == dist]
        near = right[np.searchsorted(d[right], dist - most, "left") : np.searchsorted(d[right], dist + most, "right")]
        near = near[r[near] >= dist]
        for at in range(0, len(mine), 256):
            part = mine[at : at + 256]
            bits = np.bitwise_count(fp[part][:, None] ^ fp[near][None, :])
            hit = (bits <= most) & (bits > 0)
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                met = np.append(node[near[hit[i]]], node[part[i]])
                old = np.unique(label[met])
                label[met] = old[0]
                out.append(np.stack((old[1:], np.full(len(old) - 1, old[0]))))
    both = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    return pa.table({"a": nodes[both[0]].view(np.int64), "b": nodes[both[1]].view(np.int64)})


def links(fps: DataFrame, most: int = 3, dim: int | None = None) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) at ``most`` or fewer differing bits that connect all such
    pairs. Exact for any code.

    Every fingerprint x has a distance r(x) to the code and a nearest anchor, its home. Of a linked pair let x be the
    one with the smaller r: y is within r(x) + most <= r(y) + most of x's home. So a fingerprint is sent to all anchors
    within its own covering distance plus ``most``, and at each anchor homes are compared with all that came. The code
    grows with the number of fingerprints, which keeps what meets at an anchor in proportion. Anchors that many
    chose are cut into units of ``BLOCK`` homes by ``BLOCK`` visitors; a unit returns edges, never all its pairs."""
    spark = fps.sparkSession
    fps = fps.select("fp").distinct()
    words = spark.sparkContext.broadcast(anchors(dim or dimension(fps.count(), most)))  # 4 MB at most
    posts = cut_lineage(fps.mapInArrow(lambda rows: _posts(rows, words.value, most), POSTS))
    parts = posts.groupBy("anchor").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("homes"), F.ceil(F.count("*") / BLOCK).cast("int").alias("all"))
    parts = parts.filter("homes > 0")
    dealt = posts.join(parts, "anchor").withColumn("h", F.xxhash64("fp"))
    steps = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    homes = dealt.filter("home").select("anchor", F.pmod("h", "homes").cast("int").alias("i"), steps("all").alias("j"), F.lit(0).alias("side"), "fp", "d", "r")
    visitors = dealt.select("anchor", steps("homes").alias("i"), F.pmod("h", "all").cast("int").alias("j"), F.lit(1).alias("side"), "fp", "d", "r")
    # Dealt by a key of its own: the join has left the rows by anchor, which would keep all units of one in a task.
    units = homes.unionByName(visitors).withColumn("unit", F.xxhash64("anchor", "i", "j")).groupBy("unit")
    return units.applyInArrow(lambda table: _edges(table, most), "a bigint, b bigint")


def _fingerprints(rows: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        fps = [fingerprint(text, k) for run in pieces(batch.column(1)) for text in run]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())], names=["doc_id", "fp"])


def cluster(docs: DataFrame, k: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) per row of (doc_id, text): the 64-bit SimHash over ``k``-word shingles and the least
    doc_id reached over fingerprints that differ in ``most`` or fewer bits.

    Texts are read once, whole. Rows with one fingerprint are one node; only fingerprints go to anchors. Null and empty
    texts have fingerprint 0, which links like any other. Rows with one id are one document: all its
    fingerprints are reached from each other. Rows without an id get the component of their fingerprint, null if no
    row with an id is reached. Ids may be of any type that has an order. An empty table gives no rows; other columns
    are not read."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("fp", T.LongType())])
    rows = docs.select("doc_id", c("text").cast("string").alias("text"))
    marked = cut_lineage(rows.mapInArrow(lambda r: _fingerprints(r, k), schema))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    several = marked.filter(c("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("fp").alias("b"), F.max("fp").alias("a")).filter("a <> b")
    same = marked.select("doc_id", "fp").distinct().join(several.select("doc_id", "b"), "doc_id").select(c("fp").alias("a"), "b").filter("a <> b")
    component = connected_components(links(nodes, most).unionByName(same))
    named = nodes.join(component, c("fp") == c("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    classes = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = cut_lineage(named.join(classes, "label").select("fp", "component_id"))
    return marked.join(found, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint as 16 hexadecimal digits, component_id."""
    return cluster(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
