"""Ranked lexical search of a stated set of items over all documents, by dense blocked matrix products."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.llm.common import pieces, separator_table, split_table, word_windows
from concordat.session import cut_lineage

c = F.col
_TERMS = split_table(separator_table("alnum"))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
IMPACT = 1_000_000  # no impact is as large
EXACT = 1 << 53
TILE_ITEMS = 256
TILE_TERMS = 4096
TILE_DOCS = 256
CELLS = 1 << 20


@dataclass
class Tile:
    """Items from number ``first`` on over a vocabulary of their own: its terms, and their weights (terms by items)."""

    first: int
    columns: np.ndarray
    weights: np.ndarray


class Block:
    """The items that one pass over the documents ranks."""

    def __init__(self, terms: list[list[bytes]]):
        vocabulary = sorted({t for item in terms for t in item})
        self.index = {t: i for i, t in enumerate(vocabulary)}
        self.items = [np.unique(np.fromiter((self.index[t] for t in item), np.int64, len(item))) for item in terms]
        self.tiles: list[Tile] = []

    def weigh(self, weights: np.ndarray) -> None:
        """Tiles of items over their own vocabulary, in pieces of so few terms that sums of weight by impact stay below
        2**53. A tile ends at ``TILE_ITEMS`` items or ``CELLS`` cells, but has one item at least."""
        wide = max(1, min(TILE_TERMS, (EXACT - 1) // (IMPACT * max(1, int(weights.max(initial=1))))))
        at = 0
        while at < len(self.items):
            end, size = at + 1, len(self.items[at])
            while end < min(len(self.items), at + TILE_ITEMS) and (size + len(self.items[end])) * (end + 1 - at) <= CELLS:
                size += len(self.items[end])
                end += 1
            mine = self.items[at:end]
            compact = np.unique(np.concatenate(mine))
            for left in range(0, len(compact), wide):
                columns = compact[left : left + wide]
                m = np.zeros((len(columns), len(mine)))
                for j, item in enumerate(mine):
                    place = np.searchsorted(columns, item[(item >= columns[0]) & (item <= columns[-1])])
                    m[place, j] = weights[columns[place]]
                self.tiles.append(Tile(at, columns, m))
            at = end


def _counted(text: str | None, index: dict[bytes, int]) -> tuple[int, Counter]:
    """The number of terms of a whole text, and the counts of those in the vocabulary."""
    n, found = 0, Counter()
    for words in word_windows(text, _TERMS):
        n += len(words)
        found.update(map(index.get, words, repeat(-1)))
    found.pop(-1, None)
    return n, found


def _statistics(rows: Iterator[pa.RecordBatch], index: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(term, n): in how many documents a term is; -1: documents with a term; -2: all terms with repeats."""
    total: Counter = Counter()
    for batch in rows:
        for run in pieces(batch.column(0)):
            for text in run:
                n, found = _counted(text, index)
                total[-1] += n > 0
                total[-2] += n
                total.update(found.keys())
    yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])


def _tile_best(scores: np.ndarray, order: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best of each column above 0 and not below its ``floor``; equal scores by ``order``.

    Everything that ties with the k-th score is kept until the order has decided."""
    limit = np.maximum(floor, 1)
    if len(scores) > k:
        limit = np.maximum(limit, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
    row, column = np.nonzero(scores >= limit)
    sorted_ = np.lexsort((order[row], -scores[row, column], column))
    row, column = row[sorted_], column[sorted_]
    place = np.arange(len(column)) - np.searchsorted(column, column)
    return row[place < k], column[place < k]


def _rank(rows: Iterator[pa.RecordBatch], block: Block, docs: int, terms: int, k: int) -> Iterator[pa.RecordBatch]:
    """(item, doc_id, score): the ``k`` best documents of each item among the rows of a task."""
    best: list[list[tuple]] = [[] for _ in block.items]
    ids = None
    floor = np.zeros(len(block.items), np.int64)
    key = lambda x: (-x[0], x[1] is None, x[1])
    for batch in rows:
        names, at, ids = batch.column(0), 0, batch.schema.field(0).type
        place = np.empty(len(names), np.int64)
        place[pc.sort_indices(names, null_placement="at_end").to_numpy()] = np.arange(len(names))
        for run in pieces(batch.column(1)):
            for cut in range(0, len(run), TILE_DOCS):
                counted = [_counted(text, block.index) for text in run[cut : cut + TILE_DOCS]]
                row = np.repeat(np.arange(len(counted)), [len(f) for _, f in counted])
                term = np.fromiter((x for _, f in counted for x in f.keys()), np.int64, len(row))
                tf = np.fromiter((x for _, f in counted for x in f.values()), np.int64, len(row))
                m = np.array([10 + 90 * n * docs // max(1, terms) for n, _ in counted], np.int64)
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[row])
                scores: dict[int, np.ndarray] = {}
                for tile in block.tiles:
                    to = np.minimum(np.searchsorted(tile.columns, term), len(tile.columns) - 1)
                    here = tile.columns[to] == term
                    dense = np.zeros((len(counted), len(tile.columns)))
                    dense[row[here], to[here]] = impact[here]
                    part = (dense @ tile.weights).astype(np.int64)
                    scores[tile.first] = scores[tile.first] + part if tile.first in scores else part
                for first, s in scores.items():
                    order = place[at + cut : at + cut + len(counted)]
                    placed, column = _tile_best(s, order, k, floor[first : first + s.shape[1]])
                    for i, j in zip(placed.tolist(), column.tolist(), strict=True):
                        best[first + j].append((int(s[i, j]), names[at + cut + i].as_py()))
                    for j in np.unique(column).tolist():
                        mine = best[first + j] = sorted(best[first + j], key=key)[:k]
                        floor[first + j] = mine[-1][0] if len(mine) == k else 0
            at += len(run)
    if ids is None:
        return
    found = [(j, d, s) for j, mine in enumerate(best) for s, d in mine]
    yield pa.RecordBatch.from_arrays(
        [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], ids), pa.array([x[2] for x in found], pa.int64())], names=["item", "doc_id", "score"]
    )


def _deal(items: DataFrame, block_terms: int, block_items: int) -> tuple[DataFrame, int]:
    """Items and the block they are in, and the number of blocks."""
    size = F.regexp_count(F.coalesce(c("text"), F.lit("")), F.lit(TERM)).cast("bigint")
    numbered = cut_lineage(items.select("item_id", c("text").cast("string").alias("text")).withColumn("size", size))
    total = numbered.agg(F.sum("size"), F.count("*")).first()
    blocks = max(1, -(-int(total[0] or 0) // block_terms), -(-total[1] // block_items))
    return numbered.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))), blocks


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = 50_000, block_items: int = 2_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents (doc_id, text) of each item (item_id, text).

    Terms, weights, lengths and scores are those of the contract: integer scores, so that ranks are exact. A document's
    impacts and the items' weights are dense float64 tiles; a tile has so few terms that every partial sum is an
    integer below 2**53, and tiles are added as 64-bit integers. Each task keeps the best ``k`` per item of its rows
    with all ties decided by doc_id; the final ranking reads that many rows per task and item.

    Items are dealt to blocks of about ``block_terms`` terms and ``block_items`` items, each a pass over all documents
    for the counts and one for the ranking; only a block's items are on the driver and in the workers (a single
    longer item is a block of its own size). Texts are read whole and not shuffled. Null or empty texts have no terms
    and are in no result; neither are items without terms. Repeated rows are documents of their own; repeated
    items are ranked once, an item_id with several texts once for each. Null doc_ids rank after others of the same score. Other columns are
    not read."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", c("text").cast("string").alias("text"))
    dealt, blocks = _deal(items, block_terms, block_items)
    out = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    id_type = items.schema["item_id"].dataType
    done = None
    for b in range(blocks):
        mine = dealt.filter(c("block") == b).select("item_id", "text").distinct().collect()
        block = Block([[w for words in word_windows(r["text"], _TERMS) for w in words] for r in mine])
        shared = spark.sparkContext.broadcast(block.index)
        counts = rows.select("text").mapInArrow(lambda r, s=shared: _statistics(r, s.value), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
        n = {r["term"]: r["n"] for r in counts.collect()}
        held, terms = n.get(-1, 0), n.get(-2, 0)
        weights = np.array([np.floor(1000 * np.log((2 * held + 2) / (2 * n.get(i, 0) + 1))) for i in range(len(block.index))], np.int64)
        block.weigh(weights)
        tiles = spark.sparkContext.broadcast(block)
        ranked = rows.mapInArrow(lambda r, s=tiles, h=held, t=terms: _rank(r, s.value, h, t, k), out)
        names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(mine)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", id_type)]))
        part = _numbered(ranked, "item", k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        part = cut_lineage(part) if blocks > 1 else part
        done = part if done is None else done.unionByName(part)
    return done


def _numbered(ranked: DataFrame, by: str, k: int) -> DataFrame:
    order: list[Column] = [c("score").desc(), c("doc_id").asc_nulls_last()]
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(c("rank") <= k)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ten best documents."""
    return search(docs, items).select("item_id", "rank", "doc_id", "score")
