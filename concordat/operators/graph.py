"""Reachability, connected components and set digests without collecting a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.ids import hash8
from concordat.session import cut_lineage

c = F.col


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def closure(starts: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Everything that ``step`` leads to from ``starts``, which are part of it. Each round writes what is new; eight
    rounds become one table, so that plans stay short."""
    new = cut_lineage(starts.distinct())
    found = [new]
    while not new.isEmpty():
        seen = union_all(found)
        new = cut_lineage(step(new).distinct().join(seen, seen.columns, "left_anti"))
        found.append(new)
        if len(found) > 8:
            found = [cut_lineage(union_all(found))]
    return union_all(found)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step on edges (a, b), a > b.

    Every node finds the least id in reach (an aggregate with partial combine) and hands it to its larger, or
    smaller, neighbours. Edges are rewired, never multiplied."""
    if large:
        both = edges.unionByName(edges.select(c("b").alias("a"), c("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        out = both.filter(c("b") > c("a")).join(least, "a").select(c("b").alias("a"), c("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(c("b").alias("a"), c("m").alias("b"))
        out = out.unionByName(least.select("a", c("m").alias("b")))
    return out.filter(c("a") != c("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node with an edge; the label is the least id of the component.

    Alternating large-star and small-star rounds need a number of rounds logarithmic in the size, not the
    diameter. Each round is written to the checkpoint folder; the loop stops when no edge changes."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(c("a") != c("b")).distinct()
    e = cut_lineage(e)
    mark = None
    while True:
        e = cut_lineage(_star(_star(e, True), False))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return e.select(c("a").alias("node"), c("b").alias("label")).unionByName(
        e.select(c("b").alias("node"), c("b").alias("label")).distinct()
    )


def digest_sums(rows: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Per key the number of distinct items (size) and two sums (x, y) of parts of their SHA-256. Sums of disjoint sets
    add up to those of their union."""
    part = lambda at: F.conv(F.substr(F.sha2(c(item), 256), F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")
    items = rows.select(*keys, item).distinct().select(*keys, part(1).alias("_x"), part(16).alias("_y"))
    return items.groupBy(*keys).agg(F.count("*").alias("size"), F.sum("_x").alias("x"), F.sum("_y").alias("y"))


def set_digest(rows: DataFrame, keys: list[str], item: str, out: str) -> DataFrame:
    """Eight-letter digest of the set of items per key, by one rule for sets of any size.

    The items' SHA-256 is cut in two numbers of 60 bits; the digest hashes the number of items and the two sums. Sums
    have no order and combine in the tasks, so no set is gathered."""
    sums = digest_sums(rows, keys, item)
    return sums.select(*keys, hash8(F.concat_ws(":", "size", c("x").cast("string"), c("y").cast("string"))).alias(out))
