"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.session import cut_lineage

c = F.col
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weight: Column, share: float, most: float) -> DataFrame:
    """Words to take per source, added as ``target`` to rows (key, size), one per source of the mix.

    ``share`` times all sizes are dealt by weight; no target is above ``most`` times its source's size, and what is
    left over goes to the others by weight until none is above. The level at which that ends is found in one
    pass: with the sources by the level at which they fill up, the level is what the full ones leave over
    the weights of the rest. The table holds one row per source of the mix, as many as there are weights."""
    w = Window.orderBy("_fill", "key").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        sources.withColumn("_w", weight)
        .withColumn("_cap", most * c("size"))
        .withColumn("_fill", c("_cap") / c("_w"))
        .withColumn("_left", share * F.sum("size").over(everything) - F.coalesce(F.sum("_cap").over(w), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(w), F.lit(0)))
        .withColumn("_level", c("_left") / c("_rest"))
    )
    level = F.max("_level").over(everything)
    target = F.when(c("_fill") <= level, c("_cap")).otherwise(level * c("_w"))
    return rows.withColumn("target", target.cast("double")).select("key", "size", "target")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
    buckets: int = BUCKETS,
) -> DataFrame:
    """A mix of (doc_id, text, source): one row per document with doc_id, source, size, source_size, target and
    taken, the words that the mix takes of it.

    Sources by code point, null last, get ``weights`` in turn. Every document has a random key, the MD5 of seed
    and doc_id. Within a source, documents in key order are taken once more for every whole size that the
    target holds, and the last round ends exactly at the source's budget: its last document gives only its
    first words. So the words taken of a source are its target, rounded, and a rerun takes the same.

    Keys are dealt to ``buckets`` equal ranges, sorted within each range, and the sum before a document is the
    sum of the ranges before it plus the sum before it in its range: a source with a third of all rows has as
    many tasks as ranges. The texts are read once and never shuffled.

    Null text or doc_id: size 0, the key of an empty id. Repeated rows are documents of their own. Rows with equal
    keys go by size. An empty table gives no rows; other columns are not read."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c("doc_id").cast("string"), F.lit(""))))
    source = F.when(c("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c("source")))
    rows = docs.select(
        "doc_id",
        source.alias("key"),
        n_words(c("text")).alias("size"),
        key.alias("_at"),
    )
    bucket = F.conv(F.substring("_at", 1, 8), 16, 10).cast("bigint") * buckets / F.lit(2**32)
    rows = cut_lineage(rows.withColumn("_bucket", F.floor(bucket).cast("int")))
    ranges = rows.groupBy("key", "_bucket").agg(F.sum("size").alias("_sum"))
    sources = ranges.groupBy("key").agg(F.sum("_sum").alias("size"))
    turn = F.row_number().over(Window.orderBy("key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    dealt = targets(sources, weight, share, most).withColumnRenamed("size", "source_size")
    before = Window.partitionBy("key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.join(dealt, "key").withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("key", "_bucket").orderBy("_at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.round("target").cast("bigint")
    rounds = F.when(c("source_size") > 0, F.floor(budget / c("source_size"))).otherwise(F.lit(0)).cast("bigint")
    rest = budget - rounds * c("source_size") - c("_before") - c("_inside")
    taken = rounds * c("size") + F.greatest(F.lit(0), F.least(c("size"), rest))
    return summed.join(ranges, ["key", "_bucket"]).select(
        "doc_id",
        F.when(c("key").startswith("0"), F.expr("substring(key, 2)")).alias("source"),
        "size",
        "source_size",
        "target",
        taken.cast("bigint").alias("taken"),
    )
