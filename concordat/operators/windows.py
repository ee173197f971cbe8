"""Order-based operators that stay bounded when one key holds a large share of the rows.

``row_number() <= k`` filters are rewritten by the optimiser into a per-task limit before the
shuffle, so picking the first rows of a hot key moves only k rows per task. Row numbers and
previous-row lookups over *all* rows of a key are cut into chunks of the order column: work inside a
chunk runs in its own window partition, and only one summary row per (key, chunk) is combined per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_k(df: DataFrame, keys: list[str | Column], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key in the given order."""
    name = rank or "_rn"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest(df: DataFrame, keys: list[str | Column], ts: str, tie: str) -> DataFrame:
    """The newest row per key; equal times go to the larger tie-breaker."""
    return first_k(df, keys, [F.desc_nulls_last(ts), F.desc(tie)])


def dedup_first(df: DataFrame, key: str, row_id: str, order: list[Column]) -> DataFrame:
    """First row per key in the given order; rows without a key never collapse."""
    group = F.coalesce(F.col(key), F.concat(F.lit("\u0001"), F.col(row_id)))
    return first_k(df.withColumn("_g", group), ["_g"], order).drop("_g")


def numbered(df: DataFrame, key: str, order: list[str], chunk: Column, out: str) -> DataFrame:
    """1-based position per key by ``order``; ``chunk`` must be monotone in the first order column."""
    cut = df.withColumn("_c", chunk)
    inside = F.row_number().over(Window.partitionBy(key, "_c").orderBy(*order))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut.groupBy(key, "_c").agg(F.count("*").alias("_n")).withColumn("_off", F.coalesce(before, F.lit(0)))
    offsets = offsets.select(F.col(key).alias("_k"), F.col("_c").alias("_oc"), "_off")
    return (
        cut.withColumn("_in", inside)
        .join(offsets, F.col(key).eqNullSafe(F.col("_k")) & F.col("_c").eqNullSafe(F.col("_oc")))
        .withColumn(out, (F.col("_in") + F.col("_off")).cast("bigint"))
        .drop("_k", "_oc", "_off", "_c", "_in")
    )


def with_previous(df: DataFrame, key: str, order: list[str], chunk: Column, cols: list[str], prefix: str = "prev_") -> DataFrame:
    """Values of the previous row of the key, by ``order``; ``chunk`` as in :func:`numbered`."""
    cut = df.withColumn("_c", chunk)
    w = Window.partitionBy(key, "_c").orderBy(*order)
    carried = F.struct(*[F.col(c) for c in cols])
    inside = cut.withColumn("_p", F.lag(carried).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    lasts = cut.groupBy(key, "_c").agg(F.max_by(carried, F.struct(*order)).alias("_last"))
    edge = lasts.withColumn("_edge", F.lag("_last").over(Window.partitionBy(key).orderBy("_c"))).select(
        F.col(key).alias("_k"), F.col("_c").alias("_ec"), "_edge"
    )
    joined = inside.join(edge, F.col(key).eqNullSafe(F.col("_k")) & F.col("_c").eqNullSafe(F.col("_ec")))
    prev = F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_p"))
    out = joined.withColumn("_prev", prev).withColumns({prefix + c: F.col("_prev")[c] for c in cols})
    out = out.withColumn(prefix + "exists", F.col("_prev").isNotNull())
    return out.drop("_c", "_p", "_first", "_k", "_ec", "_edge", "_prev")


def exact_median(df: DataFrame, value: str, width: float, out: str = "median") -> DataFrame:
    """One row with the exact median of ``value``.

    A histogram of fixed width finds the bucket of the middle ranks, and a finer one inside that bucket the small
    part that is counted by value. Every step aggregates before it shuffles, so no task sees the whole column.
    """
    vals = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    vals = vals.withColumn("b", F.floor(F.col("v") / width))
    hist = vals.groupBy("b").agg(F.count("*").alias("n"))
    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hist = hist.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(everything))
    lo, hi = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    before = F.col("upto") - F.col("n")
    middle = hist.filter((before < hi) & (F.col("upto") >= lo)).select("b", before.alias("before"), "total")
    part = F.floor((F.col("v") / width - F.col("b")) * 4096)
    vals = vals.join(middle, "b").withColumn("part", part)
    run = Window.partitionBy("b").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = vals.groupBy("b", "part", "before", "total").agg(F.count("*").alias("n")).withColumn("upto", F.col("before") + F.sum("n").over(run))
    fine = fine.filter((before < hi) & (F.col("upto") >= lo)).select("b", "part", before.alias("before"))
    exact = vals.drop("before").join(fine, ["b", "part"]).groupBy("b", "part", "before", "total", "v").agg(F.count("*").alias("m"))
    in_bucket = Window.partitionBy("b", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    exact = exact.withColumn("end", F.col("before") + F.sum("m").over(in_bucket)).withColumn("start", F.col("end") - F.col("m"))
    hit = exact.filter((F.col("start") < hi) & (F.col("end") >= lo))
    # At most two values carry the middle ranks.
    return hit.agg(((F.min("v") + F.max("v")) / 2).alias(out))
