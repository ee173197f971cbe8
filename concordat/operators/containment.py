"""Exact substring joins without a nested loop and without pairs of texts."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
NEEDLES = 1_000_000  # characters of needles that one automaton holds
TEXTS = 8_000_000  # characters of texts that meet it in one task


def _order(rank) -> tuple:
    """Sort key of a rank as Spark has it: nulls first, structs field by field."""
    if isinstance(rank, dict):
        return tuple(_order(x) for x in rank.values())
    return rank is not None, rank


def _least(needles: pa.Table, texts: pa.Table, of_needles: bool) -> list[tuple]:
    """(needle, least rank of the texts that hold it), or (text, least rank of the needles that it holds)."""
    found = ahocorasick.Automaton()
    ranks = needles["rank"].to_pylist()
    words = needles["needle"].to_pylist()
    order = [_order(x) for x in ranks]
    for i, word in enumerate(words):
        found.add_word(word, i)
    found.make_automaton()
    best: dict[int, tuple] = {}
    out = []
    for text, rank in zip(texts["text"].to_pylist(), texts["rank"].to_pylist(), strict=True):
        held = {i for _, i in found.iter(text)}
        if of_needles:
            key = _order(rank)
            for i in held:
                if i not in best or key < best[i][0]:
                    best[i] = key, rank
        elif held:
            out.append((text, ranks[min(held, key=order.__getitem__)]))
    return out or [(words[i], rank) for i, (_, rank) in best.items()]


def _met(hay: DataFrame, needles: DataFrame, of_needles: bool) -> DataFrame:
    """(grp, item, first) of the needles, or of the texts, of each group that meet.

    A group's needles are cut into blocks of ``NEEDLES`` characters and its texts into parts of ``TEXTS``; each block
    meets each part once, in an automaton that finds all needles of the block in one pass over a text. Texts are
    moved once per block, whole; results are a row per needle, or text, and meeting, never pairs."""
    n = needles.filter(c("text") != "").groupBy("grp", c("text").alias("needle")).agg(F.min("rank").alias("rank"))
    h = hay.filter(c("text") != "").groupBy("grp", "text").agg(F.min("rank").alias("rank"))
    pieces = lambda of, most: F.ceil(F.sum(F.length(of).cast("bigint")) / most).cast("int")
    sizes = n.groupBy("grp").agg(pieces("needle", NEEDLES).alias("blocks")).join(h.groupBy("grp").agg(pieces("text", TEXTS).alias("parts")), "grp")
    each = lambda of: F.explode(F.sequence(F.lit(0), c(of) - 1))
    dealt = lambda of, into: F.pmod(F.xxhash64(of), c(into)).cast("int")
    left = n.join(sizes, "grp").select("grp", dealt("needle", "blocks").alias("block"), each("parts").alias("part"), "needle", "rank")
    right = h.join(sizes, "grp").select("grp", each("blocks").alias("block"), dealt("text", "parts").alias("part"), "text", "rank")
    ranked = (h if of_needles else n).schema["rank"].dataType
    schema = T.StructType([T.StructField("grp", h.schema["grp"].dataType), T.StructField("item", T.StringType()), T.StructField("rank", ranked)])

    def meet(ns: pa.Table, ts: pa.Table) -> pa.Table:
        met = _least(ns, ts, of_needles) if ns.num_rows and ts.num_rows else []
        some = ts if of_needles else ns
        grp = pa.array([ns["grp"][0].as_py()] * len(met) if met else [], ns.schema.field("grp").type)
        return pa.table({"grp": grp, "item": pa.array([x for x, _ in met], pa.string()), "rank": pa.array([r for _, r in met], some.schema.field("rank").type)})

    by = ["grp", "block", "part"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, schema)
    return found.groupBy("grp", "item").agg(F.min("rank").alias("first"))


def first_holder(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """(grp, needle, first): per distinct needle (grp, text) that some text (grp, text, rank) contains, the least rank
    of those texts. Empty and null texts and needles match nothing."""
    return _met(hay, needles.withColumn("rank", F.lit(0)), True).withColumnRenamed("item", "needle")


def first_held(hay: DataFrame, needles: DataFrame) -> DataFrame:
    """(grp, hay, first): per distinct text (grp, text) that contains some needle (grp, text, rank), the least rank of
    those needles. Empty and null texts and needles match nothing."""
    return _met(hay.withColumn("rank", F.lit(0)), needles, False).withColumnRenamed("item", "hay")
