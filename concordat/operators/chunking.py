"""Greedy packing of ordered lines under a token budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20


def _runs(tokens: np.ndarray, budget: int, header: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for every line the line that opens the next chunk when a chunk opens here."""
    prefix = np.concatenate([[0], np.cumsum(tokens)])
    room = prefix[:-1] + max(budget - header, 0)
    nxt = np.searchsorted(prefix, room, side="right") - 1
    return prefix, np.maximum(nxt, np.arange(1, len(tokens) + 1))


def chunk_lines(lines: DataFrame, budget: int, header: int = 0, block: int = BLOCK) -> DataFrame:
    """Chunk number of each line (grp, pos, tokens); a line never splits and every chunk repeats the header.

    Packing is sequential, but what a stretch of lines does depends only on how full the open chunk is when it
    starts, and only through the line at which that chunk breaks. So a group is cut into blocks of at most
    ``block`` positions; each block is summarised for every possible first break, the summaries of a group are
    chained, and the blocks are numbered from their entry state. No task holds more than one block, or one small
    summary row per block."""
    if budget <= 0:
        return lines.withColumn("chunk", F.lit(0).cast("bigint"))
    cut = lines.select(
        F.col("grp").cast("string").alias("grp"), F.col("pos").cast("bigint").alias("pos"), F.col("tokens").cast("bigint").alias("tokens")
    ).withColumn("block", F.floor(F.col("pos") / block).cast("bigint"))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t = pdf["tokens"].to_numpy()
        n = len(t)
        prefix, nxt = _runs(t, budget, header)
        used, breaks = np.empty(n, np.int64), np.empty(n, np.int64)
        for i in range(n - 1, -1, -1):
            j = nxt[i]
            if j >= n:
                used[i], breaks[i] = header + prefix[n] - prefix[i], 0
            else:
                used[i], breaks[i] = used[j], breaks[j] + 1
        # A chunk that is open on entry breaks at a line whose prefix still fits in the budget.
        reach = int(np.searchsorted(prefix[:n], budget - header, side="right"))
        reach = max(1, min(n, reach))
        return pd.DataFrame(
            {
                "grp": [pdf["grp"].iloc[0]], "block": [pdf["block"].iloc[0]], "prefix": [prefix[1 : reach + 1].tolist()],
                "used": [used[:reach].tolist()], "breaks": [breaks[:reach].tolist()], "total": [int(prefix[n])],
            }
        )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, open_used, chunk = [], -1, 0
        for row in pdf.sort_values("block").itertuples():
            out.append((row.grp, row.block, open_used, chunk))
            if open_used < 0:
                open_used, chunk = int(row.used[0]), chunk + int(row.breaks[0])
                continue
            at = int(np.searchsorted(np.asarray(row.prefix), budget - open_used, side="right"))
            if at >= len(row.prefix):
                open_used += int(row.total)
            else:
                open_used, chunk = int(row.used[at]), chunk + int(row.breaks[at]) + 1
        return pd.DataFrame(out, columns=["grp", "block", "entry", "chunk"])

    def assign(pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t = pdf["tokens"].to_numpy()
        prefix, nxt = _runs(t, budget, header)
        entry, chunk = int(state["entry"].iloc[0]), int(state["chunk"].iloc[0])
        first = 0 if entry < 0 else int(np.searchsorted(prefix[1:], budget - entry, side="right"))
        starts = np.zeros(len(t), np.int64)
        i = first
        while i < len(t):
            starts[i] = 1
            i = int(nxt[i])
        number = np.cumsum(starts) + chunk - (1 if entry < 0 else 0)
        return pd.DataFrame({"grp": pdf["grp"], "pos": pdf["pos"], "tokens": t, "chunk": number})

    summary = cut.groupBy("grp", "block").applyInPandas(
        summarise, "grp string, block bigint, prefix array<bigint>, used array<bigint>, breaks array<bigint>, total bigint"
    )
    entries = summary.groupBy("grp").applyInPandas(chain, "grp string, block bigint, entry bigint, chunk bigint")
    return (
        cut.groupBy("grp", "block")
        .cogroup(entries.groupBy("grp", "block"))
        .applyInPandas(assign, "grp string, pos bigint, tokens bigint, chunk bigint")
    )
