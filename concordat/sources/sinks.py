"""Sinks: scorecard CSV, traceability tables, idempotent finding appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_scorecard(df: DataFrame, path: str) -> None:
    """CSV with header and doubled quotes."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def write_rtm(items: DataFrame, path: str, tasks: int = 4) -> None:
    """Requirements-traceability matrix, one folder per plan; rewriting replaces the plans at hand only.
    Rows of a plan go to ``tasks`` tasks by a salt, so that a large plan is not written by one task and a plan has no more
    files than that."""
    salt = F.pmod(F.xxhash64(*[c for c, t in items.dtypes if not t.startswith("map")]), F.lit(tasks))
    items.repartition("plan_id", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("plan_id").parquet(path)


def append_findings(df: DataFrame, path: str, batch: int | str) -> None:
    """Append the findings of one batch of scans under its own folder. Writing a batch again replaces it, so a
    retry or a replayed micro-batch adds nothing."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
