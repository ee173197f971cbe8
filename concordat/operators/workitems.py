"""Work-item histories: status transitions and reviewer suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.windows import first_k, with_previous

# Allowed moves of a test case.
TRANSITIONS = [
    ("PROPOSED", "APPROVED"), ("PROPOSED", "REJECTED"),
    ("APPROVED", "REJECTED"), ("APPROVED", "CREATED_IN_XRAY"), ("APPROVED", "ATTACHED"), ("APPROVED", "IMPLEMENTED"),
    ("REJECTED", "PROPOSED"), ("REJECTED", "APPROVED"),
    ("CREATED_IN_XRAY", "ATTACHED"), ("CREATED_IN_XRAY", "IMPLEMENTED"),
    ("ATTACHED", "IMPLEMENTED"),
]


def illegal_transitions(log: DataFrame) -> DataFrame:
    """Moves not in the table. Staying put is allowed; no status counts as PROPOSED.
    The log is cut by day, so one busy item does not end up in one task."""
    status = F.upper(F.coalesce("status", F.lit("PROPOSED")))
    steps = log.select("case_id", "event_id", "ts", status.alias("to_status"))
    steps = with_previous(steps, "case_id", ["ts", "event_id"], F.to_date("ts"), ["to_status"])
    moves = steps.select(
        "case_id", "event_id", F.coalesce("prev_to_status", F.lit("PROPOSED")).alias("from_status"), "to_status"
    ).filter(F.col("from_status") != F.col("to_status"))
    allowed = log.sparkSession.createDataFrame(TRANSITIONS, "from_status string, to_status string")
    return moves.join(F.broadcast(allowed), ["from_status", "to_status"], "left_anti")


def reviewers(commits: DataFrame, n: int, bot: str, default: str, history: int = 40) -> DataFrame:
    """First ``n`` distinct contributors among the newest commits of each file; a default if there is none."""
    recent = first_k(commits, ["file"], [F.desc("committed_at"), F.desc("seq"), F.asc("commit_id")], history, "age")
    email, name = F.col("email"), F.trim(F.col("name"))
    user = (
        F.when(F.lower(email).contains(bot), F.lit(None))
        .when(email.contains("@"), F.substring_index(email, "@", 1))
        .when((name == "") | name.contains(" "), F.lit(None))
        .otherwise(name)
    )
    people = recent.withColumn("user", user).filter(F.col("user").isNotNull()).groupBy("file", "user").agg(F.min("age").alias("age"))
    # At most ``history`` people per file are left here.
    place = F.row_number().over(Window.partitionBy("file").orderBy("age"))
    top = people.withColumn("place", place).filter(F.col("place") <= n).select("file", "user", "place")
    files = commits.select("file").distinct()
    return files.join(top, "file", "left").select(
        "file", F.coalesce("user", F.lit(default)).alias("reviewer"), F.coalesce("place", F.lit(1)).cast("bigint").alias("place")
    )
