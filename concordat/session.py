"""Session defaults and lineage control."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


_written: list[str] = []
_by_rows = False


def get_session(app: str = "concordat", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session. Shuffle partitions are left to the cluster unless passed in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch folder in local mode only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
        shared = tempfile.mkdtemp(prefix="concordat-checkpoint-")
    sc.setCheckpointDir(shared)
    return shared


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared checkpoint folder and read them back.

    The result survives the loss of executors and keeps the plans of loops short. Against ``checkpoint()`` it
    computes the rows once instead of twice, and the reader knows the size of the table when it plans joins."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if _by_rows and _is_large(out) else out


def _is_large(table: DataFrame) -> bool:
    """Whether the rows of a written table, or its files, are larger than what Spark broadcasts."""
    most = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if most < 0:
        return False
    files = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return files > most or table.count() * table._jdf.schema().defaultSize() > most


@contextmanager
def sized_by_rows() -> Iterator[None]:
    """Tables that :func:`cut_lineage` writes inside are not broadcast if their rows are larger than Spark's limit.

    Spark holds the size of files against it, and of that the share of the columns read by their types. A file in which
    texts repeat is a hundredth of its rows, so tables of any length would go through the driver's memory."""
    global _by_rows
    before, _by_rows = _by_rows, True
    try:
        yield
    finally:
        _by_rows = before


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """What is run inside sends Python tasks at most ``most`` rows at a time, so that tasks on whole texts hold few of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_intermediates(spark: SparkSession) -> int:
    """Delete the tables that :func:`cut_lineage` has written in this process, and say how many. To be called when the
    results that rest on them are written: they are read until then."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    gone = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
