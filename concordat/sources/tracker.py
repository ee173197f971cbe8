"""Tracker exports: paged issue JSON and rich-text trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.rules import lifecycle
from concordat.sources.markup import adf_lines

c = F.col

_NAMED = "struct<name:string>"
ISSUE_PAGE = (
    "total bigint, issues array<struct<key:string,fields:struct<summary:string,description:string,"
    f"status:struct<name:string,statusCategory:struct<key:string>>,resolution:{_NAMED},priority:{_NAMED},"
    f"labels:array<string>,components:array<{_NAMED}>,"
    "issuelinks:array<struct<outwardIssue:struct<key:string>,inwardIssue:struct<key:string>>>>>>"
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page files of an export folder, one JSON document per file, numbered by file name."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    name = F.regexp_extract(F.input_file_name(), r"([0-9]+)\.json$", 1)
    return df.select(name.cast("int").alias("page"), c("value").alias("json"))


def issues(pages: DataFrame, cap: int = 0) -> DataFrame:
    """Issue rows of paged exports (page, json), in page order; a positive cap keeps the first ones."""
    parsed = pages.select("page", F.from_json("json", ISSUE_PAGE).alias("p"))
    rows = parsed.select("page", F.posexplode("p.issues").alias("pos", "i"))

    def named(col_: str):
        return F.nullif(F.trim(c(col_)), F.lit(""))

    f = "i.fields."
    out = rows.select(
        c("i.key").alias("key"), "page", "pos", c(f + "summary").alias("summary"), c(f + "description").alias("description"),
        c(f + "status.statusCategory.key").alias("status_category"), c(f + "resolution.name").alias("resolution"),
        lifecycle(c(f + "resolution.name"), c(f + "status.statusCategory.key")).alias("lifecycle"),
        named(f + "priority.name").alias("priority"),
        F.filter(F.transform(c(f + "labels"), lambda x: F.trim(x)), lambda x: x != "").alias("labels"),
        F.filter(F.transform(c(f + "components"), lambda x: F.trim(x["name"])), lambda x: x != "").alias("components"),
        F.array_compact(
            F.transform(c(f + "issuelinks"), lambda x: F.nullif(F.coalesce(x["outwardIssue"]["key"], x["inwardIssue"]["key"]), F.lit("")))
        ).alias("links"),
    )
    return out.orderBy("page", "pos").limit(cap) if cap > 0 else out


def adf_to_lines(docs: DataFrame) -> DataFrame:
    """Rich-text trees (key, adf as JSON text) to lines (key, ord, kind, text). Every tree is walked once inside its
    row; ``ord`` is the place of a line. A tree that cannot be read has no lines."""

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [adf_lines(x) for x in part.column(1).to_pylist()]
                keys = part.column(0).take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int32()))
                columns = [pa.array([k for x in found for k in range(len(x))], pa.int32()), *(pa.array([y[k] for x in found for y in x], pa.string()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", "ord", "kind", "text"])

    return docs.select(c("key").cast("string"), c("adf").cast("string")).mapInArrow(read, "key string, ord int, kind string, text string")
