"""Wiki pages and test sources: page trees, spec blocks, test basis, endpoint references."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.text import strip
from concordat.operators.graph import union_all
from concordat.operators.windows import first_k, numbered
from concordat.session import cut_lineage
from concordat.sources.markup import Lines

c = F.col

# Source files that are scanned for endpoint references.
TEST_SUFFIXES = ["java", "kt", "groovy", "feature"]
SKIPPED_DIRS = ["target", "build", "out", "bin", ".git", "node_modules", ".idea"]


def page_tree(edges: DataFrame, roots: DataFrame, max_pages: int | None = None) -> DataFrame:
    """Pages below each root, breadth first, each page once; ``max_pages`` keeps that many per root (the root counts).

    ``edges``: parent, child, pos; ``roots``: root. With a limit, a level keeps at most so many rows per root,
    since later ones can never be delivered."""
    level = cut_lineage(
        roots.select("root", c("root").alias("page"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path")).distinct()
    )
    levels = [level]
    while True:
        seen = union_all(levels)
        nxt = level.join(edges, level["page"] == edges["parent"]).select(
            "root", c("child").alias("page"), (c("depth") + 1).alias("depth"), F.array_append("path", c("pos").cast("int")).alias("path")
        )
        nxt = nxt.groupBy("root", "page", "depth").agg(F.min("path").alias("path")).join(seen.select("root", "page"), ["root", "page"], "left_anti")
        if max_pages:
            full = seen.groupBy("root").agg(F.count("*").alias("n")).filter(c("n") >= max_pages).select("root")
            nxt = first_k(nxt.join(full, "root", "left_anti"), ["root"], [F.asc("path")], max_pages)
        level = cut_lineage(nxt)
        if level.isEmpty():
            break
        levels.append(level)
        if len(levels) > 8:
            levels = [cut_lineage(union_all(levels[:-1])), level]
    seen = union_all(levels)
    if max_pages:
        return first_k(seen, ["root"], [F.asc("depth"), F.asc("path")], max_pages, "ord")
    # Numbered level by level: no window reads all pages of a root.
    return numbered(seen, "root", ["depth", "path"], c("depth"), "ord").withColumn("ord", c("ord").cast("int"))


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """Test sources under a folder as (path, text)."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.input_file_name()
    skip = "/(" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")/"
    out = df.select(name.alias("path"), c("value").alias("text"))
    return out.filter(c("path").rlike(r"\.(" + "|".join(TEST_SUFFIXES) + ")$") & ~c("path").rlike(skip))


def test_inventory(files: DataFrame) -> DataFrame:
    """Quoted paths with the verb on the same line or one of the two above: (path, file, line, method).
    Works inside the row of each file; nothing is shuffled."""
    lines = F.split("text", "\n")
    verbs = F.transform("lines", lambda x: F.nullif(F.upper(F.regexp_extract(x, r"(?i)\b(get|post|put|patch|delete)\b", 1)), F.lit("")))
    f = files.select(c("path").alias("file"), lines.alias("lines")).withColumn("verbs", verbs)

    def verb_at(i: Column) -> Column:
        return F.coalesce(F.get("verbs", i), F.when(i >= 1, F.get("verbs", i - 1)), F.when(i >= 2, F.get("verbs", i - 2)))

    found = F.transform(
        "lines", lambda x, i: F.struct(i.alias("line"), F.regexp_extract_all(x, F.lit(r"""["'](/[A-Za-z0-9_./{}\-]*)["']"""), F.lit(1)).alias("paths"), verb_at(i).alias("method"))
    )
    hits = f.select("file", F.explode(F.filter(found, lambda s: F.size(s["paths"]) > 0)).alias("h"))
    refs = hits.select("file", c("h.line").alias("line"), c("h.method").alias("method"), F.explode("h.paths").alias("path"))
    last = F.substring_index("path", "/", -1)
    keep = (F.length("path") >= 2) & ~c("path").contains("..") & ~last.rlike(r"^.*\.[A-Za-z0-9]{1,6}$") & c("path").rlike("[A-Za-z]")
    return refs.filter(keep)


def best_spec_block(pages: DataFrame) -> DataFrame:
    """The code block of each page that looks most like an API document; the longest wins a tie."""
    tags = ["ac:plain-text-body", "pre", "code"]

    def texts(tag: str) -> Column:
        inner = F.regexp_extract_all("html", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
        bare = F.transform(inner, lambda x: F.regexp_replace(F.regexp_replace(x, r"<!\[CDATA\[|\]\]>", ""), r"(?s)<(\w[\w:-]*)[^>]*>.*?</\1>", ""))
        return F.coalesce(bare, F.array().cast("array<string>"))

    def score(b: Column) -> Column:
        low = F.lower(b)
        n = F.lit(0)
        for word, points in (("openapi", 3), ("swagger", 2), ("paths:", 2), ('"paths"', 2)):
            n = n + F.when(low.contains(word), points).otherwise(0)
        return n

    blocks = F.filter(F.concat(*[texts(t) for t in tags]), lambda b: ~b.rlike(r"^\s*$"))
    ranked = F.transform("blocks", lambda b, i: F.struct(score(b).alias("s"), F.length(b).alias("n"), (-i).alias("i"), b.alias("b")))
    best = F.array_max(ranked)
    out = pages.withColumn("blocks", blocks).filter(F.size("blocks") > 0)
    return out.select("page_id", best["s"].alias("score"), F.concat(strip(best["b"]), F.lit("\n")).alias("block"))


def test_basis(docs: DataFrame) -> DataFrame:
    """Test-basis items (id, source, kind, text) of markdown documents (id, markdown).

    Only lines that are headings or items are kept before the per-document window."""
    rows = docs.select(c("id").alias("source"), F.posexplode(F.split("markdown", "\n")).alias("pos", "raw"))
    rows = rows.select("source", "pos", strip(c("raw")).alias("line")).filter(c("line") != "")
    heading = c("line").startswith("#")
    table = c("line").startswith("|")
    bar = table & c("line").rlike(r"^\|[\s|:\-]+\|?$")
    bullet = c("line").startswith("- ") | c("line").rlike(r"^\d+\.\s.*$")
    gwt = c("line").rlike(r"(?i)^(given|when|then|and|but)\b.*")

    def modal(t: Column) -> Column:
        padded = F.concat(F.lit(" "), F.lower(t), F.lit(" "))
        return padded.contains(" must ") | padded.contains(" shall ") | padded.contains(" should ")

    cells = F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace("line", r"^\|", ""), r"\|$", "")), r"\s*\|\s*", " — ")
    item_text = F.trim(F.regexp_replace("line", r"^(-\s|\d+\.\s)", ""))
    head = F.regexp_replace("line", r"^#+\s*", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(head), "[^a-z0-9]+", "-"), "(^-|-$)", "")
    slug = F.when(slug == "", "sec").otherwise(slug)
    shape = (
        F.when(heading, "HEADING").when(bar, F.lit(None)).when(table, "TABLE").when(bullet, "BULLET").when(gwt, "GWT").when(modal(c("line")), "MODAL")
    )
    rows = rows.withColumn("shape", shape).filter(c("shape").isNotNull())
    rows = rows.withColumns(
        {"head": F.when(heading, slug), "ac": F.when(heading, F.lower(head).contains("acceptance")), "item": c("shape") != "HEADING"}
    )
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns(
        {
            "section": F.coalesce(F.last("head", True).over(w), F.lit("general")),
            "in_ac": F.coalesce(F.last("ac", True).over(w), F.lit(False)),
            "n": F.sum(F.when(c("item"), 1).otherwise(0)).over(w),
        }
    ).filter("item")
    text = F.when(c("shape") == "TABLE", cells).when(c("shape") == "BULLET", item_text).otherwise(c("line"))
    kind = (
        F.when(c("shape") == "GWT", "ACCEPTANCE_CRITERIA")
        .when(c("shape") != "BULLET", "BUSINESS_RULE")
        .when(c("in_ac"), "ACCEPTANCE_CRITERIA")
        .when(modal(item_text), "BUSINESS_RULE")
        .otherwise("REQUIREMENT")
    )
    ident = F.concat("source", F.lit("#"), "section", F.lit("-"), c("n").cast("string"))
    return rows.select(ident.alias("id"), "source", kind.alias("kind"), text.alias("text"))


def pages_to_lines(pages: DataFrame) -> DataFrame:
    """Page markup (page_id, html) to lines (page_id, pos, kind, text): headings, list items, paragraphs, table
    rows, quotations and code, in document order, with inline emphasis, code and links kept. Every page is read in one
    pass inside its row, nested as it is; a null page has no lines."""
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), *T._parse_datatype_string("pos int, kind string, text string")])

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = [Lines(x).lines if x else [] for x in part.column(1).to_pylist()]
                ids = part.column(0).take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int32()))
                columns = [pa.array([k for x in found for k in range(len(x))], pa.int32()), *(pa.array([y[k] for x in found for y in x], pa.string()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["page_id", "pos", "kind", "text"])

    return pages.select("page_id", c("html").cast("string")).mapInArrow(read, schema)
