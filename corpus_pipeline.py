"""A corpus pipeline: language ID, near duplicates, decontamination, secrets, and a mix of the sources.

Every stage takes (spark, docs, sf_dir) and what the stage before kept; its result is written as Parquet and read
again. All stages but the last return the columns of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.llm import decontamination, language_id, mixing, ngram_jaccard, secret_scan
from concordat.session import arrow_rows, checkpoint_dir, cut_lineage
from concordat.sources.tables import load

# More than half of the letters, whatever the number of languages.
LEAST_SCORE = 0.6
ROWS = 500
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def few_at_a_time(stage: Stage) -> Stage:
    """A stage whose Python tasks, and the buffers that feed them, hold at most ``ROWS`` documents. What it keeps is
    written before it returns, as the size of a batch is settled when a plan runs."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with arrow_rows(spark, ROWS):
            return cut_lineage(stage(spark, docs, sf_dir))

    return run_stage


@few_at_a_time
def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told with a score of ``LEAST_SCORE`` or more. Rejected are texts without a
    letter (null ones too), those in scripts of no known language and those between languages. A missing lang is filled in."""
    model = language_id.train(docs)
    marked = language_id.annotate(docs, model, "__language")
    keep = (F.col("__language.lang") != language_id.UNKNOWN) & (F.col("__language.score") >= LEAST_SCORE)
    return marked.filter(keep).withColumn("lang", F.coalesce("lang", "__language.lang")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the least id of each group linked at a similarity of 0.8 over five-word shingles."""
    return ngram_jaccard.keep_one(docs, k=5, num=80, den=100)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents: one word in twenty or more is in a benchmark window."""
    return decontamination.decontaminate(docs, load(spark, sf_dir, "benchmark"))


@few_at_a_time
def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cover the secrets of every text; n_chars follows the text."""
    clean = secret_scan.redact(docs, secret_scan.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document the mix takes: doc_id, source, size, source_size, target, taken."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", secrets),
    ("mix", mix),
]

# Language ID and the field of the secret scan are trained models, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared checkpoint folder."""
    docs = load(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
