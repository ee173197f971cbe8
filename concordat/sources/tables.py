"""Typed parquet reads. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from concordat.schemas import DOMAIN_TABLES, SOURCE_TABLES


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder, with its declared schema."""
    schema = SOURCE_TABLES.get(table) or DOMAIN_TABLES[table]
    return spark.read.schema(schema).parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")
