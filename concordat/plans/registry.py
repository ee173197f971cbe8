"""Registry of queries and their DuckDB twins."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from concordat.plans.dialect import DuckDialect, SparkDialect, expand_picks
from concordat.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FIXTURES: dict[str, Callable] = {}


def fixture(fn: Callable) -> Callable:
    """Register a derived table: a function of a dialect that returns SQL text."""
    FIXTURES[fn.__name__] = fn
    return fn


def with_fixtures(body: str, dialect) -> str:
    """Prefix ``body`` with the CTEs of every ``fx_*`` name it uses, dependencies first."""
    ordered: list[tuple[str, str]] = []
    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bfx_(\w+)\b", text)):
            if name not in seen:
                seen.add(name)
                sql = expand_picks(FIXTURES[name](dialect), dialect)
                visit(sql)
                ordered.append((name, sql))

    visit(body)
    if not ordered:
        return body
    ctes = ",\n".join(f"fx_{name} AS ({sql})" for name, sql in ordered)
    stripped = body.lstrip()
    if re.match(r"(?i)with\s+recursive\b", stripped):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'(?i)^with\s+recursive', '', stripped, count=1)}"
    if re.match(r"(?i)with\b", stripped):
        return f"WITH {ctes},\n{re.sub(r'(?i)^with', '', stripped, count=1)}"
    return f"WITH {ctes}\n{body}"


@dataclass
class Ctx:
    """What a query sees: the session, the data folder, tables and derived tables."""

    spark: SparkSession
    sf_dir: str
    _cache: dict[str, DataFrame] = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    def fx(self, name: str) -> DataFrame:
        if name not in self._cache:
            sql = with_fixtures(f"SELECT * FROM fx_{name}", SparkDialect(self.sf_dir))
            self._cache[name] = self.spark.sql(sql)
        return self._cache[name]


def query(name: str, oracle: str | None = None) -> Callable:
    """Register ``fn(ctx) -> DataFrame`` under ``name`` with its DuckDB text."""

    def wrap(fn: Callable[[Ctx], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Instants are UTC throughout the data model.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Ctx(spark, sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return wrap


def oracle_texts() -> dict[str, str]:
    """Self-contained DuckDB text per query."""
    return {name: with_fixtures(body, DuckDialect()) for name, body in ORACLES.items()}
