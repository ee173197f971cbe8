"""The few expressions that differ between Spark SQL and DuckDB, so one fixture text serves both."""

from __future__ import annotations

import re


class SparkDialect:
    def __init__(self, sf_dir: str):
        self.sf_dir = sf_dir.rstrip("/")

    def t(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def rx(self, expr: str, pattern: str, repl: str) -> str:
        return f"regexp_replace({expr}, r'{pattern}', '{repl}')"

    def rxget(self, expr: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({expr}, r'{pattern}', {group})"

    def json(self, expr: str, key: str) -> str:
        return f"get_json_object({expr}, '$.{key}')"

    def plus_minutes(self, ts: str, n: str) -> str:
        return f"({ts} + make_dt_interval(0, 0, {n}, 0))"

    def plus_days(self, ts: str, n: str) -> str:
        return f"({ts} + make_dt_interval({n}, 0, 0, 0))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def split(self, expr: str, sep: str) -> str:
        return f"split({expr}, r'[{sep}]')"

    def at(self, arr: str, i: int) -> str:
        return f"try_element_at({arr}, {i})"

    def rawlist(self, expr: str) -> str:
        return expr


class DuckDialect:
    def t(self, name: str) -> str:
        return name

    def rx(self, expr: str, pattern: str, repl: str) -> str:
        return f"regexp_replace({expr}, '{pattern}', '{repl}', 'g')"

    def rxget(self, expr: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({expr}, '{pattern}', {group})"

    def json(self, expr: str, key: str) -> str:
        return f"json_extract_string({expr}, '$.{key}')"

    def plus_minutes(self, ts: str, n: str) -> str:
        return f"({ts} + to_minutes(CAST({n} AS BIGINT)))"

    def plus_days(self, ts: str, n: str) -> str:
        return f"({ts} + to_days(CAST({n} AS INTEGER)))"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def split(self, expr: str, sep: str) -> str:
        return f"string_split({expr}, '{sep}')"

    def at(self, arr: str, i: int) -> str:
        return f"({arr})[{i}]"


def pick(expr: str, items: list[str | None]) -> str:
    """A mark for "item number ``expr`` of this list"; :func:`expand_picks` writes it for a dialect."""
    return "⟦" + expr + "⟧⟪" + "§".join("NULL" if v is None else f"'{v}'" for v in items) + "⟫"


_PICK = re.compile("⟦([^⟦⟧]*)⟧⟪([^⟪⟫]*)⟫")


def expand_picks(sql: str, d) -> str:
    def one(m: re.Match) -> str:
        items = m.group(2).split("§")
        if isinstance(d, SparkDialect):
            return f"element_at(array({', '.join(items)}), CAST({m.group(1)} AS INT) + 1)"
        arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(items))
        return f"CASE {m.group(1)} {arms} END"

    return _PICK.sub(one, sql)


def struct(d, fields: dict[str, str]) -> str:
    """A struct literal in either dialect."""
    if isinstance(d, SparkDialect):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
    return "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields.items()) + ")"
