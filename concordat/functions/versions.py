"""Dotted version comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segments(v: Column) -> Column:
    """Segments before the first dash; trailing empty segments do not count."""
    head = F.regexp_replace(F.substring_index(F.trim(F.coalesce(v, F.lit(""))), "-", 1), r"\.+$", "")
    return F.when(head == "", F.array(F.lit("0"))).otherwise(F.split(head, r"\."))


def version_cmp(a: Column, b: Column) -> Column:
    """-1, 0 or 1. Segments compare as numbers when both are numbers, else as text; missing ones are 0."""

    def step(x: Column, y: Column) -> Column:
        x, y = F.coalesce(x, F.lit("0")), F.coalesce(y, F.lit("0"))
        numeric = x.rlike(r"^[+]?[0-9]+$") & y.rlike(r"^[+]?[0-9]+$")
        nx, ny = F.regexp_replace(x, "^[+]?0*", ""), F.regexp_replace(y, "^[+]?0*", "")
        longer, shorter = F.length(nx) > F.length(ny), F.length(nx) < F.length(ny)
        return (
            F.when(numeric & (shorter | ~longer & (nx < ny)), -1)
            .when(numeric & (longer | ~shorter & (nx > ny)), 1)
            .when(numeric, 0)
            .when(x < y, -1)
            .when(x > y, 1)
            .otherwise(0)
        )

    signs = F.filter(F.zip_with(_segments(a), _segments(b), step), lambda s: s != 0)
    return F.coalesce(F.try_element_at(signs, F.lit(1)), F.lit(0))


def version_gte(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (version_cmp(a, b) >= 0)
