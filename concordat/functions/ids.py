"""Content-addressed evidence ids."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import norm_blank, strip

BASE32 = "abcdefghijklmnopqrstuvwxyz234567"


def _fold_tables() -> tuple[str, str]:
    """All single letters that decompose to a base letter and marks, and that letter."""
    src, dst = [], []
    for cp in range(0xC0, 0x10000):
        form = "NFKD" if cp < 0x250 else "NFD"
        base = "".join(c for c in unicodedata.normalize(form, chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(cp) and unicodedata.category(chr(cp))[0] == "L":
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD = _fold_tables()


def fold_accents(s: Column) -> Column:
    """Drop combining marks and replace Latin letters with diacritics by their base letter."""
    return F.regexp_replace(F.translate(s, *_FOLD), r"\p{M}+", "")


def hash8(text: Column) -> Column:
    """First 40 bits of SHA-256 over the normalised text, as eight base-32 letters."""
    bits = F.conv(F.substr(F.sha2(norm_blank(text), 256), F.lit(1), F.lit(10)), 16, 10).cast("bigint")
    letters = [
        F.substr(F.lit(BASE32), (F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        for shift in range(35, -1, -5)
    ]
    return F.concat(*letters)


def slug(s: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(strip(fold_accents(s))), "[^a-z0-9]+", "-"), "(^-+|-+$)", "")
    return F.when(s.isNull() | (out == ""), F.lit("x")).otherwise(out)


def issue_part_id(key: Column, text: Column) -> Column:
    return F.concat(key, F.lit("#"), hash8(text))


def section_id(source: Column, heading: Column, text: Column) -> Column:
    return F.concat(source, F.lit("#"), slug(heading), F.lit("-"), hash8(text))


def endpoint_id(class_name: Column, method: Column, path: Column) -> Column:
    return F.concat(F.lit("CODE:"), class_name, F.lit("#"), F.upper(F.coalesce(method, F.lit(""))), F.lit(" "), path)


def finding_fingerprint(*parts: Column) -> Column:
    """Stable finding id over its identifying parts; null is told apart from empty."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)
