"""Constraint and media-type comparison as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference names that stand for scalars.
SCALAR_NAMES = [
    "string", "integer", "int", "long", "short", "byte", "boolean", "double", "float", "number",
    "bigdecimal", "biginteger", "character", "char", "uuid", "date", "localdate", "localdatetime",
    "instant", "offsetdatetime", "zoneddatetime", "void",
]


def _show(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def show_list(c: Column) -> Column:
    """``[a, b]``, or ``null``."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(c, ", ", "null"), F.lit("]")), F.lit("null"))


def value_set(values: Column) -> Column:
    """Lower-case distinct values in order; empty for null."""
    empty = F.array().cast("array<string>")
    lowered = F.transform(F.coalesce(values, empty), lambda v: F.lower(v))
    return F.array_sort(F.array_distinct(F.array_compact(lowered)))


def same_set(a: Column, b: Column) -> Column:
    """Case-insensitive set equality; null is the empty set."""
    return value_set(a) == value_set(b)


def has_values(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def no_constraints(s: Column) -> Column:
    """Nothing declared. The origin flag of an enum does not count."""
    out = F.lit(True)
    for k in ("minLength", "maxLength", "minimum", "maximum", "pattern", "format"):
        out = out & s[k].isNull()
    for k in ("exclusiveMin", "exclusiveMax"):
        out = out & ~F.coalesce(s[k], F.lit(False))
    return s.isNull() | (out & ~has_values(s["enumValues"]))


def constraint_diff(code: Column, spec: Column, code_integer: Column, spec_integer: Column) -> Column:
    """First differing keyword in a fixed order, or null.

    Exclusive bounds of integers are folded into the bound; a bound, format or pattern the code does not
    declare is no drift, but a length or an enum is compared both ways.
    """

    def bound(s: Column, key: str, flag: str, integer: Column, step: int) -> Column:
        return F.when(integer & F.coalesce(s[flag], F.lit(False)), s[key] + F.lit(float(step))).otherwise(s[key])

    def exclusive(s: Column, flag: str, integer: Column) -> Column:
        return ~integer & F.coalesce(s[flag], F.lit(False))

    ci, si = F.coalesce(code_integer, F.lit(False)), F.coalesce(spec_integer, F.lit(False))

    def message(label: str, c: Column, s: Column) -> Column:
        return F.concat(F.lit(label + " code="), _show(c), F.lit(" spec="), _show(s))

    steps = []
    for k in ("minLength", "maxLength"):
        steps.append(F.when(~code[k].eqNullSafe(spec[k]), message(k, code[k], spec[k])))
    for k, flag, step in (("minimum", "exclusiveMin", 1), ("maximum", "exclusiveMax", -1)):
        c, s = bound(code, k, flag, ci, step), bound(spec, k, flag, si, step)
        steps.append(F.when(c.isNotNull() & ~c.eqNullSafe(s), message(k, c, s)))
    for flag, label in (("exclusiveMin", "exclusiveMinimum"), ("exclusiveMax", "exclusiveMaximum")):
        steps.append(
            F.when(exclusive(code, flag, ci) != exclusive(spec, flag, si), message(label, code[flag], spec[flag]))
        )
    steps.append(F.when(code["format"] != spec["format"], message("format", code["format"], spec["format"])))
    steps.append(
        F.when(
            code["pattern"].isNotNull() & ~code["pattern"].eqNullSafe(spec["pattern"]),
            message("pattern", code["pattern"], spec["pattern"]),
        )
    )
    enums = F.concat(F.lit("enum code="), show_list(code["enumValues"]), F.lit(" spec="), show_list(spec["enumValues"]))
    steps.append(F.when(~same_set(code["enumValues"], spec["enumValues"]), enums))
    return F.when(code.isNotNull() & spec.isNotNull(), F.coalesce(*steps))


# --- media types -----------------------------------------------------------------------------------


def media_base(m: Column) -> Column:
    """Lower case, without parameters; null when nothing is left."""
    return F.nullif(F.trim(F.substring_index(F.lower(m), ";", 1)), F.lit(""))


def _bases(media: Column) -> Column:
    return F.array_compact(F.transform(F.coalesce(media, F.array().cast("array<string>")), media_base))


def _parseable(base: Column) -> Column:
    token = r"[!#$%&'*+.^_`|~0-9a-z-]+"
    return base.rlike(rf"^(\*|\*/\*|{token}/{token})$") & ~base.rlike(r"^\*/[^*]")


def _one_compatible(a: Column, b: Column) -> Column:
    """Equal, wildcard, or wildcard with a structured suffix."""
    ta, tb = F.substring_index(a, "/", 1), F.substring_index(b, "/", 1)
    sa, sb = F.substring_index(a, "/", -1), F.substring_index(b, "/", -1)
    fa = F.when(sa.contains("+"), F.substring_index(sa, "+", -1))
    fb = F.when(sb.contains("+"), F.substring_index(sb, "+", -1))

    def wild(sub: Column, suffix: Column, other: Column, other_suffix: Column) -> Column:
        return F.coalesce(
            sub.startswith("*+") & ((suffix == other) | F.coalesce(suffix == other_suffix, F.lit(False))), F.lit(False)
        )

    same_type = (ta == tb) & (
        (sa == sb) | (sa == "*") | (sb == "*") | wild(sa, fa, sb, fb) | wild(sb, fb, sa, fa)
    )
    return (ta == "*") | (tb == "*") | same_type


def media_compatible(code: Column, spec: Column) -> Column:
    """Every type of each side has a partner on the other; unparseable or empty sides compare as sets."""
    cs, ss = _bases(code), _bases(spec)
    sets_equal = F.array_sort(F.array_distinct(cs)) == F.array_sort(F.array_distinct(ss))
    odd = (F.size(cs) == 0) | (F.size(ss) == 0) | F.exists(F.concat(cs, ss), lambda m: ~_parseable(m))
    both = F.forall(cs, lambda x: F.exists(ss, lambda y: _one_compatible(x, y))) & F.forall(
        ss, lambda y: F.exists(cs, lambda x: _one_compatible(x, y))
    )
    return F.when(odd, sets_equal).otherwise(both)


# --- schema references -----------------------------------------------------------------------------


def is_array_ref(ref: Column) -> Column:
    return F.coalesce(ref.endswith("[]"), F.lit(False))


def base_name(ref: Column) -> Column:
    return F.replace(ref, F.lit("[]"), F.lit(""))


def is_scalar_name(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(SCALAR_NAMES), F.lit(False))
