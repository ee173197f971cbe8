"""Endpoint paths, parameter keys, server base paths and source links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.taxonomy import VERBS

_MARK = "\u0001"


def _variables_marked(path: Column) -> Column:
    """Path variables as marks, braces nested to any depth; one that never closes takes the rest of the path.

    Where no brace is nested, a variable ends at the next closing brace; else a fold over the pieces that start with a
    brace counts the depth."""
    pieces = F.split(path, r"(?=[{}])")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(acc: Column, piece: Column) -> Column:
        depth, out = acc["depth"], acc["out"]
        opens, closes = piece.startswith("{"), piece.startswith("}")
        after = F.when(opens, depth + 1).when(closes & (depth > 0), depth - 1).otherwise(depth)
        shown = F.when(opens, F.when(depth == 0, F.lit(_MARK)).otherwise(F.lit(""))).when(depth == 0, piece).when(closes & (depth == 1), F.substr(piece, F.lit(2))).otherwise(F.lit(""))
        return F.struct(after.alias("depth"), F.concat(out, shown).alias("out"))

    nested = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    return F.when(path.rlike(r"\{[^}]*\{"), nested).otherwise(F.regexp_replace(path, r"\{[^}]*(\}|\z)", _MARK))


def norm_path(path: Column) -> Column:
    """Lower case, path variables to ``{}``, single slashes, no trailing slash; null or empty is ``/``."""
    squeezed = F.regexp_replace(F.replace(_variables_marked(F.lower(path)), F.lit(_MARK), F.lit("{}")), "/+", "/")
    cut = F.regexp_replace(squeezed, "(?<=.)/$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("/"))


def endpoint_key(method: Column, path: Column) -> Column:
    """Join key: verb and normalised path."""
    return F.concat(method, F.lit(" "), norm_path(path))


def endpoint_label(method: Column, path: Column) -> Column:
    """Display label: verb and raw path."""
    return F.concat(method, F.lit(" "), path)


def path_vars(path: Column) -> Column:
    """Variable names in order; empty for null."""
    return F.coalesce(F.regexp_extract_all(path, F.lit(r"\{([^}]*)\}"), F.lit(1)), F.array().cast("array<string>"))


def param_key(location: Column, name: Column) -> Column:
    """``LOCATION:name``; only header names are case-insensitive."""
    plain = F.coalesce(name, F.lit(""))
    return F.concat(
        F.coalesce(location, F.lit("?")), F.lit(":"), F.when(location == "HEADER", F.lower(plain)).otherwise(plain)
    )


def _base_of(url: Column) -> Column:
    """Path part of one server URL, without a trailing slash; empty when nothing can be recovered."""
    templated = url.contains("{")
    bare = F.regexp_replace(url, r"[?#].*$", "")
    has_scheme = bare.contains("://")
    from_template = F.when(has_scheme, F.regexp_extract(bare, r"^.*?://[^/]*(/.*)?$", 1)).when(
        bare.startswith("/"), bare
    )
    from_template = F.when(from_template.contains("{"), F.lit("")).otherwise(
        F.coalesce(F.try_url_decode(F.replace(from_template, F.lit("+"), F.lit("%2B"))), from_template)
    )
    absolute = F.coalesce(
        F.try_url_decode(
            F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("+"), F.lit("%2B"))
        ),
        F.lit(""),
    )
    raw = (
        F.when(templated, from_template)
        .when(url.rlike(r"(?i)^[a-z][a-z0-9+.-]*://.*"), absolute)
        .otherwise(url)
    )
    rooted = F.when(raw.startswith("/"), raw).otherwise(F.concat(F.lit("/"), raw))
    return F.when(
        url.isNull() | (F.trim(url) == "") | raw.isNull() | (F.trim(raw) == "") | (raw == "/"), F.lit("")
    ).otherwise(F.regexp_replace(rooted, "/$", ""))


def server_base(urls: Column) -> Column:
    """The base path shared by all servers, or empty when there is none or more than one."""
    bases = F.array_distinct(F.filter(F.transform(urls, _base_of), lambda b: b != ""))
    return F.when(F.size(bases) == 1, bases[0]).otherwise(F.lit(""))


def join_base(base: Column, path: Column) -> Column:
    return (
        F.when(base == "", path)
        .when(path.isNull() | path.isin("", "/"), base)
        .when(path.startswith("/"), F.concat(base, path))
        .otherwise(F.concat(base, F.lit("/"), path))
    )


def is_http_endpoint(endpoint: Column) -> Column:
    """``VERB <blank>…``; false for null."""
    return F.coalesce(endpoint.rlike("^(" + "|".join(VERBS) + r")\s"), F.lit(False))


def code_url(base: Column, project: Column, repo: Column, ref: Column, path: Column, line: Column) -> Column:
    """Link to a source line on a project/repo git host; null when a required part is missing."""

    def blank(c: Column) -> Column:
        return c.isNull() | (F.trim(c) == "")

    root = F.regexp_replace(F.coalesce(base, F.lit("")), "/+$", "")
    parts = F.transform(F.split(path, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")))
    url = F.concat(
        root,
        F.lit("/projects/"),
        project,
        F.lit("/repos/"),
        repo,
        F.lit("/browse/"),
        F.array_join(parts, "/"),
        F.when(blank(ref), F.lit("")).otherwise(
            F.concat(F.lit("?at="), F.replace(F.url_encode(F.concat(F.lit("refs/heads/"), ref)), F.lit("+"), F.lit("%20")))
        ),
        F.coalesce(F.concat(F.lit("#"), line.cast("string")), F.lit("")),
    )
    return F.when((root == "") | blank(project) | blank(repo) | blank(path) | (path == "?"), F.lit(None)).otherwise(url)
