"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON.

DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.operators.graph import union_all
from concordat.session import cut_lineage

c = F.col
# What a value's type may be called for each type of a schema.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DECIMAL", "DOUBLE", "FLOAT"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}


def json_text(text: Column) -> Column:
    """A JSON string of the text; ``null`` for null."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1))


def _heads(single: DataFrame) -> DataFrame:
    """(conv_id, call_id, head, far) of calls that wait for one call each (conv_id, call_id, dep): the first call on
    the way back that waits for none or several, and how many steps it is away. Calls whose way back runs in a circle are
    left out. Every round doubles the jumps: a chain of n calls takes log2(n) rounds."""
    keys = ["conv_id", "call_id"]
    more = single.select("conv_id", c("call_id").alias("dep"), F.lit(True).alias("more"))
    hops = single.withColumn("far", F.lit(1)).join(more, ["conv_id", "dep"], "left")
    hops = cut_lineage(hops.select(*keys, c("dep").alias("head"), "far", F.coalesce("more", F.lit(False)).alias("more")))
    left = hops.filter("more").count()
    while left:
        on = hops.select("conv_id", c("call_id").alias("head"), c("head").alias("to"), c("far").alias("by"), c("more").alias("again"))
        step = hops.filter("more").join(on, ["conv_id", "head"])
        step = step.select(*keys, c("to").alias("head"), (c("far") + c("by")).alias("far"), c("again").alias("more"))
        hops = cut_lineage(hops.filter("NOT more").unionByName(step))
        now = hops.filter("more").count()
        if now == left:  # no chain has ended: what is left are circles
            break
        left = now
    return hops.filter("NOT more").drop("more")


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after): 0 without a call to wait for, else one more than
    the highest level of the calls in ``after``. Calls on a cycle, and what waits for them, have level null.

    Calls that wait for a single one are contracted to the head of their chain (``_heads``), so chains of any length take
    a logarithmic number of rounds; what is left is one round per level of calls that wait for several. A round reads
    edges of open calls only and writes what is new; ids that no call of the conversation has are not waited for."""
    keys = ["conv_id", "call_id"]
    nodes = cut_lineage(calls.select(*keys).distinct())
    edges = calls.select(*keys, F.explode("after").alias("dep")).filter(c("dep").isNotNull()).distinct()
    known = nodes.select("conv_id", c("call_id").alias("dep"))
    edges = cut_lineage(edges.join(known, ["conv_id", "dep"], "left_semi").select(*keys, "dep"))
    several = edges.groupBy(*keys).agg(F.count("*").alias("deps"))
    by_deps = cut_lineage(edges.join(several, keys))
    heads = cut_lineage(_heads(by_deps.filter("deps = 1").select(*keys, "dep")))
    back = heads.select("conv_id", c("call_id").alias("dep"), "head", "far")
    far = by_deps.filter("deps > 1").join(back, ["conv_id", "dep"], "left")
    far = cut_lineage(far.select(*keys, F.coalesce("head", "dep").alias("head"), (F.coalesce("far", F.lit(0)) + 1).alias("far")))
    last = cut_lineage(nodes.join(several.select(*keys), keys, "left_anti").withColumn("level", F.lit(0)))
    done, told = [last], []
    while not far.isEmpty() and not last.isEmpty():
        met = last.select("conv_id", c("call_id").alias("head"), "level")
        seen = far.join(met, ["conv_id", "head"], "left")
        seen = cut_lineage(seen.select(*keys, "head", "far", (c("level") + c("far")).alias("level")))
        told = [*told, seen.filter(c("level").isNotNull()).select(*keys, "level")]
        if len(told) > 8:
            told = [cut_lineage(union_all(told))]
        rest = seen.filter(c("level").isNull()).select(*keys, "head", "far")
        ready = told[-1].select(*keys).distinct().join(rest.select(*keys).distinct(), keys, "left_anti")
        last = cut_lineage(union_all(told).join(ready, keys, "left_semi").groupBy(*keys).agg(F.max("level").alias("level")))
        done = [*done, last] if len(done) < 8 else [cut_lineage(union_all([*done, last]))]
        far = rest
    out = cut_lineage(union_all(done))
    chained = heads.join(out.select("conv_id", c("call_id").alias("head"), "level"), ["conv_id", "head"])
    out = out.unionByName(chained.select(*keys, (c("level") + c("far")).alias("level")))
    return nodes.join(out, keys, "left")


def faults(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, errors) of calls (conv_id, call_id, name, arguments) against schemas (name, field, type,
    required): sorted texts ``tool``, ``json``, ``missing f``, ``unknown f``, ``type f``, ``schema f``, comma-joined; only
    of calls that have some.

    Types: string, integer, number, boolean, object, array; a field of any other type is told as ``schema f``, one without a type takes any value. A field
    ``a.b`` is that of the object in ``a``: it is required where ``a`` is given, and where a schema names fields of an
    object, others in it are unknown. A null value counts as a missing one."""
    keys = ["conv_id", "call_id"]
    parsed = calls.select(*keys, "name", F.try_parse_json("arguments").alias("v")).withColumn("kind", F.schema_of_variant("v"))
    is_object = F.coalesce(c("kind").startswith("OBJECT"), F.lit(False))
    fields = schemas.select("name", "field", "type", "required").withColumn("owner", F.regexp_extract("field", r"^(.*)\.[^.]*$", 1))
    tools = fields.groupBy("name").agg(F.count("*").alias("_fields"))
    broken = parsed.join(tools, "name", "left").select(
        *keys, F.explode(F.filter(F.array(F.when(c("_fields").isNull(), F.lit("tool")), F.when(~is_object, F.lit("json"))), lambda x: x.isNotNull())).alias("error")
    )
    readable = parsed.filter(is_object)
    # The fields of every object that a schema looks into, a level of names at a time.
    level = readable.select(*keys, "name", F.lit("").alias("owner"), "v")
    depth = schemas.agg(F.max(F.size(F.split("field", r"\.")))).first()[0] or 1
    found = []
    for _ in range(depth):
        level = level.sparkSession.sql(
            "SELECT conv_id, call_id, name, owner, concat(CASE WHEN owner = '' THEN '' ELSE concat(owner, '.') END, key) AS field, "
            "regexp_extract(schema_of_variant(value), '^[A-Z]+', 0) AS got, value AS v FROM {rows}, LATERAL variant_explode(v) AS x(pos, key, value)",
            rows=level,
        ).filter(c("got") != "VOID")
        found.append(level.select(*keys, "name", "owner", "field", "got"))
        level = level.filter("got = 'OBJECT'").select(*keys, "name", c("field").alias("owner"), "v")
    given = union_all(found)
    wanted = readable.select(*keys, "name").join(fields, "name")
    here = given.filter("got = 'OBJECT'").select(*keys, c("field").alias("owner")).unionByName(readable.select(*keys, F.lit("").alias("owner")))
    wanted = wanted.join(here, [*keys, "owner"], "left_semi")
    expected = F.element_at(F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))]), c("type"))
    both = wanted.join(given.select(*keys, "field", "got"), [*keys, "field"], "left")
    told = lambda rows, word: rows.select(*keys, F.concat(F.lit(word + " "), "field").alias("error"))
    missing = told(both.filter(c("got").isNull() & c("required")), "missing")
    wrong = told(both.filter(c("got").isNotNull() & ~F.array_contains(expected, c("got"))), "type")
    odd = told(both.filter(c("got").isNotNull() & c("type").isNotNull() & expected.isNull()), "schema")
    owners = fields.select("name", "owner").distinct()
    unknown = told(given.join(owners, ["name", "owner"], "left_semi").join(fields, ["name", "field"], "left_anti"), "unknown")
    every = broken.unionByName(missing).unionByName(wrong).unionByName(odd).unionByName(unknown)
    return every.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call: conv_id, call_id, name, level, position, n_results, errors, valid, and ``message``.

    Calls (conv_id, call_id, name, arguments, after) and results (conv_id, call_id, content, turn) are joined by
    identifier. ``position`` numbers the calls of a conversation in topological order, by level and then the MD5 of
    call_id, calls on a cycle last; calls are numbered in 256 ranges of it per level, so that a conversation with a
    third of all calls is spread over tasks.
    ``message`` is JSON without white space and with sorted keys: arguments (null if they cannot be read), call_id,
    name and result, that of the first turn. Calls without a result have ``"result":null``; results without a
    call are left out, as are rows without conv_id or call_id; the first of calls with one identifier stays.

    Arguments are parsed as variants, which sorts the keys at every depth. Empty tables give no rows."""
    keys = ["conv_id", "call_id"]
    calls = calls.select(*keys, "name", "arguments", "after").filter(c("conv_id").isNotNull() & c("call_id").isNotNull())
    first = F.min_by(F.struct("name", "arguments", "after"), F.struct(c("name").isNull(), "name", c("arguments").isNull(), "arguments"))
    calls = cut_lineage(calls.groupBy(*keys).agg(first.alias("call")).select(*keys, "call.*"))
    answers = results.groupBy(*keys).agg(F.count("*").alias("n_results"), F.min_by("content", F.struct("turn", "content")).alias("content"))
    rank = [F.coalesce("level", F.lit(2**31 - 1)).alias("rank"), F.substring(F.md5("call_id"), 1, 2).alias("range"), F.md5("call_id").alias("at")]
    placed = levels(calls).select(*keys, "level", *rank)
    ranges = placed.groupBy("conv_id", "rank", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("rank", "range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("conv_id", "rank", "range").orderBy("at", "call_id"))
    placed = placed.withColumn("inside", inside).join(ranges, ["conv_id", "rank", "range"]).withColumn("position", c("before") + c("inside") - 1)
    done = calls.join(answers, keys, "left").join(placed.select(*keys, "level", "position"), keys).join(faults(calls, schemas), keys, "left")
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    message = F.concat(
        F.lit('{"arguments":'), arguments, F.lit(',"call_id":'), json_text(c("call_id")), F.lit(',"name":'), json_text(c("name")),
        F.lit(',"result":'), json_text(c("content")), F.lit("}"),
    )
    return done.select(
        *keys,
        "name",
        c("level").cast("bigint").alias("level"),
        c("position").cast("bigint").alias("position"),
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        F.coalesce("errors", F.lit("")).alias("errors"),
        c("errors").isNull().alias("valid"),
        message.alias("message"),
    )


# What a tool takes: fixed values of the derived tables below.
SCHEMAS = [
    ("search", "query", "string", True), ("search", "limit", "integer", False), ("search", "exact", "boolean", False),
    ("lookup", "key", "string", True), ("lookup", "limit", "integer", True),
    ("translate", "text", "string", True), ("translate", "to", "string", True),
]
CALLS = r"""
SELECT conv_id, concat('call_', turn) AS call_id,
  CASE length(text) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'translate' ELSE 'browse' END AS name,
  CASE WHEN text IS NULL OR length(text) % 13 = 0 THEN concat('{"query": ', turn)
    ELSE concat('{ "to" : "en", "query": ', quoted, ', "limit": ', CASE WHEN length(text) % 5 = 0 THEN '"ten"' ELSE cast(length(text) AS STRING) END,
      CASE WHEN length(text) % 3 = 0 THEN concat(', "key": "k', turn, '"') ELSE '' END, ', "exact": ', CASE WHEN length(text) % 2 = 0 THEN 'true' ELSE 'null' END, ' }') END AS arguments,
  CASE WHEN length(text) % 3 = 0 THEN array(concat('call_', turn - 2))
    WHEN length(text) % 3 = 1 THEN array(concat('call_', turn - 4), concat('call_', turn + 2), 'none') ELSE array() END AS after
FROM rows WHERE role = 'assistant'"""


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas out of (conv_id, turn, role, text): an assistant's turn calls a tool with its text
    as an argument, the user's turn after it is the result. Lengths decide which tool, what is wrong with the
    arguments, and which other calls it waits for."""
    spark = turns.sparkSession
    calls = spark.sql(CALLS.replace("FROM rows", "FROM {rows}").replace("{ \"to\"", "{{ \"to\"").replace("' }'", "' }}'").replace("{\"query\"", "{{\"query\""), rows=turns.withColumn("quoted", json_text(c("text"))))
    results = turns.filter(c("role") == "user").select("conv_id", F.concat(F.lit("call_"), c("turn") - 1).alias("call_id"), c("text").alias("content"), "turn")
    return calls, results, spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")


def report(turns: DataFrame) -> DataFrame:
    """Every tool call of the conversations: see ``link``."""
    return link(*from_turns(turns))
