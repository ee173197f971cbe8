"""Divergence between the sources of a language, by a quadtree over the matrix of groups and terms."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.common import pieces, separator_table, split_table, word_windows
from concordat.session import cut_lineage

c = F.col
SCALE = 1_000_000_000
ROWS = 32  # groups on a side of a unit
COLUMNS = 1024  # terms of a unit, on average
HELD = 200_000  # counts that a task holds before it passes them on
_separators = separator_table("alnum")
_separators[0x30:0x3A] = True
_LETTERS = split_table(_separators)


def _counts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, df): occurrences, and documents with the term, of the rows of a task so far."""
    names = ["lang", "source", "term", "n", "df"]
    n: dict[tuple, Counter] = defaultdict(Counter)
    df: dict[tuple, Counter] = defaultdict(Counter)

    def passed() -> pa.RecordBatch:
        keys = [(g, t, m, df[g][t]) for g, counts in n.items() for t, m in counts.items()]
        columns = [[k[0][0] for k in keys], [k[0][1] for k in keys], [k[1].decode() for k in keys], [k[2] for k in keys], [k[3] for k in keys]]
        types = pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=names)

    for batch in rows:
        langs, sources, at = batch.column(1).to_pylist(), batch.column(2).to_pylist(), 0
        for run in pieces(batch.column(0)):
            for text in run:
                group = langs[at], sources[at]
                at += 1
                seen: set[bytes] = set()
                for words in word_windows(text, _LETTERS):
                    n[group].update(words)
                    seen.update(words)
                df[group].update(seen)
            if sum(map(len, n.values())) > HELD:
                yield passed()
                n.clear()
                df.clear()
    yield passed()


class Quadtree:
    """The nonzero cells of a square matrix of side 2**depth: per level the sorted Morton codes of quadrants with one.

    A quadrant that is not listed is uniformly zero, and so are all within it."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, depth: int):
        code = np.zeros(len(row), np.int64)
        for b in range(depth):
            code |= ((column >> b & 1) << 2 * b) | ((row >> b & 1) << 2 * b + 1)
        order = np.argsort(code)
        self.value = value[order]
        self.levels = [code[order]]
        for _ in range(depth):
            self.levels.append(np.unique(self.levels[-1] >> 2))
        self.levels.reverse()

    def at(self, level: int, codes: np.ndarray) -> np.ndarray:
        """Place of each code in its level, -1 for zero quadrants."""
        known = self.levels[level]
        if not len(known):
            return np.full(len(codes), -1)
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[place] == codes, place, -1)


def joint_leaves(left: Quadtree, right: Quadtree, rows: tuple[int, int], depth: int, same: bool) -> tuple[np.ndarray, ...]:
    """(a, b, pa, pb) per pair of rows and column where one of the cells or both are not zero: rows, and places of the
    cells' values (-1: zero). Quadrant pairs over the same columns descend together; a pair of zero quadrants ends
    there. With ``same`` only pairs a < b are visited."""
    a = b = column = np.zeros(1, np.int64)
    quarter = np.arange(8)
    at = np.full(1, 0 if len(left.value) else -1), np.full(1, 0 if len(right.value) else -1)
    for level in range(1, depth + 1):
        a, b, column = ((x[:, None] * 2 + (quarter >> s & 1)).ravel() for x, s in ((a, 2), (b, 1), (column, 0)))
        low = depth - level
        keep = (a << low < rows[0]) & (b << low < rows[1])
        if same:
            keep &= a <= b if low else a < b
        a, b, column = a[keep], b[keep], column[keep]
        at = left.at(level, _code(a, column, level)), right.at(level, _code(b, column, level))
        keep = (at[0] >= 0) | (at[1] >= 0)
        a, b, column, at = a[keep], b[keep], column[keep], (at[0][keep], at[1][keep])
    return a, b, *at


def _code(row: np.ndarray, column: np.ndarray, bits: int) -> np.ndarray:
    code = np.zeros(len(row), np.int64)
    for i in range(bits):
        code |= ((column >> i & 1) << 2 * i) | ((row >> i & 1) << 2 * i + 1)
    return code


def _unit(cells: pa.Table) -> pa.Table:
    """(a, b, leaves, value) per ordered pair of a unit's groups: columns where the pair has a cell that is not zero,
    and the sum of f over those. Rows with col -1 name the groups and the p of their zero cells."""
    side, row, col, p = (cells[x].to_numpy() for x in ("side", "row", "col", "p"))
    same = bool(cells["same"][0].as_py())
    base, index, trees = [], [], []
    cell = col >= 0
    depth = max(5, int(col.max(initial=0)).bit_length())
    for s in (0,) if same else (0, 1):
        head = (side == s) & ~cell
        names, first = np.unique(row[head], return_index=True)
        index.append(names)
        base.append(p[head][first])
        mine = (side == s) & cell
        trees.append(Quadtree(np.searchsorted(names, row[mine]), col[mine], p[mine], depth))
    if same:
        base, index, trees = base * 2, index * 2, trees * 2
    a, b, pa_, pb = joint_leaves(*trees, (len(index[0]), len(index[1])), depth, same)
    x, y = (
        np.where(place >= 0, np.append(tree.value, 0)[place], zero[of]) for place, tree, zero, of in ((pa_, trees[0], base[0], a), (pb, trees[1], base[1], b))
    )
    square = (x - y) ** 2
    pair, place = np.unique(a * len(index[1]) + b, return_inverse=True)
    leaves = np.bincount(place, minlength=len(pair))
    sums = []
    for q in (y, x):
        f = np.zeros(len(pair), np.int64)
        np.add.at(f, place, square // q)
        sums.append(f)
    i, j = index[0][pair // len(index[1])], index[1][pair % len(index[1])]
    return pa.table({"a": np.concatenate((i, j)), "b": np.concatenate((j, i)), "leaves": np.concatenate((leaves, leaves)), "value": np.concatenate(sums)})


def _p(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any count."""
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(20,0)) * (CAST({n} AS DECIMAL(18,0)) + 1)) div (CAST({total} AS DECIMAL(20,0)) + {terms})")


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _matrix(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Cells (lang, source, row, cb, col, term, p, q) and groups (lang, source, row, terms, parts, sum, p0)."""
    text = [F.coalesce(c(x).cast("string"), F.lit("")).alias(x) for x in ("text", "lang", "source")]
    rows = docs.select(*text)
    names = "lang string, source string, term string, n bigint, df bigint"
    counts = rows.mapInArrow(_counts, names).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    counts = cut_lineage(counts)
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("ln"), F.sum("df").alias("df")).filter(c("df") >= least)
    kept = cut_lineage(kept.select("lang", "term", "ln"))
    langs = rows.groupBy("lang").agg(F.lit(0).alias("_")).join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("ln").alias("total")), "lang", "left")
    langs = langs.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"))
    langs = cut_lineage(langs.withColumn("parts", F.ceil(c("terms") / COLUMNS).cast("int")))
    # Terms are dealt to column blocks by hash and numbered within: no window reads all terms of a language.
    placed = kept.join(langs, "lang").withColumn("cb", F.pmod(F.xxhash64("term"), "parts").cast("int"))
    placed = placed.withColumn("col", F.row_number().over(Window.partitionBy("lang", "cb").orderBy("term")) - 1)
    placed = placed.select("lang", "term", "cb", "col", _p("ln", "total", "terms").alias("q"))
    cells = cut_lineage(counts.drop("df").join(placed, ["lang", "term"]))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("sum"))
    groups = rows.groupBy("lang", "source").agg(F.lit(0).alias("_")).drop("_").join(totals, ["lang", "source"], "left")
    groups = groups.join(langs.select("lang", "terms", "parts"), "lang").withColumn("sum", F.coalesce("sum", F.lit(0)))
    groups = groups.withColumn("row", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    zero = F.when(c("terms") > 0, _p("0", "sum", "terms"))
    groups = cut_lineage(groups.select("lang", "source", "row", "terms", "parts", "sum", zero.alias("p0")))
    cells = cells.join(groups.select("lang", "source", "row", "terms", "sum"), ["lang", "source"]).withColumn("p", _p("n", "sum", "terms"))
    return cells.select("lang", "source", "row", "cb", "col", "term", "p", "q"), groups


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, leaves, value) summed over the units: blocks of ``ROWS`` groups by such blocks, by column blocks."""
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks"))
    steps = lambda n: F.explode(F.sequence(F.lit(0), c(n) - 1))
    heads = groups.filter("parts > 0").withColumn("cb", steps("parts")).select("lang", "row", "cb", F.lit(-1).alias("col"), c("p0").alias("p"))
    dealt = cells.select("lang", "row", "cb", "col", "p").unionByName(heads).join(blocks, "lang")
    dealt = dealt.withColumn("mine", F.floor(c("row") / ROWS).cast("int")).withColumn("other", steps("blocks"))
    dealt = dealt.select(
        "lang", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "cb",
        F.when(c("mine") > c("other"), 1).otherwise(0).alias("side"), (c("mine") == c("other")).alias("same"),
        c("row").cast("bigint").alias("row"), c("col").cast("bigint").alias("col"), "p",
    )

    def unit(key: tuple, cells: pa.Table) -> pa.Table:
        found = _unit(cells)
        return found.append_column("lang", pa.array([key[0].as_py()] * found.num_rows, pa.string()))

    found = dealt.groupBy("lang", "i", "j", "cb").applyInArrow(unit, "a bigint, b bigint, leaves bigint, value bigint, lang string")
    return found.groupBy("lang", "a", "b").agg(F.sum("leaves").alias("leaves"), F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = 3, ranks: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (text, lang, source): how far the sources of a language are
    from each other (part "pair", item the other source) and which terms set a source apart (part "term").

    Counts are taken over all whole texts and pass on in sums per group and term. The matrix of a language's groups by
    its kept terms is cut into units of ``ROWS`` by ``ROWS`` groups and about ``COLUMNS`` terms. A unit holds quadtrees of the
    nonzero cells of its two sides, which descend together: quadrants that are zero on both sides end at once, and
    the area they cover (all terms less the leaves visited) is priced at f of the two constant p. The output
    has a row per ordered pair of sources of a language, as asked; no pair is formed per term outside a unit.

    Null text, lang and source are ''. Groups without kept terms have all their cells zero; a language without kept
    terms has pairs of value 0. Repeated rows are documents of their own. An empty table gives no rows; other columns are
    not read."""
    cells, groups = _matrix(docs, least)
    cells = cut_lineage(cells)
    sums = _pairs(cells, groups)
    one = groups.select("lang", "terms", c("source"), c("row").cast("bigint").alias("a"), c("p0").alias("pa"))
    two = groups.select("lang", c("source").alias("item"), c("row").cast("bigint").alias("b"), c("p0").alias("pb"))
    pairs = one.join(two, "lang").filter(c("a") != c("b")).join(sums, ["lang", "a", "b"], "left")
    outside = (c("terms") - F.coalesce("leaves", F.lit(0))) * _f(c("pa"), c("pb"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(F.coalesce("value", F.lit(0)) + outside, F.lit(0)).alias("value"))
    terms = cells.filter(c("p") > c("q")).select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), _f(c("p"), c("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(c("value").desc(), c("item"))
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= ranks))


def report(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value and rank over all documents."""
    return audit(docs)
