"""Exact n-gram Jaccard join by grouped prefixes, and the components of its links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.llm.common import Words, folded, mix, pieces, separator_table
from concordat.operators.graph import connected_components
from concordat.session import arrow_rows, cut_lineage

c = F.col
SHORT = 32
COMMON_BITS = 12
COMMON_MOST = 1 << 20
BLOCK = 256
RUN = 250_000  # characters of texts whose shingles are worked out at once
BITMAP = 1 << 26
ROWS = 500
_SPACE = separator_table("space")
_BASE = np.uint64(0x9FB21C651E98DF25)
_HIGH = np.uint64(32)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``k`` words; of all its words if there are fewer."""
    w = Words([folded(t) for t in texts], _SPACE)
    n = len(w.hash)
    run = np.zeros(n, np.uint64)
    for j in range(k):
        run = run * _BASE
        run[: max(0, n - j)] += w.hash[j:]
    run = mix(run)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(run[a : b - k + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for j in range(a, b):
                h = h * _BASE + w.hash[j : j + 1]
            out.append(mix(h))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    if not len(s):
        return 0, 0
    one, two = mix(s + np.uint64(1)).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return tuple(np.array([one, two], np.uint64).view(np.int64).tolist())


def prefix_size(n: int, num: int, den: int) -> int:
    """Two sets with a Jaccard index of num / den share one of so many tokens that come first in any fixed order."""
    return n - -(-n * num // den) + 1 if n else 0


def _token_counts(rows: Iterator[pa.RecordBatch], k: int, low: int) -> Iterator[pa.RecordBatch]:
    """(token, bits, n) of the tokens below ``low``: in how many texts, and a sketch of in how many different sets."""
    for batch in rows:
        for run in pieces(batch.column(0), RUN):
            tokens, bits = [], []
            for s in shingle_sets(run, k):
                head = s[: np.searchsorted(s, np.uint64(low << 32))] >> _HIGH
                if len(head):
                    tokens.append(np.unique(head).astype(np.int64))
                    bits.append(np.full(len(tokens[-1]), np.uint64(1) << np.uint64(digest(s)[0] & 63), np.uint64))
            if tokens:
                token, bit = np.concatenate(tokens), np.concatenate(bits)
                order = np.argsort(token, kind="stable")
                token, bit = token[order], bit[order]
                at = np.flatnonzero(np.diff(token, prepend=-1))
                columns = token[at], np.bitwise_or.reduceat(bit, at).view(np.int64), np.diff(np.append(at, len(token)))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["token", "bits", "n"])


def _prefixes(rows: Iterator[pa.RecordBatch], k: int, low: int, num: int, den: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """Per document: size and digest of its set, digest of its prefix, and the prefix tokens that others may have.

    Tokens are ordered by (common, hash). Tokens below ``low`` that the bitmap does not have are in no other text."""
    common, bitmap = shared.value
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("pd", pa.int64()), ("tokens", pa.list_(pa.int64()))])
    for batch in rows:
        ids, at = batch.column(0).to_pylist(), 0
        for run in pieces(batch.column(1), RUN):
            out = []
            for s in shingle_sets(run, k):
                p = prefix_size(len(s), num, den)
                high = (s >> _HIGH).astype(np.int64)
                hot = np.zeros(len(s), bool)
                below = int(np.searchsorted(high, low))
                if len(common) and below:
                    place = np.minimum(np.searchsorted(common, high[:below]), len(common) - 1)
                    hot[:below] = common[place] == high[:below]
                prefix = np.concatenate((s[~hot], s[hot]))[:p]
                top = (prefix >> _HIGH).astype(np.int64)
                slot = top & (BITMAP - 1)
                maybe = (top >= low) | ((bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                d1, d2 = digest(s)
                out.append((ids[at], len(s), d1, d2, digest(prefix)[0], prefix[maybe].view(np.int64)))
                at += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], f.type) for j, f in enumerate(schema)], schema=schema)


def _sets(rows: Iterator[pa.RecordBatch], k: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """The sets of the documents in the bitmap, as bytes."""
    bitmap = shared.value
    for batch in rows:
        slot = batch.column(2).to_numpy()
        keep = ((bitmap[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
        batch = batch.filter(pa.array(keep))
        ids, at = batch.column(0).to_pylist(), 0
        for run in pieces(batch.column(1), RUN):
            sets = shingle_sets(run, k)
            both = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[at : at + len(run)], pa.int64()),
                    pa.array([d[0] for d in both], pa.int64()),
                    pa.array([d[1] for d in both], pa.int64()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["rep", "d1", "d2", "tokens"],
            )
            at += len(run)


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    if len(left) == len(right) == 1:
        return np.array([[len(np.intersect1d(left[0], right[0], assume_unique=True))]])
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(both), 16_384):
        part = both[at : at + 16_384]
        m = [np.stack([np.isin(part, s, assume_unique=True) for s in side]).astype(np.float32) for side in (left, right)]
        out += m[0] @ m[1].T
    return np.rint(out).astype(np.int64)


def _verify(rows: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """(node, root, links) per unit and linked member: the number of documents it links to, and a member that it is
    connected with by links. ``rows`` hold the sides of a unit one after the other."""

    def members() -> Iterator[tuple]:
        for batch in rows:
            yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)

    out: list[tuple[int, int, int]] = []
    for _, unit in groupby(members(), key=lambda r: r[0]):
        sides: dict[int, dict[tuple, tuple]] = {0: {}, 1: {}}
        for _, side, rep, d1, copies, tokens in unit:
            sides[side][rep, d1] = (rep, copies, np.frombuffer(tokens, np.uint64))
        left = list(sides[0].values())
        right = list(sides[1].values())
        if not left or not (right or len(left) > 1):
            continue
        other = right or left
        o = _overlaps([x[2] for x in left], [x[2] for x in other])
        sizes = [np.array([len(x[2]) for x in side]) for side in (left, other)]
        linked = den * o >= num * (sizes[0][:, None] + sizes[1][None, :] - o)
        if not right:
            np.fill_diagonal(linked, False)
        copies = [np.array([x[1] for x in side]) for side in (left, other)]
        counts = [(linked * copies[1][None, :]).sum(axis=1), (linked * copies[0][:, None]).sum(axis=0)]
        nodes = [x[0] for x in left] + ([x[0] for x in right] if right else [])
        many = np.concatenate((counts[0], counts[1])) if right else counts[0]
        root = list(range(len(nodes)))

        def find(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(*np.nonzero(linked), strict=True):
            a, b = find(int(i)), find(int(j) + (len(left) if right else 0))
            if a != b:
                root[max(a, b)] = min(a, b)
        out += [(nodes[i], nodes[find(i)], int(m)) for i, m in enumerate(many.tolist()) if m]
        if len(out) >= 10_000:
            yield _links(out)
            out = []
    if out:
        yield _links(out)


def _links(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["node", "root", "links"])


def _bitmap(slots: DataFrame) -> np.ndarray:
    """A bitmap of 2**26 bits with the bits of ``slot`` set, put together in Spark: 8 MB whatever the input."""
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")).alias("bits"))
    rows = words.toArrow()
    out = np.zeros(BITMAP // 64, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _token_order(docs: DataFrame, k: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """The common tokens, sorted, and the bitmap of tokens that more than one text has. Counted over all texts."""
    counted = docs.select(c("text").cast("string")).mapInArrow(lambda rows: _token_counts(rows, k, low), "token bigint, bits bigint, n bigint")
    counts = counted.groupBy("token").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).filter(c("n") > 1)
    counts = cut_lineage(counts.select("token", "n", (F.bit_count("bits") >= COMMON_BITS).alias("common")))
    common = counts.filter("common")
    size = common.count()
    if size > COMMON_MOST:  # any order gives the same links, so the set that is broadcast may end at the most frequent
        least = common.agg(F.percentile_approx("n", 1.0 - COMMON_MOST / size)).first()[0]
        common = common.filter(c("n") > least)
    tokens = np.sort(common.select("token").toArrow()["token"].to_numpy())
    return tokens, _bitmap(counts.select((c("token").bitwiseAND(BITMAP - 1)).alias("slot")))


def _parts(n: str) -> Column:
    return F.ceil(c(n) / BLOCK).cast("int")


def link(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) per row of (doc_id, text): every pair of documents whose sets of
    ``k``-word shingles have a Jaccard index of num / den or more is linked, and a component has the least doc_id that
    links reach. Exact: prefixes only choose which pairs are compared, whole sets decide.

    1. Equal sets collapse to one representative with a number of copies.
    2. Tokens are ordered common ones last, then by hash; a document's prefix is so many first tokens that linked
       sets must share one. Documents with the same prefix and size become one group.
    3. Groups that share a prefix token are paired where their sizes and the number of shared prefix tokens
       leave the link possible. A token of more than 32 groups pairs nothing: what hangs together by such
       tokens is one family, as the variants of one text are.
    4. Pairs of groups, groups in themselves and families are expanded and verified in blocks of 256 members, each
       pair of blocks a unit of its own: a large family is spread over tasks, no pair is sent as a row, and a
       unit returns links per member and enough edges to connect them.

    Texts are read three times and not shuffled; broadcast are at most a million tokens and two bitmaps of 8 MB. Tasks get ``ROWS``
    texts or sets at a time.
    Null and empty texts: size 0, linked with nothing. Null ids: an own row; they are linked through copies with an
    id only. Rows with one id are one document of several texts: all of them are reached from each other. An
    empty table gives no rows; other columns are not read."""
    with arrow_rows(docs.sparkSession, ROWS):
        return _link(docs, k, num, den)


def _link(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """:func:`link`, every task on texts run before it returns."""
    spark = docs.sparkSession
    rows = docs.select(c("doc_id").cast("bigint"), c("text").cast("string").alias("text"))
    low = int(min(1.0, 2 * (1 - num / den)) * (1 << 32)) - 1
    order = spark.sparkContext.broadcast(_token_order(rows, k, low))
    fields = "doc_id bigint, n bigint, d1 bigint, d2 bigint, pd bigint, tokens array<bigint>"
    docs_ = cut_lineage(rows.mapInArrow(lambda r: _prefixes(r, k, low, num, den, order), fields))
    same = docs_.filter("n > 0").groupBy("d1", "d2", "n", "pd")
    reps = cut_lineage(same.agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("tokens").alias("tokens")))
    named = reps.filter(c("rep").isNotNull())
    groups = named.groupBy("n", "pd").agg(F.min("rep").alias("gid"), F.count("*").alias("members"))
    members = cut_lineage(named.join(groups, ["n", "pd"]).select("rep", "d1", "d2", "n", "copies", "gid", "members", F.when(c("rep") == c("gid"), c("tokens")).alias("tokens")))
    posts = members.filter(c("tokens").isNotNull()).select(F.explode("tokens").alias("token"), "gid", "n")
    lists = posts.groupBy("token").agg(F.count("*").alias("m"), F.min("gid").alias("least")).filter("m > 1")
    posts = cut_lineage(posts.join(lists, "token"))
    family, long_tokens = _families(posts.filter(c("m") > SHORT))
    sized = members.filter(c("rep") == c("gid")).select("gid", "members").distinct()
    pairs = _pairs(posts.filter(c("m") <= SHORT), long_tokens, num, den)
    inside = sized.filter("members > 1").select(c("gid").alias("a"), c("gid").alias("b"))
    units = cut_lineage(_units(pairs.unionByName(inside), sized, family, members))
    blocks = members.select("rep", "d1", "d2", "copies", F.lit(0).alias("kind"), c("gid").alias("id"), _parts("members").alias("parts"))
    sizes = family.join(members, c("node") == c("gid")).groupBy("label").agg(F.count("*").alias("of"))
    in_family = members.join(family, c("node") == c("gid")).join(sizes, "label")
    blocks = blocks.unionByName(in_family.select("rep", "d1", "d2", "copies", F.lit(1).alias("kind"), c("label").alias("id"), _parts("of").alias("parts")))
    blocks = blocks.withColumn("blk", F.pmod(F.xxhash64("rep", "d1"), c("parts")).cast("int"))
    sides = units.select("unit", F.lit(0).alias("side"), "kind", c("a").alias("id"), c("ablk").alias("blk"))
    sides = sides.unionByName(units.filter(~c("own")).select("unit", F.lit(1).alias("side"), "kind", c("b").alias("id"), c("bblk").alias("blk")))
    placed = cut_lineage(blocks.join(sides, ["kind", "id", "blk"]).select("unit", "side", "rep", "d1", "d2", "copies"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP)).alias("slot")
    wanted = placed.select(c("rep").alias("doc_id")).distinct()
    shared = spark.sparkContext.broadcast(_bitmap(wanted.select(slot)))
    sets = rows.select("doc_id", "text", slot).mapInArrow(lambda r: _sets(r, k, shared), "rep bigint, d1 bigint, d2 bigint, tokens binary")
    full = placed.join(sets, ["rep", "d1", "d2"]).select("unit", "side", "rep", "d1", "copies", "tokens")
    full = full.repartition("unit").sortWithinPartitions("unit")
    links = cut_lineage(full.mapInArrow(lambda r: _verify(r, num, den), "node bigint, root bigint, links bigint"))
    ids = docs_.filter("n > 0").select("doc_id", "d1", "d2")
    again = ids.join(reps.select("d1", "d2", "rep"), ["d1", "d2"]).filter(c("doc_id") != c("rep"))
    twice = docs_.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    again = again.join(twice, "doc_id").select(c("doc_id").alias("a"), c("rep").alias("b"))
    edges = links.select(c("node").alias("a"), c("root").alias("b")).unionByName(again)
    component = connected_components(edges).groupBy("node").agg(F.min("label").alias("component"))
    degree = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = reps.select("d1", "d2", "rep", "copies").join(component, c("rep") == c("node"), "left").drop("node")
    found = found.join(degree, c("rep") == c("node"), "left").drop("node")
    component_id = F.coalesce("component", "rep", "doc_id")
    return docs_.select("doc_id", "n", "d1", "d2").join(found, ["d1", "d2"], "left").select(
        "doc_id",
        c("n").alias("n_shingles"),
        F.when(c("n") > 0, component_id).otherwise(c("doc_id")).alias("component_id"),
        F.when(c("n") > 0, c("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
    )


def _families(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of groups that hang together by tokens of many groups, and (gid, long): how many each has."""
    edges = long.select(c("gid").alias("a"), c("least").alias("b"))
    return cut_lineage(connected_components(edges)), long.groupBy("gid").agg(F.count("*").alias("long"))


def _pairs(short: DataFrame, long_tokens: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of groups whose shared prefix tokens leave a link possible.

    If x's prefix ends first, the sets share the counted tokens and at most what x has after its prefix. Tokens of
    many groups are not counted here, so as many as both have are added."""
    with_long = short.join(long_tokens, "gid", "left").select("token", F.struct("gid", "n", F.coalesce("long", F.lit(0)).alias("long")).alias("g"))
    lists = with_long.groupBy("token").agg(F.collect_list("g").alias("gs"))
    fits = lambda x, y: (x["gid"] < y["gid"]) & (den * F.least(x["n"], y["n"]) >= num * F.greatest(x["n"], y["n"]))
    both = lists.select(F.explode("gs").alias("x"), "gs").select("x", F.explode(F.filter("gs", lambda y: fits(c("x"), y))).alias("y"))
    shared = both.groupBy(
        c("x.gid").alias("a"), c("y.gid").alias("b"), c("x.n").alias("an"), c("y.n").alias("bn"), F.least("x.long", "y.long").alias("long")
    ).agg(F.count("*").alias("k"))
    need = F.ceil(num * (c("an") + c("bn")) / F.lit(num + den))
    after = lambda n: F.floor(c(n) * num / den + F.lit(0.999999)).cast("bigint") - 1
    return shared.filter(c("k") + c("long") + F.greatest(after("an"), after("bn")) + 1 >= need).select("a", "b")


def _units(pairs: DataFrame, sized: DataFrame, family: DataFrame, members: DataFrame) -> DataFrame:
    """(unit, kind, a, ablk, b, bblk, own): pairs of blocks to verify; kind 0 of groups, 1 of families. Pairs of groups
    within a family are left to the family."""
    one = family.select(c("node").alias("a"), c("label").alias("fa"))
    two = family.select(c("node").alias("b"), c("label").alias("fb"))
    apart = pairs.join(one, "a", "left").join(two, "b", "left").filter(c("fa").isNull() | c("fb").isNull() | (c("fa") != c("fb")))
    parts = sized.groupBy("gid").agg(F.max(_parts("members")).alias("parts"))
    sides = apart.join(parts.select(c("gid").alias("a"), c("parts").alias("ap")), "a").join(parts.select(c("gid").alias("b"), c("parts").alias("bp")), "b")
    steps = lambda n, start: F.explode(F.sequence(start, c(n) - 1))
    by_group = sides.select("a", "b", "bp", steps("ap", F.lit(0)).alias("ablk")).select(
        F.lit(0).alias("kind"), "a", "b", "ablk", steps("bp", F.when(c("a") == c("b"), c("ablk")).otherwise(0)).alias("bblk")
    )
    whole = family.join(members, c("node") == c("gid")).groupBy("label").agg(_parts_of_count().alias("parts"))
    by_family = whole.select("label", "parts", steps("parts", F.lit(0)).alias("ablk")).select(
        F.lit(1).alias("kind"), c("label").alias("a"), c("label").alias("b"), "ablk", steps("parts", c("ablk")).alias("bblk")
    )
    both = by_group.unionByName(by_family)
    return both.withColumn("own", (c("a") == c("b")) & (c("ablk") == c("bblk"))).withColumn("unit", F.xxhash64("kind", "a", "ablk", "b", "bblk"))


def _parts_of_count() -> Column:
    return F.ceil(F.count("*") / BLOCK).cast("int")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents with one row per component: that of the least doc_id. Rows with one id count as one document: of
    different texts under one id the one that stays is, in this order, not empty, of the least hash, the least; the
    others go, near duplicates or not. Rows without an id all stay."""
    found = link(docs, k, num, den)
    spare = found.filter((c("n_shingles") > 0) & (c("doc_id") != c("component_id"))).select("doc_id").distinct()
    numbered = docs.filter(c("doc_id").isNotNull())
    rank = Window.partitionBy("doc_id").orderBy(F.coalesce(F.trim("text"), F.lit("")) == "", F.xxhash64("text"), "text")
    rest = numbered.join(spare, "doc_id", "left_anti").withColumn("__n", F.row_number().over(rank)).filter("__n = 1")
    return rest.select(docs.columns).unionByName(docs.filter(c("doc_id").isNull()))
