"""Main text of web pages by consensus of the pages of a host."""

from __future__ import annotations

import hashlib
import heapq
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from concordat.llm.common import batches
from concordat.session import cut_lineage

c = F.col
SALTS = 32

# Element names of HTML, and words in class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg math object canvas textarea title xmp noframes audio video".split())
SKIP = frozenset("nav header footer aside form button select fieldset dialog menu head label datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("article main section div td body blockquote".split())
MARKED = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead topbar "
    "footer bottombar comment comments commentlist disqus respond replies reply share sharing social related recommended newsletter "
    "subscribe signup login search pagination pager widget complementary contentinfo form dialog hidden skip toolbar".split()
)
# Elements that never hold an article, and words and elements for what may be longer than the article.
NEVER = frozenset("head button select label datalist".split())
APART = frozenset(
    "comment comments commentlist disqus respond reply replies cookie cookies consent gdpr popup modal overlay dialog complementary contentinfo "
    "nav aside footer menu related recommended".split()
)
# An open element ends where one of these opens.
ENDS = {
    "p": BLOCK - {"html", "body"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "tr": {"tr", "tbody", "tfoot"},
    "head": {"body"},
}
ENDS |= dict.fromkeys(("h1", "h2", "h3", "h4", "h5", "h6"), frozenset(("h1", "h2", "h3", "h4", "h5", "h6", "article", "footer", "nav")))
# What a forgotten end tag must not reach over.
WALL = frozenset(("table", "ul", "ol", "dl", "article", "section", "div", "body", "main", "td", "blockquote", "nav", "aside", "footer", "header"))

TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")
ARTICLE = re.compile(r"(?:article|main)\b")
PART = re.compile(r"(?:section|td|blockquote)\b")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _marks(name: str, attributes: str) -> tuple[str, frozenset[str], bool]:
    """The element's part of a generalised path, the words that mark it as not the article, and whether it is hidden."""
    if not attributes or attributes.isspace():
        return name, frozenset(), False
    a: dict[str, str] = {}
    for k, x, y, z in ATTR.findall(attributes):
        a.setdefault(k.lower(), html.unescape(x or y or z))
    classes = sorted(set(a.get("class", "").split()))
    said = " ".join([*classes, a.get("id", ""), a.get("role", "")])
    words = {w.lower() for w in PARTS.findall(said)} | set(said.lower().split())
    step = ".".join([name, *dict.fromkeys(re.sub(r"\d+", "#", x.lower()) for x in classes)])
    return step, MARKED & words, a.get("aria-hidden") == "true" or "hidden" in a


LONGEST = 512  # characters of a path; what is longer begins with a digest of the part further out


def _path(above: str, step: str) -> str:
    path = f"{above}/{step}"
    return path if len(path) <= LONGEST else f"~{hashlib.blake2b(above.encode(), digest_size=16).hexdigest()}/{step}"


@dataclass
class Mark:
    """An element whose name or attributes say that it is not the article: its path, whether such elements may be
    longer than the article, the marked element around it, and the characters outside links in it: all, and those in
    an article or main element."""

    path: str
    apart: bool
    above: int
    size: int = 0
    told: int = 0


@dataclass
class Box:
    """A container: its path, the container around it, and the number of elements around it."""

    path: str
    above: int
    depth: int
    article: bool
    part: bool


class Open(NamedTuple):
    """An open element. ``box``, ``mark``: the nearest container that counts and the nearest marked element (-1: none) here
    or further out; ``told``: the nearest marked element around the nearest article; ``out``: hidden, ``off``: left out;
    ``p``, ``wall``: places of the nearest open paragraph before a wall, and of the nearest wall."""

    name: str
    path: str
    box: int
    off: bool
    out: bool
    mark: int
    told: int | None
    p: int
    wall: int


NOTHING = Open("", "", -1, False, False, -1, None, -1, -1)


class Page:
    """Blocks of a page in order, each with the container around it; what is not the article has none.

    Marked elements (MARKED, SKIP) are left out, but for those that hold the article after all (``_overruled``): then
    the page is read again without their marks. Hidden elements are always left out. Containers and marks point to the
    ones around them and sums go up once, so that the work is linear in the page however deep it is nested."""

    def __init__(self, source: str):
        self._kept: frozenset[int] = frozenset()
        self._read(source)
        if kept := self._overruled():
            self._kept = kept
            self._read(source)

    def _read(self, source: str) -> None:
        self.blocks: list[tuple[str, int, int]] = []
        self.boxes: list[Box] = []
        self._marked: list[Mark] = []
        self._free = self._told = self._size = 0
        self._stack: list[Open] = []
        self._places: dict[str, list[int]] = defaultdict(list)
        self._text: list[str] = []
        self._linked = 0
        at, links = 0, 0
        for m in iter(lambda: TAG.search(source, at), None):
            if m.start() > at:
                self._add(source[at : m.start()], links)
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                links = max(0, links - (name == "a"))
                self._close(name)
                continue
            if name in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            links += name == "a"
            self._open(name, m[3])
        if at < len(source):
            self._add(source[at:], links)
        self._flush()
        for mark in reversed(self._marked):
            if mark.above >= 0:
                self._marked[mark.above].size += mark.size
                self._marked[mark.above].told += mark.told

    def _top(self) -> Open:
        return self._stack[-1] if self._stack else NOTHING

    def _add(self, text: str, links: int) -> None:
        above = self._top()
        if not self._kept and not links and not above.out:
            size = len(text.strip())
            self._size += size
            self._free += 0 if above.off else size
            self._told += size if above.told is not None else 0
            if above.mark >= 0:
                self._marked[above.mark].size += size
            if above.told is not None and above.told >= 0:
                self._marked[above.told].told += size
        if above.off:
            return
        self._text.append(text)
        if links:
            self._linked += len(text)

    def _overruled(self) -> frozenset[int]:
        """Marked elements that hold the article: most of the page's characters outside links (of those that may be
        longer than the article, only where hardly anything is left without them), or most of its article and main
        elements and a fourth of all. Elements with one path count together, as the articles of a list."""
        sizes: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for m in self._marked:
            sizes[m.path][0] += m.size
            sizes[m.path][1] += m.told
        kept = set()
        for k, m in enumerate(self._marked):
            size, told = sizes[m.path]
            most = 2 * size > self._size and (20 * self._free < size if m.apart else 2 * (self._told - told) <= size)
            if most or (2 * told > self._told and 4 * told >= self._size):
                kept.add(k)
        return frozenset(kept)

    def _flush(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self._text))).strip()
        if text:
            self.blocks.append((text, min(self._linked, len(text)), self._top().box))
        self._text.clear()
        self._linked = 0

    def _cut(self, k: int) -> None:
        """Close the open elements from place ``k`` on."""
        for gone in reversed(self._stack[k:]):
            self._places[gone.name].pop()
        del self._stack[k:]

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            while self._stack and name in ENDS.get(self._stack[-1].name, ()):
                self._cut(len(self._stack) - 1)
            if name in ENDS["p"] and self._top().p >= 0:
                self._cut(self._top().p)
        elif name == "br":
            self._text.append(" ")
        if name in VOID:
            return
        step, words, hidden = _marks(name, attributes)
        above, here = self._top(), len(self._stack)
        path, box, off, out, mark, told = _path(above.path, step), above.box, above.off, above.out, above.mark, above.told
        if name in ("html", "body"):
            words = frozenset()
        if hidden and name not in ("html", "body") or name in NEVER or out:
            off, out, mark, told = True, True, -1, None
        else:
            if words or name in SKIP:
                k = len(self._marked)
                self._marked.append(Mark(path, bool(words & APART) or name in APART, mark))
                off, mark = off or k not in self._kept, k
            # An article, if it is not marked as a comment or the like, counts for itself and the marked elements around it.
            if name in ("article", "main") and not words & APART:
                told = mark
        if name in CONTAINER and not off:
            self.boxes.append(Box(path, box, here, bool(ARTICLE.match(step)), bool(PART.match(step))))
            box = len(self.boxes) - 1
        wall = name in WALL
        p = here if name == "p" else -1 if wall else above.p
        self._stack.append(Open(name, path, box, off, out, mark, told, p, here if wall else above.wall))
        self._places[name].append(here)

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self._flush()
        places = self._places.get(name)
        if places and (name in BLOCK or places[-1] >= self._top().wall):
            self._cut(places[-1])

    def scores(self) -> dict[str, float]:
        """Per path: characters outside links, all of them for the nearest container of a block and half as many for
        each one further out; an article or main element counts a little more."""
        own = [0.0] * len(self.boxes)
        for text, linked, box in self.blocks:
            if box >= 0:
                own[box] += len(text) - linked
        held = {box for _, _, box in self.blocks}
        found: dict[str, float] = defaultdict(float)
        for k in range(len(self.boxes) - 1, -1, -1):
            b = self.boxes[k]
            if k in held:
                found[b.path] += own[k] * (1.2 if b.article else 1.0)
                if b.above >= 0:
                    own[b.above] += own[k] / 2
                    held.add(b.above)
        return found

    def best(self) -> str | None:
        found = self.scores()
        return min(found, key=lambda p: (-found[p], p)) if found else None

    def _within(self, chosen: set[int]) -> list[bool]:
        """Per container: is it one of the chosen, or in one?"""
        inside: list[bool] = []
        for k, b in enumerate(self.boxes):
            inside.append(k in chosen or (b.above >= 0 and inside[b.above]))
        return inside

    def _sums(self) -> tuple[list[int], list[int]]:
        """Per container: characters in it, and those outside links that count as its own (in it, or in sections, cells
        and quotations of it)."""
        size, own = [0] * len(self.boxes), [0] * len(self.boxes)
        for text, linked, box in self.blocks:
            if box >= 0:
                size[box] += len(text)
                own[box] += len(text) - linked
        for k in range(len(self.boxes) - 1, -1, -1):
            b = self.boxes[k]
            if b.above >= 0:
                size[b.above] += size[k]
                own[b.above] += own[k] if b.part else 0
        return size, own

    def _lifted(self, path: str) -> set[int]:
        """Containers of a path, or of one further out that holds the whole article: the nearest article or main
        element, or else what has, besides the path, mostly text of its own outside links (a title, a lead, paragraphs
        around a nested body; parts of it in sections, cells and quotations count as its own)."""
        boxes = {k for k, b in enumerate(self.boxes) if b.path == path}
        inside = self._within(boxes)
        if not any(box >= 0 and inside[box] for _, _, box in self.blocks) or self.boxes[min(boxes)].article:
            return boxes
        count: list[int] = []
        for b in self.boxes:
            count.append(count[b.above] + 1 if b.above >= 0 else 0)
        filled, chain = self._filled(), []
        at = self.boxes[max((k for k in boxes if filled[k]), key=lambda k: (count[k], -k))].above
        while at >= 0:
            chain.append(at)
            at = self.boxes[at].above
        above = list(dict.fromkeys(self.boxes[k].path for k in chain))
        by_path: dict[str, list[int]] = defaultdict(list)
        for k, b in enumerate(self.boxes):
            by_path[b.path].append(k)
        if nearest := next((self.boxes[k].path for k in chain if self.boxes[k].article), None):
            return set(by_path[nearest])
        size, own = self._sums()
        # What the chosen containers hold, carried up to the level that is looked at: characters, and those counted as own.
        carried = {k: (size[k], own[k]) for k in boxes}
        for outer in above:
            wider, depth = by_path[outer], self.boxes[by_path[outer][0]].depth
            lifted: dict[int, tuple[int, int]] = {}
            for k in sorted(carried, reverse=True):
                if self.boxes[k].depth <= depth:
                    lifted[k] = carried[k]
            carried = self._carry({k: v for k, v in carried.items() if self.boxes[k].depth > depth}, lifted, depth)
            rest = sum(size[k] - carried.get(k, (0, 0))[0] for k in wider)
            if 2 * sum(own[k] - carried.get(k, (0, 0))[1] for k in wider) > rest:
                boxes = set(wider)
                carried = {k: (size[k], own[k]) for k in wider}
        return boxes

    def _filled(self) -> list[bool]:
        """Per container: does it hold a block?"""
        filled = [False] * len(self.boxes)
        for _, _, box in self.blocks:
            if box >= 0:
                filled[box] = True
        for k in range(len(self.boxes) - 1, -1, -1):
            if filled[k] and self.boxes[k].above >= 0:
                filled[self.boxes[k].above] = True
        return filled

    def _carry(self, deep: dict[int, tuple[int, int]], to: dict[int, tuple[int, int]], depth: int) -> dict[int, tuple[int, int]]:
        """Sums of ``deep`` containers added up in those at ``depth`` or further out."""
        todo = [-k for k in deep]
        heapq.heapify(todo)
        while todo:
            k = -heapq.heappop(todo)
            size, own = deep.pop(k)
            b = self.boxes[k]
            if b.above < 0:
                continue
            target = deep if self.boxes[b.above].depth > depth else to
            if target is deep and b.above not in deep:
                heapq.heappush(todo, -b.above)
            old = target.get(b.above, (0, 0))
            target[b.above] = old[0] + size, old[1] + (own if b.part else 0)
        return to

    def text(self, winner: str | None) -> str:
        """Blocks within the winning path, or within the page's own best container where it has none of them; either
        is widened to the whole article."""
        for path in (winner, self.best()):
            inside = self._within(self._lifted(path)) if path else []
            if kept := [t for t, _, box in self.blocks if box >= 0 and inside and inside[box]]:
                return "\n".join(kept)
        return "\n".join(t for t, _, _ in self.blocks)


def _votes(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, votes): a page gives 1000 votes to its best container and the others their part of that."""
    for batch in batches(rows, 10_000):
        total: dict[tuple[str, str], int] = defaultdict(int)
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = Page(source).scores() if source else {}
            top = max(found.values(), default=0)
            for path, score in found.items() if top else ():
                total[host, path] += round(1000 * score / top)
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())],
            names=["host", "path", "votes"],
        )


def host_of(url: Column) -> Column:
    """Lower-case host without port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, winner): the path with the most votes of a host's pages; ties go to the lesser path. Votes are added up
    in the tasks that read the pages, so a host with a third of all pages sends few rows."""
    votes = pages.select(host_of(c("url")).alias("host"), c("html").cast("string")).mapInArrow(_votes, "host string, path string, votes bigint")
    summed = votes.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    first = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), "path"))
    return summed.withColumn("_n", first).filter(c("_n") == 1).select("host", c("path").alias("winner"))


def extract(pages: DataFrame, out: str = "text") -> DataFrame:
    """Pages (url, html) with the main text in ``out``.

    First every page scores its containers, then the pages of a host vote, then each page is read again with the
    winning path of its host. The winners are written first, so Spark knows their size: it broadcasts them while
    they are small, and else joins them by host and one of 32 salts, which keeps a large host spread.

    Blocks are joined by line feeds in page order; white space inside a block is one space; character references are
    decoded. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go; an
    element that is named like one of them but holds the article stays. Null
    or empty html gives an empty text; pages without a host vote together. Other columns pass through."""

    @arrow_udf("string")
    def main_text(source: pa.Array, winner: pa.Array) -> pa.Array:
        rows = zip(source.to_pylist(), winner.to_pylist(), strict=True)
        return pa.array([Page(s).text(w) if s else "" for s, w in rows], pa.string())

    winners = cut_lineage(winning_paths(pages)).select(
        c("host").alias("__host"), "winner", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    )
    keyed = pages.withColumn("__host", host_of(c("url"))).withColumn("__salt", F.pmod(F.xxhash64("html", "url"), F.lit(SALTS)).cast("int"))
    joined = keyed.join(winners.withColumnRenamed("winner", "__winner"), ["__host", "__salt"], "left")
    return joined.withColumn(out, main_text(c("html").cast("string"), "__winner")).drop("__host", "__salt", "__winner")


def report(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    done = extract(pages.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
