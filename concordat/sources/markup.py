"""Nested page markup and rich-text trees to lines, in one pass over a document."""

from __future__ import annotations

import html
import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

HEADINGS = {f"h{n}" for n in range(1, 7)}
VOID = {"br", "hr", "img", "input", "meta", "link", "col", "area", "base", "embed", "source", "track", "wbr"}
SKIPPED = {"script", "style", "template", "noscript", "ac:parameter"}
BLOCKS = HEADINGS | {"p", "ul", "ol", "table", "pre", "blockquote", "div", "section", "article", "main", "header", "footer", "nav", "aside", "form"}
INLINE = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
SIGNS = {"strong": "**", "em": "*", "code": "`"}
CAPTURED = HEADINGS | {"p", "li", "td", "th", "blockquote", "pre"}
CDATA = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
SPACE = re.compile(r"\s+")


@dataclass
class Frame:
    """An open element. ``buf`` is the text that it adds to: its own, or that of an element around it; ``inline``: what it
    holds is running text; ``items`` or ``rows``: of a list or table; ``quiet``: its text does not count."""

    tag: str
    buf: list[str]
    own: bool = False
    inline: bool = False
    quiet: bool = False
    href: str = ""
    items: list[str] | None = None
    rows: list[list[str]] | None = None
    row: list[str] | None = None
    macro: str | None = None
    params: dict[str, str] = field(default_factory=dict)


class Lines(HTMLParser):
    """Lines (kind, text) of a page: headings, paragraphs, list items, table rows, quotations and code.

    What stands in a block is one running text, whatever is nested in it: a list in an item is part of the item's line, a
    table in a cell part of the cell, and its rows follow the row as rows of the table. Bold, emphasis, code, links and
    line breaks keep their signs; macros are code, a ticket or what they hold."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.loose: list[str] = []
        self.stack = [Frame("", self.loose)]
        self.feed(CDATA.sub(lambda m: html.escape(m[1]), source))
        self.close()
        while len(self.stack) > 1:
            self._end()
        self._flush()

    def _flush(self) -> None:
        if text := "".join(self.loose).strip():
            self.lines.append(("text", text))
        self.loose.clear()

    def _line(self, kind: str, text: str) -> None:
        self._flush()
        if text.strip():
            self.lines.append((kind, text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("li", "p") or tag in BLOCKS:
            self._implied(tag)
        top = self.stack[-1]
        if tag == "br" and not top.quiet:
            top.buf.append("  \n" if top.inline else " ")
        if tag in VOID:
            return
        given = {k: v or "" for k, v in attrs}
        f = Frame(tag, top.buf, inline=top.inline, quiet=top.quiet or tag in SKIPPED, row=top.row)
        if tag == "ac:structured-macro":
            f.macro = given.get("ac:name", "").lower()
            f.quiet = f.quiet or f.macro in ("code", "jira")
        elif tag in ("ac:parameter", "ac:plain-text-body"):
            f.buf, f.own, f.macro, f.href = [], True, None, given.get("ac:name", "").lower()
        elif not top.inline and not f.quiet:
            if tag in ("ul", "ol"):
                self._flush()
                f.items, f.buf, f.own, f.inline = [], [], True, False
            elif tag == "table":
                self._flush()
                f.rows, f.buf, f.own = [], [], True
            elif top.items is not None or tag in CAPTURED:
                f.buf, f.own, f.inline = [], True, True
        elif tag in INLINE or tag == "a" or tag in ("td", "th"):
            f.buf, f.own, f.href = [], True, given.get("href", "")
        if tag == "tr":
            table = next((x for x in self.stack if x.rows is not None), None)
            if table:
                f.row = []
                table.rows.append(f.row)
        self.stack.append(f)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.tag in ("ac:parameter", "ac:plain-text-body", "pre"):
            top.buf.append(data)
        elif not top.quiet and top.items is None and top.rows is None:
            top.buf.append(SPACE.sub(" ", data))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                while len(self.stack) > k:
                    self._end()
                return
            if self.stack[k].tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "table", "td", "th"):
                return

    def _implied(self, tag: str) -> None:
        """End tags that were left out: of a paragraph before a block, of an item before the next one."""
        if tag == "li":
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in ("ul", "ol"):
                    return
                if self.stack[k].tag == "li":
                    while len(self.stack) > k:
                        self._end()
                    return
        elif self.stack[-1].tag == "p":
            self._end()

    def _end(self) -> None:
        f = self.stack.pop()
        above = self.stack[-1]
        text = "".join(f.buf) if f.own else ""
        if f.tag == "ac:parameter" or f.tag == "ac:plain-text-body":
            holder = next((x for x in reversed(self.stack) if x.macro is not None), None)
            if holder:
                holder.params["body" if f.tag == "ac:plain-text-body" else f.href] = text
        elif f.macro is not None:
            self._macro(f, above)
        elif f.quiet:
            return
        elif f.items is not None:
            for i, item in enumerate(f.items):
                self._line("item", f"- {item}" if f.tag == "ul" else f"{i + 1}. {item}")
        elif f.rows is not None:
            head = True
            for row in f.rows:
                if row:
                    self._line("row", "| " + " | ".join(row) + " |")
                    if head:
                        self._line("row", "|" + " --- |" * len(row))
                    head = False
        elif f.own and not above.inline:
            if above.items is not None:
                above.items.append(text.strip())
            elif f.tag in ("td", "th") and f.row is not None:
                f.row.append(text.strip().replace("\n", " "))
            elif f.tag in HEADINGS:
                self._line("heading", "#" * int(f.tag[1]) + " " + text.strip())
            elif f.tag == "pre":
                self._line("code", "```\n" + text.strip("\n") + "\n```")
            elif f.tag == "blockquote":
                self._line("quote", "> " + text.strip().replace("\n", "\n> "))
            else:
                self._line("text", text.strip())
        elif f.own:
            if f.tag in ("td", "th"):
                if f.row is not None:
                    f.row.append(text.strip().replace("\n", " "))
                above.buf.append(text)
            elif f.tag == "a":
                above.buf.append(f"[{text.strip()}]({f.href})")
            else:
                above.buf.append(INLINE[f.tag] + text.strip() + INLINE[f.tag])

    def _macro(self, f: Frame, above: Frame) -> None:
        if above.quiet or f.macro not in ("code", "jira"):
            return
        if f.macro == "jira":
            if f.params.get("key"):
                above.buf.append(f"JIRA:{f.params['key']} ")
            return
        code = f"```{f.params.get('language', '')}\n{f.params.get('body', '').strip()}\n```"
        if above.inline:
            above.buf.append(code)
        else:
            self._line("code", code)


def adf_lines(source: str | None) -> list[tuple[str, str]]:
    """Lines (kind, text) of a rich-text tree as JSON text, in one walk; none for what is not a JSON object.

    An item holds all its blocks, nested lists on lines of their own; a cell holds its blocks in one line."""
    try:
        doc = json.loads(source or "null")
    except ValueError:
        return []
    return [x for x in _blocks(doc) if x[1].strip()] if isinstance(doc, dict) else []


def _nodes(node: dict) -> list[dict]:
    content = node.get("content")
    return [n for n in content if isinstance(n, dict)] if isinstance(content, list) else []


def _attr(node: dict, name: str):
    attrs = node.get("attrs")
    return attrs.get(name) if isinstance(attrs, dict) else None


def _joined(lines: list[tuple[str, str]]) -> str:
    """Blocks as running markdown: a blank line behind each, but between the lines of one list or table."""
    out = ""
    for k, (kind, text) in enumerate(lines):
        out += text + ("\n" if kind in ("listItem", "tableRow") and k + 1 < len(lines) and lines[k + 1][0] == kind else "\n\n")
    return out.strip()


def _blocks(node: dict) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for n in _nodes(node):
        kind = n.get("type")
        if kind == "heading":
            level = _attr(n, "level")
            out.append((kind, "#" * min(6, max(1, level if isinstance(level, int) else 1)) + " " + _inline(n)))
        elif kind == "paragraph":
            out.append((kind, _inline(n)))
        elif kind in ("bulletList", "orderedList"):
            for i, item in enumerate(_nodes(n)):
                out.append(("listItem", ("- " if kind == "bulletList" else f"{i + 1}. ") + _joined(_blocks(item)).replace("\n\n", "\n")))
        elif kind == "codeBlock":
            out.append((kind, f"```{_attr(n, 'language') or ''}\n{_inline(n)}\n```"))
        elif kind == "blockquote":
            out.append((kind, "> " + _joined(_blocks(n)).replace("\n", "\n> ")))
        elif kind == "rule":
            out.append((kind, "---"))
        elif kind == "table":
            for i, row in enumerate(_nodes(n)):
                cells = [_joined(_blocks(cell)).replace("\n", " ") for cell in _nodes(row)]
                out.append(("tableRow", "| " + " | ".join(cells) + " |"))
                if i == 0:
                    out.append(("tableRow", "|" + " --- |" * len(cells)))
        elif "content" in n:
            out += _blocks(n)
        elif "text" in n:
            out.append(("paragraph", _inline({"content": [n]})))
    return out


def _inline(node: dict) -> str:
    out = []
    for n in _nodes(node):
        kind = n.get("type")
        if kind == "text":
            text = str(n.get("text") or "")
            for mark in n.get("marks") or ():
                sign = mark.get("type") if isinstance(mark, dict) else None
                text = f"[{text}]({_attr(mark, 'href') or ''})" if sign == "link" else SIGNS.get(sign, "") + text + SIGNS.get(sign, "")
            out.append(text)
        elif kind == "hardBreak":
            out.append("  \n")
        elif kind == "mention":
            said = _attr(n, "text")
            out.append("@" + str(said if said is not None else _attr(n, "id") or ""))
        elif kind == "emoji":
            out.append(str(_attr(n, "text") or ""))
        elif "content" in n:
            out.append(_inline(n))
        else:
            out.append(str(n.get("text") or ""))
    return "".join(out)
