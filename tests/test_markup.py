"""Nested markup and rich text to lines."""

import json

import pytest

from concordat.sources.markup import Lines, adf_lines
from concordat.sources.tracker import adf_to_lines
from concordat.sources.wiki import pages_to_lines

PAGES = [
    ("<h2>A <b>x</b></h2><p>t &amp; <em>e</em><br/>q</p>", [("heading", "## A **x**"), ("text", "t & *e*  \nq")]),
    ("<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul><ol><li>one</li><li><p>two</p></li></ol>", [("item", "- abc"), ("item", "- d"), ("item", "1. one"), ("item", "2. two")]),
    ("<table><tr><th>H</th></tr><tr><td>x<table><tr><td>in</td></tr></table></td><td>y<br>z</td></tr></table>", [("row", "| H |"), ("row", "| --- |"), ("row", "| xin | y   z |"), ("row", "| in |")]),
    ("loose <div>inside <a href='u'>l</a></div><blockquote>q<br/>r</blockquote><pre>a\n  b</pre>", [("text", "loose inside l"), ("quote", "> q  \n> r"), ("code", "```\na\n  b\n```")]),
    (
        '<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">java</ac:parameter><ac:plain-text-body><![CDATA[if (a < b && c > d) {}]]></ac:plain-text-body></ac:structured-macro>'
        '<ac:structured-macro ac:name="info"><ac:rich-text-body><p>note <ac:structured-macro ac:name="jira"><ac:parameter ac:name="key">K-1</ac:parameter></ac:structured-macro></p></ac:rich-text-body></ac:structured-macro>',
        [("code", "```java\nif (a < b && c > d) {}\n```"), ("text", "note JIRA:K-1")],
    ),
    ("<p>a<p>b<ul><li>x<li>y</ul><script>s<t</script>", [("text", "a"), ("text", "b"), ("item", "- x"), ("item", "- y")]),
    ("", []),
    ("<b>" * 5000 + "deep", [("text", "deep")]),
]


@pytest.mark.parametrize(("source", "lines"), PAGES)
def test_pages(source, lines):
    assert Lines(source).lines == lines


def test_trees():
    text = lambda t, *marks: {"type": "text", "text": t, "marks": list(marks)}
    para = lambda *x: {"type": "paragraph", "content": list(x)}
    item = lambda *x: {"type": "listItem", "content": list(x)}
    sub = {"type": "orderedList", "content": [item(para(text("s1"))), item(para(text("s2")))]}
    doc = {"type": "doc", "content": [
        {"type": "heading", "attrs": {"level": 9}, "content": [text("H")]}, para(text("b", {"type": "strong"}), text("l", {"type": "link", "attrs": {"href": "u"}}), {"type": "hardBreak"}, {"type": "mention", "attrs": {"id": "i"}}),
        {"type": "bulletList", "content": [item(para(text("one")), sub, para(text("after"))), item(para(text("two")))]}, {"type": "blockquote", "content": [para(text("q")), para(text("r"))]},
        {"type": "codeBlock", "attrs": {"language": "sql"}, "content": [text("select 1")]}, {"type": "rule"}, {"type": "panel", "content": [para(text("p"))]}, para(), "odd", None,
    ]}
    assert adf_lines(json.dumps(doc)) == [
        ("heading", "###### H"), ("paragraph", "**b**[l](u)  \n@i"), ("listItem", "- one\n1. s1\n2. s2\nafter"), ("listItem", "- two"), ("blockquote", "> q\n> \n> r"),
        ("codeBlock", "```sql\nselect 1\n```"), ("rule", "---"), ("paragraph", "p"),
    ]
    assert adf_lines(None) == adf_lines("{") == adf_lines("[]") == adf_lines('{"content": 5}') == []


def test_frames(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><p>b</p>", "x"), (2, None, "y"), (None, "c", "z")], "page_id long, html string, pos string")
    assert sorted((r.page_id or 0, r.pos, r.text) for r in pages_to_lines(pages).collect()) == [(0, 0, "c"), (1, 0, "a"), (1, 1, "b")]
    assert pages_to_lines(pages.limit(0)).collect() == []
    trees = spark.createDataFrame([("k", '{"content":[{"type":"rule"},{"type":"rule"}]}'), ("l", "no"), ("m", None)], "key string, adf string")
    assert sorted((r.key, r.ord, r.text) for r in adf_to_lines(trees).collect()) == [("k", 0, "---"), ("k", 1, "---")]
