"""Main text: markup cases with known texts, and a host's consensus over a page that would go wrong alone."""

from concordat.llm.html_main import Page, extract, report

SCHEMA = "page_id long, url string, html string, text string, winner string"
LONG = "Some long sentence of the article goes here, with enough words to count."


def page(body):
    return f"<!DOCTYPE html><html lang='en'><head><title>A < b</title><style>p{{}}</style></head><body class='v12'>{body}</body></html>"


def main(body):
    return Page(page(body)).text(None)


def test_blocks_and_references():
    body = f"<nav><a href=/>Home</a></nav><article><h1>Caf&eacute; &amp; co</h1><p>{LONG}\n\n  more&nbsp;<b>bold</b>text<p>Second &#x41;&#66;<br>line</article><footer>&copy; x</footer>"
    assert main(body) == f"Café & co\n{LONG} more boldtext\nSecond AB line"


def test_what_goes():
    off = [
        "<header>top</header>", "<aside>side</aside>", "<div class='ad'>buy</div>", "<div id=cookie-notice>ok?</div>", "<form>f<input></form>",
        "<script>var t='<p>no</p>';</script>", "<!-- <p>no</p> -->", "<div class='post-comments'><p>nice</p></div>", "<div role='navigation'>n</div>",
        "<div hidden>h</div>", "<section class='relatedPosts'><p>r</p></section>", "<noscript>js</noscript>", "<template><p>t</p></template>",
    ]
    for x in off:
        assert main(f"{x}<article><p>{LONG}</p>{x}<p>End.</p></article>{x}") == f"{LONG}\nEnd.", x
    assert main(f"<article><p>{LONG}</p><p>an advanced adverb, header words</p></article>").endswith("words")


def test_the_whole_article():
    """A nested container that is denser than the article does not take its place."""
    long, lead = "\n".join([LONG] * 30), f"Lead. {LONG}"
    many = f"<p>{LONG}</p>" * 30
    nested = [
        f"<h1>T</h1><p>{lead}</p><div class=body>{many}</div>", f"<h1>T</h1><p>{lead}</p><section class=a>{many}</section>",
        f"<h1>T</h1><p>{lead}</p><table><tr><td>{many}</td></tr></table>", f"<h1>T</h1><p>{lead}</p><blockquote>{many}</blockquote>",
    ]
    for x in nested:
        for outer in ("article", "main", "div class=post"):
            body = f"<nav><a href=/>Home</a></nav><div class=links><a href=/x>{LONG}</a></div><{outer}>{x}</{outer.split()[0]}><footer>f</footer>"
            assert main(body) == f"T\n{lead}\n{long}", body[:200]
    sections = "".join(f"<section class=s{k}x><h2>H{k}</h2><p>{LONG}</p></section>" for k in "abc")
    assert main(f"<article><h1>T</h1>{sections}</article>") == "\n".join(["T", *(f"H{k}\n{LONG}" for k in "abc")])
    assert Page(page(f"<article><h1>T</h1><p>{lead}</p><blockquote>{LONG}</blockquote></article>")).text("/html/body.v#/article/blockquote") == f"T\n{lead}\n{LONG}"
    assert main(f"<div class=wrap><div class=post>{many}</div><div class=box><p>{LONG}</p></div></div>") == long


def test_marks_that_the_article_overrules():
    long = "\n".join([LONG] * 5)
    many = f"<p>{LONG}</p>" * 5
    for outer in ("div class='content has-sidebar'", "div class=no-sidebar", "div class='page-with-ads'", "article class='post share-enabled'", "form action=/", "div title='the hidden valley'", "section data-x='a hidden b'"):
        name = outer.split()[0]
        assert main(f"<nav><a href=/>Home</a></nav><{outer}>{many}<div class=sidebar>side</div><div class='ad'>buy</div></{name}><footer>f</footer>") == long, outer
        assert main(f"<{outer}><article>{many}</article><div class=share>s</div></{name}>") == long, outer
    assert main(f"<article class='post share-enabled'>{many}</article>" * 3) == "\n".join([long] * 3)
    assert main(f"<article><p>{LONG}</p></article><div id=comments>{many}</div>") == LONG
    assert main(f"<div class=content><p>{LONG}</p></div><div id=comments>{many}</div><div id=cookie-consent>{many}</div>") == LONG
    assert main(f"<article>{many}</article><div class=related><article>{LONG}</article></div>") == long
    assert main(f"<article><p>{LONG}</p></article><div hidden>{many}</div><div hidden=''>{many}</div><div HIDDEN id=x>{many}</div>") == LONG


def test_broken_markup():
    assert main(f"<article><p><b>{LONG}<br><p>Next</b> one</article>") == f"{LONG}\nNext one"
    assert main(f"<div><p>{LONG}</div></p></span><p>after") == LONG or LONG in main(f"<div><p>{LONG}</div></p></span><p>after")
    assert Page("").text(None) == "" and Page("plain < text > only").text(None).startswith("plain")
    assert Page("<p>a<script>never closed").text(None) == "a" and Page("<!-- never closed").text(None) == ""
    assert main("<ul><li>one<li>two</ul>") == "one\ntwo"
    assert Page("<p>" + "<b>" * 3000 + "deep").text(None) == "deep"


def test_consensus(spark):
    story = lambda k: page(f"<div class='post-{k}'><p>{LONG}</p><p>{LONG} {k}</p></div><div class='box'><p>short {k}</p></div>")
    odd = page(f"<div class='post-9'><p>Brief.</p></div><div class='box'><p>{LONG}</p><p>{LONG}</p></div>")
    rows = [(k, f"http://A.example:80/{k}", story(k), "x", None) for k in range(6)]
    rows += [(9, "https://a.example/9", odd, None, None), (10, None, None, None, None), (11, "mailto:x", "", None, None), (12, "//b.example", odd, None, "w"), rows[0]]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in report(pages).collect()}
    assert got[9].text == "Brief." and got[12].text == f"{LONG}\n{LONG}"
    assert got[10].text == got[11].text == "" and got[10].n_chars == 0
    assert got[3].text == f"{LONG}\n{LONG} 3" and got[3].n_chars == len(got[3].text)
    assert report(pages).count() == len(rows)
    assert extract(pages, "out").columns == [*pages.columns, "out"]
    assert report(pages.limit(0)).collect() == []
