"""Main text of hand-made pages and of the test table's articles."""

import html
import re

import __spark_entry__ as entry
from wiresift.llm import html_extract

SF = "/root/testdata/sf0.001"
PARAGRAPH = "This is a paragraph of the article that has a fair number of words in it, as they do. " * 3


def test_furniture_goes():
    page = f"""<!doctype html><html><head><title>T</title><style>p {{ x }}</style></head><body>
      <header><a href=/>Home</a></header><nav><ul><li>One<li>Two</ul></nav>
      <div class="cookie-notice">We use cookies {PARAGRAPH}</div>
      <article><h1>A &amp; B&nbsp;&lt;c&gt;</h1><p>{PARAGRAPH}<p>Short.<br>More <b>bold</b>ly&#33;
      <div class="adBanner">Buy {PARAGRAPH}</div><form><input><button>Go</button></form>
      <script>var x = "</p><p>no";</script><p>{PARAGRAPH}</p></article>
      <section id="comments"><p>{PARAGRAPH}</p></section><aside>{PARAGRAPH}</aside><footer>(c)</footer></body></html>"""
    p = " ".join(PARAGRAPH.split())
    assert html_extract.extract(page) == f"A & B <c> {p} Short. More boldly! {p}"


def test_pages_without_an_article_element():
    page = f"<body><div><a>x</a> <a>y</a></div><div><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p></div><div><a>z</a></div>"
    p = " ".join(PARAGRAPH.split())
    assert html_extract.extract(page) == f"{p} Short. {p}"


def test_awkward():
    for page in (None, "", " ", "<", "<p", "<!--", "<script>x", "</p></p>", "<p></p>", "&#0;&bogus;<br/>" * 3):
        assert isinstance(html_extract.extract(page), str)
    assert html_extract.extract("just text") == "just text"
    assert html_extract.extract("<p>a\t b\n\n c</p><p>d") == "a b c d"
    assert len(html_extract.extract("<article>" + "<p>word</p>" * 50_000)) == 50_000 * 5 - 1
    assert html_extract.extract("<div>" * 5000 + "deep") == "deep"


def test_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, title string"
    rows = [(1, None, None, "t", 1, "x"), (None, "u", "<p>a", "t", 1, "x"), (2, "u", "<p>a", "t", 1, "x"), (2, "u", "<p>a", "t", 1, "x")]
    got = html_extract.extract_pages(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "title", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("a", 1), ("a", 1), ("a", 1)]
    assert html_extract.extract_pages(spark.createDataFrame([], schema)).count() == 0


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = entry.queries()["op1_html_extract"](spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        inner = re.sub(r"<(?!/?b>)[^<>]*>", " ", inner)
        assert r.text == " ".join(html.unescape(re.sub(r"</?b>", "", inner)).split())
        assert r.n_chars == len(r.text)


def test_furniture_words_on_articles_and_modifiers():
    p = " ".join(PARAGRAPH.split())
    for start, end in (('<article class="post comments-open">', "article"), ('<main class="content has-sidebar">', "main"),
                       ('<div id="content" class="with-sidebar">', "div"), ('<article class="tag-search">', "article"),
                       ('<div role="main" class="no-banner share">', "div"), ('<div class="hasSidebar">', "div")):
        page = f"""<body><nav><a>x</a></nav>{start}<p>{PARAGRAPH}</p><div class="share">Share {PARAGRAPH}</div>
          <p>{PARAGRAPH}</p></{end}><div class="sidebar">{PARAGRAPH}</div></body>"""
        assert html_extract.extract(page) == f"{p} {p}", start
    assert html_extract.extract(f"<article hidden>{PARAGRAPH}</article><p>seen") == "seen"
    nested = f'<article><p>{PARAGRAPH}</p><article class="comment">No {PARAGRAPH}</article></article>'
    assert html_extract.extract(nested) == p
    assert html_extract.extract(f'<div class="sidebar"><main>{PARAGRAPH}</main>No</div><p>x</p>') == p
    assert html_extract.extract(f'<div class="sidebar-layout"><article>{PARAGRAPH}</article></div>') == p


LINKS = "".join(f"<li><a href=/{i}>Another story number {i}</a></li>" for i in range(30))


def counter_examples():
    p = " ".join(PARAGRAPH.split())
    para = f"<p>{PARAGRAPH}</p>"
    yield f'<article>{para}<div class="more-links"><ul>{LINKS}</ul></div>{para}</article>', f"{p} {p}"
    yield f'<div class="content">{para}{para}</div><div class="responses">{para}<p>Nice one!</p></div>', f"{p} {p}"
    yield f'<article>{para}<section id="related-work"><h2>Work</h2>{para}</section><section class="search-results">{para}</section><p>End.</article>', \
        f"{p} Work {p} {p} End."
    yield f'<article>{para}<p class="social">On social life.</p><p id="notice">{PARAGRAPH}</p>{para}</article>', f"{p} On social life. {p} {p}"
    yield f"<main><ul>{LINKS}</ul>{para}{para}</main>", f"{p} {p}"
    teasers = "".join(f'<article><h3><a href=/{i}>Story {i}</a></h3><p>What it is about, in a sentence.</p></article>' for i in range(10))
    yield f'<article>{para}{para}</article><div class="more">{teasers}</div>', f"{p} {p}"
    yield f'<article>{para}<div class="related"><h3>Related</h3>{para}</div><div class="search-box">Find {PARAGRAPH}</div></article>', p
    yield f'<article>{para}<div class="login-terms"><a href=1>Log in</a> <a href=2>Sign up</a> <a href=3>Help</a></div></article>', p
    yield f'<article>{para}<ul><li>First point, with a <a href=x>link</a> in it.<li>Second point of the list.</ul><div><h2>Part</h2></div>{para}</article>', \
        f"{p} First point, with a link in it. Second point of the list. Part {p}"


def test_regions_by_ratio_and_names_by_doubt():
    for page, want in counter_examples():
        assert html_extract.extract(f"<html><body>{page}</body></html>") == want, page[:80]


def test_the_ratios_decide(monkeypatch):
    """With the threshold out of reach of any text, lists of links stay and other pages change."""
    pages = [f"<html><body>{page}</body></html>" for page, _ in counter_examples()]
    before = [html_extract.extract(p) for p in pages]
    monkeypatch.setattr(html_extract, "_threshold", lambda values: -1.0)
    assert sum(a != html_extract.extract(p) for a, p in zip(before, pages, strict=True)) >= 2


def test_a_page_of_links():
    assert html_extract.extract(f"<body><ul>{LINKS}</ul></body>").startswith("Another story number 0 Another")
